"""Repeated strings against brute force over all windows."""

import hashlib
import random

import duckdb
import pytest

from arbora.llm import repeats


def brute(docs, size):
    first = {}
    for i, t in docs:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - size + 1):
                w = b[p : p + size]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            end = 0
            for p in range(len(b) - size + 1):
                if first[b[p : p + size]] < i:
                    for q in range(max(p, end), p + size):
                        gone[q] = True
                    end = p + size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ou", "the", "ti", "é", "an", "on"]) for _ in range(rng.randrange(1, 4)))
    passage = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        docs.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    for _ in range(30):
        t = list(rng.choice(docs)[1])
        if t:
            t[rng.randrange(len(t))] = "X"
        docs.append((len(docs), "".join(t)))
    docs += [(500, None), (501, ""), (502, "a" * 400), (503, "a" * 70), (504, "ab" * 100), (505, "é" * 60), (3, docs[4][1]), (506, docs[4][1]), (506, docs[4][1]), (None, docs[4][1]), (507, "b" + "a" * 49), (508, "x" * 49)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("size,gram", [(50, 20), (24, 8)])
def test_brute_force(spark, monkeypatch, size, gram):
    monkeypatch.setattr(repeats, "PIECE", 1 << 11)
    docs = corpus()
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, chunk int, rest string").repartition(3)
    rows = repeats.repeat_digests(df, size=size, gram=gram).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    want = brute(docs, size)
    assert sum(w[2] for w in want) > 5000
    assert got == want
    cut = repeats.remove_repeats(df, size=size, gram=gram)
    assert cut.columns == [*df.columns, "n_removed"]
    texts = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, r.chunk, r.rest) for r in cut.collect())
    assert texts == sorted((w[0], w[2], 1, "c") for w in want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeat_digests(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0


def test_query_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = duckdb.connect().execute(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    assert sorted(map(tuple, repeats.op4_suffix_dedup(spark, d).collect())) == brute(docs, 50)
