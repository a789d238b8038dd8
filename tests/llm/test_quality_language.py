"""Quality rules and language identification against brute force and held-out labels."""

import re
import zlib

import duckdb
import numpy as np
import pytest

from arbora.llm import language, line_crf, quality

W = re.compile(r"[^\x20\x09-\x0D]+")
D = "/root/testdata/sf0.01"
TEXTS = [None, "", " \n\t ", "a", "a a a a", "x y z x y z q", "l1 w\nl1 w\nl1 w\r\n\n\nl1 w", "é ü | # <b> 日本\n日本\n日本", "one\n one\none ", "\n\nz\n", "w1 w2 w3\n" * 30, " ".join(f"w{i}" for i in range(3000)), "a\x0bb\x0cc\x1cd\x85e\xa0f"]


def brute(text):
    text = text or ""
    w = W.findall(text)
    tri = list(zip(w, w[1:], w[2:]))
    seen = {}
    for t in tri:
        seen[t] = seen.get(t, 0) + 1
    cover = {i + j for i, t in enumerate(tri) if seen[t] > 1 for j in range(3)}
    before, dups = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dups += line in before
            before.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(cover)


def check(rows, docs):
    for r in rows:
        n = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, docs[r.doc_id]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)


def test_base_counts(spark):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(2)
    got = quality.judge(df.union(df), None).collect()
    assert len(got) == 2 * len(TEXTS)
    check(got, dict(enumerate(TEXTS)))
    assert quality.judge(df.limit(0), None).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 3, 0, 7]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(20):
        x = rng.normal(size=(bounds[-1], 2))
        model = line_crf.LineCRF(rng.normal(size=2), rng.normal(size=(2, 2)))
        got = line_crf.viterbi(model, x, bounds)
        for a, b in zip(bounds, bounds[1:]):
            def score(y):
                return sum((x[a + i] @ model.emit) * v for i, v in enumerate(y)) + sum(model.move[u, v] for u, v in zip(y, y[1:]))
            if b > a:
                best = max(score([k >> i & 1 for i in range(b - a)]) for k in range(1 << (b - a)))
                assert score(list(got[a:b])) == pytest.approx(best)


def test_training_learns_a_chain():
    rng = np.random.default_rng(1)
    y = np.concatenate([np.r_[np.ones(10), np.zeros(10)] for _ in range(80)]).astype(int)
    x = np.stack([np.ones(len(y)), y + rng.normal(scale=0.8, size=len(y))], 1)
    bounds = np.arange(0, len(y) + 1, 20)
    got = line_crf.viterbi(line_crf.train(x, y, bounds), x, bounds)
    assert (got == y).mean() > ((x[:, 1] > 0.5) == y).mean() + 0.15  # a line by itself: 0.73


def test_quality_query(spark):
    con = duckdb.connect()
    docs = dict(con.execute(f"select doc_id, text from '{D}/documents.parquet'").fetchall())
    good = dict(con.execute(f"select doc_id, quality from '{D}/labels.parquet'").fetchall())
    rows = quality.op8_quality(spark, D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check(rows, docs)
    keep = [r.kept for r in rows if good.get(r.doc_id) == 1 and not r.base_failed]
    drop = [r.kept for r in rows if good.get(r.doc_id) == 0]
    assert sum(keep) / len(keep) > 0.97 and sum(drop) / len(drop) < 0.1


def test_no_labels_keeps_what_passes(spark):
    docs = spark.createDataFrame([(1, "w " * 3), (2, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    assert {r.doc_id: r.kept for r in quality.judge(docs, None).collect()} == {1: False, 2: True}


def test_language_held_out(spark):
    truth = dict(duckdb.connect().execute(f"select doc_id, lang from '{D}/documents.parquet'").fetchall())
    rows = language.op9_language(spark, D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_cases(spark):
    rows = [(1, "the cat and the dog " * 20, "en"), (2, "le chat et le chien " * 20, "fr"), (3, None, "fr"), (4, "12 34 !", None), (5, "", "en"), (6, "the dog and the cat", None), (None, "x", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = language.learn(df)
    assert list(known) == ["en", "fr"]
    got = {r.doc_id: r for r in language.predict(df, known).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 6)] == ["en", "fr", "und", "und", "und", "en"]
    assert language.predict(df, {}).where("lang_pred <> 'und'").count() == 0
    assert language.predict(df, {"en": known["en"]}).where("doc_id = 6").collect()[0].lang_pred == "en"
    assert language.learn(df.limit(0)) == {}
