"""The Jaccard join against all pairs, and components against union-find."""

import random
import re

import duckdb
import pytest

from arbora.llm import jaccard
from arbora.llm.components import components

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t, k):
    w = W.findall((t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def union(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def brute(docs, k, percent):
    sets = {i: frozenset(shingle_set(t, k)) for i, t in docs}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    links = set()
    for i, s in sets.items():
        common = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        links |= {(i, j) for j, c in common.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)}
    comp = union(sets, links)
    return sorted((i, len(s), comp[i]) for i, s in sets.items())


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in "the ou an Er É".split() for b in range(40)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 30, 60, 120]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(t))
                edit = rng.random()
                t[at : at + (edit < 0.7)] = [rng.choice(vocab)] if edit < 0.4 or edit > 0.7 else []
                t = t or ["x"]
            docs.append(t)
            if rng.random() < 0.3:
                base = t
    passage = [rng.choice(vocab) for _ in range(50)]
    docs += [passage + [rng.choice(vocab) for _ in range(rng.choice([3, 6, 9, 12]))] for _ in range(30)]
    texts = [rng.choice([" ", "  ", "\n"]).join(t) for t in docs]
    texts += [None, "", " \n", "one", "ONE", "one two three", "one two three four", "one two three", texts[0].upper().replace("É", "É"), "a " * 3000, "a a a a", "w " + " ".join(f"z{i}" for i in range(20000))]
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,k,percent,levels", [(1, 4, 85, 2), (2, 5, 80, 2), (3, 2, 60, 1), (4, 3, 70, 3)])
def test_all_pairs(spark, seed, k, percent, levels):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, component string").repartition(3)
    want = brute(docs, k, percent)
    assert len({c for _, _, c in want}) < len(want) - 50
    assert sorted(map(tuple, jaccard.jaccard_components(df, k, percent, levels=levels).collect())) == want


def test_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(df, 4, 85).collect())) == [(1, 2, 1), (2, 0, 2)]
    assert jaccard.jaccard_components(df.limit(0), 4, 85).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(300)]
    got = components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()
    ids = {i for a, b in links if a != b for i in (a, b)}
    assert {r.id: r.component for r in got} == union(ids, [x for x in links if x[0] != x[1]])


def test_query_on_small_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.connect().execute(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    assert sorted(map(tuple, jaccard.op10_jaccard_join(spark, d).collect())) == brute(docs, 4, 85)
