"""Ranked search against a plain scorer of every item and document."""

import math
import re
from collections import Counter

import duckdb

from arbora.llm import reversed_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in asked.items():
        df = {w: sum(w in c for _, c in counted) for w in words}
        scores = []
        for d, c in counted:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words)
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, n + 1, d, -s) for n, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


DOCS = [(1, "The cat sat, the CAT ran"), (2, "dog-cat\x00dog"), (3, None), (4, ""), (5, "!!! ..."), (6, "ÄPFEL äpfel Äpfel"), (7, "cat " * 5000 + "mouse"), (8, "the the the"), (9, "the the the"), (9, "the the the"), (None, "dog mouse unseen")]
DOCS += [(100 + i, f"w{i % 7} w{i % 3} cat end{i}") for i in range(60)]
ITEMS = [(1, "Cat the"), (2, "Äpfel"), (3, None), (4, "nothing here at all"), (5, "mouse"), (5, "DOG, dog"), (None, "cat"), (6, "w1 w2 w0 w5"), (7, "")]


def test_against_every_pair(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, item_id string").repartition(5)
    items = spark.createDataFrame([(*i, 1.0) for i in ITEMS], "item_id long, text string, doc_id double")
    assert rows(reversed_search.search(docs, items, 4)) == brute(DOCS, ITEMS, 4)
    assert rows(reversed_search.search(docs, items, 4, index_bytes=150)) == brute(DOCS, ITEMS, 4)


def test_long_texts_are_counted_by_slices(monkeypatch):
    text = "ab Cd é-9 " * 40 + "zz" * 300
    whole = reversed_search.term_counts(text)
    monkeypatch.setattr(reversed_search, "TEXT_SLICE", 7)
    assert reversed_search.term_counts(text) == whole == Counter(t.encode() for t in terms(text))


def test_empty(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert reversed_search.search(docs.limit(0), items).count() == 0
    assert reversed_search.search(docs, items.limit(0)).count() == 0
    assert reversed_search.search(docs.where("text is null"), items).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(reversed_search.ORACLES["op13_reversed_search"]).fetchall()
    assert rows(reversed_search.op13_reversed_search(spark, d)) == sorted(want)
