"""Ranked lexical search the other way round: few items, many documents.

An inverted index over the items' terms is broadcast and each document goes through it once, so nothing is shuffled by term or by document:

1. matches(): every document's terms are counted; those that an item holds are kept as packed (term, count) arrays, one row a document, in
   the shared folder. From these rows come N, L and the documents that hold each of the items' terms.
2. heaps(): a task streams its documents' rows through the postings, adds up each item's score and keeps the k best of each item.
3. The tasks' heaps meet item by item, in two steps: first those of a PARTS-th of the tasks, then PARTS heaps.

The index is bounded: items are dealt to as many groups as keep a group's terms within INDEX_BYTES, and each group is one round over the
documents. (One item alone beyond the bound is a group of its own.)

A term is a maximal run of letters, digits and characters beyond ASCII, with A-Z in lower case, of the whole text, whatever its length.
Null and empty texts have no terms and are in no result. Rows that share an item id are one item with the terms of all; a null item id is left
out. Documents that share an id are ranked each; those with a null id count in N, L and df but cannot be named and are not returned. Equal scores
go by ascending id. An empty table of either kind gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.llm.batches import give_back, pieces
from arbora.session import stash, table

INDEX_BYTES, TEXT_SLICE, CELLS, PARTS = 16 << 20, 1 << 20, 1 << 20, 256
#: Separators become spaces, A-Z lower case; bytes of characters beyond ASCII stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """How often a text holds each term (UTF-8). Long texts are counted slice by slice, cut between terms."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    if len(raw) <= TEXT_SLICE:
        return Counter(raw.split())
    found, at = Counter(), 0
    while at < len(raw):
        end = raw.find(b" ", at + TEXT_SLICE)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, term); term is binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for item, words in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                terms = list(term_counts(words))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), batch.schema.field("item").type), pa.array(terms, pa.binary())], ["item", "term"])

    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, term binary").distinct()


class Index:
    """Postings of a group of items: term number to item numbers, as arrays."""

    def __init__(self, pairs: list[tuple[object, bytes]]):
        self.items = sorted({i for i, _ in pairs})
        at = {x: n for n, x in enumerate(self.items)}
        self.terms = {t: n for n, t in enumerate(sorted({t for _, t in pairs}))}
        order = np.array(sorted((self.terms[t], at[i]) for i, t in pairs), np.int64).reshape(-1, 2)
        term, self.item = order.T
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))


def matches(docs: DataFrame, terms: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, term, tf) of each document with a term: how many terms it has, and numbers and counts of those asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in pieces(batches, "text"):
            ids, n, term, tf = [], [], [], []
            for i, words in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = term_counts(words)
                if found:
                    own = [(number[t], c) for t, c in found.items() if t in number]
                    ids.append(i)
                    n.append(found.total())
                    term.append(np.array([t for t, _ in own], "<i4").tobytes())
                    tf.append(np.array([c for _, c in own], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(term, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "term", "tf"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, term binary, tf binary")


def statistics(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("term").to_pylist()), "<i4")
            total[:-2] += np.bincount(held, minlength=n_terms)
            total[-2:] += batch.num_rows, int(batch.column("n").to_numpy().sum())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "c"])

    total = np.zeros(n_terms + 2, np.int64)
    # a row a term of the bounded index, at most
    for r in found.select("n", "term").mapInArrow(run, "at long, c long").groupBy("at").agg(F.sum("c").alias("c")).collect():
        total[r.at] = r.c
    return int(total[-2]), int(total[-1]), total[:-2]


def heaps(found: DataFrame, index: Index, n_docs: int, n_terms: int, df: np.ndarray, k: int) -> DataFrame:
    """(item number, doc_id, score, task): the k best documents of each item in each task."""
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    shared = found.sparkSession.sparkContext.broadcast((weight, index.start, index.item, len(index.items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, postings, n_items = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)
        step = max(1, CELLS // n_items)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids, lengths, held = part.column("doc_id").to_pylist(), part.column("n").to_pylist(), part.column("term").to_pylist()
                sizes = np.array([len(x) // 4 for x in held])
                term = np.frombuffer(b"".join(held), "<i4").astype(np.int64)
                tf = np.frombuffer(b"".join(part.column("tf").to_pylist()), "<i4").astype(np.int64)
                m = np.array([10 + 90 * n * n_docs // n_terms for n in lengths], np.int64)
                doc = np.repeat(np.arange(len(ids)), sizes)
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                score = np.zeros(len(ids) * n_items, np.int64)
                each = start[term + 1] - start[term]
                cuts = np.searchsorted(np.cumsum(each), np.arange(0, each.sum() + 4 * CELLS, 4 * CELLS), "left")
                for a, b in zip([0, *cuts[1:].tolist()], [*cuts[1:].tolist(), len(term)]):
                    if b > a:
                        many = each[a:b]
                        ends = np.cumsum(many)
                        place = np.arange(ends[-1]) - np.repeat(ends - many - start[term[a:b]], many)
                        np.add.at(score, np.repeat(doc[a:b] * n_items, many) + postings[place], np.repeat(gain[a:b], many))
                score = score.reshape(len(ids), n_items)
                at, item = np.nonzero(score >= least)
                for a, i, s in zip(at.tolist(), item.tolist(), score[at, item].tolist()):
                    if ids[a] is None:
                        continue
                    heap, new = best[i], (s, -ids[a])
                    if len(heap) < k:
                        heapq.heappush(heap, new)
                    elif new > heap[0]:
                        heapq.heapreplace(heap, new)
                    if len(heap) == k:
                        least[i] = heap[0][0]
        give_back()
        rows = [(i, -d, s) for i, heap in enumerate(best) for s, d in heap]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())], ["item", "doc_id", "score", "task"])

    return found.mapInArrow(run, "item long, doc_id long, score long, task int")


def _merged(best: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    pairs = stash(item_terms(items, item_id, text), "items")
    kind = pairs.schema["item"].dataType
    size = pairs.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    groups = max(1, math.ceil(size / index_bytes))
    whole = None
    for group in range(groups):
        index = Index([tuple(r) for r in pairs.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == group).collect()])
        if not index.items:
            continue
        found = stash(matches(docs, index.terms, doc_id, text), "matches")
        n_docs, n_terms, df = statistics(found, len(index.terms))
        best = heaps(found, index, n_docs, n_terms, df, k)
        best = _merged(_merged(best.withColumn("part", F.col("task") % PARTS), ["item", "part"], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame(list(enumerate(index.items)), f"item long, item_id {kind.simpleString()}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        whole = best if whole is None else whole.unionByName(best)
    if whole is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return whole


def op13_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term), total WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op13_reversed_search": op13_reversed_search}
ORACLES = {"op13_reversed_search": _ORACLE}
