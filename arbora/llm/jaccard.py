"""N-gram Jaccard join of documents in metric space: exact components of "similar enough" over sets of distinct word shingles.

Jaccard distance d is a metric, and with a bound t on it (t = 1 - similarity):

1. Documents with equal sets are one point (the smallest id stands for them).
2. How many points hold each shingle is counted for the whole corpus (packed keys, see exchange.py). A shingle of one point can be in no
   intersection, so a point whose other shingles are too few for the similarity is alone, and leaves.
3. Shingles are ordered by count, rarest first, then by hash. Two points within t share a shingle of both their prefixes (the first
   n - ceil(s n) + 1), so the holders of a prefix shingle form a region to join, and no pair can be missed.
4. Each region takes as pivot its holder with the fewest shingles of its own, the one nearest the middle of a group of near copies. Its
   distances to all holders are computed exactly. Holders within t are linked to it: its Voronoi cell, one component.
5. Regions join recursively: holders outside the cell get a pivot among themselves, LEVELS times in all, with exact distances again.
6. What remains are pairs of different components of which one lies outside the first cell. A pair x, y can be within t only if
   |d(x, p) - d(y, p)| <= t for every pivot p of the region (the triangle inequality's window: boundary points meet the cell's members there),
   if the sizes allow it, and if enough shingles follow the shared one in both. Those pairs are compared exactly.

So a group of g copies costs g comparisons with its pivots, not g squared. Only links between different components are looked for:
the result is the components, exactly. Null, empty and wordless texts have an empty set and are linked with nothing. Rows with a null
id are left out. Of rows that share an id one row is returned: the one with the smallest set hash counts. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.batches import flat_bytes, give_back, pieces
from arbora.llm.components import components
from arbora.llm.exchange import bucket_cuts, chunk_of, counts, dealt, pack, placed, text_bytes, unpack
from arbora.llm.words import distinct, mix, per_text, shingles, words
from arbora.session import stash, table

LEVELS = 2
_U = np.uint64


def _sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a column, and where each text's begin and end."""
    raw, at = flat_bytes(column)
    h, first, _ = words(raw, at, lower=True)
    s, of = shingles(h, per_text(first, at), k)
    return distinct(s, of, len(at) - 1)


def _marks(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for seed in (11, 12):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s, seed))])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]], seed).view(np.int64))
    return out[0], out[1]


def set_marks(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and the two hashes of the set, one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            s, bounds = _sets(batch.column("text"), k)
            a, b = _marks(s, bounds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(a), pa.array(b)], ["doc_id", "n_shingles", "k1", "k2"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")
    return marks.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_shingles")).alias("m")).select("doc_id", "m.n_shingles", "m.k1", "m.k2")


_SENT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("key", pa.binary()), ("n", pa.binary())])
_ANSWER = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("code", pa.binary())])


def _count(sent: pa.Table) -> pa.Table:
    """A code for how many points hold each key: 0 for one, else growing with the logarithm."""
    rows = sent.to_pylist()
    key = np.concatenate([unpack(r["key"], 5) for r in rows])
    n = np.concatenate([np.frombuffer(r["n"], "<u2") for r in rows]).astype(np.int64)
    uniq, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, n, len(uniq))
    give_back()
    code = np.minimum(np.ceil(6 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)[back]
    ends = np.cumsum([len(r["key"]) // 5 for r in rows])
    return pa.Table.from_pylist([{"bucket": r["bucket"], "chunk": r["chunk"], "code": code[e - len(r["key"]) // 5 : e].tobytes()} for r, e in zip(rows, ends)], _ANSWER)


def shared_sets(docs: DataFrame, points: DataFrame, k: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, own, shingles): for points that can have a partner their size, how many shingles no other has, and the rest rarest first."""
    n_chunks, n_buckets = counts(text_bytes(docs, text), 1 / 6)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("chunk", chunk_of("doc_id", n_chunks))
    named = points.select("doc_id", "k1", "k2", chunk_of("doc_id", n_chunks).alias("chunk"))

    def sets(group: pa.Table, of: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, sets and bounds of the chunk's points, its distinct shingles in the exchange's order, and each shingle's place there."""
        want = {r["doc_id"]: (r["k1"], r["k2"]) for r in of.select(["doc_id", "k1", "k2"]).to_pylist() if r["doc_id"] is not None}
        ids, parts, sizes = [], [np.zeros(0, np.uint64)], []
        for batch in pieces(group.select(["doc_id", "text"]).combine_chunks().to_batches(), "text", 1 << 19):
            s, bounds = _sets(batch.column("text"), k)
            a, b = _marks(s, bounds)
            for i, d in enumerate(batch.column("doc_id").to_pylist()):
                if want.get(d) == (a[i], b[i]):
                    del want[d]
                    ids.append(d)
                    parts.append(s[bounds[i] : bounds[i + 1]])
                    sizes.append(bounds[i + 1] - bounds[i])
        own = np.concatenate(parts)
        order, back = np.unique(placed(own, n_buckets), return_inverse=True)
        return np.array(ids, np.int64), own, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), order, back

    def ask(key: tuple, group: pa.Table, of: pa.Table) -> pa.Table:
        _, _, _, order, back = sets(group, of)
        n = np.minimum(np.bincount(back, minlength=len(order)), 0xFFFF).astype("<u2")
        cuts = bucket_cuts(order, n_buckets)
        give_back()
        out = [{"bucket": b, "chunk": key[0].as_py(), "key": pack(order[i:j], 5), "n": n[i:j].tobytes()} for b, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if j > i]
        return pa.Table.from_pylist(out, _SENT)

    def rank(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        ids, own, bounds, order, back = sets(group, answers)
        found = sorted((r["bucket"], r["code"]) for r in answers.select(["bucket", "code"]).to_pylist() if r["code"] is not None)
        code = np.frombuffer(b"".join(c for _, c in found), np.uint8)
        if len(code) != len(order):
            raise RuntimeError(f"a chunk asked about {len(order)} shingles and got {len(code)} answers")
        code = code[back]
        give_back()
        out = []
        for i, d in enumerate(ids.tolist()):
            c, s = code[bounds[i] : bounds[i + 1]], own[bounds[i] : bounds[i + 1]]
            many = c > 0
            if 100 * many.sum() >= percent * len(s) > 0:
                c, s = c[many], s[many]
                out.append({"doc_id": d, "n": len(many), "own": len(many) - len(s), "shingles": s[np.lexsort((s, c))].view(np.int64)})
        return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("own", pa.int32()), ("shingles", pa.list_(pa.int64()))]))

    by_chunk = dealt(rows, "chunk", n_chunks).groupBy("chunk")
    sent = by_chunk.cogroup(dealt(named, "chunk", n_chunks).groupBy("chunk")).applyInArrow(ask, "bucket int, chunk int, key binary, n binary")
    answers = dealt(sent, "bucket", n_buckets).groupBy("bucket").applyInArrow(_count, "bucket int, chunk int, code binary")
    with_points = answers.unionByName(named, allowMissingColumns=True)
    return by_chunk.cogroup(dealt(with_points, "chunk", n_chunks).groupBy("chunk")).applyInArrow(rank, "doc_id long, n int, own int, shingles array<bigint>")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact Jaccard distances of pairs (a, b), with the sizes of their intersection and union."""
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("shingles").alias(f"s_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).alias("both"))
    return both.select("a", "b", "both", (F.col("n_a") + F.col("n_b") - F.col("both")).alias("all"))


def _near(percent: int) -> Column:
    return 100 * F.col("both") >= percent * F.col("all")


def jaccard_links(sets: DataFrame, percent: int, levels: int = LEVELS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs with 100 * intersection >= percent * union."""
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9).cast("int") + 1
    held = sets.where(prefix > F.col("own")).select("doc_id", "n", "own", F.posexplode(F.slice("shingles", 1, prefix - F.col("own"))).alias("at", "shingle"))
    held = stash(held.select("shingle", "doc_id", "n", "own", (F.col("at") + F.col("own")).alias("at")), "prefixes")
    bound = 1 - percent / 100.0 + 1e-9
    open_, links, regions = held.select("shingle", "doc_id", "own"), None, held
    for level in range(levels):
        pivots = open_.groupBy("shingle").agg(F.min(F.struct("own", "doc_id")).alias("p"), F.count("*").alias("c")).where("c > 1").select("shingle", F.col("p.doc_id").alias("pivot"))
        met = open_.join(pivots, "shingle").where("doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).distinct()
        known = stash(_distances(met, sets), "pivots")
        cell = known.where(_near(percent)).select("a", "b")
        links = cell if links is None else links.unionByName(cell)
        d = f"d{level}"
        there = known.select(F.col("a").alias("doc_id"), F.col("b").alias("pivot"), (1 - F.col("both") / F.col("all")).alias(d), _near(percent).alias("near"))
        placed_ = open_.join(pivots, "shingle").join(there, ["doc_id", "pivot"], "left").select("shingle", "doc_id", "own", F.when(F.col("doc_id") == F.col("pivot"), 0.0).otherwise(F.col(d)).alias(d), F.coalesce("near", F.lit(True)).alias("near"))
        placed_ = stash(placed_, "regions")
        regions = regions.join(placed_.select("shingle", "doc_id", d, *([F.col("near").alias("inside")] if level == 0 else [])), ["shingle", "doc_id"], "left")
        open_ = placed_.where("not near").select("shingle", "doc_id", "own")
    comp = components(links)
    regions = stash(regions.where("d0 is not null").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), "regions")
    x, y = regions.alias("x"), regions.where("not inside").alias("y")
    windows = [F.col("x.d0").between(F.col("y.d0") - bound, F.col("y.d0") + bound)]
    windows += [F.coalesce(F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) <= bound, F.lit(True)) for i in range(1, levels)]
    total = F.col("x.n") + F.col("y.n")
    sizes = [100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"), (100 + percent) * F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= percent * total]
    apart = [F.col("x.component") != F.col("y.component"), F.col("x.inside") | (F.col("x.doc_id") < F.col("y.doc_id"))]
    on = F.col("x.shingle") == F.col("y.shingle")
    for c in [*apart, *windows, *sizes]:
        on = on & c
    left = x.join(y, on).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    return links.unionByName(_distances(left, sets).where(_near(percent)).select("a", "b"))


def jaccard_components(docs: DataFrame, k: int, percent: int, doc_id: str = "doc_id", text: str = "text", levels: int = LEVELS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links reach) of every document."""
    marks = stash(set_marks(docs, k, doc_id, text), "sets")
    points = stash(marks.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")), "points")
    sets = stash(shared_sets(docs, points, k, percent, doc_id, text), "shared")
    comp = components(jaccard_links(sets, percent, levels))
    whole = points.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("k1", "k2", F.coalesce("component", "doc_id").alias("component"))
    found = marks.join(whole, ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
ORACLES: dict[str, str] = {}
