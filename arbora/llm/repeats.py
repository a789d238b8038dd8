"""Repeated strings: bytes covered by a string of `size` bytes that also starts in a document with a smaller id.

Nothing is sorted by its bytes: windows of `size` bytes are grouped by hashes of what equal windows share, in three passes; a pass drops what stands alone,
and after the last one equal groups are exactly the repeated windows:

1. By anchor, the window's smallest hashed GRAM-byte string. Neighbouring windows share it, so a run of them is one entry. Runs whose anchor no
   other document has are dropped.
2. By the run's whole segment. A segment that a smaller document has too is removed whole; one that is its document's own or the first is
   settled too, unless other segments with its anchor come from other documents.
3. Only of those first occurrences, each window by all its bytes.

Each pass sends packed distinct keys to buckets and gets one answer a key back (see exchange.py): the smallest document wins, which is
all that is needed, so no group is ever gathered. Strings are told apart by at least 80 bits of two independent hashes.

Null and empty texts have nothing to remove. Rows with a null id neither lose nor explain a byte. Rows that share an id do not
count as smaller than each other. Texts shorter than `size` stay whole. Only the id and text columns are used; bytes left over from
characters cut in half count as kept in the digests (bytes), and are left out of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.batches import flat_bytes, give_back
from arbora.llm.exchange import bucket_cuts, chunk_of, counts, dealt, pack, placed, unpack
from arbora.llm.words import mix
from arbora.session import table

SIZE, GRAM, PIECE = 50, 20, 1 << 18
_U = np.uint64
PROOF = 5  # bytes of the second hash that travel
_SEG = _U((1 << 8 * PROOF) - 1)
_RNG = np.random.default_rng(46021)
_BYTE = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4D]
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64."""
    have = _POW.get(which)
    if have is None or len(have[0]) < n:
        size, out = max(n, 2 * PIECE), []
        for base in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POW[which] = (out[0], out[1])
    return have


class Hashes:
    """Hashes of any substrings of a piece: differences of prefix sums, shifted to a common power."""

    def __init__(self, raw: np.ndarray):
        self.sums, self.back = [], []
        for which in (0, 1):
            up, down = _powers(which, len(raw) + 1)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[which][raw] * up[: len(raw)])]))
            self.back.append(down)

    def one(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        x = np.take(self.sums[which], b)
        x -= np.take(self.sums[which], a)
        x *= np.take(self.back[which], a)
        return x

    def grams(self, n: int) -> np.ndarray:
        """key() of the n-byte strings at all places."""
        sums = self.sums[0]
        x = sums[n:] - sums[: len(sums) - n]
        x *= self.back[0][: len(x)]
        return mix(x)

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.one(a, b))

    def proof(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(self.one(a, b) * _U(0xD6E8FEB86659FD93) + mix(self.one(a, b, 1), 3), 5) & _SEG


def runs(raw: np.ndarray, at: np.ndarray, size: int, gram: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, place after the last window's last byte, anchor."""
    h = Hashes(raw)
    none = np.zeros(0, np.int64)
    if len(raw) < size:
        return h, none, none, none
    bits = _U(max(1, len(raw).bit_length()))
    low = h.grams(gram)
    low >>= bits
    low <<= bits
    low |= np.arange(len(low), dtype=np.uint64)
    wide, span = size - gram + 1, 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    anchor = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int32)
    long = np.diff(at) >= size
    np.add.at(inside, at[:-1][long], 1)
    np.add.at(inside, at[1:][long] - size + 1, -1)
    ok = np.cumsum(inside[: len(anchor)]) > 0
    p = np.flatnonzero(ok)
    if not len(p):
        return h, none, none, none
    a = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)  # windows of different documents are never next to each other
    first = np.flatnonzero(new)
    return h, p[first], p[np.append(first[1:], len(p)) - 1] + size, a[first]


def _array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _lean(f: Callable) -> Callable:
    """f, after which the worker gives back what it freed."""

    def run(*args):
        try:
            return f(*args)
        finally:
            give_back()

    return run


class Chunk:
    """The documents of one chunk, cut in pieces, and their runs."""

    def __init__(self, docs: pa.Table, size: int, gram: int, n_buckets: int, base: int):
        docs = docs.combine_chunks()
        known = docs.filter(pa.compute.is_valid(docs["doc_id"])).combine_chunks()
        self.size, self.n_buckets = size, n_buckets
        self.id = known["doc_id"].to_numpy().astype(np.int64).view(np.uint64) - _U(base % (1 << 64))  # distances from the smallest id, up to 2^64
        self.raw, self.at = flat_bytes(_array(known["text"]))
        block = self.at[:-1] // PIECE
        cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(self.id)] if len(self.id) else [0]
        self.pieces = list(zip(cut, cut[1:]))
        parts = []
        for i, j in self.pieces:
            h, a, b, anchor = runs(*self.piece(i, j), size, gram)
            parts.append((a + self.at[i], b + self.at[i], placed(h.key(anchor, anchor + gram), n_buckets), h.proof(a, b)))
        self.a, self.b, self.anchor, self.segment = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.doc = self.id[np.searchsorted(self.at, self.a, "right") - 1] if len(self.a) else np.zeros(0, np.uint64)

    def piece(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        return self.raw[self.at[i] : self.at[j]], self.at[i : j + 1] - self.at[i]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places, keys, proofs and documents of all windows of the chosen runs."""
        out = []
        for i, j in self.pieces:
            lo, hi = np.searchsorted(self.a, [self.at[i], self.at[j]])
            mine = np.flatnonzero(chosen[lo:hi]) + lo
            if len(mine):
                n = self.b[mine] - self.a[mine] - self.size + 1
                p = np.repeat(self.a[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
                h, q = Hashes(self.piece(i, j)[0]), p - self.at[i]
                out.append((p, placed(h.key(q, q + self.size), self.n_buckets), h.proof(q, q + self.size), np.repeat(self.doc[mine], n)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


class Entries:
    """Distinct (key, proof) pairs of a chunk in order, each with its smallest document; back finds each row's pair."""

    def __init__(self, key: np.ndarray, proof: np.ndarray, doc: np.ndarray):
        order = np.lexsort((doc, proof, key))
        k, p = key[order], proof[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
        self.key, self.proof, self.doc = k[new], p[new], doc[order][new]
        self.back = np.empty(len(k), np.int64)
        self.back[order] = np.cumsum(new) - 1

    def rows(self, kind: int, chunk: int, n_buckets: int, width: int) -> list[dict]:
        cuts = bucket_cuts(self.key, n_buckets)
        return [
            {"kind": kind, "bucket": b, "chunk": chunk, "key": pack(self.key[i:j], 5), "proof": pack(self.proof[i:j], PROOF), "doc": pack(self.doc[i:j], width)}
            for b, (i, j) in enumerate(zip(cuts.tolist(), cuts[1:].tolist()))
            if j > i
        ]


_SENT = "kind int, bucket int, chunk int, key binary, proof binary, doc binary"
_ANSWER = "kind int, bucket int, chunk int, code binary"
_SENT_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("key", pa.binary()), ("proof", pa.binary()), ("doc", pa.binary())])
_ANSWER_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int32()), ("code", pa.binary())])


def settle(sent: pa.Table, width: int) -> pa.Table:
    """The answers of one bucket. 1: a smaller document has this string. 2: this is the first, and strings that share its key come from several documents. 0: nothing to do."""
    rows = sent.to_pylist()
    sizes = np.array([len(r["key"]) // 5 for r in rows])
    key = np.concatenate([unpack(r["key"], 5) for r in rows])
    proof = np.concatenate([unpack(r["proof"], PROOF) for r in rows])
    doc = np.concatenate([unpack(r["doc"], width) for r in rows])
    order = np.lexsort((doc, proof, key))
    k, p, d = key[order], proof[order], doc[order]
    new_key = np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new = new_key.copy()
    new[1:] |= p[1:] != p[:-1]
    first = d[new][np.cumsum(new) - 1]
    at = np.flatnonzero(new_key)
    of = np.cumsum(new_key) - 1
    mixed = (np.minimum.reduceat(first, at) < np.maximum.reduceat(first, at))[of]
    code = np.empty(len(k), np.uint8)
    code[order] = np.where(d > first, 1, np.where(mixed, 2, 0))
    ends = np.cumsum(sizes)
    return pa.Table.from_pylist([{"kind": r["kind"], "bucket": r["bucket"], "chunk": r["chunk"], "code": code[e - s : e].tobytes()} for r, s, e in zip(rows, sizes, ends)], _ANSWER_ARROW)


def _codes(answers: pa.Table, kind: int, n: int) -> np.ndarray:
    rows = sorted((r["bucket"], r["code"]) for r in answers.to_pylist() if r["kind"] == kind)
    code = np.frombuffer(b"".join(c for _, c in rows), np.uint8)
    if len(code) != n:
        raise RuntimeError(f"a chunk asked about {n} strings and got {len(code)} answers")
    return code


def _covered(chunk: Chunk, first: Entries, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that are removed whole, and runs whose windows are ordered one by one."""
    own, least = code[first.back], first.doc[first.back]
    whole = (own == 1) | (chunk.doc > least)
    return whole, (own == 2) & ~whole


def find_repeats(docs: DataFrame, finish: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str | T.StructType, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Apply finish(documents of a chunk, their bytes, where each begins and ends, which bytes are covered) to every chunk."""
    stats = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.min(doc_id).alias("lo"), F.max(doc_id).alias("hi")).first()
    base = int(stats.lo or 0)
    width = max(1, (int(stats.hi or 0) - base).bit_length() + 7 >> 3)  # bytes of an id less the smallest
    n_chunks, n_buckets = counts(int(stats.b or 0), 2 / (size - gram + 2))
    rest = [c for c in docs.columns if c not in (doc_id, text)]
    chunked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(*rest).alias("rest") if rest else F.lit(None).cast("int").alias("rest"), chunk_of(doc_id, n_chunks).alias("chunk"))

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        c = Chunk(group, size, gram, n_buckets, base)
        return pa.Table.from_pylist(Entries(c.anchor, c.segment, c.doc).rows(1, key[0].as_py(), n_buckets, width), _SENT_ARROW)

    def ask_windows(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(group, size, gram, n_buckets, base)
        first = Entries(c.anchor, c.segment, c.doc)
        _, chosen = _covered(c, first, _codes(answers, 1, len(first.key)))
        _, k, p, d = c.windows(chosen)
        return pa.Table.from_pylist(Entries(k, p, d).rows(2, key[0].as_py(), n_buckets, width), _SENT_ARROW)

    def cover(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = pa.compute.sort_indices(pa.compute.is_valid(group["doc_id"]).cast(pa.int8()), sort_keys=[("", "descending")])
        group = group.take(order).combine_chunks()  # rows without an id last: Chunk leaves them out
        c = Chunk(group, size, gram, n_buckets, base)
        first = Entries(c.anchor, c.segment, c.doc)
        whole, chosen = _covered(c, first, _codes(answers, 1, len(first.key)))
        place, k, p, d = c.windows(chosen)
        second = Entries(k, p, d)
        code = _codes(answers, 2, len(second.key))
        gone = (code[second.back] == 1) | (d > second.doc[second.back])
        change = np.zeros(len(c.raw) + 1, np.int32)
        for a, b in ((c.a[whole], c.b[whole]), (place[gone], place[gone] + size)):
            np.add.at(change, a, 1)
            np.add.at(change, b, -1)
        raw, at = flat_bytes(_array(group["text"]))
        covered = np.zeros(len(raw), bool)
        covered[: len(c.raw)] = np.cumsum(change[:-1]) > 0
        return finish(group, raw, at, covered)

    # applyInArrow looks at a function's arguments, so each wrapper names its own
    def asked(key: tuple, group: pa.Table) -> pa.Table:
        return _lean(ask)(key, group)

    def settled(group: pa.Table) -> pa.Table:
        return _lean(settle)(group, width)

    def asked_windows(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        return _lean(ask_windows)(key, group, answers)

    def covered(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        return _lean(cover)(key, group, answers)

    by_chunk = dealt(chunked, "chunk", n_chunks).groupBy("chunk")
    to_chunks = lambda answers: dealt(answers, "chunk", n_chunks).groupBy("chunk")
    ask_buckets = lambda sent: dealt(sent, "bucket", n_buckets).groupBy("bucket").applyInArrow(settled, _ANSWER)
    answers = ask_buckets(by_chunk.applyInArrow(asked, _SENT))
    more = ask_buckets(by_chunk.cogroup(to_chunks(answers)).applyInArrow(asked_windows, _SENT))
    return by_chunk.cogroup(to_chunks(answers.unionByName(more))).applyInArrow(covered, schema)


def _each(raw: np.ndarray, at: np.ndarray, covered: np.ndarray):
    for a, b in zip(at.tolist(), at[1:].tolist()):
        gone = covered[a:b]
        starts = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if b > a else 0
        yield b - a, int(gone.sum()), starts, raw[a:b][~gone].tobytes()


def repeat_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the bytes that stay."""

    def finish(group: pa.Table, raw: np.ndarray, at: np.ndarray, covered: np.ndarray) -> pa.Table:
        rows = [(n, m, s, hashlib.sha256(kept).hexdigest()) for n, m, s, kept in _each(raw, at, covered)]
        return pa.table({"doc_id": group["doc_id"], **{k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])}})

    return find_repeats(docs.select(doc_id, text), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", doc_id, text, size, gram)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The documents with the covered bytes cut out of their texts, and n_removed. Null texts stay null; of a character cut in half nothing stays."""

    def finish(group: pa.Table, raw: np.ndarray, at: np.ndarray, covered: np.ndarray) -> pa.Table:
        bare = [r[1] for r in _each(raw, at, covered)]
        begins = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of characters
        if len(begins):
            covered = np.repeat(np.logical_or.reduceat(covered, begins), np.diff(np.append(begins, len(raw))))
        rows = list(_each(raw, at, covered))
        given = group["text"].is_valid().to_pylist()
        texts = [kept.decode() if ok else None for (_, _, _, kept), ok in zip(rows, given)]
        return pa.table({"doc_id": group["doc_id"], "text": pa.array(texts, pa.string()), "rest": group["rest"], "n_removed": pa.array(bare, pa.int64())})

    rest = [f for f in docs.schema.fields if f.name not in (doc_id, text)]
    kind = T.StructType(rest) if rest else T.IntegerType()
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rest", kind), T.StructField("n_removed", T.LongType())])
    out = find_repeats(docs, finish, schema, doc_id, text, size, gram)
    own = {doc_id: F.col("doc_id").cast(docs.schema[doc_id].dataType), text: F.col("text")}
    columns = [own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns if c != "n_removed"]
    return out.select(*columns, "n_removed")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES: dict[str, str] = {}
