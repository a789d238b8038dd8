"""Quality rules: base counts of a text, and a verdict from labelling its lines as content or boilerplate.

Lines that hold a word form a sequence; a linear-chain conditional random field labels them (Viterbi), and a text is kept when the
share of its word characters in content lines reaches CONTENT_SHARE and the base rules pass. The field is trained here, on the lines of a
bounded sample of documents with a quality label (TRAIN_DOCS of each value, chosen by a hash of the id, and of a document at most
TRAIN_RUNS runs of TRAIN_LINES lines, chosen by a hash from the whole of it). Labels are of documents, so
lines get theirs in two rounds: first each line that of its document, in a field without transitions; then each line that field's
own opinion where it is sure against the document, in the full field.

Null and empty texts have no words, fail the base rules and are not kept. Without usable labels every text that passes the base
rules is kept. Labels of one document that disagree count as the better one. Other columns are not read; repeated rows are
judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.batches import flat_bytes, pieces
from arbora.llm.line_crf import LineCRF, train, viterbi
from arbora.llm.words import mix, per_text, shingles, words
from arbora.session import table

#: Bounds of the training sample: documents of each label value, runs of lines of each, and lines of a run.
TRAIN_DOCS, TRAIN_RUNS, TRAIN_LINES = 1500, 10, 40
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS = {
    "symbol": _table(SYMBOLS),
    "upper": _table(bytes(range(65, 91))),
    "letter": _table(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])),
    "digit": _table(b"0123456789"),
    "loud": _table(b"!?"),
    "comma": _table(b",;:"),
    "point": np.isin(np.arange(256), np.arange(0x80, 0xC0), invert=True),  # first bytes of characters
    "space": _table(b" \t\n\v\f\r"),
}
N_FEATURES = 12


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def measure(raw: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each text, then of the lines with a word: features, word characters, and where each text's lines begin and end."""
    n = len(at) - 1
    h, first, last = words(raw, at)
    bounds = per_text(first, at)
    inked = ~_IS["space"][raw] & _IS["point"][raw]
    # words in three-word windows found twice or more in their text
    three, of = shingles(h, bounds, 3, short=False)
    keyed = mix(three + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, seen = np.unique(keyed, return_inverse=True, return_counts=True)
    at_word = np.flatnonzero(np.repeat(np.arange(n), np.diff(bounds))[: max(len(h) - 2, 0)] == np.repeat(np.arange(n), np.diff(bounds))[2:])
    twice = at_word[seen[back] > 1]
    repeated = np.zeros(len(h), bool)
    for i in range(3):
        repeated[twice + i] = True
    # lines
    starts = np.union1d(at[:-1][np.diff(at) > 0], np.flatnonzero(raw[:-1] == 10) + 1) if len(raw) else np.zeros(0, np.int64)
    cuts = np.append(starts, len(raw))
    n_words = np.diff(np.searchsorted(first, cuts))
    full = n_words > 0
    a, b = cuts[:-1][full], cuts[1:][full]
    text_of = np.searchsorted(at, a, "right") - 1
    dup = np.zeros(len(a), bool)
    whole = raw.tobytes()
    before: set[bytes] = set()
    now = -1
    for i, (x, y, t) in enumerate(zip(a.tolist(), b.tolist(), text_of.tolist())):
        if t != now:
            before, now = set(), t
        line = whole[x : y - 1] if whole[y - 1] == 10 else whole[x:y]
        dup[i] = line in before
        before.add(line)
    lines = np.searchsorted(text_of, np.arange(n + 1))

    def of_lines(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[b] - total[a]).astype(float)

    nw = n_words[full].astype(float)
    chars = of_lines(inked)
    letters = np.maximum(of_lines(_IS["letter"][raw]), 1)
    in_repeats = np.concatenate([[0], np.cumsum(repeated)])
    w0, w1 = np.searchsorted(first, a), np.searchsorted(first, b)
    same_next = np.zeros(len(h), bool)
    if len(h) > 1:
        same_next[1:] = h[1:] == h[:-1]
    next_to = np.concatenate([[0], np.cumsum(same_next)])
    ended = np.isin(raw[last[np.maximum(w1 - 1, 0)] - 1], list(b".!?")) if len(a) else np.zeros(0, bool)
    x = np.stack(
        [
            np.ones(len(a)),
            np.minimum(np.log1p(nw) / 5, 1),
            of_lines(_IS["upper"][raw]) / letters,
            np.minimum(of_lines(_IS["symbol"][raw]) / nw, 1),
            np.minimum(of_lines(_IS["loud"][raw]) / nw, 1),
            of_lines(_IS["digit"][raw]) / np.maximum(chars, 1),
            (in_repeats[w1] - in_repeats[w0]) / nw,
            np.minimum((next_to[w1] - next_to[w0]) / nw, 1),
            dup.astype(float),
            ended.astype(float),
            np.minimum(of_lines(_IS["comma"][raw]) / nw, 1),
            np.minimum(chars / nw / 15, 1),
        ],
        1,
    ) if len(a) else np.zeros((0, N_FEATURES))
    rep_total = np.concatenate([[0], np.cumsum(repeated, dtype=np.int64)])
    base = {
        "n_words": np.diff(bounds).astype(np.int64),
        "word_chars": _sums(inked, at),
        "n_symbols": _sums(_IS["symbol"][raw], at),
        "n_dup_lines": np.bincount(text_of, dup, n).astype(np.int64) if len(a) else np.zeros(n, np.int64),
        "n_repeat_words": rep_total[bounds[1:]] - rep_total[bounds[:-1]],
    }
    return base, x, chars, lines


def chosen_runs(first: int, end: int) -> list[int]:
    """Where the runs of lines to learn from begin: all of a document's, or TRAIN_RUNS of them, hashed by their place."""
    starts = np.arange(first, end, TRAIN_LINES)
    order = np.argsort(mix(np.arange(len(starts), dtype=np.uint64) + np.uint64(end - first)), kind="stable")
    return np.sort(starts[order[:TRAIN_RUNS]]).tolist()


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", train_docs: int = TRAIN_DOCS) -> LineCRF | None:
    """Train the field on a bounded sample of labelled documents; None where there are not both kinds of label."""
    known = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(quality).alias("good"))
    place = F.pmod(F.xxhash64(doc_id), F.lit(1 << 30))
    size = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    # ids below a bound that leaves more than twice as many as are wanted; the smallest of those are the sample
    few = lambda good: known.where((F.col("good") == good) & (place < int(min(1.0, (2 * train_docs + 500) / size.get(good, 1)) * (1 << 30)))).orderBy(place, doc_id).limit(train_docs)
    chosen = few(0).unionByName(few(1))
    sample = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id).groupBy(doc_id).agg(F.min(text).alias(text), F.min("good").cast("int").alias("good"))  # at most 2 * train_docs ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            raw, at = flat_bytes(batch.column(text))
            _, x, _, lines = measure(raw, at)
            got = [[x[i : min(i + TRAIN_LINES, b)].astype("<f4").tobytes() for i in chosen_runs(a, b)] for a, b in zip(lines.tolist(), lines[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), batch.column("good"), pa.array(got, pa.list_(pa.binary()))], ["doc_id", "good", "x"])

    kind = sample.schema[doc_id].dataType.simpleString()
    rows = sorted(sample.mapInArrow(run, f"doc_id {kind}, good int, x array<binary>").collect(), key=lambda r: r.doc_id)
    x, y, cuts = [], [], [0]
    for r in rows:
        for one in r.x:
            x.append(np.frombuffer(one, "<f4").reshape(-1, N_FEATURES).astype(float))
            y.append(np.full(len(x[-1]), r.good))
            cuts.append(cuts[-1] + len(x[-1]))
    if not x or len({int(v[0]) for v in y}) < 2:
        return None
    x, y, cuts = np.concatenate(x), np.concatenate(y), np.array(cuts)
    alone = train(x, y, cuts, chain=False)
    sure = x @ alone.emit
    y = np.where((y == 0) & (sure > 1), 1, np.where((y == 1) & (sure < -3), 0, y))
    return train(x, y, cuts)


def judge(docs: DataFrame, model: LineCRF | None, doc_id: str = "doc_id", text: str = "text", share: float = CONTENT_SHARE, keep_columns: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, content_share (null without words or model) and kept; with keep_columns the input's columns come first, but for those named like an output."""
    own = docs.columns if keep_columns else [doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            raw, at = flat_bytes(batch.column(text))
            base, x, chars, lines = measure(raw, at)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            good = np.full(batch.num_rows, np.nan)
            if model is not None and len(x):
                content = chars * viterbi(model, x, lines)
                total = np.concatenate([[0], np.cumsum(content)])
                with np.errstate(invalid="ignore"):
                    good = (total[lines[1:]] - total[lines[:-1]]) / np.where(base["word_chars"] > 0, base["word_chars"], np.nan)
            kept = ~failed & ~(good < share)
            made = {**{k: pa.array(v) for k, v in base.items()}, "base_failed": pa.array(failed), "content_share": pa.array(good, from_pandas=True), "kept": pa.array(kept)}
            first = {c: batch.column(c) for c in own if c not in made}
            yield pa.RecordBatch.from_arrays([*first.values(), *made.values()], [*first, *made])

    made = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    new = T.StructType.fromDDL(made).fields
    schema = T.StructType([docs.schema[c] for c in own if c not in {f.name for f in new}] + new)
    return docs.select(*dict.fromkeys([*own, doc_id, text])).mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
