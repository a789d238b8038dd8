"""Language identification by compression: the language whose dictionary makes a text smallest.

Each learned language has a zstandard raw-content dictionary of at most DICT_BYTES, made of one piece of at most SAMPLE_CHARS characters of each of at
most SAMPLE_DOCS labelled documents (chosen by a hash of the id, and each piece's place in the text by another): these bound the sample. A text is lower-cased and compressed whole with each; score is the margin, (second - best) / second, between 0 and 1. A margin
below MIN_MARGIN sets rejected: the smallest is still named, for callers who want a guess.

Null texts and texts without a letter are `und` with score 0, and rejected. With one learned language the margin is measured against
no dictionary; with none, every text is `und`. Equal sizes go to the language first in order. Rows with null lang or text teach
nothing. Other columns are not read; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbora.llm.batches import pieces
from arbora.session import table

DICT_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 110 << 10, 128, 1500
MIN_MARGIN, LEVEL = 0.02, 5
_LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", usable: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """A dictionary for each value of lang, from a bounded sample of its usable documents."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    rows = rows if usable is None else rows.where(usable)
    rows = rows.select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # only ids below a bound that leaves some four times as many as are wanted meet in a language's window; one row a language
    bounds = rows.groupBy("lang").agg(F.least(F.lit(1.0), (4 * sample_docs + 400) / F.approx_count_distinct("doc_id", 0.02)).alias("part"))
    near = rows.join(F.broadcast(bounds), "lang").where(place < F.col("part") * (1 << 30))
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    ids = near.select("lang", "doc_id").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample_docs)
    begin = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    cut = near.select("lang", "doc_id", F.substr("text", begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"))
    taught = cut.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("part").alias("part"), F.min("rank").alias("rank"))
    parts: dict[str, list] = {}
    for r in taught.collect():
        parts.setdefault(r.lang, []).append((r.rank, r.part.lower().encode()))
    return {k: b"\n".join(p for _, p in sorted(parts[k], reverse=True))[-DICT_BYTES:] for k in sorted(parts)}


@lru_cache(2)
def compressors(dictionaries: tuple[tuple[str, bytes], ...], level: int) -> list:
    import zstandard

    out = []
    for _, raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out if len(out) > 1 else [*out, zstandard.ZstdCompressor(level=level, write_content_size=False)]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN, level: int = LEVEL) -> DataFrame:
    """Add lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))  # bounded: DICT_BYTES a language
    new = ["lang_pred", "score", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names, ways = [k for k, _ in known], compressors(known, level) if known else []
        for batch in pieces(batches, text):
            lang, score = [], []
            for t in batch.column(text).to_pylist():
                if not names or t is None or not _LETTER.search(t):
                    lang.append("und")
                    score.append(0.0)
                    continue
                raw = t.lower().encode()
                sizes = [len(w.compress(raw)) for w in ways]
                best = min(range(len(names)), key=sizes.__getitem__)
                second = min(s for i, s in enumerate(sizes) if i != best)
                lang.append(names[best])
                score.append(max(0.0, (second - sizes[best]) / second))
            kept = {n: batch.column(n) for n in batch.schema.names if n not in new}
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([s < min_margin for s in score], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept.values(), *made], [*kept, *new])

    from pyspark.sql import types as T

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name not in new] + added))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    dictionaries = learn(docs, usable=~held)
    out = predict(docs.select("doc_id", held.alias("held_out"), "text"), dictionaries)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op9_language": op9_language}
ORACLES: dict[str, str] = {}
