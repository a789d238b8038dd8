"""A corpus pipeline of five stages, each written as Parquet in the shared folder and read again by the next.

1. quality: base rules and the line labeller; rejected documents go (op 8).
2. near_duplicates: five-word shingles, Jaccard similarity of 0.8 or more; of each component the row with the smallest id stays, null ids last (op 10).
3. repeats: bytes covered by a 50-byte string of a document with a smaller id are cut out, with characters they cut in half; documents of
   which nothing is left go (op 4).
4. mixing: the draws of the rates for the target weights. By default no rate exceeds 1, so a document is drawn once or not, and the shares of the
   tokens that stay meet the targets; with repeat rates are free and a document is written as often as it is drawn (op 5).
5. tokens: ids of every text and how many there are (op 1).

Every stage returns the columns of documents but the last, which adds its own. n_chars follows the text. The second stage compares rows, not ids:
a row with a null id, or with an id that others share, goes only if its text is like that of a row that stays. In the third, rows with a null id pass as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import byte_bpe, jaccard, mixing, quality, repeats
from arbora.session import ship, stash, table

SHINGLE, PERCENT = 5, 80
ROW = "row number of the pipeline"


def packed(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, text and all other columns in one, so that no stage's own columns meet a document's; row, if named, is called row and stays apart."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", row)]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("own"), *([F.col(row).alias("row")] if row else []))


def unpacked(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("own").getField(c).alias(c) for c in docs.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """packed docs with row, a number that a row keeps however often it is read.

    Of tables as Spark writes them it is the file's number and the row's place in the file; any other table is written first.
    """
    files = [re.match(r"part-(\d{5,7})-", f.rpartition("/")[2]) for f in docs.inputFiles()]
    if files and all(files) and len({f[1] for f in files}) == len(files):
        place = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1).cast("long") * (1 << 40) + F.col("_metadata.row_index")
        return packed(docs.select("*", place.alias(ROW)), ROW)
    return stash(packed(docs).withColumn("row", F.monotonically_increasing_id()), "rows")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty and wordless texts fail them; repeated rows are judged each."""
    judged = quality.judge(packed(docs), quality.fit(docs, table(spark, sf_dir, "labels")), keep_columns=True)
    return unpacked(judged.where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of like texts, the smallest by (null id last, id, hash of the text, row). Texts without a word all stay."""
    rows = numbered(docs)
    found = jaccard.jaccard_components(rows.select("row", "text"), SHINGLE, PERCENT, "row").select(F.col("doc_id").alias("row"), "component_id")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row")
    kept = rows.select("row", rank.alias("rank")).join(found, "row").groupBy("component_id").agg(F.min("rank").alias("first")).select("first.row")
    return unpacked(rows.join(kept, "row", "left_semi"), docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated strings; documents of which nothing is left go, those that had nothing (null or empty texts) stay."""
    # rows with a null id neither lose nor explain bytes; in the operator they would share a chunk
    cut = repeats.remove_repeats(packed(docs).where("doc_id is not null")).where((F.col("n_removed") == 0) | (F.length("text") > 0))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("own").getField("n_chars")) if "n_chars" in docs.columns else None
    shown = [chars.cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) if c in ("doc_id", "text") else F.col("own").getField(c).alias(c) for c in docs.columns]
    return cut.select(*shown).unionByName(docs.where("doc_id is null"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str, repeat: bool = False) -> DataFrame:
    """Documents by the draws of their rates. Rows without an id or a word have rate 1 and stay."""
    mixed = mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.TARGETS, most=None if repeat else 1.0)
    return drawn(docs, mixed, repeat)


def drawn(docs: DataFrame, mixed: DataFrame, repeat: bool = False) -> DataFrame:
    """Rows of docs of which mixed has a draw, with repeat as often as it has draws. Rows with a null id stay once."""
    named = packed(docs).join(mixed.where("doc_id is not null").select("doc_id", F.col("draws").cast("int").alias("draws")), "doc_id").where("draws > 0")
    if repeat:
        named = named.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("draws"))))
    return unpacked(named, docs).unionByName(docs.where("doc_id is null"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.withColumn("n_tokens", byte_bpe.n_ids(F.col("ids")))


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("repeats", repeated_strings), ("mixing", mixing_weights), ("tokens", tokens)]

#: SQL expresses neither trained labellers nor the byte pair merges; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, repeat: bool = False) -> DataFrame:
    """All stages over documents; with repeat a document drawn n times is in n rows."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        more = {"repeat": repeat} if stage is mixing_weights else {}
        docs = stash(stage(spark, docs, sf_dir, **more), name)
    return STAGES[-1][1](spark, docs, sf_dir)
