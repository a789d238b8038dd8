"""Byte-level BPE: texts to token ids and back.

The vocabulary is a rank file (base64 token, space, rank a line). Each byte stands for one printable character, so that the
tokenizers library can merge over strings; its merge list follows from the ranks. Each match of the pattern is encoded by itself.

Without offsets each distinct match of a worker's texts is encoded once: the regex module finds the matches of texts whose characters it and
the tokenizers library's own engine class alike (tests compare them on all of SAME), and all other texts are given to the library whole.
Decoding looks up the tokens' characters and turns each back to its byte through the inverse of the same table.

Null and empty texts give no ids. Ids decode to bytes, which need not be whole UTF-8 characters for a part of a document:
decode() therefore returns the bytes, and text in which a split character becomes U+FFFD.
Only the named columns are read; other columns of the input, whatever their names, pass through encode() and decode() unchanged
unless they carry the name of an output column, which is then replaced. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.batches import pieces, texts
from arbora.session import table

#: Texts of these characters only: Latin, Greek, Cyrillic and general punctuation, of which no code point is new to either engine.
SAME = regex.compile(r"[\x00-\u052f\u2000-\u206f]*")
CACHE_BYTES = 48 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where Latin-1 shows it, else one of those after U+0100, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts from which the token is made: what merging its bytes by all smaller ranks leaves."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        rank, i = min(((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1)), default=(own, 0))
        if rank >= own:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The tokenizers library's description of this vocabulary."""
    chars = byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = [m for token in sorted(ranks, key=ranks.get) if len(token) > 1 and (m := last_merge(token, ranks))]
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [],
            "normalizer": None,
            "pre_tokenizer": {
                "type": "Sequence",
                "pretokenizers": [
                    {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
                    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
                ],
            },
            "post_processor": None,
            "decoder": None,
            "model": {"type": "BPE", "vocab": {shown(t): r for t, r in ranks.items()}, "merges": [[shown(a), shown(b)] for a, b in merges]},
        }
    )


@lru_cache(2)
def loaded(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model)


@lru_cache(1)
def tables(shown: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all tokens one after another, where each token begins and ends, and the byte of each character."""
    codes = np.frombuffer("".join(shown).encode("utf-16-le"), "<u2")
    back = np.zeros(512, np.uint8)
    for byte, char in enumerate(byte_chars()):
        back[ord(char)] = byte
    return codes, np.concatenate([[0], np.cumsum([len(s) for s in shown], dtype=np.int64)]), back


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(n) for n in batch.schema.names if n not in columns}
    return pa.RecordBatch.from_arrays([*kept.values(), *columns.values()], [*kept, *columns])


def _schema(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + added)


class Matches(dict):
    """The ids, as bytes, of matches seen by this worker; when they fill CACHE_BYTES it starts anew, which bounds memory and changes no result."""

    def __init__(self, t, pattern: str):
        super().__init__()
        self.t, self.find, self.size = t, regex.compile(pattern).findall, 0

    def learn(self, found: list[str]) -> None:
        new = list(set(found) - self.keys())
        self.size += sum(map(len, new)) * 2 + len(new) * 200
        self.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(new, self.t.encode_batch_fast(new, add_special_tokens=False)))

    def encode(self, given: list[str]) -> list[bytes]:
        out = []
        if self.size > CACHE_BYTES:
            self.clear()
            self.size = 0
        cut = [self.find(x) if SAME.fullmatch(x) else None for x in given]
        self.learn([w for words in cut if words for w in words])
        for x, words in zip(given, cut):
            out.append(np.array(self.t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() if words is None else b"".join(map(self.__getitem__, words)))
        return out


@lru_cache(1)
def matches(model: str, pattern: str) -> Matches:
    return Matches(loaded(model), pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Add ids (binary: unsigned 32-bit little-endian) and, if asked for, offsets (array of (start, end) in code points of the text)."""
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(model_json(read_ranks(ranks_path), pattern))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            given = texts(batch.column(text))
            if not offsets:
                made = {ids: pa.array(matches(model.value, pattern).encode(given), pa.binary())}
            else:
                got = loaded(model.value).encode_batch(given, add_special_tokens=False)
                made = {ids: pa.array([np.array(e.ids, "<u4").tobytes() for e in got], pa.binary())}
                made[offsets] = pa.array([[{"start": a, "end": b} for a, b in e.offsets] for e in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield _with(batch, made)

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = [T.StructField(ids, T.BinaryType())] + ([T.StructField(offsets, span)] if offsets else [])
    return df.mapInArrow(run, _schema(df, added))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded", decoded_text: str | None = None) -> DataFrame:
    """Add the bytes of the ids (null ids: none) and, if asked for, their text, split characters as U+FFFD. Unknown ids raise an error."""
    spark = df.sparkSession
    ranks, chars = read_ranks(ranks_path), byte_chars()
    shown = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        shown[rank] = "".join(chars[b] for b in token)
    vocabulary = spark.sparkContext.broadcast(shown)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, first, back = tables(tuple(vocabulary.value))
        for batch in pieces(batches, ids):
            given = [np.frombuffer(x or b"", "<u4") for x in batch.column(ids).to_pylist()]
            every = np.concatenate([np.zeros(0, "<u4"), *given]).astype(np.int64)
            if len(every) and (every.max() >= len(first) - 1 or (first[every] == first[every + 1]).any()):
                raise ValueError("ids that the vocabulary does not have")
            n = first[every + 1] - first[every]
            begin = np.concatenate([[0], np.cumsum(n)])
            raw = back[codes[np.repeat(first[every] - begin[:-1], n) + np.arange(begin[-1])]].tobytes()
            cut = begin[np.concatenate([[0], np.cumsum([len(x) for x in given], dtype=np.int64)])]
            got = [raw[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]
            made = {decoded: pa.array(got, pa.binary())}
            if decoded_text:
                made[decoded_text] = pa.array([x.decode("utf-8", "replace") for x in got], pa.string())
            yield _with(batch, made)

    added = [T.StructField(decoded, T.BinaryType())] + ([T.StructField(decoded_text, T.StringType())] if decoded_text else [])
    return df.mapInArrow(run, _schema(df, added))


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    back = decode(coded, path)
    return back.select("doc_id", n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLES: dict[str, str] = {}
