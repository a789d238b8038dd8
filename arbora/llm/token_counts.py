"""Token counts of whole texts, exactly as the tokenizers library counts them, mostly without running its merges.

Words between spaces and line ends never share a token in this kind of vocabulary (its pattern holds no white space), so a text's
count is the sum of its words' counts. Once per vocabulary the shortcut is proved: each vocabulary string that can stand at a word's
end is encoded by itself by the library, and those that give exactly one token form the set of whole tokens. A plain word is cut
into pre-tokens; each that is in the set counts one, only the rest goes through the merges. Words that are not plain (other than
printable ASCII, or that could hold a special string) go to the library as they are, which handles special strings as it does by default.

Null and empty texts have no tokens. Other columns pass through unless named like the output. Repeated rows are counted each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.batches import pieces, texts
from arbora.session import table

#: Bytes of words remembered by a worker (with what Python needs for each); when full it starts anew. Bounds memory, not what is counted.
CACHE_BYTES = 64 << 20
_SPACE = re.compile(r"[ \n\t\r]+")
_PLAIN = re.compile(r"[!-~]+")
#: The vocabulary's own pattern on lower-case printable ASCII.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def whole_tokens(model: str, word_end: str = "</w>") -> frozenset[str]:
    """Lower-case ASCII vocabulary strings that the library encodes, alone, as one token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model)
    found = [v.removesuffix(word_end) for v in t.get_vocab() if v.endswith(word_end)]
    found = [v for v in found if _PLAIN.fullmatch(v) and v == v.lower() and [m.group() for m in _PRE_TOKEN.finditer(v)] == [v]]
    return frozenset(v for v, e in zip(found, t.encode_batch(found, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    """Counts texts with one vocabulary; holds the counts of words seen."""

    def __init__(self, model: str, whole: frozenset[str]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t, self.whole, self.seen = Tokenizer.from_str(model), whole, {"": 0}
        self.size = 0
        self.special = tuple({x.content[:2] for x in self.t.get_added_tokens_decoder().values()})

    def learn(self, words: set[str]) -> None:
        rest: dict[str, list[str]] = {}
        for word in words:
            if _PLAIN.fullmatch(word) and not any(s in word for s in self.special):
                pre = _PRE_TOKEN.findall(word.lower())
                left = [x for x in pre if x not in self.whole]
                self.seen[word] = len(pre) - len(left)
                if left:
                    rest[word] = left
            else:
                self.seen[word] = 0
                rest[word] = [word]
        todo = list({x for left in rest.values() for x in left})
        n = {x: len(e) for x, e in zip(todo, self.t.encode_batch_fast(todo, add_special_tokens=False))}
        for word, left in rest.items():
            self.seen[word] += sum(n[x] for x in left)

    def count(self, many: list[str]) -> list[int]:
        cut = [_SPACE.sub(" ", x).split(" ") for x in many]
        if self.size > CACHE_BYTES:
            self.seen, self.size = {"": 0}, 0
        new = {w for words in cut for w in words} - self.seen.keys()
        self.size += sum(len(w) * 2 + 150 for w in new)
        self.learn(new)
        of = self.seen.__getitem__
        return [sum(map(of, words)) for words in cut]


@lru_cache(1)
def counter(model: str, whole: frozenset[str]) -> Counter:
    return Counter(model, whole)


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    shared = df.sparkSession.sparkContext.broadcast((model, whole_tokens(model)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(*shared.value)
        for batch in pieces(batches, text, 1 << 20):
            kept = {n: batch.column(n) for n in batch.schema.names if n != n_tokens}
            yield pa.RecordBatch.from_arrays([*kept.values(), pa.array(c.count(texts(batch.column(text))), pa.int64())], [*kept, n_tokens])

    schema = T.StructType([f for f in df.schema.fields if f.name != n_tokens] + [T.StructField(n_tokens, T.LongType())])
    return df.mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
