"""Byte-level BPE and token counts against the libraries themselves."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from arbora.llm import byte_bpe, token_counts

ODD = [
    None, "", " ", "\n\n \t x", "don't  stop'll I'VE it's", "<|endoftext|> a<|startoftext|>b <|end", "na\u00efve caf\u00e9 \u00e9 \u0301x", "\u65e5\u672c\u8a9e \u30c6\u30ad \U0001f600\U0001f469\u200d\U0001f467", "a" * 5000, "12345 6.7e8 \u00bd \u2167 \u0663",
    "\x00\x01\x1c\x1f\x85\xa0 \u200b\u2028 \u3000\ufeff y", "\u0391\u03a3 \u03a3\u0391\u03a3 \u0130I \u1e9e\u00df \ufb01", "x\u0316\u0300 \u0308\u0301 A\u030a", "'S'T'RE don'T", "~`!@#$%^&*()_+{}|:\"<>?[]\\;',./", "tab\tand\x0bvt\x0cff\rcr", " a\u180eb c", "word " * 40000,
]


def corpus(n=400):
    rng = random.Random(7)
    out = list(ODD)
    for _ in range(n):
        k = rng.choice([1, 5, 40])
        out.append("".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(0x300, 0x3500), rng.randrange(0x1F300, 0x1F700), 32, 10])) for _ in range(k)))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "other") for i, t in enumerate(corpus())] + [(1, "twice", "other"), (1, "twice", "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_encoding_is_tiktokens_and_decodes_back(spark, frame):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    df = byte_bpe.encode(frame, path, public_tokenizers.PATTERN, offsets="spans")
    rows = byte_bpe.decode(df, path, decoded_text="again").collect()
    assert len(rows) == len(corpus()) + 2
    for r in rows:
        text = r.text or ""
        want = ref.encode_ordinary(text)
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) == want, repr(text)
        assert bytes(r.decoded) == text.encode() and r.again == text
        assert len(r.spans) == len(want) and (not want or (r.spans[0].start, r.spans[-1].end) == (0, len(text)))


def test_part_of_a_character_decodes_to_its_bytes(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    ids = struct.pack("<2I", ranks[b"a"], ranks[b"\xf0"])
    r = byte_bpe.decode(spark.createDataFrame([(ids,), (None,)], "ids binary"), path, decoded_text="t").collect()
    assert {(bytes(x.decoded), x.t) for x in r} == {(b"a\xf0", "a�"), (b"", "")}


def test_empty_tables(spark, frame):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    none = frame.limit(0)
    assert byte_bpe.decode(byte_bpe.encode(none, path, public_tokenizers.PATTERN), path).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_counts_are_the_librarys(spark, frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = token_counts.count_tokens(frame, path).collect()
    assert len(rows) == len(corpus()) + 2
    for r in rows:
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids), repr(r.text)


def test_shortcut_is_proved_not_assumed():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        whole = token_counts.whole_tokens(f.read())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(whole) > 20000
    assert all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(1).sample(sorted(whole), 500))


def test_queries_on_the_smallest_tables(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    count = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = dict(duckdb.connect().execute(f"select doc_id, coalesce(text, '') from '{d}/documents.parquet'").fetchall())
    one = {r.doc_id: r for r in byte_bpe.op1_byte_bpe(spark, d).collect()}
    three = {r.doc_id: r for r in token_counts.op3_token_counts(spark, d).collect()}
    assert one.keys() == three.keys() == docs.keys()
    for k, text in docs.items():
        ids = ref.encode_ordinary(text)
        assert (one[k].n_tokens, one[k].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert one[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        n = len(count.encode(text, add_special_tokens=False).ids)
        assert (three[k].n_bytes, three[k].n_tokens, three[k].over_limit) == (len(text.encode()), n, n > 2048)
