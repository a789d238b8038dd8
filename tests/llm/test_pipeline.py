"""Every stage of the pipeline against brute force on the smallest tables, fed with what its predecessor kept."""

import struct
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import public_tokenizers
import test_jaccard
import test_quality_language
import test_repeats
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from arbora.llm import byte_bpe, mixing
from arbora.session import stash

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stash(stage(spark, docs, D), name)
        out.append((name, docs, made))
        docs = made
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_duplicates", "repeats", "mixing", "tokens"]
    for _, before, after in stages[:-1]:
        assert after.schema == before.schema
        assert 0 < after.count() <= before.count()


def test_quality_rules(stages):
    _, before, after = stages[0]
    kept = rows(after)
    for k, r in rows(before).items():
        n = test_quality_language.brute(r.text)
        if n[0] < 50 or 100 * n[4] > 50 * n[0]:
            assert k not in kept
        elif k in kept:
            assert kept[k] == r


def test_near_duplicates(stages):
    _, before, after = stages[1]
    want = {i for i, _, c in test_jaccard.brute([(r.doc_id, r.text) for r in before.collect()], 5, 80) if i == c}
    assert rows(after).keys() == want < rows(before).keys()


def test_repeated_strings(stages):
    _, before, after = stages[2]
    docs = [(r.doc_id, r.text) for r in before.collect()]
    cut = {w[0]: w for w in test_repeats.brute(docs, 50)}
    got = rows(after)
    assert got.keys() == {k for k, w in cut.items() if w[1] > w[2] or w[1] == 0}
    for k, r in got.items():
        text = dict(docs)[k]
        assert len(r.text.replace("�", "").encode()) <= len(text.encode()) - cut[k][2]
        assert r.n_chars == (len(r.text) if cut[k][2] else r.n_chars) and (cut[k][2] or r.text == text)


def test_mixing_takes_effect(stages):
    _, before, after = stages[3]
    assert rows(after).keys() <= rows(before).keys()
    toxic = {r.doc_id for r in before.sparkSession.read.parquet(f"{D}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in before.sparkSession.read.parquet(f"{D}/labels.parquet").where("toxic = 0 and quality = 1").collect()}
    share = lambda ids: len(rows(after).keys() & ids) / len(rows(before).keys() & ids)
    assert share(toxic) < 0.5 < 0.95 < share(clean)


def test_tokens(stages):
    _, before, after = stages[4]
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = rows(after)
    assert got.keys() == rows(before).keys()
    for r in got.values():
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == ref.encode_ordinary(r.text)


def test_run(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, D).select("doc_id").collect()) == sorted(rows(stages[4][2]))


def test_mixing_follows_the_draws(spark):
    """Hard posteriors of three domains: the shares of tokens after the stage are the targets, or with each document once those of min(rate, 1)."""
    share, names, n = {"clean": 0.75, "low": 0.12, "toxic": 0.13}, ["clean", "low", "toxic"], 8000
    dealt = [d for d in names for _ in range(round(share[d] * n))]
    soft = spark.createDataFrame([(i, 1, 100, [float(d == x) for x in names]) for i, d in enumerate(dealt)], "doc_id long, n_rows long, n_tokens long, p array<double>")
    rated, _ = mixing.fit_rates(soft, [mixing.TARGETS[d] for d in names])
    mixed = mixing.draws(rated)
    rate = {r.d: r.rate for r in rated.groupBy(F.array_position("p", 1.0).alias("d")).agg(F.first("rate").alias("rate")).collect()}
    docs = spark.createDataFrame([*((i, d) for i, d in enumerate(dealt)), (None, "none"), (None, "none")], "doc_id long, text string")

    def shares(df):
        rows = df.collect()
        assert sum(r.text == "none" for r in rows) == 2
        return {d: sum(r.text == d for r in rows) / (len(rows) - 2) for d in names}, [r.doc_id for r in rows if r.text != "none"]

    got, ids = shares(corpus_pipeline.drawn(docs, mixed, repeat=True))
    assert all(abs(got[d] - w) < 0.01 for d, w in mixing.TARGETS.items()) and max(Counter(ids).values()) == 2
    got, ids = shares(corpus_pipeline.drawn(docs, mixed))
    once = {d: share[d] * min(rate[i + 1], 1.0) for i, d in enumerate(names)}
    assert all(abs(got[d] - once[d] / sum(once.values())) < 0.01 for d in names) and len(ids) == len(set(ids))


def test_rows_go_by_likeness_only(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(80)) for w in "abc")
    given = [(1, a), (1, b), (1, a), (None, c), (None, c + " more"), (None, a), (None, ""), (None, ""), (None, "short"), (None, "short"), (7, None), (9, c)]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, D).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (9, c), (None, ""), (None, ""), (None, "short"), (7, None)], key=repr)
    assert corpus_pipeline.near_duplicates(spark, docs.where("doc_id is null"), D).where("length(text) > 10").count() == 2


def test_rows_with_a_null_id_pass_the_third_stage(spark):
    docs = spark.createDataFrame([(1, "x" * 60, 60), (None, "y" * 200, 200), (None, "", 0)], "doc_id long, text string, n_chars long")
    got = [tuple(r) for r in corpus_pipeline.repeated_strings(spark, docs, D).collect()]
    assert sorted(r[1:] for r in got if r[0] is None) == [("", 0), ("y" * 200, 200)]
