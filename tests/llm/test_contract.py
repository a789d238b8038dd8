"""Odd tables through every stage of the pipeline, and words that simple hashes confuse."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import test_jaccard
import test_quality_language
import test_repeats
import tiktoken
from tokenizers import Regex, pre_tokenizers

import corpus_pipeline
from arbora.llm import byte_bpe, jaccard, language, mixing, quality, repeats

D = "/root/testdata/sf0.001"


def thue_morse(n, first):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b ^ first] for b in bits[:n])


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_words_in_patterns_that_polynomials_modulo_2_64_confuse(spark, n):
    a, b = thue_morse(n, 0), thue_morse(n, 1)
    docs = [(1, a), (2, b), (3, f"{a} p q {b} p q"), (4, a.upper()), (5, f"{a} p q {a} p q")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(df, 4, 85).collect())) == test_jaccard.brute(docs, 4, 85)
    test_quality_language.check(quality.judge(df, None).collect(), dict(docs))


def test_ids_as_far_apart_as_they_can_be(spark):
    s = "the quick brown fox jumps over the lazy dog and runs away from it "
    docs = [(-(2**63), s + "a"), (2**63 - 1, s + "b"), (0, s + "c"), (-5, "none"), (2**62, s)]
    got = sorted(map(tuple, repeats.repeat_digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    want = test_repeats.brute([(i + 2**63, t) for i, t in docs], 50)
    assert got == [(i - 2**63, *rest) for i, *rest in want]


def test_repeats_cut_whole_characters(spark):
    a = "x" + "é" * 30 + "yz"
    b = "é" * 30 + "\ufffd w"
    docs = spark.createDataFrame([(1, a), (2, b), (3, "é" + a[3:] + "q")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in repeats.remove_repeats(docs, size=21, gram=8).collect()}
    assert got[1] == (a, 0) and got[2] == ("\ufffd w", 60) and "\ufffd" not in got[3][0]


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(2_000_000))
    assert len(long) > 16 << 20
    docs = spark.createDataFrame([(1, long[5000:9000]), (2, long), (3, "w " + long[7000:7500])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.repeat_digests(docs).collect()}
    assert got == {1: (4000, 0, 0), 2: (len(long), 4000, 1), 3: (502, 500, 1)}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 4, 85).collect()} == {1: 1, 2: 2, 3: 3}
    line = spark.createDataFrame([(1, long)], "doc_id long, text string")
    r = quality.judge(line, None).collect()[0]
    assert (r.n_words, r.n_dup_lines, r.n_repeat_words) == (2_000_000, 0, 0)


def test_matches_are_cut_alike_by_both_engines():
    split, find = pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), regex.compile(public_tokenizers.PATTERN)
    for c in [*range(0x530), *range(0x2000, 0x2070)]:
        x = chr(c)
        assert byte_bpe.SAME.fullmatch(x)
        text = f"a{x}1{x} {x}{x}!{x}'s{x}  {x}b\n{x}"
        assert [w for w, _ in split.pre_tokenize_str(text)] == find.findall(text), hex(c)
    assert not byte_bpe.SAME.fullmatch("a\u0558")


def test_encoding_without_offsets(spark, monkeypatch):
    import test_tokens

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    texts = test_tokens.corpus()
    coder = byte_bpe.Matches(byte_bpe.loaded(byte_bpe.model_json(byte_bpe.read_ranks(path), public_tokenizers.PATTERN)), public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 1000)
    for i in range(0, len(texts), 50):
        got = coder.encode([t or "" for t in texts[i : i + 50]])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ref.encode_ordinary(t or "") for t in texts[i : i + 50]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    back = byte_bpe.decode(byte_bpe.encode(frame, path, public_tokenizers.PATTERN), path).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(b"\xff\xff\x00\x00",)], "ids binary"), path).collect()


def test_language_on_odd_tables(spark):
    rows = [(1, "the cat and the dog " * 30, "en", "x", 1.5), (1, "the cat and the dog " * 30, "en", "x", 1.5), (2, "le chat et le chien " * 30, "fr", None, 0.0), (3, "the dog " * 300_000, None, "y", 2.0), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    known = language.learn(df)
    got = language.predict(df, known).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got) == [(0, "und"), (1, "en"), (1, "en"), (2, "fr"), (3, "en")]
    assert language.predict(df.limit(0), known).count() == 0


def test_language_verdicts_are_the_smallest_sizes(spark):
    """Brute force: every text compressed anew with each dictionary."""
    import zstandard

    docs = spark.read.parquet(f"{D}/documents.parquet")
    known = language.learn(docs)
    for r in language.predict(docs, known).collect():
        if r.text and language._LETTER.search(r.text):
            sizes = {}
            for k, raw in known.items():
                c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[k] = len(c.compress(r.text.lower().encode()))
            best, second = sorted(sizes.values())[:2]
            assert sizes[r.lang_pred] == best and r.score == pytest.approx((second - best) / second)


def test_quality_verdicts_are_the_share_of_content(spark):
    """Brute force: of each text's lines one by one, the best path over all of two labels by plain dynamic programming."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    for r in quality.judge(docs, model, keep_columns=True).collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        _, x, chars, _ = quality.measure(raw, np.array([0, len(raw)]))
        best = {0: (0.0, []), 1: (0.0, [])}
        for i, row in enumerate(x):
            e = float(row @ model.emit)
            best = {v: max(((best[u][0] + (float(model.move[u, v]) if i else 0.0) + e * v, [*best[u][1], v]) for u in (0, 1)), key=lambda p: p[0]) for v in (0, 1)}
        path = max(best.values(), key=lambda p: p[0])[1]
        if len(x):
            share = sum(c for c, v in zip(chars, path) if v) / sum(chars)
            assert r.content_share == pytest.approx(share)
            assert r.kept == (not r.base_failed and share >= quality.CONTENT_SHARE)
        else:
            assert not r.kept


CLASH = "kept string, n_words string, n_removed string, own string, row string, draws string, copy string, doc string, n_tokens string"


def odd(spark):
    texts = [r[0] for r in duckdb.connect().execute(f"select text from '{D}/documents.parquet' where length(text) between 500 and 4000 limit 30").fetchall()]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[4]), (None, texts[5]), (None, None), (100, None), (101, ""), (102, " ".join(f"w{i}" for i in range(300_000)))]
    full = [(i, t, "en", "s", len(t or ""), *[f"{c}{n}" for c in "abcdefghi"]) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_tables(spark, stage):
    docs, f = odd(spark), dict(corpus_pipeline.STAGES)[stage]
    got = f(spark, docs, D)
    assert got.schema.names == docs.schema.names and [x.dataType for x in got.schema] == [x.dataType for x in docs.schema]
    own = {r.row: r for r in docs.collect()}
    rows = got.collect()
    assert rows and len({r.row for r in rows}) == len(rows)
    for r in rows:
        before = own[r.row]
        assert (r.kept, r.n_words, r.n_removed, r.own, r.draws, r.copy, r.doc, r.n_tokens, r.lang) == (before.kept, before.n_words, before.n_removed, before.own, before.draws, before.copy, before.doc, before.n_tokens, before.lang)
        assert r.doc_id == before.doc_id and (r.text == before.text or stage == "repeats")
    ids = [r.doc_id for r in rows]
    if stage == "near_duplicates":
        assert ids.count(3) == 2 and 4 not in ids and ids.count(None) == 1 and {100, 101, 102} <= set(ids)
    if stage == "repeats":
        assert {100, 101, 102} <= set(ids) and ids.count(None) == 2
    if stage == "mixing":
        assert {100, 101} <= set(ids) and ids.count(None) == 2
    assert f(spark, docs.limit(0), D).count() == 0
    bare = docs.select("doc_id", "text")
    assert f(spark, bare, D).columns == ["doc_id", "text"]


def test_shares_after_the_mixing_stage_meet_the_targets(spark):
    """Drawn once or not: expected shares of the tokens that stay, by the operator's own posteriors, with its own settings."""
    rng = random.Random(3)
    plain = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    kinds = {"clean": [], "low": ["|", "###"], "toxic": ["idiot", "scum"]}
    dealt = rng.choices(list(kinds), [0.75, 0.15, 0.10], k=3000)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(plain, k=60) + kinds[d] + [f"w{i}"])) for i, d in enumerate(dealt)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, d in enumerate(dealt) if i % 3], "doc_id long, domain string")
    for most in (1.0, None):
        made, reached = mixing.mix_and_shares(docs, labels, mixing.TARGETS, most=most)
        assert all(abs(reached[d] - w) < 0.01 * w for d, w in mixing.TARGETS.items())
        rows = {r.doc_id: r for r in made.collect()}
        tokens = {d: sum(rows[i].draws * rows[i].n_tokens for i, x in enumerate(dealt) if x == d) for d in kinds}
        assert all(abs(tokens[d] / sum(tokens.values()) - w) < 0.02 for d, w in mixing.TARGETS.items())
        assert most is None or max(r.draws for r in rows.values()) == 1
        kept = sum(rows[i].draws > 0 for i, d in enumerate(dealt) if d == "clean") / dealt.count("clean")
        assert kept > 0.99


def test_the_descent_reaches_what_a_plain_solver_reaches(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.dirichlet([0.3, 0.3, 0.3], 400), 2)
    p[:, 2] = 1 - p[:, 0] - p[:, 1]
    n = rng.integers(1, 400, 400)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>").repartition(3)
    goal = np.array([0.6, 0.37, 0.03])
    for most in (None, 1.0):
        rated, reached = mixing.descend_rates(df, goal.tolist(), most, tolerance=1e-3)
        rate = np.array([r.rate for r in rated.orderBy("doc_id").collect()])
        share = n / n.sum()
        aim = goal if most is None else np.minimum(goal * (share @ p)[0] / goal[0], share @ p)
        by, x, top = 1 / np.maximum(aim, 0.01), np.ones(400), np.inf if most is None else most
        for _ in range(60000):
            x = np.clip(x - 0.02 * (p @ (by * (p.T @ (share * x) - aim)) + mixing.PULL * (x - 1)), 0, top)
        assert np.abs(p.T @ (share * (rate - x))).max() < 5e-3 and rate.min() >= 0 and rate.max() <= top
        assert np.abs(np.array(reached) - p.T @ (share * rate) / (share * rate).sum()).max() < 1e-9


def test_copies_teach_the_mixing_classifier_once(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    copy = " ".join(word() for _ in range(80))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        rows.append((i, copy if toxic and i % 12 else " ".join(word() for _ in range(80)) + (" idiot scum" if toxic else "")))
        labels.append((i, "toxic" if toxic else "clean"))
    rows += [(1000 + i, " ".join([*(word() for _ in range(70)), *rng.sample(copy.split(), 10)])) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, priors = mixing.learn(docs, spark.createDataFrame(labels, "doc_id long, domain string"), ["clean", "toxic"])
    got = {r.doc_id: r.p for r in mixing.posteriors(docs, model, priors).collect()}
    assert sum(got[1000 + i][0] > 0.5 for i in range(50)) > 45
    assert all(got[i][1] > 0.5 for i in range(0, 600, 12))
