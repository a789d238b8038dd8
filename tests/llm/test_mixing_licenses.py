"""Mixing against a plain solver, and license scans against their oracle."""

import duckdb
import numpy as np
import pytest

from arbora.llm import licenses, mixing

D = "/root/testdata/sf0.01"


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    n = rng.integers(1, 400, 300)
    df = spark.createDataFrame([(i, int(a), b.tolist()) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>").repartition(3)
    goal = np.array([0.6, 0.3, 0.1])
    got, reached = mixing.fit_rates(df, goal.tolist(), steps=60)
    rate = np.array([r.rate for r in got.orderBy("doc_id").collect()])
    assert rate.min() >= 0 and np.abs(np.array(reached) - goal).max() < 0.01
    x, share = np.ones(300), n / n.sum()
    for _ in range(20000):
        x = np.maximum(x - 0.5 * (p @ (p.T @ (share * x) - goal) + mixing.RIDGE * (x - 1)), 0)
    assert np.abs(p.T @ (share * (rate - x))).max() < 0.005


def test_query_and_its_classifier(spark):
    con = duckdb.connect()
    truth = dict(con.execute(f"select doc_id, case when toxic = 1 then 'toxic' when quality = 1 then 'clean' else 'low' end from '{D}/labels.parquet'").fetchall())
    docs = {r[0] for r in con.execute(f"select doc_id from '{D}/documents.parquet'").fetchall()}
    rows = mixing.op5_mixing(spark, D).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    guess = {r.doc_id: max(("clean", "low", "toxic"), key=lambda d: r[f"p_{d}"]) for r in rows}
    assert sum(guess[k] == v for k, v in truth.items()) / len(truth) > 0.9
    assert all(abs(r.p_clean + r.p_low + r.p_toxic - 1) < 1e-9 and r.rate >= 0 and int(r.rate) <= r.draws <= int(r.rate) + 1 for r in rows)

    def shares(rate):
        sums = {d: sum(rate(r) * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS}
        return {d: v / sum(sums.values()) for d, v in sums.items()}

    # 399 labels leave soft posteriors, with which no rates reach the targets; the solver's own test holds it against the optimum
    before, after = shares(lambda r: 1.0), shares(lambda r: r.rate)
    gap = lambda x: sum((x[d] - w) ** 2 for d, w in mixing.TARGETS.items())
    assert gap(after) < gap(before) / 3
    clean = [r.draws > 0 for r in rows if truth.get(r.doc_id) == "clean" and r.n_tokens >= 50]
    assert sum(clean) / len(clean) > 0.9  # 0.94 with so few labels


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    known = mixing.label_domains(spark.read.parquet(f"{D}/labels.parquet"))
    model, priors = mixing.learn(docs, known.where("doc_id % 2 = 0"), ["clean", "low", "toxic"])
    held = mixing.posteriors(docs, model, priors).join(known.where("doc_id % 2 = 1"), "doc_id").collect()
    right = [max(zip(r.p, ["clean", "low", "toxic"]))[1] == r.domain for r in held]
    assert sum(right) / len(right) > 0.85


def test_mixing_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "good text here", 0), (3, "good text here", 0), (None, "x", 0), (4, "w " * 20000, 0)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(3, "a"), (3, "b"), (9, "a"), (None, "a"), (4, None)], "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mix(docs, labels, {"a": 1.0, "b": 3.0}).collect()}
    assert got.keys() == {1, 2, 3, 4, None}
    assert (got[1].rate, got[1].n_tokens, got[2].rate, got[None].rate) == (1.0, 0, 1.0, 1.0)
    assert (got[3].n_rows, got[3].n_tokens, got[4].n_tokens) == (2, 6, 20000)
    assert mixing.mix(docs.limit(0), labels, {"a": 1.0}).count() == 0
    assert mixing.mix(docs, labels.limit(0), {"a": 1.0, "b": 1.0}).where("abs(p[0] - 0.5) < 1e-9").count() == 5


def test_license_query_matches_its_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as from '{D}/documents.parquet'")
    want = sorted(con.execute(licenses.ORACLES["op6_license_scan"]).fetchall())
    got = sorted(map(tuple, licenses.op6_license_scan(spark, D).collect()))
    assert got == want and sum(n > 0 for _, n, _ in want) > 20


def test_license_cases(spark):
    text = licenses.NOTICES["mit-grant"]
    edited = text.replace("free of charge", "for nothing at all")
    rows = [(1, None), (2, ""), (3, "all"), (4, "xx\nALL  rights-reserved!"), (5, "pad words before it " * 7 + edited), (6, text[: len(text) // 2]), (7, "z " * 30000 + "Released under the MIT License. " + "z " * 30000), (7, "rights reserved all"), (None, "Released under the MIT license")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, matches int, s string")
    got = sorted((r.doc_id or -1, [m.license for m in r.matches]) for r in licenses.scan_licenses(df).collect())
    assert got == [(-1, ["mit"]), (1, []), (2, []), (3, []), (4, ["all-rights-reserved"]), (5, ["mit-grant"]), (6, []), (7, []), (7, ["mit"])]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(df, {"short": "one"})


def test_native_plans(spark):
    for df in (licenses.op6_license_scan(spark, D), mixing.op5_mixing(spark, D)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_a_rare_domain_reaches_its_target_or_the_miss_is_reported(spark, caplog):
    sizes = {"clean": 9800, "low": 180, "toxic": 20}
    rows = [(i, 50, [float(d == x) for x in sizes]) for i, d in enumerate(d for d, n in sizes.items() for _ in range(n))]
    soft = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    _, early = mixing.fit_rates(soft, [mixing.TARGETS[d] for d in sizes])
    assert early[2] < 0.02 and "off the optimum" in caplog.text and str(round(early[2], 4)) in caplog.text
    rated, reached = mixing.solve_rates(soft, [mixing.TARGETS[d] for d in sizes])
    assert all(abs(a - mixing.TARGETS[d]) < 0.01 * mixing.TARGETS[d] for a, d in zip(reached, sizes))
    rates = sorted({round(r.rate, 6) for r in rated.collect()})
    assert len(rates) == 3 and abs(rates[-1] - 15) < 0.1
    with pytest.raises(RuntimeError):
        mixing.solve_rates(soft, [mixing.TARGETS[d] for d in sizes], steps=0)


def test_reached_shares_are_returned(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), mixing.label_domains(spark.read.parquet(f"{D}/labels.parquet"))
    made, reached = mixing.mix_and_shares(docs, labels, mixing.TARGETS)
    sums = [sum(r.rate * r.n_tokens * r.p[i] for r in made.collect() if r.n_tokens) for i in range(3)]
    assert list(reached) == sorted(mixing.TARGETS) and all(abs(a - s / sum(sums)) < 1e-6 for a, s in zip(reached.values(), sums))
