"""Mixing to target weights with soft membership, with DataFrame expressions only.

A classifier learned from a table of labelled documents gives each document's posterior over domains; a document of n tokens
then supplies n * p[d] tokens to domain d. The rates r >= 0 minimise

    1/2 sum_d (sum_i r_i n_i p_i[d] / N - target[d])^2 / target[d]  +  PULL / 2 sum_i n_i / N (r_i - 1)^2

by projected gradient with momentum: a step needs one distributed sum of D numbers and moves every rate by its own posterior, in the metric
of its tokens. It ends when no rate has a slope above SLOPE to follow; what it reaches is returned, and logged where it misses. The ridge
keeps rates near 1 where the targets leave a choice. draws is a rate made whole: its floor, and one more with the probability of the
rest, decided by a hash of the id, so that the expected total is the rate's. With a largest rate of 1 no document is drawn twice.

Classifier: words (lower-cased runs of other than space) that one domain's documents hold much oftener than the others' are its markers. Evidence
of a document is how strong its markers of each domain are, and its shares of upper case, of symbols and of distinct words, each within
three classes of length; the domains' rates of these come from labelled documents whose markers were found in others. Copies teach
once. At most TRAIN_DOCS labelled documents a domain teach, chosen by a hash of the id; this bounds the sample and nothing else.

Null and empty texts have no tokens, the prior as posterior, and rate 1. Documents with a null id are kept with rate 1. Without labels all
domains are equally likely. Labels of one document that disagree: the last in order of domain name. Rows that repeat an id share posteriors of all
their texts together, and count as often as they occur. Other columns are not read. Targets are scaled to sum to 1.

fit_rates and solve_rates are other ways to the rates: a fixed number of steps over all documents, and Newton's method on the dual.
"""

from __future__ import annotations

import logging
import math
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.session import stash, table

log = logging.getLogger(__name__)

TRAIN_DOCS, MIN_SCORE, MIN_LIFT, STEPS_A_CELL = 3000, 3.0, 4.0, 20
#: Up to this many markers are broadcast (16 bytes each); beyond, words and markers are shuffled.
BROADCAST_WORDS = 1_000_000
STEPS, RIDGE, TOLERANCE = 40, 1e-3, 1e-6
#: The descent of mix: most steps, ridge, largest slope left where a rate can move, and a miss of a share that is reported.
DESCENT_STEPS, PULL, SLOPE, MISS = 400, 1e-4, 1e-3, 0.002
#: Posteriors that differ, up to which their rates are broadcast (about 100 bytes each).
BROADCAST_CLASSES = 200_000
#: Weights asked of the domains of the labels table.
TARGETS = {"clean": 0.90, "low": 0.07, "toxic": 0.03}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[ \t\n\u000B\f\r]"), lambda w: w != "")


def features(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, numbers of tokens, of distinct ones, of upper-case runs and of runs of symbols, and the distinct hashed words."""
    given = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(doc_id).alias("doc_id"), given.alias("text")).withColumn("w", _words(F.col("text"))).withColumn("n_tokens", F.size("w").cast("long")).withColumn("kinds", F.array_distinct("w"))
    counts = [F.size("kinds").cast("long").alias("n_kinds"), F.regexp_count("text", F.lit("[A-Z]{3,}")).cast("long").alias("n_upper"), F.regexp_count("text", F.lit(r"[#*$%&|<>!]{2,}|\|")).cast("long").alias("n_symbols")]
    return cut.select("doc_id", "n_tokens", *counts, F.transform("kinds", lambda w: F.xxhash64(w)).alias("words"))


def _sample(known: DataFrame, size: dict[str, int]) -> DataFrame:
    """TRAIN_DOCS rows of each domain with the smallest hashes of their ids; few more than that many are sorted."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    parts = [known.where((F.col("domain") == d) & (place < int(min(1.0, (2 * TRAIN_DOCS + 500) / max(n, 1)) * (1 << 30)))).orderBy(place, "doc_id").limit(TRAIN_DOCS) for d, n in sorted(size.items())]
    return reduce(DataFrame.unionByName, parts)


def _marked(have: DataFrame, markers: DataFrame, k: int) -> DataFrame:
    """One row an id: the sums of its rows' numbers, and the strength of each domain's markers among its words (m0, m1, ...)."""
    sums = ["n_tokens", "n_kinds", "n_upper", "n_symbols"]
    rows = have.select("doc_id", *sums, F.explode(F.concat(F.array(F.lit(0).cast("long")), "words")).alias("word"))
    # an entry of no domain keeps documents without a marker and carries their numbers
    own = markers.where("word <> 0").unionByName(markers.sparkSession.range(1).select(F.lit(0).cast("long").alias("word"), F.lit(-1).alias("of"), F.lit(0).alias("strength")))
    own = F.broadcast(own) if own.count() <= BROADCAST_WORDS else own
    first = F.col("of") < 0
    return rows.join(own, "word").groupBy("doc_id").agg(*(F.sum(F.when(first, F.col(c))).alias(c) for c in sums), F.count_if(first).alias("n_rows"), *(F.sum(F.when(F.col("of") == i, F.col("strength")).otherwise(0)).alias(f"m{i}") for i in range(k)))


def _cells(k: int) -> list[Column]:
    """The evidence of a marked document, as numbers of cells: how strong each domain's markers are and how few its words repeat, both within three classes
    of length, and its shares of upper case and symbols."""
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    long = F.when(n < 100, 0).when(n < 1000, 1).otherwise(2) * STEPS_A_CELL
    many = [long + F.least(F.floor(2 * F.log2(F.col(f"m{i}") + F.lit(1.0))), F.lit(STEPS_A_CELL - 1)) for i in range(k)]
    tenth = lambda c: F.floor(F.least(F.col(c) / n, F.lit(1.0)) * 10)
    return [x.cast("int") for x in [*many, long + tenth("n_kinds"), tenth("n_upper"), tenth("n_symbols")]]


class Classifier(NamedTuple):
    """markers: (word, of, strength), the domain that each word speaks for; weights: of each evidence, cell and domain."""

    markers: DataFrame
    weights: list[list[list[float]]]


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text") -> tuple[Classifier, list[float]]:
    """The classifier and the domains' log priors. labelled has doc_id and domain."""
    k = len(domains)
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    prior = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    total = sum(prior.values()) + k
    priors = [math.log((prior.get(d, 0) + 1) / total) for d in domains]
    index = F.array_position(F.array(*(F.lit(d) for d in domains)), F.col("domain")).cast("int") - 1
    chosen = stash(_sample(known, {d: prior.get(d, 0) for d in domains}).select("doc_id", index.alias("is")), "chosen")
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most TRAIN_DOCS ids a domain
    # copies share their smallest hashed run of three words: those that do count once for a word or a cell
    w, run = _words(F.coalesce("text", F.lit(""))), F.size("w") - 3
    runs = F.transform(F.sequence(F.lit(0), F.greatest(run, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    kin = sample.select("doc_id", w.alias("w")).groupBy("doc_id").agg(F.min(F.array_min(runs)).alias("kin"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    about = stash(chosen.join(kin, "doc_id").withColumn("half", half), "about")
    seen = stash(features(sample.select("doc_id", "text"), "doc_id", "text").where("n_tokens > 0").join(F.broadcast(about), "doc_id"), "taught")
    size = {(r.half, r["is"]): r.n for r in seen.groupBy("half", "is").agg(F.countDistinct("kin").alias("n")).collect()}
    n = [[size.get((h, i), 0) for i in range(k)] for h in (0, 1)]
    counts = [F.count_if((F.col("half") == h) & (F.col("is") == i)).cast("double").alias(f"c{h}{i}") for h in (0, 1) for i in range(k)]
    held = seen.select("half", "is", "kin", F.explode("words").alias("word")).distinct().groupBy("word").agg(*counts)
    # each half is judged by markers found in the other, so that the weights are of documents the markers have not seen
    folds = [([F.col(f"c0{i}") for i in range(k)], n[0]), ([F.col(f"c1{i}") for i in range(k)], n[1]), ([F.col(f"c0{i}") + F.col(f"c1{i}") for i in range(k)], [a + b for a, b in zip(*n)])]
    best = F.array(*(F.struct(F.lit(f).alias("fold"), _speaks(c, m).alias("best")) for f, (c, m) in enumerate(folds)))
    found = held.select("word", F.explode(best).alias("b")).where("b.best is not null")
    markers = stash(found.select("word", "b.fold", "b.best.of", "b.best.strength"), "markers")
    judged = reduce(DataFrame.unionByName, (_marked(seen.where(F.col("half") == h), markers.where(F.col("fold") == 1 - h).drop("fold"), k) for h in (0, 1)))
    marked = judged.join(F.broadcast(about), "doc_id")
    cells = marked.select("is", "kin", F.posexplode(F.array(*_cells(k))).alias("evidence", "cell")).groupBy("evidence", "cell", "is").agg(F.countDistinct("kin").alias("n")).collect()
    return Classifier(markers.where("fold = 2").drop("fold"), _weights(cells, [max(a + b, 1) for a, b in zip(*n)], k)), priors


def _speaks(counts: list[Column], size: list[int]) -> Column:
    """The domain whose documents hold a word much oftener than the others': (score, of, strength), null if there is none.

    The score is how far its count is above an equal share, in standard deviations; the strength is the logarithm of its rate by the others'.
    """
    size = [max(m, 1) for m in size]
    both = sum(counts, F.lit(0.0))
    share = both / sum(size)
    score = [(c - share * m) / F.sqrt(F.greatest(share * m * (1 - share), F.lit(0.5))) for c, m in zip(counts, size)]
    lift = [(c / m) / ((both - c + 0.5) / (sum(size) - m + 1)) for c, m in zip(counts, size)]
    told = [F.when((s >= MIN_SCORE) & (x >= MIN_LIFT), F.struct(s.alias("score"), F.lit(i).alias("of"), F.floor(F.log2(x)).cast("int").alias("strength"))) for i, (s, x) in enumerate(zip(score, lift))]
    return F.greatest(*told, F.lit(None))


def _weights(cells: list, n: list[int], k: int) -> list[list[list[float]]]:
    """Logarithms of how much likelier a cell is in a domain than in all; a cell that no document has shown says nothing."""
    out = [[[0.0] * k for _ in range(3 * STEPS_A_CELL)] for _ in range(k + 3)]
    found: dict[tuple[int, int], list[int]] = {}
    for r in cells:
        found.setdefault((r.evidence, r.cell), [0] * k)[r["is"]] += r.n
    for (e, c), counts in found.items():
        share = sum(counts) / sum(n)
        out[e][c] = [math.log((counts[i] + 2 * share) / ((n[i] + 2) * share)) for i in range(k)]
    return out


def posteriors(docs: DataFrame, model: Classifier, priors: list[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_rows, n_tokens and p, the posterior of each domain, one row an id."""
    k = len(priors)
    found = _marked(features(docs, doc_id, text), model.markers, k)
    constant = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    told = [F.get(constant(rows), cell) for rows, cell in zip(model.weights, _cells(k))]
    known = found.select("doc_id", "n_rows", "n_tokens", F.array(*told).alias("told"))
    odds = F.transform(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(priors))), lambda d: d["x"] + F.aggregate("told", F.lit(0.0), lambda a, t: a + F.when(F.col("n_tokens") > 0, F.get(t, d["i"])).otherwise(0.0)))
    raised = known.select("doc_id", "n_rows", "n_tokens", odds.alias("o")).select("doc_id", "n_rows", "n_tokens", F.transform("o", lambda x: F.exp(x - F.array_max("o"))).alias("e"))
    return raised.select("doc_id", "n_rows", "n_tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def fit_rates(soft: DataFrame, targets: list[float], steps: int = STEPS, ridge: float = RIDGE) -> tuple[DataFrame, list[float]]:
    """Add rate to a table of (doc_id, n_tokens, p), and the shares reached. Each step sends D numbers to the driver."""
    k = len(targets)
    goal = [t / sum(targets) for t in targets]
    total = float(soft.agg(F.sum("n_tokens")).first()[0] or 0)
    if not total:
        return soft.withColumn("rate", F.lit(1.0)), [0.0] * k
    now = soft.withColumn("rate", F.lit(1.0).cast("double")).withColumn("ahead", F.lit(1.0).cast("double"))
    size = 1 / (1 + ridge)  # the sum of n_i p_i p_i' / N has no eigenvalue above 1
    momentum = 1.0
    for step in range(steps + 1):
        at = now.agg(*(F.sum(F.col("ahead") * F.col("n_tokens") * F.get("p", F.lit(d))).alias(f"s{d}") for d in range(k))).first()
        miss = [(at[f"s{d}"] or 0.0) / total - goal[d] for d in range(k)]
        if step == steps or max(map(abs, miss)) < 1e-4:
            break
        pull = sum((F.get("p", F.lit(d)) * miss[d] for d in range(k)), F.lit(0.0))
        moved = F.greatest(F.col("ahead") - size * (pull + ridge * (F.col("ahead") - 1)), F.lit(0.0))
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        now = now.withColumn("next", moved).withColumn("ahead", F.greatest(F.col("next") + (momentum - 1) / after * (F.col("next") - F.col("rate")), F.lit(0.0))).withColumn("rate", F.col("next")).drop("next")
        momentum = after
        if step % 12 == 11:
            now = stash(now, "rates")
    reached = now.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.get("p", F.lit(d))).alias(f"s{d}") for d in range(k))).first()
    sums = [reached[f"s{d}"] or 0.0 for d in range(k)]
    # the optimality condition: no slope where a rate is positive, none downhill where it is 0
    slope = sum((F.get("p", F.lit(d)) * (sums[d] / total - goal[d]) for d in range(k)), F.lit(0.0)) + ridge * (F.col("rate") - 1)
    off = now.agg(F.max(F.when(F.col("rate") > 0, F.abs(slope)).otherwise(F.greatest(-slope, F.lit(0.0))))).first()[0]
    if off > TOLERANCE:
        log.warning("rates after %d steps are %.2g off the optimum; shares reached %s of %s", step, off, [round(x / max(sum(sums), 1e-300), 4) for x in sums], [round(g, 4) for g in goal])
    return now.drop("ahead"), [s / max(sum(sums), 1e-300) for s in sums]


def solve_rates(soft: DataFrame, targets: list[float], steps: int = STEPS, ridge: float = RIDGE) -> tuple[DataFrame, list[float]]:
    """As fit_rates, but solved to TOLERANCE or failing after steps sums, and with the ridge of a document scaled by its domains' shares of the tokens.

    The optimum has r_i = max(0, 1 - p_i . m / w_i), m the numbers by which the D targets are missed and w_i the document's ridge. m minimises the dual,
    a convex function of D variables: Newton's method with a line search, D * D numbers to the driver each step.
    """
    k = len(targets)
    goal = np.array(targets) / sum(targets)
    p = [F.get("p", F.lit(d)) for d in range(k)]
    size = soft.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * x).alias(f"s{d}") for d, x in enumerate(p))).first()
    total = float(size.n or 0)
    if not total:
        return soft.withColumn("rate", F.lit(1.0)), [0.0] * k
    weight = ridge * sum((x * ((size[f"s{d}"] or 0.0) / total) for d, x in enumerate(p)), F.lit(0.0))
    rows = soft.withColumn("weight", F.when(F.col("n_tokens") > 0, weight))

    def rates(miss: np.ndarray) -> Column:
        pull = sum((x * float(miss[d]) for d, x in enumerate(p)), F.lit(0.0))
        return F.when(F.col("n_tokens") > 0, F.greatest(1 - pull / F.col("weight"), F.lit(0.0))).otherwise(1.0)

    def look(miss: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The dual at miss, its gradient and second derivatives, and the domains' sums."""
        n, r = F.col("n_tokens") / total, F.col("r")
        curve = F.when(r > 0, n / F.col("weight")).otherwise(0.0)
        asked = [F.sum(n * F.col("weight") * r * r / 2), *(F.sum(n * x * r) for x in p), *(F.sum(curve * p[i] * p[j]) for i in range(k) for j in range(i, k))]
        got = [x or 0.0 for x in rows.withColumn("r", rates(miss)).agg(*(a.alias(f"a{i}") for i, a in enumerate(asked))).first()]
        second, sums = np.eye(k), np.array(got[1 : k + 1])
        upper = np.triu_indices(k)
        bent = np.zeros((k, k))
        bent[upper] = got[k + 1 :]
        second += bent + np.triu(bent, 1).T
        return float(miss @ miss / 2 + goal @ miss + got[0]), miss + goal - sums, second, sums

    miss, left = np.zeros(k), steps
    value, slope, second, sums = look(miss)
    while np.abs(slope).max() > TOLERANCE:
        step, part = -np.linalg.solve(second, slope), 1.0
        while True:
            if not left:
                raise RuntimeError(f"rates not found in {steps} steps: off the optimum by {np.abs(slope).max():.2g}, tolerance {TOLERANCE:g}")
            left -= 1
            tried = look(miss + part * step)
            if tried[0] <= value + 1e-4 * part * float(slope @ step) + 1e-15 or np.abs(tried[1]).max() <= TOLERANCE:
                break
            part /= 2
        miss = miss + part * step
        value, slope, second, sums = tried
    return rows.withColumn("rate", rates(miss)).drop("weight"), (sums / max(sums.sum(), 1e-300)).tolist()


def descend_rates(soft: DataFrame, targets: list[float], most: float | None = None, steps: int = DESCENT_STEPS, ridge: float = PULL, tolerance: float = SLOPE) -> tuple[DataFrame, list[float]]:
    """Add rate to a table of (doc_id, n_tokens, p) by projected gradient with momentum, to a tolerance; the shares reached.

    Documents of equal posteriors have equal rates, so the steps run over one row for each posterior that occurs: as many as there are combinations of
    cells of evidence in the corpus. Misses are counted by their targets (a rare domain's as much as a frequent one's), which also sets the step's length. With
    `most` no rate exceeds it; then the domain with the largest target is kept as whole as that allows, others follow in proportion, and one that
    has too little is kept whole and falls short. Momentum starts anew where a step turned back.
    """
    k = len(targets)
    goal = np.array(targets) / sum(targets)
    p = [F.get("p", F.lit(d)) for d in range(k)]
    classes = stash(soft.groupBy("p").agg(F.sum("n_tokens").cast("double").alias("n")), "classes")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    size = classes.agg(F.sum("n"), *(F.sum(F.col("n") * x) for x in p), *(F.sum(F.col("n") * p[i] * p[j]) for i, j in pairs)).first()
    total = float(size[0] or 0)
    if not total:
        return soft.withColumn("rate", F.lit(1.0)), [0.0] * k
    share = np.array(size[1 : k + 1]) / total
    if most is not None:
        main = int(np.argmax(goal))
        goal = np.minimum(goal * most * share[main] / goal[main], most * share)
    by = 1 / np.sqrt(np.maximum(goal, 0.01))
    bent = np.zeros((k, k))
    for (i, j), x in zip(pairs, size[k + 1 :]):
        bent[i, j] = bent[j, i] = x / total * by[i] * by[j]
    length = 1 / (float(np.linalg.eigvalsh(bent)[-1]) + ridge)
    ceiling = F.lit(float("inf") if most is None else float(most))
    inside = lambda x: F.least(F.greatest(x, F.lit(0.0)), ceiling)
    begin = F.least(F.lit(1.0), ceiling)
    now = classes.withColumn("rate", begin).withColumn("ahead", begin).withColumn("off", F.lit(float("inf"))).withColumn("back", F.lit(0.0))
    momentum = 1.0
    for step in range(steps + 1):
        at = now.agg(F.max("off"), F.sum("back"), *(F.sum(F.col("n") * F.col("ahead") * x) for x in p)).first()
        if at[0] <= tolerance or step == steps:
            break
        momentum = 1.0 if at[1] > 0 else momentum
        miss = (np.array(at[2:]) / total - goal) * by * by
        slope = sum((x * float(m) for x, m in zip(p, miss)), F.lit(0.0)) + ridge * (F.col("ahead") - 1)
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        moved = now.withColumn("next", inside(F.col("ahead") - length * slope))
        moved = moved.withColumn("off", F.abs(F.col("next") - F.col("ahead")) / length).withColumn("back", F.col("n") * (F.col("ahead") - F.col("next")) * (F.col("next") - F.col("rate")))
        now = moved.withColumn("ahead", inside(F.col("next") + (momentum - 1) / after * (F.col("next") - F.col("rate")))).withColumn("rate", F.col("next")).drop("next")
        momentum = after
        if step % 8 == 7:
            now = stash(now, "rates")
    now = stash(now.select("p", "n", "rate"), "rates")
    reached = now.agg(F.count("*"), *(F.sum(F.col("n") * F.col("rate") * x) for x in p)).first()
    sums = np.array([x or 0.0 for x in reached[1:]])
    shares = sums / max(sums.sum(), 1e-300)
    missed = np.abs(shares - goal / goal.sum()).max()
    if at[0] > tolerance or missed > MISS:
        log.warning("rates after %d steps are %.2g off the optimum; shares reached %s of %s", step, at[0], shares.round(4).tolist(), (goal / goal.sum()).round(4).tolist())
    rates = now.select("p", "rate")
    return soft.join(F.broadcast(rates) if reached[0] <= BROADCAST_CLASSES else rates, "p"), shares.tolist()


def label_domains(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Domains of the labels table: toxic, else clean or low by quality; rows without both labels say nothing."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "low")
    return labels.where("toxic is not null and quality is not null").select(F.col(doc_id).alias("doc_id"), domain.alias("domain")).where("domain is not null")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", most: float | None = None) -> DataFrame:
    """doc_id, n_rows, n_tokens, p (in order of the domains' names), rate and draws, one row an id."""
    return mix_and_shares(docs, labelled, targets, doc_id, text, most)[0]


def mix_and_shares(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", most: float | None = None, exact: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """The table of mix, and the share of tokens each domain reaches; exact for solve_rates."""
    domains = sorted(targets)
    if exact and most is not None:
        raise ValueError("solve_rates knows no largest rate")
    model, priors = learn(docs, labelled, domains, doc_id, text)
    soft = stash(posteriors(docs, model, priors, doc_id, text), "posteriors")
    wanted, given = [targets[d] for d in domains], soft.where("doc_id is not null and n_tokens > 0")
    rated, reached = solve_rates(given, wanted) if exact else descend_rates(given, wanted, most)
    rest = soft.where("doc_id is null or n_tokens = 0").withColumn("rate", F.lit(1.0))
    return draws(rated.unionByName(rest)), dict(zip(domains, reached))


def draws(rated: DataFrame) -> DataFrame:
    """Add draws: the rate's floor, and one more with the probability of the rest, by a hash of the id."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("draws", F.floor(F.col("rate") + chance).cast("long"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)
    names = sorted(TARGETS)
    return mixed.select("doc_id", "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(names)), "rate", "draws")


QUERIES = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {}
