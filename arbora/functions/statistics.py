"""Aggregates as the engine means them: not-finite numbers are missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def stats11(c: str) -> list[Column]:
    """n, mean, sd (0 for one value), sem, median, q25, q75, iqr, min, max and sum of the finite values."""
    v = finite(c)
    n, sd = F.count(v), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    places = [0.25, 0.5, 0.75]
    quartiles = F.percentile(v, F.array(*map(F.lit, places)))  # asked once: Spark keeps one buffer a column
    q = lambda p: F.get(quartiles, F.lit(places.index(p)))
    named = {"n": n, "mean": F.avg(v), "sd": sd, "sem": sd / F.sqrt(F.nullif(n, F.lit(0))), "median": q(0.5), "q25": q(0.25), "q75": q(0.75), "iqr": q(0.75) - q(0.25), "min": F.min(v), "max": F.max(v), "sum": F.sum(v)}
    return [x.alias(f"{c}_{k}") for k, x in named.items()]


def stats11_sql(c: str, digits: int = 6) -> str:
    v = f"CASE WHEN isfinite({c}) THEN {c} END"
    sd = f"CASE WHEN count({v}) > 0 THEN coalesce(stddev_samp({v}), 0) END"
    named = {"n": None, "mean": f"avg({v})", "sd": sd, "sem": f"({sd}) / sqrt(nullif(count({v}), 0))", "median": f"quantile_cont({v}, 0.5)", "q25": f"quantile_cont({v}, 0.25)", "q75": f"quantile_cont({v}, 0.75)", "iqr": f"quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)", "min": f"min({v})", "max": f"max({v})", "sum": f"sum({v})"}
    return ", ".join(f"count({v}) AS {c}_n" if k == "n" else f"round({x}, {digits}) AS {c}_{k}" for k, x in named.items())


def weighted_mean(value: str, weight: str) -> Column:
    """Mean by positive weights over finite values; unweighted where no weight is positive."""
    v, w = finite(value), F.when(finite(weight) > 0, finite(weight))
    return F.coalesce(F.sum(v * w) / F.nullif(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0)), F.avg(v))


def rma(x: str, y: str) -> dict[str, Column]:
    """Reduced-major-axis line of pairs: n, slope, intercept, r. Null below three pairs."""
    r = F.corr(F.col(x), F.col(y))
    ok = (F.regr_count(F.col(y), F.col(x)) >= 3) & (F.regr_sxx(F.col(y), F.col(x)) > 0)
    slope = F.when(r < 0, -1.0).otherwise(1.0) * F.sqrt(F.regr_syy(F.col(y), F.col(x)) / F.regr_sxx(F.col(y), F.col(x)))
    return {"n": F.regr_count(F.col(y), F.col(x)), "slope": F.when(ok, slope), "intercept": F.when(ok, F.regr_avgy(F.col(y), F.col(x)) - slope * F.regr_avgx(F.col(y), F.col(x))), "r": F.when(ok, r)}


def rounded(df, digits: int = 6):
    """Every double column rounded, for results that are compared across engines."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
