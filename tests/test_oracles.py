"""Every query that has an oracle gives the oracle's rows."""

import math

import duckdb
import pytest

from arbora import registry

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0  # -0.0 as 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    cur = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(got) == len(want) and want
    off = [(a, b) for a, b in zip(got, want) if a != b]
    assert not off, (len(off), off[:2])


def test_every_query_runs_or_has_an_oracle():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
