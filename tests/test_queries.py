"""Every query of the registry against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from engram.plans import more, registry  # noqa: F401

SF = os.environ.get("QUERY_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    got = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = Counter(tuple(plain(x) for x in r) for r in got.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want
    assert want or name in ("glossary", "force_links")
