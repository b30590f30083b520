"""Every registered query against its SQL twin on the small tables."""

import duckdb
import pytest

from corvane.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return round(float(v), 6)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def rows(found):
    return sorted((tuple(plain(v) for v in r) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_twin(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows([r[i] for i in at] for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0
