"""Every query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from strandline.plans import registry, streams  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    mine = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE:
        assert len(mine)
        return
    theirs = con.sql(registry.ORACLE[name]).df()
    assert set(mine.columns) == set(theirs.columns)
    columns = sorted(mine.columns)
    assert sorted(map(tuple, mine[columns].astype(str).values.tolist())) == sorted(map(tuple, theirs[columns].astype(str).values.tolist()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
