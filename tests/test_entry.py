import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(repr([None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r]) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_query_matches_sql(spark, name):
    got = entry.queries()[name](spark, D).toPandas()
    assert len(got)
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
        assert rows(got) == rows(c.sql(sql).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
