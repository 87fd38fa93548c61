"""Every query with SQL gives the rows that DuckDB gives; plans are those that scale."""

import duckdb
import pytest

from quillspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name == "todo_anti_join"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_todo_is_an_anti_join_on_pruned_scans(spark):
    text = plan(catalog.QUERIES["todo_anti_join"](spark, SF))
    assert "LeftAnti" in text and "ReadSchema: struct<l_orderkey:bigint>" in text and "o_totalprice" not in text


def test_existing_prefix_does_not_multiply_rows(spark):
    text = plan(catalog.QUERIES["version_skip_failed"](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "Generate" not in text


def test_running_totals_meet_in_one_row_a_bucket(spark):
    """Only the aggregated buckets go through a single partition."""
    text = plan(catalog.QUERIES["checkpoint_totals"](spark, SF))
    single = text.index("SinglePartition")
    assert "HashAggregate" in text[single : single + 600]
