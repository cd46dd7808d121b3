import duckdb
import pytest
from pyspark.sql import functions as F

from netfusion.plans import registry
from netfusion.sources import sinks

SF = "/root/testdata/sf0.001"


def test_later_values_win_and_null_ones_do_not(spark, tmp_path):
    at, schema = str(tmp_path / "t"), "id long, a string, b int"
    make = lambda rows: spark.createDataFrame(rows, schema)
    sinks.merge_rows(make([(1, "x", 1), (2, "y", None), (None, "z", 3), (2, "q", None)]), at, ["id"])
    second = make([(1, None, 9), (3, "new", 4), (None, "zz", None)])
    want = {(1, "x", 9), (2, "y", None), (3, "new", 4), (None, "zz", 3)}
    for _ in range(2):
        sinks.merge_rows(second, at, ["id"])
        assert {tuple(r) for r in sinks.read_merged(spark, at).collect()} == want
    sinks.merge_rows(make([]), at, ["id"])
    assert {tuple(r) for r in sinks.read_merged(spark, at).collect()} == want


def test_a_failed_merge_and_a_second_writer_leave_the_version_before(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.merge_rows(spark.range(3), at, ["id"])
    with pytest.raises(Exception, match="lost"):
        sinks.merge_rows(spark.range(9).select(F.when(F.col("id") > 5, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id")), at, ["id"])
    assert sinks.read_merged(spark, at).count() == 3
    (tmp_path / "t" / "versions" / "1").write_text("")  # one that another writer has begun
    with pytest.raises(Exception, match="exists"):
        sinks.merge_rows(spark.range(5), at, ["id"])
    assert sinks.read_merged(spark, at).count() == 3


def test_query_as_its_sql(spark):
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "events", "supplier", "part", "nation", "region"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = registry.queries()["graph_merged"](spark, SF)
    want = con.sql(registry.oracle_sql()["graph_merged"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(float(r[i]) if want.columns[i] == "confidence" and r[i] is not None else r[i] for i in order)) for r in want.fetchall())


def test_tasks_of_a_merge_grow_with_its_rows(spark, tmp_path, monkeypatch):
    from netfusion import session

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rows = spark.range(1000).selectExpr("id % 500 AS k", "id AS v")
    for _ in range(2):
        sinks.merge_rows(rows, f"{tmp_path}/m", ["k"])
    got = sinks.read_merged(spark, f"{tmp_path}/m")
    assert got.count() == 500 and got.where("v = k + 500").count() == 500
    assert len(got.inputFiles()) == 20 and not list((tmp_path / "m").glob("in-*"))
