"""Stored runs: typed reads, bucketed copies that meet without an exchange, and partitions that stay as they are."""

from __future__ import annotations

from docketry import registry_backfill
from docketry.operators import rollup
from docketry.operators.nested import nest_colocated
from docketry.sources import relational


def test_bucketed_runs_are_derived_without_an_exchange(spark, small):
    tables = registry_backfill.tables(spark, small)
    relational.store_bucketed(tables, "stored", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = rollup.backfill(relational.load_bucketed(spark, "stored"), nest_colocated)
        assert "Exchange" not in df._jdf.queryExecution().sparkPlan().toString() and "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
        ours = sorted(map(repr, df.collect()))
        assert ours == sorted(map(repr, rollup.backfill(tables).collect())) and len(ours) > 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in relational.SCHEMAS:
            spark.sql(f"DROP TABLE IF EXISTS stored_{name}")


def test_typed_reads_and_partial_overwrites(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a", "completed", 5), (2, "b", "failed", 6)], "run_id int, org_id string, status string, more int")
    made = relational.typed({"runs": runs})["runs"]
    made.write.parquet(f"{tmp_path}/runs")
    for name in set(relational.SCHEMAS) - {"runs"}:
        spark.createDataFrame([], relational.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}")
    read = relational.load_relational(spark, str(tmp_path))
    assert set(read) == set(relational.SCHEMAS) and read["runs"].schema["run_id"].dataType.simpleString() == "bigint"
    assert [tuple(r) for r in read["runs"].select("run_id", "status", "flags").orderBy("run_id").collect()] == [(1, "completed", None), (2, "failed", None)]
    out = str(tmp_path / "out")
    relational.overwrite_touched(runs, out, "org_id")
    relational.overwrite_touched(spark.createDataFrame([(3, "b", "new", 1)], runs.schema), out, "org_id")
    assert sorted((r.org_id, r.run_id) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 3)]
