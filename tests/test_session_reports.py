from types import SimpleNamespace

import pytest

from patronage import session
from patronage.functions.numeric import elapsed_days, finite, round_half_up
from patronage.operators import reports
from patronage.plans import customer360 as chain, report_suite
from patronage.sources import readers, tables
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def fake(master, configured=None, current=None):
    chosen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: chosen[-1] if chosen else current, setCheckpointDir=chosen.append)
    conf = SimpleNamespace(get=lambda key, default=None: configured)
    return SimpleNamespace(sparkContext=context, conf=conf), chosen


def test_checkpoint_folder_is_the_clusters():
    spark, chosen = fake("spark://host:7077", "hdfs:///shared/ck")
    assert session.ensure_checkpoint_dir(spark) == "hdfs:///shared/ck" and chosen == ["hdfs:///shared/ck"]
    spark, chosen = fake("spark://host:7077", None, "s3://bucket/ck")
    assert session.ensure_checkpoint_dir(spark) == "s3://bucket/ck" and chosen == []


def test_no_local_folder_on_a_cluster():
    spark, _ = fake("yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)


def test_pin_keeps_rows_and_types(spark):
    df = spark.range(5).select("id", F.lit("2024-01-01 01:02:03").cast("timestamp_ntz").alias("t"), F.array("id").alias("a"))
    stored = session.pin(df)
    assert stored.schema["t"].dataType == df.schema["t"].dataType
    assert sorted(stored.collect()) == sorted(df.collect())


def test_scans_are_not_shuffled(spark):
    plan = tables.table(spark, SMALL, "lineitem")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_numeric_helpers(spark):
    row = spark.sql(
        "select timestamp_ntz'2024-01-01 23:00:00' a, timestamp_ntz'2024-01-03 01:00:00' b, 1.005d x, 2.5d y, 'abc' t, double('inf') i, '7' n"
    ).select(
        elapsed_days(F.col("a"), F.col("b")).alias("days"), round_half_up(F.col("y"), 0).alias("half"),
        round_half_up(F.col("x"), 2).alias("cent"), finite("t").alias("t"), finite("i").alias("i"), finite("n").alias("n"),
    ).first()
    assert (row["days"], row["half"], row["t"], row["i"], row["n"]) == (1, 3.0, None, None, 7.0)
    assert row["cent"] == 1.0  # 1.005 is stored below the half


def test_report_run_writes_every_report(spark, tmp_path):
    sold = tables.sales(
        spark, SMALL,
        ["invoice_yearmonth", "stock_code", "description", "revenue", "quantity", "invoice_id", "customer_id", "unit_price"],
    )
    checks = report_suite.run_reports(chain.build_customer_360(spark, SMALL), sold, str(tmp_path))
    assert checks.count() == 10 and checks.where("not passed").count() == 0
    kpis = readers.read_csv(spark, str(tmp_path / "executive_kpis")).first()
    assert int(kpis["total_customers"]) == 150
    by_sql = spark.sql("select count(*) n from customer_360 where health_tier = 'Healthy'").first()["n"]
    tiers = {r["health_tier"]: r["customer_count"] for r in reports.health_tier_summary(spark.table("customer_360")).collect()}
    assert tiers.get("Healthy", 0) == by_sql


def test_stored_tables_come_from_small_parts(spark):
    """A shuffle larger than the parts allow is not merged into one part a core."""
    asked, merged = "spark.sql.shuffle.partitions", session.MERGE_TO
    before = spark.conf.get(asked), spark.conf.get(merged)
    spark.conf.set(asked, "64")
    try:
        stored = session.pin(spark.range(6_000_000).select(F.xxhash64("id").alias("x"), F.xxhash64("id", F.lit(1)).alias("y")).repartition("x"))
    finally:
        spark.conf.set(asked, before[0])
    parts = stored.groupBy(F.input_file_name()).count().count()
    assert stored.count() == 6_000_000 and parts >= 10 and spark.conf.get(merged) == before[1]


def test_sizes_as_settings_write_them():
    assert [session._bytes(x) for x in ("64MB", "8m", "1048576b", "16384", "2g", " 3 kb")] == [64 << 20, 8 << 20, 1 << 20, 16384, 2 << 30, 3072]
