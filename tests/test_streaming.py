import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from yieldspark.operators import spc
from yieldspark.streaming import charts

SF = "/root/testdata/sf0.001"


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def events(spark, tmp_path, parts):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type", "value")
    rows.repartitionByRange(parts, "ts").write.parquet(str(tmp_path))
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_p_chart_equals_batch(spark, tmp_path):
    rows, stream = events(spark, tmp_path / "e", 3)
    flag = F.col("event_type") == "error"
    got = run(charts.stream_p_chart(stream, "ts", flag, 0.2, late="60 days"), "complete", "chart")
    want = charts.stream_p_chart(rows, "ts", flag, 0.2)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_duplicates_once(spark, tmp_path):
    rows, stream = events(spark, tmp_path / "e", 1)
    rows.write.mode("append").parquet(str(tmp_path / "e"))
    assert run(charts.fresh_rows(stream, "event_id", "ts", "60 days"), "append", "fresh").count() == rows.count()


def test_ewma_carries_state(spark, tmp_path):
    rows = [("a", i, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "sensor string, t long, x double")
    for k in range(2):
        df.where((F.col("t") >= 20 * k) & (F.col("t") < 20 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = run(charts.stream_ewma(stream, "sensor", "t", "x", {"a": 2.0}), "update", "ewma_state")
    z = 2.0
    for _, _, x in rows:
        z = 0.2 * x + 0.8 * z
    last = got.orderBy(F.desc("n")).first()
    assert last["n"] == 40 and abs(last["ewma"] - z) < 1e-9


@pytest.mark.parametrize("triggers", [1, 4])
def test_run_rules_equal_batch_in_any_triggers(spark, tmp_path, triggers):
    """Rows that come up to two days late, over any number of triggers, get the flags of the whole table."""
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))
    limits = rows.groupBy("event_type").agg(F.avg("value").alias("center"), (F.stddev("value") / 3).alias("sigma"))
    last = rows.agg(F.max("ts")).first()[0]
    ends = limits.select(F.lit(-1).cast("long").alias("event_id"), (F.lit(last) + F.expr("interval 9 days")).alias("ts"), "event_type", F.lit(0.0).alias("value"))
    arrives = F.col("ts") + F.make_interval(hours=F.pmod(F.hash("event_id"), F.lit(48)))
    dealt = rows.withColumn("part", F.ntile(triggers).over(Window.orderBy(arrives)))
    for k in range(triggers):  # one file after the other: the source reads them by time
        dealt.where(F.col("part") == k + 1).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    ends.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))  # the watermark passes all rows
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 if triggers > 1 else 100).parquet(str(tmp_path / "e"))
    assert len(list((tmp_path / "e").glob("part-*"))) == triggers + 1
    got = run(charts.stream_run_rules(stream, "event_type", "ts", "event_id", "value", limits, "3 days"), "append", f"rules{triggers}").where("event_id >= 0")
    z = (F.col("value") - F.col("center")) / F.col("sigma")
    want = spc.western_electric(rows.join(limits, "event_type"), ["event_type"], ["ts", "event_id"], z).select("event_type", "ts", "event_id", z.alias("z"), "r1", "r2", "r3", "r4")
    tidy = lambda df: sorted((r["event_type"], r["ts"], r["event_id"], r["z"] and round(r["z"], 9), r["r1"], r["r2"], r["r3"], r["r4"]) for r in df.collect())
    assert tidy(got) == tidy(want) and got.where("r2").count() > 0
