import pyspark.sql.functions as F

from millrace.operators import lifecycle as batch
from millrace.plans.registry import QUERIES
from millrace.streaming import lifecycle as live

DATA = "/root/testdata/sf0.001"


def files(spark, tmp_path, parts=3):
    """Events in a few files, in order of time."""
    e = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts", "event_id").toPandas()
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    n = -(-len(e) // parts)
    for i in range(parts):
        spark.createDataFrame(e.iloc[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_stateful_equals_batch(spark, tmp_path):
    stream = files(spark, tmp_path).where("event_type IN ('purchase', 'signup', 'click')")
    rows = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"), (F.col("event_type") == "purchase").alias("seen"))
    out = live.drained(live.lifecycle(rows), f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    got = {(r["key"], r["id"]): (r["missing"], r["active"]) for r in out.collect()}
    assert all(r["applied"] for r in out.collect())
    want = {(r["user_id"], r["event_id"]): (r["missing"], r["active"]) for r in QUERIES["absence_lifecycle"](spark, DATA).collect()}
    assert got == want and batch.MISSES_TO_DEACTIVATE == 2


def test_late_snapshot_changes_nothing(spark, tmp_path):
    schema = "key long, id long, at double, seen boolean"
    for part in ([(1, 1, 10.0, True)], [(1, 2, 5.0, False), (1, 3, 11.0, False)], [(1, 4, 11.5, False), (1, 5, 11.2, True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    rows = live.drained(live.lifecycle(stream), f"file://{tmp_path}/c", f"file://{tmp_path}/o").collect()
    assert len(rows) == 5


def test_windows_equal_batch(spark, tmp_path):
    stream = files(spark, tmp_path).withColumn("at", F.col("ts").cast("timestamp"))
    out = live.drained(live.windowed_counts(stream, "at", "6 hours", "1 hour", "event_type"), f"file://{tmp_path}/c", f"file://{tmp_path}/o")
    got = {(r["start"], r["event_type"]): r["n"] for r in out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in QUERIES["tumbling_counts"](spark, DATA).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) > 0.8 * len(want)
