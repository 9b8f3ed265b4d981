"""Streaming queries over the given tables, each drained and read back; where it is the same, the SQL is that of its batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators.usage import call_cost
from docquarry.plans.registry import query
from docquarry.plans.usage import CALLS, calls
from docquarry.session import Scratch, table
from docquarry.streaming import jobs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.abs("value") * 100).cast("long").alias("prompt_tokens"), (F.length("props") * 10).cast("long").alias("completion_tokens"),
    )
    return call_cost(rows, spark.createDataFrame([("click", "4", "8")], "model string, price_in string, price_out string"))


def _drained(spark: SparkSession, frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    path = Scratch(spark, name).path
    return jobs.drained(spark, frame, f"{path}/out", f"{path}/state", mode)


@query(f"WITH {CALLS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, CAST(sum(cost) AS VARCHAR) AS cost FROM costed GROUP BY CAST(ts AS DATE)")
def stream_usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode: every day, the last included."""
    rows = _drained(spark, jobs.usage_by_day(_calls(spark, sf_dir)), "usage_by_day", "complete")
    return rows.select(F.col("day").cast("string").alias("day"), "calls", F.col("cost").cast("string").alias("cost"))


#: Calls arrive in five batches by time; every tenth comes one or two batches too late.
_ARRIVED = f"""{CALLS}, span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) - min(epoch_us(ts)) + 1 AS width FROM costed),
t AS (SELECT *, epoch_us(ts) AS us, (epoch_us(ts) - lo) * 4 // width AS q FROM costed, span),
a AS (SELECT *, CASE WHEN call_id % 10 = 0 THEN least(q + 1 + call_id // 10 % 2, 4) ELSE q END AS batch FROM t),
tops AS (SELECT batch, max(max(us)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a GROUP BY batch)"""


def _arriving(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = calls(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    q = F.expr(f"(us - {low}) * 4 div {high - low + 1}")
    batch = F.when(F.col("call_id") % 10 == 0, F.least(q + 1 + F.floor(F.col("call_id") / 10) % 2, F.lit(4))).otherwise(q)
    rows = Scratch(spark, "arriving").save("calls", rows.withColumn("batch", batch).drop("us"))
    return [rows.filter(F.col("batch") == b).drop("batch") for b in range(5)]


@query(f"""
WITH {_ARRIVED}, kept AS (SELECT *, date_trunc('day', ts) AS day FROM a JOIN tops USING (batch)
  WHERE before IS NULL OR epoch_us(date_trunc('day', ts)) // 1000 + 86400000 > before // 1000 - 3600000)
SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS day, count(*) AS calls, CAST(sum(cost) AS VARCHAR) AS cost FROM kept
WHERE epoch_us(day) // 1000 + 86400000 <= (SELECT max(us) // 1000 FROM a) - 3600000 GROUP BY day""")
def stream_usage_by_day_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode over batches out of order: a day comes out once the watermark has passed it, without the calls that came after that."""
    path = Scratch(spark, "late-usage").path
    run = lambda live: jobs.drained(spark, jobs.usage_by_day(live), f"{path}/out", f"{path}/state")
    jobs.replayed(_arriving(spark, sf_dir), f"{path}/calls", run)
    return spark.read.parquet(f"{path}/out").select(F.col("day").cast("string").alias("day"), "calls", F.col("cost").cast("string").alias("cost"))


@query(f"""
WITH {_ARRIVED}, k AS (SELECT *, before IS NOT NULL AND us < before - 2 * 86400000000 AS late FROM a JOIN tops USING (batch)),
r AS (SELECT call_id, greatest(CAST(sum(cost) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY batch, ts, call_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 2.0, CAST(sum(cost) OVER (PARTITION BY session_id ORDER BY batch, ts, call_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 0.1) AS ratio FROM k WHERE NOT late)
SELECT call_id, CASE WHEN ratio >= 1 THEN 'reject' WHEN ratio >= 0.95 THEN 'cache_only' WHEN ratio >= 0.8 THEN 'warn' ELSE 'ok' END AS action FROM r UNION ALL SELECT call_id, 'late' FROM k WHERE late""")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both budgets over batches out of order; calls more than two days late aren't counted."""
    path = Scratch(spark, "ledger").path
    run = lambda live: jobs.budget_ledger(live, path, f"{path}/state", 2.0, 0.1, "2 days", "4000 days").awaitTermination()
    jobs.replayed(_arriving(spark, sf_dir), f"{path}/calls", run)
    return spark.read.parquet(f"{path}/actions").select("call_id", "action")


@query("SELECT user_id AS task_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: the last row written for each task is its state."""
    events = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), "event_id", "ts")
    rows = _drained(spark, jobs.latest_status(events, "status", "event_id"), "latest_status", "update")
    return rows.groupBy("task_id").agg(F.max_by("status", "epoch").alias("status"), F.max_by("event_id", "epoch").alias("event_id"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 1800000000, true) AS fresh FROM events),
s AS (SELECT user_id, t, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS session_id, min(t) AS first_call, count(*) AS calls FROM s GROUP BY user_id, k""")
def stream_usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drained(spark, jobs.usage_sessions(_calls(spark, sf_dir)), "usage_sessions", "complete")
    return rows.select("session_id", F.unix_micros("first_call").alias("first_call"), "calls")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_once_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a horizon longer than the table each (user, type) comes through once."""
    events = _stream(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, jobs.once_within(events, "4000 days", "user_id", "event_type"), "once_within").select("user_id", "event_type")


@query("SELECT conv_id AS session_id, turn AS seq, md5(coalesce(string_agg(role || ': ' || substr(text, 1, 2000), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '')) AS digest FROM conversations")
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each message has before it, kept as state of its session; such state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("seq"), "role", F.col("text").alias("content"))
    return _drained(spark, jobs.live_history(live), "history").select("session_id", "seq", F.md5("history").alias("digest"))
