"""Structured Streaming jobs: ingestion, usage, budgets, history, answers. Each equals its batch operator once the stream is drained.

Event times need TIMESTAMP columns (cast TIMESTAMP_NTZ first). Sinks called for each batch are idempotent by key, so a batch that runs again
after a failure changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from docquarry.operators.search import SearchIndex
from docquarry.operators.segments import SegmentedIndex
from docquarry.operators.usage import CACHE_ONLY, DAY_BUDGET, SESSION_BUDGET, WARN, action, running_sum
from docquarry.sources.manifest import Manifest


def ingest(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], index: SegmentedIndex, checkpoint: str, order: Column | None = None, deleted: str | None = None, compact_every: int = 8) -> StreamingQuery:
    """Chunk documents as they arrive and index them: each batch is one segment, which replaces what was held of its documents.

    ``chunker`` makes chunks (point_id, the index's document column, text, ...) of a batch. A batch writes what it brings and no more (each ``compact_every`` segments the newest are merged);
    one that breaks off changes nothing, and one that runs again after it was committed is left out, so other documents' chunks can't be lost. Of a document that comes twice in
    a batch the row that is greatest by ``order`` counts (by all its columns where none is given). Rows whose column ``deleted`` is true delete their document."""
    doc = index.doc

    def batch(rows: DataFrame, epoch: int) -> None:
        rest = [c for c in rows.columns if c != doc]
        place = F.struct(order, F.struct(*rest)) if order is not None else F.struct(*rest)
        rows = rows.filter(F.col(doc).isNotNull()).groupBy(doc).agg(F.max_by(F.struct(*rest), place).alias("_row")).select(doc, "_row.*").persist()
        try:
            kept = rows if deleted is None else rows.filter(~F.coalesce(F.col(deleted), F.lit(False)))
            number = index.commit(chunker(kept), rows.select(doc), checkpoint, epoch)
        finally:
            rows.unpersist()
        if len(index.manifest.at(number)["segments"]) >= compact_every:
            index.compact()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_by_day(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls, tokens and cost per day of event time; calls later than ``late`` are left out."""
    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day"))
    rows = rows.agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("cost").alias("cost"))
    return rows.select(F.to_date("window.start").alias("day"), "calls", "tokens", "cost")


def usage_sessions(calls: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Calls of a user without a pause of ``gap``, as sessions."""
    rows = calls.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap)).agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
    return rows.select("session_id", F.col("session_window.start").alias("first_call"), F.col("session_window.end").alias("ends"), "calls", "cost")


class BudgetGuard(StatefulProcessor):
    """The running cost of a session or day, and what its budget says after each call. Calls are counted in chunks as they come, in order of time."""

    def __init__(self, budget: float = SESSION_BUDGET) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent double", ttlDurationMs=None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        calls = pd.concat(list(rows)).sort_values(["ts", "call_id"])
        before = self.spent.get()[0] if self.spent.exists() else 0.0
        total = before + calls["cost"].astype(float).cumsum()
        self.spent.update((float(total.iloc[-1]),))
        ratio = total / self.budget if self.budget > 0 else total * 0
        action = ratio.map(lambda r: "reject" if r >= 1 - 1e-12 else "cache_only" if r >= CACHE_ONLY else "warn" if r >= WARN else "ok")
        yield pd.DataFrame({"key": [str(key[0])] * len(calls), "call_id": calls["call_id"], "action": action})

    def close(self) -> None:
        pass


def live_budget(calls: DataFrame, budget: float = SESSION_BUDGET, day_budget: float | None = None) -> DataFrame:
    """(session_id, call_id, action) as calls arrive; needs the RocksDB state store. With ``day_budget``: (day, call_id, action) by the budget of its day.

    A stream keeps state by one key, so a call that both budgets bind is asked of both streams, and the stricter action holds (see stricter)."""
    schema = "key string, call_id long, action string"
    if day_budget is None:
        rows = calls.groupBy("session_id").transformWithStateInPandas(BudgetGuard(budget), schema, "append", "none")
        return rows.select(F.col("key").cast("long").alias("session_id"), "call_id", "action")
    daily = calls.withColumn("day", F.to_date("ts").cast("string")).groupBy("day")
    return daily.transformWithStateInPandas(BudgetGuard(day_budget), schema, "append", "none").select(F.col("key").cast("date").alias("day"), "call_id", "action")


def budget_ledger(calls: DataFrame, path: str, checkpoint: str, day_budget: float = DAY_BUDGET, session_budget: float = SESSION_BUDGET, late: str = "1 day", idle: str = "30 days") -> StreamingQuery:
    """(call_id, action) under ``path``/actions, by the budgets of a call's day and session together, as usage.budget_actions has it.

    Calls count in order of their batch, then of time. One that comes more than ``late`` behind the greatest time of earlier batches isn't counted and its action is "late". Between batches only what each day
    and session has spent is kept, as a table: a day until it can get no more calls, a session until ``idle`` after its last. Sums run over time slots, so no task holds a
    day or a session. A batch that runs again writes the same files, and what it adds to the ledger is committed once."""

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        ledger = Manifest(spark, f"{path}/ledger")
        number, held = ledger.latest()
        if held.get("epoch", -1) >= epoch:
            return
        micros = lambda span: int(spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {span})").first()[0])
        spec = "kind string, key string, spent decimal(38,6), last timestamp"
        before = spark.read.schema(spec).parquet(f"{path}/ledger/{held['folder']}") if held else spark.createDataFrame([], spec)
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        floor = F.lit(held["upto"] - micros(late)) if held.get("upto") is not None else F.lit(None).cast("long")
        rows = rows.withColumn("_late", F.coalesce(at < floor, F.lit(False))).withColumns({"_day": F.to_date("ts").cast("string"), "_session": F.col("session_id").cast("string")}).persist()
        try:
            good = rows.filter("not _late")
            of = lambda kind: before.filter(F.col("kind") == kind).select(F.col("key").alias(f"_{kind}"), F.col("spent").alias(f"_had_{kind}"))
            sums = running_sum(running_sum(good, "cost", "_d", "_day"), "cost", "_s", "_session")
            sums = sums.join(of("day"), "_day", "left").join(of("session"), "_session", "left")
            share = lambda had, now, budget: (F.coalesce(had, F.lit(0)) + now).cast("double") / budget if budget > 0 else F.lit(0.0)
            ratio = F.greatest(share(F.col("_had_day"), F.col("_d"), day_budget), share(F.col("_had_session"), F.col("_s"), session_budget))
            out = sums.select("call_id", action(ratio).alias("action")).unionByName(rows.filter("_late").select("call_id", F.lit("late").alias("action")))
            out.write.mode("overwrite").parquet(f"{path}/actions/batch={epoch}")
            upto = max((x for x in (held.get("upto"), rows.agg(F.max(at)).first()[0]) if x is not None), default=None)
            added = [good.groupBy(F.lit(k).alias("kind"), F.col(f"_{k}").alias("key")).agg(F.sum("cost").cast("decimal(38,6)").alias("spent"), F.max(F.col("ts").cast("timestamp")).alias("last")) for k in ("day", "session")]
            after = before.unionByName(added[0]).unionByName(added[1]).groupBy("kind", "key").agg(F.sum("spent").cast("decimal(38,6)").alias("spent"), F.max("last").alias("last"))
            if upto is not None:
                day_ends = F.unix_micros((F.to_date("key") + F.expr("INTERVAL 1 DAY")).cast("timestamp"))
                ends = F.when(F.col("kind") == "day", day_ends + micros(late)).otherwise(F.unix_micros("last") + micros(idle))
                after = after.filter(ends > upto)
            folder = f"s-{epoch:08d}-{uuid.uuid4().hex[:12]}"
            after.write.parquet(f"{path}/ledger/{folder}")
            ledger.commit(number + 1, {"epoch": epoch, "upto": upto, "folder": folder})
        finally:
            rows.unpersist()

    return calls.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stricter(one: DataFrame, other: DataFrame) -> DataFrame:
    """(call_id, action): of two drained tables of actions the stricter of each call."""
    rank = F.array_position(F.array(*map(F.lit, ("ok", "warn", "cache_only", "reject"))), F.col("action"))
    both = one.select("call_id", "action").unionByName(other.select("call_id", "action"))
    return both.groupBy("call_id").agg(F.max_by("action", rank).alias("action"))


def once_within(uploads: DataFrame, horizon: str = "1 hour", *key: str) -> DataFrame:
    """The first upload of each key within a horizon."""
    return uploads.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(list(key))


class History(StatefulProcessor):
    """A session's last messages, given out with each new one."""

    def __init__(self, n: int = 8, chars: int = 2000) -> None:
        self.n, self.chars = n, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "line string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [x[0] for x in self.lines.get()]
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            out.append((key[0], row.seq, "\n".join(held[-self.n :])))
            held.append(f"{row.role}: {(row.content or '')[: self.chars]}")
        self.lines.put([(x,) for x in held[-self.n :]])
        yield pd.DataFrame(out, columns=["session_id", "seq", "history"])

    def close(self) -> None:
        pass


def live_history(messages: DataFrame, n: int = 8, chars: int = 2000) -> DataFrame:
    """(session_id, seq, history) as messages arrive in order."""
    return messages.groupBy("session_id").transformWithStateInPandas(History(n, chars), "session_id long, seq long, history string", "append", "none")


def answer_stream(questions: DataFrame, index: SegmentedIndex, search: Callable[[SearchIndex, DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Search each batch of questions over the index as it stands when the batch begins, into ``path``/batch=...

    The version is written down before the batch is searched, so one that runs again answers over the same version and replaces its own files, whatever was ingested in
    between."""

    def batch(rows: DataFrame, epoch: int) -> None:
        pins = Manifest(rows.sparkSession, f"{path}-versions")
        number, _ = pins.latest()
        if number <= epoch:
            pins.commit(epoch + 1, {"version": index.manifest.latest()[0]})
        search(index.open(pins.at(epoch + 1)["version"]), rows).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(events: DataFrame, *columns: str) -> DataFrame:
    """The current state of each task, in update mode."""
    return events.groupBy("task_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("s")).select("task_id", "s.*")


def replayed(parts: list[DataFrame], path: str, run: Callable[[DataFrame], None]) -> None:
    """Feed ``parts`` to a stream one after another, as they would arrive: each is added to ``path`` and ``run`` drains the stream over it, going on from its checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(path)
        run(part.sparkSession.readStream.schema(part.schema).parquet(path))


def drained(spark: SparkSession, frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now and read back what it wrote."""
    schema: StructType = frame.schema
    if mode == "append":
        frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(schema).parquet(path)

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    frame.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
