"""Usage accounting, budgets, cache effect, and conversations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed prices per million tokens (prompt, completion), also for models without a row of their own.
PRICE_IN, PRICE_OUT = "0.5", "2.0"
#: Fixed budgets and the shares of them from which calls are warned of, served from cache only, or rejected.
DAY_BUDGET, SESSION_BUDGET = 50.0, 5.0
WARN, CACHE_ONLY = 0.8, 0.95


def call_cost(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """``calls`` (model, prompt_tokens, completion_tokens) with an exact ``cost``, to six decimals."""
    rows = calls
    price_in, price_out = (F.lit(p).cast("decimal(12,4)") for p in (PRICE_IN, PRICE_OUT))
    if prices is not None:
        rows = rows.join(prices.select("model", F.col("price_in").cast("decimal(12,4)").alias("_in"), F.col("price_out").cast("decimal(12,4)").alias("_out")), "model", "left")
        price_in, price_out = F.coalesce("_in", price_in), F.coalesce("_out", price_out)
    cost = F.col("prompt_tokens").cast("decimal(18,0)") * price_in + F.col("completion_tokens").cast("decimal(18,0)") * price_out
    return rows.withColumn("cost", F.round(cost / F.lit(1_000_000).cast("decimal(10,0)"), 6).cast("decimal(18,6)")).drop("_in", "_out")


def session_totals(calls: DataFrame) -> DataFrame:
    """Per session: calls, tokens, cost, first and last call."""
    return calls.groupBy("session_id").agg(
        F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("cost").alias("cost"), F.min("ts").alias("first_call"), F.max("ts").alias("last_call"),
    )


def daily_rollup(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost per day, and in a row without a day of all time."""
    return calls.rollup(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.sum("cost").alias("cost"))


def since(daily: DataFrame, days: int, today: Column) -> DataFrame:
    """The days from ``days`` before today on, that day included."""
    return daily.filter(F.col("day") >= F.date_sub(today, days))


def recent_calls(calls: DataFrame, n: int) -> DataFrame:
    """The last n calls."""
    return calls.orderBy(F.col("ts").desc(), F.col("call_id").desc()).limit(n)


def budget_actions(calls: DataFrame, day_budget: float = DAY_BUDGET, session_budget: float = SESSION_BUDGET) -> DataFrame:
    """``calls`` with ``action`` by the share of the day's or session's budget that calls up to and with it use. A budget of 0 or less never binds."""
    share = lambda spent, budget: spent.cast("double") / budget if budget > 0 else F.lit(0.0)
    rows = running_sum(running_sum(calls.withColumn("_day", F.to_date("ts")), "cost", "_spent_day", "_day"), "cost", "_spent", "session_id")
    rows = rows.withColumn("ratio", F.greatest(share(F.col("_spent_day"), day_budget), share(F.col("_spent"), session_budget)))
    return rows.withColumn("action", action(F.col("ratio"))).drop("_day", "_spent_day", "_spent")


def running_sum(rows: DataFrame, value: str, name: str, *by: str, ts: str = "ts", tie: str = "call_id", slot_seconds: int = 60) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``by`` up to and with each, in order of ``ts`` and ``tie``.

    Sums of time slots are summed up first, a row for each slot of a key, and a row adds only what its own slot holds before it. So no task
    sees a whole day or session, however many calls it has."""
    slotted = rows.withColumn("_slot", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (slot_seconds * 1_000_000)).cast("long"))
    slots = slotted.groupBy(*by, "_slot").agg(F.sum(value).alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
    names = {b: f"_by{i}" for i, b in enumerate(by)}
    bases = slots.withColumn("_base", upto).select(*(F.col(b).alias(n) for b, n in names.items()), F.col("_slot").alias("_at"), "_base")
    same = F.col("_slot").eqNullSafe(F.col("_at"))
    for b, n in names.items():
        same = same & F.col(b).eqNullSafe(F.col(n))
    own = F.sum(value).over(Window.partitionBy(*by, "_slot").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0))
    return slotted.withColumn("_own", own).join(bases, same).withColumn(name, F.col("_base") + F.col("_own")).drop("_own", "_base", "_at", "_slot", *names.values())


def action(ratio: Column) -> Column:
    return F.when(ratio >= 1, "reject").when(ratio >= CACHE_ONLY, "cache_only").when(ratio >= WARN, "warn").otherwise("ok")


def with_overrides(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, value): the value set at run time, else the default."""
    return defaults.join(overrides.select("name", F.col("value").alias("_set")), "name", "left").select("name", F.coalesce("_set", "value").alias("value"))


def budget_summary(calls: DataFrame, day_budget: float = DAY_BUDGET) -> DataFrame:
    """What each day spent, what remains, and the share used."""
    rows = calls.groupBy(F.to_date("ts").alias("day")).agg(F.sum("cost").alias("spent"))
    spent = F.col("spent").cast("double")
    return rows.select("day", "spent", F.greatest(F.lit(day_budget) - spent, F.lit(0.0)).alias("remaining"), (spent / day_budget).alias("ratio"))


def repeat_rate(requests: DataFrame, ttl_seconds: int, *key: str) -> DataFrame:
    """(layer, requests, hits, rate): a bound on cache hits, as if each request renewed the entry."""
    w = Window.partitionBy(*key).orderBy("ts", "request_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    rows = requests.withColumn("hit", F.coalesce(gap <= ttl_seconds * 1_000_000, F.lit(False)))
    return _rates(rows)


def cache_hits(requests: DataFrame, ttl_seconds: int, *key: str) -> DataFrame:
    """(layer, requests, hits, rate): what a log says of a cache whose entries live ``ttl_seconds`` from when they were stored; a hit doesn't renew them.

    Requests are dealt out by key and sorted by Spark; a task reads them in order and holds one time at once, however many a key has."""
    names = list(dict.fromkeys(("layer", *key)))
    rows = requests.select(F.struct(*names).alias("k"), "layer", F.unix_micros("ts").alias("t")).select(F.xxhash64("k").alias("h"), F.to_json("k").alias("k"), F.coalesce(F.col("layer").cast("string"), F.lit("")).alias("layer"), "t")
    rows = rows.repartition("h", "k").sortWithinPartitions("h", "k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stored = None, 0
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for k, layer, t in zip(batch["k"].to_pylist(), batch["layer"].to_pylist(), batch["t"].to_pylist(), strict=True):
                count = counts.setdefault(layer, [0, 0])
                count[0] += 1
                if k == last and t is not None and t - stored <= ttl_seconds * 1_000_000:
                    count[1] += 1
                else:
                    last, stored = k, t if t is not None else -(1 << 62)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(2))], names=["layer", "requests", "hits"])

    found = rows.select("k", "layer", "t").mapInArrow(run, "layer string, requests long, hits long").groupBy("layer").agg(F.sum("requests").alias("requests"), F.sum("hits").alias("hits"))
    return found.withColumn("rate", F.round(F.col("hits") / F.col("requests"), 4))


def _rates(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("layer").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))
    return out.withColumn("rate", F.round(F.col("hits") / F.col("requests"), 4))


def conversation_list(messages: DataFrame) -> DataFrame:
    """Per session: messages, first and last place; order by the last for a view."""
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.min("seq").alias("created"), F.max("seq").alias("updated"))


def titles(messages: DataFrame, chars: int = 30) -> DataFrame:
    """(session_id, title): the first user message, cut."""
    first = messages.filter("role = 'user'").groupBy("session_id").agg(F.min_by("content", "seq").alias("c"))
    return first.select("session_id", F.when(F.length("c") > chars, F.concat(F.substring("c", 1, chars), F.lit("..."))).otherwise(F.col("c")).alias("title"))


def history(messages: DataFrame, n: int = 8, chars: int = 2000) -> DataFrame:
    """``messages`` with the ``history`` before each: up to n messages, cut and joined by line ends."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-n, -1)
    line = F.concat("role", F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    return messages.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n"))


def bound_mode(messages: DataFrame) -> DataFrame:
    """``messages`` in the mode of their session's first message."""
    return messages.withColumn("mode", F.first("mode").over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def glossary_lookup(terms: DataFrame, glossary: DataFrame) -> DataFrame:
    """``terms`` with their explanation by trimmed, exact match, and whether one is held."""
    held = glossary.select(F.trim("term").alias("_term"), "explanation").dropDuplicates(["_term"])
    return terms.join(held, F.trim(terms["term"]) == held["_term"], "left").withColumn("cached", F.col("_term").isNotNull()).drop("_term")


def latest_status(events: DataFrame, *columns: str) -> DataFrame:
    """The current state of each task."""
    return events.groupBy("task_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("s")).select("task_id", "s.*")


def overview(calls: DataFrame, hits: DataFrame) -> DataFrame:
    """(name, value): the figures of a dashboard."""
    of = lambda frame, name, value: frame.select(F.lit(name).alias("name"), value.cast("double").alias("value"))
    total = calls.agg(F.count("*").alias("n"), F.sum("cost").alias("c"), F.count_distinct("session_id").alias("s"))
    rate = hits.agg((F.sum("hits") / F.sum("requests")).alias("r"))
    return of(total, "calls", F.col("n")).unionByName(of(total, "cost", F.col("c"))).unionByName(of(total, "sessions", F.col("s"))).unionByName(of(rate, "hit_rate", F.round("r", 4)))
