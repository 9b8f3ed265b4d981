"""Evaluation: parsing a judge's replies, means by group, retrieval and answer metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import words

SCORES = ("retrieval", "grounding", "answer_relevance", "financial_accuracy")


def judge(items: DataFrame, scorer: Callable[[list[dict]], list[str]]) -> DataFrame:
    """``items`` with the ``reply`` of a caller's judge, called once per batch."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema] + ["reply string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(reply=scorer(rows.to_dict("records")))

    return items.mapInPandas(run, schema)


def parsed_scores(reply: Column) -> list[Column]:
    """The four scores of a reply that holds a JSON object, fenced or not; out of range is clamped to 1 to 5, unreadable is 1."""
    body = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), ", ".join(f"{s} double" for s in SCORES))
    return [F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.round(body[s]).cast("int"), F.lit(1)))).alias(s) for s in SCORES]


def composite() -> Column:
    return sum((F.col(s) for s in SCORES[1:]), F.col(SCORES[0])) / len(SCORES)


def means(results: DataFrame, *by: str) -> DataFrame:
    """Mean of each score and their composite, overall or per group."""
    cells = [F.count("*").alias("n"), *(F.round(F.avg(s), 4).alias(s) for s in SCORES), F.round(F.avg(composite()), 4).alias("composite")]
    return results.groupBy(*by).agg(*cells) if by else results.agg(*cells)


def by_tag(results: DataFrame, tags: str) -> DataFrame:
    """A question counts in each of its tags."""
    return means(results.withColumn("tag", F.explode(tags)), "tag")


def low(results: DataFrame, below: float = 3.0) -> DataFrame:
    return results.withColumn("composite", composite()).filter(F.col("composite") < below)


def block_means(results: DataFrame, order: str, size: int = 10) -> DataFrame:
    """Means of each ``size`` consecutive questions; ``order`` numbers them from 0 without gaps."""
    return means(results.withColumn("block", F.floor(F.col(order) / size)), "block")


def tolerant_means(results: DataFrame, values: list[str], *by: str) -> DataFrame:
    """Means without missing and NaN values, for each grouping column alone and overall."""
    clean = results.withColumns({v: F.nanvl(F.col(v), F.lit(None).cast("double")) for v in values})
    sets = [[], *([F.col(b)] for b in by)]
    return clean.groupingSets(sets, *(F.col(b) for b in by)).agg(F.count("*").alias("n"), *(F.round(F.avg(v), 4).alias(v) for v in values))


def coverage(contexts: DataFrame, answers: DataFrame, group: str, least: int = 50) -> DataFrame:
    """(query_id, contexts, groups, answered): passages and different groups of each answer, and whether it has some length."""
    counts = contexts.groupBy("query_id").agg(F.count("*").alias("contexts"), F.count_distinct(group).alias("groups"))
    rows = answers.join(counts, "query_id", "left")
    return rows.select("query_id", F.coalesce("contexts", F.lit(0)).alias("contexts"), F.coalesce("groups", F.lit(0)).alias("groups"), (F.length("answer") > least).alias("answered"))


def recall_mrr(hits: DataFrame, truth: DataFrame, *on: str) -> DataFrame:
    """(queries, recall, mrr) over the queries that have a true answer."""
    first = hits.join(truth, ["query_id", *on], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"), F.count_distinct(*on).alias("found"))
    wanted = truth.groupBy("query_id").agg(F.count_distinct(*on).alias("wanted"))
    rows = wanted.join(first, "query_id", "left")
    return rows.agg(
        F.count("*").alias("queries"), F.round(F.avg(F.coalesce(F.col("found") / F.col("wanted"), F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )


def token_f1(pairs: DataFrame, answer: str, gold: str) -> DataFrame:
    """``pairs`` with ``f1``, the harmonic mean of precision and recall over words with their repeats, and exact match."""
    a, g = words(F.col(answer)), words(F.col(gold))
    rows = pairs.withColumns({"_a": a, "_g": g})
    count = lambda held, w: F.size(F.filter(held, lambda x: x == w))
    both = F.aggregate(F.array_distinct("_g"), F.lit(0), lambda acc, w: acc + F.least(count("_a", w), count("_g", w)))
    rows = rows.withColumn("_both", both)
    f1 = F.when(F.col("_both") == 0, 0.0).otherwise(2 * F.col("_both") / (F.size("_a") + F.size("_g")))
    return rows.withColumns({"f1": f1, "exact": F.coalesce(F.trim(answer) == F.trim(gold), F.lit(False))}).drop("_a", "_g", "_both")


def number_accuracy(pairs: DataFrame, answer: str, gold: str, tolerance: float = 0.01) -> DataFrame:
    """``pairs`` with ``numbers``: the share of the gold answer's different numbers that the answer states within ``tolerance``; without any it is 1."""
    of = lambda c: F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[-+]?\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull()))
    rows = pairs.withColumns({"_n": of(F.col(gold)), "_m": of(F.col(answer))})
    met = F.size(F.filter("_n", lambda x: F.exists("_m", lambda y: F.abs(y - x) <= tolerance * F.abs(x))))
    return rows.withColumn("numbers", F.when(F.size("_n") == 0, 1.0).otherwise(met / F.size("_n"))).drop("_n", "_m")


def weighted_final(rows: DataFrame, **weights: float) -> DataFrame:
    """``rows`` with ``final``: the weighted mean of the named scores; a missing or NaN score counts as 0."""
    total = sum(weights.values())
    part = [F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)) * w for n, w in weights.items()]
    out = part[0]
    for more in part[1:]:
        out = out + more
    return rows.withColumn("final", F.round(out / total, 6))


def timing(results: DataFrame) -> DataFrame:
    return results.agg(F.round(F.sum("elapsed_sec"), 4).alias("total"), F.round(F.avg("elapsed_sec"), 4).alias("mean"), F.count_if(F.col("error").isNotNull()).alias("errors"))


