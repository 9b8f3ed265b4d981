"""Queries over tables and figures: texts are generated from order tables, so every figure is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import finance as D
from docquarry.plans.corpus import PIPE_TABLES, documents, pipe_tables
from docquarry.plans.registry import query
from docquarry.session import table


def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, cents): one line for each order with its price; the unit depends on the key."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    amount = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    unit = F.element_at(F.array(F.lit("元"), F.lit("万元"), F.lit("亿元")), F.pmod("o_orderkey", F.lit(3)).cast("int") + 1)
    metric = F.element_at(F.array(F.lit("营业收入"), F.lit("净利润")), F.pmod("o_custkey", F.lit(2)).cast("int") + 1)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderdate", metric.alias("m"), amount.alias("a"), unit.alias("u"), cents.alias("cents"))
    return rows.withColumn("text", F.concat("m", F.lit("："), "a", "u"))


METRICS = """
lines AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, ['营业收入', '净利润'][o_custkey % 2 + 1] AS metric, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, [1, 10000, 100000000][o_orderkey % 3 + 1] AS scale FROM orders)"""


@query(f"WITH {METRICS} SELECT id, metric, CAST(round(CAST(cents AS DOUBLE) / 100 * scale, 0) AS BIGINT) AS amount, '元' AS unit, 'high' AS confidence FROM lines")
def metrics_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures come back from text with sign, decimals and unit."""
    rows = D.extract_metrics(metric_lines(spark, sf_dir), "id", "text")
    return rows.select("id", "metric", F.round("value", 0).cast("long").alias("amount"), "unit", "confidence")


@query(f"WITH {METRICS} SELECT id, CAST(round(CAST(cents AS DOUBLE) / 100 * scale, 0) AS BIGINT) AS amount FROM lines")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_lines(spark, sf_dir)
    return rows.select("id", F.round(D.in_base_unit(D.number(F.col("a")), F.col("u")), 0).cast("long").alias("amount"))


@query("""
WITH y AS (SELECT o_custkey, 2020 + (year(o_orderdate) % 10) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(arg_min(y, (n * -1, y)) AS INTEGER) AS year FROM y GROUP BY o_custkey""")
def dominant_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of a customer's orders, written out as a text."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list((F.lit(2020) + F.year("o_orderdate") % 10).cast("string")), "年 ").alias("text"))
    return D.dominant_year(rows, "o_custkey", "text")


@query(f"""
WITH {METRICS} SELECT id, CASE WHEN o_custkey % 3 = 0 THEN 'old' WHEN id % 5 = 0 THEN 'short' ELSE metric END AS metric, CASE WHEN o_custkey % 3 = 0 OR id % 5 = 0 THEN 0 ELSE CAST(round(CAST(cents AS DOUBLE) / 100 * scale, 0) AS BIGINT) END AS amount FROM lines""")
def metric_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have figures, or are short, keep what they had."""
    rows = metric_lines(spark, sf_dir)
    kind = "array<struct<metric:string,value:double,unit:string,raw_text:string,confidence:string>>"
    old = F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.array(F.struct(F.lit("old").alias("metric"), F.lit(0.0).alias("value"), F.lit("").alias("unit"), F.lit("").alias("raw_text"), F.lit("").alias("confidence"))))
    padded = F.when(F.pmod("id", F.lit(5)) == 0, F.col("text")).otherwise(F.rpad("text", 150, "。"))
    chunk = rows.select("id", "text", padded.alias("padded"), old.cast(kind).alias("financial_data"))
    out = D.write_back(chunk.select("id", F.col("padded").alias("text"), "financial_data"), D.extract_metrics(chunk, "id", "text"), "id")
    first = F.get("financial_data", F.lit(0))
    return out.select("id", F.coalesce(first.metric, F.lit("short")).alias("metric"), F.coalesce(F.round(first.value, 0).cast("long"), F.lit(0)).alias("amount"))


@query(f"WITH {METRICS} SELECT count(*) AS chunks, count(*) FILTER (id % 5 <> 0) AS with_metrics, count(*) FILTER (id % 5 <> 0) AS metrics, round(count(*) FILTER (id % 5 <> 0) / count(*), 6) AS mean FROM lines")
def metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metric_lines(spark, sf_dir).withColumn("text", F.when(F.pmod("id", F.lit(5)) == 0, "no figure").otherwise(F.col("text")))
    counts = rows.select("id").join(D.extract_metrics(rows, "id", "text").groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    return counts.agg(
        F.count("*").alias("chunks"), F.count("n").alias("with_metrics"), F.sum(F.coalesce("n", F.lit(0))).alias("metrics"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean")
    )


@query(f"""
WITH {PIPE_TABLES}, n AS (SELECT id, count(*) AS c, string_agg(part || ': ' || quantity, '，' ORDER BY l_linenumber, r) FILTER (k <= 3) AS rows
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_linenumber, r) AS k FROM tab_rows) GROUP BY id)
SELECT id, 'part、quantity、price；' || rows || CASE WHEN c > 3 THEN '…共' || c || '行' ELSE '' END AS summary FROM n""")
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipe_tables(spark, sf_dir).select("id", D.table_summary(F.col("text"), shown=3).alias("summary"))


@query(f"""
WITH {PIPE_TABLES} SELECT 'table' AS kind, count(*) AS n, count(*) AS found FROM tabs
UNION ALL SELECT 'text', count(*), count(*) FILTER (len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|'))) >= 2) FROM documents""")
def has_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipe_tables(spark, sf_dir).select(F.lit("table").alias("kind"), "text").unionByName(documents(spark, sf_dir).select(F.lit("text").alias("kind"), "text"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(D.has_table(F.col("text"))).alias("found"))


@query(f"""
WITH {METRICS}, h AS (SELECT o_custkey AS query_id, id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, id) AS rank FROM lines)
SELECT query_id, metric, CAST(round(CAST(cents AS DOUBLE) / 100 * scale, 0) AS BIGINT) AS amount FROM h JOIN lines USING (id) QUALIFY row_number() OVER (PARTITION BY query_id, metric ORDER BY rank) = 1""")
def hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a query, its orders by date are its hits."""
    rows = metric_lines(spark, sf_dir)
    w = D.Window.partitionBy("o_custkey").orderBy("o_orderdate", "id")
    hits = rows.select(F.col("o_custkey").alias("query_id"), F.col("id").alias("point_id"), F.row_number().over(w).alias("rank"))
    found = D.extract_metrics(rows, "id", "text").select(F.col("id").alias("point_id"), F.lit("c").alias("company"), F.lit("y").alias("year"), "metric", "value")
    return D.hit_metrics(hits, found).select("query_id", "metric", F.round("value", 0).cast("long").alias("amount"))


@query(f"""
WITH {METRICS} SELECT id, '利润表' AS statement_type, metric AS keywords, '[公司=c' || o_custkey || '][章节=s][年份=' || year(o_orderdate) || '][报表=利润表]' AS prefix FROM lines""")
def statement_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of statement of each line of figures, and the prefix that it is encoded behind."""
    rows = metric_lines(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "text", F.lit("s").alias("section"), F.concat(F.lit("c"), "o_custkey").alias("company"), F.year("o_orderdate").cast("string").alias("year"))
    children = rows.withColumn("parent_id", F.col("id"))
    out = D.with_encoding(rows, children)[1]
    prefix = F.substring("encoding_text", F.lit(1), F.length("encoding_text") - F.length("text"))
    return out.select(F.col("id").cast("long").alias("id"), "statement_type", F.array_join("financial_keywords", ",").alias("keywords"), prefix.alias("prefix"))
