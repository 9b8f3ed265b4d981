"""Queries over answers built from orders: each states two figures and cites sources; in a known share a figure is altered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import half_width
from docquarry.operators import verify as V
from docquarry.plans.corpus import documents
from docquarry.plans.registry import query
from docquarry.session import table

PRICE = "CAST(round(o_totalprice) AS BIGINT)"
WRONG = "o_orderkey % 10 = 0"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, answer, price, wrong): one answer for each order; every tenth states another price than its source."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.round("o_totalprice").cast("long").alias("price"), F.pmod("o_orderkey", F.lit(10)).alias("m"), "o_custkey", "o_orderdate")
    stated = F.when(F.col("m") == 0, F.col("price") * 2 + 7).otherwise(F.col("price"))
    text = F.concat(F.lit("收入为"), stated, F.lit("元[来源1]，增长"), F.col("m") + 1, F.lit("%[来源2]。"))
    return rows.withColumn("answer", text)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, idx, text)."""
    rows = answers(spark, sf_dir)
    one = rows.select("query_id", F.lit(1).alias("idx"), F.concat(F.lit("全年收入 "), "price", F.lit(" 元")).alias("text"))
    return one.unionByName(rows.select("query_id", F.lit(2).alias("idx"), F.concat(F.lit("同比增长 "), F.col("m") + 1, F.lit("％")).alias("text")))


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verify(V.cited_pairs(answers(spark, sf_dir)), sources(spark, sf_dir))


STATED = f"""stated AS (SELECT o_orderkey AS query_id, {PRICE} AS price, CASE WHEN {WRONG} THEN {PRICE} * 2 + 7 ELSE {PRICE} END AS stated, o_orderkey % 10 AS m FROM orders)"""
PAIRS = f"""{STATED}, pairs AS (SELECT query_id, CAST(stated AS BIGINT) AS value, '元' AS unit, 1 AS idx, stated = price AS passed FROM stated WHERE true UNION ALL SELECT query_id, m + 1, '%', 2, true FROM stated)"""


@query(f"WITH {PAIRS}, w AS (SELECT query_id, length(CAST(stated AS VARCHAR)) AS n FROM stated) SELECT query_id, value, unit, CASE idx WHEN 1 THEN 3 ELSE n + 12 END AS start FROM pairs JOIN w USING (query_id)")
def answer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.figures(answers(spark, sf_dir)).select("query_id", F.col("value").cast("long").alias("value"), "unit", "start")


@query(f"WITH {PAIRS}, w AS (SELECT query_id, length(CAST(stated AS VARCHAR)) AS n, length(CAST(m + 1 AS VARCHAR)) AS k FROM stated) SELECT query_id, idx, CASE idx WHEN 1 THEN n + 4 ELSE n + k + 13 END AS start, CASE idx WHEN 1 THEN n + 9 ELSE n + k + 18 END AS \"end\" FROM pairs JOIN w USING (query_id)")
def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.source_tags(answers(spark, sf_dir)).select("query_id", "idx", "start", "end")


@query(f"WITH {PAIRS} SELECT query_id, value, unit, idx FROM pairs")
def cited_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.cited_pairs(answers(spark, sf_dir)).select("query_id", F.col("value").cast("long").alias("value"), "unit", "idx")


@query(f"WITH {PAIRS} SELECT query_id, idx, passed FROM pairs")
def verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).select("query_id", "idx", "passed")


@query(f"WITH {PAIRS} SELECT query_id, count(*) AS pairs, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS passed, coalesce(string_agg('来源' || idx || '：' || printf('%.2f', CAST(value AS DOUBLE)) || unit, '；' ORDER BY idx, value) FILTER (NOT passed), '') AS issues FROM pairs GROUP BY query_id")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verdicts(verified(spark, sf_dir), answers(spark, sf_dir)).withColumn("issues", F.array_join("issues", "；"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\s　]+', '', 'g')) AS digest FROM documents")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text comes back from its full-width form, without white space."""
    plain, wide = ("".join(chr(c + d) for c in range(0x21, 0x7F)) for d in (0, 0xFEE0))
    return documents(spark, sf_dir).select("doc_id", F.md5(half_width(F.translate("text", plain, wide))).alias("digest"))


@query(f"WITH {STATED} SELECT query_id, 'money' AS kind, CAST(stated * 10000 AS BIGINT) AS base, CAST(floor(stated * 10000 / 1e7) AS BIGINT) AS bucket FROM stated")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.figures(answers(spark, sf_dir)).filter("unit = '元'").withColumn("unit", F.lit("万元"))
    value, unit = F.col("value"), F.col("unit")
    return rows.select("query_id", V.unit_class(unit).alias("kind"), V.in_base_unit(value, unit).cast("long").alias("base"), V.magnitude(value, unit).alias("bucket"))


@query(f"""
WITH p AS (SELECT o_custkey AS query_id, {PRICE} AS v, CAST(floor({PRICE} / 1e5) AS BIGINT) AS bucket FROM orders WHERE {PRICE} > 0)
SELECT query_id, bucket, count(*) AS n, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high FROM p GROUP BY ALL HAVING count(*) >= 3 AND min(v) > 0 AND (max(v) - min(v)) / min(v) > 0.05""")
def cross_doc_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders stand for an answer's verified values."""
    rows = answers(spark, sf_dir).filter("price > 0").select(F.col("o_custkey").alias("query_id"), F.col("price").cast("double").alias("value"), F.lit("元").alias("unit"), F.lit(True).alias("passed"))
    return V.cross_document(rows, width=1e5).select("query_id", "bucket", "n", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


@query(f"""
WITH m AS (SELECT DISTINCT o_custkey AS query_id, CAST({PRICE} AS DOUBLE) AS a FROM orders), l AS (SELECT *, lead(a) OVER (PARTITION BY query_id ORDER BY a) AS b FROM m), p AS (SELECT * FROM l WHERE b IS NOT NULL AND a <> 0),
both_ AS (SELECT query_id, a, b FROM p UNION ALL SELECT query_id, b, a FROM p), r AS (SELECT DISTINCT o_custkey AS query_id, (o_custkey % 40) / 100.0::DOUBLE AS rate FROM orders),
n AS (SELECT query_id, rate, a, b, abs((b - a) / a - rate) AS off FROM r JOIN both_ USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, rate ORDER BY off, a, b) = 1)
SELECT query_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(off, 6) AS off FROM n WHERE off BETWEEN 0.02 AND 0.10""")
def yoy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are amounts; a rate is made of its key."""
    rows = answers(spark, sf_dir)
    money = rows.select(F.col("o_custkey").alias("query_id"), F.col("price").cast("double").alias("value"), F.lit("元").alias("unit"))
    rates = rows.select(F.col("o_custkey").alias("query_id"), F.pmod("o_custkey", F.lit(40)).cast("double").alias("value"), F.lit("%").alias("unit")).distinct()
    out = V.growth_issues(money.unionByName(rates))
    return out.select("query_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("off", 6).alias("off"))


@query("SELECT o_orderkey, 'c' || o_custkey || ' ' || o_orderpriority || ' annual report ' || o_orderkey AS name FROM orders")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("annual_report_"), "o_orderkey", F.lit("_AP2024"), "o_custkey", F.lit(".md"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.display_name(file, F.concat(F.lit("c"), "o_custkey"), F.col("o_orderpriority")).alias("name"))


@query(f"WITH {STATED} SELECT query_id, CAST(stated AS BIGINT) AS value, '元' AS unit FROM stated WHERE abs(price - stated) > 0.01 * abs(stated) AND NOT contains('全年收入 ' || price || ' 元；同比增长 ' || (m + 1) || '%', stated || '元')")
def guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    context = rows.select("query_id", F.concat(F.lit("全年收入 "), "price", F.lit(" 元；同比增长 "), F.col("m") + 1, F.lit("%")).alias("context"))
    return V.unsupported(rows, context).select("query_id", F.col("value").cast("long").alias("value"), "unit")


@query("""
WITH i AS (SELECT conv_id AS query_id, turn, role || ' ' || length(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT query_id, string_agg(t, '；' ORDER BY k) FILTER (k <= 3) || CASE WHEN max(n) > 3 THEN '…另有' || (max(n) - 3) || '项' ELSE '' END AS footer FROM i GROUP BY query_id""")
def issue_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation stand for the issues of an answer."""
    issues = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.concat("role", F.lit(" "), F.length("text").cast("string")).alias("t"))
    return V.footer(issues, "t")
