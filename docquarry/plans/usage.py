"""Queries over usage, conversations and evaluation. Events stand for model calls and requests, conversations for messages, labels for scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import estimated_tokens
from docquarry.operators import evaluate as E
from docquarry.operators import usage as U
from docquarry.operators.retrieve import containing
from docquarry.plans.corpus import documents
from docquarry.plans.registry import query
from docquarry.plans.corpus import words_sql
from docquarry.plans.retrieval import HYBRID, hybrid, queries_of
from docquarry.session import Scratch, table
from docquarry.sources import tables as T

CALLS = """
calls AS (SELECT event_id AS call_id, user_id AS session_id, event_type AS model, ts, CAST(floor(abs(value) * 100) AS BIGINT) AS prompt_tokens, CAST(length(props) * 10 AS BIGINT) AS completion_tokens FROM events),
costed AS (SELECT *, CAST((prompt_tokens * CASE WHEN model = 'click' THEN 40 ELSE 5 END + completion_tokens * CASE WHEN model = 'click' THEN 80 ELSE 20 END + 5) // 10 / 1000000.0 AS DECIMAL(18, 6)) AS cost FROM calls)"""
SPEND = "CAST(sum(cost) AS VARCHAR)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"),
        F.floor(F.abs("value") * 100).cast("long").alias("prompt_tokens"), (F.length("props") * 10).cast("long").alias("completion_tokens"),
    )
    return U.call_cost(rows, spark.createDataFrame([("click", "4", "8")], "model string, price_in string, price_out string"))


@query(f"WITH {CALLS} SELECT call_id, CAST(cost AS VARCHAR) AS cost FROM costed")
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).select("call_id", F.col("cost").cast("string").alias("cost"))


@query(f"WITH {CALLS} SELECT session_id, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, {SPEND} AS cost, epoch_us(min(ts)) AS first_call, epoch_us(max(ts)) AS last_call FROM costed GROUP BY session_id")
def session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.session_totals(calls(spark, sf_dir))
    return rows.select("session_id", "calls", "tokens", F.col("cost").cast("string").alias("cost"), F.unix_micros("first_call").alias("first_call"), F.unix_micros("last_call").alias("last_call"))


@query(f"WITH {CALLS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, {SPEND} AS cost FROM costed GROUP BY ROLLUP (CAST(ts AS DATE))")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.daily_rollup(calls(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "calls", "tokens", F.col("cost").cast("string").alias("cost"))


@query(f"WITH {CALLS} SELECT call_id, session_id FROM costed ORDER BY ts DESC, call_id DESC LIMIT 100")
def recent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the last 100 calls."""
    return U.recent_calls(calls(spark, sf_dir), 100).select("call_id", "session_id")


@query("SELECT doc_id, greatest(length(text) // 2, 100) AS half, length(text) // 4 AS quarter FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", estimated_tokens(F.col("text"), 2, 100).alias("half"), estimated_tokens(F.col("text"), 4).alias("quarter"))


@query(f"""
WITH {CALLS}, r AS (SELECT call_id, greatest(CAST(sum(cost) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 2.0, CAST(sum(cost) OVER (PARTITION BY session_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 0.1) AS ratio FROM costed)
SELECT call_id, CASE WHEN ratio >= 1 THEN 'reject' WHEN ratio >= 0.95 THEN 'cache_only' WHEN ratio >= 0.8 THEN 'warn' ELSE 'ok' END AS action FROM r""")
def budget_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.budget_actions(calls(spark, sf_dir), 2.0, 0.1).select("call_id", "action")


@query(f"WITH {CALLS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {SPEND} AS spent, round(greatest(2.0 - CAST(sum(cost) AS DOUBLE), 0), 6) AS remaining, round(CAST(sum(cost) AS DOUBLE) / 2.0, 7) AS ratio FROM costed GROUP BY CAST(ts AS DATE)")
def budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.budget_summary(calls(spark, sf_dir), 2.0)
    return rows.select(F.col("day").cast("string").alias("day"), F.col("spent").cast("string").alias("spent"), F.round("remaining", 6).alias("remaining"), F.round("ratio", 7).alias("ratio"))


@query("""
WITH g AS (SELECT event_type AS layer, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT layer, count(*) AS requests, count(*) FILTER (gap <= 86400000000) AS hits, round(count(*) FILTER (gap <= 86400000000) / count(*), 4) AS rate FROM g GROUP BY layer""")
def ttl_repeat_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "user_id", F.col("event_type").alias("layer"), F.col("ts").cast("timestamp").alias("ts"))
    return U.repeat_rate(rows, 86_400, "user_id", "layer")


@query("SELECT user_id AS session_id, event_type AS status, event_id AS version FROM events WHERE event_id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three batches as versions of a session's record, appended and read back."""
    rows = table(spark, sf_dir, "events").filter("event_id % 11 <> 0").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("status"), F.col("event_id").alias("version"))
    path = f"{Scratch(spark, 'state').path}/records"
    for part in range(3):
        T.append_state(rows.filter(F.pmod("version", F.lit(3)) == part), path)
    return T.current_state(spark, path, "session_id", "version")


TTL = """
e AS (SELECT user_id, event_type AS layer, epoch_us(ts) AS t FROM events),
st AS (SELECT user_id, layer, min(t) AS t FROM e GROUP BY ALL UNION ALL SELECT user_id, layer, t FROM (SELECT s.user_id, s.layer, min(e.t) AS t FROM st s JOIN e ON e.user_id = s.user_id AND e.layer = s.layer AND e.t > s.t + 86400000000 GROUP BY s.user_id, s.layer) n),
hits AS (SELECT layer, count(*) AS requests, count(*) - (SELECT count(*) FROM st WHERE st.layer = e.layer) AS hits FROM e GROUP BY layer)"""


@query(f"WITH RECURSIVE {TTL} SELECT layer, requests, hits, round(hits / requests, 4) AS rate FROM hits")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact fold of each key's request times."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("layer"), F.col("ts").cast("timestamp").alias("ts"))
    return U.cache_hits(rows, 86_400, "user_id", "layer")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("turn") % 2 == 0, "pro").otherwise("safe")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), mode.alias("mode"))


@query("SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS value FROM supplier")
def overridden_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting for each supplier, some of which were set anew at run time."""
    rows = table(spark, sf_dir, "supplier")
    again = rows.filter("s_suppkey % 4 = 0").select(F.col("s_name").alias("name"), (F.col("s_acctbal") + 1).alias("value"))
    return U.with_overrides(rows.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("value")), again)


@query("SELECT conv_id AS session_id, count(*) AS messages, min(turn) AS created, max(turn) AS updated FROM conversations GROUP BY conv_id")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.conversation_list(messages(spark, sf_dir))


@query("SELECT conv_id AS session_id, CASE WHEN length(arg_min(text, turn)) > 30 THEN substr(arg_min(text, turn), 1, 30) || '...' ELSE arg_min(text, turn) END AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.titles(messages(spark, sf_dir))


@query("SELECT conv_id AS session_id, turn AS seq, md5(coalesce(string_agg(role || ': ' || substr(text, 1, 2000), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), '')) AS digest FROM conversations")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.history(messages(spark, sf_dir)).select("session_id", "seq", F.md5("history").alias("digest"))


@query("SELECT conv_id AS session_id, turn AS seq, first_value(CASE WHEN turn % 2 = 0 THEN 'pro' ELSE 'safe' END) OVER (PARTITION BY conv_id ORDER BY turn) AS mode FROM conversations")
def mode_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.bound_mode(messages(spark, sf_dir)).select("session_id", "seq", "mode")


@query("SELECT p_partkey, o.o_orderpriority AS explanation, o.o_orderpriority IS NOT NULL AS cached FROM part LEFT JOIN orders o ON o.o_orderkey = p_partkey")
def glossary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by number stand for terms, orders for the glossary."""
    terms = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_partkey").alias("term"))
    glossary = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("term"), F.col("o_orderpriority").alias("explanation"))
    return U.glossary_lookup(terms, glossary).select("p_partkey", "explanation", "cached")


@query("SELECT user_id AS task_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), "event_id", "ts")
    return U.latest_status(rows, "status", "event_id")


@query(f"""
WITH RECURSIVE {CALLS}, {TTL}, f AS (SELECT count(*) AS n, CAST(sum(cost) AS DOUBLE) AS c, count(DISTINCT session_id) AS s FROM costed)
SELECT 'calls' AS name, CAST(n AS DOUBLE) AS value FROM f UNION ALL SELECT 'cost', c FROM f UNION ALL SELECT 'sessions', CAST(s AS DOUBLE) FROM f UNION ALL SELECT 'hit_rate', round(CAST(sum(hits) AS DOUBLE) / sum(requests), 4) FROM hits""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.overview(calls(spark, sf_dir), cache_hits(spark, sf_dir))


RESULTS = """
results AS (SELECT doc_id AS id, lang AS doc_type, source, 1 + (length(text) % 5) AS retrieval, 1 + quality * 4 AS grounding, 5 - toxic * 3 AS answer_relevance, 1 + (doc_id % 5) AS financial_accuracy, length(text) / 100.0::DOUBLE AS elapsed_sec,
  CASE WHEN quality = 0 THEN NULL ELSE (doc_id % 7) / 7.0::DOUBLE END AS faithfulness FROM documents JOIN labels USING (doc_id)),
scored AS (SELECT *, (retrieval + grounding + answer_relevance + financial_accuracy) / 4 AS c FROM results)"""
_MEANS = "count(*) AS n, round(avg(retrieval), 4) AS retrieval, round(avg(grounding), 4) AS grounding, round(avg(answer_relevance), 4) AS answer_relevance, round(avg(financial_accuracy), 4) AS financial_accuracy, round(avg(c), 4) AS composite"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's reply for each labelled document, as fenced JSON made of its labels."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    part = {"retrieval": 1 + F.length("text") % 5, "grounding": 1 + F.col("quality") * 4, "answer_relevance": 5 - F.col("toxic") * 3, "financial_accuracy": 1 + F.col("doc_id") % 5}
    body = F.to_json(F.struct(*(v.alias(k) for k, v in part.items())))
    missing = F.when(F.col("quality") == 0, float("nan")).otherwise(F.col("doc_id") % 7 / 7.0)
    return rows.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("doc_type"), "source", F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")).alias("reply"), (F.length("text") / 100.0).alias("elapsed_sec"), missing.alias("faithfulness")
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replies(spark, sf_dir)
    return rows.select("id", "doc_type", "source", "elapsed_sec", "faithfulness", *E.parsed_scores(F.col("reply")))


@query(f"WITH {RESULTS} SELECT id, CAST(retrieval AS INTEGER) AS retrieval, CAST(grounding AS INTEGER) AS grounding, CAST(answer_relevance AS INTEGER) AS answer_relevance, CAST(financial_accuracy AS INTEGER) AS financial_accuracy FROM results")
def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("id", *E.SCORES)


@query(f"WITH {RESULTS} SELECT {_MEANS} FROM scored")
def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.means(results(spark, sf_dir))


@query(f"WITH {RESULTS} SELECT doc_type, {_MEANS} FROM scored GROUP BY doc_type")
def eval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.means(results(spark, sf_dir), "doc_type")


@query(f"WITH {RESULTS}, t AS (SELECT *, unnest([doc_type, source]) AS tag FROM scored) SELECT tag, {_MEANS} FROM t GROUP BY tag")
def eval_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_tag(results(spark, sf_dir).withColumn("tags", F.array("doc_type", "source")), "tags")


@query(f"WITH {RESULTS} SELECT id, c AS composite FROM scored WHERE c < 3")
def eval_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.low(results(spark, sf_dir)).select("id", "composite")


@query(f"WITH {RESULTS} SELECT id // 100 AS block, {_MEANS} FROM scored GROUP BY id // 100")
def eval_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.block_means(results(spark, sf_dir), "id", 100)


@query(f"WITH {RESULTS} SELECT doc_type, source, count(*) AS n, round(avg(faithfulness), 4) AS faithfulness, round(avg(elapsed_sec), 4) AS elapsed_sec FROM results GROUP BY GROUPING SETS ((), (doc_type), (source))")
def eval_nan_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.tolerant_means(results(spark, sf_dir), ["faithfulness", "elapsed_sec"], "doc_type", "source")


@query(f"WITH {RESULTS} SELECT round(sum(elapsed_sec), 4) AS total, round(avg(elapsed_sec), 4) AS mean, count(*) FILTER (grounding = 1) AS errors FROM results")
def eval_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.timing(results(spark, sf_dir).withColumn("error", F.when(F.col("grounding") == 1, "failed")))


@query(f"WITH {HYBRID} SELECT q.query_id, count(f.point_id) AS contexts, count(DISTINCT f.company) AS groups, length(any_value(q.text)) > 50 AS answered FROM base q LEFT JOIN final f USING (query_id) GROUP BY q.query_id")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(hybrid(spark, sf_dir), queries_of(spark, sf_dir).withColumnRenamed("text", "answer"), "company")


@query(f"""
WITH {HYBRID}, truth AS (SELECT query_id, d.doc_id FROM base q JOIN documents d ON contains(d.text, substr(q.text, 1, 60))), w AS (SELECT query_id, count(DISTINCT doc_id) AS wanted FROM truth GROUP BY query_id),
f AS (SELECT query_id, min(rank) AS first, count(DISTINCT doc_id) AS found FROM final SEMI JOIN truth USING (query_id, doc_id) GROUP BY query_id)
SELECT count(*) AS queries, round(avg(coalesce(found / wanted, 0)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM w LEFT JOIN f USING (query_id)""")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document that contains a query's opening is a true answer."""
    asked = queries_of(spark, sf_dir).select("query_id", F.substring("text", 1, 60).alias("opening"))
    truth = containing(documents(spark, sf_dir).select("doc_id", "text"), "text", asked, "opening", "doc_id").select("query_id", "doc_id")
    return E.recall_mrr(hybrid(spark, sf_dir), truth, "doc_id")


@query(f"""
WITH {HYBRID}, p AS (SELECT query_id, q.text AS gold, f.text AS answer FROM final f JOIN base q USING (query_id) WHERE rank = 1),
t AS (SELECT query_id, gold, answer, {words_sql('gold')} AS g, {words_sql('answer')} AS a FROM p),
gc AS (SELECT query_id, w, count(*) AS n FROM (SELECT query_id, unnest(g) AS w FROM t) GROUP BY ALL), ac AS (SELECT query_id, w, count(*) AS n FROM (SELECT query_id, unnest(a) AS w FROM t) GROUP BY ALL),
b AS (SELECT query_id, sum(least(gc.n, ac.n)) AS n FROM gc JOIN ac USING (query_id, w) GROUP BY query_id)
SELECT query_id, round(2 * coalesce(b.n, 0) / (len(a) + len(g)), 6) AS f1, trim(answer) = trim(gold) AS exact FROM t LEFT JOIN b USING (query_id)""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passage of each query stands for its answer."""
    best = hybrid(spark, sf_dir).filter("rank = 1").select("query_id", F.col("text").alias("answer")).join(queries_of(spark, sf_dir).withColumnRenamed("text", "gold"), "query_id")
    return E.token_f1(best, "answer", "gold").select("query_id", F.round("f1", 6).alias("f1"), "exact")


@query("""
WITH p AS (SELECT o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS v, o_orderkey % 4 AS m FROM orders)
SELECT id, CASE m WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS numbers, round((2 * CASE m WHEN 0 THEN 0.5 ELSE 1.0 END + m / 4.0) / 3, 6)::DOUBLE AS final FROM p""")
def number_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold answer states an order's price and 12.5 %; every fourth answer states another price."""
    price, m = F.round("o_totalprice").cast("long"), F.pmod("o_orderkey", F.lit(4))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (m / 4.0).alias("style"), F.concat(F.lit("price "), price, F.lit(" up 12.5%")).alias("gold"), F.concat(F.lit("up 12.5% to "), F.when(m == 0, price * 3 + 90).otherwise(price)).alias("answer"),
    )
    return E.weighted_final(E.number_accuracy(rows, "answer", "gold"), numbers=2.0, style=1.0).select("id", "numbers", "final")
