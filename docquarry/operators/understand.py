"""What a query asks for, as columns: intents, slots, entities, strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.retrieve import COMPARING, containing

#: Passages kept, re-ranking, and search mode of each intent.
STRATEGIES = [
    ("factual", 8, False, "light"),
    ("analytical", 12, True, "full"),
    ("comparative", 15, True, "full"),
    ("summary", 10, True, "light"),
    ("computational", 8, False, "skip"),
]


def intents(queries: DataFrame, rules: DataFrame, default: str = "factual", confidence: float = 0.8) -> DataFrame:
    """``queries`` with (intent, confidence): the first rule (prio, intent, keyword) whose keyword the text contains."""
    low = queries.select("query_id", F.lower("text").alias("low"))
    rows = containing(low, "low", rules, "keyword", "query_id").groupBy("query_id").agg(F.min_by("intent", "prio").alias("intent"))
    out = queries.join(rows, "query_id", "left")
    return out.withColumn("confidence", F.when(F.col("intent").isNotNull(), F.lit(confidence))).withColumn("intent", F.coalesce("intent", F.lit(default)))


#: The classes of the rule router in their order, each with its pattern; several entities stand third.
ROUTES = [
    ("comparative", COMPARING),
    ("computational", r"计算|增长率|同比|环比|复合|比率|占比|平均|合计|\bcalculate\b|\bratio\b|\bgrowth\b"),
    ("multi_entity", None),
    ("theme", r"观点|主题|趋势|看法|展望|\bviews?\b|\boutlook\b"),
    ("summarization", r"总结|概括|摘要|综述|概述|\bsummar"),
    ("factual", r"多少|是什么|什么时候|哪一年|谁|\bhow much\b|\bwhat is\b|\bwhen\b|\bwho\b"),
]


def routes(queries: DataFrame, rules: list[tuple[str, str | None]] | None = None, confidence: float = 0.8, default: str = "none") -> DataFrame:
    """(query_id, intent, confidence): the first rule, in order, whose pattern the lower-cased text has; a rule without a pattern asks for two
    ``entities`` or more. Where none holds the intent is ``default`` without a confidence."""
    intent = F.lit(None).cast("string")
    for name, pattern in reversed(rules or ROUTES):
        holds = F.size("entities") >= 2 if pattern is None else F.lower(F.coalesce("text", F.lit(""))).rlike(pattern)
        intent = F.when(holds, F.lit(name)).otherwise(intent)
    return queries.select("query_id", F.coalesce(intent, F.lit(default)).alias("intent"), F.when(intent.isNotNull(), F.lit(confidence)).alias("confidence"))


def branch(intent: Column, n_entities: Column, light: Column) -> Column:
    """The answer branch a query takes: comparisons and several entities fan out, themes and summaries gather, sums compute, the rest is looked up."""
    return (
        F.when(intent == "computational", "compute").when((intent == "comparative") | (n_entities >= 2), "fan_out").when(intent.isin("theme", "summarization", "summary"), "gather")
        .when(light, "light").otherwise("search")
    )


def filtered_by_slots(hits: DataFrame, slots: DataFrame, **columns: str) -> DataFrame:
    """``hits`` that agree with what their query names: ``company="company"`` compares a hit's company with the query's, a slot that is null binds nothing."""
    rows = hits.join(slots.select("query_id", *(F.col(c).alias(f"_{n}") for n, c in columns.items())), "query_id")
    for name in columns:
        rows = rows.filter(F.col(f"_{name}").isNull() | (F.col(f"_{name}") == F.col(name)))
    return rows.drop(*(f"_{n}" for n in columns))


def entities(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, entities, multi): all names that a query's text contains, in order; two or more make it multi-entity."""
    found = containing(queries.select("query_id", "text"), "text", names.select("name"), "name", "query_id")
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    out = queries.select("query_id").join(rows, "query_id", "left")
    held = F.coalesce("entities", F.array().cast("array<string>"))
    return out.select("query_id", held.alias("entities"), (F.size(held) >= 2).alias("multi"))


def longest_entity(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name): by tier (full name before alias before short form), then the longest, then by name."""
    rows = containing(texts.select("query_id", "text"), "text", names, "alias", "query_id")
    order = Window.partitionBy("query_id").orderBy("tier", F.length("alias").desc(), "alias", "name")
    return rows.withColumn("place", F.row_number().over(order)).filter("place = 1").select("query_id", "name")


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(20\d{2})", 1), F.lit(""))


def strip_entities(queries: DataFrame, words: list[str], least: int = 4) -> DataFrame:
    """(query_id, entity, text): for each of a query's entities its text without the others and without comparing words."""
    rows = queries.select("query_id", "text", "entities", F.explode("entities").alias("entity"))
    others = F.filter("entities", lambda e: e != F.col("entity"))
    text = F.aggregate(others, F.col("text"), lambda acc, e: F.replace(acc, e, F.lit("")))
    for word in words:
        text = F.replace(text, F.lit(word), F.lit(""))
    text = F.trim(F.regexp_replace(text, r" +", " "))
    short = F.concat_ws(" ", "entity", F.substring("text", 1, 30))
    return rows.select("query_id", "entity", F.when(F.length(text) < least, short).otherwise(text).alias("text"))


def strategies(queries: DataFrame, table: DataFrame) -> DataFrame:
    """``queries`` (with an intent) and its strategy row."""
    return queries.join(table, "intent", "left")


def light(intent: Column, n_entities: Column, comparing: Column) -> Column:
    """Few passages and no lexical search will do: a factual question about one entity at most."""
    return (intent == "factual") & (n_entities <= 1) & ~comparing


def metric_query(text: Column, words: list[str], trigger: str) -> Column:
    """Whether a query asks for a figure: a metric word together with a trigger."""
    has = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return has & text.rlike(trigger)


#: The figures that a question may name, words that ask for a figure or a table, and questions for one.
FIGURES = [
    "营业收入", "营业成本", "营业利润", "利润总额", "净利润", "归属于母公司所有者的净利润", "归母净利润", "少数股东损益", "综合收益总额", "营业总收入", "营业总成本", "销售费用", "管理费用", "研发费用", "财务费用", "投资收益", "资产减值损失", "信用减值损失", "毛利", "毛利率", "净利率",
    "资产总计", "负债合计", "所有者权益", "流动资产", "非流动资产", "流动负债", "非流动负债", "货币资金", "应收账款", "存货", "固定资产", "无形资产", "短期借款", "长期借款", "应付账款", "股本", "资本公积", "盈余公积", "未分配利润", "资产负债率", "流动比率", "速动比率",
    "经营活动产生的现金流量", "投资活动产生的现金流量", "筹资活动产生的现金流量", "现金及现金等价物净增加额", "ROE", "净资产收益率", "每股收益", "每股净资产", "基本每股收益", "稀释每股收益", "加权平均净资产收益率", "分红", "每股分红", "股息率",
    "营收", "净利", "利润", "收入", "成本", "资产", "负债", "现金流", "收益率", "回报率",
]
FIGURE_WORDS = ["多少", "分别是", "是多少", "数据", "数值", "数字", "表格", "表", "列示", "如下"]
FIGURE_QUESTION = r"(营收|利润|收入|成本|资产|负债|现金流|ROE|收益率|分红)\s*(是|为|有)?\s*(多少|怎样|如何)"


def asks_for_figure(text: Column, figures: list[str] | None = None, asking: list[str] | None = None, pattern: str = FIGURE_QUESTION) -> Column:
    """Whether a question is one for a table: it names a figure, has a word that asks for one, or is of the pattern; any of these will do."""
    words = [*(FIGURES if figures is None else figures), *(FIGURE_WORDS if asking is None else asking)]
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) | text.rlike(pattern)
