"""Tables and figures in text: units, metrics, table summaries and sentences. Vocabularies are the caller's; the defaults are small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed scales of money units in 元; other units keep their value.
UNITS = [("万亿元", 1e12), ("亿元", 1e8), ("万元", 1e4), ("元", 1.0), ("万亿", 1e12), ("亿", 1e8), ("万", 1e4)]
KEPT_UNITS = ["%", "倍", "元/股"]
UNIT = r"(万亿元|亿元|万元|元/股|元|万亿|亿|万|%|倍)?"
NUMBER = r"([-+]?\d[\d,]*(?:\.\d+)?)"
DEFAULT_METRICS = ["营业收入", "净利润", "总资产", "每股收益", "毛利率"]


def number(text: Column) -> Column:
    """A number with its sign and all decimals; thousands commas go."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def in_base_unit(value: Column, unit: Column) -> Column:
    """Money in 元; percentages, multiples and amounts per share as they are."""
    out = value
    for name, scale in UNITS:
        out = F.when(unit == name, value * scale).otherwise(out)
    return out


def base_unit(unit: Column) -> Column:
    return F.when(unit.isin([n for n, _ in UNITS]), "元").otherwise(unit)


def extract_metrics(rows: DataFrame, key: str, text: str, metrics: list[str] | None = None, enough: int = 5, gap: int = 30, most: int | None = 50) -> DataFrame:
    """(key, metric, value, unit, raw_text, confidence): metric, separator, number, unit in a line (high); documents with fewer than ``enough``
    of those also by up to ``gap`` characters between (medium). One row for each (metric, value), in reading order; figures beyond ``most`` of a
    document are dropped (None keeps all)."""
    names = "|".join(metrics or DEFAULT_METRICS)
    strict, loose = rf"({names})\s*[:：为是]\s*{NUMBER}\s*{UNIT}", rf"({names})[^\d\n]{{0,{gap}}}?{NUMBER}\s*{UNIT}"

    def found(pattern: str, confidence: str) -> DataFrame:
        hits = rows.select(key, F.posexplode_outer(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))).alias("place", "raw_text")).filter("raw_text is not null")
        part = lambda i: F.regexp_extract("raw_text", pattern, i)
        return hits.select(key, "place", part(1).alias("metric"), number(part(2)).alias("n"), part(3).alias("u"), "raw_text", F.lit(confidence).alias("confidence"))

    high = found(strict, "high")
    done = high.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= enough).select(key)
    both = high.unionByName(found(loose, "medium").join(done, key, "left_anti"))
    both = both.withColumns({"value": in_base_unit(F.col("n"), F.col("u")), "unit": base_unit(F.col("u"))}).filter("value is not null")
    order = (F.col("confidence"), F.col("place"))
    once = Window.partitionBy(key, "metric", F.round("value", 2)).orderBy(*order)
    rows = both.withColumn("k", F.row_number().over(once)).filter("k = 1")
    if most is not None:
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("k") <= most)
    return rows.select(key, "metric", "value", "unit", "raw_text", "confidence")


def dominant_year(rows: DataFrame, key: str, text: str, first: int = 2020, last: int = 2030) -> DataFrame:
    """(key, year): the most frequent year in range, the earlier on ties."""
    years = rows.select(key, F.explode_outer(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(20\d{2})"), F.lit(1))).alias("year")).withColumn("year", F.col("year").cast("int"))
    counts = years.filter(F.col("year").between(first, last)).groupBy(key, "year").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "year")
    return counts.withColumn("k", F.row_number().over(w)).filter("k = 1").select(key, "year")


def write_back(chunks: DataFrame, metrics: DataFrame, key: str, force: bool = False, least: int = 100) -> DataFrame:
    """``chunks`` with ``financial_data`` of their own metrics; those that have some (unless forced) or are short keep what they had."""
    item = F.struct("metric", "value", "unit", "raw_text", "confidence")
    new = metrics.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_new"))
    wanted = (F.length("text") >= least) & (F.lit(force) | F.col("financial_data").isNull() | (F.size("financial_data") == 0))
    rows = chunks.join(new, key, "left")
    return rows.withColumn("financial_data", F.when(wanted, F.coalesce("_new", "financial_data")).otherwise(F.col("financial_data"))).drop("_new")


def table_rows(text: Column) -> Column:
    """Cells of a pipe table's rows, without rules (``|---|``)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^[|\s:-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c)))


def table_summary(text: Column, columns: int = 4, shown: int = 8) -> Column:
    """Header, then ``name: first figure`` of the first rows, then how many rows there are."""
    rows = table_rows(text)
    body = F.slice(rows, 2, 1_000_000)
    head = F.array_join(F.slice(F.get(rows, F.lit(0)), 1, columns), "、")
    figure = lambda r: F.coalesce(F.get(F.filter(F.slice(r, 2, 1_000_000), lambda c: c.rlike(r"\d")), F.lit(0)), F.lit(""))
    named = F.transform(F.slice(body, 1, shown), lambda r: F.concat(F.get(r, F.lit(0)), F.lit(": "), figure(r)))
    count = F.size(body)
    return F.concat(head, F.lit("；"), F.array_join(named, "，"), F.when(count > shown, F.concat(F.lit("…共"), count.cast("string"), F.lit("行"))).otherwise(""))


def table_sentence(text: Column, statement: Column, company: Column, year: Column, full: int = 15, shown: int = 8, cut: int = 2000) -> Column:
    """A table as a sentence: each row's name and its values by column header."""
    rows = table_rows(text)
    head, body = F.get(rows, F.lit(0)), F.slice(rows, 2, 1_000_000)
    told = lambda r: F.concat(F.get(r, F.lit(0)), F.lit(" "), F.array_join(F.transform(F.slice(r, 2, 1_000_000), lambda c, i: F.concat(F.get(head, i + 1), F.lit(": "), c)), ","))
    some = F.when(F.size(body) <= full, body).otherwise(F.slice(body, 1, shown))
    more = F.when(F.size(body) > full, F.concat(F.lit("；共"), F.size(body).cast("string"), F.lit("行"))).otherwise("")
    return F.substring(F.concat(F.concat_ws(" ", company, year, statement), F.lit("："), F.array_join(F.transform(some, told), "；"), more), F.lit(1), F.lit(cut))


def has_table(text: Column) -> Column:
    """Two pipe lines, or one in a text of three lines at most, or two lines of aligned parts with figures."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    pipes = F.size(F.filter(lines, lambda x: x.startswith("|")))
    aligned = F.size(F.filter(lines, lambda x: (F.size(F.split(F.trim(x), r"\s{2,}")) >= 3) & x.rlike("[一-鿿]") & x.rlike(r"\d[\d,.]*\s+.*\d")))
    return (pipes >= 2) | ((pipes >= 1) & (F.size(lines) <= 3)) | (aligned >= 2)


#: Titles of statements, and the words of each kind of statement.
STATEMENT_TITLES = ["合并利润表", "母公司利润表", "合并资产负债表", "母公司资产负债表", "合并现金流量表", "母公司现金流量表", "合并股东权益变动表", "母公司股东权益变动表"]
KEYWORD_GROUPS = [
    ("利润表", ["营业收入", "营业成本", "营业利润", "利润总额", "净利润", "归属于母公司所有者的净利润", "归母净利润", "少数股东损益", "综合收益总额", "营业总收入", "营业总成本", "销售费用", "管理费用", "研发费用", "财务费用", "投资收益", "资产减值损失", "信用减值损失"]),
    ("资产负债表", ["资产总计", "负债合计", "所有者权益", "流动资产", "非流动资产", "流动负债", "非流动负债", "货币资金", "应收账款", "存货", "固定资产", "无形资产", "短期借款", "长期借款", "应付账款", "股本", "资本公积", "盈余公积", "未分配利润"]),
    ("现金流量表", ["经营活动产生的现金流量", "投资活动产生的现金流量", "筹资活动产生的现金流量", "现金及现金等价物净增加额", "销售商品、提供劳务收到的现金"]),
    ("财务指标", ["毛利率", "净利率", "ROE", "净资产收益率", "资产负债率", "流动比率", "速动比率", "每股收益", "每股净资产", "基本每股收益", "稀释每股收益", "加权平均净资产收益率"]),
]


def detect_statement(text: Column, titles: list[str] | None = None, groups: list[tuple[str, list[str]]] | None = None, first: int = 8) -> Column:
    """STRUCT<title, statement_type, keywords>: the first statement title in a text, its kind, and every keyword it contains.

    Without a title, kind and title are the first group one of whose first ``first`` words it contains; else both are empty."""
    titles, groups = titles or STATEMENT_TITLES, groups or KEYWORD_GROUPS
    named = F.coalesce(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in titles))
    kind = F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, words[:first])), lambda w: F.contains(text, w)), F.lit(name)) for name, words in groups))
    found = F.coalesce(named, kind, F.lit(""))
    return F.struct(found.alias("title"), found.alias("statement_type"), finance_keywords(text, [w for _, words in groups for w in words]).alias("keywords"))


def with_encoding(parents: DataFrame, children: DataFrame, chars: int = 80) -> tuple[DataFrame, DataFrame]:
    """Both with statement_type, financial_keywords, encoding_text and prefix_title.

    ``parents`` (id, text, section, company, year), ``children`` (id, parent_id and the same). A child with keywords but without a statement takes its parent's. A table
    is encoded as a sentence, a text with keywords and a statement behind a prefix of what is known, any other as it is; prefix_title is the beginning
    of what is encoded where that differs from the text."""

    def marked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_d", detect_statement(F.coalesce("text", F.lit(""))))
        return rows.withColumns({"statement_type": F.col("_d.statement_type"), "financial_keywords": F.col("_d.keywords")}).drop("_d")

    def encoded(rows: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        sentence = F.when(has_table(text), table_sentence(text, F.col("statement_type"), F.col("company"), F.col("year")))
        plain = (F.size("financial_keywords") == 0) | (F.coalesce("statement_type", F.lit("")) == "")
        code = F.coalesce(F.nullif(sentence, F.lit("")), F.when(plain, text), encoding_text(text, F.lit(None).cast("string"), F.col("company"), F.col("section"), F.col("year"), F.col("statement_type")))
        return rows.withColumn("encoding_text", code).withColumn("prefix_title", F.when(F.col("encoding_text") != text, F.substring("encoding_text", 1, chars)).otherwise(""))

    above = marked(parents)
    below = marked(children)
    own = F.when(F.size("financial_keywords") > 0, F.lit(None).cast("string")).otherwise(F.col("statement_type"))
    titled = F.exists(F.array(*map(F.lit, STATEMENT_TITLES)), lambda t: F.contains(F.col("text"), t))
    inherited = inherit_title(below.withColumn("_own", F.col("statement_type")).withColumn("statement_type", F.when(titled, F.col("statement_type")).otherwise(own)), above)
    below = inherited.withColumn("statement_type", F.coalesce(F.nullif("statement_type", F.lit("")), "_own")).drop("_own")
    return encoded(above), encoded(below)


def finance_keywords(text: Column, words: list[str]) -> Column:
    """The vocabulary's words that a text contains, in the vocabulary's order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def inherit_title(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children without a statement title take their parent's."""
    of = parents.select(F.col("id").alias("parent_id"), F.col("statement_type").alias("_title"))
    return children.join(of, "parent_id", "left").withColumn("statement_type", F.coalesce(F.nullif("statement_type", F.lit("")), "_title")).drop("_title")


def encoding_text(text: Column, sentence: Column, company: Column, section: Column, year: Column, statement: Column) -> Column:
    """What is encoded: the table's sentence, else the text behind a prefix of what is known."""
    known = F.concat(*(F.when(v != "", F.concat(F.lit(f"[{n}="), v, F.lit("]"))).otherwise("") for n, v in (("公司", company), ("章节", section), ("年份", year), ("报表", statement))))
    return F.coalesce(F.nullif(sentence, F.lit("")), F.concat(known, text))


def hit_metrics(hits: DataFrame, metrics: DataFrame) -> DataFrame:
    """(query_id, company, year, metric, value): figures of the hit chunks, the first in rank order of each (company, year, metric)."""
    w = Window.partitionBy("query_id", "company", "year", "metric").orderBy("rank", "point_id", "value")
    rows = hits.select("query_id", "point_id", "rank").join(metrics, "point_id")
    return rows.withColumn("k", F.row_number().over(w)).filter("k = 1").select("query_id", "company", "year", "metric", "value")
