"""Metadata, entities, classification and the sources catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.retrieve import containing
from docquarry.session import Scratch

UNKNOWN = "未知"
#: Fixed weights of document types; others count 1.
IMPORTANCE = [("annual", 0.7), ("half_year", 0.8), ("macro", 0.9), ("research", 1.2), ("outline", 1.3)]
#: Report periods come before bare years, time stamps of announcements last.
YEAR_PATTERNS = [
    r"(20\d{2})\s*年\s*(?:半年度|年度|第[一三]季度|[一三]季)", r"(20\d{2})\s*(?:annual|interim)", r"报告期[^0-9]{0,8}(20\d{2})", r"(20\d{2})\s*年", r"(?:^|[^0-9])(20\d{2})(?:[^0-9]|$)", r"AP(20\d{2})\d{4,}",
]
COMPANY_PATTERNS = [
    r"^([一-鿿A-Za-z]{2,20}?)(?:20\d{2}|[_-])", r"股票简称[:： ]*([一-鿿A-Za-z]{2,12})", r"[AH]\s*股简称[:： ]*([一-鿿A-Za-z]{2,12})", r"([一-鿿]{2,20}?(?:股份)?有限公司)", r"^([A-Za-z]{2,30})", r"([一-鿿]{2,12})",
]


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def year_of(name: Column, head: Column) -> Column:
    """The year by the first pattern found in name and head, as text; report periods win over bare years."""
    return F.coalesce(*(F.coalesce(first_match(name, [p]), first_match(head, [p])) for p in YEAR_PATTERNS), F.lit(UNKNOWN))


def company_of(name: Column, head: Column, by_code: Column | None = None) -> Column:
    """The company by report code, by the name's pattern, by labels in the head, by the name's first words."""
    known = [] if by_code is None else [by_code]
    return F.coalesce(*known, first_match(name, COMPANY_PATTERNS[:1]), first_match(head, COMPANY_PATTERNS[1:4]), first_match(name, COMPANY_PATTERNS[4:]), F.lit(UNKNOWN))


def contained(texts: DataFrame, text: str, vocabulary: DataFrame, key: str, *order: Column) -> DataFrame:
    """``texts`` joined to the first vocabulary row, by ``order``, whose key its text contains."""
    rows = containing(texts, text, vocabulary, key, "doc_id")
    w = Window.partitionBy("doc_id").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def document_type(docs: DataFrame, text: str, keywords: DataFrame, default: str = "other") -> DataFrame:
    """(doc_id, doc_type): by the longest keyword (doc_type, prio, keyword) in the lower-cased text, then by prio."""
    rows = docs.select("doc_id", F.lower(text).alias("low"))
    found = contained(rows, "low", keywords, "keyword", F.length("keyword").desc(), F.col("prio"), F.col("keyword"))
    return docs.select("doc_id").join(found.select("doc_id", "doc_type"), "doc_id", "left").select("doc_id", F.coalesce("doc_type", F.lit(default)).alias("doc_type"))


def normalised(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``names`` with ``canonical``: the name an alias stands for, else the trimmed name."""
    table = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical")).dropDuplicates(["_alias"])
    rows = names.join(table, F.trim(name) == F.col("_alias"), "left")
    return rows.withColumn("canonical", F.coalesce("_canonical", F.trim(name))).drop("_alias", "_canonical")


def title_of(text: Column, cut: int = 80) -> Column:
    """The first line with a word, without its heading mark."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.trim(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), r"^\s*#{1,6}\s*", "")), 1, cut)


def extract_metadata(
    docs: DataFrame, name: str, text: str, codes: DataFrame | None = None, keywords: DataFrame | None = None, brokers: DataFrame | None = None, aliases: DataFrame | None = None, chars: int = 2000,
) -> DataFrame:
    """``docs`` (doc_id, ``name``, ``text``, ...) with company, year, doc_type, broker, title and importance, by name and the first ``chars`` characters.

    ``codes`` (info_code, stock): a code within the name gives the company, the first in order. ``keywords`` (doc_type, prio, keyword): see document_type.
    ``brokers`` (broker): the longest that the name begins with, else empty. ``aliases`` (alias, canonical) normalise companies. Unknown values say so."""
    head = F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars)
    rows = docs.select("doc_id", F.coalesce(F.col(name), F.lit("")).alias("_name"), head.alias("_head"))
    made = rows.select("doc_id", "_name", "_head", F.lit(None).cast("string").alias("_stock"))
    if codes is not None:
        found = contained(rows, "_name", codes.select("info_code", F.col("stock").alias("_stock")), "info_code", F.col("info_code"))
        made = rows.join(found.select("doc_id", "_stock"), "doc_id", "left")
    made = made.select("doc_id", "_name", "_head", company_of(F.col("_name"), F.col("_head"), F.col("_stock")).alias("_company"), year_of(F.col("_name"), F.col("_head")).alias("year"), title_of(F.col("_head")).alias("title"))
    if aliases is not None:
        made = normalised(made, "_company", aliases).drop("_company").withColumnRenamed("canonical", "_company")
    kinds = made.select("doc_id", F.lit(UNKNOWN).alias("doc_type"))
    if keywords is not None:
        kinds = document_type(made.select("doc_id", F.concat_ws("\n", "_name", "_head").alias("_both")), "_both", keywords, UNKNOWN)
    made = made.join(kinds, "doc_id")
    if brokers is not None:
        starts = containing(rows.select("doc_id", "_name"), "_name", brokers.select("broker"), "broker", "doc_id").filter(F.startswith("_name", "broker"))
        made = made.join(starts.groupBy("doc_id").agg(F.max_by("broker", F.length("broker")).alias("_broker")), "doc_id", "left")
    broker = F.coalesce("_broker", F.lit("")) if brokers is not None else F.lit("")
    made = made.select("doc_id", F.col("_company").alias("company"), "year", "doc_type", broker.alias("broker"), "title", importance(F.col("doc_type")).alias("importance"))
    return docs.join(made, "doc_id")


def importance(doc_type: Column) -> Column:
    out = F.lit(1.0)
    for kind, weight in IMPORTANCE:
        out = F.when(doc_type == kind, F.lit(weight)).otherwise(out)
    return out


def universe(*sets: DataFrame) -> DataFrame:
    """Distinct entities (kind, name) of several sources, without empty ones."""
    out = sets[0].select("kind", "name")
    for more in sets[1:]:
        out = out.unionByName(more.select("kind", "name"))
    return out.filter(F.length(F.trim("name")) > 0).distinct()


def derive_aliases(names: DataFrame, strip: str = "(股份|集团|有限公司|控股)+$") -> DataFrame:
    """(alias, canonical): each name without its endings, where that is shorter and at least 2 long; the first name by order keeps an alias."""
    rows = names.select("name", F.regexp_replace("name", strip, "").alias("alias")).filter((F.col("alias") != F.col("name")) & (F.length("alias") >= 2))
    return rows.groupBy("alias").agg(F.min("name").alias("canonical"))


def entity_search(asked: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, name, tier, place): exact, then by alias, then one within the other; longer names first.

    Repeated names and texts meet once; a text's best k names then go to the queries that ask it."""
    scratch = Scratch(asked.sparkSession, "entities")
    asked = asked.select("query_id", "text").filter(F.length("text") >= 2)
    texts, names = scratch.save("texts", asked.select("text").distinct()), scratch.save("names", names.select("name", "alias").distinct())
    ways = (containing(texts, "text", names, "name", "text"), containing(texts, "text", names, "alias", "text"), containing(names, "name", texts, "text", "name"))
    both = ways[0].select("text", "name", "alias")
    for more in ways[1:]:
        both = both.unionByName(more.select("text", "name", "alias"))
    tier = F.when(F.col("text") == F.col("name"), 1).when(F.contains("text", "alias"), 2).otherwise(3)
    first = lambda rows, key: rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("tier", F.length("name").desc(), "name"))).filter(F.col("place") <= k)
    best = first(both.groupBy("text", "name").agg(F.min(tier).alias("tier")), "text").drop("place")
    rows = asked.join(best.hint("merge"), "text").groupBy("query_id", "name").agg(F.min("tier").alias("tier"))
    return first(rows, "query_id")


def summary_route(name: Column, skip: list[str], routes: list[tuple[str, str]], default: str = "general") -> Column:
    """Which summary a document gets, by the first pattern that its name matches; null where it is skipped."""
    out = F.when(F.exists(F.array(*map(F.lit, skip)), lambda s: F.contains(name, s)), F.lit(None).cast("string")) if skip else F.when(F.lit(False), "")
    for pattern, kind in routes:
        out = out.when(name.rlike(pattern), kind)
    return out.otherwise(default)


def profile(docs: DataFrame, text: str, least: int = 5000, name: str | None = None, keywords: DataFrame | None = None) -> DataFrame:
    """Documents of at least ``least`` characters with ``chars``; with a ``name`` column also their type, by keywords in it, and company."""
    rows = docs.withColumn("chars", F.length(text)).filter(F.col("chars") >= least)
    if name is None:
        return rows
    rows = rows.withColumn("company", company_of(F.col(name), F.substring(text, 1, 2000)))
    return rows if keywords is None else rows.join(document_type(rows.select("doc_id", name), name, keywords), "doc_id")


def keyword_lines(docs: DataFrame, text: str, terms: DataFrame, each: int = 3) -> DataFrame:
    """(doc_id, term, line_no, line): up to ``each`` lines of a document that contain a term."""
    lines = docs.select("doc_id", F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))
    rows = containing(lines, "line", terms, "term", "doc_id", "line_no")
    w = Window.partitionBy("doc_id", "term").orderBy("line_no")
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= each).drop("k")


def number_lines(docs: DataFrame, text: str, pattern: str = r"\d|%|亿|万", least: int = 10, most: int = 20) -> DataFrame:
    """(doc_id, line_no, line): the first ``most`` lines of some length with numbers or units."""
    lines = docs.select("doc_id", F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.filter((F.length("line") >= least) & F.col("line").rlike(pattern))
    return rows.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")


def contents_lines(docs: DataFrame, text: str, cut: int = 80, most: int = 20) -> DataFrame:
    """(doc_id, line_no, line): chapter and numbered lines."""
    rows = number_lines(docs, text, r"^\s*(第[一二三四五六七八九十\d]+[章节]|\d+(\.\d+)*[.、 ])", 1, most)
    return rows.withColumn("line", F.substring("line", 1, cut))


def select_announcements(rows: DataFrame, title: str, group: str, keywords: list[str], least: int, each: int, *order: Column) -> DataFrame:
    """Titles of some length with any keyword, at most ``each`` of a group."""
    low = F.lower(title)
    held = rows.filter((F.length(title) >= least) & F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, F.lower(k))))
    w = Window.partitionBy(group).orderBy(*order)
    return held.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each)


def once_by(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def length_grade(chars: Column, good: int = 5000, fair: int = 1000) -> Column:
    return F.when(chars >= good, "good").when(chars >= fair, "fair").otherwise("poor")


def catalog(points: DataFrame, source: str, first: str, *columns: str) -> DataFrame:
    """One row per source over all points: the metadata of its first chunk, chunk count, collections, whether it has an outline."""
    return points.groupBy(source).agg(
        *(F.min_by(c, first).alias(c) for c in columns), F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set("collection")), ",").alias("modes"),
        F.bool_or(F.col("chunk_type") == "outline").alias("has_outline"),
    )


def catalog_missing(files: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Files that the catalog lacks, with default metadata."""
    rows = files.join(known.select(key), key, "left_anti")
    return rows.withColumns({"company": F.lit(UNKNOWN), "year": F.lit(UNKNOWN), "doc_type": F.lit(UNKNOWN)})
