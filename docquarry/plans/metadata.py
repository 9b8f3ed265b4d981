"""Queries over metadata, entities and the catalog. Words of the corpus stand for names and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import index as X
from docquarry.operators import metadata as M
from docquarry.operators.retrieve import containing
from docquarry.plans.corpus import CHUNKS, chunks, documents
from docquarry.plans.registry import query
from docquarry.session import table

KEYWORDS = [("report", 1, "the"), ("report", 2, "there"), ("notice", 3, "tion"), ("note", 4, "les"), ("note", 5, "lesquement"), ("letter", 6, "los"), ("paper", 7, "und")]
_KEYWORDS = "keywords AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in KEYWORDS) + ") k(doc_type, prio, keyword))"



def _pairs(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(f"""
WITH {_KEYWORDS}, j AS (SELECT doc_id, doc_type, row_number() OVER (PARTITION BY doc_id ORDER BY length(keyword) DESC, prio, keyword) AS k FROM documents JOIN keywords ON contains(lower(text), keyword))
SELECT d.doc_id, coalesce(doc_type, 'other') AS doc_type FROM documents d LEFT JOIN (SELECT * FROM j WHERE k = 1) j USING (doc_id)""")
def doc_type_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.document_type(documents(spark, sf_dir), "text", _pairs(spark, KEYWORDS, "doc_type string, prio int, keyword string"))


@query("SELECT page_id, arg_min(n_name, n_nationkey) AS nation FROM pages JOIN nation ON contains(upper(html), substr(n_name, 1, 3)) GROUP BY page_id")
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nation, by key, whose short name a page contains."""
    codes = table(spark, sf_dir, "nation").select("n_nationkey", F.substring("n_name", 1, 3).alias("code"), "n_name")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.upper("html").alias("html"))
    return M.contained(pages, "html", codes, "code", F.col("n_nationkey")).select(F.col("doc_id").alias("page_id"), F.col("n_name").alias("nation"))


@query("SELECT o_orderkey, coalesce(nullif(regexp_extract(CAST(o_orderdate AS VARCHAR), '((19|20)\\d{2})', 1), ''), '未知') AS year FROM orders")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(M.first_match(day, [r"((19|20)\d{2})"]), F.lit(M.UNKNOWN)).alias("year"))


@query("SELECT p_partkey, arg_min(prefix, length(prefix) * -1) AS prefix FROM part JOIN (VALUES ('STANDARD'), ('SMALL'), ('S'), ('PROMO'), ('ECO')) v(prefix) ON starts_with(p_type, prefix) GROUP BY p_partkey")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest known prefix of each part's type."""
    known = _pairs(spark, [("STANDARD",), ("SMALL",), ("S",), ("PROMO",), ("ECO",)], "prefix string")
    rows = containing(table(spark, sf_dir, "part"), "p_type", known, "prefix", "p_partkey").filter(F.startswith("p_type", "prefix"))
    return rows.groupBy("p_partkey").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


@query("SELECT c_custkey, coalesce(r.r_name, trim(n.n_name)) AS canonical FROM customer JOIN nation n ON c_nationkey = n_nationkey LEFT JOIN region r ON r.r_name = trim(n.n_name)")
def alias_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "region").select(F.col("r_name").alias("alias"), F.col("r_name").alias("canonical"))
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return M.normalised(rows, "n_name", aliases).select("c_custkey", "canonical")


@query(f"""
WITH {_KEYWORDS}, t AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'annual' WHEN 'fr' THEN 'half_year' WHEN 'de' THEN 'research' ELSE 'memo' END AS doc_type FROM documents)
SELECT doc_type, count(*) AS n, CASE doc_type WHEN 'annual' THEN 0.7 WHEN 'half_year' THEN 0.8 WHEN 'macro' THEN 0.9 WHEN 'research' THEN 1.2 WHEN 'outline' THEN 1.3 ELSE 1.0 END::DOUBLE AS importance FROM t GROUP BY doc_type""")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "annual").when(F.col("lang") == "fr", "half_year").when(F.col("lang") == "de", "research").otherwise("memo")
    rows = documents(spark, sf_dir).select(kind.alias("doc_type")).groupBy("doc_type").agg(F.count("*").alias("n"))
    return rows.withColumn("importance", M.importance(F.col("doc_type")))


@query("SELECT kind, name FROM (SELECT 'source' AS kind, source AS name FROM documents UNION SELECT 'supplier', s_name FROM supplier UNION SELECT 'nation', n_name FROM nation) WHERE length(trim(name)) > 0")
def entity_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, kind, column: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(column).alias("name"))
    return M.universe(of("documents", "source", "source"), of("supplier", "supplier", "s_name"), of("nation", "nation", "n_name"))


@query("""
WITH asked AS (SELECT n_nationkey AS query_id, n_name AS text FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region), names AS (SELECT n_name AS name, substr(n_name, 1, 4) AS alias FROM nation),
h AS (SELECT query_id, name, min(CASE WHEN text = name THEN 1 WHEN contains(text, alias) THEN 2 ELSE 3 END) AS tier FROM asked JOIN names ON contains(text, name) OR contains(name, text) OR contains(text, alias) WHERE length(text) >= 2 GROUP BY ALL)
SELECT query_id, name, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(name) DESC, name) AS place FROM h QUALIFY place <= 5""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    asked = nations.select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("text"))
    asked = asked.unionByName(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("query_id"), F.col("r_name").alias("text")))
    return M.entity_search(asked, nations.select(F.col("n_name").alias("name"), F.substring("n_name", 1, 4).alias("alias")))


@query("""
WITH names AS (SELECT c_name AS name, substr(c_name, 9) AS alias FROM customer),
asked AS (SELECT c_custkey AS query_id, c_name AS text FROM customer UNION ALL SELECT 1000000000 + s_suppkey, 'all of ' || s_name || ' today' FROM supplier UNION ALL SELECT 2000000000 + c_custkey, substr(c_name, 1, 16) FROM customer WHERE c_custkey % 10 = 0),
h AS (SELECT query_id, name, min(CASE WHEN text = name THEN 1 WHEN contains(text, alias) THEN 2 ELSE 3 END) AS tier FROM asked JOIN names ON contains(text, name) OR contains(name, text) OR contains(text, alias) GROUP BY ALL)
SELECT query_id, name, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, length(name) DESC, name) AS place FROM h QUALIFY place <= 5""")
def entity_search_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole names, sentences about suppliers and openings of names, asked of all customers: thousands of keys with one opening."""
    customers = table(spark, sf_dir, "customer")
    asked = customers.select(F.col("c_custkey").cast("long").alias("query_id"), F.col("c_name").alias("text"))
    asked = asked.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000000).cast("long").alias("query_id"), F.concat(F.lit("all of "), "s_name", F.lit(" today")).alias("text")))
    asked = asked.unionByName(customers.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 2000000000).cast("long").alias("query_id"), F.substring("c_name", 1, 16).alias("text")))
    return M.entity_search(asked, customers.select(F.col("c_name").alias("name"), F.expr("substr(c_name, 9)").alias("alias")))


@query("""
WITH v(alias, name, tier) AS (VALUES ('thonre', 'Thonre Group', 1), ('tion', 'Tion Holding', 2), ('ment', 'Ment Works', 2), ('heit', 'Heit', 3), ('los', 'Los', 3))
SELECT doc_id, (SELECT name FROM v WHERE contains(d.text, alias) ORDER BY tier, length(alias) DESC, alias, name LIMIT 1) AS name FROM documents d WHERE EXISTS (SELECT 1 FROM v WHERE contains(d.text, alias))""")
def longest_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docquarry.operators.understand import longest_entity as longest

    names = _pairs(spark, [("thonre", "Thonre Group", 1), ("tion", "Tion Holding", 2), ("ment", "Ment Works", 2), ("heit", "Heit", 3), ("los", "Los", 3)], "alias string, name string, tier int")
    return longest(documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "text"), names).select(F.col("query_id").alias("doc_id"), "name")


@query("SELECT substr(c_name, 1, 17) AS alias, min(c_name) AS canonical FROM customer GROUP BY 1")
def name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names to full names; the first full name keeps the short one."""
    rows = table(spark, sf_dir, "customer").select(F.substring("c_name", 1, 17).alias("alias"), F.col("c_name").alias("canonical"))
    return M.once_by(rows, "alias", F.col("canonical"))


@query("SELECT lang, source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE length(text) >= 5000 GROUP BY ALL")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.profile(documents(spark, sf_dir), "text").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents)
SELECT doc_id, term, line_no, md5(line) AS digest FROM l JOIN (VALUES ('###'), ('worthless'), ('MIT License'), ('@')) t(term) ON contains(line, term) QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY line_no) <= 3""")
def kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _pairs(spark, [("###",), ("worthless",), ("MIT License",), ("@",)], "term string")
    return M.keyword_lines(documents(spark, sf_dir), "text", terms).select("doc_id", "term", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("digest"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents)
SELECT doc_id, line_no, md5(line) AS digest FROM l WHERE length(line) >= 10 AND regexp_matches(line, '\\d|%|亿|万') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 20""")
def number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.number_lines(documents(spark, sf_dir), "text").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("digest"))


@query("""
WITH p AS (SELECT page_id, url, split_part(url, '/', 3) AS host FROM pages)
SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY length(url) DESC, page_id) AS place FROM p WHERE length(url) >= 20 AND (contains(lower(url), 'a') OR contains(lower(url), 'post')) QUALIFY place <= 3""")
def select_top_n_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return M.select_announcements(rows, "url", "host", ["A", "post"], 20, 3, F.length("url").desc(), F.col("page_id")).select("host", "page_id", "place")


@query("SELECT host, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids FROM (SELECT regexp_replace(url, '[?#].*$', '') AS u, split_part(min(url), '/', 3) AS host, min(page_id) AS page_id FROM pages GROUP BY 1) GROUP BY host")
def dedup_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each address, counted per host."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("u"))
    once = M.once_by(rows, "u", F.col("page_id")).withColumn("host", F.split_part("u", F.lit("/"), F.lit(3)))
    return once.groupBy("host").agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"))


@query("SELECT lang, CASE WHEN length(text) >= 5000 THEN 'good' WHEN length(text) >= 1000 THEN 'fair' ELSE 'poor' END AS grade, count(*) AS n FROM documents GROUP BY ALL")
def length_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("lang", M.length_grade(F.length("text")).alias("grade")).agg(F.count("*").alias("n"))


CATALOG = f"""{CHUNKS}, kept AS (SELECT *, unnest(CASE WHEN doc_type = 'en' THEN ['pro', 'safe'] ELSE ['pro'] END) AS collection, CASE WHEN child = 20 THEN 'outline' ELSE 'child' END AS chunk_type FROM chunks),
catalog AS (SELECT doc_id, arg_min(company, child) AS company, arg_min(doc_type, child) AS doc_type, count(*) AS chunks, string_agg(DISTINCT collection, ',' ORDER BY collection) AS modes, bool_or(chunk_type = 'outline') AS has_outline FROM kept GROUP BY doc_id)"""


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents are in both collections; a document's 21st chunk stands for an outline."""
    rows = chunks(spark, sf_dir)
    both = F.when(F.col("doc_type") == "en", F.array(F.lit("pro"), F.lit("safe"))).otherwise(F.array(F.lit("pro")))
    rows = rows.withColumn("collection", F.explode(both)).withColumn("chunk_type", F.when(F.col("child") == 20, "outline").otherwise("child"))
    return M.catalog(rows, "doc_id", "child", "company", "doc_type")


@query(f"WITH {CATALOG} SELECT doc_id, company, doc_type, chunks FROM catalog")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark, sf_dir).select("doc_id", "company", "doc_type", "chunks")


@query(f"WITH {CATALOG} SELECT doc_id, modes, has_outline FROM catalog")
def catalog_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark, sf_dir).select("doc_id", "modes", "has_outline")


@query(f"WITH {CATALOG} SELECT doc_id, doc_type, chunks FROM catalog WHERE contains(modes, 'safe')")
def catalog_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_rows(spark, sf_dir).filter(F.contains("modes", F.lit("safe"))).select("doc_id", "doc_type", "chunks")


@query("SELECT page_id AS doc_id, '未知' AS company, '未知' AS year, '未知' AS doc_type FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def catalog_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return M.catalog_missing(files, table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH d AS (SELECT doc_id, source || '_' || (2015 + doc_id % 12) || '_' || lang || '.md' AS name, source, lang, list_filter(string_split(substr(coalesce(text, ''), 1, 2000), chr(10)), lambda x: trim(x) <> '')[1] AS line FROM documents)
SELECT doc_id, CASE WHEN source IN ('src1', 'src10', 'src12') THEN 'Acme ' || source ELSE 'Source House' END AS company, CAST(2015 + doc_id % 12 AS VARCHAR) AS year,
  CASE lang WHEN 'en' THEN 'annual' WHEN 'fr' THEN 'half_year' WHEN 'de' THEN 'research' ELSE '未知' END AS doc_type, CASE lang WHEN 'en' THEN 0.7 WHEN 'fr' THEN 0.8 WHEN 'de' THEN 1.2 ELSE 1.0 END::DOUBLE AS importance,
  source AS broker, md5(substr(trim(regexp_replace(coalesce(line, ''), '^\\s*#{1,6}\\s*', '')), 1, 80)) AS title FROM d""")
def metadata_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of source, a year and language; three sources have a report code, the others a short name for an alias."""
    docs = documents(spark, sf_dir).withColumn("name", F.concat("source", F.lit("_"), F.lit(2015) + F.pmod("doc_id", F.lit(12)), F.lit("_"), "lang", F.lit(".md")))
    sources = docs.select("source").distinct()
    codes = sources.filter(F.col("source").isin("src1", "src10", "src12")).select(F.concat("source", F.lit("_")).alias("info_code"), F.concat(F.lit("Acme "), "source").alias("stock"))
    words = _pairs(spark, [("annual", 1, "_en.md"), ("half_year", 2, "_fr.md"), ("research", 3, "_de.md")], "doc_type string, prio int, keyword string")
    rows = M.extract_metadata(docs, "name", "text", codes, words, sources.select(F.col("source").alias("broker")), _pairs(spark, [("src", "Source House")], "alias string, canonical string"))
    return rows.select("doc_id", "company", "year", "doc_type", "importance", "broker", F.md5("title").alias("title"))


OUTLINED = f"{CHUNKS}, outlines AS (SELECT doc_id, child, doc_type FROM chunks WHERE child % 3 = 0)"


@query(f"""
WITH {OUTLINED} SELECT doc_id, count(*) AS points, count(*) FILTER (kind = 'outline') AS outlines, count(*) FILTER (kind = 'outline' AND state = 'new') AS fresh FROM (
  SELECT doc_id, 'child' AS kind, 'old' AS state FROM chunks UNION ALL SELECT doc_id, 'outline', CASE WHEN doc_type = 'fr' THEN 'old' ELSE 'new' END FROM outlines) GROUP BY doc_id""")
def outline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chunk stands for an outline; those of one language are there already and stay as they are."""
    rows = chunks(spark, sf_dir)
    outlines = rows.filter("child % 3 = 0").select("doc_id", F.col("child").alias("section_order"), F.col("company").alias("section"), F.substring("text", 1, 60).alias("outline_text"), F.concat(F.lit("new "), "text").alias("text"), "doc_type")
    held = X.outline_points(rows.select("point_id", "doc_id", "text").withColumn("chunk_type", F.lit("child")), outlines.filter("doc_type = 'fr'").withColumn("text", F.lit("old")).drop("doc_type"))
    out = X.outline_points(held, outlines.drop("doc_type"))
    kind = F.col("chunk_type") == "outline"
    return out.groupBy("doc_id").agg(F.count("*").alias("points"), F.count_if(kind).alias("outlines"), F.count_if(kind & F.startswith("text", F.lit("new "))).alias("fresh"))


@query("""
SELECT p_partkey, CASE WHEN contains(p_name, 'gadget') THEN NULL WHEN regexp_matches(p_name, '^(red|blue)') THEN 'colour' WHEN regexp_matches(p_type, 'ECONOMY|PROMO') THEN 'cheap' ELSE 'general' END AS route FROM part""")
def summary_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit(" "), "p_type"))
    return rows.select("p_partkey", M.summary_route(F.col("name"), ["gadget"], [("^(red|blue)", "colour"), ("ECONOMY|PROMO", "cheap")]).alias("route"))
