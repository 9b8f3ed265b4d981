"""Queries over documents: sources, cleaning, chunking, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import chunking as C
from docquarry.operators import index as X
from docquarry.plans.registry import query
from docquarry.session import table
from docquarry.sources import tables as S

DOUBLED = "replace(coalesce(text, ''), chr(10), chr(10) || chr(10))"
#: Words and numbers in texts without Han, as functions.text has them.
_PIECES = r"\pN*\pL[\pL\pN]*|[0-9]+(?:,[0-9]{3}\b)*(?:\.[0-9]+)?%?|\pN+"


def words_sql(text: str = "text") -> str:
    return rf"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '{_PIECES}'), lambda x: rtrim(replace(x, ',', ''), '%'))"


def tokens_sql(text: str = "text") -> str:
    return rf"flatten(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '{_PIECES}'), lambda x: CASE WHEN suffix(x, '%') THEN [rtrim(replace(x, ',', ''), '%'), '%'] ELSE [replace(x, ',', '')] END))"


TOKENS = tokens_sql()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doubled(text: str = "text") -> Column:
    """Newline paragraphs become blank-line paragraphs."""
    return F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit("\n\n"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, doc_id, company, doc_type, child, text): plain child windows of all documents; the retrieval corpus."""
    return chunks_of(documents(spark, sf_dir))


def chunks_of(docs: DataFrame) -> DataFrame:
    rows = C.child_windows(docs, "text", "doc_id", "source", "lang")
    return rows.select((F.shiftleft("doc_id", 24) + F.col("child")).alias("point_id"), "doc_id", F.col("source").alias("company"), F.col("lang").alias("doc_type"), "child", F.col("chunk").alias("text"))


#: The same in SQL: windows of 400 at multiples of 320, cut back to the first kind of break found at or after the next start.
CHUNKS = r"""
wins AS (SELECT doc_id, source, lang, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 400) / 320.0) AS BIGINT), 0))) AS child FROM documents WHERE text IS NOT NULL),
fulls AS (SELECT *, CAST(child * 320 AS BIGINT) AS start, substr(text, CAST(child * 320 + 1 AS BIGINT), 400) AS f, child = greatest(CAST(ceil((length(text) - 400) / 320.0) AS BIGINT), 0) AS last FROM wins),
tails AS (SELECT *, substr(f, 321) AS t FROM fulls),
cuts AS (SELECT *, CASE WHEN contains(t, chr(10) || chr(10)) THEN length(t) - strpos(reverse(t), chr(10) || chr(10)) + 1 WHEN contains(t, chr(10)) THEN length(t) - strpos(reverse(t), chr(10)) + 1
  WHEN contains(t, '。') THEN length(t) - strpos(reverse(t), '。') + 1 WHEN contains(t, '；') THEN length(t) - strpos(reverse(t), '；') + 1
  WHEN contains(t, '. ') THEN length(t) - strpos(reverse(t), ' .') + 1 END AS cut FROM tails),
more AS (SELECT *, substr(text, start + 320 + coalesce(cut, 80) + 1, 640 - coalesce(cut, 80)) AS behind FROM cuts),
chunks AS (SELECT doc_id * 16777216 + child AS point_id, doc_id, source AS company, lang AS doc_type, child, start,
  CASE WHEN last THEN substr(text, start + 1) ELSE substr(f, 1, CAST(320 + coalesce(cut, 80) AS BIGINT)) ||
    CASE WHEN strpos(behind, chr(10)) > 1 AND regexp_matches(split_part(behind, chr(10), 1), '^\s*\d+[,.]?\d*\s*(亿元|万元|元|%|每股|占总|同比|增长|下降|收入|利润|分红|股息|净利润|营收|归母)') THEN split_part(behind, chr(10), 1) || chr(10) ELSE '' END END AS text FROM more)"""


@query("SELECT doc_id, length(text) AS n_chars, (length(text) - length(replace(text, chr(10) || chr(10), ''))) // 2 + 1 AS page_count FROM documents WHERE length(trim(text)) > 0")
def scan_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).filter(F.length(F.trim("text")) > 0)
    return rows.select("doc_id", F.length("text").alias("n_chars"), S.page_count(F.col("text")).alias("page_count"))


@query("""
SELECT doc_id, count(*) AS pages, CASE WHEN avg(CASE WHEN length(trim(p)) > 80 THEN 1 ELSE 0 END) >= 0.8 THEN 'text' ELSE 'scanned' END AS kind
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) GROUP BY doc_id""")
def page_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return S.page_type(pages, "doc_id", "p")


@query("""
SELECT count(*) AS documents, count(*) FILTER (html LIKE '%</html>%') AS succeeded, count(*) FILTER (NOT html LIKE '%</html>%') AS failed, CAST(sum(length(html)) AS BIGINT) AS chars,
       CAST(sum(CASE WHEN html LIKE '%<table%' THEN 1 ELSE 0 END) AS BIGINT) AS tables FROM pages""")
def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    records = table(spark, sf_dir, "pages").select(
        F.when(html.contains("</html>"), "success").otherwise("error").alias("status"), F.length(html).alias("char_count"), F.when(html.contains("<table"), 1).otherwise(0).alias("table_count")
    )
    return S.parse_report(records)


@query(f"""
WITH {CHUNKS}, old AS (SELECT point_id, lang_text FROM (SELECT point_id, md5(text) AS lang_text, doc_type FROM chunks)),
new AS (SELECT point_id, md5('v2 ' || text) AS lang_text FROM chunks WHERE doc_type = 'fr' UNION ALL SELECT point_id + 8388608, md5(text) FROM chunks WHERE doc_type = 'de')
SELECT point_id, lang_text AS digest FROM new UNION ALL SELECT point_id, lang_text FROM old WHERE point_id NOT IN (SELECT point_id FROM new)""")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that rewrites one language's points and adds new ones for another."""
    rows = chunks(spark, sf_dir)
    old = rows.select("point_id", F.md5("text").alias("digest"))
    changed = rows.filter("doc_type = 'fr'").select("point_id", F.md5(F.concat(F.lit("v2 "), "text")).alias("digest"))
    added = rows.filter("doc_type = 'de'").select((F.col("point_id") + (1 << 23)).alias("point_id"), F.md5("text").alias("digest"))
    return S.upsert(old, changed.unionByName(added))


PARENTS = r"""
p0 AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ps FROM documents),
p1 AS (SELECT doc_id, p, i FROM (SELECT doc_id, unnest(ps) AS p, unnest(generate_series(1, len(ps))) AS i FROM p0)),
p2 AS (SELECT doc_id, p, i, h, coalesce(last_value(CASE WHEN h THEN trim(regexp_replace(p, '^\s*(?:#{1,6}\s+|[一二三四五六七八九十]+、|\d{1,2}[.、]\s*)', '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), '') AS section
  FROM (SELECT *, regexp_matches(p, '^\s*(#{1,6}\s+.+|[一二三四五六七八九十]+、.+|\d{1,2}(\.|、)\s*\S.*)$') AS h FROM p1)),
walk AS (SELECT doc_id, i, p, section, length(p) AS size, 0 AS g FROM p2 WHERE i = 1
  UNION ALL SELECT x.doc_id, x.i, x.p, x.section, CASE WHEN flush THEN length(x.p) ELSE x.before + length(x.p) END, CASE WHEN flush THEN x.g + 1 ELSE x.g END
  FROM (SELECT p2.doc_id, p2.i, p2.p, p2.section, w.size AS before, w.g, w.size > 0 AND (w.size + length(p2.p) > 2000 OR p2.h AND w.size >= 600) AS flush FROM walk w JOIN p2 ON p2.doc_id = w.doc_id AND p2.i = w.i + 1) x),
tail AS (SELECT doc_id, max(g) AS top, max_by(size, i) AS size FROM walk GROUP BY doc_id),
parents AS (SELECT w.doc_id, CASE WHEN t.size < 600 AND t.top > 0 THEN least(g, t.top - 1) ELSE g END AS parent, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text, arg_min(section, i) AS section
  FROM walk w JOIN tail t USING (doc_id) GROUP BY 1, 2)"""


def parent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return C.parents(documents(spark, sf_dir), pieces, "doc_id")


@query(f"WITH RECURSIVE {PARENTS} SELECT doc_id, parent, section, length(text) AS char_count, md5(text) AS digest FROM parents")
def parents_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parent_rows(spark, sf_dir).select("doc_id", "parent", "section", "char_count", F.md5("text").alias("digest"))


_CLEANED = r"""
noise AS (SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\s*(第\s*\d+\s*页.*|page\s+\d+.*|\d{1,4}|[-—]\s*\d+\s*[-—]|.*免责声明.*|disclaimer.*)\s*$') AND NOT regexp_matches(x, '^\s*<!--\s*image\s*-->\s*$')), chr(10)) AS text FROM documents)"""
_OF_CLEANED = PARENTS.replace("coalesce(text, '')", "text").replace("FROM documents", "FROM noise")


@query(f"""
WITH RECURSIVE {_CLEANED}, {_OF_CLEANED}, n AS (SELECT doc_id, section, length(text) AS chars, greatest(CAST(ceil((length(text) - 400) / 320.0) AS BIGINT), 0) + 1 AS c FROM parents)
SELECT doc_id, count(*) AS parents, CAST(sum(c) AS BIGINT) AS children, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (section <> '') AS sectioned FROM n GROUP BY doc_id""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunk pipeline, as counts per document; line ends stand for blank lines."""
    above, below = C.chunk_corpus(documents(spark, sf_dir).withColumn("text", doubled()), "doc_id")
    parents = above.groupBy("doc_id").agg(F.count("*").alias("parents"), F.sum("char_count").alias("chars"), F.count_if(F.col("section") != "").alias("sectioned"))
    return parents.join(below.groupBy("doc_id").agg(F.count("*").alias("children")), "doc_id")


@query(f"WITH {CHUNKS} SELECT doc_id, child, start, md5(text) AS digest FROM chunks")
def child_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.child_windows(documents(spark, sf_dir).filter("text is not null"), "text", "doc_id")
    return rows.select("doc_id", F.col("child").cast("long").alias("child"), F.col("start").cast("long").alias("start"), F.md5("chunk").alias("digest"))


@query(f"""
WITH {CHUNKS} SELECT doc_type, company, count(*) AS points, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks WHERE child > 0 GROUP BY ALL""")
def scan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points that are not a document's first, without paging."""
    return chunks(spark, sf_dir).filter("child > 0").groupBy("doc_type", "company").agg(F.count("*").alias("points"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {CHUNKS} SELECT point_id, company FROM chunks WHERE company NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING avg(toxic) > 0.15)")
def delete_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop every point of the sources whose labelled documents are too often toxic."""
    gone = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("company")).agg(F.avg("toxic").alias("t")).filter("t > 0.15")
    return S.delete_documents(chunks(spark, sf_dir), gone, "company").select("point_id", "company")


@query("SELECT collection, lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents, (VALUES ('pro'), ('safe')) c(collection) GROUP BY ALL")
def split_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.split_collection(documents(spark, sf_dir), "pro", "safe")
    return rows.groupBy("collection", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pending(documents(spark, sf_dir), table(spark, sf_dir, "labels")).select("doc_id")


@query(r"""
SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\s*(page\s+\d+.*|\d{1,4}|[-—]\s*\d+\s*[-—]|disclaimer.*)\s*$')), chr(10))) AS digest FROM documents""")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(C.clean_lines(F.col("text"))).alias("digest"))


@query("SELECT doc_id, length(regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10)), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g')) AS n_chars FROM documents")
def collapse_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.replace("text", F.lit(". "), F.lit("\n\n\n\n"))
    return documents(spark, sf_dir).select("doc_id", F.length(C.collapse_blank(spread)).alias("n_chars"))


PIPE_TABLES = """
tab_rows AS (SELECT l_orderkey AS id, l_linenumber, 'p' || l_partkey AS part, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity,
  '| p' || l_partkey || ' | ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' | ' || CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) || ' |' AS r FROM lineitem),
tabs AS (SELECT id, '| part | quantity | price |' || chr(10) || string_agg(r, chr(10) ORDER BY l_linenumber, r) AS text FROM tab_rows GROUP BY id)"""


def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): the lines of each order as a pipe table with a header."""
    row = F.concat(F.lit("| p"), F.col("l_partkey"), F.lit(" | "), F.col("l_quantity").cast("long"), F.lit(" | "), F.round("l_extendedprice").cast("long"), F.lit(" |"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rs"))
    return rows.select("id", F.concat(F.lit("| part | quantity | price |\n"), F.array_join(F.transform("rs", lambda x: x.r), "\n")).alias("text"))


@query(f"WITH {PIPE_TABLES} SELECT id, 2 AS runs FROM tabs")
def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each generated table twice, with a plain line between."""
    rows = pipe_tables(spark, sf_dir)
    return rows.select("id", C.table_runs(F.concat("text", F.lit("\nand then\n"), "text")).alias("runs"))


@query(f"SELECT doc_id, i - 1 AS para, length(p) AS n_chars FROM (SELECT doc_id, unnest(ps) AS p, unnest(generate_series(1, len(ps))) AS i FROM (SELECT doc_id, list_filter(string_split_regex({DOUBLED}, '\\n\\n+'), lambda x: trim(x) <> '') AS ps FROM documents))")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.blank_paragraphs(documents(spark, sf_dir), doubled(), "doc_id")
    return rows.select("doc_id", F.col("para").cast("long").alias("para"), F.length("paragraph").alias("n_chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN length(p) < 60 THEN '---' ELSE p END AS p FROM l)
SELECT doc_id, i, CAST(coalesce(sum(CASE WHEN p = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS page FROM m""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines stand for page breaks."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "p")).select("doc_id", (F.col("k") + 1).cast("long").alias("i"), F.when(F.length("p") < 60, "---").otherwise(F.col("p")).alias("p"))
    return C.page_numbers(rows, "doc_id", "i", "p").select("doc_id", "i", "page")


@query(f"WITH {CHUNKS} SELECT point_id, md5(substr('[' || company || ']' || chr(10) || text, 1, 1000)) AS digest FROM chunks")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("point_id", F.md5(C.search_text(F.col("company"), F.lit(""), F.col("text"))).alias("digest"))


@query(r"""
WITH t AS (SELECT doc_id, '# start of ' || source || chr(10) || text || chr(10) || '# second part' || chr(10) || text AS text FROM documents)
SELECT doc_id, s AS section_order, CASE s WHEN 1 THEN 'start of ' || (SELECT source FROM documents d WHERE d.doc_id = t.doc_id) ELSE 'second part' END AS title, length(substr(text, 1)) AS n_chars
FROM (SELECT d.doc_id, d.text, unnest([1, 2]) AS s FROM documents d) t WHERE length(text) >= 500 AND NOT regexp_matches(text, '(?m)^\s*(#{1,6}\s+.+|\d{1,2}(\.|、)\s*\S.*)$')""")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document twice, under two headings of our own; documents with headings of theirs are left to the goldens."""
    docs = documents(spark, sf_dir).filter(~F.col("text").rlike(r"(?m)^\s*(#{1,6}\s+.+|\d{1,2}(\.|、)\s*\S.*)$"))
    docs = docs.withColumn("t", F.concat(F.lit("# start of "), "source", F.lit("\n"), "text", F.lit("\n# second part\n"), "text"))
    return C.outline_sections(docs, "t", "doc_id").select("doc_id", "section_order", "title", F.length("body").alias("n_chars"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
t AS (SELECT *, trim(regexp_replace(line, '^\s*#{1,6}\s*', '')) AS title FROM l),
h AS (SELECT *, regexp_matches(line, '^\s*(#{1,6}\s+.+|[一二三四五六七八九十]+、.+|\d{1,2}(\.|、)\s*\S.*)$') AND length(title) BETWEEN 3 AND 80 AND NOT regexp_matches(title, '[。；，：,;:.!?！？]$') AND NOT regexp_matches(title, '\d+(\.\d+)?%|\d+\.\d+|增长|下降|同比|环比')
  AND NOT (length(title) > 15 AND regexp_matches(title, '[，,]')) AND NOT (length(title) > 20 AND regexp_matches(title, '因此|但是|由于|以及|其中|并且')) AND NOT regexp_matches(line, '[、.]\s*(合并资产负债表|母公司资产负债表|合并利润表|母公司利润表|合并现金流量表|母公司现金流量表|合并所有者权益变动表)\s*$') AS opens FROM t),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section_order FROM h)
SELECT doc_id, CAST(section_order AS BIGINT) AS section_order, coalesce(max(title) FILTER (opens), '前言/概述') AS title, length(string_agg(line, chr(10) ORDER BY i) FILTER (NOT opens)) AS n_chars
FROM s GROUP BY doc_id, section_order HAVING length(string_agg(line, chr(10) ORDER BY i) FILTER (NOT opens)) >= 500""")
def outline_sections_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as they are, cut at headings of their own."""
    return C.outline_sections(documents(spark, sf_dir), "text", "doc_id").select("doc_id", "section_order", "title", F.length("body").alias("n_chars"))


@query("SELECT doc_id, 'doc_' || doc_id || '_' || (i - 1) AS paragraph_id, p AS paragraph FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))) AS p, unnest(generate_series(1, len(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10))))) AS i FROM documents)")
def doc_paragraph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(doubled(), "\n\n")).alias("i", "paragraph"))
    return rows.select("doc_id", F.concat(F.lit("doc_"), "doc_id", F.lit("_"), "i").alias("paragraph_id"), "paragraph")


@query(f"WITH {CHUNKS}, t AS (SELECT point_id, unnest({TOKENS}) AS term FROM chunks) SELECT point_id, term, count(*) AS tf FROM t GROUP BY ALL")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.postings(chunks(spark, sf_dir), "point_id", "text")


_LINE = "'营业收入' || CAST(o_totalprice AS DECIMAL(15,2)) || '亿元，' || CAST(year(o_orderdate) AS VARCHAR) || '年同比增长' || (o_custkey % 100) || '.5%，共1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '万元'"


@query(f"""
WITH l AS (SELECT o_orderkey, {_LINE} AS text FROM orders),
p AS (SELECT o_orderkey, unnest(regexp_extract_all(text, '(?:19|20)[0-9]{{2}}年|[0-9]+(?:,[0-9]{{3}}\\b)*(?:\\.[0-9]+)?(?:亿元|万元|%)?|[一-鿿]+')) AS p FROM l),
n AS (SELECT o_orderkey, p, regexp_extract(p, '^[0-9]+(?:,[0-9]{{3}}\\b)*(?:\\.[0-9]+)?') AS num FROM p),
t AS (SELECT o_orderkey, unnest(CASE WHEN regexp_full_match(p, '(19|20)[0-9]{{2}}年') THEN [p, p[1:4]] WHEN num <> '' THEN list_filter([replace(num, ',', ''), substr(p, length(num) + 1)], lambda x: x <> '')
  WHEN length(p) = 1 THEN [p] ELSE list_transform(range(1, CAST(length(p) AS BIGINT)), lambda i: substr(p, i, 2)) END) AS term FROM n)
SELECT o_orderkey, term, count(*) AS tf FROM t GROUP BY ALL""")
def figure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with amounts, units, a year and a share for each order: figures stay whole."""
    orders = table(spark, sf_dir, "orders")
    price, share, count = F.col("o_totalprice").cast("decimal(15,2)").cast("string"), (F.col("o_custkey") % 100).cast("string"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0")
    line = F.concat(F.lit("营业收入"), price, F.lit("亿元，"), F.year("o_orderdate").cast("string"), F.lit("年同比增长"), share, F.lit(".5%，共1,"), count, F.lit("万元"))
    return X.postings(orders.select("o_orderkey", line.alias("text")), "o_orderkey", "text")


@query(f"""
WITH {CHUNKS}, t AS (SELECT DISTINCT point_id, unnest({TOKENS}) AS term FROM chunks), n AS (SELECT count(*) AS n FROM chunks),
d AS (SELECT term, count(*) AS df FROM t GROUP BY term), r AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM d, n)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r""")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    stats = X.term_stats(X.postings(rows, "point_id", "text"), rows.count())
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), b AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 256 AS bucket, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS tokens, round(max(n) / sqrt(sum(n * n)), 6) AS heaviest FROM b GROUP BY doc_id""")
def hash_embed_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vectors = X.hashed_vectors(docs, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("buckets"), F.round(F.max("weight"), 6).alias("heaviest"))
    return vectors.join(docs.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens")), "doc_id")


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '\.[A-Za-z0-9]+$', ''), '[^0-9A-Za-z_一-鿿-]+', '_', 'g') AS doc_id FROM pages")
def doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.safe_id(F.col("url")).alias("doc_id"))


@query(f"""
WITH {CHUNKS} SELECT doc_id, chunk_type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(search_text)) AS BIGINT) AS search_chars FROM (
  SELECT doc_id, 'child' AS chunk_type, substr(text, 1, 500) AS text, substr('[' || company || ']' || chr(10) || text, 1, 1000) AS search_text FROM chunks
  UNION ALL SELECT doc_id, 'parent', text, NULL FROM documents) GROUP BY ALL""")
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = documents(spark, sf_dir).select("doc_id", "text")
    children = chunks(spark, sf_dir).withColumn("search_text", C.search_text(F.col("company"), F.lit(""), F.col("text"))).select("doc_id", "text", "search_text")
    rows = X.points(parents, children)
    return rows.groupBy("doc_id", "chunk_type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.length("search_text")).alias("search_chars"))
