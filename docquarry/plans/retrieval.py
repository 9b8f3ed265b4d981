"""Retrieval queries: all benchmark items against all child windows, and dense search over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import words
from docquarry.operators import cells
from docquarry.operators import retrieve as R
from docquarry.operators import search as S
from docquarry.operators import understand as U
from docquarry.plans.corpus import CHUNKS, chunks_of, documents, tokens_sql, words_sql
from docquarry.operators.search import SearchIndex
from docquarry.plans.registry import query
from docquarry.session import READING, Scratch, settings, spread, table

TERMS = tokens_sql()
DIM = 1024

BM = f"""{CHUNKS},
queries AS (SELECT item_id AS query_id, text FROM benchmark),
posted AS (SELECT term, point_id, count(*) AS tf FROM (SELECT point_id, unnest({TERMS}) AS term FROM chunks) GROUP BY ALL),
lens AS (SELECT point_id, sum(tf) AS dl FROM posted GROUP BY point_id),
raw AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), (SELECT count(*) AS n FROM chunks)),
idfs AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TERMS}) AS term FROM queries) GROUP BY ALL),
bs AS (SELECT query_id, point_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM lens)))) AS score FROM posted JOIN qt USING (term) JOIN idfs USING (term) JOIN lens USING (point_id) GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank FROM bs WHERE round(score, 6) > 0 QUALIFY rank <= 20)"""

VEC = f"""
bk AS (SELECT point_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {DIM} AS bucket, sum(tf) AS n FROM posted GROUP BY ALL),
cv AS (SELECT point_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY point_id)) AS w FROM bk),
qb AS (SELECT query_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {DIM} AS bucket, sum(qtf) AS n FROM qt GROUP BY ALL),
qv AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w FROM qb),
vs AS (SELECT query_id, point_id, sum(qv.w * cv.w) AS score FROM qv JOIN cv USING (bucket) GROUP BY ALL),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank FROM vs QUALIFY rank <= 10)"""

WEIGHTS = [("fr", 1.2), ("de", 0.9), ("es", 0.8)]
WEIGHT_CASE = "CASE doc_type WHEN 'fr' THEN 1.2 WHEN 'de' THEN 0.9 WHEN 'es' THEN 0.8 ELSE 1.0 END"
FUSED = """
fused AS (SELECT query_id, point_id, v.rank AS vector_rank, b.rank AS lexical_rank, coalesce(1.5 / (20 + v.rank), 0.0) + coalesce(0.7 / (20 + b.rank), 0.0) AS rrf
  FROM vec v FULL JOIN bm b USING (query_id, point_id)),
weighted AS (SELECT f.query_id, f.point_id, doc_id, company, doc_type, text, rrf * CASE doc_type WHEN 'fr' THEN 1.2 WHEN 'de' THEN 0.9 WHEN 'es' THEN 0.8 ELSE 1.0 END AS score FROM fused f JOIN chunks USING (point_id))"""

DEDUPED = """
two AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 6) DESC, point_id) AS place FROM weighted QUALIFY place <= 2),
deduped AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank FROM two QUALIFY rank <= 40)"""

OVERLAP = f"""
terms AS (SELECT d.*, list_distinct({words_sql('q.text')}) AS qw, {words_sql('d.text')} AS tw FROM deduped d JOIN queries q USING (query_id)),
reranked AS (SELECT query_id, point_id, doc_id, company, doc_type, text, score, list_unique(list_filter(qw, lambda x: x <> '' AND list_contains(tw, x))) / len(list_filter(qw, lambda x: x <> '')) AS rerank FROM terms),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank, 6) DESC, point_id) AS rank FROM reranked)"""

FINAL = """
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS place FROM best WHERE score >= 0.005 QUALIFY place = 1),
final AS (SELECT * EXCLUDE (place, rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM firsts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5)"""

SYNONYMS = [("the", 1, "this"), ("the", 2, "that"), ("les", 1, "ces"), ("los", 1, "esos"), ("und", 1, "sowie"), ("of", 1, "from"), ("of", 2, "by"), ("of", 3, "for")]
_SYN = ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in SYNONYMS)
EXPANDED = f"""
syn AS (SELECT * FROM (VALUES {_SYN}) s(term, prio, synonym) WHERE prio <= 2),
made AS (SELECT query_id, replace(text, term, synonym) AS t, term, prio, text FROM (SELECT item_id AS query_id, text FROM benchmark) q JOIN syn ON contains(text, term)),
uniq AS (SELECT query_id, t, min(term || lpad(CAST(prio AS VARCHAR), 3, '0')) AS o FROM made WHERE t <> text GROUP BY ALL UNION ALL SELECT item_id, text, NULL FROM benchmark),
expanded AS (SELECT query_id, t AS text, row_number() OVER (PARTITION BY query_id ORDER BY o NULLS FIRST, t) AS variant FROM uniq QUALIFY variant <= 3)"""
METRIC_WORDS, METRIC_TRIGGER = ["the", "les", "los"], "(and|et|y) "

_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank"
#: The search among tables, the vector list that it joins, and the lexical list, for the queries in wanting.
TABLED = f"""tqb AS (SELECT query_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {DIM} AS bucket, count(*) AS n FROM (SELECT query_id, unnest({TERMS}) AS term FROM wanting) GROUP BY ALL),
tqv AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS w FROM tqb),
tvs AS (SELECT query_id, point_id, sum(tqv.w * cv.w) AS score FROM tqv JOIN cv USING (bucket) SEMI JOIN tables USING (point_id) GROUP BY ALL),
tvec AS (SELECT *, {_TOP} FROM tvs QUALIFY rank <= 10),
vecb AS (SELECT *, {_TOP} FROM (SELECT query_id, point_id, max(score) AS score FROM (SELECT query_id, point_id, score FROM vecm UNION ALL SELECT query_id, point_id, score * 1.5 FROM tvec) GROUP BY ALL) QUALIFY rank <= 10),
bmb AS (SELECT query_id, point_id, score, {_TOP} FROM (SELECT query_id, point_id, CASE WHEN query_id IN (SELECT query_id FROM wanting) AND point_id IN (SELECT point_id FROM tables) THEN score * 1.5 ELSE score END AS score FROM bmm))"""

#: Lexical and vector search of each query and its first variant, merged by best score; the variants' lists are bm and vec there.
BOTH = f"""{BM.replace('SELECT item_id AS query_id, text FROM benchmark', 'SELECT query_id * 2 + variant - 1 AS query_id, text FROM expanded WHERE variant <= 2').replace(CHUNKS, EXPANDED + ', ' + CHUNKS)}, {VEC},
bmm AS (SELECT *, {_TOP} FROM (SELECT query_id // 2 AS query_id, point_id, max(score) AS score FROM bm GROUP BY ALL) QUALIFY rank <= 20),
vecm AS (SELECT *, {_TOP} FROM (SELECT query_id // 2 AS query_id, point_id, max(score) AS score FROM vec GROUP BY ALL) QUALIFY rank <= 10),
wanting AS (SELECT item_id AS query_id, '表格 ' || text || ' 数据' AS text FROM benchmark WHERE (contains(text, 'the') OR contains(text, 'les') OR contains(text, 'los')) AND regexp_matches(text, '(and|et|y) ')),
tables AS (SELECT point_id FROM chunks WHERE contains(text, '#')),
{TABLED},
base AS (SELECT item_id AS query_id, text FROM benchmark)"""
HYBRID = f"{BOTH}, {FUSED.replace('vec v', 'vecb v').replace('bm b', 'bmb b')}, {DEDUPED}, {OVERLAP.replace('JOIN queries q', 'JOIN base q')}, {FINAL}"


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_INDEXES: dict[tuple[str, str], tuple[Scratch, SearchIndex]] = {}


def index_of(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of all chunks, written once in a session and read by each query while its folder is there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES or not _INDEXES[key][0].holds("chunks", "index", "terms"):
        scratch = Scratch(spark, "index")
        with settings(spark, READING):
            _INDEXES[key] = scratch, SearchIndex.build(chunks_of(spread(documents(spark, sf_dir))), scratch, dim=DIM)
    return _INDEXES[key][1]


def lexical(spark: SparkSession, sf_dir: str, points: str | None = None, asked: DataFrame | None = None, k: int = R.BM25_K) -> DataFrame:
    """BM25 hits. ``points``, a condition, restricts what may be found, before the ranking; statistics are of all chunks."""
    index = index_of(spark, sf_dir)
    return S.lexical(index if points is None else index.only(index.chunks.filter(points)), queries_of(spark, sf_dir) if asked is None else asked, k)


def vectors(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None, k: int = R.VECTOR_K) -> DataFrame:
    return S.vector(index_of(spark, sf_dir), queries_of(spark, sf_dir) if asked is None else asked, k)


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.fuse(vectors(spark, sf_dir), lexical(spark, sf_dir), R.FUSION_K, R.VECTOR_WEIGHT, R.BM25_WEIGHT)
    return R.weigh(fused, index_of(spark, sf_dir).chunks, weights(spark), "doc_type")


def weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEIGHTS, "doc_type string, weight double")


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.at_most_per(weighted(spark, sf_dir), "doc_id")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduped(spark, sf_dir).join(queries_of(spark, sf_dir).withColumnRenamed("text", "query"), "query_id")
    return R.ranked(rows.withColumn("rerank", R.overlap(words(F.col("query")), words(F.col("text")))).drop("query", "rank"), "rerank")


def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYNONYMS, "term string, prio int, synonym string")


def hybrid(spark: SparkSession, sf_dir: str, k: int = R.FINAL_K) -> DataFrame:
    """The whole path over all chunks; those with a mark stand for chunks with a table, documents for parents."""
    index = index_of(spark, sf_dir)
    parents = documents(spark, sf_dir).select("doc_id", F.length("text").alias("parent_chars"))
    return S.hybrid(
        index, queries_of(spark, sf_dir), synonyms(spark), index.chunks.filter(F.contains("text", F.lit("#"))).select("point_id"), U.metric_query(F.col("text"), METRIC_WORDS, METRIC_TRIGGER), weights(spark), parents=parents, k=k
    )


def hits_of(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("query_id", "point_id", "rank", F.round("score", 6).alias("score"), *more)


@query(f"WITH {BM} SELECT query_id, point_id, rank, round(score, 6) AS score FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(lexical(spark, sf_dir))


@query(f"WITH {BM} SELECT query_id, point_id, rank, round(score, 6) AS score FROM bm WHERE rank <= 7")
def bm25_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over an index that was saved and loaded again, without cutting texts into terms."""
    path = f"{Scratch(spark, 'saved-index').path}/index"
    index_of(spark, sf_dir).save(path)
    return hits_of(S.lexical(SearchIndex.load(spark, path), queries_of(spark, sf_dir), 7))


@query(f"""WITH {BM}, f AS (SELECT bs.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank FROM bs JOIN chunks USING (point_id)
  WHERE round(score, 6) > 0 AND (query_id % 3 = 0 OR company = 'src' || (query_id % 20)) QUALIFY rank <= 20)
SELECT query_id, point_id, rank, round(score, 6) AS score FROM f""")
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query names a company, or none; the filter is applied before the ranking, so no query loses recall to it."""
    wanted = F.when(F.pmod("query_id", F.lit(3)) != 0, F.concat(F.lit("src"), F.pmod("query_id", F.lit(20))))
    return hits_of(S.lexical(index_of(spark, sf_dir), queries_of(spark, sf_dir).withColumn("same", wanted), same="company"))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, list_dot_product(q.v, p.v) AS score FROM e q JOIN e p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search of every row whose id is divisible by 100 against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return hits_of(R.dense_topk(asked, rows.select(F.col("vec_id").alias("point_id"), "embedding")))


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, list_dot_product(q.v, p.v) AS score FROM e q JOIN e p ON q.vec_id <> p.vec_id AND q.label = p.label WHERE q.vec_id % 100 = 0)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return hits_of(R.dense_topk(asked, rows.select(F.col("vec_id").alias("point_id"), "embedding", "label"), same="label"))


@query("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, list_dot_product(q.v, p.v) AS score FROM e q JOIN e p ON q.vec_id <> p.vec_id AND q.label = p.label WHERE q.vec_id % 100 = 0)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10""")
def vector_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by cells: only the folders of the labels asked for, and in them only blocks that the triangle inequality leaves open."""
    rows, path = table(spark, sf_dir, "embeddings"), f"{Scratch(spark, 'vector-cells').path}/cells"
    cells.build(rows.select(F.col("vec_id").alias("point_id"), "embedding", "label"), path, "label")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return hits_of(cells.search(spark, path, asked, same="label"))


def expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.expand_queries(queries_of(spark, sf_dir), synonyms(spark))


@query(f"WITH {EXPANDED} SELECT query_id, variant, text FROM expanded")
def expand_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(spark, sf_dir)


@query(f"""
WITH {BM.replace('SELECT item_id AS query_id, text FROM benchmark', 'SELECT query_id * 10 + variant AS query_id, text FROM expanded WHERE variant <= 2').replace(CHUNKS, EXPANDED + ', ' + CHUNKS)},
m AS (SELECT query_id // 10 AS query_id, point_id, max(score) AS score FROM bm GROUP BY ALL)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank, round(score, 6) AS score FROM m QUALIFY rank <= 20""")
def merge_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query and its first variant, merged by the best score of each point."""
    found = lexical(spark, sf_dir, asked=S.variants(queries_of(spark, sf_dir), synonyms(spark)))
    return hits_of(R.merge_max(found.withColumn("query_id", S.base_id(F.col("query_id"))), k=20))


#: What asks for a figure here, besides the words of METRIC_WORDS; and the word for figures as terms.
METRIC_ASKS = ["and ", "et ", "y "]
_NAMED = "array_to_string(list_filter(%s, lambda w: contains(text, w))[:3], ' ')" % METRIC_WORDS
WANTING = f"""
wanting AS (SELECT item_id AS query_id, text || ' 表格 ' || coalesce(nullif({_NAMED}, ''), '财务 务指 指标') || ' 数据' AS text FROM benchmark WHERE len(list_filter({METRIC_WORDS + METRIC_ASKS}, lambda w: contains(text, w))) > 0 OR regexp_matches(text, '{U.FIGURE_QUESTION}')),
tables AS (SELECT point_id FROM chunks WHERE contains(text, '|'))"""


@query(f"""
WITH {BM}, {VEC}, {WANTING}, {TABLED.replace('FROM vecm', 'FROM vec').replace('FROM bmm', 'FROM bm')}
SELECT query_id, point_id, rank, round(score, 6) AS score, 1 AS list FROM vecb UNION ALL SELECT query_id, point_id, rank, round(score, 6), 2 FROM bmb""")
def table_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of vector (1) and lexical search (2) with tables boosted, for the queries that ask for a figure; a window with a pipe holds a table."""
    index, asked = index_of(spark, sf_dir), queries_of(spark, sf_dir)
    tables, wants = index.chunks.filter(F.contains("text", F.lit("|"))), U.asks_for_figure(F.col("text"), METRIC_WORDS, METRIC_ASKS)
    vec, lex = S.boost_tables(index, asked, vectors(spark, sf_dir), lexical(spark, sf_dir), tables, wants, METRIC_WORDS)
    return hits_of(vec, F.lit(1).alias("list")).unionByName(hits_of(lex, F.lit(2).alias("list")))


@query(f"WITH {BM}, {VEC}, {FUSED} SELECT query_id, point_id, vector_rank, lexical_rank, round(rrf, 6) AS score FROM fused")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.fuse(vectors(spark, sf_dir), lexical(spark, sf_dir), R.FUSION_K, R.VECTOR_WEIGHT, R.BM25_WEIGHT)
    return rows.select("query_id", "point_id", "vector_rank", "lexical_rank", F.round("score", 6).alias("score"))


@query(f"WITH {BM}, {VEC}, {FUSED} SELECT query_id, point_id, doc_type, round(score, 6) AS score FROM weighted")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted(spark, sf_dir).select("query_id", "point_id", "doc_type", F.round("score", 6).alias("score"))


@query(f"WITH {BM}, {VEC}, {FUSED}, {DEDUPED} SELECT query_id, point_id, rank, round(score, 6) AS score FROM deduped")
def dedup_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(deduped(spark, sf_dir))


@query(f"WITH {BM}, {VEC}, {FUSED}, one AS (SELECT * FROM weighted QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 6) DESC, point_id) = 1) SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank, round(score, 6) AS score FROM one QUALIFY rank <= 40")
def dedup_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(R.at_most_per(weighted(spark, sf_dir), "doc_id", each=1))


@query(f"WITH {BM}, {VEC}, {FUSED}, {DEDUPED}, f AS (SELECT * FROM deduped QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) = 1) SELECT query_id, point_id, rank, round(score, 6) AS score, doc_id, length(d.text) AS parent_chars FROM f JOIN documents d USING (doc_id)")
def attach_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.first_of_each(deduped(spark, sf_dir), "doc_id").drop("text")
    return hits_of(rows.join(documents(spark, sf_dir).select("doc_id", F.length("text").alias("parent_chars")), "doc_id", "left"), "doc_id", "parent_chars")


@query(f"WITH {BM}, {VEC}, {FUSED}, {DEDUPED} SELECT query_id, count(*) AS n, round(min(score), 6) AS least FROM deduped WHERE score >= 0.03 GROUP BY query_id")
def min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).filter("score >= 0.03").groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least"))


@query(f"""
WITH {BM}, {VEC}, {FUSED}, {DEDUPED} SELECT query_id, coalesce(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 3 THEN score END) < 0.03, false) AS close, max(score) < 0.35 AS weak,
  count(*) >= 8 AND stddev_pop(CASE WHEN rank <= 8 THEN score END) < 0.05 AS flat FROM deduped GROUP BY query_id""")
def rerank_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rerank_flags(deduped(spark, sf_dir))


@query(f"WITH {BM}, {VEC}, {FUSED}, {DEDUPED}, {OVERLAP} SELECT query_id, point_id, rank, round(score, 6) AS score, round(rerank, 6) AS rerank FROM best")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(reranked(spark, sf_dir), F.round("rerank", 6).alias("rerank"))


@query(f"WITH {HYBRID} SELECT query_id, point_id, rank, round(score, 6) AS score, doc_id, round(rerank, 6) AS rerank, length(d.text) AS parent_chars FROM final JOIN documents d USING (doc_id)")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(hybrid(spark, sf_dir), "doc_id", F.round("rerank", 6).alias("rerank"), "parent_chars")


_STRICT = "strict AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank FROM bs SEMI JOIN (SELECT point_id FROM chunks WHERE doc_type = 'fr') USING (point_id) WHERE round(score, 6) > 0 QUALIFY rank <= 15)"


@query(f"""
WITH {BM}, {_STRICT}, f AS (SELECT query_id, max(score) AS best, count(*) AS n FROM strict GROUP BY query_id),
poor AS (SELECT DISTINCT query_id FROM bm LEFT JOIN f USING (query_id) WHERE coalesce(best, 0) < 20 AND coalesce(n, 0) < 16),
r AS (SELECT query_id, point_id, CASE WHEN query_id IN (SELECT query_id FROM poor) THEN score * 1.2 ELSE score END AS score, 1 AS stage FROM strict
  UNION ALL SELECT query_id, point_id, score, 2 FROM bm WHERE query_id IN (SELECT query_id FROM poor) AND NOT EXISTS (SELECT 1 FROM strict s WHERE s.query_id = bm.query_id AND s.point_id = bm.point_id))
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY stage, round(score, 6) DESC, point_id) AS rank, round(score, 6) AS score, stage FROM r""")
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = lexical(spark, sf_dir, "doc_type = 'fr'", k=15)
    return hits_of(R.two_stage(strict, lexical(spark, sf_dir), threshold=20.0, least=16), "stage")


@query(f"""
WITH {BM}, {_STRICT}, e AS (SELECT query_id FROM strict GROUP BY query_id HAVING count(*) >= 15)
SELECT query_id, point_id, rank, round(score, 6) AS score FROM strict SEMI JOIN e USING (query_id) UNION ALL SELECT query_id, point_id, rank, round(score, 6) FROM bm ANTI JOIN e USING (query_id)""")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = lexical(spark, sf_dir, "doc_type = 'fr'", k=15)
    return hits_of(R.or_unfiltered(strict, lexical(spark, sf_dir), least=15))


#: Questions about parts, of every class of the router, with none to two entities.
_ASKS = ["compare {} with the others", "营业收入同比增长率 {}", "the growth of {}", "our views on {}", "please summarize {}", "how much is {}", "名称是什么 {}", "{} and so on", "研报观点 {}", "calculated by {}", "reviews of {}"]
_ASKED = "CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN replace('{x}', '{{}}', p_name)" for i, x in enumerate(_ASKS)) + " END"
_ROUTED = " ".join(f"WHEN p_partkey % 3 >= 2 THEN '{name}'" if pattern is None else f"WHEN regexp_matches(lower({_ASKED}), '{pattern}') THEN '{name}'" for name, pattern in U.ROUTES)


@query(f"SELECT p_partkey AS query_id, CASE {_ROUTED} ELSE 'none' END AS intent FROM part")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router's own rules on questions in both languages."""
    ask = F.element_at(F.array(*map(F.lit, _ASKS)), (F.col("p_partkey") % 11 + 1).cast("int"))
    names = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("p_partkey") % 3).cast("int"))
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.replace(ask, F.lit("{}"), F.col("p_name")).alias("text"), names.alias("entities"))
    return U.routes(asked).select("query_id", "intent")


#: The vocabulary: the 100 most frequent words of 6 letters or more of all documents, each with the source that holds it most often.
VOCAB = f"""
voc AS (SELECT term, source, count(*) AS n FROM (SELECT source, unnest(list_filter({words_sql()}, lambda x: length(x) >= 6)) AS term FROM documents) GROUP BY ALL),
names AS (SELECT term AS name, arg_min(source, (-n, source)) AS company, row_number() OVER (ORDER BY sum(n) DESC, term) AS place FROM voc GROUP BY term QUALIFY place <= 100)"""


_VOCABULARIES: dict[tuple[str, str], tuple[Scratch, DataFrame]] = {}


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, company, place), made of all documents once in a session, as the index is."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VOCABULARIES or not _VOCABULARIES[key][0].holds("names"):
        terms = documents(spark, sf_dir).select("source", F.explode(F.filter(words(F.col("text")), lambda w: F.length(w) >= 6)).alias("name")).groupBy("name", "source").agg(F.count("*").alias("n"))
        top = terms.groupBy("name").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "source")).alias("of")).orderBy(F.col("total").desc(), "name").limit(100)
        names = top.select("name", F.col("of.source").alias("company"), F.row_number().over(R.Window.orderBy(F.col("total").desc(), "name")).alias("place"))
        scratch = Scratch(spark, "vocabulary")
        _VOCABULARIES[key] = scratch, scratch.save("names", names)
    return _VOCABULARIES[key][1]


INTENT_NAMES = ["comparative", "comparative", "summary", "analytical", "computational"]
INTENTS = f"""{VOCAB},
irules AS (SELECT name AS keyword, {INTENT_NAMES}[(place - 1) % 5 + 1] AS intent, (place - 1) % 5 AS prio FROM names),
intents AS (SELECT item_id AS query_id, text, coalesce((SELECT arg_min(intent, prio) FROM irules WHERE contains(lower(text), keyword)), 'factual') AS intent FROM benchmark)"""


def with_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the vocabulary stand for the keywords of each intent in turn."""
    turn = F.pmod(F.col("place") - 1, F.lit(5))
    rules = vocabulary(spark, sf_dir).select(F.col("name").alias("keyword"), F.get(F.array(*map(F.lit, INTENT_NAMES)), turn).alias("intent"), turn.alias("prio"))
    return U.intents(queries_of(spark, sf_dir), rules)


@query(f"WITH {INTENTS} SELECT query_id, intent FROM intents")
def intent_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_intent(spark, sf_dir).select("query_id", "intent")


ENTITIES = f"""{VOCAB},
ents AS (SELECT item_id AS query_id, text, coalesce((SELECT list_sort(list(name)) FROM names WHERE contains(text, name)), []) AS entities FROM benchmark)"""
ROUTER = [("comparative", "than|[0-9] vs"), ("computational", "[0-9]"), ("multi_entity", None), ("theme", "ción "), ("summarization", "les .*des "), ("factual", "what |that ")]
_CASES = " ".join("WHEN " + (f"regexp_matches(lower(text), '{p}')" if p else "len(entities) >= 2") + f" THEN '{n}'" for n, p in ROUTER)
ROUTED = f"routed AS (SELECT query_id, text, entities, CASE {_CASES} ELSE 'none' END AS route FROM ents)"


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.routes(with_entities(spark, sf_dir), ROUTER)


@query(f"WITH {INTENTS} SELECT query_id, intent, k, use_rerank, mode FROM intents LEFT JOIN (VALUES {', '.join(str(x).replace('False', 'false').replace('True', 'true') for x in U.STRATEGIES)}) s(intent, k, use_rerank, mode) USING (intent)")
def strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = U.strategies(with_intent(spark, sf_dir), spark.createDataFrame(U.STRATEGIES, "intent string, k int, use_rerank boolean, mode string"))
    return rows.select("query_id", "intent", "k", "use_rerank", "mode")


@query(f"""
WITH {BM}, {INTENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank FROM (SELECT bs.* FROM bs JOIN intents i USING (query_id) JOIN chunks c USING (point_id) WHERE (i.intent <> 'summary' OR c.doc_type = 'fr') AND round(score, 6) > 0) QUALIFY rank <= 20)
SELECT query_id, point_id, rank, round(score, 6) AS score FROM f""")
def intent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary questions only read one kind of document; the filter stands below the ranking."""
    rows = with_intent(spark, sf_dir).select("query_id", "text", "intent")
    only = lexical(spark, sf_dir, "doc_type = 'fr'", rows.filter("intent = 'summary'"))
    return hits_of(only.unionByName(lexical(spark, sf_dir, asked=rows.filter("intent <> 'summary'"))))


@query("SELECT item_id AS query_id, (contains(text, 'the') OR contains(text, 'les') OR contains(text, 'los')) AND regexp_matches(text, '(and|et|y) ') AS is_metric FROM benchmark")
def metric_query_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_of(spark, sf_dir).select("query_id", U.metric_query(F.col("text"), METRIC_WORDS, METRIC_TRIGGER).alias("is_metric"))


def with_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queries_of(spark, sf_dir)
    return rows.join(U.entities(rows, vocabulary(spark, sf_dir)), "query_id")


@query(f"WITH {ENTITIES}, {ROUTED} SELECT query_id, route AS intent, CASE WHEN route <> 'none' THEN CAST(0.8 AS DOUBLE) END AS confidence FROM routed")
def intent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir)


@query(f"""WITH {ENTITIES}, {ROUTED} SELECT CASE WHEN route = 'computational' THEN 'compute' WHEN route = 'comparative' OR len(entities) >= 2 THEN 'fan_out' WHEN route IN ('theme', 'summarization', 'summary') THEN 'gather'
  WHEN route = 'factual' THEN 'light' ELSE 'search' END AS branch, count(*) AS n FROM routed GROUP BY branch""")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries take each branch of answering."""
    rows = routed(spark, sf_dir).join(with_entities(spark, sf_dir).select("query_id", "entities"), "query_id")
    return rows.groupBy(U.branch(F.col("intent"), F.size("entities"), F.col("intent") == "factual").alias("branch")).agg(F.count("*").alias("n"))


@query(f"WITH {ENTITIES} SELECT query_id, array_to_string(entities, ',') AS entities, len(entities) >= 2 AS multi FROM ents")
def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_entities(spark, sf_dir).select("query_id", F.array_join("entities", ",").alias("entities"), "multi")


@query(f"""
WITH {ENTITIES}, p AS (SELECT query_id, text, entities, unnest(entities) AS entity FROM ents),
s AS (SELECT query_id, entity, text, trim(regexp_replace(replace(list_reduce(list_prepend(text, list_filter(entities, lambda e: e <> entity)), lambda a, e: replace(a, e, '')), 'than', ''), ' +', ' ', 'g')) AS t FROM p)
SELECT query_id, entity, CASE WHEN length(t) < 4 THEN entity || ' ' || substr(text, 1, 30) ELSE t END AS text FROM s""")
def strip_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.strip_entities(with_entities(spark, sf_dir), ["than"])


@query(f"WITH {ENTITIES}, {INTENTS.replace(VOCAB + ',', '')} SELECT query_id, intent = 'factual' AND len(entities) <= 1 AND NOT contains(e.text, 'than') AS light FROM ents e JOIN intents i USING (query_id)")
def light_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_entities(spark, sf_dir).join(with_intent(spark, sf_dir).select("query_id", "intent"), "query_id")
    return rows.select("query_id", U.light(F.col("intent"), F.size("entities"), F.contains("text", F.lit("than"))).alias("light"))


@query(f"WITH {VOCAB} SELECT item_id AS query_id, nullif(regexp_extract(text || ' in ' || (2000 + item_id), '(20\\d{{2}})', 1), '') AS year, (SELECT company FROM names WHERE contains(b.text, name) ORDER BY place % 2, length(name) DESC, name LIMIT 1) AS name FROM benchmark b")
def query_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queries_of(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" in "), F.col("query_id") + 2000))
    names = vocabulary(spark, sf_dir).select(F.col("name").alias("alias"), F.col("company").alias("name"), F.pmod("place", F.lit(2)).alias("tier"))
    return rows.join(U.longest_entity(rows, names), "query_id", "left").select("query_id", U.year_of(F.col("text")).alias("year"), "name")


_STRIPPED = """
p AS (SELECT query_id, text, entities, unnest(entities) AS entity FROM ents),
s AS (SELECT query_id, entity, text, trim(regexp_replace(replace(list_reduce(list_prepend(text, list_filter(entities, lambda e: e <> entity)), lambda a, e: replace(a, e, '')), 'than', ''), ' +', ' ', 'g')) AS t FROM p),
stripped AS (SELECT query_id, entity, CASE WHEN length(t) < 4 THEN entity || ' ' || substr(text, 1, 30) ELSE t END AS text FROM s),
subs AS (SELECT r.query_id * 1000 + row_number() OVER (PARTITION BY r.query_id ORDER BY entity) AS sub_id, r.query_id, entity, text, company, greatest(8, 12 // count(*) OVER (PARTITION BY r.query_id)) AS n FROM stripped r JOIN names ON entity = name)"""
#: Hybrid search of each entity's own question among the chunks of its company.
SUB_BM = BM.replace("SELECT item_id AS query_id, text FROM benchmark", "SELECT sub_id AS query_id, text FROM subs").replace(CHUNKS, f"{ENTITIES}, {_STRIPPED}, {CHUNKS}")
SUB = (
    SUB_BM.replace("bm AS (SELECT *, row_number() OVER (PARTITION BY query_id", f"bo AS (SELECT bs.* FROM (SELECT query_id AS qid, * EXCLUDE (query_id) FROM bs) x JOIN (SELECT point_id AS pid, company AS of FROM chunks) c ON c.pid = x.point_id JOIN subs ON sub_id = qid AND subs.company = c.of JOIN bs ON bs.query_id = qid AND bs.point_id = x.point_id),\nbm AS (SELECT *, row_number() OVER (PARTITION BY query_id").replace("FROM bs WHERE", "FROM bo WHERE")
    + ", "
    + VEC.replace("FROM vs QUALIFY", "FROM (SELECT vs.* FROM vs JOIN chunks USING (point_id) JOIN subs ON sub_id = vs.query_id AND subs.company = chunks.company) QUALIFY")
    + f", {FUSED.replace(WEIGHT_CASE, '1.0')}, {DEDUPED}, {OVERLAP}, {FINAL.replace('<= 5)', '<= 100)')}"
)


def sub_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, entity, text, same): each entity's question and its company."""
    rows = U.strip_entities(with_entities(spark, sf_dir), ["than"])
    return rows.join(vocabulary(spark, sf_dir).select(F.col("name").alias("entity"), F.col("company").alias("same")), "entity")


@query(f"WITH {SUB} SELECT s.query_id, entity, point_id, rank, round(score, 6) AS score FROM final f JOIN subs s ON s.sub_id = f.query_id WHERE rank <= 5")
def subquestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity of a query is a query of its own, among the chunks of its company."""
    rows = sub_questions(spark, sf_dir).withColumn("sub_id", F.xxhash64("query_id", "entity"))
    hits = S.hybrid(index_of(spark, sf_dir), rows.select(F.col("sub_id").alias("query_id"), "text", "same"), same="company").withColumnRenamed("query_id", "sub_id")
    return hits_of(hits.join(rows.select("sub_id", "query_id", "entity"), "sub_id"), "entity")


@query(f"""
WITH {SUB}, u AS (SELECT s.query_id, doc_id, point_id, score FROM final f JOIN subs s ON s.sub_id = f.query_id WHERE rank <= n),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 6) DESC, point_id) = 1)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, point_id) AS rank, round(score, 6) AS score FROM o QUALIFY rank <= 12""")
def multi_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-queries' hits as one list: the best of each document, cut at 12."""
    return hits_of(S.fan_out(index_of(spark, sf_dir), sub_questions(spark, sf_dir), total=12))


@query(f"""
WITH {BM}, {VEC}, {INTENTS}, h AS (SELECT v.query_id, point_id, v.rank, v.score, doc_id FROM vec v JOIN chunks USING (point_id) WHERE v.rank <= 8), m AS (SELECT b.query_id, point_id, b.rank, b.score, doc_id FROM bm b JOIN chunks USING (point_id)),
r AS (SELECT *, 1 AS list FROM h UNION ALL SELECT *, 2 FROM m ANTI JOIN h USING (query_id, doc_id)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list, rank, point_id) AS k FROM r)
SELECT query_id, point_id, k AS rank, round(score, 6) AS score, list FROM o JOIN intents USING (query_id) WHERE k <= CASE WHEN intent IN ('summary', 'analytical') THEN 20 ELSE 8 END""")
def wide_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries and analyses take 20 hits, others 8; the lexical list fills up."""
    of = index_of(spark, sf_dir).chunks.select("point_id", "doc_id")
    rows = S.wide_recall(R.of_points(vectors(spark, sf_dir, k=8), of), with_intent(spark, sf_dir), R.of_points(lexical(spark, sf_dir), of), "doc_id", 8)
    return hits_of(rows, "list")


@query(f"""
WITH {BM}, {VEC}, {FUSED}, {DEDUPED}, {ENTITIES}, {INTENTS.replace(VOCAB + ',', '')}, fl AS (SELECT query_id, coalesce(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 3 THEN score END) < 0.03, false) AS close, max(score) < 0.35 AS weak,
  count(*) >= 8 AND stddev_pop(CASE WHEN rank <= 8 THEN score END) < 0.05 AS flat FROM deduped GROUP BY query_id),
r AS (SELECT query_id, CASE WHEN regexp_matches(lower(e.text), 'than') THEN 'pattern 0' WHEN regexp_matches(lower(e.text), 'what ') THEN 'pattern 1' WHEN len(entities) >= 2 THEN 'entities' WHEN intent IN ('analytical', 'comparative') THEN 'intent'
  WHEN close THEN 'close' WHEN weak THEN 'weak' WHEN flat THEN 'flat' END AS reason FROM ents e JOIN intents USING (query_id) LEFT JOIN fl USING (query_id))
SELECT query_id, reason IS NOT NULL AS wanted, reason FROM r""")
def rerank_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = with_entities(spark, sf_dir).join(with_intent(spark, sf_dir).select("query_id", "intent"), "query_id")
    return R.rerank_wanted(asked, deduped(spark, sf_dir), "than", "what ")


@query(f"""
WITH {BM}, {_STRICT}, f AS (SELECT query_id, max(score) AS best FROM strict GROUP BY query_id) SELECT q.query_id, coalesce(best < 20, true) AS too_strict FROM queries q LEFT JOIN f USING (query_id)""")
def too_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.too_strict(queries_of(spark, sf_dir), lexical(spark, sf_dir, "doc_type = 'fr'", k=15), 20.0)


@query(f"""
WITH {BM}, {VEC}, {FUSED}, {DEDUPED}, once AS (SELECT * EXCLUDE (rank) FROM deduped QUALIFY row_number() OVER (PARTITION BY query_id, md5(substr(text, 1, 300)) ORDER BY round(score, 6) DESC, point_id) = 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, company ORDER BY round(score, 6) DESC, point_id) AS place FROM once)
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY place > 2, round(score, 6) DESC, point_id) AS rank, round(score, 6) AS score FROM pl QUALIFY rank <= 8""")
def diversity_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(R.diverse(deduped(spark, sf_dir), "company", "text"))


@query(f"""
WITH {BM}, {VEC}, h AS (SELECT v.query_id, point_id, v.rank, v.score, doc_id FROM vec v JOIN chunks USING (point_id) WHERE v.rank <= 3), m AS (SELECT b.query_id, point_id, b.rank, b.score, doc_id FROM bm b JOIN chunks USING (point_id)),
r AS (SELECT *, 1 AS list FROM h UNION ALL SELECT *, 2 FROM m ANTI JOIN h USING (query_id, doc_id))
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY list, rank, point_id) AS rank, round(score, 6) AS score, list FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list, rank, point_id) <= 10""")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = index_of(spark, sf_dir).chunks.select("point_id", "doc_id")
    rows = R.backfill(R.of_points(vectors(spark, sf_dir, k=3), of), R.of_points(lexical(spark, sf_dir), of), "doc_id", 10)
    return hits_of(rows, "list")


STATED = f"""{VOCAB}, statements AS (SELECT a.name AS term, b.name || ' ' || c.name AS statement FROM names a JOIN names b ON b.place = a.place % 100 + 1 JOIN names c ON c.place = (a.place + 6) % 100 + 1)"""
ST_BM = BM.replace("SELECT item_id AS query_id, text FROM benchmark", "SELECT sid AS query_id, statement AS text FROM stq").replace(CHUNKS, STATED + ", stq AS (SELECT row_number() OVER (ORDER BY statement) AS sid, statement FROM (SELECT DISTINCT statement FROM statements)), " + CHUNKS)


@query(f"""
WITH {ST_BM.replace('rank <= 20', 'rank <= 5')},
bqt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL), {VEC.replace('FROM qt GROUP', 'FROM bqt GROUP')},
h AS (SELECT query_id, point_id, rank, score FROM vec WHERE score >= 0.35), few AS (SELECT query_id FROM h GROUP BY query_id HAVING count(*) >= 6),
asks AS (SELECT DISTINCT item_id AS query_id, sid FROM benchmark JOIN statements ON contains(text, term) JOIN stq USING (statement) WHERE item_id NOT IN (SELECT query_id FROM few)),
m AS (SELECT asks.query_id, point_id, max(score) AS score FROM asks JOIN bm ON bm.query_id = sid GROUP BY ALL), mr AS (SELECT *, {_TOP} FROM m),
r AS (SELECT query_id, point_id, rank, score, 1 AS list FROM h UNION ALL SELECT query_id, point_id, rank, score, 2 FROM mr ANTI JOIN h USING (query_id, point_id))
SELECT query_id, point_id, row_number() OVER (PARTITION BY query_id ORDER BY list, rank, point_id) AS rank, round(score, 6) AS score, list FROM r""")
def augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a search finds under 6 good hits, the statements of a query's terms are searched too; a word's statement is two other words."""
    names = vocabulary(spark, sf_dir)
    at = lambda step, name: names.select((F.pmod(F.col("place") - 1 - step, F.lit(100)) + 1).alias("place"), F.col("name").alias(name))
    statements = names.join(at(1, "b"), "place").join(at(7, "c"), "place").select(F.col("name").alias("term"), F.concat_ws(" ", "b", "c").alias("statement"))
    return hits_of(S.augment(index_of(spark, sf_dir), queries_of(spark, sf_dir), vectors(spark, sf_dir).filter("score >= 0.35"), statements), "list")


@query(f"""
WITH {HYBRID}, b AS (SELECT query_id, rank, '[' || rank || '] ' || text AS block FROM final), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM b)
SELECT query_id, count(*) AS blocks, md5(string_agg(block, chr(10) || '---' || chr(10) ORDER BY rank)) AS digest FROM u WHERE upto <= 1500 OR upto = length(block) GROUP BY query_id""")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contexts(hybrid(spark, sf_dir), "text", 1500).select("query_id", "blocks", F.md5("context").alias("digest"))


@query(f"WITH {HYBRID} SELECT query_id, point_id, rank AS idx, company, doc_type, 'doc_' || doc_id AS source FROM final")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.citations(hybrid(spark, sf_dir)).select("query_id", "point_id", "idx", "company", "doc_type", F.concat(F.lit("doc_"), "doc_id").alias("source"))


@query(f"""
WITH {HYBRID}, f AS (SELECT query_id, max(score) AS best, count(*) FILTER (score > 0) AS n, list(DISTINCT company) AS cs FROM final GROUP BY query_id)
SELECT q.query_id, coalesce(best < 0.005, true) OR coalesce(n <= 1, true) OR NOT coalesce(list_has_any(['src' || (q.query_id % 20)], cs), false) AS reject FROM base q LEFT JOIN f USING (query_id)""")
def reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries_of(spark, sf_dir).withColumn("wanted", F.array(F.concat(F.lit("src"), F.col("query_id") % 20)))
    return R.rejected(hybrid(spark, sf_dir), asked, "wanted", "company")


@query(f"""
WITH {HYBRID}, g AS (SELECT query_id, company, doc_type, rank, text, row_number() OVER (PARTITION BY query_id, company, doc_type ORDER BY rank) AS i FROM final)
SELECT query_id, company, doc_type, count(*) AS n, least(5, 2 * count(*)) AS points, md5(string_agg(i || '. ' || substr(text, 1, 1000), chr(10) ORDER BY rank)) AS digest FROM g GROUP BY ALL""")
def group_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.grouped(hybrid(spark, sf_dir), "text", "company", "doc_type").withColumn("digest", F.md5("body")).drop("body")


@query(f"""
WITH {BM}, {VEC}, {FUSED}, {DEDUPED}, g AS (SELECT query_id, doc_id, min(rank) AS first, substr(string_agg(substr(text, 1, 2000), chr(10) ORDER BY rank), 1, 4000) AS body FROM deduped GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first) AS place, md5(body) AS digest FROM g QUALIFY place <= 15""")
def docs_from_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.documents_of(deduped(spark, sf_dir), "doc_id", "text").withColumn("digest", F.md5("body")).drop("body")


@query("SELECT doc_id AS query_id, min(doc_id) OVER (PARTITION BY lower(trim(text))) AS answer_id FROM documents")
def dedup_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.lower(F.trim("text")).alias("key"))
    return R.once_each(rows, "key")[1]


@query("SELECT page_id, CAST(max(ts) AS VARCHAR) AS opened FROM pages LEFT JOIN events ON user_id = page_id WHERE contains(lower(url), '1') OR contains(lower(html), '1') OR contains(CAST(page_id AS VARCHAR), '1') GROUP BY page_id")
def doc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents one of whose fields contains the search text, recently opened ones first."""
    opened = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page_id")).agg(F.max("ts").alias("opened"))
    rows = R.find_documents(table(spark, sf_dir, "pages"), "1", "url", "html", "page_id", opened=opened, key="page_id")
    return rows.select("page_id", F.col("opened").cast("string").alias("opened"))
