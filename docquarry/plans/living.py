"""Queries over an index that grows in batches: what it finds in the end is what an index of all documents finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import search as S
from docquarry.operators import understand as U
from docquarry.operators.segments import SegmentedIndex
from docquarry.plans.corpus import chunks_of, documents
from docquarry.plans.registry import query
from docquarry.plans.retrieval import BM, DIM, HYBRID, METRIC_TRIGGER, METRIC_WORDS, hits_of, queries_of, synonyms, weights
from docquarry.session import Scratch
from docquarry.streaming import jobs


def _grown(spark: SparkSession, sf_dir: str, compacted: bool) -> SegmentedIndex:
    """All documents, by way of stale texts that are replaced, documents that are deleted again, and some that come twice."""
    docs = documents(spark, sf_dir)
    index = SegmentedIndex(spark, f"{Scratch(spark, 'living').path}/index", dim=DIM)
    third, fifth = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 5 = 0")
    passing = docs.filter("doc_id % 7 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    stale = docs.filter("doc_id % 3 <> 0").unionByName(third.withColumn("text", F.reverse("text"))).unionByName(passing)
    index.commit(chunks_of(stale), stale)
    index.commit(chunks_of(third), third.select("doc_id").unionByName(passing.select("doc_id")))
    index.commit(chunks_of(fifth), fifth)
    if compacted:
        index.compact()
    return index


@query(f"WITH {BM} SELECT query_id, point_id, rank, round(score, 6) AS score FROM bm")
def living_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segments with replaced and deleted documents: the same as bm25_topk of a rebuilt index, weights and mean length included."""
    return hits_of(S.lexical(_grown(spark, sf_dir, False).open(), queries_of(spark, sf_dir)))


@query(f"WITH {BM} SELECT query_id, point_id, rank, round(score, 6) AS score FROM bm WHERE rank <= 7")
def living_topk_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of(S.lexical(_grown(spark, sf_dir, True).open(), queries_of(spark, sf_dir), 7))


@query(f"WITH {HYBRID} SELECT query_id, point_id, doc_id, rank, round(score, 6) AS score, round(rerank, 6) AS rerank FROM final")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as a stream of questions, each batch answered by the whole hybrid path over a version of the index."""
    index, path = _grown(spark, sf_dir, True), Scratch(spark, "answers").path
    schema = queries_of(spark, sf_dir).schema
    asked = spark.readStream.schema("item_id long, text string").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/benchmark.parquet*").select(F.col("item_id").cast(schema["query_id"].dataType).alias("query_id"), "text")

    def search(held: S.SearchIndex, questions: DataFrame) -> DataFrame:
        tables = held.chunks.filter(F.contains("text", F.lit("#"))).select("point_id")
        return S.hybrid(held, questions, synonyms(spark), tables, U.metric_query(F.col("text"), METRIC_WORDS, METRIC_TRIGGER), weights(spark))

    jobs.answer_stream(asked, index, search, f"{path}/out", f"{path}/state").awaitTermination()
    return hits_of(spark.read.parquet(f"{path}/out"), "doc_id", F.round("rerank", 6).alias("rerank"))
