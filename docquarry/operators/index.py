"""Building the indexes as tables: chunk points, hashed vectors, postings and BM25 statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import bucket, point_id, tokens


def embed(frame: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 200) -> DataFrame:
    """``frame`` with ``embedding``, L2-normalised; ``encoder()`` loads the caller's model once in each task."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema] + ["embedding array<float>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for rows in batches:
            vectors: list[list[float]] = []
            for i in range(0, len(rows), batch):
                for v in encode(rows[text].iloc[i : i + batch].fillna("").tolist()):
                    norm = sum(x * x for x in v) ** 0.5 or 1.0
                    vectors.append([x / norm for x in v])
            yield rows.assign(embedding=vectors)

    return frame.mapInPandas(run, schema)


def _terms(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term). The outer form, or Spark would cut each text a second time only to see whether it has terms."""
    return frame.select(key, F.explode_outer(tokens(F.col(text))).alias("term")).filter("term is not null")


def hashed_vectors(frame: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, bucket, weight): sparse L2-normalised counts of hashed tokens, the default encoder that needs no model."""
    counts = _terms(frame, key, text).groupBy(key, bucket(F.col("term"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def vectors_of_postings(posted: DataFrame, key: str, dim: int = 256, n: str = "tf") -> DataFrame:
    """The same vectors from postings (term, key, n), which saves reading the texts again."""
    counts = posted.groupBy(key, bucket(F.col("term"), dim).alias("bucket")).agg(F.sum(n).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf)."""
    return _terms(chunks, key, text).groupBy("term", key).agg(F.count("*").alias("tf"))


def doc_stats(posted: DataFrame, key: str) -> DataFrame:
    """(key, dl): tokens of each chunk."""
    return posted.groupBy(key).agg(F.sum("tf").alias("dl"))


def term_stats(posted: DataFrame, n_docs: Column | int, idf: str = "okapi_floor") -> DataFrame:
    """(term, df, idf). ``okapi_floor``: negative values become a quarter of the mean; ``plus_one``: never negative."""
    return weighted_terms(posted.groupBy("term").agg(F.count("*").alias("df")), n_docs, idf)


def weighted_terms(counts: DataFrame, n_docs: Column | int, idf: str = "okapi_floor") -> DataFrame:
    """The same from (term, df)."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    ratio = (n - F.col("df") + 0.5) / (F.col("df") + 0.5)
    if idf == "plus_one":
        return counts.withColumn("idf", F.log(ratio + 1))
    raw = counts.withColumn("raw", F.log(ratio))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def points(parents: DataFrame, children: DataFrame, text_chars: int | None = 500, search_chars: int | None = 1000) -> DataFrame:
    """Parents and children as one table of points, with whatever else they carry as payload.

    Of a child's texts the first characters are stored: ``text_chars`` of its text, ``search_chars`` of its search text; None stores them whole."""
    cut = lambda name, n: F.substring(name, 1, n) if n else F.col(name)
    child = children.withColumns({"text": cut("text", text_chars), "search_text": cut("search_text", search_chars), "is_parent": F.lit(False), "chunk_type": F.lit("child")})
    return parents.withColumns({"is_parent": F.lit(True), "chunk_type": F.lit("parent")}).unionByName(child, allowMissingColumns=True)


def document_points(parents: DataFrame, children: DataFrame, metadata: DataFrame, collection: str, on: str = "doc_id", text_chars: int | None = 500, search_chars: int | None = 1000) -> DataFrame:
    """The points of chunk_corpus' parents and children with their documents' ``metadata`` as payload; ids are hashes of what they name."""
    key = lambda *level: point_id(F.lit(collection), F.col(on).cast("string"), *level)
    of = lambda frame: frame.join(metadata, on, "left").withColumn("collection", F.lit(collection))
    above = of(parents).withColumns({"point_id": key(F.lit("parent"), F.col("parent")), "chunk_index": F.col("parent")})
    below = of(children).withColumns({"point_id": key(F.lit("child"), F.col("parent"), F.col("child")), "parent_id": key(F.lit("parent"), F.col("parent")), "chunk_index": F.col("child"), "char_count": F.length("text")})
    return points(above, below, text_chars, search_chars)


def outline_points(points: DataFrame, outlines: DataFrame, force: bool = False, chars: int = 60) -> DataFrame:
    """``points`` and the outlines (doc_id, section_order, section, outline_text, text) that they lack; ``force`` replaces those they hold.

    Outlines are searched like children (is_parent is false), count 1.3 times as much, and carry the first ``chars`` characters of their outline as a title."""
    new = outlines.select(
        point_id(F.lit("outline"), F.col("doc_id").cast("string"), F.col("section_order")).alias("point_id"), "doc_id", "section", "section_order", "text", "outline_text", F.col("outline_text").alias("search_text"),
        F.lit("outline").alias("chunk_type"), F.lit(False).alias("is_parent"), F.lit(1.3).alias("importance"), F.length("text").alias("char_count"), F.lit(False).alias("has_table"), F.concat(F.lit("【概要】"), F.substring("outline_text", 1, chars)).alias("prefix_title"),
    )
    keep = points.join(new.select("point_id"), "point_id", "left_anti") if force else points
    more = new if force else new.join(points.select("point_id"), "point_id", "left_anti")
    return keep.unionByName(more, allowMissingColumns=True)


def summary_points(sections: DataFrame, doc_type: str = "AI摘要", section: str = "AI Summary") -> DataFrame:
    """A parent and one child of the same text for each summary (name, body)."""
    rows = sections.select(F.col("name").alias("source_file"), F.col("body").alias("text"), F.length("body").alias("char_count"), F.lit(doc_type).alias("doc_type"), F.lit(section).alias("section"), F.lit(1).alias("page"))
    key = lambda level: point_id(F.lit("summary"), F.col("source_file"), F.lit(level))
    above = rows.withColumns({"point_id": key("parent"), "is_parent": F.lit(True), "chunk_type": F.lit("parent")})
    below = rows.withColumns({"point_id": key("child"), "parent_id": key("parent"), "search_text": F.col("text"), "is_parent": F.lit(False), "chunk_type": F.lit("child")})
    return above.unionByName(below, allowMissingColumns=True)
