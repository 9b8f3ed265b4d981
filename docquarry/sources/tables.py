"""Corpus sources and maintenance of chunk tables. Every operator is a lazy plan; sinks take the table's location."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("info_code", "stock", "org", "title")])


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text or Markdown file: (path, text, page_count); empty files are left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.filter(F.length(F.trim("text")) > 0).withColumn("page_count", page_count(F.col("text")))


def page_count(text: Column) -> Column:
    """Blank-line breaks plus 1."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit("\n\n"), F.lit("")))) / 2).cast("int") + 1


def scan_report_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Report metadata from JSON; rows without a code or a stock go."""
    rows = spark.read.schema(REPORT_METADATA).json(path)
    return rows.filter((F.coalesce("info_code", F.lit("")) != "") & (F.coalesce("stock", F.lit("")) != ""))


def parse_documents(files: DataFrame, parser: Callable[[str, bytes], str]) -> DataFrame:
    """Run a caller's parser over (path, content) rows: (path, text, char_count, status, error); an error fails its row alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    text = parser(path, bytes(content))
                    out.append((path, text, len(text), "success", None))
                except Exception as e:  # a parser may fail in any way; the row says so
                    out.append((path, None, 0, "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "text", "char_count", "status", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, char_count long, status string, error string")


def page_type(pages: DataFrame, doc: str, text: str, least: int = 80, share: float = 0.8) -> DataFrame:
    """(doc, pages, kind): ``text`` if enough pages have more than ``least`` characters, else ``scanned``; no pages count as text."""
    full = F.avg((F.length(F.trim(text)) > least).cast("int"))
    return pages.groupBy(doc).agg(F.count("*").alias("pages"), F.when(F.coalesce(full, F.lit(1.0)) >= share, "text").otherwise("scanned").alias("kind"))


def parse_report(records: DataFrame) -> DataFrame:
    """Totals of parse records: documents, successes, errors, characters, tables."""
    return records.agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") != "success").alias("failed"),
        F.sum("char_count").alias("chars"), F.sum("table_count").alias("tables"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Insert or replace by key: new rows, and old rows whose key is not among them."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def scroll(points: DataFrame, **equal: object) -> DataFrame:
    """All points whose columns equal the given values (None: is null), without paging."""
    rows = points
    for name, value in equal.items():
        rows = rows.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return rows


def delete_documents(points: DataFrame, gone: DataFrame, *on: str) -> DataFrame:
    """``points`` without the documents of ``gone``, for example by (collection, source_file); of a catalog or list of files likewise."""
    return points.join(gone.select(*on).distinct(), list(on), "left_anti")


def split_collection(points: DataFrame, *names: str) -> DataFrame:
    """A copy of all points in each of the named collections."""
    return points.withColumn("collection", F.explode(F.array(*map(F.lit, names))))


def pending(documents: DataFrame, indexed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents not yet indexed; both sides carry the same safe ids."""
    return documents.join(indexed.select(doc_id).distinct(), doc_id, "left_anti")


def ensure_collection(spark: SparkSession, path: str, like: DataFrame, name: str, recreate: bool = False) -> int:
    """How many points collection ``name`` under ``path`` holds; where it is missing, or is to be made anew, it is left empty with ``like``'s columns."""
    folder = f"{path}/collection={name}"
    empty = like.limit(0).drop("collection")
    if not recreate:
        try:
            return spark.read.parquet(folder).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    empty.write.mode("overwrite").parquet(folder)
    return 0


def save_collection(points: DataFrame, path: str, mode: str = "append") -> int:
    """Write points partitioned by collection; ``overwrite`` recreates the collections it holds. The number of points under ``path`` then."""
    points.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)
    return points.sparkSession.read.parquet(path).count()


def append_state(rows: DataFrame, path: str) -> None:
    """Add versions of records to an append-only table; what is there is never written again."""
    rows.write.mode("append").parquet(path)


def current_state(spark: SparkSession, path: str, key: str, version: str, deleted: str | None = None) -> DataFrame:
    """The last version of each record; records whose last version is marked ``deleted`` are left out."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("s")).select(key, "s.*").select(*rows.columns)
    return last if deleted is None else last.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def save_reports(path: str, **tables: DataFrame) -> None:
    """Write several report tables side by side."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").json(f"{path}/{name}")
