"""A search index that follows its documents: segments that are written once, and a manifest that says which of them hold.

A commit writes one segment (the batch's chunks with their blocks of postings, the documents whose earlier chunks no longer hold, and by how much each term's
number of chunks changes) and then moves the manifest on in one step. Nothing that was written before is touched, so bytes written follow the batch, a commit that
breaks off leaves only a folder that nobody reads, and a reader keeps the version that it opened. Statistics are sums over segments. ``compact``
merges the newest segments while they are as large together as the one before, so each chunk is written anew a number of times that grows with the logarithm of the
table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import tokens
from docquarry.operators import blocks as B
from docquarry.operators import index as X
from docquarry.operators.search import SearchIndex
from docquarry.session import Scratch
from docquarry.sources.manifest import Manifest

#: Documents replaced by a batch up to so many are looked up by their ids, which lets the scan of chunks skip row groups; more are joined.
LISTED = 1_000


class SegmentedIndex:
    """The index under ``path``. Chunks have ``point_id``, ``doc`` and ``text``; a document is replaced or deleted as a whole."""

    def __init__(self, spark: SparkSession, path: str, doc: str = "doc_id", text: str = "text", dim: int = 1024, k1: float = 1.5, b: float = 0.75, idf: str = "okapi_floor", cut: Callable[[Column], Column] = tokens) -> None:
        self.spark, self.path, self.doc, self.text, self.dim, self.k1, self.b, self.idf, self.cut = spark, path.rstrip("/"), doc, text, dim, k1, b, idf, cut
        self.manifest = Manifest(spark, path)

    def _read(self, segment: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment['folder']}/{name}").withColumn("segment", F.lit(segment["seq"]).cast("long"))

    def _all(self, segments: list[dict], name: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (self._read(s, name) for s in segments))

    def _live(self, segments: list[dict]) -> DataFrame:
        """Chunks with ``segment`` that no later segment replaces."""
        chunks, later = self._all(segments, "chunks"), [s for s in segments[1:] if s["gone"]]
        if not later:
            return chunks
        gone = self._all(later, "gone").groupBy(self.doc).agg(F.max("segment").alias("_gone"))
        return chunks.join(gone, self.doc, "left").filter(F.col("_gone").isNull() | (F.col("segment") >= F.col("_gone"))).drop("_gone")

    def commit(self, chunks: DataFrame, replaced: DataFrame, writer: str = "", epoch: int | None = None) -> int:
        """Add ``chunks`` and let go what was held of the documents ``replaced`` (doc); the version that then holds.

        ``replaced`` names the documents of ``chunks`` and those to delete; ids that are null replace nothing. With ``epoch`` a batch that ``writer`` has committed before is left out, so a
        stream may run one again. Another commit in between is an error, and this one changes nothing."""
        number, held = self.manifest.latest()
        segments, epochs = held.get("segments", []), held.get("epochs", {})
        if epoch is not None and epochs.get(writer, -1) >= epoch:
            return number
        seq = held.get("next", 0)
        here = {"seq": seq, "folder": f"s-{seq:08d}-{uuid.uuid4().hex[:12]}"}
        folder = f"{self.path}/{here['folder']}"
        replaced.select(self.doc).filter(F.col(self.doc).isNotNull()).distinct().write.parquet(f"{folder}/gone")
        chunks.sortWithinPartitions(self.doc).write.option("compression", "zstd").parquet(f"{folder}/chunks")
        mine = self.spark.read.schema(chunks.schema).parquet(f"{folder}/chunks")
        here |= {"gone": self._read(here, "gone").count(), "chunks": mine.count()}
        B.build(mine, self.text, f"{folder}/index", seq, self.dim, B.SIZE, self.cut)
        mine.select(self.doc).distinct().write.parquet(f"{folder}/docs")
        n, with_terms, all_terms = B.totals(B.read(self.spark, f"{folder}/index", "postings"))
        terms = Scratch(self.spark, "segment").save("counts", B.term_frequencies(B.read(self.spark, f"{folder}/index", "postings")), B.COUNTED)
        before = held.get("totals", [0, 0, 0])
        dead = self._dead(segments, self._read(here, "gone").drop("segment")) if segments else None
        if dead is not None:
            less, row = B.text_counts(dead, self.text, Scratch(self.spark, "segment"), "dead", self.cut)
            n, with_terms, all_terms = n - row[0], with_terms - row[1], all_terms - row[2]
            less = less.withColumn("df", -F.col("df"))
            terms = terms.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        terms.write.parquet(f"{folder}/terms")
        totals = [before[0] + n, before[1] + with_terms, before[2] + all_terms]
        record = {"segments": [*segments, here], "next": seq + 1, "totals": totals, "epochs": epochs | ({writer: epoch} if epoch is not None else {})}
        self.manifest.commit(number + 1, record)
        return number + 1

    def _dead(self, segments: list[dict], gone: DataFrame) -> DataFrame | None:
        """The chunks that still held of documents ``gone``; texts are read only if there are such documents."""
        known = self._all(segments, "docs").select(self.doc).distinct().join(gone, self.doc, "left_semi")
        listed = [r[0] for r in known.limit(LISTED + 1).collect()]
        if not listed:
            return None
        live = self._live(segments)
        return live.filter(F.col(self.doc).isin(listed)) if len(listed) <= LISTED else live.join(known, self.doc, "left_semi")

    def open(self, version: int | None = None) -> SearchIndex:
        """The index as it stands, or as it stood at ``version``; later commits don't change what it reads."""
        held = self.manifest.latest()[1] if version is None else self.manifest.at(version)
        segments = held["segments"]
        live = self._live(segments)
        paths = [f"{self.path}/{s['folder']}/index" for s in segments]
        read = lambda kind: reduce(DataFrame.unionByName, (B.read(self.spark, p, kind) for p in paths))
        allowed = live.select("point_id", "segment") if any(s["gone"] for s in segments[1:]) else None
        counts = self._all(segments, "terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return SearchIndex(
            self.dim, live.drop("segment"), read("postings"), X.weighted_terms(counts, held["totals"][0], self.idf), read("vectors"), tuple(held["totals"]), allowed, self.k1, self.b, self.cut
        )

    def compact(self) -> int:
        """Merge the newest segments as long as they hold at least half as many chunks together as the one before them; the version that then holds.

        What the merged segments replace in older ones stays replaced. The old folders stay for readers of earlier versions until ``clean``."""
        number, held = self.manifest.latest()
        segments = held.get("segments", [])
        first, size = len(segments) - 1, segments[-1]["chunks"] if segments else 0
        while first > 0 and 2 * size >= segments[first - 1]["chunks"]:
            first -= 1
            size += segments[first]["chunks"]
        if first >= len(segments) - 1:
            return number
        merged = segments[first:]
        here = {"seq": held["next"], "folder": f"s-{held['next']:08d}-{uuid.uuid4().hex[:12]}"}
        folder = f"{self.path}/{here['folder']}"
        oldest = merged[0]["seq"]
        chunks = self._live(segments).filter(F.col("segment") >= oldest).drop("segment")
        chunks.sortWithinPartitions(self.doc).write.option("compression", "zstd").parquet(f"{folder}/chunks")
        mine = self.spark.read.schema(chunks.schema).parquet(f"{folder}/chunks")
        gone = self._all(merged, "gone").select(self.doc).distinct()
        (gone if first else gone.limit(0)).write.parquet(f"{folder}/gone")
        B.build(mine, self.text, f"{folder}/index", here["seq"], self.dim, B.SIZE, self.cut)
        mine.select(self.doc).distinct().write.parquet(f"{folder}/docs")
        self._all(merged, "terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").write.parquet(f"{folder}/terms")
        here |= {"gone": self._read(here, "gone").count(), "chunks": mine.count()}
        self.manifest.commit(number + 1, held | {"segments": [*segments[:first], here], "next": held["next"] + 1})
        return number + 1

    def clean(self, since: int) -> None:
        """Delete the folders that no version from ``since`` on names."""
        number, _ = self.manifest.latest()
        names = lambda v: {s["folder"] for s in self.manifest.at(v).get("segments", [])}
        used = set().union(*(names(v) for v in range(since, number + 1)))
        self.manifest.forget(sorted(set().union(*(names(v) for v in range(1, since))) - used))
