"""Exact vector search by cells: what can't reach a query's k-th score by the triangle inequality is not read.

Vectors are dealt to cells about centroids and, within a value of a filter column, packed into blocks of one cell. A block has its own centre c and radius r, so for a
query q no vector x in it has q·x above q·c + |q|r. The blocks with the best centres give each query a first k-th score; after that only blocks that some
query may still find something in are read at all. Where vectors don't cluster, as random ones of many dimensions don't, every block may hold
something and all are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import retrieve as R
from docquarry.session import Scratch

#: Vectors of a block.
SIZE = 256
#: Vectors and their bytes that centroids are fitted on at most, and cells at most. Any centroids give the same rows.
SAMPLE, SAMPLE_BYTES, MOST_CELLS = 50_000, 32 << 20, 2_048
#: Blocks of each query that are searched for its first k-th score.
FIRST = 2
SLACK = 2e-6

_BLOCKS = "block long, cell int, n int, centre array<double>, radius double, ids binary, v binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("n", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("ids", pa.binary()), ("v", pa.binary())])


def centroids(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` centroids of a sample, by a few rounds of k-means from evenly chosen rows."""
    held = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)] if len(sample) else sample
    for _ in range(rounds if len(held) else 0):
        of = nearest(sample, held)
        sums, counts = np.zeros_like(held), np.bincount(of, minlength=len(held))
        np.add.at(sums, of, sample)
        held = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], held)
    return held


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int64), (centres * centres).sum(axis=1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (x[i : i + 4096] @ centres.T - half).argmax(axis=1)
    return out


def _dealt(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch["embedding"].flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in ("point_id", "same", "embedding")), pa.array(nearest(x, centres).astype(np.int32))], names=["point_id", "same", "embedding", "cell"])

    return run


def _packed(size: int):
    """Blocks of a partition's runs of one (same, cell)."""

    def rows(batch: pa.Table, serial: int) -> dict:
        x = np.stack([np.asarray(v) for v in batch["embedding"].to_pylist()])
        centre = x.mean(axis=0)
        return {"block": serial, "cell": batch["cell"][0].as_py(), "n": len(x), "centre": centre, "radius": float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) + 1e-9, "ids": batch["point_id"].to_numpy().tobytes(), "v": x.tobytes(), "same": batch["same"][0].as_py()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, base, schema = 0, TaskContext.get().partitionId() << 32, _SCHEMA.append(pa.field("same", pa.string()))
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            out = []
            while held.num_rows:
                keys = list(zip(held["same"].to_pylist()[: size + 1], held["cell"].to_pylist()[: size + 1], strict=True))
                run_ = next((i for i, key in enumerate(keys) if key != keys[0]), len(keys))
                if run_ == held.num_rows and run_ < size:
                    break  # more of this cell may follow
                n = min(run_, size)
                out.append(rows(held.slice(0, n), base + serial))
                serial += 1
                held = held.slice(n)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_pylist([rows(held, base + serial)], schema=schema)

    return run


def _folder(same: str | None) -> Column:
    """A value as the name of a folder; an empty one has a name too."""
    return F.concat(F.lit("of "), F.col(same).cast("string")) if same else F.lit("all")


def build(vectors: DataFrame, path: str, same: str | None = None, cells: int | None = None) -> None:
    """Write the blocks of ``vectors`` (point_id, embedding[, ``same``]) under ``path``, partitioned by ``same``.

    Null vectors and null ids are left out, as a search never finds them; vectors must have one length. Centroids are fitted on SAMPLE vectors (SAMPLE_BYTES) at most, every vector is dealt out."""
    scratch = Scratch(vectors.sparkSession, "cells")
    group = _folder(same)
    rows = vectors.filter("embedding is not null and point_id is not null").select(F.col("point_id").cast("long").alias("point_id"), group.alias("same"), F.col("embedding").cast("array<double>").alias("embedding"))
    total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    most = min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width)))
    share = min(1.0, 1.2 * most / max(1, total))
    sample = np.array([r[0] for r in rows.select("embedding").sample(share, 7).limit(most).collect()], float)
    centres = centroids(sample, cells or max(1, min(MOST_CELLS, total // SIZE)))
    dealt = rows.mapInArrow(_dealt(centres), "point_id long, same string, embedding array<double>, cell int") if len(sample) else rows.withColumn("cell", F.lit(0))
    dealt = scratch.save("dealt", dealt)
    # a large cell lies in several partitions
    placed = dealt.repartitionByRange("same", "cell", "point_id").sortWithinPartitions("same", "cell", "point_id")
    placed.mapInArrow(_packed(SIZE), f"{_BLOCKS}, same string").write.option("compression", "zstd").partitionBy("same").parquet(path)
    scratch.drop("dealt")


def _bounds(q: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    return q @ centre + np.sqrt((q * q).sum(axis=1)) * radius


def _centres(ids: np.ndarray, q: np.ndarray, of: list[str] | None, first: int):
    """For each query the blocks of a task whose centres suit it best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = q @ batch["centre"].flatten().to_numpy().reshape(batch.num_rows, -1).T
            if of is not None:
                scores[np.array(of)[:, None] != np.array(batch["same"].to_pylist())[None, :]] = -np.inf
            n = min(first, batch.num_rows)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :n]
            x, y = np.repeat(np.arange(len(ids)), n), best.ravel()
            keep = scores[x, y] > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[keep]]), batch["block"].take(pa.array(y[keep])), pa.array(scores[x[keep], y[keep]])], names=["query_id", "point_id", "score"])

    return run


def _needed(q: np.ndarray, of: list[str] | None, least: np.ndarray):
    """Blocks in which some query may find something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for centre, radius, same in zip(batch["centre"].to_pylist(), batch["radius"].to_pylist(), batch["same"].to_pylist(), strict=True):
                open_ = _bounds(q, np.array(centre), radius) >= least - SLACK
                keep.append(bool((open_ if of is None else open_ & (np.array(of) == same)).any()))
            yield pa.RecordBatch.from_arrays([batch["block"].filter(pa.array(keep))], names=["block"])

    return run


def _read(ids: np.ndarray, q: np.ndarray, of: list[str] | None, k: int, least: np.ndarray):
    """The best k of a task's blocks for each query; a block is multiplied with the queries that may find something in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, held = least.copy(), [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
        for batch in batches:
            for row in batch.to_pylist():
                open_ = _bounds(q, np.array(row["centre"]), row["radius"]) >= floor - SLACK
                if of is not None:
                    open_ &= np.array(of) == row["same"]
                which = np.flatnonzero(open_)
                points = np.frombuffer(row["ids"], np.int64)
                scores = q[which] @ np.frombuffer(row["v"], np.float64).reshape(row["n"], -1).T
                for i, s in zip(which.tolist(), scores, strict=True):
                    good = (s >= floor[i] - SLACK) & (points != ids[i])
                    if good.any():
                        p, t = np.concatenate((held[i][0], points[good])), np.concatenate((held[i][1], s[good]))
                        order = np.lexsort((p, -np.round(t, 6)))[:k]
                        held[i] = p[order], t[order]
                        if len(order) == k:
                            floor[i] = max(floor[i], held[i][1][-1])
        for i, (p, t) in enumerate(held):
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), ids[i])), pa.array(p), pa.array(t)], names=["query_id", "point_id", "score"])

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = R.VECTOR_K, same: str | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """Top k by inner product, exactly, of (query_id, embedding[, ``same``]) over what ``build`` wrote: (query_id, point_id, score, rank).

    With ``same`` a query finds vectors of its own value only, and only the folders of those values are read; null finds nothing. A query never finds the row of its own id. ``counts``
    gets the numbers of blocks and of those that were read."""
    scratch = Scratch(spark, "cell-search")
    group = _folder(same)
    asked = queries.filter("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), group.alias("same"), F.col("embedding").cast("array<double>").alias("embedding")).filter("same is not null")
    asked = scratch.save("asked", asked)
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    groups, spec, rows = max(1, -(-n * width * 8 // R.QUERY_BYTES)), "query_id long, point_id long, score double", None
    for g in range(groups):
        held = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).collect()  # QUERY_BYTES bounds it
        if not held:
            continue
        ids, q = np.array([r["query_id"] for r in held], np.int64), np.array([r["embedding"] for r in held], float)
        of = [r["same"] for r in held] if same else None
        blocks = spark.read.schema(f"{_BLOCKS}, same string").parquet(path)
        if same:
            blocks = blocks.filter(F.col("same").isin(sorted(set(of))))
        heads = blocks.select("block", "same", "centre", "radius")
        best = R.top(heads.mapInArrow(_centres(ids, q, of, FIRST), spec), FIRST).select(F.col("point_id").alias("block")).distinct()
        first = blocks.join(F.broadcast(best), "block", "left_semi")  # FIRST rows a query of the group
        first = first.mapInArrow(_read(ids, q, of, k, np.full(len(ids), -np.inf)), spec)
        at = R.top(first, k).filter(F.col("rank") == k).select("query_id", "score").collect()
        kth = dict(map(tuple, at))
        least = np.array([kth.get(i, -np.inf) for i in ids.tolist()])
        needed = scratch.save(f"needed-{g}", heads.mapInArrow(_needed(q, of, least), "block long"))
        if counts is not None:
            counts["blocks"], counts["read"] = counts.get("blocks", 0) + heads.count(), counts.get("read", 0) + needed.count()
        found = scratch.save(f"found-{g}", blocks.join(needed, "block", "left_semi").mapInArrow(_read(ids, q, of, k, least), spec))
        rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        rows = asked.select("query_id", F.col("query_id").alias("point_id"), F.lit(0.0).alias("score")).limit(0)
    return R.top(rows, k)
