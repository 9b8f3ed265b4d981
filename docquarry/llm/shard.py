"""Sharding by proportional stratified interleaving: shuffled ranks within each source, sorted by fractional rank, cut into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import Scratch


def global_rank(scratch: Scratch, name: str, frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` with ``rank``, gapless from 0 in the order of ``keys``, without one task seeing all rows.

    Rows are dealt by range and sorted; a row's rank is its place in its partition plus the rows of all earlier
    partitions. Ranges are written first, so they can't be drawn anew after a failure."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    dealt = scratch.save(name, dealt)
    part = F.shiftrightunsigned("place", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    bases = sizes.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "base")  # a row for each partition
    ranked = dealt.join(F.broadcast(bases), part == F.col("part"))
    return ranked.withColumn("rank", F.col("base") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "base", "place")


def shards(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Shards' row counts differ by one at most (law ``rows``) and each holds every source in its share of the whole, to about a row.
    Size is the text's UTF-8 bytes plus 16. Null texts count as empty, null sources as a source of their own; repeated rows each get
    a slot; with fewer rows than shards some shards are empty; an empty table gives no rows; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    within = scratch.save("within", global_rank(scratch, "by_source", rows, "stratum", "draw", "doc_id", "text_crc32"))
    strata = scratch.save("strata", within.groupBy("stratum").agg(F.min("rank").alias("first"), F.count("*").alias("n")))
    share = within.join(strata, "stratum").withColumn("share", (F.col("rank") - F.col("first") + 0.5) / F.col("n")).drop("rank", "first", "n")
    placed = global_rank(scratch, "by_share", share, "share", "draw", "doc_id", "text_crc32")
    total = within.count()
    shard = F.expr(f"rank * {n_shards}L div {max(total, 1)}L")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"rank - (shard * {total}L + {n_shards - 1}L) div {n_shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
