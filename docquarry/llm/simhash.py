"""SimHash near-duplicates by segment popcounts and a grid range-join.

A fingerprint's 32 segments of 2 bits give 32 bit counts. The Manhattan distance of two such vectors never exceeds the
number of differing bits, so fingerprints within 2 bits are within distance 2 there, and a point of the integer grid lies within 1 of
both. Each fingerprint enters the grid cells within 1 of its vector (49 on average); one that meets no other in any cell has no
link. For those left the same step is taken with the bits themselves: all that share a cell within one bit of each differ by 2 bits
at most. That verifies exactly without forming pairs, and no cell holds over 65 fingerprints, whatever the size of a group
of copies (equal fingerprints are one). Segments of 2 bits keep chance meetings in the grid rare up to billions of documents; with
4 bits they would grow with the square of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, id_of, keyed, longs, text_tag, texts
from docquarry.llm.graph import components
from docquarry.session import Scratch

SEED = 42
FINGERPRINTS_A_TASK = 50_000
_PRINTS = pa.schema([("did", pa.int64()), ("tag", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # of bytes: A-Z, and white space of ASCII, alone
    if not words:
        return 0
    size = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    last = ends[size - 1 :]
    for i in range(0, len(starts), 1 << 15):
        part = [digest(line[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)].tolist(), last[i : i + (1 << 15)].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(data.tobytes(), shingle) for data in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(longs(batch["did"])), pa.array(longs(batch["tag"])), pa.array(found, pa.int64())], schema=_PRINTS)

    return run


def segment_counts(fp: Column) -> Column:
    """Bits set in each of the 32 segments of 2 bits, packed in 2 bits each."""
    odd = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(odd), 1))


def grid_cells(counts: Column) -> Column:
    """The grid points within Manhattan distance 1. A packed count goes from 0 to 1 and back by flipping its low bit, from 1 to 2 and back by flipping both."""
    cells = [counts]
    for i in range(0, 64, 2):
        here = F.shiftrightunsigned(counts, i).bitwiseAND(F.lit(3))
        both = (3 << i) - (1 << 64 if i == 62 else 0)
        cells += [F.when(here < 2, counts.bitwiseXOR(F.lit(1 << i))), F.when(here > 0, counts.bitwiseXOR(F.lit(both)))]
    return F.array_compact(F.array(*cells))


def bit_cells(fp: Column) -> Column:
    """The fingerprint and all that differ from it in one bit."""
    masks = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(m).cast("long")) for m in masks))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    return keyed(docs).mapInArrow(_fingerprints(shingle), "did long, tag long, fp long")


def _linked(docs: DataFrame, shingle: int) -> DataFrame:
    """(did, tag, fp, root, component) per row of ``docs``: ``root`` names its component, ``component`` is the least did in it."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save("prints", fingerprints(docs, shingle))
    nodes = scratch.save("nodes", prints.groupBy("fp").agg(F.min("did").alias("least")))
    # each makes 49 or 65 rows below, so they are spread by what comes out, not by the few bytes that go in
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // FINGERPRINTS_A_TASK)
    cells = nodes.select("fp").repartition(tasks).select("fp", F.explode(grid_cells(segment_counts(F.col("fp")))).alias("cell"))
    shared = scratch.save("shared", cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell"))
    near = scratch.save("near", cells.join(shared, "cell").select("fp").distinct())
    within = near.repartition(tasks).select("fp", F.explode(bit_cells(F.col("fp"))).alias("cell")).groupBy("cell").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    edges = within.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u"))
    roots = scratch.save("roots", components(scratch, edges))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.save("named", named)
    least = scratch.save("least", named.groupBy("root").agg(F.min("least").alias("component")))
    of_print = scratch.save("of_print", named.join(least, "root").select("fp", "root", "component"))
    scratch.drop("nodes", "shared", "near", "roots", "named", "least")
    return prints.join(of_print, "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Per row of ``docs``: (doc_id, fingerprint as 16 hex digits, component_id).

    Documents link if their fingerprints differ in 2 bits or fewer; component_id is the least doc_id reachable. Null and empty texts
    have fingerprint zero, which links like any other; repeated rows each get their row; a null doc_id counts as least and its
    component_id is null; an empty table gives no rows; other columns are ignored."""
    out = _linked(docs, shingle)
    return out.select(id_back(F.col("did")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_back(F.col("component")).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one document of each component, that of the least doc_id; repeated rows of it go too.

    Different texts under one doc_id, null or not, are documents of their own. Null and empty texts are alike, so one of them stays (with what
    else links to fingerprint zero); an empty table stays empty; other columns may have any names."""
    one = _linked(docs, shingle).groupBy("root").agg(F.min(F.struct("did", "tag")).alias("one")).select("one.did", "one.tag")
    # one (did, tag) is one text and has one fingerprint, so no two components choose the same
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_of(F.col("doc_id")).alias("did"), text_tag(F.col("text")).alias("tag"))
    return rows.join(one, ["did", "tag"]).dropDuplicates(["did", "tag"]).select("row.*")
