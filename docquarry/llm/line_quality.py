"""Quality rules: statistics of each document, and how often its lines stand in other documents of its host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, id_of, longs, text_tag, texts
from docquarry.llm.hashing import WHITE, Rolling, word_codes, word_spans
from docquarry.session import Scratch

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANKS = r"[\x20\x09-\x0D]+"


def statistics(data: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text's UTF-8 bytes."""
    starts, ends = word_spans(data)
    n = len(starts)
    white = WHITE[data]
    chars = int((((data & 0xC0) != 0x80) & ~white).sum())
    lines = [x for x in data.tobytes().split(b"\n") if x and x.strip(b" \t\n\r\x0b\x0c")]
    repeats = 0
    if n > 5:
        hashes = Rolling(word_codes(data, starts, ends)).windows(5)
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = times[which] > 1
        if twice.any():
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            edge[:-1] += np.bincount(at, minlength=n)
            edge[5:] -= np.bincount(at, minlength=n)[: n - 4]
            repeats = int((np.cumsum(edge)[:-1] > 0).sum())
    return n, chars, int(SYMBOLS[data].sum()), len(lines) - len(set(lines)), repeats


_STATS = pa.schema([(n, pa.int64()) for n in ("did", "tag", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([statistics(data) for data in texts(batch["text"])], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays([pa.array(longs(batch["did"])), pa.array(longs(batch["tag"])), *(pa.array(found[:, i]) for i in range(5))], schema=_STATS)


def lines_of(docs: DataFrame) -> DataFrame:
    """(did, tag, host, at, line, words): each line with a word, as a hash without case and with its white space normalised."""
    cut = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.array_remove(F.split(x, BLANKS), "").alias("ws")))
    held = docs.select("did", "tag", "host", F.explode_outer(F.filter(cut, lambda x: F.size(x.ws) > 0)).alias("l")).filter("l is not null")
    return held.select("did", "tag", "host", "l.at", F.xxhash64(F.lower(F.array_join("l.ws", " "))).alias("line"), F.size("l.ws").alias("words"))


def common_lines(lines: DataFrame, sizes: DataFrame, least: int, share: float, most: int) -> DataFrame:
    """(host, line, documents, limit) of the lines in more different documents of a host than its limit.

    The limit is ``share`` of the host's documents, but ``least`` at least and ``most`` at most, so it doesn't rise with a host beyond measure.
    Documents are told apart by their whole text: exact copies count once."""
    counts = lines.select("host", "line", "tag").distinct().groupBy("host", "line").agg(F.count("*").alias("documents")).filter(F.col("documents") > least)
    limit = F.least(F.greatest(F.lit(float(least)), F.col("size") * share), F.lit(float(most)))
    return counts.join(sizes, "host").withColumn("limit", limit).filter("documents > limit").select("host", "line", "documents", "limit")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(id_of(F.col("doc_id")).alias("did"), text_tag(F.col("text")).alias("tag"), text.alias("text"), _host(F.col("source")).alias("host"))


def _host(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), source.cast("string")), F.lit(""))


def _gone(scratch: Scratch, named: DataFrame, least: int, share: float, most: int) -> DataFrame:
    """(did, tag, host, at, line, words, documents, limit): each line that goes; texts are cut into lines once."""
    sizes = scratch.save("sizes", named.groupBy("host").agg(F.count("*").alias("size")))
    lines = scratch.save("lines", lines_of(named))
    common = scratch.save("common", common_lines(lines, sizes, least, share, most))
    gone = scratch.save("gone", lines.join(common, ["host", "line"]).select("did", "tag", "host", "at", "line", "words", "documents", "limit").distinct())
    scratch.drop("sizes", "lines", "common")
    return gone


def quality(
    docs: DataFrame, least: int = 20, share: float = 0.05, most: int = 1000, left: float = 0.2, least_words: int = 10, repeat_percent: int = 20
) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    base_failed: fewer than ``least_words`` words, or more than ``repeat_percent`` % of them in repeated 5-word windows. Else a document
    is rejected when the lines that are common on its host (see common_lines) leave less than ``left`` of its words. Rejected documents of a host that lose the very same
    lines are a group: if enough would be left of its first one (by doc_id) with the group counted as one document, that one stays, so no group of near copies goes whole.
    Null and empty texts have no words and fail; a null source is a host of its own; repeated rows each get their row; an empty table gives
    no rows; other columns are ignored."""
    scratch, named = Scratch(docs.sparkSession, "quality"), _keyed(docs)
    out = _judged(scratch, named, _gone(scratch, named, least, share, most), left, least_words, repeat_percent)[0]
    return out.select(id_back(F.col("did")).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _judged(scratch: Scratch, named: DataFrame, gone: DataFrame, left: float, least_words: int, repeat_percent: int) -> tuple[DataFrame, DataFrame]:
    """The statistics and verdict of each row of ``named``, by (did, tag), and the lines that go; of a text's hosts the one where most goes counts."""
    of_host = gone.groupBy("did", "tag", "host").agg(F.sum("words").alias("gone"), F.xxhash64(F.array_sort(F.collect_set("line"))).alias("lines"))
    lost = scratch.save("lost", of_host.groupBy("did", "tag").agg(F.max(F.struct("gone", "host", "lines")).alias("m")).select("did", "tag", "m.*"))
    stats = named.select("did", "tag", "text").mapInArrow(_statistics, ", ".join(f"{n} long" for n in _STATS.names))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    enough = lambda gone: F.col("n_words") - F.coalesce(gone, F.lit(0)) >= F.col("n_words") * left
    out = stats.join(lost, ["did", "tag"], "left").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & enough(F.col("gone")))
    out = scratch.save("judged", out)
    depleted = out.filter("not base_failed and not kept").groupBy("host", "lines").agg(F.count_distinct("tag").alias("m"), F.min(F.struct("did", "tag", "n_words")).alias("one")).filter("m > 1")
    first = scratch.save("first", depleted.select("one.*", "host", "m"))
    # the lines of a group's first document that are common without the rest of the group too
    still = gone.join(first, ["did", "tag", "host"]).filter("documents - m + 1 > limit")
    still = scratch.save("still", still.select(*gone.columns))
    spared = first.join(still.groupBy("did", "tag").agg(F.sum("words").alias("gone")), ["did", "tag"], "left").filter(enough(F.col("gone")))
    spared = scratch.save("spared", spared.select("did", "tag", F.lit(True).alias("spared")).distinct())
    out = out.join(spared, ["did", "tag"], "left").withColumn("kept", F.col("kept") | F.coalesce("spared", F.lit(False))).drop("spared", "gone", "host", "lines")
    return out, gone.join(spared, ["did", "tag"], "left_anti").unionByName(still.join(spared, ["did", "tag"], "left_semi"))


def keep_good(
    docs: DataFrame, least: int = 20, share: float = 0.05, most: int = 1000, left: float = 0.2, least_words: int = 10, repeat_percent: int = 20
) -> DataFrame:
    """``docs`` without rejected documents and, in the rest, without the lines above the limits; n_chars follows.

    Each text under one doc_id, null or not, is judged and cut by itself, and cut by each of its hosts. Null and empty texts have no words and go; repeated rows
    are kept or go together; an empty table stays empty; other columns may have any names."""
    scratch, named = Scratch(docs.sparkSession, "quality"), _keyed(docs)
    judged, gone = _judged(scratch, named, _gone(scratch, named, least, share, most), left, least_words, repeat_percent)
    verdict = judged.filter("kept").select("did", "tag").distinct()
    cuts = gone.groupBy("did", "tag", "host").agg(F.collect_set("at").alias("cuts"))
    marks = verdict.join(named.select("did", "tag", "host").distinct(), ["did", "tag"]).join(cuts, ["did", "tag", "host"], "left")
    marks = scratch.save("marks", marks)
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_of(F.col("doc_id")).alias("did"), text_tag(F.col("text")).alias("tag"), _host(F.col("source")).alias("host"))
    out = rows.join(marks, ["did", "tag", "host"])
    lines = F.transform(F.split("row.text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.array_join(F.transform(F.filter(lines, lambda s: ~F.array_contains("cuts", s.i)), lambda s: s.x), "\n")
    text = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(kept)
    values = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(values[c].alias(c) if c in values else F.col("row").getField(c).alias(c) for c in docs.columns))
