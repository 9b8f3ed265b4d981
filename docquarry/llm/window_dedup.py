"""Substring de-duplication over words by level-wise doubling.

Windows are followed from short to long, and only those repeated at one length are extended to twice that length. The
first level takes 5-word windows at content-defined anchors (each window of 20 words has one, at an offset that its words
alone decide); survivors grow to 10 words, inside the windows they stand for, then to 20. At the last doubling, an
anchor's whole neighbourhood (all its 20-word windows, up to 35 words) is compared first: where it stands earlier
as a whole, it is settled in one row, and only neighbourhoods that differ are opened into single windows. No
candidates survive beyond the contract's length, since a longer repeat consists of repeated 20-word windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrow import fewer, id_back, keyed, longs, texts
from docquarry.llm.hashing import BLOCK, Rolling, as_long, minimizers, word_codes, word_spans
from docquarry.session import Scratch

_KEY = [("did", pa.int64()), ("tag", pa.int64())]
_ANCHORS = pa.schema([("h", pa.int64()), *_KEY, ("pos", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16())])


def _gathered(schema: pa.Schema, rows_of):
    """An Arrow task that calls rows_of(did, tag, data, row index, batch) for each row and gathers the numpy columns it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for i, (did, tag, data) in enumerate(zip(longs(batch["did"]), longs(batch["tag"]), texts(batch["text"]), strict=True)):
                for rows in rows_of(int(did), int(tag), data, i, batch):
                    if len(rows[0]):
                        parts.append(rows)
                        held += len(rows[0])
                if held > 200_000:
                    yield fewer(parts, schema)
                    parts, held = [], 0
            if parts:
                yield fewer(parts, schema)

    return run


def _first_level(window: int, gram: int):
    def rows_of(did, tag, data, _i, _batch):
        starts, ends = word_spans(data)
        if len(starts) < window:
            return
        pos, lo, hi, h = minimizers(word_codes(data, starts, ends), gram, window)
        n = len(pos)
        yield as_long(h), np.full(n, did), np.full(n, tag), pos.astype(np.int32), lo.astype(np.int16), hi.astype(np.int16)

    return _gathered(_ANCHORS, rows_of)


def _places(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = batch["at"][i].values
    pos, lo, hi = (rows.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    order = np.lexsort((hi, lo, pos))
    return pos[order], lo[order], hi[order]


def _codes(data: np.ndarray, kinds: int) -> list[np.ndarray]:
    """One or two independent codes of every word."""
    starts, ends = word_spans(data)
    return [word_codes(data, starts, ends, which) for which in range(kinds)]


def _hashes(codes: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """64 bits of hash for each kind of code of each range of words, in blocks; ``start`` rises."""
    out = [np.empty(len(start), np.int64) for _ in codes]
    for first in range(0, len(codes[0]), BLOCK):
        i, j = np.searchsorted(start, (first, first + BLOCK))
        if i < j:
            top = int(end[i:j].max())
            for which, kind in enumerate(codes):
                out[which][i:j] = as_long(Rolling(kind[first:top], which).ranges(start[i:j] - first, end[i:j] - first))
    return out


def _next_level(window: int, gram: int, length: int):
    """Windows of twice the length about each anchor, to its right or to its left, with the offsets for which they fit."""

    def rows_of(did, tag, data, i, batch):
        pos, lo, hi = _places(batch, i)
        split, codes = window - length, _codes(data, 1)
        for a, b, start in ((lo, np.minimum(hi, split), pos), (np.maximum(lo, split + 1), hi, pos - (length - gram))):
            fits = a <= b
            if fits.any():
                n = int(fits.sum())
                yield _hashes(codes, start[fits], start[fits] + length)[0], np.full(n, did), np.full(n, tag), pos[fits].astype(np.int32), a[fits].astype(np.int16), b[fits].astype(np.int16)

    return _gathered(_ANCHORS, rows_of)


_AREAS = pa.schema([("h", pa.int64()), ("h2", pa.int64()), *_KEY, ("pos", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16())])


def _areas(window: int):
    """A hash of all words of an anchor's windows, and of its range of offsets."""

    def rows_of(did, tag, data, i, batch):
        pos, lo, hi = _places(batch, i)
        order = np.argsort(pos - hi, kind="stable")
        pos, lo, hi = pos[order], lo[order], hi[order]
        h, h2 = _hashes(_codes(data, 2), pos - hi, pos - lo + window)
        n = len(pos)
        yield h * 1024 + lo, h2 * 1024 + hi, np.full(n, did), np.full(n, tag), pos.astype(np.int32), lo.astype(np.int16), hi.astype(np.int16)

    return _gathered(_AREAS, rows_of)


_WINDOWS = pa.schema([("h", pa.int64()), ("h2", pa.int64()), *_KEY, ("start", pa.int32())])


def _singles(window: int):
    def rows_of(did, tag, data, i, batch):
        pos, lo, hi = _places(batch, i)
        size = hi - lo + 1
        start = np.repeat(pos - hi, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        start = np.unique(start)
        h, h2 = _hashes(_codes(data, 2), start, start + window)
        yield h, h2, np.full(len(start), did), np.full(len(start), tag), start.astype(np.int32)

    return _gathered(_WINDOWS, rows_of)


def _of_documents(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("did", "tag").agg(F.collect_set(F.struct("pos", "lo", "hi")).alias("at"))


def later_windows(scratch: Scratch, docs: DataFrame, later: DataFrame, window: int, first: int) -> DataFrame:
    """(did, tag, a, b): spans of words whose windows all stand earlier too.

    ``later`` names the documents whose whole text stands earlier: they never decide where a sequence first stands."""
    twice = lambda rows: rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    spec = "h long, did long, tag long, pos int, lo short, hi short"
    live = scratch.save("level-0", docs.mapInArrow(_first_level(window, first), spec))
    length, gone = 2 * first, ["level-0"]
    live = live.join(scratch.save("twice-0", twice(live)), "h")
    live = scratch.save("live", _of_documents(live).join(later, ["did", "tag"], "left_anti"))
    held = scratch.save("text", docs.join(live, ["did", "tag"]))
    scratch.drop("level-0", "twice-0", "live")
    gone = []
    while length < window:
        rows = scratch.save(f"level-{length}", held.mapInArrow(_next_level(window, first, length), spec))
        live = rows.join(scratch.save(f"twice-{length}", twice(rows)), "h")
        live = scratch.save(f"live-{length}", _of_documents(live))
        held = held.drop("at").join(live, ["did", "tag"])
        gone += [f"level-{length}", f"twice-{length}", f"live-{length}"]
        length *= 2
    areas = scratch.save("areas", held.mapInArrow(_areas(window), "h long, h2 long, did long, tag long, pos int, lo short, hi short"))
    one = areas.groupBy("h", "h2").agg(F.min(F.struct("did", "tag", "pos")).alias("one"))
    areas = scratch.save("ranked", areas.join(scratch.save("ones", one), ["h", "h2"]).withColumn("is_one", F.struct("did", "tag", "pos") == F.col("one")).drop("one", "h", "h2"))
    settled = areas.filter("not is_one").select("did", "tag", (F.col("pos") - F.col("hi")).alias("a"), (F.col("pos") - F.col("lo") + window).alias("b"))
    opened = held.drop("at").join(scratch.save("opened", _of_documents(areas.filter("is_one"))), ["did", "tag"])
    rows = scratch.save("windows", opened.mapInArrow(_singles(window), "h long, h2 long, did long, tag long, start int"))
    firsts = scratch.save("firsts", rows.groupBy("h", "h2").agg(F.min(F.struct("did", "tag", "start")).alias("one"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = rows.join(firsts, ["h", "h2"]).filter(F.struct("did", "tag", "start") != F.col("one"))
    spans = scratch.save("spans", settled.unionByName(later.select("did", "tag", F.col("start").alias("a"), (F.col("start") + window).alias("b"))))
    scratch.drop("text", "areas", "ones", "ranked", "opened", "windows", "firsts", *gone)
    return spans


_DIGEST = pa.schema([*((n, pa.int64()) for n in ("did", "n_words", "n_removed")), ("kept_sha256", pa.string())])


def _digest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (did, data, later) in enumerate(zip(longs(batch["did"]), texts(batch["text"]), batch["later"].to_pylist(), strict=True)):
                words = data.tobytes().split()
                keep = np.ones(len(words), bool)
                if later and len(words) >= window:
                    keep[:] = False
                elif batch["spans"][i].is_valid:
                    spans = batch["spans"][i].values
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, spans.field(0).to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, spans.field(1).to_numpy(zero_copy_only=False), -1)
                    keep = np.cumsum(edge)[:-1] == 0
                rows.append({"did": int(did), "n_words": len(words), "n_removed": int((~keep).sum()), "kept_sha256": hashlib.sha256(b" ".join(compress(words, keep))).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)

    return run


def remove_later_windows(docs: DataFrame, window: int = 20, first: int = 5) -> DataFrame:
    """Per document the words removed: (doc_id, n_words, n_removed, kept_sha256).

    A word goes if a ``window``-word sequence that also starts earlier (in a smaller doc_id, or earlier in the same
    document) covers it; sequences are judged on the input. Null and empty texts have no words; a text shorter than
    the window stays whole; rows that repeat an id and text are one document, removed alike; two texts under one id are
    ordered by a hash of the text; an empty table gives no rows; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "windows")
    named = keyed(docs)
    sums = scratch.save("sums", named.select("did", "tag", F.sha2("text", 256).alias("sum")).distinct())
    groups = scratch.save("groups", sums.groupBy("sum").agg(F.count("*").alias("n"), F.min(F.struct("did", "tag")).alias("one")).filter("n > 1"))
    later = sums.join(groups, "sum")
    later = scratch.save("later", later.filter(F.struct("did", "tag") != F.col("one")).select("did", "tag", F.lit(True).alias("later")))
    spans = later_windows(scratch, named, later, window, first)
    spans = spans.groupBy("did", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    kind = spans.schema["spans"].dataType
    info = spans.withColumn("later", F.lit(False)).unionByName(later.select("did", "tag", F.lit(None).cast(kind).alias("spans"), "later"))
    out = named.join(scratch.save("info", info), ["did", "tag"], "left").select("did", "tag", "text", "spans", "later")
    out = out.mapInArrow(_digest(window), "did long, n_words long, n_removed long, kept_sha256 string")
    return out.select(id_back(F.col("did")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
