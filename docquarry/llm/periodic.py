"""Periodic runs of words, by an enhanced suffix array and the branching-tandem test.

Documents are put one after another, each closed by a code of its own, until a batch of WORDS_A_BATCH words is full; a longer one is a
batch by itself. The batch's suffix array, its inverse and its common prefixes come from prefix doubling. The intervals of common
prefixes are given by the nearest smaller values on both sides of each entry, so no tree is built: an entry of
depth d parts two ranges of suffixes, and each suffix i of the smaller range is tested for whether i + d or i - d lies in the other one
by its place in the inverse array. That is a square that can't be moved right; moved left as far as words d apart are equal it is
a run. A run is also found with the multiples of its period, over the same stretch; the least is kept."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, keyed, longs, texts

WORDS_A_BATCH = 1 << 17
#: Suffixes of smaller ranges that are tested at a time.
TESTS_AT_ONCE = 1 << 21
#: Steps from one smaller value to the next before the rest goes by minima over powers of two.
HOPS = 8


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffixes in order, their ranks, ranks by the first 1, 2, 4... codes) of codes of which the last stands once."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    rank = rank.astype(np.int64)
    # a rank is the number of suffixes that are less, so those of a class stay as they are while others are parted
    sizes = np.bincount(rank)
    rank = (np.cumsum(sizes) - sizes)[rank]
    order = np.argsort(rank, kind="stable")
    levels, length = [rank], 1
    while True:
        held = rank[order]
        first = np.append(True, held[1:] != held[:-1])
        alone = first & np.append(first[1:], True)
        if alone.all():
            return order, rank, levels
        at = np.flatnonzero(~alone)
        mine = order[at]
        after = mine + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        place = np.lexsort((second, held[at]))
        mine, one, two = mine[place], held[at], second[place]
        order[at] = mine
        new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        rank = rank.copy()
        rank[mine] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank)
        length *= 2


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes from a and from b on are equal."""
    n = len(levels[0])
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        step = same.astype(np.int64) << k
        a, b, out = a + step, b + step, out + step
    return out


def smaller_before(values: np.ndarray, strict: bool) -> np.ndarray:
    """The nearest earlier place with a smaller value (or an equal one, unless ``strict``), -1 for none."""
    n = len(values)
    out = np.arange(-1, n - 1)
    beats = (lambda x, y: x >= y) if strict else (lambda x, y: x > y)
    live = np.arange(n)
    for _ in range(HOPS):
        at = out[live]
        on = (at >= 0) & beats(values[np.maximum(at, 0)], values[live])
        live, at = live[on], at[on]
        out[live] = out[at]
        if not len(live):
            return out
    minima = [values]
    while 2 << (len(minima) - 1) <= n:
        half, last = 1 << (len(minima) - 1), minima[-1]
        minima.append(np.minimum(last[half:], last[:-half]))
    at = out[live] + 1  # everything from here on is no smaller
    for k in range(len(minima) - 1, -1, -1):
        low = at - (1 << k)
        on = low >= 0
        on[on] = beats(minima[k][low[on]], values[live[on]])
        at = np.where(on, low, at)
    out[live] = at - 1
    return out


def runs(codes: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) by start and period of the runs of at least ``least`` codes and ``times`` periods; closing codes belong to none."""
    empty = np.zeros(0, np.int64)
    n = len(codes)
    if n < 2:
        return empty, empty, empty
    order, rank, levels = suffix_array(codes)
    depth = common_prefix(levels, order[:-1], order[1:])  # entry k parts suffixes k and k + 1
    low = smaller_before(depth, True) + 1
    high = n - 2 - smaller_before(depth[::-1], False)[::-1]
    # suffixes low..k on one side, k + 1..high on the other; an entry deeper than half of what is there has no square
    k = np.flatnonzero((depth > 0) & (2 * depth <= n))
    low, high, depth = low[k], high[k], depth[k]
    left = k - low + 1 <= high - k
    first, size = np.where(left, low, k + 1), np.where(left, k - low + 1, high - k)
    there, upto = np.where(left, k + 1, low), np.where(left, high, k)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total = np.cumsum(size)
    cuts = np.searchsorted(total, np.arange(TESTS_AT_ONCE, (total[-1] if len(total) else 0) + TESTS_AT_ONCE, TESTS_AT_ONCE), "right")
    begin = 0
    for stop in [*cuts.tolist(), len(k)]:
        stop = max(stop, min(begin + 1, len(k)))
        if begin == stop:
            continue
        part = slice(begin, stop)
        sizes = size[part]
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(begin, stop), sizes)
        suffix = order[first[of] + np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)]
        for ahead in (True, False):
            other = suffix + depth[of] if ahead else suffix - depth[of]
            inside = (other >= 0) & (other < n)
            at = rank[np.where(inside, other, 0)]
            hit = inside & (at >= there[of]) & (at <= upto[of])
            if hit.any():
                period = depth[of[hit]]
                start = suffix[hit] if ahead else other[hit]
                found.append((start + 2 * period, period))
        begin = stop
    if not found:
        return empty, empty, empty
    end, period = np.unique(np.array([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(end):
        # the least period at each end; its multiples whose square lies within its stretch have the same stretch
        first = np.append(True, end[1:] != end[:-1])
        start = _moved_left(codes, end[first], period[first])
        kept.append((start, end[first], period[first]))
        of = np.cumsum(first) - 1
        rest = ~first & ((period % period[first][of] > 0) | (end - 2 * period < start[of]))
        end, period = end[rest], period[rest]
    start, end, period = (np.concatenate(x) for x in zip(*kept, strict=True))
    keep = end - start >= np.maximum(least, times * period)
    start, end, period = start[keep], end[keep], period[keep]
    place = np.lexsort((period, start))
    return start[place], end[place], period[place]


def _moved_left(codes: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Where the stretch up to ``end`` in which codes ``period`` apart are equal begins: each period's last unequal pair before it."""
    out = np.empty(len(end), np.int64)
    order = np.argsort(period, kind="stable")
    cuts = np.flatnonzero(np.diff(period[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        mine = order[a:b]
        q = int(period[mine[0]])
        at, left = end[mine] - 2 * q, 16
        on = np.arange(len(mine))
        while len(on):
            # look back in growing steps, so the work follows the length of the run
            here = at[on][:, None] - np.arange(1, left + 1)
            same = (here >= 0) & (codes[np.maximum(here, 0)] == codes[np.maximum(here, 0) + q])
            more = np.where(same.all(axis=1), left, same.argmin(axis=1))
            at[on] -= more
            on = on[more == left]
            left = min(left * 4, 1 << 16)
        out[mine] = at
    return out


_FOUND = pa.schema([("did", pa.int64()), ("tag", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_binary())])


def _batch(held: list[tuple[int, int, list[bytes]]], least: int, times: int) -> Iterator[dict]:
    """Rows of the documents of one batch."""
    ids: dict[bytes, int] = {}
    code = ids.setdefault
    sizes = np.array([len(words) for *_, words in held])
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.empty(int(sizes.sum()) + len(held), np.int64)
    for i, (a, (_, _, words)) in enumerate(zip(starts.tolist(), held, strict=True)):
        codes[a : a + len(words)] = [code(w, len(ids)) for w in words]
        codes[a + len(words)] = -1 - i
    start, end, period = runs(codes, least, times)
    of = np.searchsorted(starts, start, "right") - 1
    cuts = np.searchsorted(of, np.arange(len(held) + 1))
    for i, (did, tag, words) in enumerate(held):
        a, b = int(cuts[i]), int(cuts[i + 1])
        base = int(starts[i])
        mine = [{"start": s - base, "length": e - s, "period": q} for s, e, q in zip(start[a:b].tolist(), end[a:b].tolist(), period[a:b].tolist(), strict=True)]
        keep = np.ones(len(words), bool)
        for r in mine:
            keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
        yield {"did": did, "tag": tag, "n_words": len(words), "runs": mine, "collapsed": b" ".join(compress(words, keep))}


def _find(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for did, tag, data in zip(longs(batch["did"]).tolist(), longs(batch["tag"]).tolist(), texts(batch["text"]), strict=True):
                words = data.tobytes().split()
                if held and n + len(words) > WORDS_A_BATCH:
                    yield pa.RecordBatch.from_pylist(list(_batch(held, least, times)), schema=_FOUND)
                    held, n = [], 0
                held.append((did, tag, words))
                n += len(words) + 1
            if held:
                yield pa.RecordBatch.from_pylist(list(_batch(held, least, times)), schema=_FOUND)

    return run


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, runs, collapsed).

    ``runs`` (start, length, period), in order of start and period, are the stretches of words whose least period is ``period``, of at least ``least`` words and
    ``times`` periods, that can't be made longer; runs of different periods may overlap. ``collapsed`` is the text without the words that lie in a run beyond its
    first period, joined by one space. Each document is settled within its row, so nothing is shuffled.
    Null and empty texts have no words, no runs and an empty text; repeated rows each get their row; a null doc_id stays null; an empty
    table gives no rows; other columns are ignored."""
    out = keyed(docs).mapInArrow(_find(least, times), "did long, tag long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.select(id_back(F.col("did")).alias("doc_id"), "n_words", "runs", F.decode("collapsed", "UTF-8").alias("collapsed"))

