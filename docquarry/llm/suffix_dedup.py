"""Exact substring de-duplication over bytes by a distributed, common-prefix-aware merge sort of suffixes.

Every byte is judged, but not every suffix is sorted. A window of ``window`` bytes is named by its least gram (an
*anchor*, half a window long), so equal windows have equal anchors at equal offsets. Anchors whose gram stands
once in the corpus can't lie in a repeated window and go. What stands to the right of each remaining anchor (a
suffix) and, read backwards, to its left (a suffix of the reversed text) is sorted twice over: tasks sort runs, code
them by front (length of the common prefix, then the rest), deal them out by ranges of a hash of the gram, and merge what they
receive with a loser tree that carries common prefixes along and never compares a known prefix again. Its lengths of common prefixes tell how
far each anchor's neighbours agree with it on both sides, hence which windows repeat. Offsets that no
single neighbour settles are decided by comparing hashes of those windows themselves.

Contexts that are equal over their whole length are counted before the sort, so a group of copies, however large, is one
suffix; a gram with a very large number of different contexts is spread by splitters of its own.

Where the first occurrence is to stay, the same merge also finds, for each suffix, the nearest ones in order that stand earlier in
the corpus and the offsets shared all the way to them.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrow import fewer, id_back, id_of, keyed, longs, text_tag, texts
from docquarry.llm.hashing import BLOCK, Rolling, as_long, byte_codes, minimizers
from docquarry.session import Scratch

GRAM_BYTES = 16
RUN_ROWS = 60_000
#: A gram with more contexts than this, and than one in HOT_SHARE of all, is spread by splitters.
HOT_ROWS, HOT_SHARE = 2_000, 1_000_000
_ANCHORS = pa.schema([("h", pa.int64()), ("did", pa.int64()), ("tag", pa.int64()), ("pos", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16())])


def _anchors(window: int):
    gram = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for did, tag, data in zip(longs(batch["did"]), longs(batch["tag"]), texts(batch["text"]), strict=True):
                if len(data) < window:
                    continue
                pos, lo, hi, h = minimizers(byte_codes(data), gram, window)
                parts.append((as_long(h), np.full(len(pos), did), np.full(len(pos), tag), pos.astype(np.int32), lo.astype(np.int16), hi.astype(np.int16)))
                held += len(pos)
                if held > 200_000:
                    yield fewer(parts, _ANCHORS)
                    parts, held = [], 0
            if parts:
                yield fewer(parts, _ANCHORS)

    return run


_PLACES = pa.schema([*((n, pa.int64()) for n in ("did", "tag", "c1", "c2", "g1", "g2")), ("pos", pa.int32()), ("lo", pa.int16()), ("hi", pa.int16()), ("side", pa.binary()), ("right", pa.binary())])


def _contexts(window: int):
    """Of each anchor its gram's hash, the bytes before it (read backwards), the bytes after it, and a hash of all."""
    gram, reach = window // 2, window - window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for did, tag, data, at in zip(longs(batch["did"]), longs(batch["tag"]), texts(batch["text"]), batch["at"], strict=True):
                rows = at.values
                pos, lo, hi = (rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                order = np.argsort(pos, kind="stable")
                pos, lo, hi = pos[order], lo[order], hi[order]
                for first in range(0, len(data), BLOCK):
                    i, j = np.searchsorted(pos, (first, first + BLOCK))
                    if i == j:
                        continue
                    here = pos[i:j]
                    base = max(0, first - reach)
                    part = data[base : first + BLOCK + window]
                    two = [Rolling(byte_codes(part, which), which) for which in (0, 1)]
                    s = here - base
                    a, b = np.maximum(0, s - reach), np.minimum(len(part), s + gram + reach)
                    keys = [r.ranges(a, b) * np.uint64(2 * reach + 1) + (s - a).astype(np.uint64) for r in two]
                    grams = [r.ranges(s, s + gram) for r in two]
                    whole = part.tobytes()
                    n = j - i
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, did)), pa.array(np.full(n, tag)), *(pa.array(as_long(x)) for x in (*keys, *grams)),
                            pa.array(here.astype(np.int32)), pa.array(lo[i:j].astype(np.int16)), pa.array(hi[i:j].astype(np.int16)),
                            pa.array([whole[x:y][::-1] for x, y in zip(a, s, strict=True)], pa.binary()),
                            pa.array([whole[x:y] for x, y in zip(s + gram, b, strict=True)], pa.binary()),
                        ],
                        schema=_PLACES,
                    )

    return run


def _strings(batch: pa.RecordBatch, first: str, second: str, reach: int) -> np.ndarray:
    """Rows of fixed width: the gram's hash, then the context sorted by, then the other one; short ones are padded."""
    out = np.zeros((batch.num_rows, GRAM_BYTES + 2 * reach), np.uint8)
    for k, name in enumerate(("g1", "g2")):
        out[:, 8 * k : 8 * k + 8] = np.frombuffer(longs(batch[name]).astype(">i8").tobytes(), np.uint8).reshape(-1, 8)
    for k, name in enumerate((first, second)):
        for row, value in enumerate(batch[name].to_pylist()):
            at = GRAM_BYTES + k * reach
            out[row, at : at + len(value)] = np.frombuffer(value, np.uint8)
    return out


def _prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the row before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


_RUNS = pa.schema([("dest", pa.int64()), ("run", pa.binary())])
_HEAD = np.dtype([("c1", "<i8"), ("c2", "<i8"), ("did", "<i8"), ("tag", "<i8"), ("pos", "<i4"), ("first", "<i2"), ("second", "<i2"), ("lcp", "<u2"), ("ghost", "?")])


def _sorted_runs(first: str, second: str, reach: int, dests: int, hot: dict[bytes, tuple[int, list[bytes]]]):
    """Sorted runs, front-coded, one piece for each destination.

    Destinations are equal ranges of the grams' second hash, which need no sample (the first is the least of its window, so it is small). Only a gram with very many contexts (``hot``) is cut further, by
    splitters of its own; its pieces also take along their neighbours beyond the splitters (ghosts), so every suffix meets its true neighbours."""

    def piece(rows: np.ndarray, head: np.ndarray) -> bytes:
        head["lcp"] = _prefixes(rows)
        keep = np.arange(rows.shape[1])[None, :] >= head["lcp"][:, None]
        return np.int64(len(head)).tobytes() + head.tobytes() + rows[keep].tobytes()

    def flush(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = _strings(batch, first, second, reach)
        order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        rows = rows[order]
        head = np.zeros(len(rows), _HEAD)
        for name in ("c1", "c2", "did", "tag", "pos"):
            head[name] = longs(batch[name])[order]
        for name, column in (("first", first), ("second", second)):
            head[name] = np.array([len(x) for x in batch[column].to_pylist()], np.int64)[order]
        upper = np.ascontiguousarray(rows[:, 8:12]).view(">u4").ravel().astype(np.uint64)
        dest = ((upper * np.uint64(dests)) >> np.uint64(32)).astype(np.int64)
        ghosts: dict[int, tuple[int, int]] = {}
        if hot:
            grams = [r.tobytes() for r in rows[:, :GRAM_BYTES]]
            for gram, (base, splitters) in hot.items():
                i, j = bisect.bisect_left(grams, gram), bisect.bisect_right(grams, gram)
                keys = [r.tobytes() for r in rows[i:j]]
                cuts = [i, *(i + bisect.bisect_left(keys, s) for s in splitters), j]
                for d, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    dest[x:y] = base + d
                    ghosts[base + d] = (x - 1 if x > i else -1, y if y < j else -1)
        by = np.argsort(dest, kind="stable")
        starts = np.flatnonzero(np.diff(dest[by], prepend=-1))
        members = {int(dest[by[i]]): by[i:j] for i, j in zip(starts, np.append(starts[1:], len(by)), strict=True)}
        dests_out, runs = [], []
        for d in sorted(members.keys() | ghosts.keys()):
            before, after = ghosts.get(d, (-1, -1))
            at = np.concatenate([[before] * (before >= 0), members.get(d, by[:0]), [after] * (after >= 0)]).astype(np.int64)
            if len(at):
                part = head[at]
                part["ghost"][:1] |= before >= 0
                part["ghost"][len(part) - 1 :] |= after >= 0
                dests_out.append(d)
                runs.append(piece(rows[at], part))
        yield pa.RecordBatch.from_arrays([pa.array(dests_out, pa.int64()), pa.array(runs, pa.binary())], schema=_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= RUN_ROWS:
                yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
        if sum(b.num_rows for b in held):
            yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _unpack(run: bytes, width: int) -> tuple[np.ndarray, list[bytes]]:
    n = int(np.frombuffer(run, np.int64, 1)[0])
    head = np.frombuffer(run, _HEAD, n, 8)
    at, rows, last = 8 + n * _HEAD.itemsize, [], b""
    for lcp in head["lcp"].tolist():
        last = last[:lcp] + run[at : at + width - lcp]
        at += width - lcp
        rows.append(last)
    return head, rows


def merge(runs: list[list[bytes]], lcps: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs by a loser tree; yields (run, index in it, common prefix with the row yielded before).

    Each waiting head keeps the length of its common prefix with the last row that beat it. Of two heads that lost to the
    same row, the one with more in common is smaller; only equal lengths need a comparison, from that length on."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    at = [0] * len(runs)
    heads: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    common = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's common prefix is then with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        la, lb = common[a], common[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        n = len(x)
        while la < n and x[la : la + 32] == y[la : la + 32]:
            la += 32
        while la < n and x[la] == y[la]:
            la += 1
        la = min(la, n)
        if la == n or x[la] < y[la]:
            common[b] = la
            return a, b
        common[a] = la
        return b, a

    losers, winners = [0] * k, list(range(k))
    size = k
    while size > 1:
        size //= 2
        rising = []
        for i in range(size):
            w, loser = play(winners[2 * i], winners[2 * i + 1])
            losers[size + i] = loser
            rising.append(w)
        winners = rising
    best = winners[0]
    while heads[best] is not None:
        yield best, at[best], common[best]
        at[best] += 1
        i = at[best]
        if i < len(runs[best]):
            heads[best], common[best] = runs[best][i], lcps[best][i]
        else:
            heads[best] = None
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


_SIDES = ("a1", "b1", "a2", "b2", "a3", "b3", "a4", "b4")
_NEIGHBOURS = pa.schema([("c1", pa.int64()), ("c2", pa.int64()), ("hat", pa.int16()), ("split", pa.bool_()), *((n, pa.int16()) for n in _SIDES)])


def _nearest_earlier(rank: list[int], a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Of each row, the offsets shared with the nearest row before it of lower rank: those that all links between share.

    ``a`` and ``b`` bound the offsets that a row shares with the row before. Rows that share an offset stand together, so the nearest of
    lower rank shares it wherever any does; a stack of rows of rising rank finds it in one pass."""
    left, right = [1] * len(rank), [0] * len(rank)
    stack: list[tuple[int, int, int]] = []
    for i, r in enumerate(rank):
        x, y = a[i], b[i]
        while stack and stack[-1][0] > r:
            _, p, q = stack.pop()
            x, y = max(x, p), min(y, q)
        if stack:
            left[i], right[i] = x, y
        stack.append((r, x, y))
    return left, right


def _merged(reach: int, right_first: bool, keep_first: bool):
    """Of each suffix: how far either neighbour agrees with it, the offsets of windows that it shares with each, and with the nearest
    suffixes on both sides that stand earlier in the corpus; ``split``: its gram goes on in another destination."""
    width = GRAM_BYTES + 2 * reach

    def run(table: pa.Table) -> pa.Table:
        unpacked = [_unpack(x, width) for x in table["run"].to_pylist()]
        # within a run a ghost may stand before or after others of its run, as all rows stay in order
        order = list(merge([rows for _, rows in unpacked], [h["lcp"].tolist() for h, _ in unpacked]))
        if not order:
            return _NEIGHBOURS.empty_table()
        starts = np.cumsum([0, *(len(h) for h, _ in unpacked)])
        head = np.concatenate([h for h, _ in unpacked])[[starts[r] + i for r, i, _ in order]]
        rows = np.frombuffer(b"".join(unpacked[r][1][i] for r, i, _ in order), np.uint8).reshape(-1, width)
        lcp = np.array([x for _, _, x in order], np.int64)
        lcp[0] = 0
        same = lcp >= GRAM_BYTES
        hat = np.where(same, np.minimum(lcp - GRAM_BYTES, reach), -1)
        other = np.minimum(_prefixes(rows[:, GRAM_BYTES + reach :]), reach)
        cut = lambda name, x: np.minimum(x, np.minimum(head[name], np.concatenate([head[name][:1], head[name][:-1]])))
        one, two = cut("first", hat), cut("second", other)
        right, left = (one, two) if right_first else (two, one)
        a, b = np.where(same, reach - right, reach + 1), np.where(same, left, -1)
        ahead = lambda x, none: np.append(x[1:], none)
        most = np.minimum(np.maximum(hat, ahead(hat, -1)), head["first"])
        real = ~head["ghost"]
        next_a, next_b = ahead(a, reach + 1), ahead(b, -1)
        earlier = [np.full(len(head), x) for x in (reach + 1, -1, reach + 1, -1)]
        if keep_first:
            rank = np.empty(len(head), np.int64)
            rank[np.lexsort((head["pos"], head["tag"], head["did"]))] = np.arange(len(head))
            earlier[:2] = map(np.array, _nearest_earlier(rank.tolist(), a.tolist(), b.tolist()))
            earlier[2:] = (np.array(x[::-1]) for x in _nearest_earlier(rank[::-1].tolist(), next_a[::-1].tolist(), next_b[::-1].tolist()))
        group = np.cumsum(~same)
        split = np.isin(group, group[~real])
        columns = (head["c1"], head["c2"], most, split, a, b, next_a, next_b, *earlier)
        return pa.Table.from_arrays([pa.array(x[real].astype(f.type.to_pandas_dtype())) for x, f in zip(columns, _NEIGHBOURS, strict=True)], schema=_NEIGHBOURS)

    return run


def _hot_grams(classes: DataFrame, rows_of_all: int, dests: int) -> dict[str, dict[bytes, tuple[int, list[bytes]]]]:
    """Splitters for either order of the grams with very many contexts, so that no destination has over about ``most`` rows of one.

    Of those grams alone, 4 keys of 80 bytes are sampled for each ``most`` rows: 4 * HOT_SHARE keys at the very most, whatever the corpus."""
    most = max(HOT_ROWS, rows_of_all // HOT_SHARE)
    hot = classes.groupBy("g1", "g2").agg(F.count("*").alias("m")).filter(F.col("m") > most)
    sizes = hot.orderBy("g1", "g2").collect()
    out: dict[str, dict[bytes, tuple[int, list[bytes]]]] = {"right": {}, "side": {}}
    if not sizes:
        return out
    gram = F.concat(F.unhex(F.lpad(F.hex("g1"), 16, "0")), F.unhex(F.lpad(F.hex("g2"), 16, "0")))
    # c2 is a hash, so this share of its range is a sample; any splitters give the same rows
    rows = classes.join(hot, ["g1", "g2"]).filter(F.pmod("c2", F.lit(1 << 20)) < (4 << 20) / most)
    for name in out:
        keys: dict[bytes, list[bytes]] = {}
        for r in rows.select(gram.alias("gram"), F.substring(F.col(name), 1, 64).alias("key")).collect():
            keys.setdefault(bytes(r.gram), []).append(bytes(r.gram) + bytes(r.key))
        base = dests
        for g1, g2, m in sizes:
            key = int(g1).to_bytes(8, "big", signed=True) + int(g2).to_bytes(8, "big", signed=True)
            found, parts = sorted(keys.get(key, [])), m // most + 1
            out[name][key] = (base, sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else [])
            base += parts
    return out


def _neighbours(classes: DataFrame, reach: int, dests: int, right_first: bool, hot: dict[str, dict[bytes, tuple[int, list[bytes]]]], keep_first: bool) -> DataFrame:
    first, second = ("right", "side") if right_first else ("side", "right")
    rows = classes.select("c1", "c2", "g1", "g2", "side", "right", F.col("one.did").alias("did"), F.col("one.tag").alias("tag"), F.col("one.pos").alias("pos"))
    runs = rows.mapInArrow(_sorted_runs(first, second, reach, dests, hot[first]), "dest long, run binary")
    return runs.groupBy("dest").applyInArrow(_merged(reach, right_first, keep_first), "c1 long, c2 long, hat short, split boolean, " + ", ".join(f"{n} short" for n in _SIDES))


def _windows(reach: int):
    """The windows themselves, as hashes, at each offset in a class's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((n, pa.int64()) for n in ("c1", "c2", "g1", "g2", "k1", "k2", "n")), ("p", pa.int32())])
        for batch in batches:
            parts: list[tuple] = []
            values = zip(*(batch[x].to_pylist() for x in ("c1", "c2", "g1", "g2", "n", "side", "right", "lo", "hi")), strict=True)
            for c1, c2, g1, g2, n, left, right, lo, hi in values:
                p = np.arange(max(lo, 0), hi + 1)
                p = p[(p <= len(left)) & (reach - p <= len(right))]
                keys = []
                for which in (0, 1):
                    one, two = (Rolling(byte_codes(np.frombuffer(x, np.uint8), which), which) for x in (left, right))
                    zero = np.zeros(len(p), np.int64)
                    keys.append(as_long(one.ranges(zero, p) * np.uint64(0x9E3779B97F4A7C15) + two.ranges(zero, reach - p)))
                parts.append((*(np.full(len(p), x) for x in (c1, c2, g1, g2)), *keys, np.full(len(p), n), p.astype(np.int32)))
            if parts:
                yield fewer(parts, schema)

    return run


def removable_spans(scratch: Scratch, docs: DataFrame, window: int, keep_first: bool = False) -> DataFrame:
    """(did, tag, a, b): spans of bytes that windows standing elsewhere too cover (``keep_first``: standing earlier too, by did, tag and
    place); of copies only one need be given."""
    spark, gram = docs.sparkSession, window // 2
    reach = window - gram
    anchors = scratch.save("anchors", docs.mapInArrow(_anchors(window), "h long, did long, tag long, pos int, lo short, hi short"))
    twice = scratch.save("twice", anchors.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    held = anchors.join(twice, "h").groupBy("did", "tag").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("at"))
    held = scratch.save("held", held)
    places = docs.join(held, ["did", "tag"]).mapInArrow(_contexts(window), "did long, tag long, c1 long, c2 long, g1 long, g2 long, pos int, lo short, hi short, side binary, right binary")
    places = scratch.save("places", places)
    scratch.drop("anchors", "twice", "held")
    classes = places.groupBy("c1", "c2").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("g1", "g2", "side", "right")), F.min(F.struct("did", "tag", "pos")).alias("one"))
    classes = scratch.save("classes", classes.withColumn("n", F.least("n", F.lit(2)).cast("int")))
    size = classes.count()
    dests = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // 20_000)
    hot = _hot_grams(classes, size, dests)
    order = lambda right, s: _neighbours(classes, reach, dests, right, hot, keep_first).withColumn("s", F.lit(s))
    sides = scratch.save("sides", order(True, "r").unionByName(order(False, "l")))
    pair = lambda i: F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"))
    listed = lambda *i: F.flatten(F.collect_list(F.array(*map(pair, i))))
    hat = lambda s: F.max(F.when(F.col("s") == s, F.col("hat")))
    found = sides.groupBy("c1", "c2").agg(hat("r").alias("r"), hat("l").alias("l"), listed(1, 2).alias("next"), listed(3, 4).alias("earlier"), F.bool_or("split").alias("split"))
    found = found.join(classes.select("c1", "c2", "n", "one"), ["c1", "c2"])
    # all offsets that can repeat lie from lo to hi; those in ``known`` do (or stand earlier too)
    known = F.array_sort(F.filter("earlier" if keep_first else "next", lambda x: x.a <= x.b)).cast("array<struct<a:int,b:int>>")
    found = found.select("c1", "c2", "one", (F.lit(reach) - F.col("r")).cast("int").alias("lo"), F.col("l").cast("int").alias("hi"), known.alias("known"), (F.col("n") > 1).alias("whole"), "next", "split")
    if keep_first:
        # where all neighbours share the same offsets, all that share one stand together, and the nearest earlier ones decide
        apart = F.col("split") | F.exists("next", lambda x: (x.a <= reach) & ((x.a > F.col("lo")) | (x.b < F.col("hi"))))
        is_open = (F.col("lo") <= F.col("hi")) & apart
    else:
        # offsets from lo on that the known ranges, in order, cover without a gap
        upto = F.aggregate("known", F.col("lo") - 1, lambda acc, x: F.when(x.a <= acc + 1, F.greatest(acc, x.b)).otherwise(acc))
        is_open = ~F.col("whole") & (upto < F.col("hi"))
    found = scratch.save("found", found.filter("whole or lo <= hi").withColumn("open", is_open).drop("next", "split"))
    scratch.drop("sides")
    nothing = F.lit(None).cast(found.schema["one"].dataType).alias("but")
    ranges = found.filter("true" if keep_first else "not whole").select("c1", "c2", F.explode("known").alias("k")).select("c1", "c2", F.col("k.a").alias("a"), F.col("k.b").alias("b"), nothing)
    # all places of a class with several repeat at every offset; where the first is kept, all but that
    whole = found.filter("whole").select("c1", "c2", F.lit(0).alias("a"), F.lit(reach).alias("b"), F.col("one").alias("but") if keep_first else nothing)
    ranges = ranges.unionByName(whole)
    open_grams = scratch.save("open", found.filter("open").join(classes.select("c1", "c2", "g1", "g2"), ["c1", "c2"]).select("g1", "g2").distinct())
    if open_grams.head(1):
        asked = classes.join(open_grams, ["g1", "g2"]).join(found.filter("lo <= hi" if keep_first else "true").select("c1", "c2", "lo", "hi"), ["c1", "c2"])
        rows = asked.select("c1", "c2", "g1", "g2", F.col("n").cast("long").alias("n"), "side", "right", "lo", "hi").mapInArrow(_windows(reach), "c1 long, c2 long, g1 long, g2 long, k1 long, k2 long, n long, p int")
        name = ["g1", "g2", "p", "k1", "k2"]
        if keep_first:
            rows = scratch.save("rows", rows.join(classes.select("c1", "c2", "one"), ["c1", "c2"]).drop("n"))
            met = rows.groupBy(*name).agg(F.min("one").alias("least"), F.count("*").alias("m")).filter("m > 1").drop("m")
            more = rows.join(scratch.save("met", met), name).filter("one <> least")
        else:
            rows = scratch.save("rows", rows)
            more = rows.join(scratch.save("met", rows.groupBy(*name).agg(F.sum("n").alias("m")).filter("m > 1").drop("m")), name)
        ranges = ranges.unionByName(more.select("c1", "c2", F.col("p").alias("a"), F.col("p").alias("b"), nothing))
    ranges = scratch.save("ranges", ranges)
    spans = places.select("did", "tag", "pos", "lo", "hi", "c1", "c2").join(ranges, ["c1", "c2"])
    spans = spans.withColumns({"p": F.greatest("a", "lo"), "q": F.least("b", "hi")}).filter("p <= q").filter(F.col("but").isNull() | (F.struct("did", "tag", "pos") != F.col("but")))
    spans = scratch.save("spans", spans.select("did", "tag", (F.col("pos") - F.col("q")).alias("a"), (F.col("pos") - F.col("p") + window).alias("b")))
    scratch.drop("places", "classes", "found", "open", "rows", "met", "ranges")
    return spans


def union_of(spans: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs that (start, end) rows cover."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    ends = reach[np.append(fresh[1:], len(spans)) - 1]
    return [(int(a), min(int(b), length)) for a, b in zip(spans[fresh, 0], ends, strict=True)]


def with_spans(docs: DataFrame, window: int, keep_first: bool = False) -> DataFrame:
    """``docs`` (did, tag, text and what else it has) with ``whole`` (every byte goes) and ``spans``, arrays of (a, b) to unite."""
    scratch = Scratch(docs.sparkSession, "suffix")
    sums = docs.select("did", "tag", F.sha2("text", 256).alias("sum"), F.octet_length("text").alias("size")).filter(F.col("size") >= window)
    sums = scratch.save("sums", sums.distinct() if keep_first else sums)
    groups = scratch.save("groups", sums.groupBy("sum").agg(F.count("*").alias("copies"), F.min(F.struct("did", "tag")).alias("one")).filter("copies > 1"))
    copies = sums.join(groups, "sum")
    copies = copies.filter(F.struct("did", "tag") != F.col("one")) if keep_first else copies
    copies = scratch.save("copies", copies.select("did", "tag").distinct())
    spans = removable_spans(scratch, docs.select("did", "tag", "text"), window, keep_first)
    spans = spans.join(copies, ["did", "tag"], "left_anti").groupBy("did", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    info = spans.withColumn("whole", F.lit(False)).unionByName(copies.select("did", "tag", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("whole")))
    return docs.join(scratch.save("info", info), ["did", "tag"], "left")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for did, data, whole, spans in zip(longs(batch["did"]), texts(batch["text"]), batch["whole"].to_pylist(), batch["spans"], strict=True):
            runs = [(0, len(data))] if whole else kept_spans(spans, len(data))
            keep, at = hashlib.sha256(), 0
            for a, b in runs:
                keep.update(data[at:a])
                at = b
            keep.update(data[at:])
            out.append((int(did), len(data), sum(b - a for a, b in runs), len(runs), keep.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(("did", "n_bytes", "n_removed", "n_spans", "kept_sha256"), x, strict=True)) for x in out], schema=_DIGEST)


_DIGEST = pa.schema([*((n, pa.int64()) for n in ("did", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string())])


def kept_spans(spans: pa.Scalar, length: int) -> list[tuple[int, int]]:
    if not spans.is_valid:
        return []
    rows = spans.values
    return union_of(np.stack([rows.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], 1), length)


def remove_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """Per document the bytes removed: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Every byte that a ``window``-byte string standing anywhere else covers goes, first occurrence included; strings
    are judged on the input. Null and empty texts have 0 bytes; texts shorter than the window stay whole; rows repeated under one
    id count as copies; an empty table gives no rows; other columns are ignored."""
    named = keyed(docs)
    out = with_spans(named, window).select("did", "text", "whole", "spans").mapInArrow(_digest, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(id_back(F.col("did")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _cut(names: list[str]):
    """The columns ``names`` from (rest, text, whole, spans), the text without what goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_out = []
            for data, whole, spans in zip(texts(batch["text"]), batch["whole"].to_pylist(), batch["spans"], strict=True):
                keep, at = [], 0
                for a, b in [(0, len(data))] if whole else kept_spans(spans, len(data)):
                    while a < b and data[a] & 0xC0 == 0x80:  # a character that is removed in part stays
                        a += 1
                    while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
                        b -= 1
                    keep.append(data[at:a].tobytes())
                    at = b
                keep.append(data[at:].tobytes())
                texts_out.append(b"".join(keep).decode("utf-8", "replace"))
            columns = [pa.array(texts_out, batch["text"].type) if n == "text" else batch["rest"].field(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def cut_repeats(docs: DataFrame, window: int = 400, keep_first: bool = False) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` by whole characters; columns and rows stay, and n_chars follows.

    ``keep_first``: of each ``window``-byte string, what stands first stays, by doc_id (null is least), then by a hash of the text, then by place;
    else every occurrence goes, as in remove_repeats. Null and empty texts become empty; texts shorter than the window stay; rows that repeat an id and text
    are cut alike (they count as copies unless the first is kept); an empty table stays empty; other columns may have any names."""
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(F.struct(*rest).alias("rest"), text.alias("text"), id_of(F.col("doc_id")).alias("did"), text_tag(F.col("text")).alias("tag"))
    out = with_spans(marked, window, keep_first).select("rest", "text", "whole", "spans").mapInArrow(_cut(docs.columns), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
