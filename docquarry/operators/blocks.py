"""An index in blocks: postings with the bounds of each block, and exact search that leaves out what can't reach a query's result.

Points with alike terms stand next to each other (by the least hash of their first terms, which texts of one language or topic share, and, of those that are coded together, by length),
within the partition that reads them, so texts cross no shuffle. Each SIZE of them are a block, and a block is one row: its points, its terms with the places and counts of their postings, and the buckets of
their hashed vectors likewise. For each term the least length of the points that have it once, twice and more often, and its greatest count, bound what it can add to a score there, whatever the mean
length is by then. A block is searched where it is read, for all queries of a group at once:
terms whose bounds together stay under a query's k-th score so far are only looked up for points that can
still reach it. The first k-th scores come from a few blocks; each task goes on with its own. Neither postings nor rows of (query, point) are shuffled, but the k best of each task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.text import plain, runs, tokens
from docquarry.session import READING, Scratch, settings

#: Points of a block. Its places fit 16 bits.
SIZE = 512
#: A length that no text has.
NEVER = (1 << 31) - 1
#: A block's number: its segment, then 20 bits each for the partition that made it and its place there.
SEGMENT_BITS = 40
#: Blocks that are searched first, for the first bounds; any number gives the same rows.
FIRST_BLOCKS = 8
#: Blocks that a task gets at a time: to be searched, and to have their terms counted.
AT_ONCE, COUNTED = 16, 64
#: Plain texts that are cut at a time.
CUT = 4096
#: Texts that are coded at a time, so many or of so many bytes: whole blocks, and a word that many of them have is hashed and looked up once.
CODING = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(128 * SIZE), "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}
#: Queries that are scored at a time: a task holds so many scores for each point of a block.
QUERIES = 1024
#: Terms that so many queries have, with more postings for all of them than one in DENSE of (queries x points), are scored in a product of matrices; any numbers give the same rows.
DENSE, DENSE_QUERIES = 128, 8
#: Bytes of a row group of blocks, of which readers hold one; of blocks that are written for one search.
GROUP, ONCE = 16 << 20, 4 << 20
#: Terms of a text that say what it stands next to; any number gives the same rows.
ALIKE = 16
#: Buckets of words that a task remembers.
KNOWN = 500_000
#: Scores are ranked by 6 decimals: what is within this of a bound is scored.
SLACK = 2e-6
#: What stands between the terms of a text on their way to the blocks.
BETWEEN = "\0"

#: Numbers as bytes: dl, ends, starts, tf_max, tf, v_starts, v_n int32; dl_min 3 int32 a term; at, v_at uint16. names: all terms one behind the other, ``ends`` where each ends.
ROWS = "block long, points array<long>, filled int, total long, dl binary, names binary, ends binary, starts binary, tf_max binary, dl_min binary, at binary, tf binary, v_starts binary, v_at binary, v_n binary"
KINDS = {"postings": ["block", "points", "filled", "total", "dl", "names", "ends", "starts", "tf_max", "dl_min", "at", "tf"], "vectors": ["block", "points", "v_starts", "v_at", "v_n"]}
_ROWS = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (x.split() for x in ROWS.split(", "))])


def alike(terms: Column) -> Column:
    """A sort key that brings texts with common terms together: the least hash of their first ALIKE terms."""
    return F.array_min(F.transform(F.slice(terms, 1, ALIKE), lambda t: F.xxhash64(t)))


class _Buckets:
    """The buckets of words, as functions.text.bucket has them; each word is hashed once while it is among the last KNOWN."""

    def __init__(self, dim: int) -> None:
        self.dim, self.names, self.of = dim, pa.array([], pa.string()), np.zeros(0, np.int64)

    def __call__(self, words: pa.Array) -> np.ndarray:
        if len(self.names) > KNOWN:
            self.__init__(self.dim)
        where = pc.index_in(words, value_set=self.names)
        new = words.filter(where.is_null())
        hashed = b"".join(hashlib.md5(w).digest() for w in new.cast(pa.binary()).to_pylist())
        where = pc.fill_null(where, -1).to_numpy()
        where = np.where(where < 0, len(self.names) + np.cumsum(where < 0) - 1, where)
        self.names, self.of = pa.concat_arrays([self.names, new]), np.append(self.of, np.frombuffer(hashed, ">u4")[::4].astype(np.int64) % self.dim)
        return self.of[where]


def _text(names: pa.Array) -> tuple[bytes, np.ndarray]:
    """All strings one behind the other, and where each ends."""
    names = pa.concat_arrays([names.cast(pa.string())])
    ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]
    data = names.buffers()[2]
    return (data.to_pybytes()[ends[0] : ends[-1]] if data else b""), (ends[1:] - ends[0]).astype(np.int32)


def _terms(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of all texts of a batch, how many each text has, and where they begin: first those of plain texts, then what others were cut into."""
    parts = [runs(batch["plain"].slice(i, CUT)) for i in range(0, batch.num_rows, CUT)]
    lists = pc.split_pattern(batch["terms"], BETWEEN)
    few, many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
    begin = np.where(few > 0, many.sum() + np.cumsum(few) - few, np.cumsum(many) - many)
    return pa.concat_arrays([pa.array([], pa.string()), *(w for w, _ in parts), lists.flatten()]), few + many, begin


def _rows(segment: int, size: int, dim: int):
    """A row for each block of the points of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, known = (segment << SEGMENT_BITS) | (TaskContext.get().partitionId() << 20), 0, _Buckets(dim)
        for batch in batches:
            words, all_lengths, begin = _terms(batch)
            coded = words.dictionary_encode()
            # numbers of 4 bytes sort faster, where they suffice
            all_codes = coded.indices.to_numpy().astype(np.int32 if max(len(coded.dictionary), dim) * size < NEVER else np.int64)
            bucket = known(coded.dictionary).astype(all_codes.dtype) if dim else None
            ids = batch["point_id"].to_numpy()
            order = np.lexsort((ids, all_lengths, pc.fill_null(batch["alike"], 0).to_numpy()))
            for i in range(0, batch.num_rows, size):
                mine = order[i : i + size]
                points, dl = ids[mine], all_lengths[mine]
                codes = all_codes[_flat(begin[mine], dl)]
                where = np.repeat(np.arange(len(points), dtype=codes.dtype), dl)
                pair, tf = np.unique(codes * size + where, return_counts=True)
                term, at = pair // size, pair % size
                cuts = np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)])
                level, n = np.minimum(tf, 3), len(cuts)
                least = [np.minimum.reduceat(np.where(level == j, dl[at], NEVER), cuts) if n else np.zeros(0) for j in (1, 2, 3)]
                names, ends = _text(coded.dictionary.take(pa.array(term[cuts])))
                row = {
                    "block": base + made, "points": points, "filled": int((dl > 0).sum()), "total": int(dl.sum()), "dl": dl.astype(np.int32), "names": names, "ends": ends, "starts": np.append(cuts, len(term)).astype(np.int32),
                    "tf_max": (np.maximum.reduceat(tf, cuts) if n else tf).astype(np.int32), "dl_min": np.stack(least, axis=1).astype(np.int32), "at": at.astype(np.uint16), "tf": tf.astype(np.int32),
                }
                if dim:
                    cell, of = np.unique(bucket[codes] * size + where if n else codes, return_counts=True)
                    row |= {"v_starts": np.searchsorted(cell, np.arange(dim + 1) * size).astype(np.int32), "v_at": (cell % size).astype(np.uint16), "v_n": of.astype(np.int32)}
                made += 1
                as_is = lambda x: x.tobytes() if isinstance(x, np.ndarray) else x
                yield pa.RecordBatch.from_arrays([pa.array([v if f.name == "points" else as_is(v)], f.type) for f in _ROWS for v in (row.get(f.name),)], schema=_ROWS)

    return run


def _cut(points: DataFrame, text: str, cut: Callable[[Column], Column], *keep: str) -> DataFrame:
    """(keep..., plain, cut): a plain text in lower case, or what another one is cut into."""
    whole = plain(F.col(text)) if cut is tokens else F.lit(None).cast("string")
    rows = points.select(*keep, text, whole.alias("plain"))
    return rows.select(*keep, "plain", F.when(F.col("plain").isNull(), F.coalesce(cut(F.col(text)), F.array().cast("array<string>"))).alias("cut"))


def build(points: DataFrame, text: str, path: str, segment: int = 0, dim: int = 0, size: int = SIZE, cut: Callable[[Column], Column] = tokens) -> None:
    """Write the blocks of ``points`` (point_id, ``text``, ...) under ``path``; ``dim``: also hashed vectors of so many buckets.

    Texts are cut into terms once, by ``cut``, and sorted within the partitions they are read in; the plain ones, which ``tokens`` cuts into runs of letters and digits, are cut many at a
    time where blocks are made. A null text has no terms; ids that repeat are points of their own."""
    rows = _cut(points, text, cut, "point_id")
    opening = F.split(F.substring("plain", 1, ALIKE * 8), " ")
    rows = rows.select("point_id", F.coalesce(alike(opening), alike(F.col("cut"))).alias("alike"), "plain", F.when(F.size("cut") > 0, F.array_join("cut", BETWEEN)).alias("terms"))
    with settings(points.sparkSession, CODING | READING):
        rows.sortWithinPartitions("alike", "point_id").mapInArrow(_rows(segment, size, dim), ROWS).write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The columns of a kind of the blocks that ``build`` wrote; of an index without points there are none."""
    return spark.read.schema(ROWS).parquet(path).select(*KINDS[kind])


def _names(row: dict) -> pa.Array:
    ends = np.frombuffer(row["ends"], np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(np.int32(0), ends).astype(np.int32).tobytes()), pa.py_buffer(row["names"]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of some blocks together: how many points have the term."""
    for batch in batches:
        rows = batch.to_pylist()
        if rows:
            n = np.concatenate([np.diff(np.frombuffer(row["starts"], np.int32)) for row in rows])
            sums = pa.table({"term": pa.concat_arrays([_names(row) for row in rows]), "n": pa.array(n, pa.int64())}).group_by("term").aggregate([("n", "sum")])
            yield from sums.select(["term", "n_sum"]).rename_columns(["term", "n"]).to_batches()


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df)."""
    return postings.select("names", "ends", "starts").mapInArrow(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some texts together (term, n): how many have the term; and a row without a term: texts, texts with a term, terms."""
    for batch in batches:
        words, lengths, begin = _terms(batch)
        coded, order = words.dictionary_encode(), np.argsort(begin, kind="stable")
        where = np.repeat(order, lengths[order])
        held = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, batch.num_rows) + where)
        n = np.bincount(held // max(1, batch.num_rows), minlength=len(coded.dictionary))
        zeros = np.zeros(len(n), np.int64)
        columns = [np.append(n, batch.num_rows), np.append(zeros, np.count_nonzero(lengths)), np.append(zeros, lengths.sum())]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())]), *(pa.array(c, pa.int64()) for c in columns)], names=["term", "n", "filled", "total"])


def text_counts(points: DataFrame, text: str, scratch: Scratch, name: str, cut: Callable[[Column], Column] = tokens) -> tuple[DataFrame, tuple[int, int, int]]:
    """(term, df) of texts that are in no blocks of their own, cut once, as a table of ``scratch``, and their totals as ``totals`` has them."""
    rows = _cut(points, text, cut).select("plain", F.when(F.size("cut") > 0, F.array_join("cut", BETWEEN)).alias("terms"))
    with settings(points.sparkSession, CODING):
        held = scratch.save(name, rows.mapInArrow(_text_counts, "term string, n long, filled long, total long"), int(CODING["spark.sql.execution.arrow.maxRecordsPerBatch"]))
    row = held.filter("term is null").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "filled", "total"))).first()
    return held.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")), tuple(row)


def totals(postings: DataFrame) -> tuple[int, int, int]:
    """(points, points with a term, terms)."""
    row = postings.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (F.size("points"), "filled", "total"))).first()
    return tuple(row)


class Queries:
    """What the tasks hold of a group of queries: their terms (names, or buckets of vectors) with weights, what each must equal, and the first bounds."""

    def __init__(self, ids: list[int], terms: list[dict[int, float]], same: list[int | None], k: int, names: list[str] | None = None, mean: float = 1.0, k1: float = 1.5, b: float = 0.75) -> None:
        self.ids, self.k, self.names, self.mean, self.k1, self.b = ids, k, names, mean, k1, b
        self.bound_to = np.array([x is not None for x in same], bool)
        self.same = np.array([x or 0 for x in same], np.int64)
        self.bounds = np.full(len(ids), -np.inf)
        q, t = (np.array([x[i] for x in ((q, t) for q, held in enumerate(terms) for t in held)], np.int64) for i in (0, 1))
        w = np.array([w for held in terms for w in held.values()], float)
        width = len(names) if names is not None else int(t.max(initial=-1)) + 1
        #: For each QUERIES queries: (first query, end, where the queries of each term start, queries, weights), by term.
        self.slices = []
        for first in range(0, len(ids), QUERIES):
            mine = np.flatnonzero((q >= first) & (q < first + QUERIES))
            mine = mine[np.argsort(t[mine], kind="stable")]
            self.slices.append((first, min(first + QUERIES, len(ids)), np.searchsorted(t[mine], np.arange(width + 1)), q[mine] - first, w[mine]))

    def part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.mean))


def _flat(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many each."""
    return np.repeat(starts - np.append(0, np.cumsum(n)[:-1])[: len(n)], n) + np.arange(n.sum())


class Lexical:
    """The postings of a block whose terms are asked for: row by row of ``term``, from ``starts`` on ``n`` postings at places ``at``; ``top`` bounds what each adds."""

    def __init__(self, row: dict, queries: Queries, vocabulary: pa.Array) -> None:
        self.queries, self.dl = queries, np.frombuffer(row["dl"], np.int32).astype(float)
        where = pc.fill_null(pc.index_in(_names(row), value_set=vocabulary), -1).to_numpy()
        held = np.flatnonzero(where >= 0)
        starts = np.frombuffer(row["starts"], np.int32).astype(np.int64)
        self.term, self.starts, self.n = where[held], starts[held], starts[held + 1] - starts[held]
        self.at, self.tf = np.frombuffer(row["at"], np.uint16), np.frombuffer(row["tf"], np.int32)
        most, least = np.frombuffer(row["tf_max"], np.int32)[held], np.frombuffer(row["dl_min"], np.int32).reshape(-1, 3)[held]
        tops = [np.where(least[:, j] < NEVER, queries.part(tf, least[:, j]), 0.0) for j, tf in enumerate((1.0, 2.0, most))]
        self.top = np.maximum(np.maximum(tops[0], tops[1]), tops[2])

    def part(self, where: np.ndarray) -> np.ndarray:
        return self.queries.part(self.tf[where], self.dl[self.at[where]])


class Vectors:
    """The same of a block's hashed vectors: its buckets are the terms."""

    def __init__(self, row: dict, queries: Queries, vocabulary: pa.Array | None) -> None:
        starts = np.frombuffer(row["v_starts"], np.int32).astype(np.int64)
        n = np.diff(starts)
        held = np.flatnonzero(n)
        self.term, self.starts, self.n = held, starts[held], n[held]
        self.at, of = np.frombuffer(row["v_at"], np.uint16), np.frombuffer(row["v_n"], np.int32).astype(float)
        self.weight = of / np.sqrt(np.bincount(self.at, of * of, minlength=len(row["points"])))[self.at]
        self.top = np.maximum.reduceat(self.weight, self.starts) if len(held) else np.zeros(0)
        asked = held < len(queries.slices[0][2]) - 1
        self.term, self.starts, self.n, self.top = (x[asked] for x in (self.term, self.starts, self.n, self.top))

    def part(self, where: np.ndarray) -> np.ndarray:
        return self.weight[where]


def search_block(held: Lexical | Vectors, n: int, queries: tuple, least: np.ndarray, counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) in a block of n points of all above 0 that reach ``least`` of their query; counts: postings read or looked up, and those that the queries have."""
    first, end, by_term, qs, ws = queries
    many = by_term[held.term + 1] - by_term[held.term]
    row, of = np.repeat(np.arange(len(held.term)), many), _flat(by_term[held.term], many)
    q, w = qs[of], ws[of]
    counts[1] += int(held.n[row].sum())
    bound = np.maximum(w * held.top[row], 0.0)
    most = np.bincount(q, bound, minlength=end - first)
    live = most[q] >= least[q]
    row, q, w, bound = row[live], q[live], w[live], bound[live]
    order = np.lexsort((-bound, q))
    row, q, w, bound = row[order], q[order], w[order], bound[order]
    upto = np.append(0.0, np.cumsum(bound))
    begin = np.searchsorted(q, np.arange(end - first))
    rest = most[q] - (upto[:-1] - upto[begin[q]])  # what terms from here on can add
    asked = np.bincount(row, minlength=len(held.n))
    common = (asked >= DENSE_QUERIES) & (asked * held.n * DENSE > (end - first) * n)
    dense = common[row]
    essential = (rest >= least[q]) | (least[q] <= 0) | dense

    def added(pick: np.ndarray) -> np.ndarray:
        lens = held.n[row[pick]]
        used = np.zeros(len(held.n), bool)
        used[row[pick]] = True
        parts = np.zeros(len(held.at))
        where = _flat(held.starts[used], held.n[used])
        parts[where] = held.part(where)
        where = _flat(held.starts[row[pick]], lens)
        counts[0] += len(where)
        return np.bincount(np.repeat(q[pick] * n, lens) + held.at[where], np.repeat(w[pick], lens) * parts[where], minlength=(end - first) * n).reshape(-1, n)

    score = added(essential & ~dense)
    if dense.any():
        matrix, weights, places = np.zeros((int(common.sum()), n)), np.zeros((end - first, int(common.sum()))), np.cumsum(common) - 1
        where = _flat(held.starts[common], held.n[common])
        matrix[np.repeat(np.arange(len(matrix)), held.n[common]), held.at[where]] = held.part(where)
        weights[q[dense], places[row[dense]]] = w[dense]
        counts[0] += int(held.n[row[dense]].sum())
        score = score + weights @ matrix
    other = np.flatnonzero(~essential)
    after = np.bincount(q[other], bound[other], minlength=end - first)
    of_q, place = np.nonzero((score > 0) & (score + after[:, None] >= least[:, None]))
    score, found = score[of_q, place], of_q * n + place
    if len(other) and len(found):
        n_other = np.bincount(q[other], minlength=end - first)
        if 4 * n_other[of_q].sum() > held.n[row[other]].sum():
            s = score + added(~essential)[of_q, found % n]
        else:
            begin = np.append(0, np.cumsum(n_other))[:-1]
            which, pair = np.repeat(np.arange(len(found)), n_other[of_q]), other[_flat(begin[of_q], n_other[of_q])]
            all_ = _flat(held.starts, held.n)
            keys = np.repeat(np.arange(len(held.n)) * n, held.n) + held.at[all_]
            key = row[pair] * n + found[which] % n
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[place] == key)
            counts[0] += len(hit)
            s = score + np.bincount(which[hit], w[pair[hit]] * held.part(all_[place[hit]]), minlength=len(found))
    else:
        s = score
    keep = s >= least[of_q]
    return of_q[keep] + first, found[keep] % n, s[keep]


def _best(q: np.ndarray, p: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query, and which of them are the k-th."""
    order = np.lexsort((p, -np.round(s, 6), q))
    q, p, s = q[order], p[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], p[keep], s[keep], place[keep] == k - 1


def _searched(queries: Queries, kind: type, use: bool):
    """The k best points of each query in a task's blocks, as (q, point_id, score); at last a row (-1, postings read, postings that the queries have)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least, counts = (queries.bounds if use else np.full(len(queries.ids), -np.inf)) - SLACK, [0, 0]
        vocabulary = None if queries.names is None else pa.array(queries.names, pa.string())
        for row in (_taken(batch, i) for batch in batches for i in range(batch.num_rows)):
            held, points = kind(row, queries, vocabulary), row["points"]
            for part in queries.slices:
                q, at, s = search_block(held, len(points), part, least[part[0] : part[1]], counts)
                good = np.round(s, 6) > 0 if kind is Lexical else s > 0
                if row["allowed"] is not None:
                    open_ = np.zeros(len(points), bool)
                    open_[row["allowed"]] = True
                    good &= open_[at]
                if row["groups"] is not None:
                    group = np.zeros(len(points), np.int64)
                    group[row["groups"][0]] = row["groups"][1]
                    good &= ~queries.bound_to[q] | (group[at] == queries.same[q])
                if good.any():
                    *top, last = _best(*(np.concatenate(x) for x in zip(top, (q[good], points[at[good]], s[good]), strict=True)), queries.k)
                    least[top[0][last]] = np.maximum(least[top[0][last]], top[2][last] - SLACK)
        if len(top[0]):
            yield pa.RecordBatch.from_arrays([pa.array(top[0].astype(np.int32)), pa.array(top[1]), pa.array(top[2])], names=["q", "point_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([counts[0]], pa.int64()), pa.array([float(counts[1])])], names=["q", "point_id", "score"])

    return run


def _taken(batch: pa.RecordBatch, i: int) -> dict:
    """A block's row with its lists as arrays of numbers."""
    row = {n: batch[n][i] for n in batch.schema.names}
    out = {n: x.as_buffer() if pa.types.is_binary(x.type) else None for n, x in row.items()}
    out["points"] = row["points"].values.to_numpy()
    out["allowed"] = row["allowed"].values.to_numpy() if row["allowed"].is_valid else None
    out["groups"] = tuple(row["groups"].values.field(j).to_numpy() for j in (0, 1)) if row["groups"].is_valid else None
    return out


def blocks_of(blocks: DataFrame, allowed: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``blocks`` with the places of those ``allowed`` (point_id[, segment]) and what ``groups`` (point_id, of) they are in; blocks with none allowed are left out."""
    where = blocks.select("block", F.shiftright("block", SEGMENT_BITS).alias("segment"), F.posexplode("points").alias("at", "point_id"))
    rows = blocks
    if allowed is not None:
        on = ["point_id", "segment"] if "segment" in allowed.columns else ["point_id"]
        rows = rows.join(where.join(allowed.select(*on), on, "left_semi").groupBy("block").agg(F.collect_list("at").alias("allowed")), "block")
    else:
        rows = rows.withColumn("allowed", F.lit(None).cast("array<int>"))
    if groups is not None:
        return rows.join(where.join(groups, "point_id").groupBy("block").agg(F.collect_list(F.struct("at", "of")).alias("groups")), "block", "left")
    return rows.withColumn("groups", F.lit(None).cast("array<struct<at:int,of:long>>"))


def searched(scratch: Scratch, name: str, index: DataFrame, queries: Queries, allowed: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(q, point_id, score) of the blocks of ``index``, k of each query and task, and a row of counts for each task (see _searched), as a table of ``scratch``."""
    kind, schema = Vectors if queries.names is None else Lexical, "q int, point_id long, score double"
    blocks = blocks_of(index, allowed, groups)
    narrow = allowed is not None or groups is not None
    if narrow:
        with settings(scratch.spark, {"parquet.block.size": str(ONCE)}):
            blocks = scratch.save(f"{name}-blocks", blocks)
    first = [r[0] for r in blocks.select("block").limit(FIRST_BLOCKS).collect()]
    found = blocks.filter(F.col("block").isin(first)).mapInArrow(_searched(queries, kind, False), schema).filter("q >= 0")
    least = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), queries.k, 1).alias("s")).filter(F.size("s") > 0)
    for q, s in least.collect() if first else []:  # one number a query of the group
        queries.bounds[q] = s[0]
    with settings(scratch.spark, READING):
        out = scratch.save(name, blocks.mapInArrow(_searched(queries, kind, True), schema), AT_ONCE)
    if narrow:
        scratch.drop(f"{name}-blocks")
    return out
