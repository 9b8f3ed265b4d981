"""Ranked lexical search by presence masks.

Documents are read twice, in tasks. First each is cut into terms and only what the queries ask for is kept: a list of term numbers
with their counts, besides the corpus' totals. Then each block of documents is turned into a bitmap for each term; for a query the
bitmaps of its terms, side by side, give each document's mask of terms that it has, and documents of one mask form a group. A mask has a greatest
possible score (each of its terms at the best that the block holds). Masks are evaluated from the greatest down, exactly, until
no mask left can reach the query's k-th score so far, in this block or in those that the task saw before. Each task passes on k rows a query."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, id_of, longs, texts
from docquarry.session import Scratch

#: Queries are taken in groups of so many bytes of text at most (a query by itself may be longer), so that what each task holds of them is bounded.
GROUP_BYTES = 16 << 20

#: Bytes to bytes: A-Z in lower case, letters and digits of ASCII and all above it as they are, the rest as blanks.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TERMS).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


_COUNTS = "did long, n long, at binary, tf binary, kind int"
_COUNTS_SCHEMA = pa.schema([("did", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("tf", pa.binary()), ("kind", pa.int32())])


def _counted(vocabulary: dict[bytes, int]):
    """Of each document with a term its number of terms and, of those asked for, numbers and counts (kind 0); at last a task's documents of each term (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, find = np.zeros(len(vocabulary), np.int64), vocabulary.get
        for batch in batches:
            rows: list[tuple[int, int, bytes, bytes, int]] = []
            for did, data in zip(longs(batch["did"]).tolist(), texts(batch["text"]), strict=True):
                words = terms(data.tobytes())
                if not words:
                    continue
                found = sorted((j, c) for w, c in Counter(words).items() if (j := find(w)) is not None)
                pairs = np.array(found, np.int32).reshape(-1, 2)
                df[pairs[:, 0]] += 1
                rows.append((did, len(words), pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _COUNTS_SCHEMA, strict=True)], schema=_COUNTS_SCHEMA)
        at = np.flatnonzero(df)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((0, 0, part.astype(np.int32).tobytes(), df[part].tobytes(), 1), _COUNTS_SCHEMA, strict=True)], schema=_COUNTS_SCHEMA)

    return run


_DF = pa.schema([("term", pa.int32()), ("df", pa.int64())])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, df in zip(batch["at"], batch["tf"], strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(at.as_py(), np.int32)), pa.array(np.frombuffer(df.as_py(), np.int64))], schema=_DF)


class Block:
    """Documents with what each posting adds to a score but for its term's weight."""

    def __init__(self, dids: np.ndarray, n: np.ndarray, sizes: np.ndarray, at: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> None:
        m = 10 + (90 * n * n_docs) // n_terms
        self.dids, self.at = dids, at
        self.doc = np.repeat(np.arange(len(dids)), sizes)
        self.starts = np.cumsum(sizes) - sizes
        self.sizes = sizes
        self.part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        order = np.argsort(at, kind="stable")
        self.held, first = np.unique(at[order], return_index=True)
        self.best = np.maximum.reduceat(self.part[order], first) if len(first) else self.part[:0]
        self.bits = np.zeros((len(self.held), -(-len(dids) // 8)), np.uint8)
        row = np.searchsorted(self.held, at)
        np.bitwise_or.at(self.bits, (row, self.doc >> 3), (1 << (self.doc & 7)).astype(np.uint8))

    def masks(self, asked: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents in order of their masks' greatest scores, first of each mask, greatest score of each mask) of those that hold an asked term."""
        here = np.isin(asked, self.held)
        asked, weights = asked[here], weights[here]
        rows = np.searchsorted(self.held, asked)
        grid = np.unpackbits(self.bits[rows], axis=1, bitorder="little")[:, : len(self.dids)]
        docs = np.flatnonzero(grid.any(axis=0))
        if not len(docs):
            return docs, docs, docs
        packed = np.ascontiguousarray(np.packbits(grid[:, docs], axis=0).T)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.int64)
        keys = packed[:, 0] if packed.shape[1] == 1 else np.unique(packed, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        most = grid[:, docs[order[first]]].T.astype(np.int64) @ (weights * self.best[rows])
        # whole masks, from the greatest score down
        place = np.argsort(-most, kind="stable")
        size = np.diff(np.append(first, len(order)))[place]
        begin = np.cumsum(size) - size
        within = np.arange(len(order)) - np.repeat(begin, size)
        return docs[order[np.repeat(first[place], size) + within]], begin, most[place]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold a term; ``weights`` of all terms, 0 for those not asked."""
        size = self.sizes[docs]
        ends = np.cumsum(size)
        at = np.repeat(self.starts[docs], size) + np.arange(ends[-1]) - np.repeat(ends - size, size)
        return np.add.reduceat(weights[self.at[at]] * self.part[at], ends - size)


def best(scores: np.ndarray, dids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((dids, -scores))[:k]
    return scores[order], dids[order]


def _searched(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int, evaluated: list[int] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        top = [(none, none) for _ in items]
        spread = np.zeros(len(weights), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [np.frombuffer(x.as_py(), np.int32) for x in batch["at"]]
            tf = [np.frombuffer(x.as_py(), np.int32) for x in batch["tf"]]
            block = Block(longs(batch["did"]), longs(batch["n"]), np.array([len(x) for x in at], np.int64), np.concatenate(at).astype(np.int64), np.concatenate(tf).astype(np.int64), n_docs, n_terms)
            for q, asked in enumerate(items):
                docs, first, most = block.masks(asked, weights[asked])
                spread[asked] = weights[asked]
                ends, done = np.append(first[1:], len(docs)), 0
                while done < len(first):
                    held = top[q]
                    if len(held[0]) >= k and most[done] < held[0][-1]:
                        break  # an equal greatest score may still come in by its doc_id
                    # at least as many documents as before again, in whole masks
                    more = min(len(first), max(done + 1, int(np.searchsorted(ends, 2 * first[done] + 4 * k, "right"))))
                    part = docs[first[done] : ends[more - 1]]
                    if evaluated is not None:
                        evaluated[0] += len(part)
                    s = block.scores(part, spread)
                    good = s > 0
                    top[q] = best(np.concatenate((held[0], s[good])), np.concatenate((held[1], block.dids[part[good]])), k)
                    done = more
                spread[asked] = 0
        for q, (s, d) in enumerate(top):
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q, np.int32)), pa.array(d), pa.array(s)], names=["q", "did", "score"])

    return run


def _group(scratch: Scratch, name: str, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(item_id, did, score): each task's best k for each of these queries, of which GROUP_BYTES bound the size."""
    spark = docs.sparkSession
    asked = [(r["item_id"], sorted(set(terms((r["text"] or "").encode())))) for r in queries.select("item_id", "text").collect()]
    vocabulary: dict[bytes, int] = {}
    items = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in asked]
    named = docs.select(id_of(F.col("doc_id")).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    counted = scratch.save(f"counted-{name}", named.mapInArrow(_counted(vocabulary), _COUNTS))
    held = counted.filter("kind = 0").select("did", "n", "at", "tf")
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # one row for each term that was asked for
    df = dict(counted.filter("kind = 1").select("at", "tf").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df")).collect())
    weights = np.array([weight(n_docs, df.get(j, 0)) for j in range(len(vocabulary))], np.int64)
    found = held.mapInArrow(_searched(items, weights, n_docs, max(1, n_terms), k), "q int, did long, score long")
    found = scratch.save(f"found-{name}", found)
    scratch.drop(f"counted-{name}")
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(asked)], f"q int, item_id {queries.schema['item_id'].dataType.simpleString()}")
    return found.join(F.broadcast(names), "q").select("q", "item_id", "did", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best rows of ``docs`` for each row of ``queries`` (item_id, text): (item_id, rank, doc_id, score), best first, equal scores by doc_id.

    Terms are maximal runs of letters and digits of ASCII, A-Z in lower case, and of characters beyond it. With N documents that have a term and L terms in all, a term of df
    documents weighs floor(1000 * ln((2N + 2) / (2df + 1))); it adds that times (10**9 * tf) div (1000 * tf + 8 * m), where m = 10 + (90 * n * N) div L for a document
    of n terms. Each different term of a query counts once; only scores above 0 are returned.
    Null and empty texts have no terms: such documents are never found, such queries find nothing. Rows that repeat an id are documents of their own, as are
    queries; a null doc_id comes first among equal scores and stays null; empty tables give no rows; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "masks")
    size = F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")) + 64
    asked = scratch.save("queries", queries.select("item_id", "text", F.expr("uuid()").alias("u")).withColumn("bytes", size))
    groups = math.ceil((asked.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] or 1) / GROUP_BYTES)
    asked = asked.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(groups)))
    parts = [_group(scratch, str(g), docs, asked.filter(F.col("g") == g), k).withColumn("g", F.lit(g)) for g in range(groups)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = Window.partitionBy("g", "q").orderBy(F.col("score").desc(), "did")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", id_back(F.col("did")).alias("doc_id"), "score")
