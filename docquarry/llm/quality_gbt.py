"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow tasks. The trees are fitted on a bounded sample of labelled rows (``max_rows``, the
documents whose ids hash lowest), then flattened into arrays; a batch goes down all trees level by level in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, id_of, longs, texts
from docquarry.llm.hashing import Rolling, word_codes, word_spans
from docquarry.llm.line_quality import SYMBOLS, statistics

FEATURES = (
    "log_bytes", "log_words", "mean_word", "spread_word", "longest_word", "symbols", "words_with_symbols", "digits", "upper", "stops", "commas", "other_marks",
    "beyond_ascii", "lines", "dup_lines", "repeat_words", "distinct_words", "top_word", "distinct_pairs", "short_words", "entropy", "longest_line",
)


def features(data: np.ndarray) -> np.ndarray:
    """Statistics of a text's UTF-8 bytes, none of them null."""
    out = np.zeros(len(FEATURES))
    size = len(data)
    n, _chars, symbols, dup_lines, repeats = statistics(data)
    if not n:
        return out
    counts = np.bincount(data, minlength=256).astype(float)
    starts, ends = word_spans(data)
    length = ends - starts
    codes = word_codes(data, starts, ends)
    _, times = np.unique(codes, return_counts=True)
    marked = np.add.reduceat(SYMBOLS[data], starts)
    pairs = len(np.unique(Rolling(codes).windows(2))) / (n - 1) if n > 1 else 1.0
    share = counts[counts > 0] / size
    ends_of_lines = np.flatnonzero(data == 10)
    lines = len(ends_of_lines) + 1
    other = counts[33:127].sum() - counts[48:58].sum() - counts[65:91].sum() - counts[97:123].sum()
    out[:] = (
        np.log1p(size), np.log1p(n), length.mean(), length.std(), length.max(), symbols / size, (marked > 0).mean(), counts[48:58].sum() / size, counts[65:91].sum() / size,
        counts[46] / n, counts[44] / n, (other - counts[46] - counts[44]) / size, counts[128:].sum() / size, lines / n, dup_lines / lines, repeats / n, len(times) / n, times.max() / n,
        pairs, (length <= 3).mean(), -(share * np.log2(share)).sum(), np.diff(ends_of_lines, prepend=-1, append=size).max() / size,
    )
    return out


@dataclass
class Forest:
    """Complete trees as arrays: a row of ``feature`` and ``threshold`` holds a tree's inner nodes by level, one of ``leaf`` its leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 2.0) -> Forest:
    """Second-order boosting of the logistic loss on binned features. Without rows the score is a half; with one class its smoothed share."""
    inner = 2**depth - 1
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    coded = np.stack([np.searchsorted(k, c, "left") for k, c in zip(cuts, x.T, strict=True)], 1)
    total = np.full(len(y), base)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        feature, threshold, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                at = (node - first) * bins + coded[:, f]
                g, h = (np.bincount(at, v, width * bins).reshape(width, bins).cumsum(1) for v in (grad, hess))
                ga, ha = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + penalty) + (ga - g) ** 2 / (ha - h + penalty) - ga**2 / (ha + penalty)
                gain[:, len(cuts[f]) :] = 0
                gain[(h < 1) | (ha - h < 1)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best):
                    best[w], feature[first + w], cut_bin[first + w], threshold[first + w] = top[w], f, k[w], cuts[f][k[w]]
            node = 2 * node + 1 + (coded[np.arange(len(y)), feature[node]] > cut_bin[node])
        g, h = (np.bincount(node - inner, v, inner + 1) for v in (grad, hess))
        leaf = rate * g / (h + penalty)
        total += leaf[node - inner]
        kept.append((feature, threshold, leaf))
    return Forest(base, *(np.stack(v) for v in zip(*kept, strict=True)))


_ROWS = pa.schema([("did", pa.int64()), ("x", pa.list_(pa.float64()))])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array([features(data) for data in texts(batch["text"])]).reshape(-1, len(FEATURES))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(longs(batch["did"])), lists], schema=_ROWS)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Forest:
    """Fit on at most ``max_rows`` labelled documents outside the held-out share, those whose ids hash lowest."""
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.max("quality").alias("y")).orderBy(F.xxhash64("did"), "did").limit(max_rows)
    # the limit bounds what is broadcast here and what comes to the driver
    rows = docs.select(id_of(F.col("doc_id")).alias("did"), "text").join(F.broadcast(chosen), "did")
    got = rows.select("did", "text").mapInArrow(_statistics, "did long, x array<double>").join(F.broadcast(chosen), "did").orderBy(F.xxhash64("did"), "did", F.col("x")).limit(max_rows).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), (got["y"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, forest: Forest, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: (doc_id, held_out, score, predicted).

    Null and empty texts are scored by statistics that are all zero; repeated rows each get their row; an empty table gives no rows; labels and other columns are
    never read here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(data) for data in texts(batch["text"])]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(longs(batch["did"])), pa.array(forest.score(x))], names=["did", "score"])

    rows = docs.select(id_of(F.col("doc_id")).alias("did"), "text").mapInArrow(run, "did long, score double")
    doc_id = id_back(F.col("did"))
    return rows.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """Fit on the labelled share of ``docs`` and score all of it: (doc_id, held_out, score, predicted), a row for each row.

    At most ``max_rows`` labelled documents are learnt from; labels without an id or value are left out, of several for an id the greatest counts.
    Null and empty texts are scored like any other; without usable labels every score is a half; an empty table gives no rows; other columns are ignored."""
    return score(docs, train(docs, labels, max_rows), threshold)
