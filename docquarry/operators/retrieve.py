"""Retrieval and ranking of a table of queries against a table of chunks.

Hits are rows (query_id, point_id, score, rank); equal scores are ranked by point_id, and scores count to 6 decimals, so a
ranking doesn't depend on the order in which sums were formed. Filters go below the ranking. Vocabularies of any size are searched for in
texts (see containing)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.session import Scratch

#: Fixed defaults of the ranking.
VECTOR_K, BM25_K, FINAL_K = 10, 20, 5
FUSION_K, VECTOR_WEIGHT, BM25_WEIGHT = 20, 1.5, 0.7
TABLE_BOOST, MIN_SCORE = 1.5, 0.005
#: So many different keys are looked for one by one; more meet the texts by a gram of LONG or SHORT characters each, broadcast if they have so many characters at most.
VOCABULARY_ROWS, LONG, SHORT, BROADCAST_CHARS = 256, 6, 3, 8 << 20
#: Up to so many hits (ids and scores) are sent to the points they name, so that no text is shuffled; more are joined.
BROADCAST_HITS = 200_000
#: Bytes of a block of vectors that is multiplied as one matrix.
BLOCK_BYTES = 1 << 20
#: Bytes of the queries that tasks hold at a time.
QUERY_BYTES = 64 << 20


def containing(texts: DataFrame, text: str, vocabulary: DataFrame, key: str, *ids: str, rows: int | None = None) -> DataFrame:
    """``texts`` joined with each row of ``vocabulary`` whose ``key`` its ``text`` contains; ``ids`` name a text (repeated ids do no harm).

    Up to ``rows`` different keys are looked for one by one. More are each found by one of their grams (LONG characters, SHORT of keys under LONG, all of keys under SHORT), the one that the
    fewest keys have, so keys with a common opening don't meet; a text's different grams join them by equality, without the text, and what meets is then verified. Null texts
    and keys meet nothing; the empty key meets every other text."""
    rows = VOCABULARY_ROWS if rows is None else rows
    keys = vocabulary.select(F.col(key).alias("_key")).filter("_key is not null").distinct()
    few = [r[0] for r in keys.limit(rows + 1).collect()]
    if len(few) <= rows:
        mine = F.filter(F.array(*map(F.lit, few)), lambda k: F.contains(F.col(text), k)) if few else F.array().cast("array<string>")
        found = texts.withColumn("_key", F.explode(mine))
        return found.join(vocabulary, found["_key"] == vocabulary[key]).drop("_key")
    n = F.length("_key")
    keys = keys.withColumn("_size", F.when(n >= LONG, LONG).when(n >= SHORT, SHORT).otherwise(n))
    all_grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - F.col("_size") + 1), lambda i: F.substring("_key", i, F.col("_size"))))
    grams = keys.select("_key", "_size", F.explode(all_grams).alias("_gram"))
    shared = grams.groupBy("_gram").agg(F.count("*").alias("n"))
    # grams of like keys shuffle as few bytes however many there are, so what may be large is merged by a hint, not left to its size
    rarest = grams.join(shared.hint("merge"), "_gram").groupBy("_key").agg(F.min(F.struct("n", "_gram", "_size")).alias("m")).select("_key", "m._gram", "m._size")
    rarest = Scratch(texts.sparkSession, "grams").save("rarest", rarest)
    size = rarest.agg(F.sum(F.length("_key") + F.length("_gram") + 32), F.collect_set("_size")).first()  # LONG + 1 sizes at most
    large = size[0] > BROADCAST_CHARS
    sorted_in = lambda frame: frame.hint("merge") if large else frame
    rarest = rarest.hint("merge") if large else F.broadcast(rarest)
    # texts are cut into characters once: finding the i-th character of a string anew would take time with the square of its length
    chars = texts.filter(F.col(text).isNotNull()).select(*ids, F.split(text, "").alias("_chars")).withColumn("_n", F.size("_chars"))
    of_size = lambda n: F.when(F.col("_n") >= n, F.transform(F.sequence(F.lit(0), F.col("_n") - n), lambda i: F.concat(*(F.get("_chars", i + j) for j in range(n))) if n else F.lit(""))).otherwise(F.array().cast("array<string>"))
    slim = chars.select(*ids, F.explode(F.array_distinct(F.flatten(F.array(*map(of_size, sorted(size[1])))))).alias("_gram"))
    met = slim.join(rarest.drop("_size"), "_gram").select(*ids, "_key").distinct()
    found = texts.join(sorted_in(met), list(ids)).filter(F.contains(F.col(text), F.col("_key")))
    return found.join(sorted_in(vocabulary), found["_key"] == vocabulary[key]).drop("_key")


def ranked(hits: DataFrame, score: str = "score", by: str = "query_id", name: str = "rank", tie: str = "point_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.round(score, 6).desc(), tie)
    return hits.withColumn(name, F.row_number().over(order))


def top(hits: DataFrame, k: int | Column, score: str = "score", by: str = "query_id", tie: str = "point_id") -> DataFrame:
    """The best k rows of each query, ranked from 1."""
    return ranked(hits, score, by, "rank", tie).filter(F.col("rank") <= k)


def bm25(query_terms: DataFrame, posted: DataFrame, terms: DataFrame, lengths: DataFrame, k: int = BM25_K, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Top k by BM25 of (query_id, term, qtf) over postings (term, point_id, tf), (term, idf) and (point_id, dl)."""
    mean = lengths.agg(F.avg("dl").alias("mean"))  # one row
    rows = posted.join(query_terms.join(terms.select("term", "idf"), "term"), "term").join(lengths, "point_id").crossJoin(F.broadcast(mean))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    return top(rows.groupBy("query_id", "point_id").agg(F.sum(part).alias("score")).filter("round(score, 6) > 0"), k)


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = VECTOR_K, same: str | None = None) -> DataFrame:
    """Top k by inner product of (query_id, embedding[, same]) and (point_id, embedding[, same]); ``same``: a column that must be equal.

    Each task multiplies its own vectors, in blocks of BLOCK_BYTES, with the queries and passes on the best k of each; queries are taken in groups of QUERY_BYTES, whatever their
    number is, and of them alone does a group pass through the driver. A query never meets its own row if the two ids are equal."""
    pick = lambda frame, key: frame.select(F.col(key).cast("long").alias("id"), F.array().cast("array<int>").alias("at"), F.col("embedding").cast("array<double>").alias("v"), (F.col(same) if same else F.lit(0)).cast("long").alias("grp"))
    return _block_topk(pick(queries, "query_id"), pick(vectors, "point_id"), k, 0)


def sparse_topk(queries: DataFrame, vectors: DataFrame, dim: int, k: int = VECTOR_K, same: str | None = None) -> DataFrame:
    """Top k by inner product above 0 of sparse vectors (query_id, bucket, weight) and (point_id, bucket, weight), in blocks as in dense_topk; either may be gathered already as (id, at, v).

    ``same``: a column that must be equal; a query's null binds nothing."""

    def pick(frame: DataFrame, key: str) -> DataFrame:
        if "v" in frame.columns:
            group = F.coalesce(F.when(F.col(same).isNotNull(), F.xxhash64(same)), F.lit(0)) if same else F.lit(0)
            return frame.select(F.col(key).cast("long").alias("id"), "at", "v", group.cast("long").alias("grp"))
        group = F.coalesce(F.when(F.first(same).isNotNull(), F.xxhash64(F.first(same))), F.lit(0)) if same else F.lit(0)
        rows = frame.groupBy(F.col(key).cast("long").alias("id")).agg(F.collect_list(F.struct(F.col("bucket").cast("int").alias("b"), F.col("weight").cast("double").alias("w"))).alias("x"), group.cast("long").alias("grp"))
        return rows.select("id", F.col("x.b").alias("at"), F.col("x.w").alias("v"), "grp")

    return _block_topk(pick(queries, "query_id"), pick(vectors, "point_id"), k, dim)


_BLOCK = "n int, ids binary, groups binary, starts binary, at binary, v binary"


def _packed(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of (id, at, v, grp) rows: values, and where ``dim`` isn't 0 their places in a vector of ``dim``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widest = dim or int(np.diff(batch["v"].offsets.to_numpy()).max(initial=1))
            size = max(1, BLOCK_BYTES // (8 * max(widest, 1)))
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                starts = part["v"].offsets.to_numpy()
                columns = [part["id"].to_numpy(), part["grp"].to_numpy(zero_copy_only=False), starts - starts[0], part["at"].flatten().to_numpy().astype(np.int32), part["v"].flatten().to_numpy().astype(np.float64)]
                yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows], pa.int32())} | {n: [c.tobytes()] for n, c in zip(("ids", "groups", "starts", "at", "v"), columns, strict=True)})

    return run


def _matrix(row: dict, dim: int) -> np.ndarray:
    starts, v = np.frombuffer(row["starts"], np.int32), np.frombuffer(row["v"], np.float64)
    if not dim:
        return v.reshape(row["n"], -1)
    out = np.zeros((row["n"], dim))
    out[np.repeat(np.arange(row["n"]), np.diff(starts)), np.frombuffer(row["at"], np.int32)] = v
    return out


def _best(q: np.ndarray, p: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((p, -np.round(s, 6), q))
    q, p, s = q[order], p[order], s[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))[: len(q)]
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
    return q[keep], p[keep], s[keep]


def query_groups(packed: DataFrame, scratch: Scratch, width: int) -> Iterator[list[dict]]:
    """Packed queries (see _packed) in groups of about QUERY_BYTES as matrices of ``width`` numbers a row, one after another."""
    packed = scratch.save("queries", packed)
    total = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * 8 * max(width, 1)
    n = max(1, -(-total // QUERY_BYTES))
    for g in range(n):
        yield [r.asDict() for r in packed.filter(F.pmod(F.xxhash64("ids"), F.lit(n)) == g).collect()]


def _block_topk(queries: DataFrame, vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """Queries are held by the tasks in groups of bounded size; each vector block is multiplied where it is read, so neither side is shuffled or multiplied out."""
    scratch = Scratch(queries.sparkSession, "vectors")
    width = dim or queries.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    rows = None
    for g, blocks in enumerate(query_groups(queries.mapInArrow(_packed(dim), _BLOCK), scratch, width)):
        if blocks:
            found = scratch.save(f"found-{g}", vectors.mapInArrow(_multiplied(blocks, k, dim), "query_id long, point_id long, score double"))
            rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        rows = queries.select(F.col("id").alias("query_id"), F.col("id").alias("point_id"), F.lit(0.0).alias("score")).limit(0)
    return top(rows, k)


def _multiplied(blocks: list[dict], k: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best k of a task's vectors for each query of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = [_matrix(q, dim) for q in blocks]
        ids, groups = ([np.frombuffer(q[x], np.int64) for q in blocks] for x in ("ids", "groups"))
        held: list[tuple | None] = [None] * len(blocks)
        for p in (row for part in _packed(dim)(batches) for row in part.to_pylist()):
            points, theirs, matrix = np.frombuffer(p["ids"], np.int64), np.frombuffer(p["groups"], np.int64)[None, :], _matrix(p, dim)
            for i, queries in enumerate(matrices):
                scores = queries @ matrix.T
                mine = groups[i][:, None]
                scores[(mine != theirs) & ~(bool(dim) & (mine == 0))] = -np.inf
                if dim:
                    scores[scores <= 0] = -np.inf
                else:
                    scores[ids[i][:, None] == points[None, :]] = -np.inf
                n = min(k, len(points))
                # every score that rounds to at least the n-th best stays, so ties are settled by id
                floor = np.round(np.partition(scores, -n, axis=1)[:, -n], 6)[:, None] if n < len(points) else np.full((len(ids[i]), 1), -np.inf)
                x, y = np.nonzero((np.round(scores, 6) >= floor) & (scores > -np.inf))
                new = (ids[i][x], points[y], scores[x, y])
                before = held[i]
                held[i] = _best(*(new if before is None else [np.concatenate(z) for z in zip(before, new, strict=True)]), k)
        for found in held:
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "point_id", "score"])

    return run


def of_points(hits: DataFrame, points: DataFrame) -> DataFrame:
    """``hits`` joined with their ``points`` by point_id. Hits are counted first: they are few for each query, whatever the number of points is."""
    few = hits.count() <= BROADCAST_HITS
    return (F.broadcast(hits) if few else hits).join(points, "point_id")


def merge_max(*hits: DataFrame, k: int) -> DataFrame:
    """Hits of several variants of a query as one list: the best score of each point, then the top k."""
    rows = hits[0].select("query_id", "point_id", "score")
    for more in hits[1:]:
        rows = rows.unionByName(more.select("query_id", "point_id", "score"))
    return top(rows.groupBy("query_id", "point_id").agg(F.max("score").alias("score")), k)


def expand_queries(queries: DataFrame, synonyms: DataFrame, most: int = 3, each: int = 2) -> DataFrame:
    """(query_id, variant, text): the query, then it with a term replaced by its first synonyms; ``most`` different texts."""
    words = synonyms.filter(F.col("prio") <= each)
    made = containing(queries.select("query_id", "text"), "text", words, "term", "query_id").select(
        "query_id", F.col("text").alias("old"), F.replace("text", F.col("term"), F.col("synonym")).alias("text"), "term", "prio"
    )
    rows = made.filter("text <> old").groupBy("query_id", "text").agg(F.min(F.struct("term", "prio")).alias("order"))
    rows = queries.select("query_id", "text", F.lit(None).cast(rows.schema["order"].dataType).alias("order")).unionByName(rows)
    order = Window.partitionBy("query_id").orderBy(F.col("order").asc_nulls_first(), "text")
    return rows.withColumn("variant", F.row_number().over(order)).filter(F.col("variant") <= most).select("query_id", "variant", "text")


def boost_tables(hits: DataFrame, tables: DataFrame, factor: float = TABLE_BOOST, wanting: DataFrame | None = None) -> DataFrame:
    """Scores of points that hold a table, times a factor, once; with ``wanting`` (query_id), for these queries alone. The lexical half of search.boost_tables."""
    found = of_points(hits.select("point_id").distinct(), tables.select("point_id")).select("point_id", F.lit(True).alias("has_table")).distinct()
    marked = hits.join(found, "point_id", "left")
    counts = F.col("has_table")
    if wanting is not None:
        marked = marked.join(wanting.select("query_id").distinct().withColumn("_wants", F.lit(True)), "query_id", "left")
        counts = counts & F.col("_wants")
    return ranked(marked.withColumn("score", F.when(counts, F.col("score") * factor).otherwise(F.col("score"))).drop("has_table", "_wants", "rank"))


def fuse(vector: DataFrame, lexical: DataFrame, k: int = 60, vector_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; a rank that a list lacks is null."""
    v, b = (x.select("query_id", "point_id", F.col("rank").alias(n)) for x, n in ((vector, "vector_rank"), (lexical, "lexical_rank")))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (k + F.col(r)), F.lit(0.0))
    return v.join(b, ["query_id", "point_id"], "full").withColumn("score", part(vector_weight, "vector_rank") + part(lexical_weight, "lexical_rank"))


def weigh(hits: DataFrame, points: DataFrame, weights: DataFrame, on: str) -> DataFrame:
    """Scores times the weight of a point's kind (1 where the table has none)."""
    rows = of_points(hits, points).join(weights, on, "left")
    return rows.withColumn("score", F.col("score") * F.coalesce("weight", F.lit(1.0))).drop("weight")


def at_most_per(hits: DataFrame, parent: str, each: int = 2, most: int = 40) -> DataFrame:
    """The best ``each`` hits of each parent, then the best ``most``."""
    place = Window.partitionBy("query_id", parent).orderBy(F.round("score", 6).desc(), "point_id")
    return top(hits.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= each).drop("place", "rank"), most)


def rerank(hits: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int, query: str = "query", text: str = "text") -> DataFrame:
    """Re-rank by a caller's pair scorer, in batches."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in hits.drop("rank").schema] + ["rerank double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(rerank=scorer(rows[query].tolist(), rows[text].tolist()))

    return top(hits.drop("rank").mapInPandas(run, schema), k, "rerank")


def overlap(query_terms: Column, text_terms: Column) -> Column:
    """The share of a query's different terms that a text has: the scorer used without a model."""
    q = F.array_distinct(query_terms)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text_terms)) / F.size(q)).otherwise(0.0)


def rerank_flags(hits: DataFrame, gap: float = 0.03, low: float = 0.35, spread: float = 0.05, many: int = 8) -> DataFrame:
    """(query_id, close, weak, flat): best three within ``gap``; best under ``low``; at least ``many`` hits whose first ones hardly vary."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    first = F.stddev_pop(F.when(F.col("rank") <= many, F.col("score")))
    return hits.groupBy("query_id").agg(
        F.coalesce(at(1) - at(3) < gap, F.lit(False)).alias("close"), (F.max("score") < low).alias("weak"), ((F.count("*") >= many) & (first < spread)).alias("flat")
    )


#: What makes a question comparing or conditional.
COMPARING = r"对比|比较|相比|差异|区别|哪个更|\bversus\b|\bvs\b|\bcompare"
CONDITIONAL = r"如果|假设|在.{1,20}情况下|\bif\b|\bassuming\b"


def rerank_wanted(queries: DataFrame, hits: DataFrame, *patterns: str, intents: tuple[str, ...] = ("analytical", "comparative"), **thresholds: float) -> DataFrame:
    """(query_id, wanted, reason) for queries (query_id, text, intent, entities): whether re-ranking pays, and the first reason that says so.

    A question of a pattern, of two entities or more, or of such an intent wants it; any other if its scores are close, weak or flat."""
    found = queries.select("query_id", "text", "intent", F.size("entities").alias("n")).join(rerank_flags(hits, **thresholds), "query_id", "left")
    asks = lambda p: F.lower("text").rlike(p)
    reason = F.lit(None).cast("string")
    for name in ("flat", "weak", "close"):
        reason = F.when(F.col(name), F.lit(name)).otherwise(reason)
    reason = F.when(F.col("intent").isin(*intents), F.lit("intent")).otherwise(reason)
    reason = F.when(F.col("n") >= 2, F.lit("entities")).otherwise(reason)
    for i, pattern in reversed(list(enumerate(patterns or (COMPARING, CONDITIONAL)))):
        reason = F.when(asks(pattern), F.lit(f"pattern {i}")).otherwise(reason)
    return found.select("query_id", reason.isNotNull().alias("wanted"), reason.alias("reason"))


def first_of_each(hits: DataFrame, parent: str) -> DataFrame:
    """One hit of each parent, the first by rank, ranked anew."""
    place = Window.partitionBy("query_id", parent).orderBy("rank")
    return hits.withColumn("place", F.row_number().over(place)).filter("place = 1").drop("place")


def two_stage(strict: DataFrame, wide: DataFrame, threshold: float, least: int = 3, factor: float = 1.2) -> DataFrame:
    """Where the strict search found little (best under ``threshold`` and fewer than ``least`` hits), the wide search joins in behind it."""
    found = strict.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n"))
    asked = wide.select("query_id").distinct().join(found, "query_id", "left")
    poor = asked.filter((F.coalesce("best", F.lit(0.0)) < threshold) & (F.coalesce("n", F.lit(0)) < least)).select("query_id")
    more = wide.join(poor, "query_id", "left_semi").select("query_id", "point_id", "score", F.lit(2).alias("stage"))
    raised = strict.join(poor.withColumn("poor", F.lit(True)), "query_id", "left")
    first = raised.select("query_id", "point_id", F.when(F.col("poor"), F.col("score") * factor).otherwise(F.col("score")).alias("score"), F.lit(1).alias("stage"))
    rows = first.unionByName(more.join(first.select("query_id", "point_id"), ["query_id", "point_id"], "left_anti"))
    order = Window.partitionBy("query_id").orderBy("stage", F.round("score", 6).desc(), "point_id")
    return rows.withColumn("rank", F.row_number().over(order))


def or_unfiltered(filtered: DataFrame, unfiltered: DataFrame, least: int = 3) -> DataFrame:
    """A query's filtered hits, or its unfiltered ones where those are fewer than ``least``."""
    enough = filtered.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("query_id")
    return filtered.join(enough, "query_id", "left_semi").unionByName(unfiltered.join(enough, "query_id", "left_anti"))


def backfill(hits: DataFrame, more: DataFrame, parent: str, k: int) -> DataFrame:
    """Up to k hits of each query: its own, then those of ``more`` whose parents it hasn't."""
    new = more.join(hits.select("query_id", parent).distinct(), ["query_id", parent], "left_anti")
    rows = hits.withColumn("list", F.lit(1)).unionByName(new.withColumn("list", F.lit(2)))
    order = Window.partitionBy("query_id").orderBy("list", "rank", "point_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("rank").withColumnRenamed("place", "rank")


def diverse(hits: DataFrame, group: str, text: str, k: int = 8, each: int = 2, opening: int | None = 300) -> DataFrame:
    """Without repeated points or texts; up to ``each`` of each group come first, the best others fill up to k.

    Texts with the same first ``opening`` characters count as repeats, so others with that opening go too; None compares whole texts."""
    order = (F.round("score", 6).desc(), "point_id")
    once = Window.partitionBy("query_id", F.md5(F.substring(text, 1, opening) if opening else F.col(text))).orderBy(*order)
    rows = hits.dropDuplicates(["query_id", "point_id"]).withColumn("copy", F.row_number().over(once)).filter("copy = 1").drop("copy")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", group).orderBy(*order)))
    pick = Window.partitionBy("query_id").orderBy((F.col("place") > each).cast("int"), *order)
    return rows.drop("rank").withColumn("rank", F.row_number().over(pick)).filter(F.col("rank") <= k).drop("place")


def contexts(hits: DataFrame, text: str, most: int = 3000) -> DataFrame:
    """(query_id, blocks, context): numbered texts in rank order while they fit; the first always does."""
    w = Window.partitionBy("query_id").orderBy("rank")
    block = F.concat(F.lit("["), F.row_number().over(w), F.lit("] "), F.col(text))
    rows = hits.withColumn("block", block)
    rows = rows.withColumn("upto", F.sum(F.length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter((F.col("upto") <= most) | (F.col("upto") == F.length("block")))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b")).select(
        "query_id", F.size("b").alias("blocks"), F.array_join(F.transform("b", lambda x: x.block), "\n---\n").alias("context")
    )


def citations(hits: DataFrame) -> DataFrame:
    """Hits numbered from 1 after repeated points have gone, so a number is always its place in the list."""
    rows = hits.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "point_id").orderBy("rank"))).filter("copy = 1").drop("copy")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def rejected(hits: DataFrame, queries: DataFrame, wanted: str, group: str, least: float = MIN_SCORE) -> DataFrame:
    """(query_id, reject): best hit too weak, at most one positive hit, or no hit of the groups the query names (if it names any)."""
    found = hits.groupBy("query_id").agg(F.max("score").alias("best"), F.count_if(F.col("score") > 0).alias("n"), F.collect_set(group).alias("groups"))
    rows = queries.select("query_id", wanted).join(found, "query_id", "left")
    none = F.coalesce(F.col("best") < least, F.lit(True)) | F.coalesce(F.col("n") <= 1, F.lit(True))
    miss = (F.size(wanted) > 0) & ~F.coalesce(F.arrays_overlap(wanted, F.coalesce("groups", F.array().cast("array<string>"))), F.lit(False))
    return rows.select("query_id", (none | miss).alias("reject"))


def grouped(hits: DataFrame, text: str, *by: str, cut: int = 1000) -> DataFrame:
    """(query_id, by..., n, points, body): each group's texts, numbered in rank order; up to min(5, 2n) points to make of them."""
    rows = hits.groupBy("query_id", *by).agg(F.array_sort(F.collect_list(F.struct("rank", F.substring(text, 1, cut).alias("t")))).alias("b"))
    body = F.array_join(F.transform("b", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x.t)), "\n")
    return rows.select("query_id", *by, F.size("b").alias("n"), F.least(F.lit(5), 2 * F.size("b")).alias("points"), body.alias("body"))


def documents_of(hits: DataFrame, doc: str, text: str, part: int = 2000, whole: int = 4000, most: int = 15) -> DataFrame:
    """(query_id, doc, place, body): the documents of the hits in rank order, with their parts cut and joined."""
    rows = hits.groupBy("query_id", doc).agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", F.substring(text, 1, part).alias("t")))).alias("b"))
    body = F.substring(F.array_join(F.transform("b", lambda x: x.t), "\n"), F.lit(1), F.lit(whole))
    rows = rows.select("query_id", doc, F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("place"), body.alias("body"))
    return rows.filter(F.col("place") <= most)


def once_each(queries: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(queries to run, all queries with the id whose answer they share), by a normalised key; counts of a key meet before they are joined."""
    name = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    first = queries.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min("query_id").alias("answer_id"))
    condition = name[0]
    for more in name[1:]:
        condition = condition & more
    rows = queries.join(first, condition).drop(*(f"_{k}" for k in key))
    return rows.filter("query_id = answer_id").drop("answer_id"), rows.select("query_id", "answer_id")


def viewpoints(themes: DataFrame, marks: dict[str, str]) -> DataFrame:
    """(query_id, body): themes (theme_no, theme) with their viewpoints (source, stance, view) as text, a mark for each stance; others get none.

    Themes and viewpoints stand in order of theme_no, then source, then view; a theme without a viewpoint stands alone."""
    mark = F.lit("")
    for stance, sign in marks.items():
        mark = F.when(F.col("stance") == stance, F.lit(sign)).otherwise(mark)
    line = F.when(F.col("view").isNotNull(), F.concat(F.lit("- "), mark, F.lit("["), F.coalesce("source", F.lit("")), F.lit("] "), "view"))
    held = themes.groupBy("query_id", "theme_no", "theme").agg(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("source", "view", line.alias("line"))))).alias("v"))
    block = F.array_join(F.concat(F.array(F.concat(F.lit("## "), "theme")), F.transform("v", lambda x: x.line)), "\n")
    rows = held.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("theme_no", block.alias("block")))).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x.block), "\n").alias("body"))


def find_documents(documents: DataFrame, asked: str, *fields: str, opened: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``documents`` any of whose ``fields`` contains the text asked for, whatever the case; with ``opened`` (key, opened), recent ones first."""
    found = F.lit(False)
    for field in fields:
        found = found | F.contains(F.lower(F.coalesce(F.col(field).cast("string"), F.lit(""))), F.lit(asked.lower()))
    rows = documents.filter(found)
    return rows if opened is None else rows.join(opened, key, "left").orderBy(F.col("opened").desc_nulls_last(), key)
