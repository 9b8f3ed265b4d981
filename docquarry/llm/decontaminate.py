"""Benchmark decontamination: a prefix-filtered set join, all in DataFrame operations.

The sets are a window's shingles. For exact containment of a window one shingle is a sufficient prefix: a document that contains
the window contains its rarest shingle. So windows are indexed by the shingle that the corpus holds least often;
a document's shingles look it up, positional and length bounds place the window, and its words are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, id_of, text_tag
from docquarry.session import Scratch

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes of shingles (8 bytes each) that may be broadcast: 8 MB, some 40 MB as a hash table.
BROADCAST_HASHES = 1_000_000


def words(text: Column) -> Column:
    """Words of letters, digits and all beyond ASCII, with A-Z alone lower-cased; null has none."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), SEPARATOR), "")


def shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size)))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, wid, w): the windows of each item, named by a hash of their words."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("all"))
    last = F.greatest(F.size("all") - window, F.lit(0))
    w = w.filter(F.size("all") > 0).select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("all", i + 1, F.lit(window)))).alias("w"))
    return w.select("item", F.md5(F.array_join("w", " ")).alias("wid"), "w").distinct()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(id_of(F.col("doc_id")).alias("did"), text_tag(F.col("text")).alias("tag"), words(F.col("text")).alias("w"))


def _shingled(named: DataFrame, sizes: list[int]) -> DataFrame:
    """(did, tag, w, pos, h): the shingles of each of ``sizes`` at each word, once for each size; of a text without words one row without a place.

    The outer form, or Spark would cut each text a second time only to see whether it has words."""
    places = named.select("did", "tag", "w", F.posexplode_outer("w").alias("pos", "word"))
    here = [shingle(F.col("w"), F.col("pos"), k) for k in sizes]
    return places.withColumn("h", here[0] if len(here) == 1 else F.explode(F.array(*here)))


def _candidates(scratch: Scratch, docs: DataFrame, hashes: DataFrame, few: bool, sizes: list[int], before: int, after: int) -> DataFrame:
    """(did, tag, pos, h, base, near): the places of shingles in ``hashes`` and the words about them, from ``base`` on.

    Few hashes go to the documents; only what they find, and the words near, goes on. Many are met by shuffling positions alone
    (id, place and hash); the texts of documents with a place found are then read again. Whole word arrays are never shuffled."""
    if few:
        found = _shingled(_named(docs), sizes).join(F.broadcast(hashes), "h")
    else:
        slim = _shingled(_named(docs), sizes).select("did", "tag", "pos", "h").join(hashes, "h").distinct()
        held = scratch.save("held", slim.groupBy("did", "tag").agg(F.collect_list(F.struct("pos", "h")).alias("at")))
        texts = docs.select(id_of(F.col("doc_id")).alias("did"), text_tag(F.col("text")).alias("tag"), "text").join(held, ["did", "tag"])
        found = texts.select("did", "tag", words(F.col("text")).alias("w"), F.explode("at").alias("x")).select("did", "tag", "w", "x.pos", "x.h")
    base = F.greatest(F.col("pos") - before, F.lit(0))
    return found.select("did", "tag", "pos", "h", base.alias("base"), F.slice("w", base + 1, F.lit(before + after)).alias("near"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, prefix: int = 5, share: int = 20) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    A document word within any occurrence of an item's window is hit; an item of fewer words than the window is one window.
    Contaminated: at least one word in ``share`` is hit. Null and empty texts have no words and are clean, items without words
    match nothing, an empty benchmark leaves all clean; repeated rows each get their row; other columns are ignored."""
    return _contamination(docs, items, window, prefix, share).drop("did", "tag")


def _contamination(docs: DataFrame, items: DataFrame, window: int = 13, prefix: int = 5, share: int = 20) -> DataFrame:
    """What contamination gives, with the (did, tag) of each row."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    of_items = scratch.save("items", item_windows(items, window))
    at = of_items.select("wid", "w").distinct().withColumn("size", F.least(F.size("w"), F.lit(prefix)))
    at = at.withColumn("off", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))))
    sizes = sorted(r[0] for r in at.select("size").distinct().collect()) or [prefix]  # at most ``prefix`` numbers
    hashed = F.coalesce(*(F.when(F.col("size") == k, shingle(F.col("w"), F.col("off"), k)) for k in sizes))
    at = scratch.save("shingles", at.select("wid", F.size("w").alias("len"), "off", hashed.alias("h"), F.array_join("w", " ").alias("window")))
    hashes = scratch.save("hashes", at.select("h").distinct())
    few = hashes.count() <= BROADCAST_HASHES

    places = _shingled(_named(docs), sizes).select("h")
    counts = scratch.save("counts", places.join(F.broadcast(hashes) if few else hashes, "h").groupBy("h").agg(F.count("*").alias("n")))
    order = Window.partitionBy("wid").orderBy(F.coalesce("n", F.lit(0)), "off")
    index = at.join(counts, "h", "left").withColumn("k", F.row_number().over(order)).filter("k = 1")
    index = scratch.save("index", index.select("h", "off", "len", "wid", "window"))

    near = _candidates(scratch, docs, index.select("h").distinct(), few, sizes, window - 1, window)
    start = F.col("pos") - F.col("off")
    first = start - F.col("base")  # where the window would begin among the words near
    inside = (start >= 0) & (first + F.col("len") <= F.size("near"))
    same = F.array_join(F.slice("near", F.greatest(first, F.lit(0)) + 1, F.col("len")), " ") == F.col("window")
    met = near.join(index, "h").filter(inside & same).select("did", "tag", start.alias("a"), (start + F.col("len")).alias("b"), "wid").distinct()
    met = scratch.save("met", met)
    before = Window.partitionBy("did", "tag").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(before), F.lit(0))), F.lit(0))
    hit = met.withColumn("new", new).groupBy("did", "tag").agg(F.sum("new").alias("hit"))
    # each item once a document, before the list of a document is gathered
    named = met.select("did", "tag", "wid").distinct().join(of_items.select("wid", "item"), "wid").select("did", "tag", "item").distinct()
    named = named.groupBy("did", "tag").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = scratch.save("found", hit.join(named, ["did", "tag"]))
    scratch.drop("items", "shingles", "hashes", "counts", "index", "held", "met")
    out = _named(docs).select("did", "tag", F.size("w").cast("long").alias("n_words")).join(found, ["did", "tag"], "left")
    n_hit, ids = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("did", "tag", id_back(F.col("did")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, **how: int) -> DataFrame:
    """``docs`` without its contaminated documents; each text under one doc_id, null or not, is judged by itself.

    Null and empty texts stay; repeated rows stay or go together; an empty table stays empty; other columns may have any names."""
    bad = _contamination(docs, items, **how).filter("contaminated").select(F.col("did").alias("bad_id"), F.col("tag").alias("bad_tag")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), id_of(F.col("doc_id")).alias("bad_id"), text_tag(F.col("text")).alias("bad_tag"))
    return rows.join(bad, ["bad_id", "bad_tag"], "left_anti").select("row.*")
