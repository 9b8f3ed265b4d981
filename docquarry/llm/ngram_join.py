"""N-gram Jaccard join: grouped prefixes, filtered pairs of groups, verified members.

A document is the set of its word n-grams, as 64-bit hashes. Equal sets are one. If the sets of two documents are similar enough, the first few
elements of each (its prefix) in one order of all elements have one in common, the rarer the fewer pairs. Documents of one size with identical
prefixes are a group; groups that share a rare element are paired, pairs of groups are dropped by size, by position and by what
the whole prefixes can still add up to, and only the members of the rest are expanded and compared as whole sets.

*Which elements are counted.* Counting all elements would move several times the corpus. The order therefore begins with the elements of
the lowest hashes (SHARE of all), and only those are counted: they give nearly every document its whole prefix.

*Hot elements.* Elements of more than RARE sets come last among those counted, so a document has one in its prefix only if most of it is common
text. Such documents (near copies of one text, above all) are joined once more among themselves, with all of their elements counted. What is
rare there is paired as before. A list of those that share a hot element isn't: each is compared with one centre, the one
whose hot elements begin first, which puts near copies into one component at once; then the rest of each list (members outside its largest component) is
compared with its other components, so that no link is lost and no pairs are made within a component."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrow import id_back, keyed, longs, texts
from docquarry.llm.graph import components
from docquarry.llm.hashing import BLOCK, Rolling, as_long, word_codes, word_spans
from docquarry.session import Scratch

#: Elements are rare up to so many sets; any number gives the same links.
RARE = 32
#: The part of all hashes that is counted; any number gives the same links.
SHARE = 0.3
#: Frequent elements up to so many (16 bytes each) are broadcast.
BROADCAST_ELEMENTS = 1_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def elements(data: np.ndarray, size: int) -> np.ndarray:
    """The different n-grams of a text's words, A-Z in lower case, as sorted hashes; all its words as one if they are fewer."""
    data = LOWER[data]
    starts, ends = word_spans(data)
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    codes, size = word_codes(data, starts, ends), min(size, n)
    return np.unique(np.concatenate([as_long(Rolling(codes[i : i + BLOCK + size - 1]).windows(size)) for i in range(0, n - size + 1, BLOCK)]))


def prefix_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (percent * n + 99) // 100 + 1


def _cut(share: float) -> int:
    return int(-(1 << 63) + share * (1 << 64)) if share < 1 else (1 << 63) - 1


_SETS = pa.schema([(n, pa.int64()) for n in ("did", "tag", "n", "d1", "d2")] + [("low", pa.list_(pa.int64()))])


def _sets(size: int, percent: int, share: float):
    """A document's set as a digest, and its elements of the lowest hashes: all that are counted if a prefix can be taken from them, else all."""
    cut = _cut(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for did, tag, data in zip(longs(batch["did"]).tolist(), longs(batch["tag"]).tolist(), texts(batch["text"]), strict=True):
                s = elements(data, size)
                low = s[: np.searchsorted(s, cut)]
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                rows.append((did, tag, len(s), int(digest[0]), int(digest[1]), low if len(low) >= prefix_size(len(s), percent) else s))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SETS, strict=True)], schema=_SETS)

    return run


_FULL = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("set", pa.list_(pa.int64()))])


def _full(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [elements(data, size) for data in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(longs(batch["rid"])), pa.array(list(map(len, sets)), pa.int64()), pa.array(sets, _FULL.field("set").type)], schema=_FULL)

    return run


_PREFIXES = pa.schema([("rid", pa.int64()), ("n", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("is_hot", pa.list_(pa.bool_())), ("c", pa.int32()), ("f", pa.int64()), ("h", pa.int64())])


def _ordered(percent: int, share: float):
    """Each set's prefix in the order (counted or not, rare or by frequency, hash), its last element's place in that order, and a digest of prefix and size."""
    cut = _cut(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (rid, n) in enumerate(zip(longs(batch["rid"]).tolist(), longs(batch["n"]).tolist(), strict=True)):
                low = batch["low"][i].values.to_numpy()
                df = np.zeros(len(low), np.int64)
                if batch["hot"][i].is_valid:
                    hot = batch["hot"][i].values
                    df[np.searchsorted(low, hot.field(0).to_numpy())] = hot.field(1).to_numpy()
                kind = 2 * (low >= cut) + (df > 0)
                order = np.lexsort((low, df, kind))[: prefix_size(n, percent)]
                prefix, last = low[order], order[-1]
                digest = np.frombuffer(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest(), np.int64)
                rows.append((rid, n, int(digest[0]), int(digest[1]), prefix, df[order] > 0, int(kind[last]), int(df[last]), int(low[last])))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(_PREFIXES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PREFIXES, strict=True)], schema=_PREFIXES)

    return run


def _prefixes(scratch: Scratch, name: str, sets: DataFrame, percent: int, share: float, rare: int) -> DataFrame:
    """(rid, n, gid, prefix, is_hot, last): the prefixes of ``sets`` (rid, n, low: sorted) in an order by how many of them hold an element; gid is the least rid of the group."""
    counted = sets.select("rid", F.explode("low").alias("h"))
    frequent = scratch.save(f"{name}-frequent", counted.groupBy("h").agg(F.count("*").alias("df")).filter(F.col("df") > rare))
    few = frequent.limit(BROADCAST_ELEMENTS + 1).count() <= BROADCAST_ELEMENTS
    hot = counted.join(F.broadcast(frequent) if few else frequent, "h").groupBy("rid").agg(F.collect_list(F.struct("h", "df")).alias("hot"))
    held = sets.join(hot, "rid", "left").select("rid", "n", "low", "hot")
    spec = "rid long, n long, g1 long, g2 long, prefix array<long>, is_hot array<boolean>, c int, f long, h long"
    rows = scratch.save(f"{name}-ordered", held.mapInArrow(_ordered(percent, share), spec))
    groups = scratch.save(f"{name}-groups", rows.groupBy("g1", "g2").agg(F.min("rid").alias("gid")))
    out = scratch.save(f"{name}-prefixes", rows.join(groups, ["g1", "g2"]).select("rid", "n", "gid", "prefix", "is_hot", F.struct("c", "f", F.col("h").alias("e")).alias("last")))
    scratch.drop(f"{name}-frequent", f"{name}-ordered", f"{name}-groups")
    return out


def _sizes_fit(one: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(one, other) >= percent * F.greatest(one, other)


def _reaches(overlap: Column, one: Column, other: Column, percent: int) -> Column:
    """Whether two sets of these sizes with this overlap are similar enough."""
    return (100 + percent) * overlap >= percent * (one + other)


def _postings(prefixes: DataFrame, key: str, hot: bool) -> DataFrame:
    """(e, ``key``, n, left): the elements of prefixes that are hot, or aren't, and how many elements stand from there on."""
    rows = prefixes.select(key, "n", F.posexplode(F.arrays_zip("prefix", "is_hot")).alias("pos", "x")).filter(F.col("x.is_hot") if hot else ~F.col("x.is_hot"))
    return rows.select(F.col("x.prefix").alias("e"), key, "n", (F.col("n") - F.col("pos")).alias("left"))


def _side(rows: DataFrame, end: str, *names: str) -> DataFrame:
    return rows.select("e", *(F.col(c).alias(f"{c}_{end}") for c in names))


def _may_link(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose prefixes leave room for enough overlap: what they share, and all that one holds beyond the prefix that ends first."""
    side = lambda end: prefixes.select(F.col("rid").alias(end), F.struct("n", "prefix", "last").alias(f"p{end}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    beyond = lambda end: F.col(f"p{end}.n") - F.size(f"p{end}.prefix")
    rest = F.when(F.col("pa.last") < F.col("pb.last"), beyond("a")).when(F.col("pa.last") > F.col("pb.last"), beyond("b")).otherwise(F.least(beyond("a"), beyond("b")))
    shared = F.size(F.array_intersect("pa.prefix", "pb.prefix"))
    return rows.filter(_reaches(shared + rest, F.col("pa.n"), F.col("pb.n"), percent)).select("a", "b")


def _group_pairs(scratch: Scratch, name: str, prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of groups that share a rare element and may link, and of one group with a rare element. No element brings over RARE documents together."""
    groups = prefixes.filter("rid = gid")
    posted = scratch.save(f"{name}-postings", _postings(groups, "gid", False))
    shared = scratch.save(f"{name}-shared", posted.groupBy("e").agg(F.count("*").alias("k")).filter("k > 1").select("e"))
    posted = scratch.save(f"{name}-met", posted.join(shared, "e"))
    rows = _side(posted, "a", "gid", "n", "left").join(_side(posted, "b", "gid", "n", "left"), "e").filter("gid_a < gid_b")
    na, nb = F.col("n_a"), F.col("n_b")
    rows = rows.filter(_sizes_fit(na, nb, percent) & _reaches(F.least("left_a", "left_b"), na, nb, percent))
    met = scratch.save(f"{name}-pairs", rows.select(F.col("gid_a").alias("a"), F.col("gid_b").alias("b")).distinct())
    met = _may_link(met, groups, percent)
    members = prefixes.select("gid", "rid")
    end = lambda x: members.select(F.col("gid").alias(x), F.col("rid").alias(f"rid_{x}"))
    across = met.join(end("a"), "a").join(end("b"), "b").select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))
    several = prefixes.filter(F.exists("is_hot", lambda x: ~x)).select("gid", "rid")
    within = several.select("gid", F.col("rid").alias("a")).join(several.select("gid", F.col("rid").alias("b")), "gid").filter("a < b").select("a", "b")
    out = scratch.save(f"{name}-candidates", across.unionByName(within))
    scratch.drop(f"{name}-postings", f"{name}-shared", f"{name}-met", f"{name}-pairs")
    return out


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(u, v): the pairs (a, b) that are similar enough as whole sets; one set travels for each pair."""
    rows = pairs.join(full.select(F.col("rid").alias("a"), F.col("set").alias("sa")), "a").join(full.select(F.col("rid").alias("b"), F.col("set").alias("sb")), "b")
    good = _reaches(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), percent)
    return rows.filter(good).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _hot_links(scratch: Scratch, prefixes: DataFrame, full: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` and those between documents that share a hot element, as far as they join components."""
    posted = scratch.save("hot-postings", _postings(prefixes, "rid", True))
    centres = scratch.save("hot-centres", posted.groupBy("e").agg(F.max_by(F.struct("rid", "n", "left"), F.struct(F.col("left") - F.col("n"), -F.col("rid"))).alias("c"), F.count("*").alias("k")).filter("k > 1").select("e", "c"))
    fits = lambda ln, n, lm, m: _sizes_fit(n, m, percent) & _reaches(F.least(ln, lm), n, m, percent)
    stars = posted.join(centres, "e").filter("rid <> c.rid").filter(fits(F.col("left"), F.col("n"), F.col("c.left"), F.col("c.n")))
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = scratch.save("stars", stars.select(*ends(F.col("rid"), F.col("c.rid"))).distinct())
    links = scratch.save("links-2", links.unionByName(_verified(_may_link(stars, prefixes, percent), full, percent)))
    roots = scratch.save("roots-2", components(Scratch(posted.sparkSession, "ngram-stars"), links))
    named = scratch.save("hot-named", posted.join(roots, posted["rid"] == roots["node"], "left").select("e", "rid", "n", "left", F.coalesce("root", "rid").alias("root")))
    sizes = named.groupBy("e", "root").agg(F.count("*").alias("k"))
    largest = scratch.save("hot-largest", sizes.groupBy("e").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count("*").alias("roots")).filter("roots > 1").select("e", "largest"))
    open_ = scratch.save("hot-open", named.join(largest, "e").withColumn("outside", F.col("root") != F.col("largest")).drop("largest"))
    rows = _side(open_.filter("outside"), "a", "rid", "n", "left", "root").join(_side(open_, "b", "rid", "n", "left", "root", "outside"), "e")
    rows = rows.filter((F.col("root_a") != F.col("root_b")) & (~F.col("outside_b") | (F.col("rid_a") < F.col("rid_b")))).filter(fits(F.col("left_a"), F.col("n_a"), F.col("left_b"), F.col("n_b")))
    rest = scratch.save("hot-rest", rows.select(*ends(F.col("rid_a"), F.col("rid_b"))).distinct().join(stars, ["a", "b"], "left_anti"))
    out = scratch.save("links-3", links.unionByName(_verified(_may_link(rest, prefixes, percent), full, percent)))
    scratch.drop("hot-postings", "hot-centres", "stars", "links-2", "roots-2", "hot-named", "hot-largest", "hot-open", "hot-rest")
    return out


def similar(docs: DataFrame, size: int = 4, percent: int = 85, rare: int = RARE, share: float = SHARE) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_shingles, component_id).

    A text's set holds its different ``size``-word shingles, A-Z in lower case (of a shorter text all its words as one). Texts link when their sets' intersection is at least ``percent`` % of
    their union; component_id is the least doc_id reachable by links, itself included. Elements are told apart by 64 bits of hash.
    Null and empty texts, or such without words, have an empty set and link with nothing; rows of one set are linked, repeated rows and different texts under one
    id too if they are alike; a null doc_id counts as least and stays null; an empty table gives no rows; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    named = keyed(docs)
    spec = "did long, tag long, n long, d1 long, d2 long, low array<long>"
    sets = scratch.save("sets", named.mapInArrow(_sets(size, percent, share), spec).withColumn("rid", F.monotonically_increasing_id()))
    classes = scratch.save("classes", sets.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("did", "rid")).alias("one")).select("d1", "d2", F.col("one.did").alias("least"), F.col("one.rid").alias("rid")))
    distinct = scratch.save("distinct", sets.join(classes.select("rid"), "rid").select("rid", "did", "tag", "n", "low"))
    first = _prefixes(scratch, "first", distinct, percent, share, rare)
    hot = first.filter(F.exists("is_hot", lambda x: x)).select("rid")
    pairs = _group_pairs(scratch, "first", first, percent)
    wanted = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).unionByName(hot).distinct()
    wanted = scratch.save("wanted", distinct.select("rid", "did", "tag").join(wanted, "rid"))
    # rows that repeat an id and text come once
    held = named.join(wanted, ["did", "tag"]).dropDuplicates(["did", "tag"]).select("rid", "text")
    full = scratch.save("full", held.mapInArrow(_full(size), "rid long, n long, set array<long>"))
    links = scratch.save("links", _verified(pairs, full, percent))
    again = full.join(scratch.save("hot", hot), "rid", "left_semi").select("rid", "n", F.col("set").alias("low"))
    second = _prefixes(scratch, "second", again, percent, 1.0, rare)
    more = _group_pairs(scratch, "second", second, percent).join(pairs, ["a", "b"], "left_anti")
    links = scratch.save("links-1", links.unionByName(_verified(more, full, percent)))
    links = _hot_links(scratch, second, full, links, percent)
    roots = scratch.save("roots", components(scratch, links))
    named = scratch.save("named", classes.join(roots, classes["rid"] == roots["node"], "left").select("d1", "d2", "least", F.coalesce("root", "rid").alias("root")))
    least = scratch.save("least", named.groupBy("root").agg(F.min("least").alias("component")))
    of_set = scratch.save("of_set", named.join(least, "root").select("d1", "d2", "component"))
    scratch.drop("classes", "distinct", "first-prefixes", "first-candidates", "wanted", "full", "hot", "links", "second-prefixes", "second-candidates", "links-1", "links-3", "roots", "named", "least")
    out = sets.select("did", "n", "d1", "d2").join(of_set, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("did"))
    return out.select(id_back(F.col("did")).alias("doc_id"), F.col("n").alias("n_shingles"), id_back(component).alias("component_id"))
