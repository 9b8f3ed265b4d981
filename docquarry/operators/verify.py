"""Checking the figures of generated answers against the sources they cite, for all answers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.text import half_width
from docquarry.operators.finance import UNIT, base_unit, in_base_unit, number

TAG = r"\[来源(\d+)\]"
VALUE = rf"([-+]?\d[\d,]*(?:\.\d+)?)\s*{UNIT}"


def _matches(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<raw, start>>: each match and where it begins, from 0."""
    raws, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    step = lambda acc, x: F.struct((acc.at + x["b"] + x["n"]).alias("at"), F.concat(acc.out, F.array(acc.at + x["b"])).alias("out"))
    lengths = F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(raws)).alias("b"), raws.alias("r")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["r"]).alias("n")))
    starts = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc.out)
    return F.transform(F.arrays_zip(raws.alias("raw"), starts.alias("start")), lambda x: F.struct(x["raw"].alias("raw"), x["start"].alias("start")))


def source_tags(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(query_id, idx, place, start, end): the source tags of each answer in order, and the characters they take."""
    rows = answers.select("query_id", F.posexplode_outer(_matches(F.coalesce(text, F.lit("")), TAG)).alias("place", "m")).filter("m is not null")
    return rows.select("query_id", F.regexp_extract("m.raw", TAG, 1).cast("int").alias("idx"), "place", F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.raw")).alias("end"))


def figures(answers: DataFrame, text: str = "answer", least: float = 0.001) -> DataFrame:
    """(query_id, place, start, raw, value, unit): numbers outside source tags and where they begin, without tiny ones and bare years.

    Tags count up to four digits."""
    masked = F.coalesce(text, F.lit(""))
    for digits in range(1, 5):  # as many marks as characters, so that places hold
        masked = F.regexp_replace(masked, rf"\[来源\d{{{digits}}}\]", "\u0001" * (4 + digits))
    rows = answers.select("query_id", F.posexplode_outer(_matches(masked, VALUE)).alias("place", "m"))
    rows = rows.select("query_id", "place", F.col("m.start").alias("start"), F.col("m.raw").alias("raw")).select("query_id", "place", "start", "raw", number(F.regexp_extract("raw", VALUE, 1)).alias("n"), F.regexp_extract("raw", VALUE, 2).alias("unit"))
    keep = (F.abs("n") >= least) & ~((F.col("unit") == "") & F.col("n").between(2000, 2099) & (F.col("n") == F.floor("n")))
    return rows.filter(keep).select("query_id", "place", "start", "raw", F.col("n").alias("value"), "unit")


def cited_pairs(answers: DataFrame, text: str = "answer", near: int = 20, far: int = 100) -> DataFrame:
    """(query_id, value, unit, idx): each figure with the source it is cited from.

    A tag takes the nearest figure ending fewer than ``near`` characters before it. Else, within its sentence, tags that stand together take
    the last figures from the right, a tag with fewer than ``far`` characters behind it takes all figures before it that no tag took, and
    any other the nearest. Rows are de-duplicated."""
    sentence = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^。！？\n]+(?:[。！？](?:\s*\[来源\d+\])*)?"), F.lit(0))
    rows = answers.select("query_id", F.posexplode(sentence).alias("s", "sentence"))
    # pieces between tags: the text before each run of tags, and the run
    part = rows.select("query_id", "s", "sentence", F.posexplode(F.regexp_extract_all("sentence", F.lit(rf"[^\[]*?(?:{TAG})+".replace(r"(\d+)", r"\d+")), F.lit(0))).alias("g", "piece"))
    tags = F.regexp_extract_all("piece", F.lit(TAG), F.lit(1))
    before = F.regexp_replace("piece", TAG, "")
    raws = F.regexp_extract_all(before, F.lit(VALUE), F.lit(0))
    held = part.select("query_id", "s", "g", tags.alias("tags"), raws.alias("raws"), before.alias("before")).filter(F.size("raws") > 0)
    n, m = F.size("raws"), F.size("tags")
    trailing = F.length(F.regexp_extract("before", rf"{VALUE}([^\d]*)$", 3))
    one = F.array(F.struct(F.element_at("raws", -1).alias("raw"), F.get("tags", F.lit(0)).alias("tag")))
    all_of = F.transform("raws", lambda r: F.struct(r.alias("raw"), F.get("tags", F.lit(0)).alias("tag")))
    several = F.transform(F.sequence(F.lit(1), F.least(n, m)), lambda i: F.struct(F.get("raws", n - i).alias("raw"), F.get("tags", m - i).alias("tag")))
    pairs = F.when(m > 1, several).when(trailing < near, one).when(trailing < far, all_of).otherwise(one)
    out = held.select("query_id", F.explode(pairs).alias("p")).select("query_id", "p.raw", F.col("p.tag").cast("int").alias("idx"))
    out = out.select("query_id", number(F.regexp_extract("raw", VALUE, 1)).alias("value"), F.regexp_extract("raw", VALUE, 2).alias("unit"), "idx")
    return out.filter(~((F.col("unit") == "") & F.col("value").between(2000, 2099) & (F.col("value") == F.floor("value")))).distinct()


def unit_class(unit: Column) -> Column:
    return F.when(unit.isin("%", "倍"), "ratio").when(base_unit(unit) == "元", "money").otherwise("other")


def magnitude(value: Column, unit: Column, width: float = 1e7) -> Column:
    """The bucket in which values of a kind are compared: money by ``width``, others by their rounded value."""
    return F.when(unit_class(unit) == "money", F.floor(in_base_unit(value, unit) / width)).otherwise(F.round(value, 0)).cast("long")


def verify(pairs: DataFrame, sources: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """``pairs`` with ``passed``: the value stands in its source (query_id, idx, text) as a whole number, or a like figure is within tolerance.

    A source that isn't there fails."""
    plain = half_width(F.col("text"))
    found = F.transform(
        F.regexp_extract_all(plain, F.lit(VALUE), F.lit(0)), lambda r: F.struct(number(F.regexp_extract(r, VALUE, 1)).alias("v"), F.regexp_extract(r, VALUE, 2).alias("u"))
    )
    rows = pairs.join(sources.select("query_id", "idx", found.alias("found")), ["query_id", "idx"], "left")
    mine = in_base_unit(F.col("value"), F.col("unit"))
    like = lambda s: unit_class(s.u) == unit_class(F.col("unit"))
    close = lambda s: like(s) & (F.abs(in_base_unit(s.v, s.u) - mine) <= tolerance * F.abs(mine))
    equal = lambda s: (s.v == F.col("value")) & ((F.col("unit") == "") | (s.u == F.col("unit")) | (s.u == ""))
    return rows.withColumn("passed", F.coalesce(F.exists("found", lambda s: equal(s) | close(s)), F.lit(False))).drop("found")


def verdicts(verified: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, pairs, failed, passed, issues): an answer passes if no pair failed; the pairs that did, by source and value."""
    said = F.concat(F.lit("来源"), "idx", F.lit("："), F.format_string("%.2f", F.col("value").cast("double")), F.coalesce("unit", F.lit("")))
    failed = F.collect_list(F.when(~F.col("passed"), F.struct("idx", "value", said.alias("said"))))
    counts = verified.groupBy("query_id").agg(F.count("*").alias("pairs"), F.count_if(~F.col("passed")).alias("failed"), F.transform(F.array_sort(failed), lambda x: x.said).alias("issues"))
    rows = answers.select("query_id").join(counts, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("query_id", zero("pairs").alias("pairs"), zero("failed").alias("failed"), (zero("failed") == 0).alias("passed"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def cross_document(verified: DataFrame, least: int = 3, spread: float = 0.05, width: float = 1e7) -> DataFrame:
    """(query_id, kind, bucket, n, low, high): values of a kind and magnitude, from several sources, that differ too much."""
    rows = verified.filter("passed").withColumns({"kind": unit_class(F.col("unit")), "base": in_base_unit(F.col("value"), F.col("unit")), "bucket": magnitude(F.col("value"), F.col("unit"), width)})
    found = rows.groupBy("query_id", "kind", "bucket").agg(F.count("*").alias("n"), F.min("base").alias("low"), F.max("base").alias("high"))
    return found.filter((F.col("n") >= least) & (F.col("low") > 0) & ((F.col("high") - F.col("low")) / F.col("low") > spread))


def growth_issues(values: DataFrame, low: float = 0.02, high: float = 0.10) -> DataFrame:
    """(query_id, rate, a, b, off): stated growth rates whose nearest pair of adjacent amounts is off by ``low`` to ``high``.

    ``values`` has (query_id, value, unit): per cent values are rates, money values amounts; pairs are read in both directions."""
    money = values.filter(unit_class(F.col("unit")) == "money").select("query_id", in_base_unit(F.col("value"), F.col("unit")).alias("a")).distinct()
    pairs = money.withColumn("b", F.lead("a").over(Window.partitionBy("query_id").orderBy("a"))).filter("b is not null and a <> 0 and b <> 0")
    both = pairs.unionByName(pairs.select("query_id", F.col("b").alias("a"), F.col("a").alias("b")))
    rates = values.filter("unit = '%'").select("query_id", (F.col("value") / 100).alias("rate")).distinct()
    near = rates.join(both, "query_id").withColumn("off", F.abs((F.col("b") - F.col("a")) / F.col("a") - F.col("rate")))
    w = Window.partitionBy("query_id", "rate").orderBy("off", "a", "b")
    return near.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k").filter(F.col("off").between(low, high))


def footer(issues: DataFrame, text: str, most: int = 3) -> DataFrame:
    """(query_id, footer): the first issues, and how many there are more."""
    held = issues.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col(text).alias("t")))).alias("i"))
    n = F.size("i")
    shown = F.array_join(F.transform(F.slice("i", 1, most), lambda x: x.t), "；")
    return held.select("query_id", F.concat(shown, F.when(n > most, F.concat(F.lit("…另有"), (n - most).cast("string"), F.lit("项"))).otherwise("")).alias("footer"))


def display_name(source_file: Column, company: Column, doc_type: Column) -> Column:
    """A source's name to show: company, type, and its file name without announcement code and underscores."""
    name = F.trim(F.replace(F.regexp_replace(source_file, r"(_AP\d+)?\.md$", ""), F.lit("_"), F.lit(" ")))
    return F.concat_ws(" ", F.nullif(company, F.lit("")), F.nullif(doc_type, F.lit("")), name)


def unsupported(answers: DataFrame, contexts: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(query_id, value, unit): an answer's figures with units that its context holds neither literally nor within tolerance."""
    stated = figures(answers).filter("unit <> ''").select("query_id", F.col("raw").alias("raw"), "value", "unit")
    known = figures(contexts.withColumnRenamed("context", "answer")).select("query_id", in_base_unit(F.col("value"), F.col("unit")).alias("known"), unit_class(F.col("unit")).alias("known_kind"))
    mine = in_base_unit(F.col("value"), F.col("unit"))
    ok = stated.join(known, "query_id").filter((F.col("known_kind") == unit_class(F.col("unit"))) & (F.abs(F.col("known") - mine) <= tolerance * F.abs(mine)))
    literal = stated.join(contexts, "query_id").filter(F.contains("context", "raw"))
    name = ["query_id", "value", "unit"]
    return stated.select(*name).distinct().join(ok.select(*name).unionByName(literal.select(*name)).distinct(), name, "left_anti")
