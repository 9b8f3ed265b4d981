"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe_chunks, chat, decontaminate, line_quality, masks, ngram_join, periodic, quality_gbt, shard, simhash, suffix_dedup, token_files, window_dedup
from docquarry.session import table

Query = Callable[[SparkSession, str], DataFrame]
CONTROL = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shards(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_ids(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL))
    return chat.format_and_read(turns.union(control))


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.remove_later_windows(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(table(spark, sf_dir, "documents"))


def with_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document, by a hash of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_runs(table(spark, sf_dir, "documents")))
    longest = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when((r.length > best.length), r).otherwise(best))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), "runs", "collapsed")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    return rows.select(
        "doc_id", "n_runs", "r.start", "r.length", "r.period", F.floor(1000 * F.col("r.length") / F.col("r.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


def op13_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    own = (op1_decontamination, op2_simhash, op3_sharding, op4_quality_classifier, op5_suffix_dedup, op6_bpe, op7_token_files, op8_chat, op9_window_dedup, op10_quality_rules, op11_ngram_join, op12_periodic_runs, op13_mask_search)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_LETTERS}'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '{_LETTERS}'), []) AS w FROM benchmark),
bw AS (SELECT item_id, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS t FROM bw),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS s, w FROM d WHERE len(w) > 0),
hits AS (SELECT doc_id, s, iw.n, item_id FROM dw, sizes, iw
         WHERE sizes.n = iw.n AND s + sizes.n - 1 <= len(w) AND array_to_string(w[s : s + sizes.n - 1], ' ') = iw.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, unnest(generate_series(0, CAST(len(h) // 2 - 400 AS BIGINT), 500)) AS base, h FROM d WHERE len(h) >= 800),
p AS (SELECT doc_id, base, substr(h, 2 * base + 1, 1798) AS h FROM b),
s AS (SELECT doc_id, base, unnest(generate_series(0, CAST(len(h) // 2 - 400 AS BIGINT))) AS i, h FROM p),
k AS (SELECT doc_id, base + i AS s, md5(substr(h, 2 * i + 1, 800)) AS k FROM s),
r AS (SELECT doc_id, s FROM k QUALIFY count(*) OVER (PARTITION BY k) > 1),
e AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM r),
g AS (SELECT doc_id, s, sum(CASE WHEN before IS NULL OR s > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM e),
spans AS (SELECT doc_id, g, min(s) AS a, max(s) + 400 AS b FROM g GROUP BY ALL),
cut AS (SELECT doc_id, a AS upto, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS since FROM spans
        UNION ALL SELECT d.doc_id, len(h) // 2, coalesce(max(b), 0) FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id, len(h)),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (upto - since) AS BIGINT)), '' ORDER BY since, upto) AS t FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP8 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL
           SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
u AS (SELECT *, 24 + length(role) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
v AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM u)
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM v GROUP BY conv_id"""

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORDS}'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
s AS (SELECT doc_id, p AS s, count(*) OVER t AS n, string_agg(x, ' ') OVER t AS t FROM p WINDOW t AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
h AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS k FROM s WHERE n = 20),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM h WHERE k > 1),
k AS (SELECT p.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p.p) AS t FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p WHERE g.p IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
f AS (SELECT doc_id, p AS s, count(*) OVER t AS n, string_agg(x, ' ') OVER t AS t FROM p WINDOW t AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
r AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, t) AS c FROM f WHERE n = 5),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + 4)) AS p FROM r WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM d),
m AS (SELECT doc_id, host, line, i, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS k, len(regexp_extract_all(line, '{_WORDS}')) AS n FROM l WHERE regexp_matches(line, '{_WORDS}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM m GROUP BY doc_id),
size AS (SELECT host, count(*) AS n FROM d GROUP BY host),
texts AS (SELECT doc_id, md5(text) AS t FROM d),
common AS (SELECT host, k, count(DISTINCT t) AS df, least(greatest(20, 0.05 * size.n), 1000) AS most FROM m JOIN texts USING (doc_id) JOIN size USING (host) GROUP BY host, k, size.n
           HAVING count(DISTINCT t) > least(greatest(20, 0.05 * size.n), 1000)),
lost AS (SELECT doc_id, host, m.n, k, df, most FROM m JOIN common USING (host, k)),
gone AS (SELECT doc_id, host, sum(n) AS n, md5(string_agg(DISTINCT k, chr(10) ORDER BY k)) AS lines FROM lost GROUP BY doc_id, host),
y AS (SELECT d.doc_id, d.host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS lost, lines, len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
grouped AS (SELECT host, min(doc_id) AS doc_id, count(DISTINCT t) AS m FROM y JOIN texts USING (doc_id) WHERE NOT base_failed AND n_words - lost < 0.2 * n_words GROUP BY host, lines HAVING count(DISTINCT t) > 1),
x AS (SELECT y.*, grouped.m IS NOT NULL AND n_words - coalesce((SELECT sum(n) FROM lost WHERE lost.doc_id = y.doc_id AND df - grouped.m + 1 > most), 0) >= 0.2 * n_words AS spared
      FROM y LEFT JOIN grouped USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND (n_words - lost >= 0.2 * n_words OR spared) AS kept
FROM x"""

#: The decimal id's CRC-32, bit by bit: each byte is followed by eight shifts, marked -1.
OP12 = f"""
WITH s AS (SELECT doc_id, [4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS s,
                  regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n, xor(list_reduce(s, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) AS h FROM s),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, h // 10 AS g FROM c),
p AS (SELECT doc_id, n, h, w, a, 1 + (n - a) // (3 + g % 8) AS p FROM a),
o AS (SELECT doc_id, n, unnest(range(n)) AS i, h, w, a, p FROM p),
t AS (SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS x FROM o),
e AS (SELECT t.doc_id, t.i, u.i - t.i AS q FROM t JOIN t AS u ON t.doc_id = u.doc_id AND t.x = u.x AND u.i > t.i AND 4 * (u.i - t.i) <= t.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length),
f AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
z AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND i >= r.start + r.period AND i < r.start + r.length) GROUP BY doc_id)
SELECT c.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM c LEFT JOIN f USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN z USING (doc_id)"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS w FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(w)) AS big_l FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS t FROM benchmark),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM u WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + CAST((90 * n * big_n) // big_l AS BIGINT))))) AS BIGINT) AS score
      FROM p JOIN w USING (t) JOIN q USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op5_suffix_dedup": OP5, "op8_chat": OP8, "op9_window_dedup": OP9, "op10_quality_rules": OP10, "op12_periodic_runs": OP12, "op13_mask_search": OP13}
