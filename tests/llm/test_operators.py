"""Each operator against a plain restatement of its contract, over every awkward case, and over empty tables."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import bpe_chunks, chat, decontaminate, hashing, line_quality, masks, ngram_join, periodic, quality_gbt, shard, simhash, suffix_dedup, token_files, window_dedup
from docquarry.llm.queries import CONTROL, tokenizer_path, with_runs

sys.path.insert(0, str(Path(__file__).parent))
import corpus as C  # noqa: E402

DOCS = C.rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, C.COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], C.COLUMNS)


def same(frame, expected):
    assert Counter(map(tuple, frame.collect())) == Counter(expected)


def test_decontamination(spark, docs, none):
    long = next(t for _, t, *_ in DOCS if t and len(t.split()) > 100)
    items = [(1, " ".join(long.split()[5:30]).upper()), (2, "Two words"), (3, None), (4, ""), (5, "nowhere at all in there"), (6, "日本語" * 300), (7, " ".join(long.split()[5:30])), (None, "a b c"), (8, "ha")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = C.contamination(DOCS, [("" if i is None else i, t) for i, t in items])
    same(decontaminate.contamination(docs, bench), expected)
    same(decontaminate.contamination(docs, bench.limit(0)), C.contamination(DOCS, []))
    assert decontaminate.contamination(none, bench).collect() == []
    bad = {C.key(r[0]) for r in expected if r[-1]}
    assert sorted(C.key(r.doc_id) for r in decontaminate.drop_contaminated(docs, bench).collect()) == sorted(C.key(d[0]) for d in DOCS if C.key(d[0]) not in bad)


def test_decontamination_by_shuffle(spark, docs, monkeypatch):
    """Many hashes: positions are shuffled, long texts are not, and the result is the same."""
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", -1)
    long = next(t for _, t, *_ in DOCS if t and len(t.split()) > 10_000).split()
    items = [(1, DOCS[11][1]), (2, " ".join(long[-30:])), (3, " ".join(long[5000:5020])), (4, " ".join(long[:13])), (5, "Two words"), (6, " ".join(long[-30:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(decontaminate.contamination(docs, bench), C.contamination(DOCS, items))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_long_words_stay_apart(spark):
    """Words that every polynomial hash modulo 2**64 gives one value: nothing repeats, so nothing goes."""
    one, other = [], []
    for size in (512, 1024, 4096):
        bits = [bin(i).count("1") % 2 for i in range(size)]
        one.append("".join("ab"[b] for b in bits))
        other.append("".join("ba"[b] for b in bits))
        assert all(hashing.word_codes(np.frombuffer(x.encode(), np.uint8), np.zeros(1, int), np.full(1, size), k)[0] != hashing.word_codes(np.frombuffer(y.encode(), np.uint8), np.zeros(1, int), np.full(1, size), k)[0] for x, y in [(one[-1], other[-1])] for k in (0, 1))
    equal = " ".join(f"w{i}" for i in range(19))
    rows = [(2 * k + j, f"{equal} {w[k]}") for k in range(3) for j, w in enumerate((one, other))]
    rows += [(10 + k, f"{equal[:30]} {one[k]} a b c d and {other[k]} a b c d {k}") for k in range(3)]
    docs = [(i, t, "en", "s", 1, 0, "t", "h") for i, t in rows]
    frame = spark.createDataFrame(docs, C.COLUMNS)
    same(window_dedup.remove_later_windows(frame), C.later_windows(docs))
    assert [r.n_removed for r in window_dedup.remove_later_windows(frame).collect()] == [0] * 9
    same(line_quality.quality(frame).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), C.base_quality(docs))
    assert {r.n_repeat_words for r in line_quality.quality(frame).collect()} == {0}


def test_simhash(docs, none):
    same(simhash.near_duplicates(docs), C.near_duplicates(DOCS))
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.one_of_each(docs).collect()
    assert sorted(C.key(r.doc_id) for r in kept) == sorted({C.key(c) for _, _, c in C.near_duplicates(DOCS)})


def test_grid_never_misses(spark):
    """Fingerprints within two bits share a cell of counts."""
    rng = np.random.RandomState(1)
    pairs = []
    for _ in range(300):
        a = int(rng.randint(0, 1 << 62)) * 4 + int(rng.randint(0, 4))
        b = a
        for bit in rng.choice(64, rng.randint(0, 3), replace=False):
            b ^= 1 << int(bit)
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        pairs.append((signed(a), signed(b)))
    from pyspark.sql import functions as F

    cells = lambda c: simhash.grid_cells(simhash.segment_counts(F.col(c)))
    rows = spark.createDataFrame(pairs, "a long, b long").select(F.arrays_overlap(cells("a"), cells("b")).alias("met"))
    assert rows.filter("not met").count() == 0


def test_long_chain_is_one_component(spark):
    from docquarry.llm.graph import components
    from docquarry.session import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 102)], "u long, v long")
    got = dict(map(tuple, components(Scratch(spark, "t"), edges).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_sharding(docs, none):
    rows = shard.shards(docs, n_shards=5).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d[0], len((d[1] or "").encode()) + 16, C.crc(d[1])) for d in DOCS)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    source = {d[0]: d[3] for d in DOCS}
    for s in counts:
        for name, n in Counter(d[3] for d in DOCS).items():
            here = sum(source[r.doc_id] == name for r in rows if r.shard == s)
            assert abs(here - n * counts[s] / len(DOCS)) <= 2
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    again = shard.shards(docs, n_shards=5).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert shard.shards(none).collect() == []


def test_quality_classifier(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_gbt.classify(docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d[0] for d in DOCS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in rows)
    assert all(r.score == 0.5 for r in quality_gbt.classify(docs, labels.limit(0)).collect())
    assert quality_gbt.classify(none, labels).collect() == []


def test_statistics_and_scores(spark, docs):
    """Each statistic and each tree against a plain restatement."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    forest = quality_gbt.train(docs, labels)
    for _, text, *_ in DOCS:
        want = C.features(text)
        got = quality_gbt.features(np.frombuffer((text or "").encode(), np.uint8))
        assert got.tolist() == pytest.approx(want, rel=1e-9, abs=1e-12)
        assert forest.score(got[None, :])[0] == pytest.approx(C.tree_score(forest, got), rel=1e-9)
    rows = {(r.doc_id, round(r.score, 9)) for r in quality_gbt.score(docs, forest).collect()}
    assert rows == {(d[0], round(C.tree_score(forest, quality_gbt.features(np.frombuffer((d[1] or "").encode(), np.uint8))), 9)) for d in DOCS}


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{Path(sf_dir).parent}/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    rows = quality_gbt.classify(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "quality").toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    auc = ((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean()
    assert auc > 0.9


def test_trees_fit_a_rule():
    x = np.random.RandomState(0).rand(2000, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality_gbt.fit(x, y)
    assert ((forest.score(x) > 0.5) == (y == 1)).mean() > 0.97
    assert forest.score(x[:0]).shape == (0,)


@pytest.mark.parametrize("window", [24, 60, 400])
def test_suffix_dedup(docs, none, window):
    same(suffix_dedup.remove_repeats(docs, window), C.repeats(DOCS, window))
    assert suffix_dedup.remove_repeats(none, window).collect() == []


@pytest.mark.parametrize(("window", "hot"), [(24, 2000), (60, 2000), (60, 8), (240, 2000)])
def test_suffix_dedup_keeps_what_stands_first(spark, docs, window, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", hot)
    rows = [r for r in C.rows() if r[0] is not None]
    r = random.Random(5)
    parts = ["".join(r.choice("abcd ") for _ in range(n)) for n in (30, 45, 60, 70, 90, 130, 250, 300)]
    # shared parts in many orders and cut at many places, so that equal windows meet with differing ones between them
    texts = ["".join(p[r.randrange(20) :] for p in r.sample(parts, r.randint(1, 5))) for _ in range(150)]
    rows += [(100 + i, t, None, None, len(t), None, None, None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, C.COLUMNS).repartition(7)
    named = frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).distinct().collect()
    expected = C.later_bytes([(x.doc_id, x.text) for x in sorted(named, key=lambda x: (x.doc_id, x.t))], window)
    got = suffix_dedup.cut_repeats(frame, window, keep_first=True)
    assert got.columns == frame.columns
    # ASCII texts are cut to the byte; in others, characters that are cut in part stay
    plain = {(x.doc_id, x.t) for x in named if (x.text or "").isascii()}
    ids = {d for d, _ in plain} - {x.doc_id for x in named if not (x.text or "").isascii()}
    assert sorted({(x.doc_id, x.text.encode()) for x in got.collect() if x.doc_id in ids}) == sorted({x for x in expected if x[0] in ids})


def test_hot_grams_are_split(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)
    same(suffix_dedup.remove_repeats(docs, 60), C.repeats(C.rows(), 60))


def test_suffix_dedup_with_many_partial_neighbours(spark):
    """Few letters, so that anchors have neighbours agreeing on either side alone."""
    rng = np.random.RandomState(5)
    docs = [(i, "".join(rng.choice(list("ab"), rng.randint(0, 150)))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for window in (8, 12, 16):
        same(suffix_dedup.remove_repeats(frame, window), C.repeats(docs, window))


def test_minimizers_across_block_borders(monkeypatch):
    """Blocks change nothing: each anchor comes once, with the whole range of its offsets."""
    codes = hashing.byte_codes(np.random.RandomState(6).randint(0, 4, 3000).astype(np.uint8))
    for block in (64, 100, 701):
        monkeypatch.setattr(hashing, "BLOCK", 1 << 19)
        whole = hashing.minimizers(codes, 12, 24)
        monkeypatch.setattr(hashing, "BLOCK", block)
        for a, b in zip(hashing.minimizers(codes, 12, 24), whole, strict=True):
            assert a.tolist() == b.tolist()
        assert len(set(whole[0].tolist())) == len(whole[0])


def test_suffix_dedup_of_a_text_longer_than_a_block(spark):
    """Bytes that stand once stay at block borders too, and a repeat across a border goes whole."""
    rng = np.random.RandomState(7)
    once = ["".join(map(chr, rng.randint(97, 123, hashing.BLOCK + 60_000))) for _ in range(2)]
    border = hashing.BLOCK - 400
    passage = once[1][border - 500 : border + 500]
    docs = [(1, once[0]), (2, once[1]), (3, "<" + passage + ">")]
    kept = [once[0], once[1][: border - 500] + once[1][border + 500 :], "<>"]
    expected = [(i, len(t), len(t) - len(k), int(t != k), C.sha(k.encode())) for (i, t), k in zip(docs, kept, strict=True)]
    same(suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")), expected)


def test_cut_keeps_whole_characters(spark):
    docs = [(1, "é" * 300 + "x", 1), (2, "y" + "é" * 300, 1), (3, "fine", 4), (4, None, None)]
    rows = suffix_dedup.cut_repeats(spark.createDataFrame(docs, "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["x", "y", "fine", ""] and [r.n_chars for r in rows] == [1, 1, 4, 0]


def test_merge_by_loser_tree():
    rng = np.random.RandomState(2)
    runs = [sorted({bytes(rng.choice([97, 98], 40).astype(np.uint8)) for _ in range(rng.randint(0, 60))}) for _ in range(7)]

    def prefix(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))

    lcps = [[0, *(prefix(a, b) for a, b in zip(r, r[1:], strict=False))][: len(r)] for r in runs]
    out = list(suffix_dedup.merge(runs, lcps))
    merged = [runs[r][i] for r, i, _ in out]
    assert merged == sorted(x for r in runs for x in r)
    assert [lcp for _, _, lcp in out][1:] == [prefix(a, b) for a, b in zip(merged, merged[1:], strict=False)]


def test_bpe_round_trip(spark, docs, none):
    path = tokenizer_path("word_bpe_49k.json")
    odd = ["don't  stop", "x<|endoftext|>y <|startoftext|>", "é ́x ΑΣ Σ İ", "Ab" * 9000 + " c " + "é" * 9000, "don" * 4000 + "'t's", "a　b\x85c\x1cd", "1234 #$%", "\n\n a "]
    rows = DOCS + [(1000 + i, t, *[None] * 6) for i, t in enumerate(odd)]
    t = bpe_chunks.tokenizer(path)
    expected = []
    for d in rows:
        ids = t.encode(d[1] or "", add_special_tokens=False).ids
        expected.append((d[0], len(ids), C.sha(np.array(ids, "<u4").tobytes()), C.sha(t.decode(ids, skip_special_tokens=False).encode())))
    same(bpe_chunks.encode_decode(spark.createDataFrame(rows, C.COLUMNS), path), expected)
    assert bpe_chunks.encode_decode(none, path).collect() == []


def test_chunks_are_found_again():
    rng = np.random.RandomState(0)
    body = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(4000))
    cut = lambda t: {h for h in _chunks(t)}
    assert len(cut(body) & cut("some other words before it all " + body)) > 0.9 * len(cut(body))


def _chunks(text):
    data = np.frombuffer(text.encode(), np.uint8)
    ends = bpe_chunks.chunk_ends(data)
    return [data[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def test_token_files(spark, docs, none):
    path = tokenizer_path("byte_bpe_50k.json")
    t = token_files.encoder(path, token_files.before_words, "<u2", lower=False).tokenizer
    expected, start = [], 0
    for d in sorted(DOCS, key=lambda d: (C.key(d[0]), d[1] is not None, d[1] or "")):
        ids = [*t.encode(d[1] or "", add_special_tokens=False).ids, 0]
        expected.append((d[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(token_files.written_ids(docs, path), expected)
    same(token_files.written_ids(docs, path, vocabulary=1 << 20), expected)
    assert token_files.written_ids(none, path).collect() == []


def test_chat(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nfoo\\"), (1, 2, "user", None), (2, 0, "system", "\\<|x"), (2, 1, "assistant", ""), (2, 2, "assistant", "<\\|a|>"),
        (3, 0, "user", "alone"), (4, 0, "ro\nle<|im_end|>", "t"), (4, 0, None, None), (5, 1, "assistant", "日本 é"), (5, 0, "assistant", "first"), (5, 0, "assistant", "first"), (None, 0, "assistant", "no id"), (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    expected = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        expected[conv] = (len(own), C.sha("".join(f"{r}\n{x}\n" for _, r, x in own).encode()), len(loss), C.sha(loss.encode()))
    rows = chat.format_and_read(frame).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in rows} == expected and len(rows) == len(expected)
    assert all(r.formatted_chars > 0 for r in rows)
    assert chat.format_and_read(frame.limit(0)).collect() == []


def test_one_example_for_each_reply(spark):
    frame = spark.createDataFrame([(1, i, r, f"t{i}") for i, r in enumerate(["user", "assistant", "user", "assistant", "user"])], "conv_id long, turn long, role string, text string")
    rows = chat.examples(frame).orderBy("example").collect()
    assert [(r.example, r.loss_chars) for r in rows] == [(1, 2), (3, 2), (4, 0)]
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in rows[:2]] == ["t1", "t3"]


def test_window_dedup(spark, none):
    rows = list(dict.fromkeys(DOCS))
    frame = spark.createDataFrame(rows, C.COLUMNS).repartition(3)
    same(window_dedup.remove_later_windows(frame), C.later_windows(rows))
    same(window_dedup.remove_later_windows(frame, window=8, first=2), C.later_windows(rows, 8))
    assert window_dedup.remove_later_windows(none).collect() == []
    once = C.later_windows(rows)
    twice = window_dedup.remove_later_windows(frame.unionByName(frame)).collect()
    assert Counter(map(tuple, twice)) == Counter(once + once)


def test_window_dedup_with_few_words(spark):
    rng = np.random.RandomState(4)
    docs = [(i, " ".join(rng.choice(list("ab"), rng.randint(0, 60)))) for i in range(60)]
    same(window_dedup.remove_later_windows(spark.createDataFrame(docs, "doc_id long, text string"), window=8, first=2), C.later_windows(docs, 8))


def test_quality_rules(docs, none):
    rows = line_quality.quality(docs).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter(C.base_quality(DOCS))
    assert all(r.kept == (not r.base_failed) for r in rows)  # no line is above the limits here
    assert line_quality.quality(none).collect() == []


def test_texts_under_one_id_are_judged_apart(spark):
    """Null and repeated ids: no document goes, or loses lines, by what is found of another."""
    r = random.Random(8)
    prose = lambda: " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(40))
    menu = "menu of the site with several links"
    ids = [None] * 8 + [5] * 8
    docs = [(k, f"{prose()}\n{menu}\n{prose()}" if i % 2 else f"{prose()}\n{prose()}\n{prose()}", "s") for i, k in enumerate(ids)] + [(None, "bad", "s"), (5, "bad", "s"), (5, None, "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(2)
    rows = lambda out: Counter(map(tuple, out.collect()))
    good = docs[:16]
    cut = Counter((k, t.replace(f"\n{menu}\n", "\n"), s) for k, t, s in good)
    assert rows(line_quality.keep_good(frame, least=5, least_words=10)) == cut
    assert rows(simhash.one_of_each(spark.createDataFrame(good, "doc_id long, text string, source string"))) == Counter(good)
    items = spark.createDataFrame([(1, good[3][1]), (2, good[12][1])], "item_id long, text string")
    assert rows(decontaminate.drop_contaminated(frame, items)) == Counter(d for i, d in enumerate(docs) if i not in (3, 12))


def test_common_lines_deplete(spark):
    """A line in many different documents of a host goes, exact copies count once, and what is left decides."""
    menu = "menu of the site with several links to follow"
    docs = [(i, f"own words number {i} and nothing else\n{menu}\nlast line {i} of this page here", "s") for i in range(30)]
    docs += [(100 + i, "a copied text of some length\nthat many pages hold alike in here\nand it never changes at all", "s") for i in range(30)]
    docs += [(200, "x\n" + "\n".join([menu] * 4) + "\ny", "s"), (201, menu, "other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    how = {"least": 5, "share": 0.05, "least_words": 1, "repeat_percent": 100}
    rows = {r.doc_id: r.kept for r in line_quality.quality(frame, **how).collect()}
    assert [k for k, v in rows.items() if not v] == [200]
    kept = {r.doc_id: r.text for r in line_quality.keep_good(frame, **how).collect()}
    assert kept[3] == "own words number 3 and nothing else\nlast line 3 of this page here"
    assert kept[101] == docs[31][1] and kept[201] == menu and 200 not in kept and len(kept) == 61


def test_a_block_of_common_lines_goes_whole(spark):
    """A footer of four lines that never change their neighbours, on 200 pages of a host, and a limit that large hosts don't raise."""
    r = random.Random(9)
    prose = lambda: " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(12))
    footer = ["all rights are reserved by us", "read our cookie policy for more", "About | Help | Terms", "follow us"]
    own = [f"{prose()}\n{prose()}" for _ in range(200)]
    docs = [(i, t + "\n" + "\n".join(footer), "s") for i, t in enumerate(own)] + [(1000 + i, f"{prose()}\n{prose()}", "s") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    kept = {r.doc_id: r.text for r in line_quality.keep_good(frame).collect()}
    assert kept == dict(enumerate(own)) | {i: t for i, t, _ in docs[200:]}
    kept = {r.doc_id: r.text for r in line_quality.keep_good(frame, share=0.9, most=150).collect()}
    assert kept == dict(enumerate(own)) | {i: t for i, t, _ in docs[200:]}
    assert {r.text for r in line_quality.keep_good(frame, share=0.9).collect()} == {t for _, t, _ in docs}


def test_no_group_of_near_copies_goes_whole(spark):
    """Near copies make their own lines common: one of them stays, without the lines that are common without them too. Pages of furniture alone still go."""
    r = random.Random(10)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    shared, footer = [prose(8) for _ in range(10)], "all rights are reserved by us"
    docs = [(i, "\n".join([*shared, f"own {i} {prose(2)}", footer]), "s") for i in range(60)]
    docs += [(100 + i, f"{prose(20)}\n{footer}\n{prose(20)}", "s") for i in range(60)]
    docs += [(200 + i, "\n".join([footer] * 3 + ["x"] * (i + 1)), "s") for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    how = {"least": 20, "share": 0.05, "repeat_percent": 100}
    kept = {x.doc_id: x.text for x in line_quality.keep_good(frame, **how).collect()}
    assert set(kept) == {0, *range(100, 160)}
    assert kept[0] == docs[0][1].removesuffix("\n" + footer) and footer not in kept[100]
    assert {x.doc_id for x in line_quality.quality(frame, **how).collect() if x.kept} == set(kept)


def test_operators_with_clashing_columns(spark):
    """Other columns may be named as what the operators use inside."""
    names = "whole spans rest row cuts gone_lines did tag host at line words text_tag kept_id kept_tag marked bad_id bad_tag a b h w n_hit sum one copies".split()
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z", None, "", "x y"]
    docs = [(i, t, "s", 3, *range(len(names))) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars int, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([(1, "nothing of it")], "item_id long, text string")
    for out, left in ((line_quality.keep_good(frame), [0]), (simhash.one_of_each(frame), [0, 1, 3]), (suffix_dedup.cut_repeats(frame, 24, True), [0, 1, 2, 3]), (decontaminate.drop_contaminated(frame, items), [0, 1, 2, 3])):
        assert out.columns == frame.columns
        assert sorted((r.doc_id, *r[4:]) for r in out.collect()) == [(i, *range(len(names))) for i in left]
        assert out.limit(0).columns == frame.columns
    none = frame.limit(0)
    for out in (line_quality.keep_good(none), simhash.one_of_each(none), suffix_dedup.cut_repeats(none, 24, True), decontaminate.drop_contaminated(none, items)):
        assert out.columns == frame.columns and out.collect() == []


def near_copies(seed=5):
    """Copies of one text with nothing to many words changed, in front, in the middle or at the end; some with words of another text; short ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, other = [word() for _ in range(120)], [word() for _ in range(100)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join(base + other), " ".join(other)]
    for changes in range(9):
        for _ in range(9):
            w = list(base)
            for at in r.sample(range(len(w)), changes):
                w[at] = word()
            texts.append(" ".join(w[r.randint(0, 3) : len(w) - r.randint(0, 3)]))
    texts += [" ".join(base[:k]) for k in range(1, 120, 3)] + [" ".join(other[k:]) for k in range(0, 100, 7)]
    texts += ["\n".join(base[i : i + 3]) for i in range(0, 9, 3)] * 2
    return [(1000 + i, t, "en", "s", 1, 0, "t", "h") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("rare", "share", "percent"), [(32, 0.3, 85), (2, 0.3, 85), (4, 1.0, 85), (3, 0.1, 60)])
def test_ngram_join(spark, docs, none, rare, share, percent):
    """Rare and hot elements, elements beyond those counted, and lists with several components."""
    rows = DOCS + near_copies()
    frame = docs.unionByName(spark.createDataFrame(near_copies(), C.COLUMNS))
    same(ngram_join.similar(frame, percent=percent, rare=rare, share=share), C.ngram_join(rows, percent=percent))
    if rare == 32:
        assert ngram_join.similar(none).collect() == []


def test_ngram_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_ELEMENTS", 0)
    rows = near_copies(8)
    same(ngram_join.similar(spark.createDataFrame(rows, C.COLUMNS), rare=2), C.ngram_join(rows))


def test_runs_of_codes():
    """Small alphabets, several documents in a batch, every threshold."""
    r = random.Random(2)
    for _ in range(400):
        texts, codes = [], []
        for d in range(r.randint(1, 3)):
            w = [r.randrange(r.choice((1, 2, 3, 5))) for _ in range(r.randint(0, 40))]
            if r.random() < 0.5 and w:
                w = w[: r.randint(0, len(w))] + w[: r.randint(1, len(w))] * r.randint(1, 6)
            texts.append((len(codes), w))
            codes += [*w, -1 - d]
        least, times = r.choice([(6, 4), (2, 2), (4, 3)])
        want = sorted(((a + s, a + s + m, q) for a, w in texts for s, m, q in C.runs(w, least, times)), key=lambda x: (x[0], x[2]))
        assert [tuple(map(int, x)) for x in zip(*periodic.runs(np.array(codes, np.int64), least, times), strict=True)] == want


def test_smaller_before_beyond_the_hops():
    r = random.Random(4)
    for values in (list(range(50)) + [0, 3, 0, 0], [5] * 70, [r.randrange(4) for _ in range(200)], list(range(40, 0, -1)) + list(range(40)) + [-1]):
        a = np.array(values)
        for strict in (True, False):
            want = [max((j for j in range(i) if values[j] < values[i] or (not strict and values[j] == values[i])), default=-1) for i in range(len(values))]
            assert periodic.smaller_before(a, strict).tolist() == want


def test_periodic_runs(spark, docs, none, monkeypatch):
    more = ["a a a a a a", "a a a a a", "x y x y x y x y x y z", "a b a b a b a b c a b c a b c a b c", "ha " * 400 + "ho " * 7, "q " + "one two three " * 5 + "one"]
    rows = DOCS + [(2000 + i, t, "en", "s", 1, 0, "t", "h") for i, t in enumerate(more)]
    frame = docs.unionByName(spark.createDataFrame(rows[len(DOCS) :], C.COLUMNS))
    want = []
    for d in rows:
        w = [x.decode() for x in (d[1] or "").encode().split()]
        found = C.runs(w)
        want.append((d[0], len(w), tuple(found), C.collapsed(w, found)))
    plain = lambda frame: Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in frame.collect())
    assert plain(periodic.periodic_runs(frame)) == Counter(want)
    assert periodic.periodic_runs(none).collect() == []
    monkeypatch.setattr(periodic, "TESTS_AT_ONCE", 3)
    codes = np.array([0, 1] * 20 + [2] * 9 + [-1])
    assert [x.tolist() for x in periodic.runs(codes, 6, 4)] == [[0, 40], [40, 49], [2, 1]]


def test_with_runs(docs):
    """Every tenth document repeats a stretch of its words to its end; the others and those without words stay."""
    got = Counter((r.doc_id, " ".join((r.text or "").encode().decode().split())) for r in with_runs(docs).collect())
    want: Counter = Counter()
    for i, t, *_ in DOCS:
        w = [x.decode() for x in (t or "").encode().split()]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        want[(i, " ".join(w))] += 1
    assert got == want


def test_mask_search(spark, docs, none, monkeypatch):
    """Ties by doc_id, repeated rows, items without terms, items of over 64 terms, several groups of items, and only what can still come in is evaluated."""
    texts = [t for _, t, *_ in DOCS if t and len(t.split()) > 20]
    items = [(1, texts[1]), (2, "Two words, two!"), (3, None), (4, ""), (5, "nowhereatall"), (6, " ".join(texts[2].split()[:5])), (7, "ha 日本語"), (8, texts[0][:3000]), (8, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = C.ranked(DOCS, items)
    same(masks.search(docs, bench), want)
    monkeypatch.setattr(masks, "GROUP_BYTES", 4000)
    same(masks.search(docs, bench), want)
    same(masks.search(docs, bench, 3), C.ranked(DOCS, items, 3))
    assert masks.search(none, bench).collect() == [] and masks.search(docs, bench.limit(0)).collect() == []


def test_masks_stop_early():
    """Documents that hold the rare term come first; the others are never evaluated."""
    n = 2000
    has = [[0, 1] if i % 100 == 0 else [1] for i in range(n)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"did": list(range(n)), "n": [10] * n, "at": [np.array(x, np.int32).tobytes() for x in has], "tf": [np.array([1] * len(x), np.int32).tobytes() for x in has]}, schema=pa.schema([("did", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("tf", pa.binary())]))
    evaluated = [0]
    weights = np.array([masks.weight(n, 20), masks.weight(n, n)], np.int64)
    out = list(masks._searched([np.array([0, 1])], weights, n, 10 * n, 10, evaluated)(iter([batch])))
    assert evaluated == [20] and out[0]["did"].to_pylist() == list(range(0, 1000, 100))
