import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.functions.text import plain, runs, tokens
from docquarry.operators import chunking as C
from docquarry.operators import evaluate as E
from docquarry.operators import index as X
from docquarry.operators import retrieve as R
from docquarry.operators import blocks as B
from docquarry.operators import cells as cells_of
from docquarry.operators import search as S
from docquarry.operators import understand as Q
from docquarry.operators import usage as U
from docquarry.plans import retrieval
from docquarry.session import Scratch, spread
from docquarry.sources import tables as T

HITS = "query_id long, point_id long, score double, rank int"


def test_dense_search_is_exact_with_ties(spark):
    rng = np.random.RandomState(0)
    vectors = np.round(rng.randn(300, 8), 1)
    vectors[50] = vectors[10]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "point_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(1000 + i, vectors[i].tolist()) for i in range(7)], "query_id long, embedding array<float>")
    got = {q: [r.point_id for r in sorted((r for r in R.dense_topk(queries, points, 12).collect() if r.query_id == q), key=lambda r: r.rank)] for q in range(1000, 1007)}
    exact = vectors.astype(np.float32).astype(float)
    for q in range(7):
        scores = np.round(exact @ exact[q], 6)
        assert got[1000 + q] == sorted(range(300), key=lambda i: (-scores[i], i))[:12]


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], HITS)
    b = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], HITS)
    one, two = ({r.point_id: round(r.score, 9) for r in R.fuse(*x).collect()} for x in ((a, b), (b, a)))
    assert one == two and one[11] == pytest.approx(1 / 61 + 1 / 62)


def test_boost_does_not_compound(spark):
    hits = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 0.9, 2)], HITS)
    tables = spark.createDataFrame([(11,), (11,)], "point_id long")
    assert [(r.point_id, r.rank) for r in R.boost_tables(hits, tables).orderBy("rank").collect()] == [(11, 1), (10, 2)]


def test_context_keeps_the_first_block(spark):
    hits = spark.createDataFrame([(1, 1, 1.0, 1, "x" * 50), (1, 2, 0.9, 2, "y"), (2, 3, 1.0, 1, "a"), (2, 4, 0.5, 2, "b")], HITS + ", text string")
    got = {r.query_id: r.context for r in R.contexts(hits, "text", 20).collect()}
    assert got == {1: "[1] " + "x" * 50, 2: "[1] a\n---\n[2] b"}


def test_citations_number_without_gaps(spark):
    hits = spark.createDataFrame([(1, 7, 1.0, 1), (1, 7, 0.9, 2), (1, 8, 0.8, 3)], HITS)
    assert [(r.point_id, r.idx) for r in R.citations(hits).orderBy("idx").collect()] == [(7, 1), (8, 2)]


def test_large_vocabularies_find_the_same(spark):
    """Beyond the limit keys are found by a gram; short and long keys, repeated ids and nulls included."""
    r = random.Random(2)
    texts = [(i % 40, "".join(r.choice("abc") for _ in range(r.randint(0, 30)))) for i in range(60)] + [(50, None), (51, ""), (52, "abcabcabc")]
    keys = [("".join(r.choice("abc") for _ in range(n)), n) for n in (1, 2, 3, 4, 5, 6, 7, 9) for _ in range(4)] + [("abcabcabc", 0), (None, 1)]
    frame, words = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(keys, "word string, n int")
    found = [sorted(map(tuple, R.containing(frame, "text", words, "word", "id", rows=rows).collect())) for rows in (1000, 0)]
    assert found[0] == found[1] == sorted((i, t, w, n) for i, t in texts for w, n in keys if t is not None and w is not None and w in t)


def test_many_keys_with_one_opening(spark):
    """Keys meet texts by their rarest gram, so a common opening makes no candidates, and no pair of text and key is tried."""
    keys = spark.range(20_000).selectExpr("concat('company ', lpad(cast(id * 7919 % 1000003 as string), 7, '0')) as name", "id as n")
    texts = spark.range(50).selectExpr("id", "concat('of company ', lpad(cast(id * 7919 % 1000003 as string), 7, '0'), ' and company x') as text")
    found = R.containing(texts, "text", keys, "name", "id")
    assert sorted((r.id, r.n) for r in found.collect()) == [(i, i) for i in range(50)]
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    few = R.containing(texts, "text", keys.filter("n < 5"), "name", "id")
    assert sorted(r.id for r in few.collect()) == list(range(5)) and "NestedLoop" not in few._jdf.queryExecution().toString()


def near(vectors, queries, k, same=False):
    out = {}
    for i, v, g in queries:
        if same and g is None:
            continue
        s = sorted((-round(float(np.dot(v, x)), 6), j) for j, x, h in vectors if j != i and (not same or h == g))[:k]
        out[i] = [(j, -t) for t, j in s]
    return out


@pytest.mark.parametrize("cells", [1, 12])
def test_search_by_cells(spark, tmp_path, monkeypatch, cells):
    """Equal to brute force with and without a filter, whatever the cells; clustered vectors let most blocks be left out; filters reach the folders."""
    monkeypatch.setattr(cells_of, "SIZE", 16)
    r = np.random.RandomState(3)
    centres = r.randn(12, 8) * 4
    rows = [(i, (centres[i % 12] + r.randn(8) * 0.2).tolist(), f"g{i % 3}" if i % 17 else None) for i in range(900)] + [(900, [0.0] * 8, "g0"), (901, None, "g0"), (902, (centres[3]).tolist(), "g'1"), (903, (centres[3]).tolist(), "g'1")]
    frame = spark.createDataFrame(rows, "point_id long, embedding array<double>, kind string")
    asked = [(i, v, g) for i, v, g in rows[:40] + rows[900:] if v is not None]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, kind string")
    held = [x for x in rows if x[1] is not None]
    read = lambda hits: {i: [(h.point_id, round(h.score, 6)) for h in sorted(g, key=lambda h: h.rank)] for i, g in itertools.groupby(sorted(hits.collect(), key=lambda h: h.query_id), key=lambda h: h.query_id)}
    for same in (None, "kind"):
        path = str(tmp_path / f"cells-{same}")
        cells_of.build(frame, path, same, cells)
        counts: dict[str, int] = {}
        hits = cells_of.search(spark, path, queries, 5, same, counts)
        want = {i: x for i, x in near(held, asked, 5, same is not None).items() if x}
        assert read(hits) == want
        assert counts["read"] <= counts["blocks"]
        few: dict[str, int] = {}
        cells_of.search(spark, path, queries.limit(2), 5, same, few)
        assert few["read"] < few["blocks"] / 2 or cells == 1
    monkeypatch.setattr(R, "QUERY_BYTES", 300)
    assert read(cells_of.search(spark, path, queries, 5, "kind")) == want
    plan = spark.read.parquet(path).filter(F.col("same").isin(["of g0"]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "same" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [60 / (i + 1) for i in range(60)]
    return [(i, " ".join(r.choices(words, weights, k=r.randint(3, 40))), f"c{i % 3}") for i in range(300)]


def scores(corpus, query, dim=None):
    terms = [t.split() for _, t, _ in corpus]
    df = Counter(w for t in terms for w in set(t))
    n, mean = len(terms), sum(map(len, terms)) / len(terms)
    raw = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for (i, _, _), t in zip(corpus, terms, strict=True):
        tf = Counter(t)
        s = sum((floor if raw[w] < 0 else raw[w]) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in query.split() if w in tf)
        out[i] = round(s, 6)
    return out


@pytest.mark.parametrize(("size", "first", "group"), [(512, 8, 1 << 20), (16, 1, 1 << 20), (7, 0, 1 << 20), (1, 2, 60)])
def test_lexical_search_is_exact(spark, corpus, tmp_path, monkeypatch, size, first, group):
    """However large blocks are, and however many give the first bounds; also from a saved index, within a group, and with queries taken in turns."""
    monkeypatch.setattr(B, "SIZE", size)
    monkeypatch.setattr(B, "FIRST_BLOCKS", first)
    monkeypatch.setattr(S, "GROUP_BYTES", group)
    index = S.SearchIndex.build(spark.createDataFrame(corpus, "point_id long, text string, company string"), Scratch(spark, "test"), dim=64)
    index.save(str(tmp_path / "index"))
    index = S.SearchIndex.load(spark, str(tmp_path / "index"))
    asked = [(1, "w0 w1 w2 w50 w51", None), (2, "w0", "c1"), (3, "w59 w58 w3 w3", "c2"), (4, "nothing", None), (5, "w1 w0 w2", "c9"), (6, None, None)]
    frame = spark.createDataFrame(asked, "query_id long, text string, same string")
    for same in (None, "company"):
        hits = S.lexical(index, frame, 7, same).collect()
        for q, text, want in asked:
            of = scores(corpus, text or "")
            ok = [i for i, _, c in corpus if of[i] > 0 and (same is None or want is None or c == want)]
            best = sorted(ok, key=lambda i: (-of[i], i))[:7]
            assert [h.point_id for h in sorted((h for h in hits if h.query_id == q), key=lambda h: h.rank)] == best
    even = index.only(index.chunks.filter("point_id % 2 = 0"))
    hits = S.lexical(even, frame.filter("query_id = 1"), 7).orderBy("rank").collect()
    of = scores(corpus, asked[0][1])
    assert [h.point_id for h in hits] == sorted((i for i, _, _ in corpus if i % 2 == 0 and of[i] > 0), key=lambda i: (-of[i], i))[:7]


def test_blocks_leave_postings_out(spark, monkeypatch):
    """Once k points have a rare term, the postings of common terms are only looked up."""
    monkeypatch.setattr(B, "SIZE", 64)
    r = random.Random(1)
    rows = [(i, " ".join(["rare"] * (i % 100 == 0) + r.choices([f"c{j}" for j in range(30)], k=20)), "c") for i in range(3000)]
    index = S.SearchIndex.build(spark.createDataFrame(rows, "point_id long, text string, company string"), Scratch(spark, "test"), dim=8)
    counts: dict[str, int] = {}
    hits = S.lexical(index, spark.createDataFrame([(1, "rare c1 c2 c3")], "query_id long, text string"), 5, counts=counts)
    of = scores(rows, "rare c1 c2 c3")
    assert [h.point_id for h in hits.orderBy("rank").collect()] == sorted(of, key=lambda i: (-of[i], i))[:5]
    assert 0 < counts["read"] < counts["all"] / 3


def test_postings_cross_no_shuffle(spark, corpus, monkeypatch):
    """A search reads blocks where they are; only the best of each task go on."""
    index = S.SearchIndex.build(spark.createDataFrame(corpus, "point_id long, text string, company string"), Scratch(spark, "test"), dim=8)
    plans, save = [], Scratch.save

    def saved(self, name, build, *more):
        plans.append(build._jdf.queryExecution().executedPlan().toString())
        return save(self, name, build, *more)

    monkeypatch.setattr(Scratch, "save", saved)
    asked = spark.createDataFrame([(1, "w0 w50")], "query_id long, text string")
    assert S.lexical(index, asked, 5).count() == 5 and S.vector(index, asked, 5).count() == 5
    reading = [p for p in plans if "tf#" in p or "v_at#" in p]
    assert len(reading) == 2 and not any("Exchange" in p for p in reading)


def test_many_queries_in_slices(spark, corpus, monkeypatch):
    """However many queries are scored at a time, the hits are the same."""
    index = S.SearchIndex.build(spark.createDataFrame(corpus, "point_id long, text string, company string"), Scratch(spark, "test"), dim=64)
    asked = spark.createDataFrame([(i, t) for i, t, _ in corpus[:40]], "query_id long, text string")
    found = []
    for n in (1024, 7):
        monkeypatch.setattr(B, "QUERIES", n)
        found.append([sorted((h.query_id, h.rank, h.point_id, round(h.score, 6)) for h in f(index, asked, 6).collect()) for f in (S.lexical, S.vector)])
    assert found[0] == found[1] and all(len(x) == 240 for x in found[0])


def test_common_terms_are_scored_by_products(spark, corpus, monkeypatch):
    """What many queries have is scored as matrices, to the same hits, and reads what they would read one by one."""
    index = S.SearchIndex.build(spark.createDataFrame(corpus, "point_id long, text string, company string"), Scratch(spark, "test"), dim=64)
    asked = spark.createDataFrame([(i, t) for i, t, _ in corpus[:40]], "query_id long, text string")
    found, repeat = [], B._flat
    for dense in (0, B.DENSE, 1 << 30):
        monkeypatch.setattr(B, "DENSE", dense)
        found.append([sorted((h.query_id, h.rank, h.point_id, round(h.score, 6)) for h in f(index, asked, 6).collect()) for f in (S.lexical, S.vector)])
    assert found[0] == found[1] == found[2]
    rows, texts = index.postings.toArrow().to_pylist(), {i: t.split() for i, t, _ in corpus[:40]}
    queries = B.Queries(list(texts), [dict.fromkeys(range(60), 1.0) for _ in texts], [None] * len(texts), 6, [f"w{i}" for i in range(60)])
    sizes: list[int] = []
    monkeypatch.setattr(B, "DENSE", 128)
    monkeypatch.setattr(B, "_flat", lambda starts, n: sizes.append(int(n.sum())) or repeat(starts, n))
    for row in rows:
        held, counts = B.Lexical(row, queries, pa.array(queries.names)), [0, 0]
        B.search_block(held, len(row["points"]), queries.slices[0], queries.bounds, counts)
        assert counts[0] == counts[1] and max(sizes) < counts[1] / 4
        sizes.clear()


def test_words_are_hashed_once(monkeypatch):
    """Buckets are those of functions.text.bucket, also when a word comes again, and when the words held are let go."""
    md5, hashed = B.hashlib.md5, []
    monkeypatch.setattr(B.hashlib, "md5", lambda w: hashed.append(w) or md5(w))
    of = lambda w: int(md5(w.encode()).hexdigest()[:8], 16) % 1000
    buckets = B._Buckets(1000)
    for words in (["a", "b", "é"], [], ["b", "中", "a"], ["中", "d"]):
        assert buckets(pa.array(words, pa.string())).tolist() == [of(w) for w in words]
    assert len(hashed) == 5
    monkeypatch.setattr(B, "KNOWN", 2)
    assert buckets(pa.array(["d", "x"])).tolist() == [of("d"), of("x")] and len(buckets.names) == 2


def test_tokens_with_han_or_figures(spark):
    texts = ["a 1,234.5 b", "12% up", "x5中", "中5", "ab 3 , 4", "é1,", "2024年"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["a", "1234.5", "b"], ["12", "%", "up"], ["x5", "中"], ["中", "5"], ["ab", "3", "4"], ["é1"], ["2024年", "2024"]]


def test_a_save_that_breaks_off_changes_nothing(spark, corpus, tmp_path, monkeypatch):
    frame = spark.createDataFrame(corpus, "point_id long, text string, company string")
    one, two = (S.SearchIndex.build(f, Scratch(spark, "test"), dim=8) for f in (frame, frame.filter("point_id < 50")))
    one.save(str(tmp_path / "index"))
    before = S.SearchIndex.load(spark, str(tmp_path / "index"))
    monkeypatch.setattr(two, "vectors", None)
    with pytest.raises(AttributeError):
        two.save(str(tmp_path / "index"))
    assert S.SearchIndex.load(spark, str(tmp_path / "index")).chunks.count() == 300
    S.SearchIndex.build(frame.filter("point_id < 50"), Scratch(spark, "test"), dim=8).save(str(tmp_path / "index"))
    assert S.SearchIndex.load(spark, str(tmp_path / "index")).chunks.count() == 50 and S.SearchIndex.load(spark, str(tmp_path / "index"), 1).totals == before.totals
    assert before.chunks.count() == 300


def test_lexical_search_of_a_tiny_corpus(spark):
    """Where all words are common, weights are negative and nothing is found."""
    docs = [(i, "a b c" + " d" * (i == 0), "c0") for i in range(5)]
    index = S.SearchIndex.build(spark.createDataFrame(docs, "point_id long, text string, company string"), Scratch(spark, "test"), dim=8)
    hits = S.lexical(index, spark.createDataFrame([(1, "a d"), (2, "a b")], "query_id long, text string"), 3).collect()
    want = {(q, p) for q, t in ((1, "a d"), (2, "a b")) for p, s in scores(docs, t).items() if s > 0}
    assert {(h.query_id, h.point_id) for h in hits} == want


def test_hybrid_search(spark, corpus):
    index = S.SearchIndex.build(spark.createDataFrame(corpus, "point_id long, text string, company string").withColumn("doc_id", F.col("point_id") % 100), Scratch(spark, "test"), dim=64)
    queries = spark.createDataFrame([(1, corpus[7][1]), (2, corpus[20][1])], "query_id long, text string")
    synonyms = spark.createDataFrame([("w1 ", 1, "w40 ")], "term string, prio int, synonym string")
    tables = index.chunks.filter("point_id % 5 = 0").select("point_id")
    parents = index.chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    rows = S.hybrid(index, queries, synonyms, tables, F.col("query_id") == 1, parents=parents, scorer=lambda q, t: [float(a == b) for a, b in zip(q, t, strict=True)], k=3).collect()
    assert {(r.query_id, r.point_id) for r in rows if r.rank == 1} == {(1, 7), (2, 20)} and {r.chunks for r in rows} == {3} and max(r.rank for r in rows) == 3
    vec = S.candidates(index, queries, synonyms, tables, F.col("query_id") == 1)[0]
    plain = S.candidates(index, queries, synonyms)[0]
    assert max(r.score for r in vec.filter("query_id = 1").collect()) >= max(r.score for r in plain.filter("query_id = 1").collect())
    subs = spark.createDataFrame([(1, "a", corpus[3][1], "c0"), (1, "b", corpus[4][1], "c1"), (2, "a", corpus[5][1], None)], "query_id long, entity string, text string, same string")
    found = S.fan_out(index, subs, total=6).collect()
    assert {r.company for r in found if r.query_id == 1} == {"c0", "c1"} and max(r.rank for r in found) == 6


def test_tables_are_searched_and_boosted(spark, corpus):
    """For queries that ask for a figure, chunks with a table are searched alone too and count more in both lists, once; other queries keep their lists."""
    index = S.SearchIndex.build(spark.createDataFrame(corpus, "point_id long, text string, company string"), Scratch(spark, "test"), dim=64)
    asked = {1: "w0 w1 w50", 2: "w0 w1 w50", 3: "w7 w8"}
    questions = {1: "w0 w1 w50 表格 w50 w1 数据", 3: "w7 w8 表格 财务 务指 指标 数据"}
    queries = spark.createDataFrame([*asked.items(), (4, None)], "query_id long, text string")
    held = [i for i, _, _ in corpus if i % 20 == 0]
    tables = spark.createDataFrame([(i,) for i in held * 2], "point_id long")
    vec, lex = S.boost_tables(index, queries, S.vector(index, queries, 6), S.lexical(index, queries, 9), tables, F.col("query_id").isin(1, 3, 4), ["w50", "w1"], vector_k=6)

    def hashed(text):
        v = np.zeros(64)
        for w in text.split():
            v[int(B.hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        return v / np.linalg.norm(v)

    def best(of, k):
        return sorted(((i, round(s, 6)) for i, s in of.items() if s > 0), key=lambda x: (-x[1], x[0]))[:k]

    read = lambda hits, q: [(h.point_id, round(h.score, 6)) for h in sorted(hits.filter(F.col("query_id") == q).collect(), key=lambda h: h.rank)]
    vectors = {i: hashed(t) for i, t, _ in corpus}
    new = 0
    for q, text in asked.items():
        plain = dict(best({i: float(v @ hashed(text)) for i, v in vectors.items()}, 6))
        alone = dict(best({i: float(vectors[i] @ hashed(questions[q])) for i in held}, 6)) if q in questions else {}
        want = best({i: max(plain.get(i, 0), 1.5 * alone.get(i, 0)) for i in plain | alone}, 6)
        got = read(vec, q)
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
        new += len({i for i, _ in got} - set(plain))
        words = dict(best(scores(corpus, text), 9))
        want = best({i: s * 1.5 if q in questions and i in held else s for i, s in words.items()}, 9)
        got = read(lex, q)
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
    assert new > 0 and read(vec, 4) == read(lex, 4) == []


def test_questions_for_a_table(spark):
    """A figure, a word that asks for one or the pattern will do alone; the question names the first three figures of the vocabulary that it has."""
    texts = ["净利润和毛利率和存货", "见下表", "what is ROE", "hello", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = frame.select(Q.asks_for_figure(F.col("t")).alias("asks"), S.table_question(F.col("t"), Q.FIGURES).alias("q")).collect()
    assert [r.asks for r in rows] == [True, True, True, False, None]
    assert [r.q for r in rows] == ["净利润和毛利率和存货 表格 净利润 毛利 毛利率 数据", "见下表 表格 财务指标 数据", "what is ROE 表格 ROE 数据", "hello 表格 财务指标 数据", None]
    frame = spark.createDataFrame([(0, "the sum"), (1, "this and that"), (2, "x5"), (3, "so")], "i int, t string")
    assert [r[0] for r in frame.select(Q.asks_for_figure(F.col("t"), ["the"], ["and "], "x[0-9]")).collect()] == [True, True, True, False]


def test_viewpoints_and_document_search(spark):
    rows = spark.createDataFrame([(1, 2, "later", None, None, None), (1, 1, "growth", "b", "negative", "falls"), (1, 1, "growth", "a", "odd", "rises")], "query_id long, theme_no int, theme string, source string, stance string, view string")
    assert R.viewpoints(rows, {"positive": "+", "negative": "-"}).first().body == "## growth\n- [a] rises\n- -[b] falls\n## later"
    docs = spark.createDataFrame([(1, "Annual", "X"), (2, "other", "annual x"), (3, "none", None)], "doc_id long, title string, company string")
    opened = spark.createDataFrame([(2, 5)], "doc_id long, opened long")
    assert [r.doc_id for r in R.find_documents(docs, "ANNUAL", "title", "company", opened=opened).collect()] == [2, 1]


def test_query_router(spark):
    rows = spark.createDataFrame([(1, "对比甲和乙", ["a", "b"]), (2, "甲的增长率", []), (3, "甲 乙", ["a", "b"]), (4, "市场观点", []), (5, "总结年报", []), (6, "收入是多少", []), (7, "hello", []), (8, None, [])], "query_id long, text string, entities array<string>")
    got = [(r.intent, r.confidence) for r in Q.routes(rows).orderBy("query_id").collect()]
    assert [i for i, _ in got] == ["comparative", "computational", "multi_entity", "theme", "summarization", "factual", "none", "none"] and got[0][1] == 0.8 and got[7][1] is None
    hits = spark.createDataFrame([(1, 7, 1.0, 1, "甲", "2023"), (1, 8, 0.9, 2, "乙", "2023")], HITS + ", company string, year string")
    slots = spark.createDataFrame([(1, "甲", None)], "query_id long, company string, year string")
    assert [r.point_id for r in Q.filtered_by_slots(hits, slots, company="company", year="year").collect()] == [7]
    assert Q.filtered_by_slots(hits, slots, year="year").count() == 2


def test_strip_entities(spark):
    rows = spark.createDataFrame([(1, "比较 甲公司 和 乙公司 的收入", ["甲公司", "乙公司"]), (2, "甲公司 乙公司", ["甲公司", "乙公司"])], "query_id long, text string, entities array<string>")
    got = {(r.query_id, r.entity): r.text for r in Q.strip_entities(rows, ["比较", "和"]).collect()}
    assert got[1, "甲公司"] == "甲公司 的收入" and got[2, "乙公司"] == "乙公司 甲公司 乙公司"


def test_models_run_in_batches(spark):
    def encoder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = X.embed(spark.createDataFrame([(1, "abc"), (2, None)], "id long, text string"), "text", encoder).orderBy("id").collect()
    assert rows[0].embedding == pytest.approx([3 / 10**0.5, 1 / 10**0.5], rel=1e-6) and rows[1].embedding == [0.0, 1.0]
    hits = spark.createDataFrame([(1, 1, 1.0, 1, "q", "aa"), (1, 2, 0.5, 2, "q", "aaaa")], HITS + ", query string, text string")
    assert R.rerank(hits, lambda q, t: [float(len(x)) for x in t], 1).first().point_id == 2
    judged = E.judge(spark.createDataFrame([(1, "x")], "id long, answer string"), lambda items: ['```{"retrieval": 9, "grounding": 2.4}```' for _ in items])
    assert tuple(judged.select(*E.parsed_scores(F.col("reply"))).first()) == (5, 2, 1, 1)


@pytest.mark.parametrize(("reply", "want"), [('{"retrieval":1,"grounding":2,"answer_relevance":3,"financial_accuracy":4}', (1, 2, 3, 4)), ("garbage", (1, 1, 1, 1)), (None, (1, 1, 1, 1)), ('{"retrieval": -3}', (1, 1, 1, 1))])
def test_judge_replies(spark, reply, want):
    assert tuple(spark.createDataFrame([(reply,)], "r string").select(*E.parsed_scores(F.col("r"))).first()) == want


def test_parser_errors_stay_in_their_row(spark):
    def parse(path, content):
        return content.decode("utf-8").upper()

    rows = T.parse_documents(spark.createDataFrame([("a", bytearray(b"ok")), ("b", bytearray(b"\xff"))], "path string, content binary"), parse).orderBy("path").collect()
    assert [(r.text, r.status) for r in rows] == [("OK", "success"), (None, "error")] and "UnicodeDecodeError" in rows[1].error


def test_scan_and_collections(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("a.md", "x\n\ny"), ("b.txt", "  "), ("c.txt", "z")):
        (tmp_path / "in" / name).write_text(text)
    rows = T.scan_corpus(spark, str(tmp_path / "in")).collect()
    assert sorted((r.text, r.page_count) for r in rows) == [("x\n\ny", 2), ("z", 1)]
    (tmp_path / "meta.json").write_text('{"info_code":"A1","stock":"S"}\n{"info_code":"","stock":"T"}\n{"stock":"U"}\n')
    assert [r.stock for r in T.scan_report_metadata(spark, str(tmp_path / "meta.json")).collect()] == ["S"]
    points = T.split_collection(spark.createDataFrame([(1, "a")], "point_id long, text string"), "pro", "safe")
    path = str(tmp_path / "points")
    assert T.ensure_collection(spark, path, points, "pro") == 0
    assert T.save_collection(points, path) == 2 and T.save_collection(points, path) == 4
    assert T.save_collection(points.filter("collection = 'pro'"), path, "overwrite") == 3
    assert T.ensure_collection(spark, path, points, "safe") == 2 and T.ensure_collection(spark, path, points, "safe", recreate=True) == 0
    assert T.scroll(spark.read.parquet(path), collection="pro").count() == 1 and T.scroll(spark.read.parquet(path), collection="safe").count() == 0
    reports = str(tmp_path / "reports")
    for _ in range(2):
        T.save_reports(reports, means=points, rows=points.limit(1))
    assert spark.read.json(f"{reports}/means").count() == 2 and spark.read.json(f"{reports}/rows").count() == 1


def test_state_is_appended(spark, tmp_path):
    path = str(tmp_path / "state")
    for version, rows in enumerate([[("a", "x", False), ("b", "y", False)], [("a", "z", False)], [("b", None, True)]]):
        T.append_state(spark.createDataFrame(rows, "key string, value string, gone boolean").withColumn("version", F.lit(version)), path)
    assert sorted(map(tuple, T.current_state(spark, path, "key", "version").select("key", "value").collect())) == [("a", "z"), ("b", None)]
    assert [r.key for r in T.current_state(spark, path, "key", "version", deleted="gone").collect()] == ["a"]


def test_points_of_outlines_and_summaries(spark):
    points = spark.createDataFrame([(1, "old")], "point_id long, text string")
    outlines = spark.createDataFrame([("d", 1, "s", "short", "long text"), ("d", 2, "s", "short", "more")], "doc_id string, section_order int, section string, outline_text string, text string")
    once = X.outline_points(points, outlines)
    assert once.count() == 3 and once.filter("chunk_type = 'outline' and not is_parent and importance = 1.3").count() == 2
    changed = outlines.withColumn("text", F.lit("new"))
    assert X.outline_points(once, changed).filter("text = 'new'").count() == 0
    assert X.outline_points(once, changed, force=True).filter("text = 'new'").count() == 2 and X.outline_points(once, changed, force=True).count() == 3
    rows = X.summary_points(spark.createDataFrame([("one.md", "body")], "name string, body string")).collect()
    assert {(r.is_parent, r.text) for r in rows} == {(True, "body"), (False, "body")} and next(r for r in rows if not r.is_parent).parent_id == next(r for r in rows if r.is_parent).point_id
    docs = spark.createDataFrame([("d", "word " * 400)], "doc_id string, text string")
    above, below = C.chunk_corpus(docs, "doc_id")
    held = X.document_points(above, below, spark.createDataFrame([("d", "Acme", "2023")], "doc_id string, company string, year string"), "pro", text_chars=None)
    assert held.filter("company <> 'Acme'").count() == 0 and held.select("point_id").distinct().count() == held.count()
    assert held.filter("not is_parent").join(held.filter("is_parent").select(F.col("point_id").alias("parent_id")), "parent_id", "left_anti").count() == 0


def test_cache_hits_do_not_renew(spark):
    rows = spark.createDataFrame([("k", "a", t) for t in (0, 50, 110, 150, 300)], "key string, layer string, s long").withColumn("ts", F.timestamp_seconds("s"))
    row = U.cache_hits(rows, 100, "key").first()
    assert (row.requests, row.hits) == (5, 2)


def test_budget_without_limit(spark):
    calls = spark.createDataFrame([(1, 1, 9.0, "2024-01-01 00:00:00")], "call_id long, session_id long, cost double, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert U.budget_actions(calls, 0, 0).first().action == "ok" and U.budget_actions(calls, 9, 0).first().action == "reject"
    defaults = spark.createDataFrame([("day", 50.0), ("session", 5.0)], "name string, value double")
    assert {r.name: r.value for r in U.with_overrides(defaults, defaults.filter("name = 'day'").withColumn("value", F.lit(9.0))).collect()} == {"day": 9.0, "session": 5.0}


def test_plain_texts_have_the_terms_that_tokens_cuts(spark):
    """Runs of letters and digits, cut many texts at a time, are what the expression cuts; every other text is left to it."""
    texts = [f"A{chr(c)}b1{chr(c)}2 {chr(c)}9 Çé{chr(c)}" for c in range(0x2100)] + [None, "", " ", "x", "12", "2.5", "1,000", "7%", "3. x", "a,b 1 ,2", "营收 12", "É" * 3, "ß1", "İx", "“q”—r…", "5€", "x²", "½"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", plain(F.col("text")).alias("plain"), tokens(F.col("text")).alias("tokens")).orderBy("id").collect()
    cut, n = runs(pa.array([r["plain"] for r in rows], pa.string()))
    ends = np.cumsum(n)
    assert len(cut) == ends[-1]
    for r, end, k in zip(rows, ends, n, strict=True):
        if r["plain"] is None:
            assert k == 0
        else:
            assert cut.slice(end - k, k).to_pylist() == r["tokens"], texts[r["id"]]
    left = {t for t, r in zip(texts, rows, strict=True) if r["plain"] is None}
    assert {"2.5", "1,000", "7%", "营收 12", "x²", "½"} <= left and not left & {None, "", "x", "12", "3. x", "a,b 1 ,2", "ß1", "İx", "“q”—r…", "5€"}
    some = pa.array(["skipped", "é b", None, "c1"], pa.string()).slice(1)
    assert runs(some)[0].to_pylist() == ["é", "b", "c1"] and runs(some)[1].tolist() == [2, 0, 1]


def test_blocks_of_plain_and_other_texts_hold_all_terms(spark):
    """One index of texts that are cut in bulk and of texts that are not: each is found by each of its terms, with the counts of plain postings."""
    texts = {1: "alpha beta beta", 2: "营收 12.5% beta", 3: None, 4: "", 5: "Ünder 1,000 alpha", 6: "gamma. alpha,beta", 7: "营收"}
    index = S.SearchIndex.build(spark.createDataFrame(list(texts.items()), "point_id long, text string"), Scratch(spark, "test"), dim=8, idf="plus_one")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "营收"), (4, "12.5"), (5, "1000"), (6, "gamma ünder")], "query_id long, text string")
    found = {(r["query_id"], r["point_id"]) for r in S.lexical(index, asked).collect()}
    assert found == {(1, 1), (1, 5), (1, 6), (2, 1), (2, 2), (2, 6), (3, 2), (3, 7), (4, 2), (5, 5), (6, 5), (6, 6)}
    assert index.totals[:2] == (7, 5)
    df = {r["term"]: r["df"] for r in index.terms.collect()}
    assert df["beta"] == 3 and df["alpha"] == 3 and df["1000"] == 1 and df["%"] == 1


def test_counts_of_texts_are_those_of_their_blocks(spark):
    """Texts that leave an index, plain or not, take from its statistics just what they would bring as blocks; they are cut in one pass."""
    r = random.Random(3)
    texts = [" ".join(r.choices(["a", "b", "Ça", "2.5", "营收", "x1", "7%", "1,000"], k=r.randrange(6))) for _ in range(300)] + [None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "point_id long, text string")
    df, totals = B.text_counts(frame, "text", Scratch(spark, "test"), "counts")
    index = S.SearchIndex.build(frame, Scratch(spark, "test"), dim=8, idf="plus_one")
    assert totals == index.totals and sorted(map(tuple, df.collect())) == sorted(map(tuple, index.terms.select("term", "df").collect()))
    plan = df._jdf.queryExecution().toString()
    assert "regexp" not in plan  # what was cut is read, not cut again
    none, totals = B.text_counts(frame.limit(0), "text", Scratch(spark, "test"), "counts")
    assert none.count() == 0 and totals == (0, 0, 0)


def test_documents_of_one_row_group_are_dealt_out(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").crossJoin(spark.range(5)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    dealt = spread(docs)
    assert dealt.groupBy(F.spark_partition_id()).count().count() == spark.sparkContext.defaultParallelism * 2 + 2 == 10
    assert Counter(map(tuple, dealt.collect())) == Counter(map(tuple, docs.collect()))
    even = dealt.localCheckpoint()
    assert spread(even) is even and spread(docs.limit(0)).count() == 0


def test_vocabulary_is_made_once(spark, sf_dir):
    one, two = retrieval.vocabulary(spark, sf_dir), retrieval.vocabulary(spark, sf_dir)
    assert one.inputFiles() == two.inputFiles() and not any("documents.parquet" in f for f in one.inputFiles())
    assert one.count() == 100
