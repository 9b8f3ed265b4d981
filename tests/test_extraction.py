import pytest
from pyspark.sql import functions as F

from docquarry.operators import finance as D
from docquarry.operators import metadata as M
from docquarry.operators import verify as V


def test_years_by_pattern(spark):
    cases = [("某公司2023年年度报告", "", "2023"), ("x", "报告期为 2022 止，发布于2024年", "2022"), ("x_2021_y", "", "2021"), ("AP202405011234", "", "2024"), ("2020 note", "2023年半年度", "2023"), ("none", "", M.UNKNOWN)]
    rows = spark.createDataFrame(cases, "name string, head string, want string").select("want", M.year_of(F.col("name"), F.col("head")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_company_fallbacks(spark):
    cases = [("平安银行2023年报", "", "平安银行"), ("x1", "股票简称：万科A", "万科A"), ("1", "本报告由中国石油股份有限公司发布", "中国石油股份有限公司"), ("Acme-report", "", "Acme"), ("1", "", M.UNKNOWN)]
    rows = spark.createDataFrame(cases, "name string, head string, want string").select("want", M.company_of(F.col("name"), F.col("head")).alias("got")).collect()
    assert rows[0].got == rows[0].want and rows[1].got == rows[1].want and rows[2].got.endswith("有限公司") and rows[3].got == "Acme" and rows[4].got == M.UNKNOWN


def test_longest_keyword_wins(spark):
    docs = spark.createDataFrame([(1, "公司半年度报告"), (2, "年度报告"), (3, "nothing")], "doc_id long, text string")
    words = spark.createDataFrame([("annual", 1, "年度报告"), ("half_year", 2, "半年度报告")], "doc_type string, prio int, keyword string")
    assert {r.doc_id: r.doc_type for r in M.document_type(docs, "text", words).collect()} == {1: "half_year", 2: "annual", 3: "other"}


def test_aliases(spark):
    names = spark.createDataFrame([("中国平安集团",), ("中国平安股份",), ("短",)], "name string")
    assert {r.alias: r.canonical for r in M.derive_aliases(names).collect()} == {"中国平安": "中国平安股份"}


@pytest.mark.parametrize(("text", "value", "unit"), [("营业收入：405.29亿元", 405.29e8, "元"), ("净利润为-1,234.5万元", -1234.5e4, "元"), ("毛利率：12.5%", 12.5, "%"), ("每股收益: 0.35元/股", 0.35, "元/股"), ("总资产：1.2万亿元", 1.2e12, "元"), ("总资产：77", 77.0, "")])
def test_metrics(spark, text, value, unit):
    row = D.extract_metrics(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").first()
    assert row.value == pytest.approx(value) and row.unit == unit and row.confidence == "high"


def test_loose_metrics_only_where_few_are_strict(spark):
    rows = D.extract_metrics(spark.createDataFrame([(1, "净利润在本年度达到约 5 亿元\n净利润：5亿元")], "id long, text string"), "id", "text").collect()
    assert [(r.value, r.confidence) for r in rows] == [(5e8, "high")]


def test_tables(spark):
    table = "| 项目 | 2023 | 2022 |\n|---|---|---|\n" + "\n".join(f"| r{i} | {i} | {i + 1} |" for i in range(20))
    frame = spark.createDataFrame([(table, "no table here\nat all"), ("| a | b |\n| x | 1 |", "收入  100  90\n成本  80  70")], "t string, u string")
    rows = frame.select(D.table_summary(F.col("t")).alias("s"), D.table_sentence(F.col("t"), F.lit("利润表"), F.lit("甲"), F.lit("2023")).alias("k"), D.has_table(F.col("t")).alias("h"), D.has_table(F.col("u")).alias("n")).collect()
    assert rows[0].s.startswith("项目、2023、2022；r0: 0，r1: 1") and rows[0].s.endswith("…共20行")
    assert rows[0].k.startswith("甲 2023 利润表：r0 2023: 0,2022: 1；") and rows[0].k.endswith("；共20行")
    assert rows[1].k == "甲 2023 利润表：x b: 1"
    assert [(r.h, r.n) for r in rows] == [(True, False), (True, True)]


def test_cited_pairs(spark):
    cases = [(1, "收入为100亿元[来源1]。"), (2, "收入为100亿元，利润5亿元[来源1][来源2]。"), (3, "收入100亿元和利润5亿元都比上年有了很大的显著提高而且仍在继续增长之中[来源1]。"), (4, "2023年没有数字[来源1]。")]
    rows = V.cited_pairs(spark.createDataFrame(cases, "query_id long, answer string")).collect()
    got = {q: sorted((r.value, r.idx) for r in rows if r.query_id == q) for q in (1, 2, 3, 4)}
    assert got == {1: [(100.0, 1)], 2: [(5.0, 2), (100.0, 1)], 3: [(5.0, 1), (100.0, 1)], 4: []}


def test_verification_needs_whole_numbers(spark):
    pairs = spark.createDataFrame([(1, 5.0, "", 1), (1, 15.0, "", 1), (1, 1.5, "亿元", 2), (1, 3.0, "%", 9)], "query_id long, value double, unit string, idx int")
    sources = spark.createDataFrame([(1, 1, "共 15 家"), (1, 2, "收入 １５，０００ 万元")], "query_id long, idx int, text string")
    assert {(r.value, r.passed) for r in V.verify(pairs, sources).collect()} == {(5.0, False), (15.0, True), (1.5, True), (3.0, False)}


def test_footer(spark):
    issues = spark.createDataFrame([(1, i, f"i{i}") for i in range(5)], "query_id long, place int, text string")
    assert V.footer(issues, "text").first().footer == "i0；i1；i2…另有2项"


def test_metadata_record(spark):
    docs = [(1, "中信证券_x_H3_AP20_2023年报.md", "# 关于报告\n正文"), (2, "Acme_2022半年度报告.md", "intro\nmore"), (3, None, None), (4, "中信_note.md", "\n\n  First line\nx")]
    frame = spark.createDataFrame(docs, "doc_id long, name string, text string")
    codes = spark.createDataFrame([("H3_AP20", "平安银行"), ("H3", "later")], "info_code string, stock string").orderBy("info_code")
    words = spark.createDataFrame([("annual", 1, "年报"), ("half_year", 2, "半年度报告")], "doc_type string, prio int, keyword string")
    brokers = spark.createDataFrame([("中信",), ("中信证券",)], "broker string")
    aliases = spark.createDataFrame([("Acme", "Acme Holding")], "alias string, canonical string")
    rows = {r.doc_id: r for r in M.extract_metadata(frame, "name", "text", codes, words, brokers, aliases).collect()}
    assert tuple(rows[1])[3:] == ("later", "2023", "annual", "中信证券", "关于报告", 0.7)
    assert tuple(rows[2])[3:] == ("Acme Holding", "2022", "half_year", "", "intro", 0.8)
    assert tuple(rows[3])[3:] == (M.UNKNOWN, M.UNKNOWN, M.UNKNOWN, "", "", 1.0) and rows[4].broker == "中信" and rows[4].title == "First line"
    bare = M.extract_metadata(frame, "name", "text").filter("doc_id = 2").first()
    assert (bare.company, bare.doc_type, bare.broker) == ("Acme", M.UNKNOWN, "")
    rows = M.profile(frame.withColumn("text", F.rpad("text", 6000, "。")), "text", 5000, "name", words).collect()
    assert {(r.doc_id, r.doc_type) for r in rows} == {(1, "annual"), (2, "half_year"), (4, "other")}


def test_routes_and_contents(spark):
    route = M.summary_route(F.col("n"), ["跳过"], [("研报", "research"), ("评级", "rating"), ("年报", "annual")])
    rows = spark.createDataFrame([("研报和年报",), ("某年报",), ("跳过年报",), ("x",)], "n string").select(route.alias("r")).collect()
    assert [r.r for r in rows] == ["research", "annual", None, "general"]
    text = "第一章 概况\nplain\n1.2 细分 " + "x" * 100 + "\n第三节 风险"
    rows = M.contents_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text").orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [0, 2, 3] and len(rows[1].line) == 80


def test_statements_of_chunks(spark):
    parents = [("p1", "3、合并利润表\n营业收入 100", "主要", "甲", "2023"), ("p2", "no finance", "", "甲", "2023"), ("p3", "| 项目 | 金额 |\n| 净利润 | 5 |", "表", "甲", "2023")]
    children = [("c1", "p1", "营业成本 和 销售费用", "主要", "甲", "2023"), ("c2", "p1", "nothing of it", "主要", "甲", "2023"), ("c3", "p2", "毛利率 20%", "", "甲", "2023"), ("c4", "p2", None, "", "甲", "2023")]
    kind = "section string, company string, year string"
    above, below = D.with_encoding(spark.createDataFrame(parents, f"id string, text string, {kind}"), spark.createDataFrame(children, f"id string, parent_id string, text string, {kind}"))
    a, b = ({r.id: r for r in x.collect()} for x in (above, below))
    assert a["p1"].statement_type == "合并利润表" and a["p1"].encoding_text == "[公司=甲][章节=主要][年份=2023][报表=合并利润表]3、合并利润表\n营业收入 100" and a["p1"].prefix_title == a["p1"].encoding_text[:80]
    assert a["p2"].encoding_text == "no finance" and a["p2"].prefix_title == "" and a["p3"].encoding_text == "甲 2023 利润表：净利润 金额: 5"
    assert b["c1"].statement_type == "合并利润表" and b["c1"].financial_keywords == ["营业成本", "销售费用"] and b["c3"].statement_type == "财务指标"
    assert b["c2"].encoding_text == "nothing of it" and b["c4"].encoding_text == ""


def test_places_in_answers(spark):
    text = "收入 1,200.5万元[来源12]，增长5%[来源3]"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "[来源1]")], "query_id long, answer string")
    assert [(r.raw, text[r.start : r.start + len(r.raw)]) for r in V.figures(frame).orderBy("place").collect()] == [("1,200.5万元", "1,200.5万元"), ("5%", "5%")]
    assert [(r.query_id, r.idx) for r in V.source_tags(frame).orderBy("query_id", "place").collect()] == [(1, 12), (1, 3), (3, 1)]
    assert all(text[r.start : r.end] == f"[来源{r.idx}]" for r in V.source_tags(frame).filter("query_id = 1").collect())


def test_entities_of_repeated_names(spark):
    """Copies of names and texts meet once; a query asked with two texts takes the best of both."""
    names = [(f"Firm {i % 30:03d}", f"{i % 30:03d}") for i in range(300)] + [(None, "no"), ("Other", None)]
    asked = [(i, f"Firm {i % 30:03d}") for i in range(60)] + [(100, "Firm 00"), (101, "of 007 and 008"), (102, None), (103, "x"), (101, "Firm 02")]
    frame = spark.createDataFrame(names, "name string, alias string"), spark.createDataFrame(asked, "query_id long, text string")
    found = M.entity_search(frame[1], frame[0])
    want = set()
    for q in {q for q, _ in asked}:
        tiers = {}
        for text in (t for i, t in asked if i == q and t and len(t) >= 2):
            for name, alias in set(names):
                if name and (name in text or text in name) or alias and alias in text:
                    tier = 1 if text == name else 2 if alias and alias in text else 3
                    tiers[name] = min(tier, tiers.get(name, 9))
        want |= {(q, n, t, i + 1) for i, (n, t) in enumerate(sorted(tiers.items(), key=lambda x: (x[1], -len(x[0] or ""), x[0] or ""))[:5])}
    assert {(r.query_id, r.name, r.tier, r.place) for r in found.collect()} == want


def test_large_vocabularies_are_never_broadcast(spark, monkeypatch):
    """However small their files look: like names compress to next to nothing, and a broadcast of them took the driver's memory."""
    from docquarry.operators import retrieve as R
    from docquarry.session import Scratch

    plans, save = [], Scratch.save

    def saved(self, name, build, *more):
        plans.append(build._jdf.queryExecution().optimizedPlan().toString())
        return save(self, name, build, *more)

    monkeypatch.setattr(Scratch, "save", saved)
    monkeypatch.setattr(R, "BROADCAST_CHARS", 0)
    keys = spark.range(2000).selectExpr("concat('company ', lpad(cast(id as string), 9, '0')) as name", "id as n")
    found = R.containing(keys.select("n", F.concat("name", F.lit(" x")).alias("text")), "text", keys.select("name", F.col("n").alias("m")), "name", "n")
    assert found.count() == 2000 and "strategy=merge" in plans[0]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
