import re

from pyspark.sql import functions as F

from docquarry.functions.text import half_width, point_id, safe_id, tokens, words
from docquarry.operators.search import SearchIndex, lexical
from docquarry.operators.segment import segmenter
from docquarry.session import Scratch
from docquarry.operators import chunking as C
from docquarry.plans import registry

REPORT = "\n".join(
    ["一、公司概况", "公司在年内保持增长。" * 5, "", "3、合并利润表", "项目 2023年 2022年", "", "2、收入合计 100 90", "", "二、重要事项", "其他内容。", "", "| 项目 | 金额 |", "| 收入 | 405.29 |", "", "尾段"]
)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_short_lines_join_until_long_enough(spark):
    assert one(spark, "half\na line\n| t | u |\n1. first\n- item\n" + "x" * 50 + "\nend", C.merge_short_lines) == "half a line\n| t | u |\n1. first\n- item\n" + "x" * 50 + "\nend"
    assert one(spark, "", C.merge_short_lines) == "" and one(spark, None, C.merge_short_lines) == ""


def test_label_moves_to_its_table(spark):
    assert one(spark, "表1 收入\nstray\n| a |", C.keep_table_labels) == "stray\n表1 收入\n| a |"
    assert one(spark, "表1 收入\n| a |", C.keep_table_labels) == "表1 收入\n| a |"


def test_noise_lines_go(spark):
    assert one(spark, "a\n第 3 页 共 9 页\nPage 4\n12\n<!-- image -->\nb", C.clean_lines) == "a\nb"
    assert one(spark, "a\n\n\n\n\n\nb", C.collapse_blank) == "a\n\n\nb"


def test_statement_block_is_one_paragraph(spark):
    rows = C.paragraphs(spark.createDataFrame([(1, REPORT)], "doc_id long, text string"), "text").orderBy("para").collect()
    texts = [r.paragraph for r in rows]
    assert texts[0] == "一、公司概况"
    block = next(t for t in texts if t.startswith("3、合并利润表"))
    assert "2、收入合计 100 90" in block and "二、重要事项" not in block
    assert "| 项目 | 金额 |\n| 收入 | 405.29 |" in texts and texts[-1] == "尾段"


def test_parents_lose_no_text(spark):
    pieces = ["a" * 900, "b" * 900, "c" * 900, "d" * 100, "e" * 2500, "f" * 50]
    frame = spark.createDataFrame([(1, pieces), (2, ["short"]), (3, [])], "doc_id long, ps array<string>")
    rows = C.parents(frame, F.col("ps"), "doc_id").collect()
    got = [r.text for r in sorted(rows, key=lambda r: (r.doc_id, r.parent)) if r.doc_id == 1]
    assert "\n\n".join(got) == "\n\n".join(pieces)
    assert got[-1].endswith("f" * 50) and len(got) == 3
    assert [r.text for r in rows if r.doc_id == 2] == ["short"] and not [r for r in rows if r.doc_id == 3]


def test_parents_flush_at_sections(spark):
    pieces = ["intro " * 20, "一、第一节", "a" * 700, "---", "2. Second", "b" * 500, "三、第三节", "c" * 1900, "d" * 200, "e" * 10]
    rows = C.parents(spark.createDataFrame([(1, pieces)], "doc_id long, ps array<string>"), F.col("ps"), "doc_id").orderBy("parent").collect()
    assert [(r.section, r.page) for r in rows] == [("", 1), ("Second", 2), ("第三节", 2)]
    assert rows[1].text == "2. Second\n\n" + "b" * 500 + "\n\n三、第三节" and rows[2].text.endswith("e" * 10)


def test_chunk_pipeline(spark):
    body = "# 收入分析\n" + "正文。" * 250 + "\n\n| 项目 | 金额 |\n| 收入 | 405.29 |\nPage 3\n\n---\n\n# 风险\n" + "内容。" * 220
    above, below = C.chunk_corpus(spark.createDataFrame([("pro", 1, body), ("pro", 2, None), ("safe", 3, "short")], "collection string, doc_id long, text string"), "collection", "doc_id")
    rows = above.orderBy("doc_id", "parent").collect()
    assert [(r.doc_id, r.section, r.page, r.has_table) for r in rows] == [(1, "收入分析", 1, True), (1, "风险", 2, False), (3, "", 1, False)]
    assert "Page 3" not in rows[0].text and "405.29" in rows[0].table_summary
    children = below.filter("doc_id = 1").orderBy("parent", "child").collect()
    assert all(r.section == ("收入分析", "风险")[r.parent] and r.page == r.parent + 1 for r in children)
    assert children[1].text.startswith("[收入分析] ") and children[0].search_text.startswith("[收入分析]\n") and "[table_data]" in children[0].search_text
    assert [r.text for r in below.filter("doc_id = 3").collect()] == ["short"]


def test_a_figure_line_belongs_to_the_window_before(spark):
    text = "x" * 340 + "\n405.29亿元 同比增长\n" + "y" * 700
    rows = C.child_windows(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", "doc_id").orderBy("child").collect()
    assert rows[0].chunk == "x" * 340 + "\n405.29亿元 同比增长\n" and rows[1].start == 320
    plain = C.child_windows(spark.createDataFrame([(1, text.replace("405.29亿元", "then"))], "doc_id long, text string"), "text", "doc_id").orderBy("child").collect()
    assert len(plain[0].chunk) < len(rows[0].chunk)


def test_small_text_rules(spark):
    assert one(spark, "| 营业收入 | 1 |", C.has_financial_table) is True and one(spark, "营业收入\n| a | 1 |", C.has_financial_table) is False
    assert one(spark, "三、 重要事项", C.section_name) == "重要事项" and one(spark, "## Risks ", C.section_name) == "Risks" and one(spark, "plain", C.section_name) is None
    files = spark.createDataFrame([("f", "# all\n_生成于 今天\n## one.md\nfirst\n---\nsecond\n## empty\n\n## two.md\nlast"), ("g", None)], "path string, text string")
    assert [(r.place, r.name, r.body) for r in C.summary_sections(files, "text", "path").collect()] == [(0, "one.md", "first\nsecond"), (1, "two.md", "last")]


def test_many_lines_take_time_in_proportion(spark):
    """200,000 lines in one text: a pass over them, not one for each."""
    text = "\n".join(["word"] * 100_000 + ["", "# t"] * 50_000)
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert C.paragraphs(frame).count() == 50_001
    assert len(one(spark, text, C.merge_short_lines)) == len(text)
    above, below = C.chunk_corpus(frame, "doc_id")
    assert above.agg(F.sum("char_count")).first()[0] > 500_000 and below.count() > 1500


def test_children_cover_every_character(spark):
    texts = ["", "x" * 399, "y" * 401, "ab. " * 300, "first\n\n" + "z" * 700 + "\n" + "w" * 900, "句子。" * 400]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = C.child_windows(frame, "text", "doc_id").collect()
    for i, text in enumerate(texts):
        own = sorted((r.start, r.chunk) for r in rows if r.doc_id == i)
        assert [s for s, _ in own] == [320 * k for k in range(len(own))]
        covered = set()
        for start, chunk in own:
            assert len(chunk) <= 400 and text[start : start + len(chunk)] == chunk
            covered |= set(range(start, start + len(chunk)))
        assert covered == set(range(len(text)))


def test_outlines_have_valid_headings(spark):
    text = "intro " * 100 + "\n# 经营情况\n" + "body " * 120 + "\n# 同比增长 5.2%\nmore\n# 短\nx"
    rows = C.outline_sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), "text", "doc_id").orderBy("section_order").collect()
    assert [r.title for r in rows] == ["前言/概述", "经营情况"] and rows[1].body.endswith("more\n# 短\nx")


def test_text_functions(spark):
    assert one(spark, "营业收入 Total 405.29", tokens) == ["营业", "业收", "收入", "total", "405.29"]
    assert one(spark, "１２３，ＡＢ ｃ", half_width) == "123,ABc"
    assert one(spark, "年报 2023(修订).pdf", safe_id) == "年报_2023_修订_"
    ids = spark.range(1000).select(point_id(F.lit("pro"), "id").alias("p")).agg(F.count_distinct("p"), F.min("p")).first()
    assert ids[0] == 1000 and ids[1] >= 0


def test_sections_of_all_documents(spark, sf_dir, tmp_path):
    """Documents with headings of their own are cut too, as a plain fold over their lines says."""
    body = "\n".join(["some words of a section that stand in a line of their own here"] * 9)
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    own = [(-1, f"{body}\n# First part\n{body}\n2. Second part\nshort\n## Third part \n{body}", "s"), (-2, f"1. Only part\n{body}", "s"), (-3, "", "s")]
    spark.createDataFrame(docs + own, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def sections(text):
        out = [("前言/概述", [])]
        for line in text.split("\n"):
            title = re.sub(r"^\s*#{1,6}\s*", "", line, flags=re.A).strip(" ")
            bad = re.search(r"[。；，：,;:.!?！？]$", title) or re.search(r"\d+(\.\d+)?%|\d+\.\d+|增长|下降|同比|环比", title) or len(title) > 15 and re.search("[，,]", title)
            bad = bad or len(title) > 20 and re.search("因此|但是|由于|以及|其中|并且", title) or not 3 <= len(title) <= 80 or re.search(C.STATEMENT_TITLE, line)
            if re.search(C.HEADING, line, re.A) and not bad:
                out.append((title, []))
            else:
                out[-1][1].append(line)
        return [(i, t, len("\n".join(b))) for i, (t, b) in enumerate(out) if len("\n".join(b)) >= 500]

    rows = sorted(map(tuple, registry.queries()["outline_sections_all"](spark, str(tmp_path)).collect()))
    assert rows == sorted((d, *s) for d, t, _ in docs + own for s in sections(t or ""))
    assert [r[2] for r in rows if r[0] < 0] == ["1. Only part", "前言/概述", "First part", "Third part"]


def test_figures_stay_whole(spark):
    """Numbers with commas, decimals, units and years; words with digits; numerals of other kinds; nothing of it where there is nothing."""
    cases = {
        "revenue 405.29 up 1,234.5%": ["revenue", "405.29", "up", "1234.5", "%"],
        "营业收入405.29亿元，2024年": ["营业", "业收", "收入", "405.29", "亿元", "2024年", "2024"],
        "1,2,3 and 1,2345, 12,345,678 a1b2 3D 2nd": ["1", "2", "3", "and", "1", "2345", "12345678", "a1b2", "3d", "2nd"],
        "于2023年末达3.5百分点": ["于", "2023年", "2023", "末达", "3.5", "百分点"],
        "12024年 元旦 v1.2.3 5² Ⅳ": ["12024", "年", "元旦", "v1", "2.3", "5", "²", "ⅳ"],
        "end of 2024. Next": ["end", "of", "2024", "next"],
        "": [], None: [],
    }
    for text, want in cases.items():
        assert one(spark, text, tokens) == want
    assert one(spark, "Sales 1,234.5%，增长3.2亿", words) == ["sales", "1234.5", "增长", "3.2", "亿"]


def test_segmenter(spark):
    """The likeliest words win over longer and shorter ones; what the dictionary lacks is cut into characters; figures stay whole."""
    rows = [("营业", 50), ("收入", 60), ("营业收入", 40), ("入", 5), ("研究", 30), ("研究生", 20), ("生命", 40), ("命", 5), ("起源", 30), ("", 9), (None, 1), ("收入", 1)]
    cut = segmenter(spark.createDataFrame(rows, "word string, weight int"), "word", "weight")
    assert one(spark, "营业收入405.29亿元，2024年", cut) == ["营业收入", "405.29", "亿元", "2024年", "2024"]
    assert one(spark, "研究生命起源 GPU x", cut) == ["研究", "生命", "起源", "gpu", "x"]
    assert one(spark, "他研究", cut) == ["他", "研究"]
    assert one(spark, "", cut) == [] and one(spark, None, cut) == []
    index = SearchIndex.build(spark.createDataFrame([(1, "公司营业收入405.29亿元"), (2, "公司营业405.3亿元"), (3, "其他")], "point_id long, text string"), Scratch(spark, "cut"), dim=8, cut=cut)
    hits = lexical(index, spark.createDataFrame([(1, "营业收入"), (2, "405.29")], "query_id long, text string"), 5).collect()
    assert {(h.query_id, h.point_id) for h in hits} == {(1, 1), (2, 1)}


def test_windows_are_cut_in_one_pass_and_alike_for_every_size(spark):
    """A window ends behind the last break of the first kind found, or with the line of a figure that goes on behind it."""
    text = "a" * 35 + "\n" + "b" * 20 + ". " + "𝒳" * 30 + "7亿元 more\n" + "c" * 50
    frame = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    windows = C.child_windows(frame, "text", "doc_id", window=40, stride=30)
    got = {(r.doc_id, r.child, r.start): r.chunk for r in windows.collect()}
    assert got[1, 0, 0] == text[:36] and got[1, 1, 30] == text[30:70] and got[2, 0, 0] == got[3, 0, 0] == ""
    last = max(child for doc, child, _ in got if doc == 1)
    assert got[1, last, last * 30] == text[last * 30 :] and all(got[1, i, i * 30][:30] == text[i * 30 : (i + 1) * 30] for i in range(last + 1))
    assert "regexp_extract_all" not in windows._jdf.queryExecution().toString()
