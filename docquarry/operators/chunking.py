"""Cleaning, sectioning and chunking of document text.

Per-document work stays in one row, so nothing here shuffles before chunks are exploded. What depends on all lines before (short lines,
paragraphs, parents) and windows are one pass over a text in Arrow tasks, linear however long it is; the rest are native columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from docquarry.functions.text import lit_text
from docquarry.operators import finance

#: Fixed defaults of the chunking rules.
PARENT_CHARS, CHILD_CHARS, STRIDE_CHARS, LEAST_CHARS = 2000, 400, 320, 600
NOISE_LINE = r"(?i)^\s*(第\s*\d+\s*页.*|page\s+\d+.*|\d{1,4}|[-—]\s*\d+\s*[-—]|.*免责声明.*|disclaimer.*)\s*$"
IMAGE_LINE = r"^\s*<!--\s*image\s*-->\s*$"
HEADING = r"^\s*(#{1,6}\s+.+|[一二三四五六七八九十]+、.+|\d{1,2}(\.|、)\s*\S.*)$"
STRUCTURAL = r"^(\s*|\|.*|[-*>] .*|#.*|```.*|>.*|\d+[.、)].*)$"
STATEMENT_TITLE = r"[、.]\s*(合并资产负债表|母公司资产负债表|合并利润表|母公司利润表|合并现金流量表|母公司现金流量表|合并所有者权益变动表)\s*$"
FINANCE_WORD = r"(资产|负债|利润|收入|成本|现金|权益|费用|税)"
#: Fixed value: a line that goes on with a figure of the line before.
FIGURE_LINE = r"^\s*\d+[,.]?\d*\s*(亿元|万元|元|%|每股|占总|同比|增长|下降|收入|利润|分红|股息|净利润|营收|归母)"
FINANCE_TABLE = r"(万元|亿元|营业收入|净利润|资产|负债|股东权益|利润|现金流|合计)"
SECTION_MARK = r"^\s*(?:#{1,6}\s+|[一二三四五六七八九十]+、|\d{1,2}[.、]\s*)"


def drop_lines(text: Column, *patterns: str) -> Column:
    """Text without the lines that match a pattern."""
    keep = lambda line: ~line.rlike("|".join(f"(?:{p})" for p in patterns))
    return F.array_join(F.filter(F.split(lit_text(text), "\n"), keep), "\n")


def clean_lines(text: Column) -> Column:
    return drop_lines(text, NOISE_LINE, IMAGE_LINE)


def collapse_blank(text: Column) -> Column:
    return F.regexp_replace(lit_text(text), "\n{4,}", "\n\n\n")


def merge_short_lines(text: Column, short: int = 40) -> Column:
    """A plain line under ``short`` characters takes the next plain line on, joined by a blank; the result is tried again."""
    structural = re.compile(STRUCTURAL, re.ASCII)

    def merged(whole: str) -> str:
        out: list[list[str]] = []
        size, plain_before = 0, False
        for line in whole.split("\n"):
            plain = not structural.search(line)
            if out and plain and plain_before and size < short:
                part = line.strip(" ")
                out[-1].append(part)
                size += 1 + len(part)
            else:
                out.append([line])
                size, plain_before = len(line), plain
        return "\n".join(" ".join(parts) for parts in out)

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(merged)

    return run(lit_text(text))


def keep_table_labels(text: Column, label: str = r"^\s*(表|Table)\s*\d+.*$") -> Column:
    """Where a table's label, one stray line and the table follow each other, the stray line moves before the label."""
    lines = F.split(lit_text(text), "\n")
    at = lambda i: F.coalesce(F.get(lines, i), F.lit(""))
    is_label = lambda i: at(i).rlike(label)
    stray = lambda i: (F.trim(at(i)) != "") & ~at(i).startswith("|") & ~at(i).rlike(label)
    moved = lambda i: is_label(i) & stray(i + 1) & at(i + 2).startswith("|")
    return F.array_join(F.transform(lines, lambda x, i: F.when(moved(i), at(i + 1)).when(moved(i - 1), at(i - 1)).otherwise(x)), "\n")


def table_runs(text: Column) -> Column:
    """How many runs of pipe lines a text has."""
    lines = F.split(lit_text(text), "\n")
    starts = F.transform(lines, lambda x, i: F.when(x.startswith("|") & ~F.coalesce(F.get(lines, i - 1), F.lit("")).startswith("|"), 1).otherwise(0))
    return F.aggregate(starts, F.lit(0), lambda a, x: a + x)


def has_financial_table(text: Column) -> Column:
    """Whether a pipe line holds a financial word or unit."""
    return F.exists(F.split(lit_text(text), "\n"), lambda x: F.trim(x).startswith("|") & x.rlike(FINANCE_TABLE))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def section_name(line: Column) -> Column:
    """A heading's text without its mark; other lines have none."""
    return F.when(line.rlike(HEADING), F.trim(F.regexp_replace(line, SECTION_MARK, "")))


_HEADING, _TITLE, _FINANCE, _MARK = (re.compile(p, re.ASCII) for p in (HEADING, STATEMENT_TITLE, FINANCE_WORD, SECTION_MARK))


def split_paragraphs(text: str, most: int = 10_000) -> Iterator[tuple[str, str]]:
    """(kind, paragraph) in order: a blank line ends a paragraph, a heading stands alone, pipe lines stay together, and a statement's block runs on."""
    group: list[str] = []
    first = last = "blank"
    inside, chars = False, 0
    for line in text.split("\n"):
        kind = "blank" if not line.strip(" ") else "table" if line.startswith("|") else "title" if _TITLE.search(line) else "heading" if _HEADING.search(line) else "plain"
        ends = kind == "heading" and (line.strip(" ").startswith("#") or not _FINANCE.search(line))
        was, inside = inside, kind == "title" or inside and not (ends or chars > most)
        stays = was and inside and kind != "title"
        if not stays and (kind != last or kind in ("heading", "title")) and not (kind == "plain" and last == "title" and inside):
            if group:
                yield first, "\n".join(group)
            group, first = [], kind
        if kind != "blank" or stays:
            group.append(line)
        last, chars = kind, len(line) if kind == "title" else chars + len(line)
    if group:
        yield first, "\n".join(group)


def merge_parents(pieces: Iterable[tuple[str, str]], most: int, least: int) -> list[tuple[str, int, str]]:
    """(section, page, text) of a document's parents, in order.

    A parent is flushed when the next paragraph would pass ``most`` characters, and at a heading once it has ``least``. It carries the section in
    which it begins and the page of its first paragraph; ``---`` alone turns the page. A last parent under ``least`` joins the one before, so no text is lost."""
    out: list[tuple[str, int, list[str]]] = []
    section, page, size, last = "", 1, 0, 0
    for kind, text in pieces:
        if text.strip(" ") == "---":
            page += 1
            continue
        heading = kind == "heading"
        if heading:
            section = _MARK.sub("", text).strip(" ")
        if not out or size and (size + len(text) > most or heading and size >= least):
            out.append((section, page, []))
            size = 0
        out[-1][2].append(text)
        size += len(text)
        last = size
    if len(out) > 1 and last < least:
        out[-2][2].extend(out.pop()[2])
    return [(s, p, "\n\n".join(t)) for s, p, t in out]


def _exploded(frame: DataFrame, source: str, keep: list[str], rows_of: Callable[[object], Iterable[tuple]], **columns: str) -> DataFrame:
    """(keep..., columns...): the rows that ``rows_of`` makes of each value of ``source``, numbered by the first column."""
    arrow = {"int": pa.int32(), "string": pa.string()}
    schema = frame.select(*keep).schema
    for name, kind in columns.items():
        schema = schema.add(name, "integer" if kind == "int" else kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                at: list[int] = []
                rows: list[tuple] = []
                for i, value in enumerate(batch["_source"].to_pylist()):
                    for k, row in enumerate(rows_of(value)):
                        at.append(i)
                        rows.append((k, *row))
                held = [batch[c].take(pa.array(at, pa.int64())) for c in keep]
                made = [pa.array([r[j] for r in rows], arrow[kind]) for j, kind in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([*held, *made], names=[*keep, *columns])

    return frame.select(*keep, F.col(source).alias("_source")).mapInArrow(run, schema)


def paragraphs(docs: DataFrame, text: str = "text", most: int = 10_000) -> DataFrame:
    """One row per paragraph: ``docs`` without its text, with (para, kind, paragraph), in order from 0. Null texts have none.

    A blank line ends a paragraph, a heading stands alone, pipe lines stay together. A statement title opens a block that only a
    Markdown heading, a section title without a finance word, or ``most`` characters end."""
    return _exploded(docs, text, [c for c in docs.columns if c != text], lambda t: split_paragraphs(t or "", most), para="int", kind="string", paragraph="string")


def blank_paragraphs(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The plain case: pieces between blank lines, without empty ones."""
    pieces = F.filter(F.split(lit_text(text), r"\n\n+"), lambda x: F.trim(x) != "")
    return docs.select(*keep, F.posexplode_outer(pieces).alias("para", "paragraph")).filter("paragraph is not null")


def parents(docs: DataFrame, pieces: Column, *keep: str, most: int = PARENT_CHARS, least: int = LEAST_CHARS) -> DataFrame:
    """(keep..., parent, section, page, text, char_count) from an array of a document's paragraphs (see merge_parents)."""
    kinds = lambda ps: (("heading" if "\n" not in p and _HEADING.search(p) and not _TITLE.search(p) else "plain", p) for p in ps or [])
    rows = _exploded(docs.withColumn("_p", pieces), "_p", list(keep), lambda ps: merge_parents(kinds(ps), most, least), parent="int", section="string", page="int", text="string")
    return rows.withColumn("char_count", F.length("text"))


def chunk_corpus(docs: DataFrame, *keep: str, text: str = "text", most: int = PARENT_CHARS, least: int = LEAST_CHARS, window: int = CHILD_CHARS, stride: int = STRIDE_CHARS, searched: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """The whole chunk pipeline: (parents, children) of ``docs`` (keep..., ``text``).

    Noise lines go, paragraphs are split, merged into parents and these cut into windows. Parents have (keep..., parent, section, page, text,
    char_count, has_table, table_summary), children (keep..., parent, child, start, section, page, text, has_table, table_summary, search_text);
    a child without a table of its own takes its parent's summary."""
    cleaned = docs.withColumn(text, clean_lines(F.col(text)))
    rows = _exploded(cleaned, text, list(keep), lambda t: merge_parents(split_paragraphs(t or ""), most, least), parent="int", section="string", page="int", text="string")
    summary = lambda t: F.when(finance.has_table(t), finance.table_summary(t)).otherwise("")
    above = rows.withColumns({"char_count": F.length("text"), "has_table": finance.has_table(F.col("text")), "table_summary": summary(F.col("text"))})
    carried = [*keep, "parent", "section", "page", "table_summary"]
    below = child_windows(above, "text", *carried, window=window, stride=stride)
    own = F.when((F.col("section") != "") & ~F.startswith("chunk", "section"), F.concat(F.lit("["), "section", F.lit("] "), "chunk")).otherwise(F.col("chunk"))
    below = below.withColumns({"text": own, "has_table": finance.has_table(F.col("chunk")), "table_summary": F.coalesce(F.nullif(summary(F.col("chunk")), F.lit("")), "table_summary")})
    below = below.withColumn("search_text", search_text(F.col("section"), F.col("table_summary"), F.col("chunk"), searched))
    return above, below.select(*keep, "parent", "child", "start", "section", "page", "text", "has_table", "table_summary", "search_text")


def child_windows(docs: DataFrame, text: str, *keep: str, window: int = CHILD_CHARS, stride: int = STRIDE_CHARS, goes_on: str | None = FIGURE_LINE) -> DataFrame:
    """(keep..., child, start, chunk): windows at multiples of ``stride``, each cut back to a natural break if one lies at or after the
    next window's start. The last window runs to the end, so every character is in some window.

    A line that begins right behind a window and matches ``goes_on`` (a figure and its unit or word) belongs to it whole, if it ends within the
    next two strides."""
    figure, breaks = re.compile(goes_on, re.ASCII) if goes_on else None, ("\n\n", "\n", "。", "；", ". ")

    def windows(body: str) -> Iterator[tuple[int, str]]:
        last = max(0, -((window - len(body)) // stride))
        for start in range(0, last * stride, stride):
            behind = start + stride
            tail = body[behind : start + window]
            end = behind + next((at + len(b) for b in breaks if (at := tail.rfind(b)) >= 0), max(0, window - stride))
            line = body.find("\n", end, behind + 2 * stride)
            yield start, body[start : line + 1 if line > end and figure and figure.search(body[end:line]) else end]
        yield last * stride, body[last * stride : (last + 2) * stride]

    return _exploded(docs, text, list(keep), lambda t: windows(t or ""), child="int", start="int", chunk="string")


def search_text(section: Column, summary: Column, body: Column, most: int | None = 1000) -> Column:
    """What the lexical index reads: section, table summary with a mark, then the text.

    Only the first ``most`` characters are searched (None: all); a summary takes half of them at most, so a long one can't push the text out."""
    shown = F.substring(summary, F.lit(1), F.lit(most // 2)) if most else summary
    table = F.when(summary != "", F.concat(shown, F.lit(" [table_data]")))
    parts = F.concat_ws("\n", F.when(section != "", F.concat(F.lit("["), section, F.lit("]"))), table, body)
    return F.substring(parts, F.lit(1), F.lit(most)) if most else parts


def valid_heading(title: Column) -> Column:
    """3 to 80 characters, no closing mark, no percentages or growth words, no commas if long, no connectives if longer."""
    n = F.length(title)
    return (
        n.between(3, 80) & ~title.rlike(r"[。；，：,;:.!?！？]$") & ~title.rlike(r"\d+(\.\d+)?%|\d+\.\d+|增长|下降|同比|环比")
        & ~((n > 15) & title.rlike("[，,]")) & ~((n > 20) & title.rlike("因此|但是|由于|以及|其中|并且"))
    )


def outline_sections(docs: DataFrame, text: str, *keep: str, least: int | None = 500, preface: str = "前言/概述") -> DataFrame:
    """(keep..., section_order, title, body): text cut at valid headings, in order.

    Sections under ``least`` characters are dropped with their text (None keeps all); what stands before the first heading is titled ``preface``."""
    lines = F.split(lit_text(F.col(text)), "\n")
    title = lambda x: F.trim(F.regexp_replace(x, r"^\s*#{1,6}\s*", ""))
    opens = lambda x: x.rlike(HEADING) & valid_heading(title(x)) & ~x.rlike(STATEMENT_TITLE)
    rows = docs.withColumn("_l", lines)
    starts = F.filter(F.transform("_l", lambda x, i: F.when(opens(x), i).otherwise(-1)), lambda i: i >= 0)
    bounds = F.concat(F.array(F.lit(-1)), starts, F.array(F.size("_l")))
    cut = F.transform(
        F.sequence(F.lit(0), F.size(bounds) - 2),
        lambda k: F.struct(
            F.when(k == 0, F.lit(preface)).otherwise(title(F.get("_l", F.get(bounds, k)))).alias("title"),
            F.array_join(F.slice("_l", F.get(bounds, k) + 2, F.get(bounds, k + 1) - F.get(bounds, k) - 1), "\n").alias("body"),
        ),
    )
    return rows.select(*keep, F.posexplode_outer(cut).alias("section_order", "s")).select(*keep, "section_order", "s.title", "s.body").filter(F.length("body") >= (least or 0))


def page_numbers(pieces: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """``pieces`` with ``page``: standalone ``---`` pieces before it, plus 1."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("page", F.coalesce(F.sum((F.col(text) == "---").cast("int")).over(w), F.lit(0)) + 1)


def summary_sections(files: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., place, name, body): the ``## name`` blocks of summary files. Rules, ``#`` titles and the generator's own line go, as do blocks without text."""

    def blocks(whole: str | None) -> Iterator[tuple[str, str]]:
        name, lines = "", []
        for line in [*(whole or "").split("\n"), "## "]:
            if line.startswith("## "):
                if name and (body := "\n".join(lines).strip()):
                    yield name, body
                name, lines = line[3:].strip(), []
            elif not line.startswith(("---", "# ", "_生成")):
                lines.append(line)

    return _exploded(files, text, list(keep), blocks, place="int", name="string", body="string")
