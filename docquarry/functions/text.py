"""Text expressions: tokens, normal forms, ids. All are native columns, but for ``runs``, which cuts many plain texts at once in a task."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[\\u4e00-\\u9fff]"
#: A run with a letter that isn't Han; a number with groups of three digits and decimals; other numerals; a run of Han.
_WORD = r"\p{N}*+[\p{L}&&[^一-鿿]][\p{L}\p{N}&&[^一-鿿]]*"
_NUMBER = r"[0-9]+(?:,[0-9]{3}(?![0-9A-Za-z_]))*(?:\.[0-9]+)?"
_REST = r"\p{N}+|[一-鿿]+"
#: Units of amounts that are terms of their own behind a number.
UNITS = ("百万元", "亿元", "万元", "百分点", "亿", "万", "元", "%")
_FIGURE = f"{_NUMBER}(?:{'|'.join(UNITS)})?"
_YEAR = "(?:19|20)[0-9]{2}年"
#: A text of Latin, Greek and Cyrillic whose only numerals are digits (one greedy class: a search for other characters takes ten times as long); and what it may not have besides.
_SIMPLE = r"^[\x00-\u00B1\u00B4-\u00B8\u00BA\u00BB\u00BF-\u052F\u2000-\u206F\u20A0-\u20BF]*+\z"
_FIGURES = r"[0-9](?:\.[0-9]|[,%])"


def lit_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, and runs of Han; numbers whole, with their decimals and without commas."""
    return _plain(_words(text))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(lit_text(text)), F.lit(f"{_WORD}|{_NUMBER}|{_REST}"), F.lit(0))


def _plain(found: Column) -> Column:
    return F.transform(found, lambda w: F.replace(w, F.lit(","), F.lit("")))


def pieces(text: Column) -> Column:
    """What tokens are made of: words, years with their sign, numbers with their unit, and whole runs of Han, in order."""
    return F.regexp_extract_all(F.lower(lit_text(text)), F.lit(f"{_YEAR}|{_WORD}|{_FIGURE}|{_REST}"), F.lit(0))


def piece_tokens(piece: Column) -> Column | None:
    """The terms of a piece, null for a run of Han: a year's sign makes a term with it besides the number, a unit is a term of its own."""
    number = F.regexp_extract(piece, f"^{_NUMBER}", 0)
    figure = F.array(F.replace(number, F.lit(","), F.lit("")), F.substr(piece, F.length(number) + 1, F.length(piece)))
    is_figure = piece.rlike(f"^{_FIGURE}$")
    return (
        F.when(piece.rlike(f"^{_YEAR}$"), F.array(piece, F.substring(piece, 1, 4)))
        .when(is_figure & (F.length(number) < F.length(piece)), figure)
        .when(~piece.rlike(f"^{HAN}"), F.array(F.replace(piece, F.lit(","), F.lit(""))))
    )


def tokens(text: Column) -> Column:
    """Terms for search: words; whole numbers without commas; units behind them; years, with and without their sign; overlapping pairs of what Han is left."""
    pairs = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array(w))
    cut = F.flatten(F.transform(pieces(text), lambda w: F.coalesce(piece_tokens(w), pairs(w))))
    # behind a figure there is no comma in the others, so nothing is taken out of their words
    return F.when(lit_text(text).rlike(f"[0-9一-鿿](?:(?<={HAN})|[%,])"), cut).otherwise(_words(text))


def plain(text: Column) -> Column:
    """The text in lower case where its ``tokens`` are just its runs of letters and digits, in characters that every Unicode version since 13 has alike; else null. ``runs`` cuts them in bulk."""
    low = F.lower(lit_text(text))
    return F.when(low.rlike(_SIMPLE) & ~low.rlike(_FIGURES), low)


def _in_runs() -> np.ndarray:
    """By two bytes of UTF-8, of which the second ends a character of a plain text: whether that is a letter or digit."""
    table = np.zeros((256, 256), bool)
    for c in range(0x530):
        *first, last = chr(c).encode()
        table[first[0] if first else slice(None), last] = unicodedata.category(chr(c))[0] in "LN"
    return table.reshape(-1)


_IN_RUNS = _in_runs()


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters and digits of ``plain`` texts, one text behind the other, and how many each text has; a null has none."""
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    if not len(data):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    pairs = data.astype(np.uint16)
    pairs[1:] |= pairs[:-1] << 8
    inside = _IN_RUNS[pairs]
    opens = np.flatnonzero((data >= 0xC2) & (data < 0xE0))  # the first byte of two goes with the second
    inside[opens] = inside[opens + 1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]
    upto = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    n = np.diff(np.searchsorted(np.flatnonzero(first), ends))
    return pa.StringArray.from_buffers(len(upto) - 1, pa.py_buffer(upto.tobytes()), pa.py_buffer(data[inside].tobytes())), n


def half_width(text: Column) -> Column:
    """Full-width digits, letters and marks in their ASCII form; blanks and line ends dropped."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.translate(F.regexp_replace(lit_text(text), r"[\s　]+", ""), wide, plain)


def safe_id(name: Column) -> Column:
    """A document id from a file name: the extension goes, runs of other characters become one underscore."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    return F.regexp_replace(stem, r"[^0-9A-Za-z_一-鿿-]+", "_")


def point_id(*parts: Column) -> Column:
    """A stable 63-bit id of what it names, so that indexing again replaces instead of adding."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def bucket(token: Column, dim: int) -> Column:
    """A hash bucket of a token that any engine with MD5 can compute."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def estimated_tokens(text: Column, chars_per_token: float, least: int = 0) -> Column:
    return F.greatest(F.floor(F.length(lit_text(text)) / chars_per_token).cast("int"), F.lit(least))
