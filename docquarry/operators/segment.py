"""Cutting runs of Han into words of a caller's dictionary: the most probable path through all words that fit."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import piece_tokens, pieces

#: Words of a dictionary at most; the tasks hold it.
MOST_WORDS = 2_000_000


def best_path(run: str, costs: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The cheapest cut of a run into words and, where no word fits, single characters at cost ``unknown``; of equal ones that with the longer first words."""
    n = len(run)
    cost, step = [0.0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        cost[i] = unknown + cost[i + 1]
        for size in range(1, min(longest, n - i) + 1):
            word = costs.get(run[i : i + size])
            if word is not None and word + cost[i + size] <= cost[i]:
                cost[i], step[i] = word + cost[i + size], size
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def segmenter(dictionary: DataFrame, word: str = "word", weight: str | None = None) -> Callable[[Column], Column]:
    """A function from a text column to its terms, like functions.text.tokens but with runs of Han cut into words.

    ``weight`` counts how often a word is met (1 where none is given); a word's cost is the negative logarithm of its share, so fewer and likelier words win. Numbers, units and years stay words of
    their own. Null and empty words are left out, of a word that comes twice the weights add up. A dictionary of over MOST_WORDS words is refused."""
    amount = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    rows = dictionary.filter(F.length(F.coalesce(word, F.lit(""))) > 0).groupBy(F.lower(word).alias("w")).agg(F.sum(amount).alias("n")).limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"a dictionary has {MOST_WORDS} words at most")
    total = sum(r["n"] for r in rows) + 1.0
    costs = {r["w"]: math.log(total / max(r["n"], 0.5)) for r in rows}
    longest, unknown = max(map(len, costs), default=1), math.log(total / 0.5) + 1.0

    @F.pandas_udf("array<array<string>>")
    def cut(runs: pd.Series) -> pd.Series:
        return runs.map(lambda texts: [best_path(t, costs, longest, unknown) for t in texts])

    def terms(text: Column) -> Column:
        found = pieces(text)
        # pieces that aren't runs of Han pass the function by as empty texts
        words = cut(F.transform(found, lambda w: F.when(piece_tokens(w).isNull(), w).otherwise("")))
        return F.flatten(F.zip_with(found, words, lambda w, cut_: F.coalesce(piece_tokens(w), cut_)))

    return terms
