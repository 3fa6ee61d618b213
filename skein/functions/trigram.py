"""Trigram similarity of words and titles, and edit distance with swaps."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word of lower-case text, padded with two blanks before and one behind."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams as a share of all, 0 where there are none. a and b are arrays from trigrams()."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ > 0, both / all_).otherwise(F.lit(0.0))


def _of_word(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(word) + 1)]


def trigrams_text(text: str) -> set[str]:
    return {t for w in regex.findall(r"[\p{L}\p{N}]+", text) for t in _of_word(w)}


def similarity_text(a: str, b: str) -> float:
    x, y = trigrams_text(a), trigrams_text(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def word_similarity_text(query: str, target: str) -> float:
    """Greatest share of the query's trigrams, over those and the others between, in a continuous extent of the target's."""
    want = trigrams_text(query)
    order = [t for w in regex.findall(r"[\p{L}\p{N}]+", target) for t in _of_word(w)]
    if not want or not order:
        return 0.0
    places = [i for i, t in enumerate(order) if t in want]
    best = 0.0
    for n, low in enumerate(places):
        seen: set[str] = set()
        shared = 0
        at = low
        for high in places[n:]:
            while at <= high:
                if order[at] not in seen:
                    seen.add(order[at])
                    shared += order[at] in want
                at += 1
            best = max(best, shared / (len(want) + len(seen) - shared))
            if len(want) + len(seen) - shared > len(want) / max(best, 1e-9):
                break
    return best


@F.pandas_udf(T.DoubleType())
def word_similarity(query: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([word_similarity_text(q or "", t or "") for q, t in zip(query, target, strict=True)])


def osa(a: str, b: str) -> int:
    """Least number of insertions, deletions, substitutions and swaps of neighbours, no place edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, old[j - 2] + 1)
            row.append(best)
    return row[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int32")
