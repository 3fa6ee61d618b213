"""Which configured language a document is in, by counting stop words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.analyzer import stop_words
from skein.functions.text import simple_words

SAMPLE_CHARS, LEAST, MARGIN = 2000, 2, 1.5


def sample(content: Column, parts: Column, title: Column) -> Column:
    """The start of the first of three texts that is not blank."""
    own = lambda c: F.when(F.length(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))) > 0, c)
    return F.substring(F.coalesce(own(content), own(parts), own(title), F.lit("")), 1, SAMPLE_CHARS)


def scores(text: Column, languages: Sequence[str]) -> dict[str, Column]:
    """Stop words of each language among the words of a text."""
    words = simple_words(text)

    def count(language: str) -> Column:
        own = sorted(stop_words(language))
        return F.size(F.filter(words, lambda w: w.isin(own))) if own else F.lit(0)

    return {x: count(x) for x in languages}


def decide(counts: dict[str, Column]) -> Column:
    """The language with most stop words, if it has LEAST and MARGIN times those of the next; else the first one."""
    names = list(counts)
    if len(names) == 1:
        return F.lit(names[0])
    order = F.sort_array(F.array(*[F.struct(counts[x].alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("name")) for i, x in enumerate(names)]), asc=False)
    best, second = order[0], order[1]
    return F.when((best["n"] >= LEAST) & (best["n"] >= MARGIN * second["n"]), best["name"]).otherwise(F.lit(names[0]))


def detect(content: Column, parts: Column, title: Column, languages: Sequence[str]) -> Column:
    return decide(scores(sample(content, parts, title), languages))
