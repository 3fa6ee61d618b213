"""Fragments of a document around the words searched for; made for the rows of one page only."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.analyzer import stem
from skein.functions.text import lower_text

WINDOW_BYTES, WINDOW_CHARS, LEAD, PREVIEW = 10_000, 10_000, 500, 300
FRAGMENTS, MAX_WORDS, MIN_WORDS = 3, 30, 12
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def _mapped(text: str, language: str) -> str:
    """Letter for letter, so that places in it are places in the text."""
    if language == "turkish":
        return text.translate(str.maketrans("Iİ", "ıi")).lower()
    return "".join(c.lower() if len(c.lower()) == 1 else "i" if c == "İ" else c for c in text)


def window(text: str, words: Sequence[str], language: str) -> str:
    """A long text cut to a stretch that begins somewhat before the first match, at a word's start if one is near."""
    if len(text.encode("utf-8", "replace")) <= WINDOW_BYTES:
        return text
    mapped = _mapped(text, language)
    found = [m.start() for w in words if (m := regex.search(r"(?<![\p{L}\p{N}])" + regex.escape(w), mapped))] or [p for w in words if (p := mapped.find(w)) >= 0]
    low = max(0, min(found, default=0) - LEAD)
    if low:
        low = min(low + LEAD, text.find(" ", low) + 1 or low)
    return text[low : low + WINDOW_CHARS]


def fragments(text: str, words: Sequence[str], language: str) -> list[str]:
    """Up to FRAGMENTS stretches of MIN_WORDS to MAX_WORDS words with most matches, in order; the start where nothing matches."""
    own = window(text, words, language)
    mapped = _mapped(own, language)
    spans = [(m.start(), m.end()) for m in _WORD.finditer(mapped)]
    if not spans:
        return []
    lexemes = {stem(w, language) for w in words}
    hit = [any(mapped[a:b].startswith(w) for w in words) or stem(mapped[a:b], language) in lexemes for a, b in spans]
    sums = [0]
    for h in hit:
        sums.append(sums[-1] + h)
    taken: list[tuple[int, int]] = []
    at = 0
    options = []
    while at < len(spans):
        if hit[at]:
            low = max(0, at - MIN_WORDS // 2)
            high = min(len(spans), low + MAX_WORDS)
            options.append((-(sums[high] - sums[low]), low, high))
            at = high
        else:
            at += 1
    for _, low, high in sorted(options)[:FRAGMENTS]:
        taken.append((low, high))
    out = [own[spans[a][0] : spans[b - 1][1]].strip() for a, b in sorted(taken or [(0, min(len(spans), MAX_WORDS))])]
    return [x for x in out if x]


EXCERPTS = T.ArrayType(T.StructType([T.StructField("source", T.StringType()), T.StructField("excerpt", T.StringType())]))


def excerpts(content: Column, parts: Column, config: Column, words: Sequence[str], weights: Sequence[str]) -> Column:
    """Excerpts of content, parts or both, by the fields searched."""
    own = list(words)

    @F.pandas_udf(EXCERPTS)
    def make(texts: pd.Series, configs: pd.Series) -> pd.Series:
        return pd.Series([[{"source": "content", "excerpt": x} for x in fragments(t or "", own, c or "simple")] for t, c in zip(texts, configs, strict=True)])

    fields = [c for c, w in ((content, "D"), (parts, "C")) if w in weights] or [content]
    return make(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in fields]), config)


def preview(content: Column) -> Column:
    text = F.substring(content, 1, PREVIEW)
    return F.when(F.length(F.trim(text)) > 0, F.array(F.struct(F.lit("content").alias("source"), F.trim(text).alias("excerpt")))).otherwise(F.array().cast("array<struct<source:string,excerpt:string>>"))


def title_words(text: str) -> list[str]:
    return _WORD.findall(lower_text(text))
