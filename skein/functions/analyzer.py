"""Languages: stop words and stems, for columns of tokens and for query words."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.stem import STEMMERS
from skein.functions.text import lower_text

#: Languages an index can be set to; ``simple`` has neither stop words nor stems.
LANGUAGES = ("simple", "danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian", "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish")


@cache
def _bundled(language: str) -> frozenset[str]:
    loader = SparkSession.active()._jvm.org.apache.spark.ml.feature.StopWordsRemover
    # Contractions never come out of the tokenizer, which splits at apostrophes.
    return frozenset(lower_text(w) for w in loader.loadDefaultStopWords(language) if w.isalpha())


def stop_words(language: str) -> frozenset[str]:
    """Words that the language leaves out; Spark's own lists."""
    return frozenset() if language == "simple" else _bundled(language)


def stem(word: str, language: str) -> str:
    stemmer = STEMMERS.get(language)
    return stemmer(word) if stemmer and word.isalpha() else word


def lexeme(word: str, language: str) -> str | None:
    """What the language's analyzer keeps of one lower-case token; None for a stop word."""
    return None if word in stop_words(language) else stem(word, language)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pa.Array, config: pa.Array) -> pa.Array:
    """Each distinct word of a batch and language is stemmed once; the rest are numbers."""
    words, config = tokens.flatten().dictionary_encode(), config.dictionary_encode()
    lists = np.diff(tokens.offsets.to_numpy()) if len(tokens) else np.array([], int)
    if tokens.null_count:
        lists = np.where(tokens.is_valid().to_numpy(zero_copy_only=False), lists, 0)
    known, number = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
    languages = np.repeat(config.indices.fill_null(-1).to_numpy(zero_copy_only=False), lists)
    out = np.zeros(len(number), np.int64)
    stemmed: list[str] = []
    for code in np.unique(languages):
        own = languages == code
        some, place = np.unique(number[own], return_inverse=True)
        out[own] = place + len(stemmed)
        language = config.dictionary[int(code)].as_py() if code >= 0 else ""
        stemmed += [stem(known[i], language) for i in some]
    values = pa.array(stemmed, pa.string()).take(pa.array(out))
    offsets = pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=tokens.is_null())


def has_stemmer(languages: list[str]) -> bool:
    return any(x in STEMMERS for x in languages)


def stems(tokens: Column, config: Column, languages: list[str]) -> Column:
    """Stems of an array of tokens, by each row's language; stays in the JVM if no language has a stemmer."""
    return _stems(tokens, config) if has_stemmer(languages) else tokens


def is_stop_word(token: Column, config: Column, languages: list[str]) -> Column:
    out = F.lit(False)
    for language in languages:
        words = sorted(stop_words(language))
        if words:
            out = out | ((config == language) & token.isin(words))
    return out
