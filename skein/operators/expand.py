"""Other spellings of the typed words, from the vocabulary, as far as the viewer may see documents that have them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.analyzer import stop_words
from skein.functions.text import fold, fold_text, lower_text, valid_word
from skein.functions.trigram import osa_distance, similarity, trigrams, trigrams_text, word_similarity
from skein.operators.match import any_of

MIN_SPELLING, VARIANTS, CORRECTIONS, SHORTLIST, THRESHOLD = 4, 3, 2, 50, 0.2


def valid_words(words: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(w for w in map(lower_text, words) if valid_word(w)))


def distance_allowed(word: str) -> int:
    return 1 if len(word) < 7 else 2


def _queries(df: DataFrame, words: Sequence[str], extra=lambda w: (w,)) -> DataFrame:
    rows = [(w, fold_text(w), len(w), *extra(w)[1:]) for w in words]
    return df.sparkSession.createDataFrame(rows, "typed string, typed_folded string, n int")


def accent_candidates(vocabulary: DataFrame, words: Sequence[str]) -> DataFrame:
    """(typed, word, place): vocabulary words with the typed one's folded letters, shortest first.

    Four letters and more match as a prefix, three as a whole. Words that begin as typed are found anyway.
    """
    typed = _queries(vocabulary, words)
    # At most a query's words, 32 of each kind, so the small side is bounded.
    joined = vocabulary.join(F.broadcast(typed), ((F.col("n") >= 4) & F.expr("startswith(folded, typed_folded)")) | ((F.col("n") == 3) & (F.col("folded") == F.col("typed_folded"))))
    joined = joined.where("NOT startswith(word, typed)")
    place = F.row_number().over(Window.partitionBy("typed").orderBy(F.length("word"), "word"))
    return joined.withColumn("place", place).where(F.col("place") <= SHORTLIST).select("typed", "word", "place")


def _shares(folded_: Column, gram: str) -> Column:
    """Whether a folded word has a trigram; blanks of one are ends of the word."""
    starts, ends, letters = gram.startswith(" "), gram.endswith(" "), gram.strip()
    if starts and ends:
        return folded_ == letters
    return folded_.startswith(letters) if starts else folded_.endswith(letters) if ends else folded_.contains(letters)


def sharing(vocabulary: DataFrame, words: Sequence[str], nearby: bool = False) -> DataFrame:
    """vocabulary with the typed words that share a trigram with the word; with nearby, only those of about its length.

    All are tests of a word's letters against fixed ones: no trigrams of the whole vocabulary, and no pairs with all of it.
    """
    own = list(dict.fromkeys(words))
    tests = []
    for w in own:
        alike = any_of([_shares(F.col("folded"), g) for g in sorted(trigrams_text(fold_text(w)))])
        tests.append((F.abs(F.length("word") - len(w)) <= distance_allowed(w)) & alike if nearby else alike)
    typed = F.array_compact(F.array(*[F.when(t, F.lit(w)) for t, w in zip(tests, own, strict=True)]).cast("array<string>"))
    # The outer kind keeps the tests behind the count of distinct words; pushed before it, they would meet every occurrence.
    return vocabulary.withColumn("typed", F.explode_outer(typed)).where("typed IS NOT NULL")


def spelling_candidates(vocabulary: DataFrame, words: Sequence[str]) -> DataFrame:
    """(typed, word, distance, alike): the SHORTLIST most similar words of about the length, within the edit distance allowed.

    Trigrams and length cut the vocabulary down in the JVM; only the shortlist meets the distance function.
    """
    own = [w for w in words if len(w) >= MIN_SPELLING]
    typed = _queries(vocabulary, own).withColumns({"typed_grams": trigrams(F.col("typed_folded")), "most": F.when(F.col("n") < 7, 1).otherwise(2)})
    near = sharing(vocabulary.where(F.length("word") >= MIN_SPELLING - 2), own, nearby=True)
    joined = near.join(F.broadcast(typed), "typed").withColumn("grams", trigrams(F.col("folded")))
    joined = joined.withColumn("alike", similarity(F.col("grams"), F.col("typed_grams"))).where((F.col("alike") >= THRESHOLD) & (F.col("word") != F.col("typed")))
    place = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("alike"), "word"))
    short = joined.withColumn("place", place).where(F.col("place") <= SHORTLIST)
    return short.withColumn("distance", osa_distance("typed_folded", "folded")).where(F.col("distance") <= F.col("most")).select("typed", "word", "distance", "alike")


def seen(candidates: DataFrame, surface: DataFrame, visible: DataFrame, weights: Sequence[str]) -> list[Row]:
    """Candidates that stand, as written, in a searched field of some visible document: a semi-join, so nothing else shows.

    The candidates, SHORTLIST for each typed word at most, are fetched first, so that the scan of the surface
    words, which are laid out by word, reads those alone.
    """
    rows = candidates.collect()
    words = sorted({r["word"] for r in rows})
    if not words:
        return []
    own = surface.where(F.col("word").isin(words) & F.col("weight").isin(list(weights))).join(visible.select("id"), "id", "left_semi")
    found = {r["word"] for r in own.select("word").distinct().collect()}
    return [r for r in rows if r["word"] in found]


def typed_prefix_seen(words: Sequence[str], surface: DataFrame, visible: DataFrame, weights: Sequence[str]) -> set[str]:
    """Typed words that begin some word of a visible document."""
    begun = [F.col("word").startswith(w) for w in words]
    own = surface.where(any_of(begun) & F.col("weight").isin(list(weights))).join(visible.select("id"), "id", "left_semi")
    row = own.agg(*[F.bool_or(b).alias(f"b{i}") for i, b in enumerate(begun)]).first()
    return {w for i, w in enumerate(words) if row[f"b{i}"]}


def pick_variants(rows: Sequence[tuple[str, str, int]]) -> dict[str, list[str]]:
    """The first VARIANTS of each typed word; one that a kept shorter one begins is covered already."""
    out: dict[str, list[str]] = {}
    for typed, word, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        kept = out.setdefault(typed, [])
        if len(kept) < VARIANTS and not any(word.startswith(k) for k in kept):
            kept.append(word)
    return {k: v for k, v in out.items() if v}


def pick_corrections(rows: Sequence[tuple[str, str, int, float]]) -> dict[str, list[str]]:
    """Of each typed word's corrections those of the least distance, most alike first, CORRECTIONS at most."""
    out: dict[str, list[tuple]] = {}
    for typed, word, distance, alike in rows:
        out.setdefault(typed, []).append((distance, -alike, word))
    return {k: [w for d, _, w in sorted(v) if d == min(v)[0]][:CORRECTIONS] for k, v in out.items()}


def accent_variants(words: Sequence[str], vocabulary: DataFrame, surface: DataFrame, visible: DataFrame, weights: Sequence[str]) -> dict[str, list[str]]:
    own = valid_words(words)
    if not own:
        return {}
    rows = seen(accent_candidates(vocabulary, own), surface, visible, weights)
    return pick_variants([(r["typed"], r["word"], r["place"]) for r in rows])


def corrections(words: Sequence[str], known: Sequence[str], languages: Sequence[str], vocabulary: DataFrame, surface: DataFrame, visible: DataFrame, weights: Sequence[str]) -> dict[str, list[str]]:
    """Corrections of words that are no stop word anywhere, have no accent variant (``known``), and begin no word the viewer sees."""
    own = [w for w in valid_words(words) if len(w) >= MIN_SPELLING and w not in known and not any(w in stop_words(x) for x in languages)]
    if own:
        begun = typed_prefix_seen(own, surface, visible, weights)
        own = [w for w in own if w not in begun]
    if not own:
        return {}
    rows = seen(spelling_candidates(vocabulary, own), surface, visible, weights)
    return pick_corrections([(r["typed"], r["word"], r["distance"], r["alike"]) for r in rows])


def similar_titles(docs: DataFrame, text: str, least: float) -> DataFrame:
    """docs whose title has an extent at least so alike to the text, with ``alike``.

    An extent can share no more of the text's trigrams than the whole title does, so titles that share too few
    are left out in the JVM, before any meets the function.
    """
    want = sorted(trigrams_text(text))
    shared = F.size(F.array_intersect(trigrams(F.col("title_search")), F.array(*map(F.lit, want)).cast("array<string>")))
    near = docs.where(shared >= least * len(want) - 1e-9) if want else docs.where(F.lit(False))
    return near.withColumn("alike", word_similarity(F.lit(text), F.col("title_search"))).where(F.col("alike") >= least)


def folded(df: DataFrame, column: str = "word") -> DataFrame:
    return df.withColumn("folded", fold(F.col(column)))
