"""Matching compiled queries against postings, and ranking what matches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.functions.text import lower_text
from skein.model import WEIGHT_VALUES
from skein.operators.query import MIN_SUBSTRING, Element, Query, Term, parse, sequences

#: Term frequencies weigh ranks for queries of so many positive terms.
IDF_TERMS = range(2, 9)
#: So many pairs of a word and a query are counted at once.
PAIRS = 4_000_000


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def in_language(config: Column, language: str, languages: Sequence[str]) -> Column:
    """Rows of a language; the first language takes those of unknown ones too."""
    if language == languages[0]:
        return ~config.isin(list(languages[1:])) if len(languages) > 1 else F.lit(True)
    return config == language


def _atom(e: Element, lexeme: Column | None = None) -> Column:
    lexeme = F.col("lexeme") if lexeme is None else lexeme
    return lexeme.startswith(e.lexeme) if e.prefix else lexeme == e.lexeme


class Compiled:
    """A query for an index: which postings to read, and what to make of them for each document."""

    def __init__(self, queries: Mapping[str, Query], weights: Sequence[str], alternatives: Mapping[str, Sequence[str]] | None = None, inside_titles: bool = True):
        self.inside_titles = inside_titles and "A" in weights
        self.languages = list(queries)
        self.queries = queries
        self.weights = list(weights)
        first = queries[self.languages[0]]
        # Terms are the same in each language but for Turkish letters, so they go by place.
        self.terms = [*first.required, *first.optional, *first.excluded]
        self.n_required, self.n_positive = len(first.required), len(first.positive)
        self.plans = {
            language: [sequences(t, language, i >= self.n_positive, alternatives) for i, t in enumerate([*q.required, *q.optional, *q.excluded])] for language, q in queries.items()
        }

    @property
    def answerable(self) -> bool:
        """Some positive term has lexemes in some language, and all languages read the same terms."""
        return all(len(p) == len(self.terms) for p in self.plans.values()) and any(p[i] for p in self.plans.values() for i in range(self.n_positive))

    def _elements(self) -> dict[tuple[str, Element], int]:
        """A number for each lexeme that some longer sequence needs the positions of."""
        out: dict[tuple[str, Element], int] = {}
        for language, plan in self.plans.items():
            for seqs in plan:
                for s in seqs:
                    if len(s) > 1:
                        for e in s:
                            out.setdefault((language, Element(0, e.lexeme, e.prefix)), len(out))
        return out

    def wanted(self, lexeme: Column, config: Column) -> Column:
        """Whether some term needs a lexeme: what hits() reads, for postings made from raw texts."""
        return any_of([in_language(config, l, self.languages) & _atom(e, lexeme) for l, plan in self.plans.items() for e in sorted({e for seqs in plan for s in seqs for e in s}, key=repr)])

    def hits(self, postings: DataFrame) -> DataFrame:
        """(id, c0, c1, ...): each term's sum of occurrence weights. One scan of the postings, one shuffle on id."""
        value = F.create_map(*[x for w, v in WEIGHT_VALUES.items() for x in (F.lit(w), F.lit(v))])[F.col("weight")]
        elements = self._elements()
        wanted, sums = [], []
        for i in range(len(self.terms)):
            single = any_of([in_language(F.col("config"), l, self.languages) & _atom(s[0]) for l, plan in self.plans.items() for s in plan[i] if len(s) == 1])
            wanted.append(single)
            sums.append(F.sum(F.when(single, F.size("positions") * value)).alias(f"s{i}"))
        for (language, e), n in elements.items():
            stands = in_language(F.col("config"), language, self.languages) & _atom(e)
            wanted.append(stands)
            placed = F.transform("positions", lambda p: F.struct(p.alias("p"), value.alias("v")))
            sums.append(F.flatten(F.collect_list(F.when(stands, placed))).alias(f"e{n}"))  # of one document: at most its positions
        rows = postings.where(F.col("weight").isin(self.weights)).where(any_of(wanted))
        found = rows.groupBy("id").agg(*sums)
        counts = []
        for i in range(len(self.terms)):
            total = F.coalesce(F.col(f"s{i}"), F.lit(0.0))
            longer = {s: None for plan in self.plans.values() for s in plan[i] if len(s) > 1}
            for s in longer:
                for language, plan in self.plans.items():
                    if s in plan[i]:
                        total = total + self._sequence_weight(s, language, elements)
            counts.append(total.alias(f"c{i}"))
        return found.select("id", *counts)

    @staticmethod
    def _sequence_weight(sequence: tuple[Element, ...], language: str, elements: Mapping[tuple[str, Element], int]) -> Column:
        """Sum, over the places where the sequence stands, of its first lexeme's weight there."""
        columns = [F.col(f"e{elements[language, Element(0, e.lexeme, e.prefix)]}") for e in sequence]
        rest = list(zip(sequence[1:], columns[1:], strict=True))

        def follows(first: Column, e: Element, places: Column) -> Column:
            return F.exists(places, lambda x: x["p"] == first["p"] + e.offset)

        def stands(first: Column) -> Column:
            return all_of([follows(first, e, c) for e, c in rest])

        return F.aggregate(F.filter(columns[0], stands), F.lit(0.0), lambda a, x: a + x["v"])

    def by_language(self, config: Column, make) -> Column:
        """make(language) in each row's language."""
        out = make(self.languages[0])
        for language in self.languages[1:]:
            out = F.when(config == language, make(language)).otherwise(out)
        return out

    def substring(self, i: int, language: str) -> Column | None:
        """Whether a word of three letters or more stands anywhere in the title, if titles are searched."""
        term: Term = [*self.queries[language].required, *self.queries[language].optional, *self.queries[language].excluded][i]
        word = lower_text(term.text)
        if term.phrase or i >= self.n_positive or not self.inside_titles or len(word) < MIN_SUBSTRING or not self.plans[language][i]:
            return None
        return F.col("title_search").contains(word)

    @property
    def reads_titles(self) -> bool:
        return any(self.substring(i, l) is not None for l in self.languages for i in range(self.n_positive))

    def holds(self, i: int, language: str) -> Column:
        """P: the document satisfies term i."""
        found = F.col(f"c{i}") > 0
        inside = self.substring(i, language)
        return found if inside is None else found | inside

    def matches(self, config: Column) -> Column:
        def one(language: str) -> Column:
            plan = self.plans[language]
            required, optional = range(self.n_required), range(self.n_required, self.n_positive)
            if not any(plan[i] for i in range(self.n_positive)):
                return F.lit(False)
            if any(plan[i] for i in required):
                base = all_of([self.holds(i, language) for i in required if plan[i]])
            elif len(optional):
                base = any_of([self.holds(i, language) for i in optional if plan[i]])
            else:
                base = F.lit(True)
            return base & ~any_of([self.holds(i, language) for i in range(self.n_positive, len(self.terms)) if plan[i]])

        return self.by_language(config, one)

    def all_match(self, config: Column) -> Column:
        return self.by_language(config, lambda l: all_of([self.holds(i, l) for i in range(self.n_positive) if self.plans[l][i]]))

    def rank(self, frequencies: Sequence[int], size: int) -> Column:
        """Mean of the terms' saturated scores weighed by rarity, or the saturated score of all occurrences."""
        scores = [F.col(f"c{i}") / (F.col(f"c{i}") + 1) for i in range(self.n_positive)]
        rare = {i: idf(n, size) for i, n in enumerate(frequencies) if n > 0}
        if self.n_positive in IDF_TERMS and len(rare) >= 2:
            return reduce(lambda a, b: a + b, [scores[i] * w for i, w in rare.items()]) / sum(rare.values())
        total = reduce(lambda a, b: a + b, [F.col(f"c{i}") for i in range(self.n_positive)])
        return total / (total + 1)


def idf(frequency: int, size: int) -> float:
    size = max(size, frequency)
    return math.log(1 + (size - frequency + 0.5) / (frequency + 0.5))


def candidates(docs: DataFrame, postings: DataFrame, compiled: Compiled) -> DataFrame:
    """docs with the terms' sums: those that have any of the terms' lexemes, or match by their title alone."""
    hits = compiled.hits(postings)
    joined = docs.join(hits, "id", "left" if compiled.reads_titles else "inner")
    joined = joined.withColumns({f"c{i}": F.coalesce(f"c{i}", F.lit(0.0)) for i in range(len(compiled.terms))})
    joined = joined.withColumns({"matched": compiled.matches(F.col("config")), "all_match": compiled.all_match(F.col("config"))})
    return joined.where(F.col("matched") | any_of([F.col(f"c{i}") > 0 for i in range(compiled.n_positive)]))


def best(postings: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """(key, id, words): for each query, rows (key, lexeme), the k documents with most of its words; of equals those of the least ids.

    postings: (lexeme, id) without repeats, those of a document one after the other. The words of all queries are fetched;
    what is counted for one batch of postings is gone before the next, but for the k best of each query so far.
    """
    spark, number = postings.sparkSession, {}
    rows = queries.select(key, "lexeme").distinct().collect()
    keys = {x: i for i, x in enumerate(dict.fromkeys(r[0] for r in rows))}
    for r in rows:
        number.setdefault(r["lexeme"], []).append(keys[r[0]])
    starts = np.cumsum([0, *map(len, number.values())])
    listed = np.array([i for own in number.values() for i in own], np.int64)
    n, last = len(keys), (1 << 63) - 1

    def count(ids: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, words, id) of whole documents, in pieces."""
        begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        lengths = starts[words + 1] - starts[words]
        if len(begins) > 1 and (lengths.sum() > PAIRS or len(begins) * n > PAIRS):
            half = begins[len(begins) // 2]
            yield from count(ids[:half], words[:half])
            yield from count(ids[half:], words[half:])
            return
        document = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(ids)]))
        at = np.arange(lengths.sum()) + np.repeat(starts[words] - np.cumsum(lengths) + lengths, lengths)
        counts = np.bincount(np.repeat(document, lengths) * n + listed[at], minlength=len(begins) * n)
        found = np.flatnonzero(counts)
        yield found % n, counts[found], ids[begins][found // n]

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (np.zeros(0, np.int64),) * 3
        least = np.zeros(n, np.int64)  # words of a query's k-th
        ids = words = np.zeros(0, np.int64)

        def add(ids: np.ndarray, words: np.ndarray) -> None:
            nonlocal own
            for some in count(ids, words):
                keep = some[1] >= least[some[0]]
                query, counts, id_ = (np.concatenate([x, y[keep]]) for x, y in zip(own, some, strict=True))
                order = np.lexsort((id_, -counts, query))
                query, counts, id_ = query[order], counts[order], id_[order]
                place = np.arange(len(query)) - np.searchsorted(query, query)
                full = place == k - 1
                least[query[full]] = counts[full]
                own = tuple(x[place < k] for x in (query, counts, id_))

        for b in batches:
            ids, words = np.r_[ids, b.column(0).to_numpy()], np.r_[words, b.column(1).to_numpy()]
            whole = len(ids) - int(np.argmax(np.r_[ids[::-1] != ids[-1:], True]))  # the last document may go on
            if whole:
                add(ids[:whole], words[:whole])
                ids, words = ids[whole:], words[whole:]
        if len(ids):
            add(ids, words)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], names=["query", "words", "id"])

    numbers = spark.createDataFrame([(x, i) for i, x in enumerate(number)], "lexeme string, word bigint")
    hits = postings.join(F.broadcast(numbers), "lexeme").select(F.coalesce("id", F.lit(last)).alias("id"), "word")
    partial = hits.mapInArrow(tops, "query bigint, words bigint, id bigint")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("words"), "id"))
    named = spark.createDataFrame([(i, x) for x, i in keys.items()], T.StructType([T.StructField("query", T.LongType()), queries.schema[key]]))
    ranked_ = partial.withColumn("k", place).where(F.col("k") <= k)
    return ranked_.join(F.broadcast(named), "query").select(key, F.nullif("id", F.lit(last)).alias("id"), "words")


def limited(docs: DataFrame, postings: DataFrame | Callable[..., DataFrame], text: str, weight: str, languages: Sequence[str]) -> DataFrame:
    """docs that a search for the text, in the field of one weight, finds by its words; signs, quotes and prefixes count.

    postings: a table, or what makes them from raw texts for some weights and lexemes, so that the rest is not made.
    """
    queries = {l: parse(text, l) for l in languages}
    if any(q is None for q in queries.values()):
        return docs.where(F.lit(False))
    compiled = Compiled(queries, [weight], inside_titles=False)
    if not compiled.answerable:
        return docs.where(F.lit(False))
    own = postings([weight], compiled.wanted) if callable(postings) else postings
    found = candidates(docs.select("id", "config"), own, compiled).where("matched").select("id")
    return docs.join(found, "id", "left_semi").select(*docs.columns)


def frequencies(found: DataFrame, compiled: Compiled) -> tuple[int, list[int]]:
    """(total matches, documents that have each positive term's lexemes), in one aggregate over visible documents."""
    row = found.agg(F.count_if("matched").alias("n"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"n{i}") for i in range(compiled.n_positive)]).first()
    return row["n"], [row[f"n{i}"] for i in range(compiled.n_positive)]


def ranked(found: DataFrame, compiled: Compiled, counts: Sequence[int], size: int) -> DataFrame:
    """Matches in order: all terms first, then rank, then the newest, then the least id."""
    return found.where("matched").withColumn("rank", compiled.rank(counts, size)).orderBy(F.desc("all_match"), F.desc("rank"), F.desc("modified_time"), F.asc("id"))
