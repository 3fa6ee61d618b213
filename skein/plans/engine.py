"""The engine: index, change, search and inspect documents. One object for one index folder."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.access import Access, viewer_tokens
from skein.functions.analyzer import stop_words
from skein.functions import text as T
from skein.functions.text import lower_text
from skein.model import DOCUMENT, POSTING, SURFACE, WORD, SearchRequest, SearchResult
from skein.operators import expand, filters
from skein.operators.excerpt import excerpts, preview
from skein.operators.language import detect
from skein.operators.match import Compiled, candidates, frequencies, ranked
from skein.operators.query import Query, parse
from skein.plans import build
from skein.plans.store import Conflict, Incomplete, Outdated, Snapshot, Store
from skein.settings import Settings

TITLE_SIMILARITY = 0.6
#: States that a change is tried on before it gives up against other writers.
ATTEMPTS = 5
_SCHEMAS = {"docs": DOCUMENT, "postings": POSTING, "surface": SURFACE, "words": WORD}


class NotFound(KeyError):
    pass


class Engine:
    id, name = "skein", "Full-text search on Spark"

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        """Without settings, those that the index was last written or configured with."""
        self.spark, self.store = spark, Store(spark, path)
        if settings is None and self.store.exists():
            stored = self.store.meta().get("settings", {})
            settings = Settings(**{f.name: stored[f.name] for f in fields(Settings) if f.name in stored})
        self.settings = (settings or Settings()).clamped()

    # -- administration

    def initialize(self) -> None:
        """Create what is missing; build derived tables anew if they are of another version or one of them is gone."""
        if not self.store.exists():
            places = self.store.add({n: self.spark.createDataFrame([], s) for n, s in _SCHEMAS.items()})
            try:
                self.store.commit(None, places, n_docs=0, max_id=0, settings=asdict(self.settings))
            except Conflict:  # another one has just created it
                self.store.check()
            return
        try:
            self.store.check()
        except (Outdated, Incomplete):
            if not self.store.present()["docs"]:
                raise  # all else derives from the documents
            old = Snapshot(self.store, self.store.meta())
            self._write(old, old.table("docs"), old.meta.get("max_id", 0))

    def load(self) -> None:
        """Make sure the index can be used: create it if absent, refuse one of another version or with a table gone."""
        self.store.check() if self.store.exists() else self.initialize()

    def test(self) -> bool:
        self.load()
        return self.store.table("docs").schema.fieldNames() != []

    def drop(self) -> None:
        self.store.drop()

    def configuration(self) -> dict:
        return asdict(self.settings)

    def configure(self, values: Mapping[str, object]) -> bool:
        """Change settings, all or none, and keep them with the index; True if documents must be indexed anew for a changed language."""
        new, changed = self.settings.changed(values)
        self.load()
        self._changing(lambda snap: self.store.commit(snap, {}, settings=asdict(new)))
        self.settings = new
        return changed

    def status(self) -> dict:
        """Counts and capabilities; a part that cannot be read is None."""

        def tried(f):
            try:
                return f()
            except Exception:  # a broken part must not hide the others
                return None

        return {
            "documents": tried(lambda: self.store.table("docs").count()),
            "by_language": tried(lambda: {r["config"]: r["count"] for r in self.documents_by_language().collect()}),
            "words": tried(lambda: self.store.table("words").count()),
            "schema": tried(lambda: self.store.meta()["schema"]),
            "tables": tried(self.store.present),
            "trigram": self.settings.use_trigram,
            "typo_correction": self.settings.typo_correction,
        }

    def documents_by_language(self) -> DataFrame:
        return build.by_language(self.store.table("docs"))

    # -- changes

    def _changing(self, change: Callable[[Snapshot], None]) -> None:
        """Run a change on the current state; anew on the next one if another writer was first."""
        for attempt in range(ATTEMPTS):
            try:
                return change(self.store.snapshot())
            except Conflict:
                if attempt + 1 == ATTEMPTS:
                    raise

    def _write(self, snap: Snapshot, docs: DataFrame, max_id: int, changed: DataFrame | None = None) -> None:
        """The next state, from a plan for docs, which is written first and read back by all that derives from it.

        changed: (id) of documents that are new, different or gone. Only these are analysed; what the index has
        of the others is carried over. Without it, everything is built anew. Readers see all of it at once.
        """
        old = {n: snap.table(n) for n in ("postings", "surface", "words")} if changed is not None else {}
        places = self.store.add({"docs": docs})
        docs = self.store.read(places["docs"])
        facts = docs.agg(F.count("*").alias("n"), F.max("id").alias("m")).first()
        part = docs if changed is None else docs.join(changed, "id", "left_semi")
        with self._work() as work:
            # Texts are analysed once; both tables, and the samples that their order takes, come from what is on disk.
            build.terms(part.repartition("id"), self.settings.languages).write.parquet(work)
            terms = self.spark.read.parquet(work)
            tables = {"postings": build.postings_of(terms), "surface": build.surface_of(terms)}
            if changed is not None:
                tables = {n: old[n].join(changed, "id", "left_anti").select(*df.columns).unionByName(df) for n, df in tables.items()}
            places |= self.store.add(tables)
        surface = self.store.read(places["surface"])
        if changed is None:
            places |= self.store.add({"words": build.vocabulary(surface)})
        elif self.settings.typo_correction:
            fresh = build.vocabulary(surface.join(changed, "id", "left_semi"))
            # Words of texts that are gone stay until the vocabulary is rebuilt.
            places |= self.store.add({"words": old["words"].unionByName(fresh.join(old["words"].select("word"), "word", "left_anti").select("word", "folded"))})
        self.store.commit(snap, places, n_docs=facts["n"], max_id=max(max_id, facts["m"] or 0), settings=asdict(self.settings))

    @contextmanager
    def _work(self) -> Iterator[str]:
        """A folder beside the tables that is gone afterwards, whatever happens."""
        path = f"{self.store.path}/_work-{uuid.uuid4().hex}"
        try:
            yield path
        finally:
            self.store._fs.delete(self.store._path(path), True)

    def index(self, incoming: DataFrame, now: int | None = None, max_vector_bytes: int = 0) -> None:
        """Add or change a batch of documents (model.INCOMING), each key once; see build.latest() for repeated keys.

        With max_vector_bytes, documents that would take more room in the index lose text step by step, and get a warning.
        """
        self.load()
        rows = build.index_rows(incoming, self.settings, int(time.time()) if now is None else now)
        if max_vector_bytes:
            rows = build.degrade(rows, max_vector_bytes)
        with self._work() as work:
            rows.write.parquet(f"{work}/new")  # extraction runs once, and ids are dealt out over what is on disk
            new = self.spark.read.parquet(f"{work}/new")

            def change(snap: Snapshot) -> None:
                build.upsert(snap.table("docs"), new, snap.meta["max_id"]).write.mode("overwrite").parquet(f"{work}/docs")
                docs = self.spark.read.parquet(f"{work}/docs")
                docs.join(new.select("provider_id", "document_id"), ["provider_id", "document_id"], "left_semi").select("id").write.mode("overwrite").parquet(f"{work}/ids")
                self._write(snap, docs, snap.meta["max_id"], self.spark.read.parquet(f"{work}/ids"))

            self._changing(change)

    def _remove(self, which: Callable[[DataFrame], DataFrame]) -> None:
        """Remove the rows of docs that ``which`` leaves of them."""

        def change(snap: Snapshot) -> None:
            with self._work() as work:
                which(snap.table("docs")).select("id").write.parquet(work)
                ids = self.spark.read.parquet(work)
                self._write(snap, build.without(snap.table("docs"), ids), snap.meta["max_id"], ids)

        self.load()
        self._changing(change)

    def delete(self, keys: DataFrame | Sequence[tuple[str, str]]) -> None:
        """Remove documents by (provider_id, document_id); absent ones are no error."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame(list(keys), "provider_id string, document_id string")
        self._remove(lambda docs: build.of_keys(docs, keys))

    def reset(self, provider: str) -> None:
        """Remove a provider's documents; ``all`` empties the index, its words too."""
        if provider == "all":
            self.load()
            places = self.store.add({n: self.spark.createDataFrame([], s) for n, s in _SCHEMAS.items()})
            self._changing(lambda snap: self.store.commit(snap, places, n_docs=0))
        else:
            self._remove(lambda docs: build.of_provider(docs, provider))

    def rebuild(self) -> None:
        """Everything derived from stored text, as after a change of language: detected languages, postings, words."""
        self.load()

        def change(snap: Snapshot) -> None:
            config = detect(F.col("content"), F.col("parts_text"), F.col("title"), self.settings.languages)
            docs = snap.table("docs").withColumn("config", config).withColumn("title_search", T.lower(T.turkish(F.col("title"), F.col("config"))))
            self._write(snap, docs, snap.meta["max_id"])

        self._changing(change)

    def rebuild_vocabulary(self) -> int:
        """The vocabulary of what is indexed now, without words of texts that are gone. Readers see the old one until it is done."""
        self.load()
        self._changing(lambda snap: self.store.commit(snap, self.store.add({"words": build.vocabulary(snap.table("surface"))})))
        return self.store.table("words").count()

    # -- reading

    def document(self, provider: str, document: str) -> dict:
        rows = self.store.table("docs").where((F.col("provider_id") == provider) & (F.col("document_id") == document)).limit(1).collect()
        if not rows:
            raise NotFound((provider, document))
        r = rows[0].asDict(recursive=True)
        own = {k: [t[2:] for t in r["access"] if t.startswith(k + ":")] for k in "ugc"}
        return {
            **{k: r[k] for k in ("provider_id", "document_id", "title", "content", "source", "hash", "modified_time", "links", "tags", "metatags", "parts", "info")},
            "owner": r["owner_id"], "users": [u for u in own["u"] if u != r["owner_id"]], "groups": own["g"], "circles": own["c"], "subtags": r["subtags_map"],
        }

    def alternatives(self, text: str, request: SearchRequest, access: Access) -> dict[str, list[str]]:
        """Accent variants and spelling corrections of the words of a text, as a search under the request would use them."""
        self.load()
        snap = self.store.snapshot()
        visible = filters.rows_of_request(snap.table("docs"), snap.table("postings"), request, viewer_tokens(access), self.settings.languages)
        words, weights = lower_text(text).split(), filters.weights(request.limit_fields)
        surface, vocabulary = snap.table("surface"), snap.table("words")
        variants = expand.accent_variants(words, vocabulary, surface, visible, weights)
        if self.settings.use_trigram:
            variants |= expand.corrections(words, list(variants), self.settings.languages, vocabulary, surface, visible, weights)
        return variants

    def search(self, request: SearchRequest, access: Access) -> SearchResult:
        """One page of documents that the viewer may see, best first, with the exact total."""
        began = time.time()
        tag = f"skein-{uuid.uuid4().hex}"
        timed_out = threading.Event()

        def stop() -> None:
            timed_out.set()
            self.spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.settings.search_timeout, stop) if self.settings.search_timeout else None
        self.spark.sparkContext.addJobTag(tag)
        if timer:
            timer.daemon = True
            timer.start()
        try:
            out = self._search(request, access)
        except Exception as e:
            if timed_out.is_set():
                out = SearchResult(timed_out=True)
            elif "PatternSyntaxException" in str(e) or "INVALID_PARAMETER_VALUE.PATTERN" in str(e):
                out = SearchResult()  # a pattern that only the regular-expression engine itself refuses
            else:
                raise
        finally:
            if timer:
                timer.cancel()
            self.spark.sparkContext.removeJobTag(tag)
        out.time_ms = int((time.time() - began) * 1000)
        return out

    def _search(self, request: SearchRequest, access: Access) -> SearchResult:
        self.load()
        tokens, weights = viewer_tokens(access), filters.weights(request.limit_fields)
        if not tokens or not weights:
            return SearchResult()
        size = min(max(1, request.size), self.settings.max_results)
        offset = min((max(1, request.page) - 1) * size, 2**31 - 1 - size)
        languages = self.settings.languages
        snap = self.store.snapshot()  # all that this search reads is of one state
        visible = filters.rows_of_request(snap.table("docs"), snap.table("postings"), request, tokens, languages)
        if not request.search.strip():
            return self._empty_search(visible, size, offset) if request.empty_search else SearchResult()
        queries = {l: parse(request.search, l) for l in languages}
        if any(q is None for q in queries.values()):
            return SearchResult()
        words = list(dict.fromkeys(w for q in queries.values() for w in q.words))
        surface, vocabulary = snap.table("surface"), snap.table("words")
        variants: dict[str, list[str]] = {}
        if self.settings.typo_correction and words:
            variants = expand.accent_variants(words, vocabulary, surface, visible, weights)
        found, total, rows = self._page(snap, visible, queries, weights, variants, size, offset, words)
        if self.settings.typo_correction and self.settings.use_trigram and offset == 0 and len(rows) < size and words:
            more = expand.corrections(words, list(variants), languages, vocabulary, surface, visible, weights)
            if more:
                variants = {**variants, **more}
                found, total, rows = self._page(snap, visible, queries, weights, variants, size, offset, words)
        if total == 0 and "A" in weights and self.settings.use_trigram and all(q.plain for q in queries.values()) and found:
            fallback = self._similar_titles(visible, " ".join(words), size, offset)
            if fallback.total:
                return fallback
        return self._shaped(rows, total, variants)

    def _page(self, snap: Snapshot, visible: DataFrame, queries: Mapping[str, Query], weights: Sequence[str], variants: Mapping[str, Sequence[str]], size: int, offset: int, words: Sequence[str]) -> tuple[bool, int, list]:
        """(whether the query can match at all, total, rows of the page)."""
        compiled = Compiled(queries, weights, variants)
        if not compiled.answerable:
            return False, 0, []
        narrow = visible.select("id", "config", "modified_time", "title_search")
        found = candidates(narrow, snap.table("postings"), compiled).persist()
        try:
            total, counts = frequencies(found, compiled)
            if total == 0 or offset >= total:
                return True, total, []
            page = ranked(found, compiled, counts, snap.meta["n_docs"]).offset(offset).limit(size).select("id", "all_match", "rank")
            ids = page.collect()  # one page
        finally:
            found.unpersist()
        order = {r["id"]: (n, r["rank"]) for n, r in enumerate(ids)}
        shown = [*words, *(w for v in variants.values() for w in v), *(lower_text(x) for q in queries.values() for t in q.positive if t.phrase for x in t.text.split())]
        full = snap.table("docs").where(F.col("id").isin(list(order)))
        full = full.select("id", "provider_id", "document_id", "title", "source", "hash", "modified_time", excerpts(F.col("content"), F.col("parts_text"), F.col("config"), list(dict.fromkeys(shown)), weights).alias("excerpts"))
        rows = [{**r.asDict(recursive=True), "rank": order[r["id"]][1]} for r in full.collect()]
        return True, total, sorted(rows, key=lambda r: order[r["id"]][0])

    def _empty_search(self, visible: DataFrame, size: int, offset: int) -> SearchResult:
        page = visible.orderBy(F.desc("modified_time"), "id").offset(offset).limit(size)
        rows = [{**r.asDict(recursive=True), "rank": 0.0} for r in page.select("id", "provider_id", "document_id", "title", "source", "hash", "modified_time", preview(F.col("content")).alias("excerpts")).collect()]
        return self._shaped(sorted(rows, key=lambda r: (-r["modified_time"], r["id"])), visible.count(), {})

    def _similar_titles(self, visible: DataFrame, text: str, size: int, offset: int) -> SearchResult:
        """Titles with an extent like the typed words; not for stop words alone."""
        if not text or all(any(w in stop_words(x) for x in self.settings.languages) for w in text.split()):
            return SearchResult()
        close = expand.similar_titles(visible, text, TITLE_SIMILARITY).select("id", "modified_time", "alike").persist()
        try:
            total = close.count()
            best = close.orderBy(F.desc("alike"), F.desc("modified_time"), "id").offset(offset).limit(size).collect()
        finally:
            close.unpersist()
        order = {r["id"]: (n, r["alike"]) for n, r in enumerate(best)}
        page = visible.where(F.col("id").isin(list(order))).select("id", "provider_id", "document_id", "title", "source", "hash", "modified_time", preview(F.col("content")).alias("excerpts"))
        rows = [{**r.asDict(recursive=True), "rank": order[r["id"]][1]} for r in page.collect()] if order else []
        rows.sort(key=lambda r: order[r["id"]][0])
        return self._shaped(rows, total, {})

    @staticmethod
    def _shaped(rows: Sequence[dict], total: int, variants: Mapping[str, Sequence[str]]) -> SearchResult:
        docs = [{**{k: v for k, v in r.items() if k not in ("id", "rank")}, "score": f"{round(r['rank'] * 100, 2):g}"} for r in rows]
        best = max((-(-r["rank"] * 100 // 1) for r in rows), default=0)
        return SearchResult(docs, total, int(best), alternatives=dict(variants))


def with_settings(engine: Engine, **values: object) -> Engine:
    """The same index under other settings."""
    out = Engine(engine.spark, engine.store.path)
    out.settings = replace(engine.settings, **values)
    return out
