"""From incoming documents to index tables: documents, postings, surface words, vocabulary. All as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from skein.access import document_tokens_column
from skein.functions import text as T
from skein.functions.analyzer import has_stemmer, is_stop_word, stems, stop_words
from skein.model import CONTENT, FULL, META, PARTS
from skein.operators.language import detect
from skein.settings import CONTENT_LIMIT, Settings
from skein.sources.extract import cut_bytes, extracted

TAGS_CAP, MAX_POSITION, MAX_POSITIONS = 65_536, 16_383, 255
WEIGHTS = ("A", "B", "C", "D")
#: In JSON text; after an odd number of backslashes only.
ESCAPED_NUL = r"(?<!\\)((?:\\\\)*)\\u0000"


def strings(column: str) -> Column:
    """A list of strings without NULs, empties and repeats; null gives the empty list."""
    clean = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.translate(x, "\0", ""))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))


def sub_tags(column: str) -> Column:
    """source -> tags, cleaned."""
    entries = F.transform(F.map_entries(F.coalesce(column, F.create_map().cast("map<string,array<string>>"))), lambda e: F.struct(F.translate(e["key"], "\0", "").alias("key"), F.array_distinct(F.filter(e["value"], lambda x: x.isNotNull() & (x != ""))).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["key"] != ""))


def sub_tags_of_list(column: str) -> Column:
    """The map from a list of ``source_tag`` strings, cut at the first underscore; strings without one have an empty source and go."""
    pairs = F.transform(F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.instr(x, "_") > 1), lambda x: F.struct(F.split(x, "_", 2)[0].alias("k"), F.split(x, "_", 2)[1].alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    values = F.transform(keys, lambda k: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))
    return F.map_from_arrays(keys, values)


def flat_sub_tags(column: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.map_entries(column), lambda e: F.transform(e["value"], lambda t: F.concat(e["key"], F.lit("_"), t)))))


def cap_parts(parts: Column, budget: int) -> Column:
    """Named texts, cut in order once their bytes reach the budget."""
    start = F.struct(F.lit(budget).cast("int").alias("left"), F.array().cast("array<struct<key:string,value:string>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        value = cut_bytes(F.coalesce(e["value"], F.lit("")), a["left"])
        return F.struct((a["left"] - F.octet_length(value)).cast("int").alias("left"), F.array_append(a["out"], F.struct(e["key"].alias("key"), value.alias("value"))).alias("out"))

    return F.map_from_entries(F.aggregate(F.map_entries(parts), start, step, lambda a: a["out"]))


def index_rows(incoming: DataFrame, settings: Settings, now: int, plain: bool = False) -> DataFrame:
    """Rows of the documents table without id, plus the flags ``new_content`` and ``new_parts``.

    Content is decoded, recognised and cleaned; a document whose content cannot be read keeps its other
    fields and gets a warning, and never fails the batch. plain: content is known to be plain text, of which all is
    kept: it is neither decoded nor searched for markup nor cut, and a missing one stays missing.
    """
    cap = settings.max_content_size or CONTENT_LIMIT
    status = F.coalesce("status", F.lit(FULL))
    if isinstance(incoming.schema["subtags"].dataType, ArrayType):
        incoming = incoming.withColumn("subtags", sub_tags_of_list("subtags"))
    every = (status.bitwiseAND(F.lit(META | CONTENT | PARTS | 1))) == 0
    df = incoming.withColumns({
        "new_content": every | (status.bitwiseAND(F.lit(CONTENT)) != 0),
        "new_parts": every | (status.bitwiseAND(F.lit(PARTS)) != 0),
        "title": F.translate(F.coalesce("title", F.lit("")), "\0", ""),
        "owner_id": F.translate(F.coalesce("owner", F.lit("")), "\0", ""),
        "access": document_tokens_column(F.col("owner"), F.col("users"), F.col("groups"), F.col("circles")),
        **{c: strings(c) for c in ("links", "tags", "metatags")},
        "subtags_map": sub_tags("subtags"),
        "source": F.coalesce("source", F.lit("")),
        "hash": F.md5("content") if plain else F.when(F.coalesce("content", F.lit("")) != "", F.md5(F.col("content"))).otherwise(F.lit("")),
        "modified_time": F.coalesce("modified_time", F.lit(0)).cast("long"),
        "indexed_at": F.lit(now).cast("long"),
        "parts": cap_parts(F.transform_values(F.coalesce("parts", F.create_map().cast("map<string,string>")), lambda k, v: T.squeeze(F.translate(F.coalesce(v, F.lit("")), "\0", " "))), cap),
        "info": F.regexp_replace(F.translate(F.coalesce("info", F.lit("{}")), "\0", ""), ESCAPED_NUL, "$1"),
    })
    df = df.withColumns({
        "subtags": flat_sub_tags("subtags_map"),
        "tags_text": cut_bytes(F.array_join(F.concat("tags", "metatags"), " "), F.lit(TAGS_CAP)),
        "parts_text": F.array_join(F.filter(F.map_values("parts"), lambda x: x != ""), " "),
        "read": F.when(F.col("new_content"), F.struct(T.squeeze(F.col("content")).alias("text"), F.lit("").alias("warning")) if plain else extracted(F.col("content"), F.coalesce("encoded", F.lit(False)), F.col("title"), settings)),
    })
    read = F.when(F.col("new_content"), F.col("read.text")).otherwise(F.lit("")) if plain else F.coalesce("read.text", F.lit(""))
    df = df.withColumns({"content": read, "warning": F.coalesce("read.warning", F.lit(""))})
    df = df.withColumn("config", detect(F.col("content"), F.col("parts_text"), F.col("title"), settings.languages))
    return df.withColumn("title_search", T.lower(T.turkish(F.col("title"), F.col("config")))).select(
        "provider_id", "document_id", "owner_id", "access", "links", "tags", "metatags", "subtags", "subtags_map", "source", "hash", "modified_time", "indexed_at", "config",
        "title", "tags_text", "parts", "parts_text", "content", "info", "title_search", "warning", "new_content", "new_parts",
    )


def vector_bytes(*texts: Column) -> Column:
    """About the bytes that texts take in postings: each distinct token, and two for each occurrence."""
    own = T.tokens(F.concat_ws(" ", *texts))
    return F.aggregate(F.array_distinct(own), F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 4) + 2 * F.size(own)


def degrade(rows: DataFrame, limit: int) -> DataFrame:
    """Index rows, those over the limit cut by the first step that is enough: content halved, quartered, dropped; parts to 64 KB; tags to 16 KB and title to 4000 characters."""
    content, parts, tags, title = F.col("content"), F.col("parts_text"), F.col("tags_text"), F.col("title")
    half = lambda k: cut_bytes(content, F.floor(F.octet_length(content) / k).cast("int"))
    none, short = F.lit(""), (cut_bytes(parts, F.lit(65_536)), cut_bytes(tags, F.lit(16_384)), F.substring(title, 1, 4000))
    steps = [
        (content, parts, tags, title, ""), (half(2), parts, tags, title, "content cut to a half"), (half(4), parts, tags, title, "content cut to a quarter"), (none, parts, tags, title, "content left out"),
        (none, short[0], tags, title, "content left out, parts cut"), (none, *short, "content left out, parts, tags and title cut"),
    ]
    pick = None
    for c, p, g, t, said in reversed(steps):
        own = F.struct(c.alias("content"), p.alias("parts_text"), g.alias("tags_text"), t.alias("title"), F.concat_ws("; ", F.nullif("warning", F.lit("")), F.nullif(F.lit(said), F.lit(""))).alias("warning"))
        pick = own if pick is None else F.when(vector_bytes(t, t, g, p, c) <= limit, own).otherwise(pick)
    names = ("content", "parts_text", "tags_text", "title", "warning")
    return rows.withColumn("_pick", pick).withColumns({n: F.col(f"_pick.{n}") for n in names}).select(*rows.columns)


def latest(incoming: DataFrame, order: str = "indexed_at") -> DataFrame:
    """The last row of each key, by a column of arrival."""
    w = Window.partitionBy("provider_id", "document_id").orderBy(F.desc(order))
    return incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_ids(rows: DataFrame, base: int) -> DataFrame:
    """rows, already on disk, with ids from base + 1 on in key order: counts of range partitions give each its first id."""
    placed = rows.repartitionByRange("provider_id", "document_id").withColumn("_p", F.spark_partition_id())
    counts = placed.groupBy("_p").count().withColumn("_before", F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # one row for each partition
    within = Window.partitionBy("_p").orderBy("provider_id", "document_id")
    return placed.withColumn("_n", F.row_number().over(within)).join(F.broadcast(counts.select("_p", F.coalesce("_before", F.lit(0)).alias("_before"))), "_p").withColumn("id", (F.lit(base) + F.col("_before") + F.col("_n")).cast("long")).drop("_p", "_n", "_before")


def of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The docs of (provider_id, document_id) in keys, which may name absent ones and repeat."""
    own = keys.select("provider_id", "document_id")
    return docs.join(own, ["provider_id", "document_id"], "left_semi")


def of_provider(docs: DataFrame, provider: str) -> DataFrame:
    return docs.where(F.col("provider_id") == provider)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for those whose id is in gone."""
    return docs.join(gone.select("id"), "id", "left_anti")


def by_language(docs: DataFrame) -> DataFrame:
    """config and count, most documents first."""
    return docs.groupBy("config").count().orderBy(F.desc("count"), "config")


def upsert(old: DataFrame, new: DataFrame, max_id: int) -> DataFrame:
    """Documents after a batch: matched rows keep their id, and content or parts that the batch doesn't replace; others are added."""
    keys = ["provider_id", "document_id"]
    both = new.alias("n").join(old.alias("o"), keys, "left")
    columns = [c for c in old.columns if c not in ("id", *keys)]
    kept = F.col("o.id").isNotNull()

    def pick(c: str) -> Column:
        if c in ("content", "config", "hash", "warning"):
            return F.when(kept & ~F.col("n.new_content"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c in ("parts", "parts_text"):
            return F.when(kept & ~F.col("n.new_parts"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        if c == "title_search":
            config = F.when(kept & ~F.col("n.new_content"), F.col("o.config")).otherwise(F.col("n.config"))
            return T.lower(T.turkish(F.col("n.title"), config))
        return F.col(f"n.{c}")

    merged = both.select(F.col("o.id").alias("id"), *keys, *[pick(c).alias(c) for c in columns])
    rest = old.join(new.select(*keys), keys, "left_anti").select("id", *keys, *columns)
    fresh = with_ids(merged.where("id IS NULL").drop("id"), max_id).select("id", *keys, *columns)
    return rest.unionByName(merged.where("id IS NOT NULL")).unionByName(fresh)


def _tokens(text: Column) -> Column:
    return T.tokens(T.turkish(F.coalesce(text, F.lit("")), F.col("config")))


def _fields() -> list[tuple[str, list[Column]]]:
    """Weight and tokens of each field, in order. Titles come twice, as written and split at punctuation and between letters and digits."""
    title = F.col("title")
    return [("A", [_tokens(title), _tokens(T.split_title(title))]), ("B", [_tokens(F.col("tags_text"))]), ("C", [_tokens(F.col("parts_text"))]), ("D", [_tokens(F.col("content"))])]


def _stream(weights: Sequence[str]) -> Column:
    """A document's (token, weight, pos) in the fields of these weights; positions count from 1 through all fields, so only fields after the last one wanted are left alone."""
    fields = _fields()
    while fields and fields[-1][0] not in weights:
        fields.pop()

    def weighed(weight: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(weight).alias("weight")))

    placed = F.transform(F.concat(*[weighed(w, c) for w, columns in fields for c in columns]), lambda t, i: F.struct(t["token"].alias("token"), t["weight"].alias("weight"), F.least(i + 1, F.lit(MAX_POSITION)).alias("pos")))
    return placed if all(w in weights for w, _ in fields) else F.filter(placed, lambda t: t["weight"].isin(list(weights)))


def _grouped(docs: DataFrame, languages: list[str], weights: Sequence[str], words: bool, wanted: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(id, config, lexeme, weight, positions, first), and words if asked for: the lexemes of each row, grouped where it is.

    A row's tokens are sorted in an array, and runs of one lexeme and weight become rows, so memory is bounded by the
    largest document, and nothing is shuffled or spilled. first says that no run before has the lexeme.
    """
    rows = docs.select("id", "config", _stream(weights).alias("_t"))
    if stemmed := has_stemmer(languages):
        rows = rows.withColumn("_x", stems(F.transform("_t", lambda t: t["token"]), F.col("config"), languages))
    stops = any(stop_words(x) for x in languages)

    def placed(t: Column, i: Column) -> Column:
        lexeme = F.get("_x", i) if stemmed else t["token"]
        if stops:
            lexeme = F.when(~is_stop_word(t["token"], F.col("config"), languages), lexeme)
        return F.struct(lexeme.alias("lexeme"), t["weight"].alias("weight"), t["pos"].alias("pos"), *([t["token"].alias("token")] if words else []))

    own = F.transform("_t", placed)
    if wanted:
        own = F.filter(own, lambda x: wanted(x["lexeme"], F.col("config")))
    rows = rows.select("id", "config", F.sort_array(own).alias("_s"))
    at = lambda i: F.get("_s", i)
    new = lambda i: (i == 0) | ~at(i)["lexeme"].eqNullSafe(at(i - 1)["lexeme"])
    rows = rows.withColumn("_b", F.filter(F.transform("_s", lambda x, i: F.when(new(i) | (x["weight"] != at(i - 1)["weight"]), i)), lambda i: i.isNotNull()))

    def run(b: Column, k: Column) -> Column:
        places = F.sequence(b, F.coalesce(F.get("_b", k + 1), F.size("_s")) - 1)
        own = [F.array_distinct(F.transform(places, lambda j: at(j)["token"])).alias("words")] if words else []
        return F.struct(at(b)["lexeme"].alias("lexeme"), at(b)["weight"].alias("weight"), capped(F.transform(places, lambda j: at(j)["pos"])).alias("positions"), new(b).alias("first"), *own)

    # explode_outer: the plain one would have the optimizer compute every array twice, once to test for emptiness.
    return rows.select("id", "config", F.explode_outer(F.transform("_b", run)).alias("_g")).where("_g IS NOT NULL").select("id", "config", "_g.*")


def capped(positions: Column) -> Column:
    """Ascending positions without repeats, the first MAX_POSITIONS."""
    return F.slice(F.array_distinct(positions), 1, MAX_POSITIONS).cast("array<int>")


def terms(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(id, config, lexeme, weight, positions, words): what postings and surface words derive from; lexeme is null for stop words.

    Positions ascend and are capped. One row a document, with an id of its own; no shuffle.
    """
    return _grouped(docs, languages, WEIGHTS, True).select("id", "config", "lexeme", "weight", "positions", "words")


def postings(docs: DataFrame, languages: list[str], weights: Sequence[str] = WEIGHTS, wanted: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(lexeme, config, id, weight, positions): stop words gone, words stemmed, positions ascending and capped.

    Fields of other weights are not read; wanted(lexeme, config) leaves out other lexemes before they are sorted.
    """
    return postings_of(_grouped(docs, languages, weights, False, wanted))


def tokens_of(docs: DataFrame, weight: str) -> DataFrame:
    """(lexeme, id): postings of one weight without languages, places left out; each token of a row once."""
    own = F.array_distinct(F.concat(*dict(_fields())[weight]))
    return docs.select("id", F.explode_outer(own).alias("lexeme")).where("lexeme IS NOT NULL").select("lexeme", "id")


def postings_of(terms_: DataFrame) -> DataFrame:
    return terms_.where("lexeme IS NOT NULL").select("lexeme", "config", "id", "weight", "positions")


def merged(postings_: DataFrame) -> DataFrame:
    """Postings of rows that share an id, as those of one document."""
    at = F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions"))))
    return postings_.groupBy("lexeme", "config", "id", "weight").agg(capped(at).alias("positions"))


def document_frequency(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(lexeme, documents, occurrences). Each document says once that it has a lexeme, so sums of what it says are enough: words move, not their documents."""
    own = _grouped(docs, languages, WEIGHTS, False).where("lexeme IS NOT NULL")
    return own.groupBy("lexeme").agg(F.count_if("first").alias("documents"), F.sum(F.size("positions")).cast("long").alias("occurrences"))


def _surface_words(columns: Sequence[Column]) -> Column:
    return F.array_distinct(F.filter(F.concat(*columns), T.is_vocabulary_word))


def surface(docs: DataFrame) -> DataFrame:
    """(word, config, id, weight): unstemmed words of letters alone, for expansion and its visibility probe."""
    fields = F.array(*[F.struct(F.lit(w).alias("weight"), _surface_words(columns).alias("words")) for w, columns in _fields()])
    each = docs.select("id", "config", F.explode_outer(fields).alias("f")).select("id", "config", F.col("f.weight").alias("weight"), F.explode_outer("f.words").alias("word"))
    return each.where("word IS NOT NULL").select("word", "config", "id", "weight")


def surface_of(terms_: DataFrame) -> DataFrame:
    """The same of terms, where each word of a document's field stands once."""
    return terms_.select(F.explode("words").alias("word"), "config", "id", "weight").where(T.is_vocabulary_word(F.col("word")))


def vocabulary(words: DataFrame) -> DataFrame:
    return words.select("word").distinct().withColumn("folded", T.fold(F.col("word")))


def vocabulary_of(docs: DataFrame) -> DataFrame:
    """The vocabulary of raw texts, without the surface words of each document."""
    own = _surface_words([c for _, columns in _fields() for c in columns])
    return vocabulary(docs.select(F.explode_outer(own).alias("word")).where("word IS NOT NULL"))
