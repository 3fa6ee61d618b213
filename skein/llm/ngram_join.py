"""Operator 2, n-gram Jaccard join: rare-prefix, size-banded tiles with place and bitmap bounds, then exact intersection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import sketch
from skein.llm.common import checkpoint, few, mix, shingle_sets, table, text_chunks, word_hashes, word_rows

_U = np.uint64
#: Longs of a set's bitmap signature.
LANES = 8
#: Most cells of the sketch over all shingles, 32 MB of flags "in two sets or more" and 32 MB of levels; most bits of flags over the sets' rarest shingles, 64 MB.
MAX_ORDER_BITS, MAX_FLAG_BITS = 28, 29
#: Sets of a tile that are compared in one task with as many others.
BLOCK = 256


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, list[bytes], np.ndarray, list[np.ndarray]]]:
    """(first row, words, first, sets) of each chunk of texts, A-Z lower-cased: sorted distinct shingle hashes of each row."""
    for low, _, data, offsets in text_chunks(batch.column("text")):
        words, first = word_rows(data, offsets, lower=True)
        yield low, words, first, list(shingle_sets(word_hashes(words), first, n))


def _shingles(text: str, n: int) -> set[bytes]:
    """The shingles of one text themselves, their words joined by a space."""
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _least_overlap(size: int, num: int, den: int) -> int:
    """Shingles that a set of this size shares with any set that it links to: ceil(size * num / den)."""
    return -(-size * num // den)


def _lanes(grams: np.ndarray) -> list[int]:
    bits = np.zeros(64 * LANES, np.uint8)
    bits[(mix(grams) >> _U(64 - 9)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, size, key1, key2, single, tokens, lanes), checkpointed: of each text its set's size, a 128-bit digest of its words, the
    number of its shingles known to stand in no other set, those of its prefix after them, and its bitmap.

    The prefix is so many of a set's rarest shingles that linked sets have one in common. The order is the same for
    every set: single shingles, then by the level of the merged sketch, then by hash. However full the sketch
    is, a prefix is no longer than that, and as any order loses no link, only more sets share a shingle. A set
    of which so many shingles stand nowhere else that it can't link has no tokens. Flags are never too low, so
    no shared shingle is taken for a single one.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for *_, sets in _sets(batch, n):
            yield from sets

    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(n_bytes / 4, 4, 16, MAX_ORDER_BITS)
    order = spark.sparkContext.broadcast(sketch.build_order(docs.select("text"), shingles, bits, partitions))
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("single", pa.int64()), ("tokens", pa.list_(pa.int64())), ("lanes", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, levels = order.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, words, first, sets in _sets(batch, n):
                again = sketch.flagged(flags, np.concatenate(sets))
                out, at = [], 0
                for r, grams in enumerate(sets):
                    shared = grams[again[at : at + len(grams)]]
                    at += len(grams)
                    single = len(grams) - len(shared)
                    places = len(grams) - _least_overlap(len(grams), num, den) + 1 - single
                    tokens = shared[np.argsort(sketch.level(levels, shared), kind="stable")[:places]] if places > 0 else shared[:0]
                    key = hashlib.blake2b(b" ".join(words[first[r] : first[r + 1]]), digest_size=16).digest()
                    key1, key2 = np.frombuffer(key, np.int64).tolist()
                    out.append({"doc_id": ids[low + r], "size": len(grams), "key1": key1, "key2": key2, "single": single, "tokens": tokens.view(np.int64).tolist(), "lanes": _lanes(grams) if len(tokens) else None})
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    signed = checkpoint(docs.mapInArrow(sign, "doc_id long, size long, key1 long, key2 long, single long, tokens array<long>, lanes array<long>"))
    order.destroy()  # the checkpoint is written; else the driver keeps a copy until it happens to collect its garbage
    return signed


def _flags(tokens: DataFrame, top: int) -> np.ndarray:
    """Bits that say which tokens, longs or arrays of them in the only column, come up ``top`` times or more; never too low."""
    kind = tokens.dtypes[0][1]
    total = tokens.agg(F.count("*") if kind == "bigint" else F.sum(F.size(tokens.columns[0]))).first()[0] or 0

    def items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        column = batch.column(0)
        yield (column if kind == "bigint" else column.flatten()).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)

    return sketch.build(tokens, items, 1, sketch.bits_for(total, 8, 16, MAX_FLAG_BITS), top, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _thinned(sets: DataFrame, flags: np.ndarray) -> DataFrame:
    """sets with those of their tokens, and the places beside them, that have their bit set; sets left with none go."""
    wanted = sets.sparkSession.sparkContext.broadcast(flags)
    names = sets.columns

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            values = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            keep = sketch.flagged(wanted.value, values.view(_U))
            ends = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
            offsets = pa.array(np.r_[0, np.r_[0, np.cumsum(keep)][ends]], pa.int32())
            out = {name: batch.column(name) for name in names}
            out["tokens"] = pa.ListArray.from_arrays(offsets, pa.array(values[keep]))
            out["places"] = pa.ListArray.from_arrays(offsets, batch.column("places").flatten().filter(pa.array(keep)))
            yield pa.record_batch(out).filter(pa.array(np.diff(offsets.to_numpy()) > 0))

    return sets.mapInArrow(thin, ", ".join(f"{name} {kind}" for name, kind in sets.dtypes))


def _exploded(sets: DataFrame, *columns: str) -> DataFrame:
    """A row for each token of sets, with its place in the order as pos."""
    both = F.explode(F.arrays_zip("tokens", "places")).alias("p")
    return sets.select(*columns, both).select(*columns, F.col("p.tokens").alias("token"), F.col("p.places").alias("pos"))


def _bound(size_a: Column, size_b: Column, lanes_a: list[Column], lanes_b: list[Column], num: int, den: int) -> Column:
    """Whether two sets can still link: each bit of one bitmap that the other lacks stands for a shingle that it lacks."""
    only_a = sum((F.bit_count(a.bitwiseAND(F.bitwise_not(b))) for a, b in zip(lanes_a[1:], lanes_b[1:], strict=True)), F.bit_count(lanes_a[0].bitwiseAND(F.bitwise_not(lanes_b[0]))))
    only_b = sum((F.bit_count(b.bitwiseAND(F.bitwise_not(a))) for a, b in zip(lanes_a[1:], lanes_b[1:], strict=True)), F.bit_count(lanes_b[0].bitwiseAND(F.bitwise_not(lanes_a[0]))))
    most = F.least(size_a - only_a, size_b - only_b)
    return (den * F.least(size_a, size_b) >= num * F.greatest(size_a, size_b)) & (den * most >= num * (size_a + size_b - most))


def _wide(grams: np.ndarray) -> bytes:
    """A bitmap with at least two bits a shingle, so that it tells large sets apart too; a power of two of bytes."""
    bits = max(6, int(2 * len(grams) - 1).bit_length())
    out = np.zeros(1 << bits, np.uint8)
    out[(mix(grams ^ _U(0x2545F4914F6CDD1D)) & _U((1 << bits) - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _wide_bound(x: bytes, y: bytes, size_a: int, size_b: int) -> int:
    """An upper bound of two sets' overlap; the longer bitmap is folded to the length of the other."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(size_a - int(np.bitwise_count(a & ~b).sum()), size_b - int(np.bitwise_count(b & ~a).sum()))


def _of_pairs(pairs: DataFrame, docs: DataFrame, value, kind: str, keep) -> DataFrame:
    """The pairs (a, b) that ``keep(value_a, value_b)`` is true of, with value(rows' texts) taken of the documents in some pair.

    A bounded bitmap of those ids keeps other documents out of the shuffle. An id with several texts has
    several values, and its pairs stay if any of them does.
    """
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))

    def numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column("doc_id").to_numpy().astype(np.int64).view(_U)

    wanted = spark.sparkContext.broadcast(sketch.build(ids, numbers, 1, 24, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("doc_id").to_numpy().astype(np.int64)
            batch = batch.filter(pa.array(sketch.flagged(wanted.value, own.view(_U))))
            if len(batch):
                yield from value(batch)

    of = docs.where("doc_id IS NOT NULL").mapInArrow(values, f"id long, value {kind}")
    both = pairs.join(of.select(F.col("id").alias("b"), F.col("value").alias("value_b")), "b").join(of.select(F.col("id").alias("a"), F.col("value").alias("value_a")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(keep(batch.column("value_a"), batch.column("value_b")), pa.bool_()))

    return both.select("a", "b", "value_a", "value_b").mapInArrow(check, "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets link: by wide bitmaps first, then by intersecting their sorted arrays.

    Texts travel for the second step, as they take half the room of their arrays.
    """

    def bitmaps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [len(grams).to_bytes(8, "little") + _wide(grams) for *_, sets in _sets(batch, n) for grams in sets]
        yield pa.record_batch({"id": batch.column("doc_id"), "value": pa.array(out, pa.binary())})

    def may_link(left: pa.Array, right: pa.Array) -> list[bool]:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
            a, b = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
            most = _wide_bound(x[8:], y[8:], a, b)
            out.append(den * most >= num * (a + b - most))
        return out

    def texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"id": batch.column("doc_id"), "value": batch.column("text")})

    def link(left: pa.Array, right: pa.Array) -> list[bool]:
        out = []
        held: tuple[str | None, np.ndarray, set[bytes]] = (None, np.zeros(0, _U), set())  # pairs come in runs of one document
        for x, y in zip(left, right, strict=True):
            x, y = x.as_py(), y.as_py()
            if x != held[0]:
                held = x, _array(x), _shingles(x, n)
            a, b = held[1], _array(y)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            alike = den * shared >= num * (len(a) + len(b) - shared)
            if alike:  # by hashes; now by the words themselves
                shared = len(held[2] & _shingles(y, n))
                alike = den * shared >= num * (len(a) + len(b) - shared)
            out.append(alike)
        return out

    def _array(text: str) -> np.ndarray:
        return next(sets[0] for *_, sets in _sets(pa.record_batch({"text": pa.array([text])}), n))

    close = checkpoint(_of_pairs(pairs, docs, bitmaps, "binary", may_link), small=True)
    return _of_pairs(close, docs, texts, "string", link)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each id of the different edges (v, u), v > u, has one edge to a smaller id alone, or edges to larger ones alone."""
    ends = edges.select(F.col("v").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("u", F.lit(0), F.lit(1)))
    ids = few(ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")))
    return ids.where("up + down > 1").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of the links (a, b) reaches, by alternating star contractions.

    A step joins each node to the least of its neighbours; stars are never gathered in a row, so a node with
    very many links costs partial aggregates only. Ends when the edges are stars around the least id of each:
    a round would then change nothing.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), small=True)
    while not _are_stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Larger neighbours go to the least one of the neighbourhood.
        large = few(both.where("v > u").join(least, "u").select(F.col("v").alias("v"), F.col("m").alias("u")))
        # Then smaller neighbours and the node itself do.
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = few(large.join(small_least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v > u")).union(few(small_least.select("v", F.col("m").alias("u"))))
        edges = checkpoint(small.distinct(), small=True)
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component"))


def _reachable(size_a: Column, size_b: Column, pos_a: Column, pos_b: Column, num: int, den: int) -> Column:
    """Whether two sets can still link if the shingle at these places is the first that they share: what comes after it bounds the rest."""
    most = 1 + F.least(size_a - pos_a - 1, size_b - pos_b - 1)
    return (num + den) * most >= num * (size_a + size_b)


def ngram_jaccard(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: classes of near-duplicate texts.

    Two texts link if their sets of distinct n-word shingles, A-Z lower-cased, have den * intersection >= num *
    union; component_id is the least doc_id reachable by links. No link between different texts is missed:

    1. Texts of the same words are one set, held by the least doc_id that has it.
    2. Linked sets share one of their rarest shingles, in one order for all sets (prefix filter). All sets
       with a shingle in their prefix are a tile. Each is compared with the tile's least set, which gives as
       many pairs as rows.
    3. Components of these links. In a tile that still has several, sets of different components are
       compared in blocks, if their size bands are equal or adjacent.
    4. A pair is made only where the places of the tile's shingle in both orders leave enough shingles to
       link (the first one that linked sets share does), and goes on only if it passes the bitmap bound.
    5. The shingles' words are then compared, not their hashes.

    A null text, or one without words, has no shingles and is alone. A row with null doc_id has null
    component_id. Rows that share a doc_id are one node, which links with all that its texts link with. Other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_rows = _signatures(docs, n, num, den)
    rows = all_rows.where("doc_id IS NOT NULL AND size > 0")
    holders = rows.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    several = rows.groupBy("doc_id").agg(F.min(F.struct("key1", "key2")).alias("k0"), F.max(F.struct("key1", "key2")).alias("k1")).where("k0 <> k1").select("doc_id")
    same_id = rows.select("doc_id", "key1", "key2").join(several, "doc_id").join(holders, ["key1", "key2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(den / num)) + 1e-9).cast("int")
    # Shingles that stand in one prefix only make no tile.
    marked = rows.where("size(tokens) > 0").withColumn("places", F.transform("tokens", lambda _, i: F.col("single") + i)).drop("single")
    marked = _thinned(marked, _flags(marked.select("tokens"), 2))
    # One row for each set; a doc_id with several texts brings several.
    sets = marked.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "size", "lanes", "tokens", "places")).alias("s")).select("s.*")
    sets = checkpoint(sets.select("doc_id", "size", band.alias("band"), "tokens", "places", *[F.col("lanes")[i].alias(f"l{i}") for i in range(LANES)]), small=True)
    lanes = [f"l{i}" for i in range(LANES)]
    tokens = _exploded(sets, "doc_id", "size")
    tiles = tokens.groupBy("token").agg(F.min(F.struct("doc_id", "size", "pos")).alias("first"), F.max("doc_id").alias("most")).where("first.doc_id < most").select("token", "first")
    tiles = checkpoint(tiles, small=True)  # a plain input of the join, which can then deal out anew what belongs to a very common shingle
    tiled = _thinned(sets, _flags(tiles.select("token"), 1))
    tokens = _exploded(tiled, "doc_id", "size")
    met = tokens.withColumnRenamed("doc_id", "b").join(tiles, "token").where((F.col("first.doc_id") < F.col("b")) & _reachable(F.col("first.size"), F.col("size"), F.col("first.pos"), F.col("pos"), num, den))
    stars = met.select(F.col("first.doc_id").alias("a"), "b").distinct()

    def side(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("size").alias(f"size_{name}"), *[F.col(x).alias(f"{x}_{name}") for x in lanes])

    def lane(name: str) -> list[Column]:
        return [F.col(f"{x}_{name}") for x in lanes]

    possible = _bound(F.col("size_a"), F.col("size_b"), lane("a"), lane("b"), num, den)
    pairs = checkpoint(stars.join(side("b"), "b").join(side("a"), "a").where(possible).select("a", "b"), small=True)
    first = checkpoint(_verified(pairs, docs, n, num, den).union(same_id), small=True)
    so_far = components(first)
    # Tiles whose sets are not yet of one component.
    known = tiled.join(so_far.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    slim = known.select("component", F.explode("tokens").alias("token"))
    open_ = checkpoint(slim.groupBy("token").agg(F.count("*").alias("k"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("token", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")), small=True)
    members = _exploded(_thinned(known, _flags(open_.select("token"), 1)), "doc_id", "component", "size", "band", *lanes)
    members = members.join(open_, "token").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # A set meets each block of its tile once: the pair of blocks (i, j), i <= j, is a key of its own.
    cut = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    own = ["block", "band", "component", "size", "pos", *lanes]
    left = cut.select("token", "i", "j", F.col("doc_id").alias("a"), *[F.col(x).alias(f"{x}_a") for x in own])
    right = cut.select("token", "i", "j", F.col("doc_id").alias("b"), *[F.col(x).alias(f"{x}_b") for x in own])
    crossed = (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & (F.abs(F.col("band_a") - F.col("band_b")) <= 1)
    crossed &= _reachable(F.col("size_a"), F.col("size_b"), F.col("pos_a"), F.col("pos_b"), num, den)
    blocks_met = (F.col("block_a") + F.col("block_b")) == (F.col("i") + F.col("j"))
    more = left.join(right, ["token", "i", "j"]).where(crossed & blocks_met & possible).select("a", "b").distinct()
    second = _verified(checkpoint(more, small=True), docs, n, num, den)
    reached = components(first.union(second))
    named = holders.join(reached.withColumnRenamed("id", "rep"), "rep", "left").select("key1", "key2", F.coalesce("component", "rep").alias("component"))
    placed = all_rows.select("doc_id", "size", "key1", "key2").join(named, ["key1", "key2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("size") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return placed.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose doc_id is the least of its class, and those with null doc_id; columns of docs stay."""
    gone = ngram_jaccard(docs, n, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), 4, 85, 100)


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS s FROM d),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT d.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN z ON d.doc_id = z.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""
