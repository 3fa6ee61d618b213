"""Operator 10, benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import sketch
from skein.llm.common import NOT_ALNUM, checkpoint, gram_hashes, mix, table, text_chunks, word_hashes, word_rows

_U = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of windows with similarity 0.8 differ in 13 of 64 bits on average, in more than 22 for about one in 500;
#: a passage has many windows.
RADIUS = 22
#: Bytes of a fingerprint are its blocks.
BLOCKS = 8
#: Words of items that one pass over the documents looks for; a larger benchmark takes more passes, with the same results.
ITEM_WORDS = 1_000_000
#: Most cells of the sketch of the benchmark's shingle counts that weighs shingles in fingerprints, 16 MB.
MAX_COUNT_BITS = 22
MATCH = "doc_id long, item_id long, first_word long, n_words long, similarity double"
_BITS = np.arange(64, dtype=_U)
_POPCOUNT = np.array([bin(b).count("1") for b in range(256)])
#: An item: item_id, hashes of its shingles in order, weight of each different one.
Item = tuple[int | None, np.ndarray, dict[int, float]]


def _grams(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, q, hashes of the q-word shingles in order) of each text with a word; q is SHINGLE or the number of its words."""
    for low, _, data, offsets in text_chunks(batch.column("text")):
        words, first = word_rows(data, offsets, NOT_ALNUM, lower=True)
        hashes = word_hashes(words)
        for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            if b > a:
                q = min(SHINGLE, b - a)
                yield low + r, q, gram_hashes(hashes[a:b], q)


class _Blocks:
    """Multi-index of fingerprints: for each block and each value of it, the items that are near enough in that block.

    Of two fingerprints within ``radius`` bits, some block i differs in no more than t[i] bits, if the t[i] + 1
    add up to radius + 1; so the buckets of a window's own block values hold all items within the radius.
    """

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius, self.buckets = prints, radius, []
        for b in range(BLOCKS):
            bits = (radius + 1) // BLOCKS + (b < (radius + 1) % BLOCKS) - 1
            near = _POPCOUNT[np.arange(256)[:, None] ^ prints[None, :, b]] <= bits
            self.buckets.append((np.r_[0, np.cumsum(near.sum(axis=1))], np.nonzero(near)[1]))

    def within(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within the radius, in order."""
        found = []
        for b, (bounds, members) in enumerate(self.buckets):
            low = bounds[windows[:, b]]
            count = bounds[windows[:, b] + np.int64(1)] - low
            window = np.repeat(np.arange(len(windows)), count)
            place = np.arange(len(window)) + np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
            found.append(window * len(self.prints) + members[place])
        window, item = np.divmod(np.unique(np.concatenate(found)), len(self.prints))
        near = np.bitwise_count(windows[window] ^ self.prints[item]).sum(axis=1) <= self.radius
        return window[near], item[near]


class _Group:
    """The items of one pass that have q-word shingles, in kinds: number of shingles, mean weight and greatest weight in half octaves.

    A fingerprint depends on the kind and the whole benchmark's counts, not on what else the pass holds.
    """

    def __init__(self, q: int, items: list[Item], n_items: int, counts: np.ndarray, similarity: float, radius: int):
        self.q, self.n_items, self.counts = q, n_items, counts
        by_kind: dict[tuple[int, int, int], list[Item]] = {}
        for item in items:
            _, grams, weight = item
            mean = sum(weight[g] for g in grams.tolist()) / len(grams)
            by_kind.setdefault((len(grams), round(2 * math.log2(mean)), math.ceil(2 * math.log2(max(weight.values())) - 1e-9)), []).append(item)
        self.kinds = []
        places: dict[int, list[int]] = {}
        for k, ((size, mean_class, most_class), members) in enumerate(sorted(by_kind.items(), key=lambda x: x[0])):
            scale = (2 ** (mean_class / 2), 2 ** (most_class / 2))
            prints = np.concatenate([self.windows(self.sums(m[1], *scale), size) for m in members])
            tfs = [Counter(m[1].tolist()) for m in members]
            totals = [sum(n * m[2][g] for g, n in tf.items()) for m, tf in zip(members, tfs, strict=True)]
            heaviest = max(max(m[2].values()) for m in members)
            needed = max(1, math.ceil(similarity * min(totals) / heaviest - 1e-9))
            self.kinds.append((size, scale, members, tfs, totals, _Blocks(prints, radius), needed))
            for g in {g for tf in tfs for g in tf}:
                places.setdefault(g, []).append(k)
        self.known = np.sort(np.fromiter(places, _U, len(places)))
        of = [places[g] for g in self.known.tolist()]
        self.kind_bounds = np.r_[0, np.cumsum([len(x) for x in of])]
        self.kinds_of = np.array([k for x in of for k in x], np.int64)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.known >> _U(44)).astype(np.int64)] = True
        self.longest = max(kind[0] for kind in self.kinds)
        #: A window alike enough to some item has at least so many shingles of the pass.
        self.needed = min(kind[6] for kind in self.kinds)

    def sums(self, grams: np.ndarray, typical: float, most: float) -> np.ndarray:
        """Running sums of the weighted signs. A shingle unknown to the benchmark, or heavier than any of the items sought, weighs what is typical of those."""
        n = sketch.estimates(self.counts, grams ^ _U(self.q))
        weights = np.log1p(self.n_items / np.maximum(n, 1))
        weights = np.where((n > 0) & (weights <= most), weights, typical)
        signs = ((mix(grams)[:, None] >> _BITS) & _U(1)).astype(np.float64) * 2 - 1
        out = np.zeros((len(grams) + 1, 64))
        np.cumsum(np.round(signs * weights[:, None] * 1024), axis=0, out=out[1:])
        return out

    @staticmethod
    def windows(sums: np.ndarray, size: int) -> np.ndarray:
        """The 8 bytes of the SimHash of each run of ``size`` shingles."""
        return np.packbits(sums[size:] > sums[: len(sums) - size], axis=1)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, places in ``known``) of the shingles that some item of the pass has."""
        at = np.flatnonzero(self.gate[(grams >> _U(44)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.known, grams[at]), len(self.known) - 1)
        real = self.known[found] == grams[at]
        return at[real], found[real]

    def matches(self, grams: np.ndarray, hits: np.ndarray, known: np.ndarray, similarity: float) -> Iterator[tuple]:
        """(item_id, first shingle, shingles, similarity): the best window of each item found in one document."""
        # Only near shingles of the benchmark, and enough of them within an item's length, can a window be alike.
        last = hits[self.needed - 1 :]
        dense = hits[: len(last)][last - hits[: len(last)] < self.longest]
        regions: list[list[int]] = []
        for p in dense.tolist():
            if not regions or p - self.longest > regions[-1][1]:
                regions.append([max(0, p - self.longest), 0])
            regions[-1][1] = min(len(grams), p + 2 * self.longest)
        best: dict[tuple[int, int], tuple] = {}
        for low, high in regions:
            part = grams[low:high]
            inside = known[(hits >= low) & (hits < high)]
            counts = self.kind_bounds[inside + 1] - self.kind_bounds[inside]
            place = np.arange(counts.sum()) + np.repeat(self.kind_bounds[inside] - np.r_[0, np.cumsum(counts)[:-1]], counts)
            of_kind = np.bincount(self.kinds_of[place], minlength=len(self.kinds))
            held: dict[tuple[float, float], np.ndarray] = {}
            for k in np.flatnonzero(of_kind).tolist():
                size, scale, members, tfs, totals, blocks, needed = self.kinds[k]
                if of_kind[k] < needed:
                    continue
                if scale not in held:
                    held[scale] = self.sums(part, *scale)
                span = min(size, len(part))
                for w, i in zip(*[x.tolist() for x in blocks.within(self.windows(held[scale], span))], strict=True):
                    item_id, _, weight = members[i]
                    own = Counter(part[w : w + span].tolist())
                    alike = sum(weight[g] * min(n, own[g]) for g, n in tfs[i].items() if g in own) / totals[i]
                    if alike >= similarity - 1e-9 and ((k, i) not in best or alike > best[k, i][3] + 1e-12):
                        best[k, i] = (item_id, low + w, span, alike)
        yield from best.values()


class Index:
    """An index of some items: one group for each shingle length, SHINGLE or all the words of a shorter item."""

    def __init__(self, items: list[tuple[int, Item]], n_items: dict[int, int], counts: np.ndarray, similarity: float, radius: int):
        self.similarity = similarity
        by_q: dict[int, list[Item]] = {}
        for q, item in items:
            by_q.setdefault(q, []).append(item)
        self.groups = [_Group(q, own, n_items[q], counts, similarity, radius) for q, own in sorted(by_q.items())]

    def scan(self, column: pa.Array) -> Iterator[tuple]:
        """(row, item_id, first word, words, similarity) of every item found in a column of texts."""
        for low, _, data, offsets in text_chunks(column):
            words, first = word_rows(data, offsets, NOT_ALNUM, lower=True)
            hashes = word_hashes(words)
            for group in self.groups:
                grams = gram_hashes(hashes, group.q)
                at, known = group.hits(grams)
                row = np.searchsorted(first, at, "right") - 1
                inside = at + group.q <= first[row + 1]
                at, row, known = at[inside], row[inside], known[inside]
                bounds = np.searchsorted(row, np.arange(len(first)))
                for r in np.flatnonzero(np.diff(bounds) >= group.needed).tolist():
                    a, b = bounds[r], bounds[r + 1]
                    own = grams[first[r] : first[r + 1] - group.q + 1]
                    for item_id, begin, size, alike in group.matches(own, at[a:b] - first[r], known[a:b], self.similarity):
                        yield low + r, item_id, begin, size + group.q - 1, alike


def _weighed(benchmark: DataFrame) -> tuple[DataFrame, dict[int, int], np.ndarray]:
    """((item_id, q, grams, counts), items for each q, sketch): of the whole benchmark, how many items have each shingle.

    ``counts`` has structs (gram, n) of an item's different shingles, from an exact grouping; the sketch holds the same
    counts for documents' shingles in fingerprints. Rows of equal id and text are one item.
    """
    spark = benchmark.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_grams(batch))
            rows = pa.array([x[0] for x in found], pa.int64())
            yield pa.record_batch({
                "item_id": batch.column("item_id").take(rows), "digest": batch.column("digest").take(rows), "q": pa.array([x[1] for x in found], pa.int32()),
                "grams": pa.array([x[2].view(np.int64) for x in found], pa.list_(pa.int64())),
            })

    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    items = checkpoint(own.withColumn("digest", F.sha2("text", 256)).mapInArrow(split, "item_id long, digest string, q int, grams array<long>"))
    n_items = {r["q"]: r["n"] for r in items.groupBy("q").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    each = items.select("item_id", "digest", "q", F.explode(F.array_distinct("grams")).alias("gram"))
    times = each.groupBy("q", "gram").agg(F.count("*").alias("n"))
    counts = each.join(times, ["q", "gram"]).groupBy("item_id", "digest").agg(F.collect_list(F.struct("gram", "n")).alias("counts"))  # of one item
    rows = items.withColumnRenamed("digest", "d").withColumnRenamed("item_id", "i").join(counts, F.col("i").eqNullSafe(F.col("item_id")) & (F.col("d") == F.col("digest")))

    def tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for q, grams in zip(batch.column("q").to_pylist(), batch.column("grams"), strict=True):
            yield np.unique(np.asarray(grams.values, np.int64).view(_U)) ^ _U(q)

    n_grams = items.agg(F.sum(F.size("grams"))).first()[0] or 0
    bits = sketch.bits_for(n_grams, 64, 10, MAX_COUNT_BITS)
    cells = sketch.build(items.select("q", "grams"), tokens, 1, bits, (1 << 32) - 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("item_id", "digest", "q", "grams", "counts"), n_items, cells


def indexes(benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, item_words: int = ITEM_WORDS) -> Iterator[Index]:
    """The benchmark in blocks of about item_words words; the driver holds one block at a time."""
    rows, n_items, cells = _weighed(benchmark)
    held, size = [], 0
    for r in rows.orderBy("item_id", "digest").toLocalIterator():
        weight = {c["gram"] & (2**64 - 1): math.log1p(n_items[r["q"]] / c["n"]) for c in r["counts"]}
        held.append((r["q"], (r["item_id"], np.array(r["grams"], np.int64).view(_U), weight)))
        size += len(r["grams"]) + r["q"] - 1
        if size >= item_words:
            yield Index(held, n_items, cells, similarity, radius)
            held, size = [], 0
    if held:
        yield Index(held, n_items, cells, similarity, radius)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) for each document and item of which it has a passage.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item's similarity to a
    window of its own length is the share of its shingles' weight that the window has, repeats counted;
    a shingle weighs ln(1 + items / items that have it), over the whole benchmark. Windows lie at every
    position from which enough shingles of the items are in reach; elsewhere no window can be alike.
    Their fingerprints meet those of items within ``radius`` bits, whatever the bits, through the buckets of
    their blocks, and each candidate is then measured exactly. A shorter document is one window. Items of
    fewer words than a shingle match as a whole. Null and empty texts on either side match nothing; rows with
    equal doc_id each count, as do items of equal item_id but other text; other columns are ignored. Documents
    are read once for each block of item_words words of items, without a shuffle; results do not depend on it.
    """
    out = None
    for index in indexes(benchmark, similarity, radius, item_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(shared.value.scan(batch.column("text")))
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())),
                    "item_id": pa.array([x[1] for x in found], pa.int64()), "first_word": pa.array([x[2] for x in found], pa.int64()),
                    "n_words": pa.array([x[3] for x in found], pa.int64()), "similarity": pa.array([round(x[4], 6) for x in found], pa.float64()),
                })

        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        part = own.mapInArrow(find, MATCH)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], MATCH)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, item_words: int = ITEM_WORDS) -> DataFrame:
    """The rows of docs in which benchmark_matches() finds nothing, all columns kept; the verdict needs no other row, so nothing moves."""
    text = docs.schema.fieldNames().index("text")
    for index in indexes(benchmark, similarity, radius, item_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[x[0] for x in shared.value.scan(batch.column(text).cast(pa.string()))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
