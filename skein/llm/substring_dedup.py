"""Operator 1, substring dedup: a count-min prefilter before exact grouping of 50-word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import sketch
from skein.llm.common import checkpoint, gram_hashes, table, text_chunks, valid_starts, word_hashes, word_rows

_U = np.uint64
#: Words in the shorter runs of which each window's least hash is its anchor.
ANCHOR_WORDS = 8
#: Widest row of the sketch: 2**29 cells, one bit each once merged, 64 MB a row.
MAX_BITS = 29
DEPTH = 2
#: Rows of two longs, 8 MB, up to which a counted table is broadcast.
BROADCAST_ROWS = 500_000


def _anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window, the least hash of the ANCHOR_WORDS-word runs in it: the same words have the same anchor."""
    short = min(ANCHOR_WORDS, window)
    least, span, size = gram_hashes(hashes, short), window - short + 1, 1
    if len(hashes) < window:
        return np.zeros(0, _U)
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = span - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _windows(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(first row, first, valid, anchors, words) of each chunk of texts."""
    for low, _, data, offsets in text_chunks(batch.column("text")):
        words, first = word_rows(data, offsets)
        if len(words) < window:
            continue
        anchors = _anchors(word_hashes(words), window)
        yield low, first, valid_starts(first, window, len(anchors)), anchors, words


def _digests(words: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    """BLAKE2b, 128 bits in two longs, of the words of each window, joined by one space."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.r_[0, ends[:-1]]
    digests = [hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begins[at].tolist(), (ends[at + window - 1] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _left(docs: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """docs left join few, which is broadcast if it was counted to be small, else shuffled."""
    few = checkpoint(few)
    return docs.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, "left")


def with_keys(docs: DataFrame) -> DataFrame:
    """docs with text_key, copy (a smaller doc_id has the same text) and row (0; the text_key where rows share a doc_id)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    light = docs.where("doc_id IS NOT NULL").select("doc_id", "text_key", F.md5("text").alias("digest"))
    least = light.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = light.join(least, "digest").where("doc_id > least").select("doc_id", "text_key").distinct().withColumn("copy", F.lit(True))
    shared = light.groupBy("doc_id").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a < b").select("doc_id", F.lit(True).alias("many"))
    out = _left(_left(docs, copies, ["doc_id", "text_key"]), shared, ["doc_id"])
    return out.select("doc_id", "text", "text_key", F.coalesce("copy", F.lit(False)).alias("copy"), F.when(F.col("many"), F.col("text_key")).otherwise(F.lit(0).cast("long")).alias("row"))


def repeated_windows(docs: DataFrame, window: int = 50, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, row, start) for the result of with_keys(): windows whose words also start in a document with a smaller doc_id.

    Copies of a whole text take no part: all their windows repeat, and the text's first document stands for them.

    1. Each partition counts its windows in a count-min sketch and the sketches are merged. A window is
       counted under its anchor, a part that is the same wherever the window occurs, so the estimate of
       its count is never too low; a run of windows that share an anchor is counted once, and twice if
       the anchor's run comes up again. That takes about one item in 22 words.
    2. Windows estimated to occur twice or more, and only these, are grouped exactly: by a 128-bit
       cryptographic digest of their words, so that windows of different words do not meet.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL AND NOT copy").select("doc_id", "row", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch.bits_for(n_bytes / 6 / 22, 16, 16, max_bits)

    def items(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, first, valid, anchors, _ in _windows(batch, window):
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(anchors)]
            new = np.r_[True, (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])]
            yield anchors[valid & new]

    repeated = spark.sparkContext.broadcast(sketch.build(docs.select("text"), items, DEPTH, bits, 2, partitions))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False)
            for low, first, valid, anchors, words in _windows(batch, window):
                at = np.flatnonzero(valid)
                at = at[sketch.flagged(repeated.value, anchors[at])]
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                for a in range(0, len(at), 1 << 18):
                    p, r = at[a : a + (1 << 18)], row[a : a + (1 << 18)]
                    digests = _digests(words, p, window)
                    yield pa.record_batch({"h1": digests[:, 0], "h2": digests[:, 1], "doc_id": pa.array(ids[r + low], pa.int64()), "row": pa.array(keys[r + low], pa.int64()), "start": pa.array(p - first[r], pa.int32())})

    found = docs.mapInArrow(emit, "h1 long, h2 long, doc_id long, row long, start int")
    groups = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least")
    # Written out, so that the join has it as a plain input: only then are windows that very many documents have dealt out anew.
    groups = checkpoint(groups)
    return found.join(groups, ["h1", "h2"]).where("doc_id > least").select("doc_id", "row", "start")


def substring_dedup(docs: DataFrame, window: int = 50, max_bits: int = MAX_BITS) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space). Windows are judged on
    the input. A null or empty text has no words and keeps an empty text; a row with null doc_id is
    neither a source nor cut; rows with equal doc_id do not cut one another, and each row is returned.
    Other columns are ignored. An empty table gives an empty result.
    """
    docs = with_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    starts = repeated_windows(docs, window, max_bits).groupBy("doc_id", "row").agg(F.collect_set("start").alias("starts"))  # of one document
    joined = docs.join(starts, ["doc_id", "row"], "left").select("doc_id", "text", "copy", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, copies = batch.column("starts"), batch.column("copy").to_pylist()
            for low, high, data, offsets in text_chunks(batch.column("text")):
                words, first = word_rows(data, offsets)
                n_words, n_removed, kept = [], [], []
                for r in range(high - low):
                    own = words[first[r] : first[r + 1]]
                    n_words.append(len(own))
                    if copies[low + r] and len(own) >= window:
                        own = []
                    elif lists[low + r].is_valid:
                        edges = np.zeros(len(own) + 1, np.int64)
                        at = np.asarray(lists[low + r].values, np.int64)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + window, -1)
                        own = list(compress(own, (np.cumsum(edges)[:-1] == 0).tolist()))
                    n_removed.append(n_words[-1] - len(own))
                    kept.append(b" ".join(own).decode())
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(low, high - low), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Windows and groups alone; the digests follow from the words kept.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g JOIN m USING (k) WHERE doc_id > least),
x AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
y AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN d.w ELSE list_transform(list_filter(list_zip(d.w, range(1, len(d.w) + 1)), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END AS kept
  FROM d LEFT JOIN x ON d.doc_id = x.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM y
"""
