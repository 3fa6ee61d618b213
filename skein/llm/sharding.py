"""Operator 7, sharding: histogram sort finds byte-exact splitters, then rows are exchanged once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import checkpoint, table

#: Bits by which each round of probes refines the interval that holds a splitter.
STEP = 12
#: Rows of a shard that get their slots in one task.
SLOT_ROWS = 50_000


def _narrow(docs: DataFrame) -> DataFrame:
    """The sort key is (hash of the text, hash of doc_id and text): copies lie together, and a boundary can fall inside a group of them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("high"),
        F.xxhash64("doc_id", text).alias("low"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """shards - 1 keys (unsigned high, unsigned low); shard s has the keys from splitter s - 1 up to, not with, splitter s.

    A round counts, over all partitions, the exact bytes in 2**STEP equal parts of every interval that
    still holds a splitter, and keeps the part in which the target lies. It ends when bytes below the
    candidate are within tolerance * (bytes of a shard) of the target, or the interval is a single key. A
    round reads only rows in open intervals and collects at most (shards - 1) * 2**STEP sums, whatever
    the table's size; there are at most 11 rounds, 128 bits of key at 12 bits each.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    # goal bytes; bytes below the interval; prefix of the key and its bits
    open_, done = {i: (total * (i + 1) // shards, 0, 0, 0) for i in range(shards - 1)}, {}
    top = F.col("high")
    while open_:
        by_prefix: dict[tuple[int, int], list[int]] = {}
        for i, (_, _, prefix, bits) in open_.items():
            by_prefix.setdefault((prefix, bits), []).append(i)
        parts = None
        for (prefix, bits) in by_prefix:
            step = min(STEP, 64 - bits if bits < 64 else 128 - bits)
            if bits < 64:
                inside = F.lit(True) if bits == 0 else F.shiftrightunsigned(top, 64 - bits) == F.lit(prefix)
                part = F.shiftrightunsigned(top, 64 - bits - step).bitwiseAND(F.lit((1 << step) - 1))
            else:
                high, low, b = prefix >> (bits - 64), prefix & ((1 << (bits - 64)) - 1), bits - 64
                inside = top == F.lit(high - (1 << 64) if high >> 63 else high)
                if b:
                    inside = inside & (F.shiftrightunsigned("low", 64 - b) == F.lit(low))
                part = F.shiftrightunsigned("low", 64 - b - step).bitwiseAND(F.lit((1 << step) - 1))
            one = rows.where(inside).select(F.lit(str(prefix)).alias("prefix"), F.lit(bits).alias("bits"), part.alias("part"), "size")
            parts = one if parts is None else parts.unionByName(one)
        sums: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in parts.groupBy("prefix", "bits", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
            sums.setdefault((int(r["prefix"]), r["bits"]), []).append((r["part"], r["size"], r["n"]))
        for (prefix, bits), members in by_prefix.items():
            step = min(STEP, 64 - bits if bits < 64 else 128 - bits)
            cells = sorted(sums.get((prefix, bits), []))
            for i in members:
                goal, below, _, _ = open_.pop(i)
                at, n = (1 << step), 0
                for cell, size, n in cells:
                    if below + size > goal:
                        at = cell
                        break
                    below += size
                found = (prefix << step) + at
                if at == 1 << step or goal - below <= slack or n == 1 or bits + step == 128:
                    done[i] = found << (128 - bits - step)
                else:
                    open_[i] = (goal, below, found, bits + step)
    last = (1 << 128) - 1
    return [(min(done[i], last) >> 64, min(done[i], last) & ((1 << 64) - 1)) for i in range(shards - 1)]


def _signed(x: int) -> int:
    """Of an unsigned 64-bit key, the long that sorts in its place."""
    return x - (1 << 63)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs, exchanged once.

    The law is ``bytes``: every boundary is within tolerance * (bytes of a shard), or one row, of its
    place, so sizes are near equal. Copies are neighbours in the order and share a shard unless a boundary
    must fall among them, as it does where one text has more than a shard's bytes. A null text counts as
    empty (size 1, CRC 0). Rows that are equal in doc_id and text share a key and a shard. Null doc_ids
    are rows like others. An empty table gives no rows. Columns of docs besides these are ignored.
    """
    rows = checkpoint(_narrow(docs))
    bounds = splitters(rows, shards, tolerance)
    flip = F.lit(-(1 << 63))
    high, low = F.col("high").bitwiseXOR(flip), F.col("low").bitwiseXOR(flip)
    index = F.lit(0)
    for h, l in bounds:
        index = index + F.when((high > F.lit(_signed(h))) | ((high == F.lit(_signed(h))) & (low >= F.lit(_signed(l)))), 1).otherwise(0)
    count = rows.count()
    # Slots come from sums over small parts of a shard; parts follow the document's hash, so equal texts don't meet in one.
    bits = max(0, (count // (shards * SLOT_ROWS)).bit_length())
    rows = rows.select("doc_id", "size", "text_crc32", "high", "low", index.cast("int").alias("shard"), (F.shiftrightunsigned("low", 64 - bits) if bits else F.lit(0).cast("long")).alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("low", "doc_id", "high", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(counts, ["shard", "part"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
