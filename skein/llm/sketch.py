"""Count-min sketches of 64-bit items: built per partition, merged by shards of cells, collected within a stated bound.

Every partition counts its own items and sends only the cells it touched. Merging adds them up, so a
cell never holds less than the count of any item in it: estimates are too high or right, never too low.
The merged sketch has ``depth * width`` cells whatever the size of the corpus; that product bounds what is
sent to the driver, in pieces, and broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from skein.llm.common import checkpoint, few, mix

_U = np.uint64
SHARD_BITS = 17
#: Items held in a partition before their cells are sent on; fewer for an order, as its sketch is made beside the largest batches of text.
FLUSH, ORDER_FLUSH = 2_000_000, 500_000
#: About the most bytes of a merged sketch that the driver receives at once, beside the sketch itself.
PIECE = 4 << 20


def cells(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each item in one row of a sketch with 2**bits cells."""
    return (mix(items + _U(0x9E3779B97F4A7C15 * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> _U(64 - bits)).astype(np.int64)


def _pieces(items: np.ndarray, depth: int, bits: int, top: int) -> Iterator[pa.RecordBatch]:
    shard_bits = min(SHARD_BITS, bits)
    for row in range(depth):
        own, counts = np.unique(cells(items, row, bits), return_counts=True)
        counts = np.minimum(counts, top)
        shards = own >> shard_bits
        edges = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(own) else np.zeros(0, int)
        out: dict[str, list] = {"shard": [], "step": [], "cell": [], "width": [], "n": []}
        for low, high in zip(edges, np.r_[edges[1:], len(own)], strict=True):
            step, cell, width, n = _packed(own[low:high] & ((1 << shard_bits) - 1), counts[low:high], 1 << shard_bits, top)
            for name, x in zip(out, ((row << 32) | int(shards[low]), step, cell, width, n), strict=True):
                out[name].append(x)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out.values(), (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=list(out))


def _packed(at: np.ndarray, n: np.ndarray, size: int, top: int) -> tuple[int, bytes, int, bytes]:
    """(bytes of a step, steps from cell to cell, bytes of a count, counts); step 0: all cells in order; count 0: a bit for "twice"."""
    if top <= 2:
        width, packed = 0, np.packbits(n >= 2).tobytes()
    else:
        width = next(k for k in (1, 2, 4) if int(n.max()) < 1 << 8 * k)
        if len(at) * 5 > size:  # most cells are in use: all counts in order take less room
            full = np.zeros(size, f"<u{width}")
            full[at] = n
            return 0, b"", width, full.tobytes()
        packed = n.astype(f"<u{width}").tobytes()
    steps = np.diff(at, prepend=0)
    step = 1 if int(steps.max()) < 256 else 2 if int(steps.max()) < 65536 else 4
    return step, steps.astype(f"<u{step}").tobytes(), width, packed


def _add(total: np.ndarray, step: int, cell: bytes, width: int, n: bytes, top: int) -> None:
    if step == 0:
        total[:] = np.minimum(total.astype(np.int64) + np.frombuffer(n, f"<u{width}"), top)
        return
    at = np.cumsum(np.frombuffer(cell, f"<u{step}"), dtype=np.int64)
    more = np.unpackbits(np.frombuffer(n, np.uint8), count=len(at)) + 1 if width == 0 else np.frombuffer(n, f"<u{width}")
    total[at] = np.minimum(total[at].astype(np.int64) + more, top)


def _counted(batches: Iterator[pa.RecordBatch], items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], depth: int, bits: int, top: int, flush: int) -> Iterator[pa.RecordBatch]:
    """Cells of the items in a partition's batches, sent on for each ``flush`` items."""
    held, size = [], 0
    for batch in batches:
        for items in items_of(batch):
            held.append(items)
            size += len(items)
            if size >= flush:
                yield from _pieces(np.concatenate(held), depth, bits, top)
                held, size = [], 0
    if size:
        yield from _pieces(np.concatenate(held), depth, bits, top)


def _received(merged: DataFrame, most: int) -> Iterator[Row]:
    """The rows of merged, ``most`` bytes at most: those of a large sketch a few partitions at a time, as the driver would hold them several times over."""
    if most <= PIECE:
        yield from few(merged).collect()
    else:
        yield from checkpoint(merged, small=True).coalesce(-(-most // PIECE)).toLocalIterator()


def _collected(df: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], depth: int, bits: int, top: int, partitions: int, payload: Callable[[np.ndarray], bytes], most: int, flush: int = FLUSH) -> Iterator[tuple[int, int, bytes]]:
    """(row, shard, what payload makes of the shard's merged counts), counts held at ``top``; payloads of ``most`` bytes in all, at most."""

    shard_bits = min(SHARD_BITS, bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, step, cell, width, n in zip(*[batch.column(c).to_pylist() for c in ("shard", "step", "cell", "width", "n")], strict=True):
                _add(sums.setdefault(name, np.zeros(1 << shard_bits, np.uint8 if top <= 2 else np.uint32)), step, cell, width, n, top)
        for name, total in sums.items():
            yield pa.record_batch({"shard": pa.array([name], pa.int64()), "cells": pa.array([payload(total)], pa.binary())})

    pieces = df.mapInArrow(lambda batches: _counted(batches, items_of, depth, bits, top, flush), "shard long, step int, cell binary, width int, n binary")
    merged = pieces.repartition(partitions, "shard").mapInArrow(merge, "shard long, cells binary")
    for row in _received(merged, most):
        yield row["shard"] >> 32, row["shard"] & 0xFFFFFFFF, row["cells"]


def build(df: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], depth: int, bits: int, top: int, partitions: int) -> np.ndarray:
    """The merged sketch of the items that ``items_of`` finds in the batches of df, counts held at ``top``.

    With top == 2 it is an array (depth, 2**bits / 8) of bits that say "at least two"; with top == 1, "at
    least one"; else an array (depth, 2**bits) of uint32 counts.
    """
    packed = top <= 2
    out = np.zeros((depth, (1 << bits) // 8), np.uint8) if packed else np.zeros((depth, 1 << bits), np.uint32)
    per = out.shape[1] >> max(0, bits - SHARD_BITS)
    for row, shard, cells_ in _collected(df, items_of, depth, bits, top, partitions, lambda total: (np.packbits(total >= top) if packed else total).tobytes(), out.nbytes):
        out[row, shard * per : (shard + 1) * per] = np.frombuffer(cells_, out.dtype)
    return out


def build_order(df: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits that say "at least two" as of build(), levels): a level is 8 * log2 of the largest count among eight neighbouring cells.

    Both take 2**bits / 8 bytes, and are of one sketch, counted once.
    """
    flags, levels = np.zeros((1, (1 << bits) // 8), np.uint8), np.zeros((1 << bits) // 8, np.uint8)
    per = len(levels) >> max(0, bits - SHARD_BITS)

    def payload(total: np.ndarray) -> bytes:
        most = np.maximum(1, total.reshape(-1, 8).max(axis=1))
        return np.packbits(total >= 2).tobytes() + np.minimum(255, np.round(8 * np.log2(most))).astype(np.uint8).tobytes()

    for _, shard, both in _collected(df, items_of, 1, bits, (1 << 32) - 1, partitions, payload, flags.nbytes + levels.nbytes, ORDER_FLUSH):
        own = slice(shard * per, (shard + 1) * per)
        flags[0, own], levels[own] = np.frombuffer(both, np.uint8).reshape(2, per)
    return flags, levels


def level(levels: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The level of each item by build_order()."""
    return levels[cells(items, 0, int(len(levels) * 8).bit_length() - 1) >> 3]


def flagged(bitmap: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which items have their bit set in every row."""
    bits = int(bitmap.shape[1] * 8).bit_length() - 1
    out = np.ones(len(items), bool)
    for row in range(len(bitmap)):
        at = cells(items, row, bits)
        out &= (bitmap[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def estimates(counts: np.ndarray, items: np.ndarray) -> np.ndarray:
    bits = int(counts.shape[1]).bit_length() - 1
    out = counts[0, cells(items, 0, bits)]
    for row in range(1, len(counts)):
        out = np.minimum(out, counts[row, cells(items, row, bits)])
    return out


def bits_for(items: float, per_item: int, low: int, high: int) -> int:
    """Bits of a width of at least per_item cells an item, held between the two bounds."""
    return int(min(high, max(low, np.ceil(np.log2(max(1.0, items * per_item))))))
