"""Helpers shared by the training-data operators: input columns, checkpoints, vectorised word hashing."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and the five control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_U = np.uint64
#: For word_rows: what str.split() leaves between words; the second table makes a space of all ASCII but letters and digits.
NOT_ALNUM = bytes(0x20 if b < 0x80 and not chr(b).isalnum() else b for b in range(256))
#: Words whose hashes a worker keeps, each of no more than this many bytes.
MEMO, MEMO_BYTES = 400_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame) -> DataFrame:
    """df in four tasks a core at most, each taking partitions in turn.

    For a table that is small beside its number of partitions: the driver keeps a record of every task, and loops run many stages.
    """
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def checkpoint(df: DataFrame, small: bool = False) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that all executors share.

    ``spark.checkpoint.dir`` is honoured. Only a local session, whose executors are threads of the driver,
    gets a folder of its own where it is unset; on a cluster that is an error. A table that is small beside its number of
    partitions is written by few() tasks, so that it isn't scattered over very many files.
    """
    context = df.sparkSession.sparkContext
    if small:
        df = few(df)
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = os.path.join(tempfile.gettempdir(), "skein-checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than SPACES; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), lambda w: w != "")


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    if len(column) == 0:
        return
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = min(len(column), max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_rows(data: np.ndarray, offsets: np.ndarray, breaks: bytes | None = None, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """(words, first): the words of all rows in order; row r has words first[r] to first[r + 1] - 1.

    Words are what SPACES leave (the very bytes at which bytes.split() breaks), after ``breaks`` is applied.
    """
    raw = data.tobytes()
    if lower:
        raw = raw.lower()  # of bytes: A-Z alone
    if breaks:
        raw = raw.translate(breaks)
    words: list[bytes] = []
    first = [0]
    low = int(offsets[0])
    for high in offsets[1:].tolist():
        words += raw[low:high].split()
        first.append(len(words))
        low = high
    return words, np.array(first, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche; arithmetic is modulo 2**64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _WordHashes(dict):
    """BLAKE2b of words, 64 bits each; short words are remembered, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


_hashes = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word's bytes."""
    return np.fromiter(map(_hashes.__getitem__, words), _U, len(words))


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9FB21C651E98DF25) + b * _U(0xD6E8FEB86659FD93) + _U(0x632BE59BD9B4E019))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, whatever text they lie in; built by doubling."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out, done, power, size = None, 0, words, 1
    while True:
        if n & size:
            out = power[:count] if out is None else join_hashes(out, power[done : done + count])
            done += size
        if 2 * size > n:
            return out.copy() if n == 1 else out
        power = join_hashes(power[:-size], power[size:])
        size *= 2


def valid_starts(first: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of the first ``count`` word positions begin n words of one row."""
    lengths = np.diff(first)
    end = np.repeat(first[1:], lengths)[:count]
    return np.arange(count) + n <= end


def shingle_sets(hashes: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's n-word shingles; of all its words where they are fewer; empty without words."""
    grams = gram_hashes(hashes, n)
    short = {k: gram_hashes(hashes, k) for k in range(1, n)}
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        count = high - low
        if count >= n:
            yield np.unique(grams[low : high - n + 1])
        elif count:
            yield mix(short[count][low : low + 1] ^ _U(count))
        else:
            yield np.zeros(0, _U)
