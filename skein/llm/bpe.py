"""Operator 5, byte-level BPE encoding and decoding by replaying merges over all words of a block of the corpus."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table

NONE = np.int32(2**31 - 1)
#: Characters of text whose distinct words are encoded together, and words whose ids a worker keeps for later blocks.
BLOCK = 8_000_000
MEMO = 300_000


class Codec:
    """Ranks of byte strings, and the replay of their merges.

    The distinct words that are new in a block are laid out in one array of tokens with links to their
    neighbours. An inverted index maps each pair, by the rank of the token it makes, to its positions.
    The least rank present is merged at all its positions at once, the first in each word; only the
    pairs on either side of a merge are looked up again. Words do not touch, so replaying them together
    gives each the same tokens as alone.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        size = max(ranks.values()) + 1
        by_rank = [b""] * size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.lengths = np.fromiter(map(len, by_rank), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.memo: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or NONE."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers; a word that is a token is that token."""
        out: list[bytes] = [b""] * len(words)
        rest = []
        for i, w in enumerate(words):
            rank = self.ranks.get(w)
            if rank is None:
                rest.append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        if not rest:
            return out
        sizes = np.fromiter((len(words[i]) for i in rest), np.int64, len(rest))
        token = self.of_byte[np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)]
        n = len(token)
        word = np.repeat(np.arange(len(rest), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        ends = np.cumsum(sizes)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        rank = np.full(n, NONE, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._rank(token[inner], token[inner + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            ranks = rank[at]
            keep = ranks != NONE
            at, ranks = at[keep], ranks[keep]
            if len(at) > 1:
                order = np.argsort(ranks, kind="stable")
                at, ranks = at[order], ranks[order]
                edges = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                groups = np.split(at, edges)
                names = ranks[np.r_[0, edges]].tolist()
            elif len(at):
                groups, names = [at], [int(ranks[0])]
            else:
                return
            for name, group in zip(names, groups, strict=True):
                if name in index:
                    index[name].append(group)
                else:
                    index[name] = [group]
                    heapq.heappush(heap, name)

        add(inner)
        while heap:
            least = heapq.heappop(heap)
            lists = index.pop(least)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[(rank[at] == least) & alive[at]]
            if len(at) > 1:
                at = np.unique(at)
                own = word[at]
                again = np.flatnonzero(own[1:] == own[:-1]) + 1
                if len(again):  # later places in a word wait: this merge may have made a lower rank there
                    index[least] = [at[again]]
                    heapq.heappush(heap, least)
                    at = np.delete(at, again)
            if not len(at):
                continue
            gone = after[at]
            following = after[gone]
            token[at] = least
            after[at] = following
            alive[gone] = False
            has = following >= 0
            before[following[has]] = at[has]
            rank[at] = NONE
            right = at[has]
            rank[right] = self._rank(token[right], token[following[has]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self._rank(token[left], token[after[left]])
            add(np.concatenate((right, left)))
        ids = token[alive].astype("<u4")
        last = np.cumsum(np.bincount(word[alive], minlength=len(rest))) * 4
        raw = ids.tobytes()
        low = 0
        for i, high in zip(rest, last.tolist(), strict=True):
            out[i] = raw[low:high]
            low = high
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        low = 0
        while low < len(texts):
            pieces, size = [], 0
            while low + len(pieces) < len(texts) and size < BLOCK:
                text = texts[low + len(pieces)]
                pieces.append(self.pattern.findall(text))
                size += len(text)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            new = {w for p in pieces for w in p if w not in self.memo}
            new = list(new)
            self.memo.update(zip(new, self.replay([w.encode() for w in new]), strict=True))
            get = self.memo.__getitem__
            for p in pieces:
                yield b"".join(map(get, p))
            low += len(pieces)

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        sizes = self.lengths[at]
        ends = np.cumsum(sizes)
        return self.bytes[np.repeat(self.offsets[at] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _slices(batch: pa.RecordBatch, name: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``limit`` bytes, so that what a run turns into stays small too."""
    sizes = np.array([len(x) if x is not None else 0 for x in batch.column(name).cast(pa.large_binary()).to_pylist()], np.int64)
    low, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= limit or i + 1 == len(sizes):
            yield batch.slice(low, i + 1 - low)
            low, total = i + 1, 0


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) for each row of docs; with digests, the SHA-256 of ids and of what they decode to in place of ids.

    A null text counts as empty and has no ids. Rows are independent; repeated rows each get a row;
    columns other than doc_id and text are ignored. One pass, no shuffle. A lost task starts over alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _slices(batch, "text"):
                ids = list(own.encode([t or "" for t in part.column("text").to_pylist()]))
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if digests:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                    columns["decoded_sha256"] = pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string())
                else:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.record_batch(columns)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text for each row of (doc_id, ids); null ids give the empty text, bytes that are no UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in _slices(batch, "ids"):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "text": pa.array([own.decode(x or b"").decode("utf-8", "replace") for x in part.column("ids").to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
