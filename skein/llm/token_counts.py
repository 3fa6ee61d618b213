"""Operator 3, token counts: a dynamic program over prefixes, for a byte-level BPE in the tokenizers library's format."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import table

#: Entries that each of a worker's memos may hold; a full memo is emptied, which costs time only.
MEMO = 1_600_000
#: How this kind of tokenizer cuts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CONTRACTION = regex.compile(r"'(?:re|ve|ll)$")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Exact token counts of every prefix of a text.

    For bytes w of one piece, last[i] is the last token of the encoding of w[:i]. It is the one token t = w[j:i]
    that the merge rules leave apart from last[j], so count[i] = count[j] + 1: each prefix extends a shorter
    one and nothing is encoded anew.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        split = spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take neighbours are not supported")
        as_bytes = lambda s: bytes(letters[c] for c in s)
        special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {as_bytes(t) for t in model["vocab"] if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        #: Of each merged token: rank, left and right part.
        self.made = {a + b: (i, a, b) for (a, b), i in self.ranks.items()}
        self.reach: dict[bytes, int] = {}
        for t in self.tokens:
            if len(t) > 2:
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PIECES)
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.totals: dict[str, int] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """The encoding of a few bytes by the merge rules themselves."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 40))
            pair = parts[best], parts[best + 1]
            if pair not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether the merge rules leave these two tokens as they are; with no left, whether they make the right one.

        The tokens are taken apart again from the last merge on. A merge across their border that comes before
        the one that made the part next to it would have happened first; of equal ones, the left comes first.
        """
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) >= MEMO:
                self.apart.clear()
            known = self.apart[left, right] = self._across(left, right) if left else self.merge(right) == [right]
        return known

    def _across(self, left: bytes, right: bytes) -> bool:
        limit = 1 << 40
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and rank < limit:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or made_left is not None and made_left[0] > made_right[0]:
                limit, left = made_left[0], made_left[2]
            else:
                limit, right = made_right[0] + 1, made_right[1]

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ... piece."""
        tokens, apart, reach = self.tokens, self.apart, self.reach
        last, count = [b""], [0]
        for i in range(1, len(piece) + 1):
            # No token that ends in these three bytes is longer.
            for j in range(max(0, i - reach.get(piece[i - 3 : i], 2)) if i > 2 else 0, i):
                token = piece[j:i]
                if token in tokens:
                    left = last[j]
                    known = apart.get((left, token))
                    if known if known is not None else self.stays(left, token):
                        last.append(token)
                        count.append(count[j] + 1)
                        break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return count

    def total(self, piece: str) -> int:
        n = self.totals.get(piece)
        if n is None:
            if len(self.totals) >= MEMO:
                self.totals.clear()
            n = self.totals[piece] = self.prefixes(piece.encode())[-1]
        return n

    def segments(self, text: str) -> Iterator[tuple[str, str]]:
        """(text, special token that ends it or '')."""
        if self.special is None:
            yield text, ""
            return
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], m[0]
            at = m.end()
        yield text[at:], ""

    def count(self, text: str) -> int:
        n, total = 0, self.total
        for segment, special in self.segments(text):
            for piece in self.pieces.findall(segment):
                n += total(piece)
            n += bool(special)
        return n

    def _piece_prefixes(self, before: str, piece: str) -> list[int]:
        """Counts of the prefixes of piece, relative to the tokens up to its start, given the piece before it."""
        counts = self.prefixes(piece.encode())
        if _CONTRACTION.match(piece):  # its first two characters alone are two pieces
            counts[2] = counts[1] + self.total(piece[1])
        elif before.isspace() and piece[0].isspace():  # up to here white space is a single piece
            run = before + piece[0]
            counts[len(piece[0].encode())] = self.prefixes(run.encode())[-1] - self.total(before)
        return counts

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of each prefix of the text's UTF-8 bytes, by its length; where a character is cut, of the bytes so far."""
        out, base = [0], 0
        for segment, special in self.segments(text):
            before = ""
            for piece in self.pieces.findall(segment):
                out += [base + n for n in self._piece_prefixes(before, piece)[1:]]
                base, before = base + self.total(piece), piece
            if special:
                start = base - sum(map(self.total, self.pieces.findall(segment)))
                for k in range(1, len(special)):
                    out += [start + sum(map(self.total, self.pieces.findall(segment + special[:k])))] * len(special[k - 1].encode())
                base += 1
                out += [base] * len(special[-1].encode())
        return np.array(out, np.int64)

    def fit(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix, of whole characters, with at most ``budget`` tokens."""
        if budget <= 0:
            return 0
        base = at = best = 0
        for segment, special in self.segments(text):
            before = ""
            for piece in self.pieces.findall(segment):
                if base >= budget:
                    # Only white space that joins the run before it can add bytes without adding a token.
                    if before.isspace() and piece[0].isspace():
                        size = len(piece[0].encode())
                        if base + self._piece_prefixes(before, piece)[size] <= budget:
                            best = at + size
                    return best
                n = self.total(piece)
                size = len(piece.encode())
                if base + n <= budget:
                    best = at + size
                else:
                    counts, p = self._piece_prefixes(before, piece), 0
                    for c in piece:
                        p += len(c.encode())
                        if base + counts[p] <= budget:
                            best = max(best, at + p)
                base, at, before = base + n, at + size, piece
            if special:
                base, at = base + 1, at + len(special.encode())
                if base <= budget:
                    best = at
        return best


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """A worker's own counter for a vocabulary file; the path must be readable where tasks run."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, with_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_bytes and, if asked for, prefix_counts for each row of docs.

    fit_bytes is the length of the longest prefix of whole characters within ``limit`` tokens, null where
    the whole text is within it. prefix_counts has the token count of every prefix, by its bytes. A null
    text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeated rows each get a row; columns
    other than doc_id and text are ignored. One pass, no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = [own.count(t) for t in texts]
                columns = {
                    "doc_id": part.column("doc_id"),
                    "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "over_limit": pa.array([k > limit for k in n], pa.bool_()),
                    "fit_bytes": pa.array([own.fit(t, limit) if k > limit else None for t, k in zip(texts, n, strict=True)], pa.int64()),
                }
                if with_prefixes:
                    columns["prefix_counts"] = pa.array([own.prefix_counts(t) for t in texts], pa.list_(pa.int64()))
                yield pa.record_batch(columns)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long" + ", prefix_counts array<long>" * with_prefixes)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
