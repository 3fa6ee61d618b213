"""Operators 1, 2 and 4 against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from skein.llm import ngram_join, sketch
from skein.llm.line_dedup import dedup_lines, with_chunks
from skein.llm.ngram_join import components, keep_one, ngram_jaccard
from skein.llm.substring_dedup import substring_dedup

SPACES = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def brute_windows(rows, n):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            for k in range(len(words(t)) - n + 1):
                w = tuple(words(t)[k : k + n])
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t, *_ in rows:
        ws = words(t)
        gone = set()
        for k in range(len(ws) - n + 1):
            if i is not None and least[tuple(ws[k : k + n])] < i:
                gone.update(range(k, k + n))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize(("n", "bits"), [(50, 29), (7, 29), (8, 16), (3, 16)])
def test_substring(docs, corpus, n, bits):
    assert Counter(map(tuple, substring_dedup(docs, n, bits).collect())) == brute_windows(corpus, n)


def test_substring_with_full_sketch(docs, corpus):
    """A sketch far too small lets all windows through and loses none."""
    assert Counter(map(tuple, substring_dedup(docs, 5, 4).collect())) == brute_windows(corpus, 5)


def brute_classes(rows, n, num, den):
    sets = []
    for i, t, *_ in rows:
        ws = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and den * len(a & b) >= num * len(a | b):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (2, 50), (1, 30)])
def test_ngram_join(docs, corpus, n, num):
    assert Counter(map(tuple, ngram_jaccard(docs, n, num, 100).collect())) == brute_classes(corpus, n, num, 100)


def test_ngram_join_with_full_flags(docs, corpus, monkeypatch):
    """Flags far too small take all shingles for shared ones: no more than prefixes leave the texts, and no link is lost."""
    for name in ("MAX_FLAG_BITS", "MAX_ORDER_BITS"):
        monkeypatch.setattr(ngram_join, name, 4, raising=False)
    signed = ngram_join._signatures(docs.select("doc_id", "text"), 4, 85, 100).collect()
    assert all(len(r["tokens"]) <= r["size"] - -(-r["size"] * 85 // 100) + 1 for r in signed)
    assert Counter(map(tuple, ngram_jaccard(docs, 4, 85, 100).collect())) == brute_classes(corpus, 4, 85, 100)


def test_order_in_little_memory():
    """A partition's items for the order are counted in less room than 60 MB beside them."""
    items = np.random.default_rng(1).integers(0, 1 << 63, 5_000_000).astype(np.uint64)
    tracemalloc.start()
    for _ in sketch._counted(iter([None]), lambda _: (items[i : i + 50_000] for i in range(0, len(items), 50_000)), 1, 28, (1 << 32) - 1, sketch.ORDER_FLUSH):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6, most


def test_order_comes_in_pieces(spark):
    """The driver holds the merged order once and a piece of it, not all rows beside it; it is that of a plain count."""
    items = np.random.default_rng(2).integers(0, 150_000, 200_000)
    df = spark.createDataFrame([(x,) for x in items.tolist()], "item long").repartition(3)
    tracemalloc.start()
    flags, levels = sketch.build_order(df, lambda batch: iter([batch.column("item").to_numpy().astype(np.uint64)]), 26, 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.bincount(sketch.cells(items.astype(np.uint64), 0, 26), minlength=1 << 26)
    assert (flags[0] == np.packbits(counts >= 2)).all()
    assert (levels == np.round(8 * np.log2(np.maximum(1, counts.reshape(-1, 8).max(axis=1))))).all()
    assert most < 1.75 * (flags.nbytes + levels.nbytes), most


def test_ngram_chain(spark):
    """A chain of texts, each like the next only, is one class; a hot group costs no pairs."""
    ws = [f"t{i}" for i in range(300)]
    rows = [(100 + k, " ".join(ws[4 * k : 4 * k + 60])) for k in range(50)] + [(i, "same words here again and again") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard(docs, 1, 80, 100).collect()}
    assert all(got[100 + k] == 100 for k in range(50)) and all(got[i] == 0 for i in range(40))


def test_keep_one(docs, corpus):
    kept = [r["doc_id"] for r in keep_one(docs).collect()]
    classes = {i: c for i, _, c in brute_classes(corpus, 5, 80, 100)}
    assert Counter(kept) == Counter(r[0] for r in corpus if r[0] is None or classes[r[0]] == r[0])
    assert keep_one(docs).columns == docs.columns


def test_words_of_one_polynomial(spark):
    """Two long words that a polynomial modulo a power of two takes for one are two words."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    filler = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*filler[:30], w, *filler[30:]])) for i, w in enumerate((a, b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(docs).collect()} == {0: 0, 1: 0}
    single = spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard(single).collect()} == {0: 0, 1: 1, 2: 0}


def test_components(spark):
    """A long path, a star with a great centre and a cycle, each with its least id."""
    path, star, cycle = [(i, i + 1) for i in range(40)], [(500, 100 + i) for i in range(30)], [(700, 701), (701, 702), (702, 700), (5000, 5000)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(path + star + cycle, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in [*range(101, 130), 500]) and got[701] == got[702] == 700


def chunks(text):
    lines, sums = text.split("\n"), [hashlib.md5(x.encode()).hexdigest() for x in text.split("\n")]
    out, low = [], 0
    for i in range(len(lines)):
        rolled = hashlib.md5(((sums[i - 1] if i else "") + sums[i]).encode()).hexdigest()
        if int(rolled[:8], 16) % 4 == 0 or i + 1 == len(lines):
            out.append(lines[low : i + 1])
            low = i + 1
    return out


def test_lines(docs, corpus):
    keyed = sorted({(i, t) for i, t, *_ in corpus if i is not None and t is not None})
    first = {}
    # Rows that share a doc_id are ordered by a hash of their text, so only those that don't are compared.
    for i, t in keyed:
        for c in chunks(t):
            if len(c) >= 2:
                first.setdefault("\n".join(c), (i, t))
    several = {i for i, n in Counter(i for i, _ in keyed).items() if n > 1}
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_chunks", "n_removed_lines"] and got.count() == len(corpus)
    seen = {}
    for r in got.collect():
        seen.setdefault(r["doc_id"], set()).add((r["text"], r["n_lines"], r["n_removed_lines"]))
    for i, t in keyed:
        if i in several:
            continue
        kept, used = [], set()
        for c in chunks(t):
            b = "\n".join(c)
            if len(c) >= 2 and b.strip() and (first[b] != (i, t) or b in used):
                continue
            used.add(b)
            kept.append(c)
        text = "\n".join(x for c in kept for x in c)
        assert seen[i] == {(text, len(t.split("\n")), len(t.split("\n")) - sum(map(len, kept)))}


def test_lines_shared_block(spark):
    block = "\n".join(f"shared line {k}" for k in range(30))
    rows = [(i, f"head {i}\n{block}\ntail {i}") for i in range(6)]
    got = {r["doc_id"]: r["n_removed_lines"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[i] >= 15 for i in range(1, 6))


def test_empty(no_docs):
    assert substring_dedup(no_docs).collect() == [] and ngram_jaccard(no_docs).collect() == [] and dedup_lines(no_docs).collect() == []
    assert with_chunks(no_docs.select("doc_id", "text")).count() == 0
