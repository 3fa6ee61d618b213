"""Operator 8's verdict and the pipeline against plain versions without Spark."""

import base64
import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from test_dedup import brute_classes, chunks
from test_filters import base_counts, brute_similarities

import corpus_pipeline
from skein.llm import quality as Q
from skein.llm.decontaminate import SIMILARITY


def estimate(x, correction):
    mean = x.mean(axis=0)
    return mean, np.cov(x, rowvar=False, bias=True) * correction + np.diag(np.square(Q.FLOOR))


def distances(x, mean, cov):
    apart = x - mean
    return (apart * np.linalg.solve(cov, apart.T).T).sum(axis=1)


def robust(x):
    """The minimum-covariance estimate of the rows x: concentration from four starts, the least determinant estimated anew."""
    starts = [estimate(x, 1.0)]
    for q in Q.QUANTILES:
        centre = np.quantile(x, q, axis=0)
        sd = np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), Q.FLOOR)
        starts.append((centre, np.diag(np.square(sd))))
    ends = []
    for mean, cov in starts:
        det = math.inf
        while True:
            bins = np.floor(8 * np.log2(distances(x, mean, cov) + 1e-6))
            new = estimate(x[bins <= np.sort(bins)[math.ceil(Q.SHARE * len(x)) - 1]], Q.CORRECTION)
            lower = np.linalg.slogdet(new[1])[1]
            if lower >= det - Q.CONVERGED:
                break
            det, (mean, cov) = lower, new
        ends.append((det, mean, cov))
    _, mean, cov = min(ends, key=lambda e: e[0])
    return estimate(x[distances(x, mean, cov) <= Q.NEAR], Q.NEAR_CORRECTION)


def brute_kept(rows):
    """Verdict for each row (doc_id, text, lang, source)."""
    vectors, failed, groups = [], [], []
    for _, text, lang, source in rows:
        n, chars, symbols, lines, repeats = base_counts(text)
        failed.append(n < 10 or 100 * repeats > 20 * n)
        vectors.append([round(math.log2(v) * Q.SCALE) / Q.SCALE for v in (1 + chars / max(n, 1), *(1 + 100 * c / max(n, 1) for c in (symbols, lines, repeats)))])
        groups.append((lang or "", source or ""))
    vectors = np.array(vectors)
    members = defaultdict(list)
    for i, (lang, source) in enumerate(groups):
        if not failed[i]:
            for g in ((lang, source), (lang,), ()):
                members[g].append(i)
    found = {}
    kept = []
    for i, (lang, source) in enumerate(groups):
        if failed[i]:
            kept.append(False)
            continue
        g = next((g for g in ((lang, source), (lang,)) if len(members[g]) >= Q.LEAST_ROWS), ())
        if g not in found:
            found[g] = robust(vectors[members[g]])
        kept.append(bool(distances(vectors[i : i + 1], *found[g])[0] <= Q.CUTOFF))
    return kept


def brute_lines(rows):
    """The rows with the text that line dedup leaves; doc_ids are distinct."""
    first, out = {}, []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        for k, c in enumerate(chunks(text)) if text is not None else ():
            if len(c) >= 2:
                first.setdefault("\n".join(c), (i, k))
    for i, text, *rest in rows:
        if text is not None:
            kept = [c for k, c in enumerate(chunks(text)) if len(c) < 2 or not "\n".join(c).strip() or first["\n".join(c)] == (i, k)]
            text = "\n".join(x for c in kept for x in c)
        out.append((i, text, *rest))
    return out


def brute_pipeline(docs, items):
    docs = [r for r, good in zip(docs, brute_kept(docs), strict=True) if good]
    docs = brute_lines(docs)
    classes = {i: c for i, _, c in brute_classes(docs, 5, 80, 100)}
    docs = [r for r in docs if classes[r[0]] == r[0]]
    alike = {d for (d, _), x in brute_similarities([r[:2] for r in docs], items).items() if x >= SIMILARITY - 1e-9}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for i, text, *_ in docs:
        if i not in alike:
            ids = encoding.encode_ordinary(text or "")
            out[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    return out


def mixed_table(seed):
    """(documents, items): sources of many sizes with junk, shared blocks of lines, copies, near copies, benchmark items, nulls."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    line = lambda: " ".join(word() for _ in range(rng.randint(4, 12)))
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 40)))) for i in range(12)]
    block = [line() for _ in range(12)]
    rows = []
    for i in range(420):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["hot", "hot", "s1", f"t{rng.randrange(40)}", None])
        own = [line() for _ in range(rng.randint(2, 12))]
        kind = rng.randrange(12)
        if kind == 0:
            own = [" ".join(w + "##" for w in x.split()) for x in own]
        elif kind == 1:
            own[1:1] = block
        elif kind == 2 and rows:
            own = (rng.choice(rows)[1] or "").split("\n")
        elif kind == 3 and rows:
            words = (rng.choice(rows)[1] or "").split(" ")
            words[len(words) // 2] = "changed"
            own = " ".join(words).split("\n")
        elif kind == 4:
            own.insert(1, rng.choice(items)[1])
        elif kind == 5:
            own += own[:2]
        rows.append((i, rng.choice([None, "", "one two"]) if kind == 6 and i % 3 == 0 else "\n".join(own), lang, source))
    return rows, items


def test_verdict(spark):
    """kept of every row, over groups that are estimated themselves, by language and over the whole table."""
    rows, _ = mixed_table(3)
    got = {r["doc_id"]: r["kept"] for r in Q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()}
    want = {r[0]: k for r, k in zip(rows, brute_kept(rows), strict=True)}
    assert got == want and 0.5 < sum(want.values()) / len(want) < 0.95


def test_verdict_of_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = list(map(tuple, docs.select("doc_id", "text", "lang", "source").collect()))
    assert {r["doc_id"]: r["kept"] for r in Q.quality(docs).collect()} == {r[0]: k for r, k in zip(rows, brute_kept(rows), strict=True)}


def test_pipeline_brute_force(spark, tmp_path):
    """run() gives the rows of plain versions of the five stages."""
    docs, items = mixed_table(7)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute_pipeline(docs, items)
    assert got == want and 100 < len(want) < len(docs)
