"""Operators 6, 7, 8, 9 and 10 against brute force, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm.decontaminate import SIMILARITY, _Blocks, benchmark_matches, drop_contaminated
from skein.llm.licenses import BASE, LEAST_SHARE, TEMPLATES, scan_licenses
from skein.llm.line_dedup import dedup_lines
from skein.llm.ngram_join import keep_one
from skein.llm.quality import keep_good, quality
from skein.llm.sharding import shard
from skein.llm.url_filter import RULES, rules_frame, url_verdicts


def test_licenses(spark, docs, corpus, no_docs):
    rng = random.Random(2)
    pool = "under the mit license apache version 2 cc by nc all rights reserved gnu general public x y".split()
    texts = [rng.choice([" ", "-", ", "]).join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += ["Released under the MIT License.", "Apache License, Version 2.0", "CC BY-NC 4.0; CC-BY-NC", "This work is licensed under the GNU General Public License, version 3.", "MİT under the mit licenseé", None]
    texts += ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute", "SPDX-License-Identifier: Apache-2.0 or SPDX-License-Identifier: BSD-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ws = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        places = [(k, label) for phrase, label in BASE for k in range(len(ws)) if ws[k : k + len(phrase.split())] == phrase.split()]
        r, at = got[i], [k for k, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    # Labels, score and places by brute force: every place of a key phrase, every word of the notice around it.
    split = {i: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for i, t in rows}
    idf = lambda w: math.log((1 + len(rows)) / (1 + sum(w in ws for ws in split.values()))) + 1
    for i, ws in split.items():
        want = Counter()
        for label, notice, key in TEMPLATES:
            own, k = notice.split(), key.split()
            shift = next(j for j in range(len(own)) if own[j : j + len(k)] == k)
            for s in range(len(ws) - len(k) + 1):
                if ws[s : s + len(k)] == k:
                    share = sum(idf(w) for j, w in enumerate(own) if 0 <= s - shift + j < len(ws) and ws[s - shift + j] == w) / sum(map(idf, own))
                    if share >= LEAST_SHARE + 1e-6 or share >= LEAST_SHARE - 1e-6 and (label, s) in {(p["label"], p["start"]) for p in got[i]["places"]}:
                        want[label, s, round(share, 4)] += 1
        assert Counter((p["label"], p["start"], round(p["share"], 4)) for p in got[i]["places"]) == want
        assert abs(got[i]["score"] - max((x for *_, x in want), default=0.0)) < 1e-3
        assert got[i]["labels"] == ",".join(sorted({x for x, *_ in want} | set(filter(None, got[i]["base_labels"].split(",")))))
    assert got[306]["labels"] == "mit" and got[307]["labels"] == "apache-2,bsd" and got[308]["labels"] == "gpl"
    assert got[300]["labels"] == "mit" and got[300]["score"] == 1.0 and got[303]["labels"] == "gpl"
    assert scan_licenses(docs).count() == len(corpus) and scan_licenses(no_docs).collect() == []


@pytest.mark.parametrize(("shards", "tolerance"), [(8, 0.001), (3, 0.0), (1, 0.1)])
def test_sharding(docs, corpus, shards, tolerance):
    got = shard(docs, shards, tolerance).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    total, largest = sum(size(t) for _, t, *_ in corpus), max(Counter((i, t) for i, t, *_ in corpus).values()) * 50_001
    for s in range(shards):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * largest + tolerance * total


def test_sharding_splits_a_hot_text(spark, no_docs):
    rows = [(i, "the same text over and over" if i % 3 else f"text {i} " * (i % 7)) for i in range(3000)]
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(x - mean) <= 0.002 * mean + 60 for x in sizes.values())
    assert shard(no_docs).collect() == []


def base_counts(t):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
    grams = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    many = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, corpus, no_docs):
    got = quality(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *base_counts(t)) for i, t, *_ in corpus)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality(no_docs).collect() == [] and keep_good(docs).columns == docs.columns
    assert Counter(r["doc_id"] for r in keep_good(docs).collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_clashing_columns(spark, docs):
    """Columns with every name used inside the stages come back as they were."""
    names = ["q_words", "q_text", "q_kept", "q_n", "q_lang", "q_failed", "own", "m0", "w00", "det", "d2", "e_n", "g", "k", "d_doc", "d_cuts", "d_lines", "d_key", "d_kept", "d_text", "text_key", "first_bytes", "a.b"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    same = Counter(tuple(r)[: len(docs.columns)] for r in keep_good(wide).collect())
    assert same == Counter(map(tuple, keep_good(docs).collect())) and keep_good(wide).columns == wide.columns
    out = dedup_lines(wide)
    assert out.columns == [*wide.columns, "n_lines", "n_chunks", "n_removed_lines"]
    assert all(list(tuple(r)[len(docs.columns) :][: len(names)]) == names for r in out.collect())
    assert Counter(r["text"] for r in out.collect()) == Counter(r["text"] for r in dedup_lines(docs).collect())
    assert keep_one(wide).columns == wide.columns


def test_quality_outliers(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(30, 200))), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(80)), "en", "s") for i in range(60)] + [(2000 + i, "abc " * 3 + " ".join(word() for _ in range(50)), "en", "rare") for i in range(3)]
    kept = {r["doc_id"] for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert kept == {i for i, *_ in rows if not 1000 <= i < 2000}


def test_quality_small_groups(spark):
    """Junk in sources, and in languages, too small for an estimate of their own."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(30, 200)))
    junk = lambda: " ".join(word() + "###" for _ in range(80))
    rows = [(i, good(), "en", f"s{i % 30}") for i in range(300)] + [(1000 + i, junk(), "en", f"s{i}") for i in range(30)]
    rows += [(500 + i, good(), f"l{i}", "s") for i in range(20)] + [(1100 + i, junk(), f"l{i}", "s") for i in range(5)] + [(1200, junk(), "alone", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality(docs).where("kept").collect()} == {i for i, *_ in rows if i < 1000}
    assert keep_good(docs.where("doc_id >= 500 AND doc_id < 1102")).count() > 0


def test_quality_many_outliers(spark):
    """Groups with 10 to 45 % junk in one table, a source for each share."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = []
    for share in (10, 20, 24, 30, 35, 40, 45):
        for i in range(200):
            junk = i < 2 * share
            rows.append((1000 * share + i, " ".join(word() + "###" * junk for _ in range(rng.randint(30, 100))), "en", f"s{share}", junk))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    assert {r["doc_id"] for r in quality(docs).where("kept").collect()} == {r[0] for r in rows if not r[4]}


def test_urls(spark, no_docs):
    urls = ["http://example.org/en/1", "https://A.Example.ORG/en/12?x=1", "http://example.org/es/a/b", "x://notexample.org/es/", "http://b.com/fr/x", "http://b.com/de/", "http://com/de/", "HTTP://b.com", "b.com/de/", None, "", "a://", "://org/", "http://org#f", "http://a.b.c.org?q", "http://example.org/es", "http://.org/", "ftp://u.example.org/en/1://z"]
    rows = [(i % 15, u, 1) for i, u in enumerate(urls + urls[:3])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host int")

    def verdict(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    got = Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_verdicts(pages, rules_frame(spark, RULES)).collect())
    assert got == Counter((i, u, *verdict(u)) for i, u, _ in rows)
    assert url_verdicts(pages.where("false"), rules_frame(spark, RULES)).collect() == []
    assert {r["verdict"] for r in url_verdicts(pages, rules_frame(spark, []), "block").collect()} == {"block"}


def test_benchmark(spark, docs, no_docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 50)))) for i in range(40)] + [(90, "tiny one"), (91, None), (92, ""), (93, "  ")]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows, leaks = [], {}
    for d in range(200):
        text = filler(rng.randint(0, 120))
        if d % 4 == 0:
            i, item = items[d % 40]
            ws = item.split()
            if d % 8 == 0 and len(ws) > 35:  # one word changed of a long item: five shingles of 31 or more
                ws[len(ws) // 2] = "changed"
            joined = (", " if d % 12 == 0 else " ").join(ws)
            text = f"{text} {joined.upper() if d % 16 == 0 else joined} {filler(rng.randint(0, 60))}"
            leaks[d] = i
        rows.append((d, text))
    rows += [(500, items[3][1]), (501, None), (502, ""), (503, "some Tiny, one here"), (504, " ".join(items[5][1].split()[:5]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_matches(frame, bench).collect()}
    assert got == {*leaks.items(), (500, 3), (503, 90)}
    clean = {r["doc_id"] for r in drop_contaminated(frame, bench).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in got}
    assert drop_contaminated(docs, bench).columns == docs.columns and benchmark_matches(no_docs, bench).collect() == []
    assert benchmark_matches(frame, bench.where("false")).collect() == [] and drop_contaminated(frame, bench.where("false")).count() == len(rows)


def near_passages(seed):
    """(documents, items): items share boilerplate and come in near copies; documents hold them with 0 to 4 words changed."""
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    boiler, hot = text(14), text(59)
    items = [[*boiler, *text(30)] for _ in range(8)] + [text(rng.choice([3, 24, 25, 40, 90])) for _ in range(25)] + [[*hot[:50], *text(3), *hot[53:]] for _ in range(12)]
    docs = []
    for _ in range(120):
        near = list(rng.choice(items))
        for _ in range(rng.randrange(5)):
            near[rng.randrange(len(near))] = f"v{rng.randrange(400)}"
        docs.append([*text(rng.randrange(60)), *near, *text(rng.randrange(60))])
    docs += [text(150), boiler, hot[:40], []]
    return [(d, " ".join(w)) for d, w in enumerate(docs)], [(i, " ".join(w)) for i, w in enumerate(items)] + [(None, "lone words of an item without number"), (4, "a b c d e f g h"), (5, None), (6, "--")]


def brute_similarities(docs, items):
    """The greatest similarity of each document and item over all windows of the item's length."""
    words = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w]
    of = {}
    for i, t in set(items):
        ws = words(t)
        q = min(5, len(ws))
        if q:
            of[i, t] = q, Counter(tuple(ws[k : k + q]) for k in range(len(ws) - q + 1))
    n = Counter(q for q, _ in of.values())
    df = Counter((q, g) for q, tf in of.values() for g in tf)
    best = {}
    for d, t in docs:
        ws = words(t)
        for (i, _), (q, tf) in of.items():
            weight = {g: math.log1p(n[q] / df[q, g]) for g in tf}
            grams = [tuple(ws[k : k + q]) for k in range(len(ws) - q + 1)]
            size = sum(tf.values())
            for k in range(max(1, len(grams) - size + 1)):
                own = Counter(grams[k : k + size])
                alike = sum(weight[g] * min(m, own[g]) for g, m in tf.items()) / sum(weight[g] * m for g, m in tf.items())
                best[d, i] = max(best.get((d, i), 0.0), alike)
    return best


def test_benchmark_brute_force(spark):
    """Over all windows: nothing found that isn't alike, at least 0.9 of what is alike found, the same whatever a pass holds."""
    docs, items = near_passages(12)
    best = brute_similarities(docs, items)
    alike = {k for k, x in best.items() if x >= SIMILARITY - 1e-9}
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, items[3]], "item_id long, text string")
    got = sorted(map(tuple, benchmark_matches(frame, bench).collect()), key=str)
    found = {(r[0], r[1]) for r in got}
    assert found <= alike and len(found) >= 0.9 * len(alike) and len(alike) > 50
    assert all(r[4] <= best[r[0], r[1]] + 1e-6 for r in got) and sum(abs(r[4] - best[r[0], r[1]]) < 1e-6 for r in got) >= 0.9 * len(got)
    for item_words in (1, 700):
        assert sorted(map(tuple, benchmark_matches(frame, bench, item_words=item_words).collect()), key=str) == got


def test_blocks():
    """The buckets hold every fingerprint within the radius."""
    rng = np.random.default_rng(4)
    prints, windows = rng.integers(0, 256, (300, 8), dtype=np.uint8), rng.integers(0, 256, (200, 8), dtype=np.uint8)
    windows[:50] = prints[:50] ^ (rng.random((50, 8)) < 0.3).astype(np.uint8)
    apart = np.bitwise_count(windows[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    for radius in (0, 3, 10, 22, 30):
        window, item = _Blocks(prints, radius).within(windows)
        assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*[x.tolist() for x in np.nonzero(apart <= radius)], strict=True))


def test_pipeline(spark, tmp_path):
    """Each stage as the next one's input, written and read again, gives what run() gives."""
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, source).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
    assert Counter(map(tuple, docs.collect())) == Counter(map(tuple, corpus_pipeline.run(spark, source).collect()))
