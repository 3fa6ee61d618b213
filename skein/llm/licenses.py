"""Operator 6, license scans: positional postings of each file's rarest licence words, intersected, verified by key phrases."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import ascii_lower, table

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels fixed by the contract of the query.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: (label, text of the notice, phrase that must stand in it). The method's own; the base phrases are key phrases here too.
#: Usual wordings of the licences' own notices, lower-cased, without signs; one label may have several.
TEMPLATES = (
    ("mit", "released under the mit license", "under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons "
        "to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0",
        "apache license version 2",
    ),
    ("apache-2", "spdx license identifier apache 2 0", "spdx license identifier apache 2"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("bsd", "spdx license identifier bsd", "spdx license identifier bsd"),
    ("gpl", "spdx license identifier gpl", "spdx license identifier gpl"),
    ("lgpl", "spdx license identifier lgpl", "spdx license identifier lgpl"),
    ("mpl-2", "spdx license identifier mpl 2 0", "spdx license identifier mpl"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "dedicated all copyright and related and neighboring rights"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        "gnu general public license as published by",
    ),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version",
        "gnu lesser general public license as published by",
    ),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license v 2 0"),
    ("bsd", "governed by a bsd style license", "bsd style license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must "
        "retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies",
        "distribute this software for any purpose with or without fee",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
#: A template is a match where its key phrase stands and this share of its words' weight agrees by position.
LEAST_SHARE = 0.5


def license_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def license_idf(words: DataFrame, templates: Sequence[tuple[str, str, str]]) -> dict[str, float]:
    """Inverse document frequency, over all rows, of every word in the templates: as many numbers as these have words."""
    names = sorted({w for _, notice, key in templates for w in f"{notice} {key}".split()})
    found = words.select(F.explode_outer(F.array_intersect("words", F.array(*map(F.lit, names)))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in found.collect() if r["w"] is not None}
    total = words.count()
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in names}


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places for each row of docs.

    The highest-IDF words, over the whole table, of each key phrase are looked up in the file: the two rarest
    of different kind, or the one there is. Their places, less their own place in the phrase, are postings of
    possible starts; those on which both agree are intersected, and a start counts if the whole key phrase
    stands there. The score is the greatest share of a template's weight that agrees by position at a
    verified start, 0 without one; a label needs LEAST_SHARE. places lists (label, start of the phrase,
    share). A null or empty text has no words, no labels and null first and last word. Overlapping places all
    count. Other columns are ignored; repeated rows each give a row.
    """
    rows = docs.select("doc_id", license_words(F.col("text").cast("string")).alias("words"))
    idf = license_idf(rows, templates)
    phrases: dict[str, list[tuple[str, list[str]]]] = {}
    for label, notice, key in templates:
        phrases.setdefault(key, []).append((label, notice.split()))
    for key, _ in base:
        phrases.setdefault(key, [])
    anchors: dict[str, list[int]] = {}
    for key in phrases:
        ws = key.split()
        order = sorted(range(len(ws)), key=lambda i, ws=ws: (-idf.get(ws[i], math.inf), i))
        anchors[key] = [order[0], *[i for i in order if ws[i] != ws[order[0]]][:1]]
    rare = sorted({key.split()[i] for key, own in anchors.items() for i in own})
    # The words themselves are not carried on beyond the files that have any of the words looked up.
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    rows = rows.withColumns({"n_words": F.size("words").cast("long"), "hits": hits})
    words = F.col("words")

    def at(i: Column) -> Column:
        return F.when(i >= 0, F.get(words, i))

    def starts(key: str) -> Column:
        ws = key.split()

        def posting(place: int) -> Column:
            return F.transform(F.filter("hits", lambda x: x["w"] == ws[place]), lambda x: x["i"] - place)

        postings = [posting(place) for place in anchors[key]]
        both = postings[0] if len(postings) == 1 else F.array_intersect(*postings)

        def stands(s: Column) -> Column:
            ok = s >= 0
            for j, w in enumerate(ws):
                if j not in anchors[key]:
                    ok = ok & F.coalesce(at(s + j) == w, F.lit(False))
            return ok

        return F.filter(both, stands)

    def placed(key: str, label: str, notice: list[str], shift: int) -> Column:
        own, weights = F.array(*map(F.lit, notice)), F.array(*[F.lit(idf[w]) for w in notice])

        def place(s: Column) -> Column:
            agreeing = F.transform(own, lambda w, j: F.when(F.coalesce(at(s - shift + j) == w, F.lit(False)), F.get(weights, j)).otherwise(0.0))
            total = F.aggregate(agreeing, F.lit(0.0), lambda a, x: a + x)
            return F.struct(F.lit(label).alias("label"), s.cast("long").alias("start"), F.round(total / sum(idf[w] for w in notice), 6).alias("share"))

        return F.transform(names[key], place)

    names = {key: f"at_{n}" for n, key in enumerate(phrases)}
    rows = rows.withColumns({names[key]: F.when(F.size("hits") > 0, starts(key)).otherwise(F.array().cast("array<int>")) for key in phrases})
    places = []
    for key, members in phrases.items():
        for label, notice in members:
            ws = key.split()
            shift = next(i for i in range(len(notice)) if notice[i : i + len(ws)] == ws)
            places.append(placed(key, label, notice, shift))
    rows = rows.withColumns({"all_places": F.concat(*places), "base_at": F.concat(*[F.col(names[key]) for key, _ in base])})
    base_labels = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(names[key]) > 0, F.lit(label)) for key, label in base]), lambda x: x.isNotNull())))
    rows = rows.withColumns({"places": F.filter("all_places", lambda p: p["share"] >= LEAST_SHARE), "base_list": base_labels})
    own = F.transform("places", lambda p: p["label"])
    return rows.select(
        "doc_id", "n_words", F.size("base_at").cast("long").alias("n_base"),
        F.array_min("base_at").cast("long").alias("first_word"), F.array_max("base_at").cast("long").alias("last_word"),
        F.array_join("base_list", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base_list", own))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"), "places",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("places")
