"""Licence scans by a positional index of rare words, in DataFrame expressions only.

Licence templates are short texts. Document frequencies of their words are
counted over all files; each template is indexed by its words of highest IDF,
with their positions. A file's words are looked up in that index. Every
posting says where the template would begin; beginnings that enough rare words
agree on are candidates, and a candidate holds if the template's mandatory
phrases stand at their places.

All of it is done within the file's row: no shuffle but that of the counts,
which are pre-summed and have one row for each word of the templates. Only
files that hold a rare word are looked at word by word. A null text is an
empty one; a file without words has no label and score 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexprep.llm.arrow import free_name
from lexprep.llm.tables import quoted

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, public notice in plain words, mandatory phrases of that notice.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ("except in compliance with the license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation", ("free software", "general public license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ("for any purpose with or without fee",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), 1)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequency(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """(files, files that hold each word), over all files: one row for each word comes to the driver."""
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(words(F.col(quoted(text_col))), _strings(vocabulary)))).alias("w"))
    got = {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}
    return got.get("", 0), got


def rare_index(n: int, df: dict[str, int], templates=TEMPLATES, rare: int = 5, share: float = 0.6):
    """(postings, needs): (word, template, position) of each template's ``rare`` words of highest IDF, and how many of
    them must agree on a beginning. Ties go by the word."""
    postings, needs = [], []
    for t, (_, text, _) in enumerate(templates):
        w = text.split()
        idf = {x: math.log((n + 1) / (df.get(x, 0) + 1)) for x in set(w)}
        best = sorted(idf, key=lambda x: (-idf[x], x))[:rare]
        places = [(x, t, k) for k, x in enumerate(w) if x in best]
        postings += places
        needs.append(max(2, math.ceil(share * len(best))))
    return postings, needs


def _places(arr: Column, phrase: str) -> Column:
    """Starts, counted from 0, of the places where the words of a phrase stand one after the other."""
    w = phrase.split()
    last = w[-1]
    here = F.filter(F.transform(arr, lambda x, i: F.when(x == last, i - (len(w) - 1))), lambda i: i.isNotNull() & (i >= 0))
    hit = F.filter(here, lambda i: F.slice(arr, i + 1, len(w)) == _strings(w))
    return F.when(F.array_contains(arr, last), hit).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, name: str = "licence", text_col: str = "text", templates=TEMPLATES, base=BASE,
         rare: int = 5, share: float = 0.6) -> DataFrame:
    """``docs`` and a struct ``name``: n_words, places (starts of base phrases), base_labels, labels (arrays, sorted),
    found (label, first word and share of agreeing words of each template placed), score: 1 if a base phrase stands
    somewhere, else the best share of a template's words that stand at their places."""
    n, df = document_frequency(docs, sorted({w for _, t, _ in templates for w in t.split()}), text_col)
    postings, needs = rare_index(n, df, templates, rare, share)
    rare_words = sorted({w for w, _, _ in postings})
    index = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(t).alias("t"), F.lit(p).alias("p")) for w, t, p in postings])
    notice = F.array(*[_strings(t.split()) for _, t, _ in templates])
    label = _strings([x for x, _, _ in templates])
    need = F.array(*[F.lit(k) for k in needs])
    must = F.array(*[F.array(*[F.struct(F.lit(_at(text, p)).alias("q"), _strings(p.split()).alias("w")) for p in phrases])
                     for _, text, phrases in templates])

    name = free_name(docs, name)
    c = {k: free_name(docs, f"{k}_of_scan") for k in ("arr", "hits", "agreed", "first", "found", "base")}
    out = docs.withColumn(c["arr"], words(F.col(quoted(text_col))))
    arr = F.col(c["arr"])
    # every posting of every rare word in the file: (template, where it would begin)
    own = F.filter(F.transform(arr, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(rare_words))
    start = F.flatten(F.transform(own, lambda x: F.transform(F.filter(index, lambda p: p["w"] == x["w"]),
                                                           lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("o")))))
    kind = "array<struct<t:int,o:int>>"
    out = out.withColumn(c["hits"], F.when(F.arrays_overlap(arr, _strings(rare_words)), F.sort_array(start)).otherwise(F.array().cast(kind)))
    hits = F.col(c["hits"])
    # sorted, so that a beginning named often enough meets itself need - 1 further on
    out = out.withColumn(c["agreed"], F.filter(hits, lambda x, i: F.get(hits, i + F.get(need, x["t"]) - 1) == x))
    agreed = F.col(c["agreed"])
    # still sorted, so that equal ones stand side by side
    out = out.withColumn(c["first"], F.filter(agreed, lambda x, i: (i == 0) | (F.get(agreed, F.greatest(i - 1, F.lit(0))) != x)))
    holds = F.filter(F.col(c["first"]), lambda x: F.forall(F.get(must, x["t"]), lambda m: F.when(
        x["o"] + m["q"] >= 0, F.slice(arr, F.greatest(x["o"] + m["q"] + 1, F.lit(1)), F.size(m["w"])) == m["w"]).otherwise(False)))

    def agreement(x):
        text = F.get(notice, x["t"])
        return F.size(F.filter(text, lambda w, j: F.when(x["o"] + j >= 0, F.get(arr, x["o"] + j) == w).otherwise(False))) / F.size(text)

    out = out.withColumn(c["found"], F.transform(holds, lambda x: F.struct(
        F.get(label, x["t"]).alias("label"), x["o"].alias("first_word"), agreement(x).alias("share"))))
    places = [_places(arr, p) for p, _ in base]
    out = out.withColumn(c["base"], F.array(*places))
    bases, found = F.col(c["base"]), F.col(c["found"])
    none = F.array().cast("array<string>")
    base_labels = F.concat(none, *[F.when(F.size(F.get(bases, F.lit(k))) > 0, F.array(F.lit(x))).otherwise(none)
                                   for k, (_, x) in enumerate(base)])
    spots = F.array_sort(F.flatten(bases))
    score = F.when(F.size(spots) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0)))
    return out.withColumn(name, F.struct(
        F.size(arr).cast("long").alias("n_words"), spots.alias("places"),
        F.array_sort(F.array_distinct(base_labels)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(found, lambda x: x["label"])))).alias("labels"),
        found.alias("found"), score.alias("score"))).drop(*c.values())


def _at(text: str, phrase: str) -> int:
    """Where a phrase begins in a template, in words."""
    t, p = text.split(), phrase.split()
    return next(k for k in range(len(t)) if t[k:k + len(p)] == p)
