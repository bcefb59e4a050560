"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

The lines of every text that use a word of licensing are its headers. The document frequencies of all terms come
from the texts that have headers, a Spark aggregate of their distinct terms. For each notice, the best window of
a line, as long as the notice, is compared with it by the cosine of their vectors; a document's own licence is
that of its best header, and "all rights reserved" counts only where no other licence is found. The whole text,
less its copyright lines, is compared with the notices and with full licence texts: where the template makes up
at least `mostly` of its squared weight (the cosine squared), it is a licence file and licenses its directory. A
document without a licence of its own takes that of the nearest directory above it that has one, found by joining
paths.

Null and empty texts have no header; null paths belong to no directory. Of several licence files in a directory
the best cosine counts, ties to the smaller licence name.
"""

from __future__ import annotations

import importlib.resources
import math
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.spans import scan
from riskframe.llm.tables import join_salted, written

# The notices that licences ask for, or their first sentences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("BSD-3-Clause", "Released under the BSD License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "Licensed under the GNU General Public License version 3"),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright. All rights reserved"),
)
TRIGGER = re.compile(r"(?ai:licen[sc]e|copyright|rights reserved|public domain|permission is hereby|spdx|redistribution)")
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
COPYRIGHT = re.compile(r"(?im)^\W*(?:copyright\s*(?:\(c\)|©|[<\[]?(?:\d{4}|year|yyyy))|©).*$")
RESERVED = "Proprietary"
#: The most frequent terms, whose weights every task has; those of the others are joined.
FREQUENT = 20_000


def words_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def terms(words: list[str]) -> Counter:
    """Words and pairs of neighbours."""
    return Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def body(text: str) -> str:
    """The text without its copyright lines, if anything else is in it."""
    rest = COPYRIGHT.sub("", text)
    return rest if TERM.search(rest) else text


def terms_of(text: str) -> set[str]:
    """Terms of a text and of its body, in which other words may be neighbours."""
    return set(terms(words_of(text))) | set(terms(words_of(body(text))))


def full_texts() -> list[tuple[str, str]]:
    folder = importlib.resources.files(__package__) / "license_texts"
    return sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in folder.iterdir() if f.name.endswith(".txt"))


def rank(cosine: float, name: str) -> tuple[bool, float, str]:
    return name == RESERVED, -cosine, name


class Index:
    """Templates as normalised TF-IDF vectors, and the weights of their terms and of the frequent ones."""

    def __init__(self, counts: dict[str, int], n: int, texts: list[tuple[str, str]]) -> None:
        self.n = n
        self.idf = {t: self.weight(count) for t, count in counts.items()}
        self.notices = [(name, len(words_of(text)), self.template(text)) for name, text in TEMPLATES]
        self.names = [name for name, _ in TEMPLATES] + [name for name, _ in texts]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, text in enumerate([text for _, text in TEMPLATES] + [text for _, text in texts]):
            for term, w in self.template(body(text)).items():
                self.postings.setdefault(term, []).append((i, w))

    def weight(self, count: int) -> float:
        """At least 1."""
        return math.log((1 + self.n) / (1 + count)) + 1

    def template(self, text: str) -> dict[str, float]:
        v = {t: (1 + math.log(k)) * self.idf[t] for t, k in terms(words_of(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def header(self, line: str, least: float, rare: dict[str, float]) -> tuple[float, str] | None:
        """The best notice and the cosine of its best window; terms neither in the index nor in rare weigh 1."""
        words = words_of(line)
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        best = None
        for name, size, template in self.notices:
            # What a window shares with the template bounds its cosine.
            own = list(accumulate((template.get(a, 0.0) ** 2 + template.get(b, 0.0) ** 2 for a, b in zip(words, [*pairs, ""], strict=True)), initial=0.0))
            for at in range(max(1, len(words) - size + 1)):
                end = min(at + size, len(words))
                if own[end] - own[at] < least * least - 1e-9:
                    continue
                dot = square = 0.0
                for t, k in (Counter(words[at:end]) + Counter(pairs[at : end - 1])).items():
                    w = (1 + math.log(k)) * (self.idf.get(t) or rare.get(t, 1.0))
                    square += w * w
                    dot += w * template.get(t, 0.0)
                cosine = dot / math.sqrt(square)
                if cosine >= least and (best is None or rank(cosine, name) < rank(*best)):
                    best = cosine, name
        return best

    def whole(self, counts: Counter) -> tuple[float, float, str] | None:
        """Of a whole text: the best product with a template, the squared weight of the indexed terms, the name."""
        dots: Counter = Counter()
        square = 0.0
        for t, k in counts.items():
            if t in self.idf:
                w = (1 + math.log(k)) * self.idf[t]
                square += w * w
                for i, x in self.postings.get(t, ()):
                    dots[i] += w * x
        best = min(((-dot, self.names[i]) for i, dot in dots.items()), default=None)
        return (-best[0], square, best[1]) if best else None


def fit(docs: DataFrame) -> tuple[Index, DataFrame]:
    """The index, and (term, count): the texts with headers in which a term is, for all of their terms."""

    def rows_of():
        # The empty term counts the texts.
        return lambda columns: [[["", *terms_of(x)] if x and TRIGGER.search(x) else [] for x in columns[0]]]

    found = written(scan(docs, ("text",), "terms array<string>", rows_of).select(F.explode("terms").alias("term")).groupBy("term").count(), "license-terms")
    texts = full_texts()
    own = sorted({t for _, text in [*TEMPLATES, *texts] for t in terms_of(text)} | {""})
    known = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in own], "term string"))
    counts = dict.fromkeys(own, 0)
    counts |= {r["term"]: r["count"] for r in found.join(known, "term").collect()}  # at most as many as the templates have terms
    counts |= {r["term"]: r["count"] for r in found.orderBy(F.desc("count"), "term").limit(FREQUENT).collect()}
    return Index(counts, counts.pop(""), texts), found


def headers(text: str) -> list[tuple[int, int, str]]:
    """The lines that speak of licensing: (start, end, line)."""
    if not TRIGGER.search(text):
        return []
    out, at = [], 0
    for line in text.split("\n"):
        if TRIGGER.search(line):
            out.append((at, at + len(line), line))
        at += len(line) + 1
    return out


def decided(best: tuple[float, str] | None, whole: tuple[float, float, str] | None, mostly: float) -> tuple[str | None, float, bool]:
    """license, cosine, is_license_file."""
    if whole and whole[0] ** 2 >= (mostly - 1e-9) * whole[1]:
        return whole[2], min(1.0, whole[0] / math.sqrt(whole[1])), True
    return (best[1], min(1.0, best[0]), False) if best else (None, 0.0, False)


def better(a: tuple[float, str] | None, b: tuple[float, str] | None) -> tuple[float, str] | None:
    return min((x for x in (a, b) if x), key=lambda x: rank(*x), default=None)


def classified(docs: DataFrame, index: Index, counts: DataFrame, least: float, mostly: float) -> DataFrame:
    """doc_id, path, license, cosine, is_license_file.

    With rare terms at the smallest weight, 1, cosines are only too large: what they already decide is decided in
    the first pass. Headers and whole texts that may still match, and have rare terms, wait for their counts. A
    key of that join is in few texts, as more frequent terms are in the index.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    ids = f"doc_id {kinds['doc_id']}, path {kinds['path']}"

    def first():
        own = shared.value
        cache: dict[str, tuple[tuple[float, str] | None, list[str]]] = {}

        def header(line: str) -> tuple[tuple[float, str] | None, list[str]]:
            if line not in cache:
                if len(cache) > 50_000:
                    cache.clear()
                best = own.header(line, least, {})
                cache[line] = best, [t for t in terms(words_of(line)) if t not in own.idf] if best else []
            return cache[line]

        def row(text: str | None) -> tuple:
            best, waiting, rare, whole = None, [], {}, None
            for _, _, line in headers(text or ""):
                found, unknown = header(line)
                if unknown:
                    waiting.append(line)
                    rare |= dict.fromkeys(unknown, 0)
                else:
                    best = better(best, found)
            if text and TRIGGER.search(text):
                tf = terms(words_of(body(text)))
                whole = own.whole(tf)
                unknown = {t: k for t, k in tf.items() if t not in own.idf}
                if whole and whole[0] ** 2 < (mostly - 1e-9) * (whole[1] + sum((1 + math.log(k)) ** 2 for k in unknown.values())):
                    whole = None
                if whole:
                    rare |= unknown
            license, cosine, file = decided(best, whole, mostly) if not rare else (None, 0.0, False)
            said = [*(best or (None, None)), *(whole or (None, None, None))] if rare else [None] * 5
            return license, cosine, file, *said, waiting, [{"term": t, "tf": k} for t, k in rare.items()]

        def rows(columns: list) -> list[list]:
            out = [row(text) for text in columns[2]]
            return [*columns[:2], *([r[i] for r in out] for i in range(10))]

        return rows

    def second():
        own = shared.value

        def row(best_cosine, best_license, dot, square, name, waiting, found) -> tuple:
            weights = {x["term"]: own.weight(x["count"]) for x in found}
            best = (best_cosine, best_license) if best_license else None
            for line in waiting:
                best = better(best, own.header(line, least, weights))
            whole = (dot, square + sum(((1 + math.log(x["tf"])) * weights[x["term"]]) ** 2 for x in found if x["tf"]), name) if name else None
            return decided(best, whole, mostly)

        def rows(columns: list) -> list[list]:
            out = [row(*x) for x in zip(*columns[2:], strict=True)]
            return [*columns[:2], *([r[i] for r in out] for i in range(3))]

        return rows

    result = "license string, cosine double, is_license_file boolean"
    state = "best_cosine double, best_license string, dot double, square double, name string, waiting array<string>"
    passed = scan(docs, ("doc_id", "path", "text"), f"{ids}, {result}, {state}, rare array<struct<term:string,tf:int>>", first)
    passed = written(passed.withColumn("row", F.monotonically_increasing_id()), "license-rows")
    done, open_ = passed.where(F.size("rare") == 0), passed.where(F.size("rare") > 0)
    weighed = open_.select("row", F.inline("rare")).join(counts, "term").groupBy("row").agg(F.collect_list(F.struct("term", "tf", "count")).alias("found"))
    names = ("doc_id", "path", "best_cosine", "best_license", "dot", "square", "name", "waiting", "found")
    return done.select("doc_id", "path", "license", "cosine", "is_license_file").unionAll(scan(open_.join(weighed, "row"), names, f"{ids}, {result}", second))


def directories(path: Column) -> Column:
    """The directories above a path, the nearest first: a/b/c.txt has a/b and a."""
    parts = F.split(path, "/")
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(docs: DataFrame, least: float = 0.55, mostly: float = 0.5) -> DataFrame:
    """docs (doc_id, path, text) as doc_id, path, license, cosine, is_license_file, inherited_from, effective_license."""
    docs = docs.select("doc_id", "path", "text")
    own = written(classified(docs, *fit(docs), least, mostly), "licenses")
    folder = F.try_element_at(directories(F.col("path")), F.lit(1))
    files = own.where("is_license_file").select(folder.alias("dir"), "license", "cosine").where("dir is not null")
    licensed = files.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license"))["license"].alias("dir_license"))
    # Each directory once: its ancestors meet the licensed directories, the nearest wins.
    folders = own.select("path", folder.alias("folder")).where("folder is not null").groupBy("folder").agg(F.min("path").alias("path"))
    above = folders.select("folder", F.posexplode(directories(F.col("path"))).alias("up", "dir"))
    nearest = above.join(licensed, "dir").groupBy("folder").agg(F.min(F.struct("up", "dir", "dir_license")).alias("x"))
    nearest = nearest.select("folder", F.col("x.dir").alias("inherited_from"), F.col("x.dir_license").alias("dir_license"))
    out = join_salted(own.withColumn("folder", folder), nearest, "folder", "path", "left")
    has = F.col("license").isNotNull()
    return out.select("doc_id", "path", "license", "cosine", "is_license_file", F.when(~has, F.col("inherited_from")).alias("inherited_from"), F.coalesce("license", "dir_license").alias("effective_license"))
