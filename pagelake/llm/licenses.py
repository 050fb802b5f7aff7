"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

A notice is a span of words; its vector is tf * idf over its words, with document frequencies
counted over all documents. Every word weighs something, however common, so a notice that stands in
all documents is found like a rare one. Which spans are compared follows from the templates alone:
a span begins and ends with words of its template (others at its ends only lower the cosine), is at most
1 / least ** 2 times as long (a longer one can't reach the least cosine unless its other words are lighter)
and holds the template's licence names where the template is too short to do without.
Starts whose words to come make up too little of the template are left out; they can't reach
the cosine either. A file without a notice inherits from the
licence file of its nearest ancestor directory; that is worked out once per directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.shared import numbered
from pagelake.plans.reuse import materialize

LEAST_COSINE = 0.6
SHORT = 16
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# Notices in common use (fixed values): identifier and wording.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
]
# A template of at most SHORT words stands for a licence by these; without them 'under the License, version 2.0' would do.
NAMES = frozenset("mit apache gnu lesser affero bsd clause mozilla unencumbered cc0 cc sa nc nd".split())
NOTICE = "struct<license string, cosine double, start int, stop int>"


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, text in templates for w in WORD.findall(text.lower())})


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each template term stands, and the number of documents. Terms are a fixed few."""
    wanted = frozenset(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(wanted.intersection(WORD.findall((text.as_py() or "").lower())))
                found[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "documents"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "term string, documents long")
    rows = {r["term"]: r["documents"] for r in parts.groupBy("term").agg(F.sum("documents").alias("documents")).collect()}
    return rows, rows.pop("", 0)


class Matcher:
    """Template vectors and term weights; small enough to travel with each task."""

    def __init__(self, templates: list[tuple[str, str]], frequencies: dict[str, int], documents: int, least: float = LEAST_COSINE):
        self.least = least
        self.unknown = math.log(1 + documents) + 1  # a word that no template has
        self.idf = {w: math.log((1 + documents) / (1 + frequencies.get(w, 0))) + 1 for w in vocabulary(templates)}
        self.templates = []  # (licence, most words of a span, weights, names that a span must hold)
        for name, text in templates:
            words = WORD.findall(text.lower())
            vector = {w: n * self.idf[w] for w, n in Counter(words).items()}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            if norm:
                names = NAMES.intersection(words) if len(words) <= SHORT else frozenset()
                self.templates.append((name, math.ceil(len(words) / least**2), {w: x / norm for w, x in vector.items()}, names))

    def starts(self, hits: list[tuple[int, str]], template: tuple) -> Iterator[int]:
        """Starts of spans that may reach the least cosine: by Cauchy and Schwarz it is at most the
        norm of what the template's words in the span make up of the template."""
        _, length, weights, names = template
        own = [(k, w) for k, w in hits if w in weights]
        counts: Counter = Counter()
        share, stop = 0.0, 0
        for k, w in own:
            while stop < len(own) and own[stop][0] < k + length:
                if not counts[own[stop][1]]:
                    share += weights[own[stop][1]] ** 2
                counts[own[stop][1]] += 1
                stop += 1
            if share >= self.least**2 - 1e-9 and all(counts[n] for n in names):
                yield k
            counts[w] -= 1
            if not counts[w]:
                share -= weights[w] ** 2

    def extent(self, words: list[str], start: int, limit: int, template: tuple) -> tuple[float, int]:
        """Cosine and stop of the best span from a start, at most up to the limit; the shortest of equals."""
        _, length, weights, names = template
        counts: dict[str, int] = {}
        missing, dot, square, best = set(names), 0.0, 0.0, (0.0, start)
        for k in range(start, min(start + length, limit)):
            w = words[k]
            n, x = counts.get(w, 0), self.idf.get(w, self.unknown)
            counts[w] = n + 1
            square += (2 * n + 1) * x * x
            if w in weights:
                dot += x * weights[w]
                missing.discard(w)
                if not missing and dot > (best[0] + 1e-9) * math.sqrt(square):
                    best = (dot / math.sqrt(square), k + 1)
        return best

    def notice(self, text: str | None) -> dict | None:
        """The best notice of a whole text (the first of equals), with its place in characters."""
        low = (text or "").lower()
        words = WORD.findall(low)
        hits = [(k, w) for k, w in enumerate(words) if w in self.idf]
        known = {w for _, w in hits}
        best = (self.least - 2e-9, 0, 0, 0)
        for t, template in enumerate(self.templates):
            if template[3] <= known and sum(x * x for w, x in template[2].items() if w in known) >= self.least**2 - 1e-9:
                for start in self.starts(hits, template):
                    cosine, stop = self.extent(words, start, len(words), template)
                    if cosine > best[0] + 1e-9 or best[2] and cosine > best[0] - 1e-9 and start < best[1]:
                        best = (cosine, start, stop, t)
        cosine, a, b, t = best
        if not b:
            return None
        places = [m.span() for m in WORD.finditer(low)][a:b]
        return {"license": self.templates[t][0], "cosine": round(cosine, 6), "start": places[0][0], "stop": places[-1][1]}


def with_notice(docs: DataFrame, matcher: Matcher, text_col: str = "text", name: str = "notice") -> DataFrame:
    @F.pandas_udf(NOTICE)
    def notice(texts: pd.Series) -> pd.DataFrame:
        found = [matcher.notice(t) or {} for t in texts]
        kinds = {"license": "object", "cosine": "Float64", "start": "Int32", "stop": "Int32"}  # batches without any notice as well
        return pd.DataFrame({name: pd.Series([f.get(name) for f in found], dtype=kind) for name, kind in kinds.items()})

    return docs.withColumn(name, notice(F.col(text_col).cast("string"))).withColumn(name, F.when(F.col(f"{name}.license").isNotNull(), F.col(name)))


def directory(path: Column) -> Column:
    """The directory of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherited(files: DataFrame, is_license_file: Column | None = None) -> DataFrame:
    """The rows (path, license and others) with `effective`, `from_directory` and `levels` up.

    A file's own licence comes first (0 levels, no directory). Else the licence file of the nearest ancestor
    directory, its own directory being the nearest; of several licence files in one directory the least
    path. Null paths inherit nothing. Directories are joined, not files with ancestors.
    Without `is_license_file` the file's name decides.
    """
    is_license_file = F.col("path").rlike(LICENSE_FILE) if is_license_file is None else is_license_file
    placed = files.withColumn("_dir", directory(F.col("path")))
    owners = placed.where(is_license_file & F.col("license").isNotNull() & F.col("path").isNotNull())
    owners = owners.groupBy("_dir").agg(F.min(F.struct("path", "license")).alias("o")).select(F.col("_dir").alias("_up"), F.col("o.license").alias("_theirs"))
    owners = materialize(owners, "license-directories")
    folders = placed.where(F.col("path").isNotNull() & F.col("license").isNull()).select("_dir").distinct()
    parts = F.when(F.col("_dir") == "", F.array().cast("array<string>")).otherwise(F.split("_dir", "/"))
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    climbs = folders.withColumn("_up", F.explode(ups)).withColumn("_levels", F.size(parts) - F.when(F.col("_up") == "", 0).otherwise(F.size(F.split("_up", "/"))))
    nearest = climbs.join(owners, "_up").groupBy("_dir").agg(F.min(F.struct("_levels", "_up", "_theirs")).alias("n"))
    found = placed.join(nearest, "_dir", "left")
    own = F.col("license").isNotNull()
    return found.select(
        *files.columns,
        F.when(own, F.col("license")).otherwise(F.col("n._theirs")).alias("effective"),
        F.when(~own, F.col("n._up")).alias("from_directory"),
        F.when(own, 0).otherwise(F.col("n._levels")).alias("levels"),
    )


def scan_licenses(
    docs: DataFrame, path: Column, templates: list[tuple[str, str]] | None = None, least: float = LEAST_COSINE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, path, license, cosine, start, stop (own notice, in characters).

    Whole texts are scanned; null and empty ones have no notice. Repeated rows and null ids each get a row.
    """
    templates = templates or TEMPLATES
    frequencies, documents = document_frequencies(docs, vocabulary(templates), text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    found = with_notice(narrow, Matcher(templates, frequencies, documents, least))
    return numbered(found.select("doc_id", "path", "notice.*"), "license-scan").drop("row")
