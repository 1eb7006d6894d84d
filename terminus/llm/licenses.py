"""License scans: TF-IDF cosine to templates, then inheritance down the tree.

*Own licence.* Every text is read whole. Its licence passages are its lines with
a cue word and the runs of neighbouring such lines; a licence file (named
LICENSE, COPYING, ..) is also taken as a whole. Each passage is a sparse TF-IDF
vector, and so is each window of it with as many terms as a template: words
around a notice then count for nothing. The template with the largest cosine
gives the licence if it reaches ``THRESHOLD``. A licence file without any cue
word is only compared as a whole. An ``SPDX-License-Identifier`` is taken as it
stands (score 1).

*Document frequencies* are counted over all words of all texts. A term in fewer
than one in ``RARE`` texts weighs as one in ``RARE``: a term with a fixed share
of the texts then weighs the same in a table of ``RARE`` texts or any larger
one. So only terms above that share need a count: at most ``RARE`` times the
mean number of distinct terms of a text, however many texts there are.

*Inheritance.* A file without a licence takes that of the nearest directory at
or above its own that holds a licence file with one. Distinct directories are
joined with the licensed ones by their ancestor paths; files then join their
directory, salted, so that a directory with a third of all files is split.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terminus.llm.common import table, written

THRESHOLD = 0.6
RARE = 1000
COUNTED_AT_ONCE = 200_000
SALTS = 8
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
CUE = re.compile(r"licen[sc]|copyright|spdx|redistribut|permission|public domain", re.I)
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+:-]*\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9][a-z0-9.+:-]*\)*)*)",
                  re.I)
LICENCE_FILE = r"(?i)^(un)?licen[sc]e|^copying|^notice"

# Customary notices of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Terms:
    """All terms there can be."""

    def __contains__(self, term: str) -> bool:
        return TERM.fullmatch(term) is not None


VOCABULARY = Terms()  # whose document frequencies count
NAMES = {name.lower(): name for name, _ in TEMPLATES}


def declared(text: str) -> str | None:
    """The first SPDX expression of a text; a single identifier by its template's
    name (``-only``, ``-or-later`` and ``+`` left out) if it has one."""
    for m in SPDX.finditer(text):
        found = " ".join(m.group(1).split())
        found += ")" * (found.count("(") - found.count(")"))
        if found.upper() not in ("NONE", "NOASSERTION"):
            return NAMES.get(re.sub(r"(-only|-or-later|\+)$", "", found.lower()), found)
    return None


def passages(text: str, whole: bool) -> list[str]:
    """Cue lines, runs of neighbouring cue lines, and the text itself if ``whole``."""
    if not CUE.search(text):
        return [text] if whole and text else []
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        if CUE.search(line):
            out.append(line)
            run.append(line)
            continue
        if len(run) > 1:
            out.append("\n".join(run))
        run = []
    return [*out, text] if whole else out


class Matcher:
    """Best template of a passage by TF-IDF cosine."""

    def __init__(self, n_docs: int, df: dict[str, int]):
        weight = lambda n: min(math.log((1 + n_docs) / (1 + n)), math.log(1 + RARE)) + 1
        self.unseen = weight(0)
        self.idf = {t: weight(n) for t, n in df.items()}
        self.templates = [(name, self.vector(terms(text)), len(terms(text))) for name, text in TEMPLATES]

    def vector(self, words: list[str]) -> dict[str, float]:
        raw = {t: n * self.idf.get(t, self.unseen) for t, n in Counter(words).items()}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
        return {t: v / norm for t, v in raw.items()}

    def window(self, words: list[str], template: dict[str, float], size: int) -> float:
        """The largest cosine of ``size`` neighbouring words."""
        weights = [self.idf.get(t, self.unseen) for t in words]
        held, square, dot, best = Counter(), 0.0, 0.0, 0.0
        for i, (t, w) in enumerate(zip(words, weights, strict=True)):
            square += (2 * held[t] + 1) * w * w
            held[t] += 1
            dot += w * template.get(t, 0.0)
            if i >= size:
                t, w = words[i - size], weights[i - size]
                square -= (2 * held[t] - 1) * w * w
                held[t] -= 1
                dot -= w * template.get(t, 0.0)
            if i >= size - 1 and dot > 0:
                best = max(best, dot / math.sqrt(square))
        return best

    def best(self, text: str, whole: bool) -> tuple[str | None, float]:
        name = declared(text)
        if name:
            return name, 1.0
        found = (0.0, "")
        for passage in passages(text, whole):
            words = terms(passage)
            v, cue = self.vector(words), CUE.search(passage)
            for name, t, size in self.templates:
                score = sum(w * v.get(term, 0.0) for term, w in t.items())
                if cue and len(words) > size:
                    score = max(score, self.window(words, t, size))
                found = max(found, (round(score, 9), name))
        return (found[1] if found[0] >= THRESHOLD else None), found[0]


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per term, added up over the partition as far as memory goes; "" has the number of texts."""
    df = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64())], ["term", "n"])

    for batch in batches:
        df[""] += batch.num_rows
        for text in batch.column(0):
            df.update(set(terms(text.as_py() or "")))
            if len(df) >= COUNTED_AT_ONCE:
                yield counted()
                df.clear()
    yield counted()


def _scan(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(*model.value)
        for batch in batches:
            got = [match.best(t.as_py() or "", w.as_py()) for t, w in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array([x for x, _ in got], pa.string()),
                 pa.array([s for _, s in got], pa.float64())],
                ["doc_id", "path", "licence_file", "own_license", "own_score"])
    return run


def directory_of(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, salts: int = SALTS) -> DataFrame:
    """``files(doc_id, path, text, ..)`` -> one row per file: ``doc_id, path,
    own_license, own_score, license, license_dir``.

    ``license`` is the own one (``license_dir`` null) or the inherited one with
    its directory; both are null if there is none. Of several licence files in a
    directory the best score wins, then the first path. Null and empty texts have
    no own licence and score 0; a null path is a file in the root. Repeated rows
    and null doc_ids pass through; other columns are not read. An empty table
    gives no rows.
    """
    spark = files.sparkSession
    rows = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("path").cast("string").alias("path"),
                        F.col("text").cast("string").alias("text"))
    counted = written(rows.select("text").mapInArrow(_document_frequency, "term string, n bigint")
                      .groupBy("term").agg(F.sum("n").alias("n")))
    n_docs = counted.filter("term = ''").agg(F.sum("n")).first()[0] or 0
    often = counted.filter((F.col("term") != "") & ((F.col("n") + 1) * (RARE + 1) > n_docs + 1)).collect()  # bounded: see above
    model = spark.sparkContext.broadcast((n_docs, {r.term: r.n for r in often}))
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1)
    found = written(rows.withColumn("licence_file", name.rlike(LICENCE_FILE)).select("doc_id", "path", "text", "licence_file")
                    .mapInArrow(_scan(model), "doc_id bigint, path string, licence_file boolean, own_license string, "
                                "own_score double").withColumn("dir", directory_of(F.col("path"))))
    licensed = (found.filter("licence_file and own_license is not null").groupBy("dir")
                .agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", "own_license")).alias("l"))
                .select(F.col("dir").alias("license_dir"), F.col("l.own_license").alias("inherited")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
        F.concat_ws("/", F.slice(parts, 1, k)).alias("license_dir"), k.alias("depth")))
    # An absolute path's first part is empty: "" is then named twice, once per depth.
    nearest = (found.select("dir").distinct().select("dir", F.inline(above)).join(licensed, "license_dir")
               .groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "inherited")).alias("n"))
               .select("dir", "n.license_dir", "n.inherited")
               .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(salts)).cast("int"))
    own = F.col("own_license").isNotNull()
    return salted.join(nearest, ["dir", "salt"], "left").select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"),
        F.when(~own, F.col("license_dir")).alias("license_dir"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: the table has no paths, so they follow from source
    and doc_id (up to three directories deep; some are named LICENSE)."""
    docs = table(spark, sf_dir, "documents")
    h = F.md5(F.col("doc_id").cast("string").cast("binary"))
    digit = lambda i: F.conv(F.substring(h, i, 1), 16, 10).cast("int")
    dirs = F.slice(F.array(F.substring(h, 2, 1), F.substring(h, 3, 1), F.substring(h, 4, 1)), F.lit(1), digit(1) % 4)
    name = F.when(digit(5) == 0, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", F.array(F.col("source")), dirs, F.array(name)).alias("path"), "text")
