"""Operator 3: licence scan and inheritance along directories, in DataFrame functions only.

1. IDF. Documents that hold a template term are counted over the whole corpus; a term
   outside the templates gets the greatest weight, ``ln(N + 1)``, so foreign words always
   count against a match. What reaches the driver is one number per template term.
2. Candidates. Every text is cut into lines, and runs of lines that follow one another (but
   for lines without terms) up to the words of the longest template (wrapped headers); it is
   also taken as a whole (a licence file may be one statement over many lines). The terms of
   a template are heavy but for the lightest ones whose weights together cannot reach the
   threshold; a line, run or text without a heavy term of any template is skipped without
   loss (Cauchy-Schwarz), and so is a run with too many other terms (``run_limits``).
3. Cosine. The rest are scored against every template, exactly, from the template terms
   they hold and the number of all their terms.
4. Inheritance. A directory's licence is that of the best licence file in it: one whose
   whole text is a statement, or one named LICENSE, COPYING or the like that holds a
   statement anywhere, as the full licence texts do; named ones come first. Distinct
   directories of files without a statement of their own are joined with their ancestors
   once - not the files, of which one directory may hold a third - and the deepest
   ancestor with a licence wins; the files then join their directory.

Defined cases: null text is empty and has no licence; a null path is one file in no
directory: it neither gives nor inherits; ties go to the template whose name sorts first,
then to the first line; repeated rows give repeated results; an empty table gives an
empty result; input columns named like an output column are replaced, all others kept,
whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_apart, written

# fixed values: licence statements by SPDX name
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": [
        "Dedicated to the public domain under CC0 1.0.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "Proprietary": [
        "All rights reserved.",
    ],
}

#: Cosine from which a line or a whole text states a licence.
MIN_COSINE = 0.65

#: Paths of licence files by their name.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]es?|unlicen[cs]e|copying)(-[^/]*)?([.](txt|text|md|rst|html?))?$"

_SPLIT = "[^a-z0-9]+"
_UNITS = "array<struct<at: int, to: int, h: array<string>, n: int>>"


def template_terms(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(name, sorted distinct terms) of every template."""
    return [(name, sorted({w for w in re.split(_SPLIT, t.lower()) if w}))
            for name, texts in sorted(templates.items()) for t in texts]


def _terms(text: Column) -> Column:
    """Distinct terms of a lower-case text."""
    return F.array_remove(F.array_distinct(F.split(text, _SPLIT, -1)), "")


def inverse_frequencies(files: DataFrame, text: str, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """IDF of every template term, and that of a term outside the templates."""
    total = files.count()
    words = files.select(F.explode(_terms(F.lower(F.col(text)))).alias("w")).where(F.col("w").isin(vocabulary))
    df = {r["w"]: r["count"] for r in words.groupBy("w").count().collect()}  # one row per template term
    return ({w: math.log((total + 1.0) / (df.get(w, 0) + 1.0)) + 1e-6 for w in vocabulary},
            max(math.log(total + 1.0), 1.0))


def heavy_terms(templates: list[tuple[str, list[str]]], idf: dict[str, float], least: float) -> list[str]:
    """Terms of which a text needs one to reach the cosine ``least`` with any template."""
    heavy: set[str] = set()
    for _, words in templates:
        whole, light = sum(idf[w] ** 2 for w in words), 0.0
        for w in sorted(words, key=lambda w: (idf[w], w)):
            light += idf[w] ** 2
            if light >= least * least * whole * (1 - 1e-9):
                heavy.add(w)
    return sorted(heavy)


def run_limits(templates: list[tuple[str, list[str]]], idf: dict[str, float], rarest: float,
               least: float) -> tuple[int, float]:
    """What a unit that reaches the cosine ``least`` has: so many terms outside the templates
    at most (its norm is at most a template's over ``least``), and so great a share of terms
    inside them at least (no term weighs more than one outside)."""
    most = max(sum(idf[w] ** 2 for w in words) for _, words in templates)
    return int(most / (least * rarest) ** 2 * (1 + 1e-9)), least * least * (1 - 1e-4)


def runs(lines: Column, heavy: Column, width: int, foreign: int, share: float) -> Column:
    """Units of two to ``width`` of ``lines`` (at, h: template terms, f: other terms) in a row:
    those with a heavy term, inside the limits, whose last line adds a template term."""
    none = F.array().cast(_UNITS)

    def longer(a: Column, x: Column) -> Column:
        grown = F.struct(F.array_union(a["h"], x["h"]).alias("h"), F.array_union(a["f"], x["f"]).alias("f"))
        return F.when(F.size(a["f"]) > foreign, a).otherwise(F.transform(F.array(grown), lambda g: F.struct(
            g["h"].alias("h"), g["f"].alias("f"), F.when(
                (F.size(g["h"]) > F.size(a["h"])) & (F.size(g["f"]) <= foreign)
                & (F.size(g["h"]) >= share * (F.size(g["h"]) + F.size(g["f"]))) & F.arrays_overlap(g["h"], heavy),
                F.concat(a["w"], F.array(F.struct(F.lit(0).alias("at"), x["at"].alias("to"), g["h"].alias("h"),
                                                  (F.size(g["h"]) + F.size(g["f"])).alias("n"))))).otherwise(a["w"]).alias("w")))[0])

    def from_line(ls: Column) -> Column:
        return F.flatten(F.transform(ls, lambda s, i: F.when(
            (F.size(s["h"]) > 0) & (F.size(s["f"]) <= foreign),
            F.transform(F.aggregate(F.slice(ls, i + 2, F.lit(width - 1)),
                                    F.struct(s["h"].alias("h"), s["f"].alias("f"), none.alias("w")), longer, lambda a: a["w"]),
                        lambda u: F.struct(s["at"].alias("at"), u["to"].alias("to"), u["h"].alias("h"), u["n"].alias("n"))))
            .otherwise(none)))

    return F.transform(F.array(lines), from_line)[0]


def weights(templates: list[tuple[str, list[str]]], idf: dict[str, float]) -> list[tuple[str, str | None, float]]:
    """(term, template, weight) of the sparse matrix that a unit's terms are multiplied with:
    its normalised templates, and for the norm of the unit a row of squares without name."""
    out: list[tuple[str, str | None, float]] = [(w, None, v * v) for w, v in idf.items()]
    for k, (name, words) in enumerate(templates):
        norm = math.sqrt(sum(idf[w] ** 2 for w in words))
        out += [(w, f"{name}/{k}", idf[w] ** 2 / norm) for w in words]
    return out


def cosines(units: DataFrame, templates: list[tuple[str, list[str]]], idf: dict[str, float], rarest: float,
            least: float) -> DataFrame:
    """(row, at, to, cosine, license) of the units (row, at, to, hits, n) that reach ``least``."""
    matrix = units.sparkSession.createDataFrame(weights(templates, idf), "w string, template string, x double")
    hits = units.select("row", "at", "to", (F.col("n") - F.size("hits")).alias("other"), F.explode("hits").alias("w"))
    dots = (hits.join(F.broadcast(matrix), "w")  # as many rows as the templates have terms
            .groupBy("row", "at", "to", "other", "template").agg(F.sum("x").alias("dot")))
    best = dots.groupBy("row", "at", "to", "other").agg(
        F.max(F.when(F.col("template").isNull(), F.col("dot"))).alias("mass"),
        F.min(F.when(F.col("template").isNotNull(), F.struct((-F.col("dot")).alias("d"), F.col("template").alias("name")))).alias("b"))
    norm = F.sqrt(F.col("mass") + F.col("other") * F.lit(rarest * rarest))
    return (best.select("row", "at", "to", (-F.col("b.d") / norm).alias("cosine"),
                        F.regexp_replace("b.name", "/[0-9]+$", "").alias("license"))
            .where(F.col("cosine") >= least))


def own_licenses(files: DataFrame, path: str, text: str, templates: dict[str, list[str]] | None = None,
                 min_cosine: float = MIN_COSINE) -> DataFrame:
    """``files`` without the text, with ``license, cosine, line_no, scope``: the best
    statement of each file and the line it starts in (``scope`` file: the whole text is one,
    or the file has the name of a licence file; header: a line or a run of lines is)."""
    known = template_terms(templates or TEMPLATES)
    vocabulary = sorted({w for _, words in known for w in words})
    out = ("license", "cosine", "line_no", "scope")
    cols = [c for c in files.columns if c not in (*out, text)]
    idf, rarest = inverse_frequencies(files, text, vocabulary)
    heavy = F.array(*[F.lit(w) for w in heavy_terms(known, idf, min_cosine)])
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    foreign, share = run_limits(known, idf, rarest, min_cosine)
    width = max(len(re.findall("[a-z0-9]+", t.lower())) for texts in (templates or TEMPLATES).values() for t in texts)
    unit = lambda at, h, n: F.struct(at.alias("at"), at.alias("to"), h.alias("h"), n.alias("n"))

    def line(t: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), F.array_intersect(t, vocab).alias("h"), F.array_except(t, vocab).alias("f"))

    def units_of(ls: Column) -> Column:
        alone = F.transform(F.filter(ls, lambda x: F.arrays_overlap(x["h"], heavy)),
                            lambda x: unit(x["at"], x["h"], F.size(x["h"]) + F.size(x["f"])))
        return F.concat(alone, runs(ls, heavy, width, foreign, share))

    # of a text that can state a licence: itself, and its lines and runs of lines that can
    lines = F.filter(F.transform(F.split(body, "\n", -1), lambda x, i: line(_terms(x), i)),
                     lambda x: (F.size(x["h"]) > 0) | (F.size(x["f"]) > 0))
    parts = lambda t: F.concat(F.transform(F.array(lines), units_of)[0],
                               F.array(unit(F.lit(-1), F.array_intersect(t, vocab), F.size(t))))
    rows = written(files.select(
        *cols, F.monotonically_increasing_id().alias("_row"),
        F.transform(F.array(_terms(body)), lambda t: F.when(F.arrays_overlap(t, heavy), parts(t)))[0].alias("_u")), "lines")
    units = rows.select(F.col("_row").alias("row"), F.explode("_u").alias("u")).select(
        "row", "u.at", "u.to", F.col("u.h").alias("hits"), "u.n")
    found = cosines(units, known, idf, rarest, min_cosine)
    # a whole text that is a licence comes before its lines; then the best, then the first
    best = (found.groupBy("row").agg(F.min(F.struct((F.col("at") >= 0).alias("header"), F.round(-F.col("cosine"), 12).alias("c"),
                                                    "at", "license")).alias("b"))
            .select(F.col("row").alias("_of"), "b.*"))
    return (rows.select(*cols, "_row").join(best, F.col("_row") == F.col("_of"), "left")
            .withColumn("cosine", -F.col("c"))
            .withColumn("line_no", F.when(F.col("header"), F.col("at") + 1))
            .withColumn("scope", F.when(F.col("header") & ~F.coalesce(F.col(path).rlike(LICENSE_FILE), F.lit(False)), "header")
                        .when(F.col("header").isNotNull(), "file"))
            .select(*cols, *out))


def directory(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def _ancestors(folder: Column) -> Column:
    """A directory and all above it, the root last."""
    parts = F.split(folder, "/", -1)
    size = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(size, F.lit(0), F.lit(-1)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))


@columns_apart("path", "text")
def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None,
         min_cosine: float = MIN_COSINE) -> DataFrame:
    """``files`` without the text, with ``license, cosine, line_no, scope, inherited_from``.

    A file without a statement takes the licence of the nearest directory above it that
    holds a licence file (``scope`` inherited).
    """
    out = ("license", "cosine", "line_no", "scope", "inherited_from")
    own = written(own_licenses(files, path, text, templates, min_cosine).withColumn(
        "_dir", directory(F.col(path))), "own")
    cols = [c for c in own.columns if c not in (*out, "_dir")]
    given = (own.where("scope = 'file' and _dir is not null").groupBy(F.col("_dir").alias("up"))
             .agg(F.min(F.struct(~F.col(path).rlike(LICENSE_FILE), -F.col("cosine"), "license")).alias("b"))
             .select("up", F.col("b.license").alias("given")))
    lacking = own.where("license is null and _dir is not null").select("_dir").distinct()
    # written, so that the last join can split a directory that holds very many files
    from_above = written(lacking.withColumn("a", F.explode(_ancestors(F.col("_dir")))).select("_dir", "a.depth", "a.up")
                  .join(given, "up").groupBy("_dir").agg(F.max_by(F.struct("given", "up"), "depth").alias("g"))
                  .select(F.col("_dir").alias("_of"), "g.given", "g.up"), "directories")
    takes = F.col("license").isNull() & F.col("given").isNotNull()
    return (own.join(from_above, (F.col("_dir") == F.col("_of")) & F.col("license").isNull(), "left")
            .withColumn("scope", F.when(takes, "inherited").otherwise(F.col("scope")))
            .withColumn("inherited_from", F.when(takes, F.col("up")))
            .withColumn("license", F.coalesce("license", "given"))
            .select(*cols, *out))
