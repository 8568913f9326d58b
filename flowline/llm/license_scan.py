"""Licence scans, with DataFrame functions only.

Segments of a document (lines, sentences, paragraphs, word windows around a template's telling words,
and the whole text) are compared with licence templates (notices, titles, sentences and whole texts) by
sparse TF-IDF cosine, all frequencies from the corpus; a document takes the licence of its best segment.
A document that is mostly licence text is a licence file and speaks for its directory; a document without
a licence of its own inherits that of the nearest directory above it that has one.  A text may stand at
further paths (:func:`page_places`), where it speaks and inherits as well.

Documents without a template's telling words are never exploded: a segment that holds none of
a template's anchors (its heaviest terms, taken until the rest of its vector is shorter than the
threshold) has a cosine below the threshold, by the Cauchy-Schwarz inequality.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from .shared import materialise, small, word_count

# Header lines and opening sentences by which licences are recognised, under their SPDX ids.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved."),
)
#: Licences whose whole texts are kept in ``licences``, each as one template and, if short, by paragraphs too.
TEXTS = tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licences").glob("*.txt")))
SHORT_WORDS = 400
TEMPLATES += tuple((name, p) for name, text in TEXTS if len(text.split()) <= SHORT_WORDS for p in re.split(r"\n\s*\n", text) if len(p.split()) >= 12)
TEMPLATES += TEXTS
#: A bare notice, which stands back where any other licence is found.
NOTICE = "Proprietary"
#: Word windows: lengths, each stepped by a quarter of it.
WINDOWS = (3, 5, 8, 12, 24, 48)
#: Lengths of segments in words, from and to, that are compared with the same templates: those of half to twice a length among them.
LENGTHS = ((1, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, 64), (65, 128), (129, 512), (513, 4096), (4097, 1 << 30))
#: Least cosine of a header, and least share of a document's words that makes it a licence file.
COSINE, FILE_SHARE = 0.8, 0.5
#: Names of licence files.
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
#: What stands between terms.
_BREAK = "[^a-z0-9+]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BREAK), "")


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, n): in how many texts each term of the corpus occurs; the empty term has the number of texts."""
    terms = F.explode(F.array_union(F.array(F.lit("")), F.split(F.lower("text"), _BREAK)))
    return materialise(docs.where("text is not null").select(terms.alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n > 1 or term = ''"), "frequencies")


def template_terms(counted: DataFrame, templates=TEMPLATES) -> tuple[list[tuple[int, str, dict[str, float]]], int]:
    """(number, licence, weights of length 1) of each template, and the number of texts ``counted`` (:func:`frequencies`) is of.

    Weights are (1 + log count) * log((documents + 1) / (documents with the term + 1)) + a small constant; a term of one
    document counts as one of none.  The result is bounded by the templates.
    """
    split = [(i, name, _split(text)) for i, (name, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in split for w in ws})
    mine = F.broadcast(_terms(counted, vocabulary))
    df = {r["term"]: r["n"] for r in counted.join(mine, "term").collect()}
    total = df.get("", 0)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 0.1 for w in vocabulary}
    out = []
    for i, name, ws in split:
        weights = {w: (1 + math.log(k)) * idf[w] for w, k in Counter(ws).items()}
        length = math.sqrt(sum(v * v for v in weights.values()))
        out.append((i, name, {w: v / length for w, v in weights.items()}))
    return out, total


def _terms(counted: DataFrame, vocabulary: list[str]) -> DataFrame:
    return counted.sparkSession.createDataFrame([(w,) for w in ["", *vocabulary]], "term string")


def _split(text: str) -> list[str]:
    return [w for w in re.split(_BREAK, text.lower()) if w]


def anchors(weighted: list[tuple[int, str, dict[str, float]]], cosine: float) -> list[str]:
    """Terms of which every segment at the threshold of some template has one."""
    out = set()
    for _, _, weights in weighted:
        rest = 1.0
        for w, v in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
            if rest < cosine * cosine:
                break
            out.add(w)
            rest -= v * v
    return sorted(out)


def one_of(words: list[str]) -> str:
    """A pattern for any of ``words``, branching letter by letter, so that a place in a text is tried once and not for every word."""
    end = any(w == "" for w in words)
    by_letter: dict[str, list[str]] = {}
    for w in words:
        if w:
            by_letter.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + one_of(rest) for c, rest in sorted(by_letter.items())]
    if not branches:
        return ""
    return "(?:" + "|".join(branches) + ")" + "?" * end


def headers(docs: DataFrame, cosine: float = COSINE, templates=TEMPLATES) -> DataFrame:
    """(doc_id, path, licence, cosine, n_segment, n_words, copy): the best segment at the threshold of each (doc_id, path).

    ``n_segment`` is the number of words that segments with this licence cover: lines, sentences or paragraphs
    together, or the longest window, whichever is most.  Copies of a text are compared once; ``copy`` is its MD5.
    """
    counted = frequencies(docs)
    weighted, total = template_terms(counted, templates)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, name, w, v) for i, name, ws in weighted for w, v in ws.items()], "template int, licence string, term string, weight double"))
    telling = anchors(weighted, cosine)
    anchor = rf"(?<![a-z0-9+]){one_of(telling)}(?![a-z0-9+])"
    held = materialise(docs.where(F.lower("text").rlike(anchor)).select("doc_id", "path", "text", F.md5("text").alias("copy")), "held")
    texts = held.dropDuplicates(["copy"]).withColumn("row", F.monotonically_increasing_id())
    texts = materialise(texts.select("row", "copy", "text", word_count(F.col("text")).alias("n_words"), _words(F.col("text")).alias("w")), "texts")
    lines = F.split("text", "\n")
    paragraphs = F.split("text", r"\n[\x20\t\r]*\n")
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?:;])\s+")))
    sizes = {i: len(_split(text)) for i, (_, text) in enumerate(templates)}

    def near(low: float, high: float) -> list[str]:
        """Anchors of the templates that segments of ``low`` to ``high`` words are compared with: those of half to twice their length."""
        return anchors([t for t in weighted if low <= 2 * sizes[t[0]] and sizes[t[0]] <= 2 * high], cosine)

    def told(words: Column) -> Column:
        out = F.lit(False)
        for low, high in LENGTHS:
            out = F.when(F.size(words).between(low, high), F.arrays_overlap(words, F.array(*map(F.lit, near(low, high) or [""])))).otherwise(out)
        return out

    pieces = lambda kind, of: F.filter(F.transform(F.filter(of, lambda s: F.lower(s).rlike(anchor)), lambda s: F.struct(F.lit(kind).alias("kind"), _words(s).alias("words"))), lambda s: told(s["words"]))
    def windows(k: int) -> Column:
        """Windows that start at multiples of a quarter of their length, near a telling word."""
        step, telling = max(1, k // 4), near(k, k)
        places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(*telling))
        starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(F.floor((p - k + step) / step), F.lit(0)), F.floor(p / step)))))
        return F.transform(starts, lambda i: F.struct(F.lit("window").alias("kind"), F.slice("w", (i * step + 1).cast("int"), F.lit(k)).alias("words")))

    whole = F.filter(F.array(F.struct(F.lit("whole").alias("kind"), F.col("w").alias("words"))), lambda s: told(s["words"]))
    every = F.concat(pieces("line", lines), pieces("sentence", sentences), pieces("paragraph", paragraphs), whole, *[F.when(F.size("w") > 0, windows(k)).otherwise(F.array().cast("array<struct<kind:string,words:array<string>>>")) for k in WINDOWS])
    # outer: else the optimiser adds a filter that evaluates the exploded array a second time
    segments = texts.select("row", F.posexplode_outer(every).alias("line", "s"))
    terms = segments.select("row", "line", "s.kind", F.explode_outer("s.words").alias("term")).where("term is not null")
    terms = terms.groupBy("row", "line", "kind", "term").agg(F.count("*").alias("n"))
    terms = materialise(terms, "terms")
    # frequencies of the segments' own terms: one row per term on both sides, so no term is hot
    known = counted.join(terms.select("term").distinct(), "term").select("term", (F.log((F.lit(total) + 1) / (F.col("n") + 1)) + 0.1).alias("idf"))
    rarity = small(materialise(known, "rarity"))
    terms = terms.join(rarity, "term", "left").withColumn("v", (1 + F.log(F.col("n").cast("double"))) * F.coalesce("idf", F.lit(math.log(total + 1) + 0.1)))
    lengths = terms.groupBy("row", "line", "kind").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"), F.sum("n").alias("n_segment"))
    dots = terms.join(table, "term").groupBy("row", "line", "template", "licence").agg(F.sum(F.col("v") * F.col("weight")).alias("dot"))
    close = dots.join(lengths, ["row", "line"]).withColumn("cosine", F.round(F.col("dot") / F.col("length"), 9)).where(F.col("cosine") >= cosine)
    by_line = close.groupBy("row", "licence", "kind", "line").agg(F.max("cosine").alias("cosine"), F.max("n_segment").alias("n"), F.min("template").alias("template"))
    by_kind = by_line.groupBy("row", "licence", "kind").agg(F.when(F.col("kind") == "window", F.max("n")).otherwise(F.sum("n")).alias("n"), F.max(F.struct("cosine", F.col("n").alias("longest"), F.negative("template").alias("template"))).alias("b"))
    by_licence = by_kind.groupBy("row", "licence").agg(F.max("n").alias("n_segment"), F.max("b").alias("b"))
    rank = F.struct(F.col("licence") != NOTICE, "b.cosine", "b.longest", "b.template", "n_segment")
    best = by_licence.groupBy("row").agg(F.max_by(F.struct("licence", "b.cosine", "n_segment"), rank).alias("f"), F.max(rank).alias("rank"))
    of_text = texts.select("row", "copy", "n_words").join(best, "row").select("copy", "n_words", "f", "rank")
    of_row = held.select("doc_id", "path", "copy").distinct().join(small(materialise(of_text, "found")), "copy")
    return of_row.groupBy("doc_id", "path").agg(F.max_by(F.struct("f.*", "n_words", "copy"), F.struct("rank", "copy")).alias("b")).select("doc_id", "path", "b.*")


def directory(path: Column) -> Column:
    """The path without its last part; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _bare(text: Column) -> Column:
    """The MD5 of a text without its ASCII white space."""
    for gap in " \n\r\t\x0b\x0c":
        text = F.replace(text, F.lit(gap), F.lit(""))
    return F.md5(text)


def article(html: Column) -> Column:
    """What stands between the first and the last ``article`` tag of a page; empty where it has no two."""
    pieces = F.split(html, r"</?[aA][rR][tT][iI][cC][lL][eE](?=[\s/>])[^<>]*>", -1)
    return F.array_join(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), "")


def visible(html: Column) -> Column:
    """The text of ``html``: no scripts, styles, comments and tags, usual entities resolved.  What isn't closed goes to the end."""
    out = F.regexp_replace(html, r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\b[^<>]*>|\z)|style\b.*?(?:</style\b[^<>]*>|\z)|[^<>]*>)", "")
    for char, entities in (("\xa0", ("nbsp", "#160")), ("<", ("lt", "#60")), (">", ("gt", "#62")), ('"', ("quot", "#34")), ("'", ("apos", "#39")), ("&", ("#38", "amp"))):
        for entity in entities:
            out = F.replace(out, F.lit(f"&{entity};"), F.lit(char))
    return out


def page_places(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(copy, path): the paths at which texts of ``docs`` (text) stand in ``pages`` (url, html), ``copy`` being the text's MD5.

    A text stands at a page if it is that of the page's article, with or without its main heading, white space aside.  The path is
    ``//``, the host with A-Z lower-cased and the url's path, up to ``?`` or ``#``; pages without ``://`` before these, host or article are
    no places, nor are texts of white space only.  One row per text and path, however many documents and pages share them.
    """
    rest = F.regexp_extract("url", r"^[^?#]*?://([^?#]+)", 1)
    host = F.translate(F.regexp_extract(rest, "^[^/]+", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    under = F.regexp_extract(rest, "^[^/]+(/.*)$", 1)
    path = F.when(host != "", F.concat(F.lit("//"), host, F.when(under == "", "/").otherwise(under)))
    inside = article(F.col("html"))
    headless = F.regexp_replace(inside, r"(?s)<[hH]1\b.*?(?:</[hH]1\b[^<>]*>|\z)", "")
    # written first: filters on the digests would otherwise be evaluated on the texts, once more
    shown = materialise(pages.select(path.alias("path"), F.array(_bare(visible(inside)), _bare(visible(headless))).alias("bare")), "articles")
    texts = materialise(docs.select(F.md5("text").alias("copy"), _bare(F.col("text")).alias("bare")), "bare")
    shown = shown.where("path is not null").select("path", F.explode("bare").alias("bare")).where(F.col("bare") != F.md5(F.lit(""))).distinct()
    return texts.distinct().join(shown, "bare").select("copy", "path").distinct()


def scan(docs: DataFrame, cosine: float = COSINE, file_share: float = FILE_SHARE, templates=TEMPLATES, places: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, licence, origin, cosine, licence_path) of every row of ``docs`` (doc_id, path, text).

    ``origin`` is file, header, inherited or none.  A licence file is one by name, or one whose licence segment makes up
    ``file_share`` of its words; of several in a directory the one with the highest cosine speaks for it, then the first path.
    Null and empty texts have no licence of their own but inherit; a null path is a file in the root; rows that share doc_id and
    path share the result; ties between templates go to the longer segment, then the first template; an empty table gives no
    rows; other columns are ignored.

    ``places`` (copy, path) are further paths of the text with that MD5: it speaks for their directories too, and is a licence file if one
    of them is named so.  A text that hears nothing at its own path hears at each place the nearest directory, and of these
    the highest cosine counts, then the first licence path.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path"), F.lit("")).alias("path"), F.col("text"))
    own = headers(slim, cosine, templates).withColumn("is_file", F.col("path").rlike(FILE_NAME) | (F.col("n_segment") >= file_share * F.col("n_words")))
    if places is not None:
        places = materialise(places.select("copy", "path"), "places")
        named = small(materialise(places.where(F.col("path").rlike(FILE_NAME)).select("copy").distinct().withColumn("named", F.lit(True)), "named"))
        own = own.join(named, "copy", "left").withColumn("is_file", F.col("is_file") | F.col("named").isNotNull()).drop("named")
    own = materialise(own, "licences")
    files = own.where("is_file").select("path", "licence", "cosine")
    if places is not None:
        texts = small(materialise(own.where("is_file").select("copy", "licence", "cosine").distinct(), "files"))
        files = files.unionByName(places.join(texts, "copy").select("path", "licence", "cosine"))
    speak = files.groupBy(directory(F.col("path")).alias("dir")).agg(F.min_by(F.struct("licence", "cosine", "path"), F.struct(F.negative("cosine"), "path")).alias("spoken"))
    speak = materialise(speak, "directories")
    # nearest ancestor: every directory that occurs is joined with its ancestors once, not once per document
    paths = slim.select("path") if places is None else slim.select("path").unionByName(places.select("path"))
    dirs = paths.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = dirs.select("dir", F.explode(above).alias("up"))
    heard = speak.select(F.col("dir").alias("up"), "spoken")
    nearest = small(materialise(up.join(small(heard), "up").groupBy("dir").agg(F.max_by("spoken", F.length("up")).alias("spoken")), "nearest"))
    keyed = slim.select("doc_id", "path", directory(F.col("path")).alias("dir"), F.md5("text").alias("copy")).join(nearest, "dir", "left")
    if places is not None:
        told = places.select("copy", directory(F.col("path")).alias("dir")).join(nearest, "dir").groupBy("copy")
        told = small(materialise(told.agg(F.min_by("spoken", F.struct(F.negative("spoken.cosine"), "spoken.path")).alias("told")), "told"))
        keyed = keyed.join(told, "copy", "left").withColumn("spoken", F.coalesce("spoken", "told")).drop("told")
    mine = small(own.select(F.struct("doc_id", "path", "licence", "cosine", "is_file").alias("own")))
    joined = keyed.join(mine, keyed["doc_id"].eqNullSafe(mine["own.doc_id"]) & (keyed["path"] == mine["own.path"]), "left")
    has, heard = F.col("own").isNotNull(), F.col("spoken").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("own.licence", "spoken.licence").alias("licence"),
        F.when(F.col("own.is_file"), "file").when(has, "header").when(heard, "inherited").otherwise("none").alias("origin"),
        F.coalesce("own.cosine", "spoken.cosine").alias("cosine"), F.when(has, F.col("path")).otherwise(F.col("spoken.path")).alias("licence_path"),
    )
