"""License scans: passages compared with licence templates by the Dice coefficient over word bigrams.

A passage is a line of a text, a block between blank lines, the whole text, or, as a notice may stand inside a longer line,
a sentence of a line or two neighbouring ones (``sentences``). Case, punctuation and repeated blanks do not count.
Templates are notices, the usual wordings around the names of licences, and whole licence texts (``licence_texts/``). A template is a candidate for a passage only if their numbers of different bigrams allow the coefficient:
with threshold t, one side may have at most (2 - t) / t times the bigrams of the other. Bigrams meet by a join with
the templates' bigrams, so nothing is compared that shares none; a passage longer than any template allows is dropped
before its bigrams become rows. Shared bigrams are summed per passage and template.

Defined results: null and empty texts and those of one word have no bigrams and match nothing. Equal rows (id and
text) are one. Sentences are numbered through the text, two neighbours by their first. Of several templates with the same coefficient the first by name is reported.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import query, table

#: The notices by which texts name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT-notice": "Licensed under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "Licensed under the GNU General Public License v3.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain.",
    "Proprietary": "All rights reserved.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
#: Names under which notices speak of licences, and the words around them.
NAMES = {
    "MIT": ("the MIT License",), "ISC": ("the ISC License",), "BSD-2-Clause": ("the BSD 2-Clause License",), "BSD-3-Clause": ("the BSD 3-Clause License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    **{f"{short}-{v}.0" if len(v) == 1 else f"{short}-{v}": (f"the GNU {long} Public License, version {v}", f"the GNU {long} Public License v{v}", f"the {short} v{v}")
       for short, long, versions in (("GPL", "General", "2 3"), ("LGPL", "Lesser General", "2.1 3"), ("AGPL", "Affero General", "3")) for v in versions.split()},
}
FORMS = (
    "Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This project is licensed under {}.",
    "This software is released under {}.", "This code is distributed under the terms of {}.")
TEMPLATES |= {f"{k}-notice-{i}{j}": form.format(name) for k, names in NAMES.items() for i, name in enumerate(names) for j, form in enumerate(FORMS)}
TEMPLATES |= {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bigrams(text: Column) -> Column:
    """Different pairs of neighbouring words. The words are bound to a name, so that a text is cut once."""
    def pairs(w):
        both = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.slice(both, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))

    return F.get(F.transform(F.array(words(text)), pairs), F.lit(0))


def _passages(text: Column, sentences: bool) -> Column:
    """(kind, nth, text): lines, blocks of more than one line, and the whole text if it has more than one block.

    With ``sentences`` also those of lines that have several, each alone and with the next one.
    """
    numbered = lambda kind, parts: F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), p.alias("text")))
    lines, blocks = F.split(text, "\n"), F.split(text, "\n[ \t]*\n")
    more = F.filter(numbered("block", blocks), lambda p: F.contains(p["text"], F.lit("\n")))
    whole = F.when(F.size(blocks) > 1, numbered("text", F.array(text))).otherwise(F.array().cast("array<struct<kind:string,nth:int,text:string>>"))
    parts = [numbered("line", lines), more, whole]
    if sentences:
        several = F.filter(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?;:])\s+")), lambda x: F.size(x) > 1)
        two = F.transform(several, lambda x: F.transform(x, lambda y, i: F.concat_ws(" ", y, F.get(x, i + 1))))
        last = F.transform(several, lambda x: F.transform(x, lambda y, i: i + 1 == F.size(x)))
        pairs = F.filter(F.transform(F.arrays_zip(F.flatten(two).alias("t"), F.flatten(last).alias("last")), lambda x, i: F.struct(
            F.lit("sentences").alias("kind"), i.alias("nth"), F.when(~x["last"], x["t"]).alias("text"))), lambda x: x["text"].isNotNull() & (x["text"] != ""))
        parts += [numbered("sentence", F.flatten(several)), pairs]
    return F.concat(*parts)


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = 0.8,
    sentences: bool = True,
) -> DataFrame:
    """doc_id, kind, nth, license, dice: the best template of every passage that reaches the threshold."""
    spark = docs.sparkSession
    slack = (2 - threshold) / threshold
    known = spark.createDataFrame(sorted(templates.items()), "license string, notice string").withColumn("pairs", bigrams(F.col("notice")))
    known = known.select("license", F.size("pairs").alias("size"), F.explode("pairs").alias("pair"))
    longest = max((len(x.split()) for x in templates.values()), default=0) * 4  # words of a template, however they are cut
    cut = F.transform(F.filter(_passages(F.col("text"), sentences), lambda p: p["text"] != ""), lambda p: F.struct(
        p["kind"].alias("kind"), p["nth"].alias("nth"), bigrams(p["text"]).alias("pairs")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    pairs = rows.select("doc_id", F.xxhash64("text").alias("k"), F.explode(cut).alias("p")).select("doc_id", "k", "p.*").where(
        F.size("pairs").between(1, longest * slack))
    each = pairs.select("doc_id", "k", "kind", "nth", F.size("pairs").alias("own"), F.explode("pairs").alias("pair"))
    met = each.join(F.broadcast(known), "pair").where((F.col("own") <= F.col("size") * slack) & (F.col("size") <= F.col("own") * slack))
    key = ["doc_id", "k", "kind", "nth"]
    # equal rows give the same pairs several times: different pairs are counted
    shared = met.groupBy(*key, "license", "own", "size", "pair").agg(F.lit(1).alias("one")).groupBy(*key, "license", "own", "size").agg(F.count("*").alias("shared"))
    close = shared.withColumn("dice", 2 * F.col("shared") / (F.col("own") + F.col("size"))).where(F.col("dice") >= threshold)
    best = Window.partitionBy(*key).orderBy(F.desc("dice"), "license")
    return close.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("doc_id", "kind", F.col("nth").cast("bigint").alias("nth"), "license", "dice")


_VALUES = ", ".join("('%s', '%s')" % (k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_SQL = f"""
WITH known AS (SELECT license, {_PAIRS} AS pairs FROM (SELECT license, {_WORDS.format('notice')} AS w FROM (VALUES {_VALUES}) t(license, notice))),
base AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS blocks FROM documents WHERE text IS NOT NULL),
passages AS (
  SELECT doc_id, text AS k, 'line' AS kind, unnest(range(len(lines))) AS nth, unnest(lines) AS p FROM base
  UNION ALL SELECT * FROM (SELECT doc_id, text AS k, 'block' AS kind, unnest(range(len(blocks))) AS nth, unnest(blocks) AS p FROM base) WHERE contains(p, chr(10))
  UNION ALL SELECT doc_id, text, 'text', 0, text FROM base WHERE len(blocks) > 1),
cut AS (SELECT doc_id, k, kind, nth, {_PAIRS} AS pairs FROM (SELECT *, {_WORDS.format('p')} AS w FROM passages) WHERE len(w) > 1),
scored AS (SELECT doc_id, k, kind, nth, license, 2.0 * len(list_intersect(c.pairs, n.pairs)) / (len(c.pairs) + len(n.pairs)) AS dice FROM cut c, known n
  WHERE len(c.pairs) BETWEEN len(n.pairs) / 3.0 AND len(n.pairs) * 3.0)
SELECT doc_id, kind, nth, license, CAST(dice AS DOUBLE) AS dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, k, kind, nth ORDER BY dice DESC, license) = 1
"""


@query("op5_licenses", _SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents"), sentences=False)  # the SQL has no sentences
