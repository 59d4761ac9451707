"""Licence scan: lines and whole documents against licence templates by the Dice coefficient of word bigrams.

Text is lower-cased, everything but a-z and 0-9 becomes a space, and a unit's set is its distinct pairs of
neighbouring words, as 64-bit hashes. Dice = 2 |A and B| / (|A| + |B|). For Dice >= t the sizes obey
t/(2-t) |B| <= |A| <= (2-t)/t |B| and at least t/(2-t) |B| bigrams are shared, so a unit must hold one of
any |B| - that + 1 bigrams of the template: its longest-worded ones are the join key, and only templates
whose size bounds admit the unit are compared. DataFrame functions only; the template tables have a fixed
number of rows, so they are broadcast; nothing but matches is shuffled.

Result: one row per document and unit with a match: the template with the highest Dice (ties: first name).
Defined cases: null or empty texts and units of under two words match nothing; null doc_id is kept as null;
repeated rows of a document give one row; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices and header texts of public licences.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def bigrams_of(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(size: int, least: float) -> tuple[int, int, int]:
    """Fewest and most bigrams a unit can have, and how many bigrams of the template are its key."""
    ratio = least / (2 - least)
    return ceil(ratio * size - 1e-9), floor(size / ratio + 1e-9), size - ceil(ratio * size - 1e-9) + 1


def keys(spark: SparkSession, templates: list[tuple[str, str]], least: float) -> DataFrame:
    rows = []
    for number, (name, text) in enumerate(templates):
        grams = bigrams_of(text)
        low, high, n = bounds(len(grams), least)
        rows += [(key, number, name, grams, low, high) for key in sorted(grams, key=lambda g: (-len(g), g))[:n]]
    texts = spark.createDataFrame(rows, "key string, number int, license string, template array<string>, low int, high int")
    return texts.withColumn("key", F.xxhash64("key")).withColumn("template", F.transform("template", lambda g: F.xxhash64(g)))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, line (from 0; -1: the whole text), license, dice, n_bigrams."""
    sizes = [bounds(len(bigrams_of(text)), least) for _, text in templates]
    lines = F.split("text", "\n")
    whole = F.when(F.size(lines) > 1, F.array("text")).otherwise(F.array().cast("array<string>"))
    cut = docs.where(F.col("text").isNotNull()).select("doc_id", F.size(lines).alias("n"), F.posexplode(F.concat(lines, whole)).alias("at_line", "unit"))
    words = F.split(F.trim(F.regexp_replace(F.lower("unit"), "[^a-z0-9]+", " ")), " ")
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.xxhash64(F.concat_ws(" ", a, b)))
    # what a generator gives is computed once; a projection would be repeated wherever it is used
    units = (
        cut.select("doc_id", F.when(F.col("at_line") == F.col("n"), -1).otherwise(F.col("at_line")).alias("line"), F.explode(F.array(words)).alias("words"))
        .where(F.size("words") > min(low for low, _, _ in sizes))
        .select("doc_id", "line", F.explode(F.array(F.array_distinct(pairs))).alias("grams"))
        .where(F.size("grams").between(min(low for low, _, _ in sizes), max(high for _, high, _ in sizes)))
    )
    near = units.select("doc_id", "line", "grams", F.explode("grams").alias("key")).join(F.broadcast(keys(docs.sparkSession, templates, least)), "key")
    shared = F.size(F.array_intersect("grams", "template"))
    dice = F.round(2.0 * shared / (F.size("grams") + F.size("template")), 6)
    fits = near.where(F.size("grams").between(F.col("low"), F.col("high"))).withColumn("dice", dice).where(F.col("dice") >= least)
    best = F.max_by(F.struct("license", "dice", F.size("grams").cast("long").alias("n_bigrams")), F.struct("dice", (-F.col("number")).alias("first")))
    return fits.groupBy("doc_id", "line").agg(best.alias("best")).select("doc_id", "line", "best.*")


def sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    values = ", ".join(f"({i}, {quoted(n)}, [{', '.join(map(quoted, bigrams_of(t)))}])" for i, (n, t) in enumerate(templates))
    return f"""
with templates(number, license, template) as (values {values}),
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as unit, unnest(range(len(string_split(text, chr(10))))) as line from documents where text is not null
  union all select doc_id, text, -1 from documents where contains(text, chr(10))),
worded as (select doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') as words from lines),
sets as (
  select doc_id, line, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) as grams
  from worded where len(words) > 1),
rated as (
  select doc_id, line, license, number, len(grams) as n_bigrams,
         round(2e0 * len(list_intersect(grams, template)) / (len(grams) + len(template)), 6) as dice
  from sets join templates on len(grams) between {least} / (2 - {least}) * len(template) - 1e-9 and len(template) / ({least} / (2 - {least})) + 1e-9),
best as (select *, row_number() over (partition by doc_id, line order by dice desc, number) as nth from rated where dice >= {least})
select doc_id, cast(line as integer) as line, license, dice, n_bigrams from best where nth = 1
"""
