"""Licence scans by sentence rules, in DataFrame operations only.

Every text is read twice. The first reading cuts sentences at line ends and after . ! ? ; : followed by white space; the
second takes single line ends for spaces, as in hard-wrapped notices and comment blocks, and cuts at lines without
letters or digits and after the same signs. A normalised sentence (lower case, runs of anything but a-z and 0-9 as one
space, so marks of comments go) that the dictionary knows becomes its identifier. The identifiers of a document in one
reading, in order, are matched against licence rules, which are ordered sequences of identifiers that must stand side
by side. Of the rules of one licence that match in either reading, the longest is reported.

Defined results: null and empty texts have no sentences and match nothing. Repeated rows of one doc_id are one sequence
for each row; the row with the longest match counts. Other columns are not read. An empty table gives an empty result.
The dictionary and the rules are fixed and small, so both are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepweave.llm.common import documents

# Sentences of public licence notices, by identifier.
SENTENCES: dict[str, str] = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "mit-short": "Released under the MIT License.",
    "mit-named": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-line": "Licensed under the ISC License.",
    "bsd-short": "Distributed under the BSD 3-Clause License.",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software:",
    "gpl-modify": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl2-either": "either version 2 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "lgpl3-modify": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-either": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-free": "This library is free software;",
    "agpl3-modify": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-line": "This work is licensed under a Creative Commons CC0 1.0 Universal License.",
    "cc-by-sa-full": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-full": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-full": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-version": "2.0.",
}
# Fixed values: (rule, licence, ordered sentence identifiers).
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("apache-line", "Apache-2.0", ("apache-short",)),
    ("apache-opening", "Apache-2.0", ("apache-head", "apache-use")),
    ("apache-notice", "Apache-2.0", ("apache-head", "apache-use", "apache-copy", "apache-url")),
    ("mit-line", "MIT", ("mit-short",)),
    ("mit-name", "MIT", ("mit-named",)),
    ("mit-text", "MIT", ("mit-grant", "mit-notice")),
    ("mit-full", "MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("isc-line", "ISC", ("isc-line",)),
    ("isc-text", "ISC", ("isc-grant", "isc-warranty")),
    ("apache-full", "Apache-2.0", ("apache-head", "apache-use", "apache-copy", "apache-url", "apache-unless", "apache-see")),
    ("bsd-line", "BSD-3-Clause", ("bsd-short",)),
    ("bsd2-text", "BSD-2-Clause", ("bsd-head", "bsd-source", "bsd-binary")),
    ("bsd3-text", "BSD-3-Clause", ("bsd-head", "bsd-source", "bsd-binary", "bsd-names")),
    ("gpl3-line", "GPL-3.0", ("gpl3-short",)),
    ("gpl3-notice", "GPL-3.0", ("gpl-free", "gpl-modify", "gpl-hope")),
    ("gpl2-notice", "GPL-2.0", ("gpl2-terms", "gpl2-either")),
    ("lgpl3-notice", "LGPL-3.0", ("lgpl3-modify",)),
    ("lgpl21-notice", "LGPL-2.1", ("lgpl-free", "lgpl21-terms", "lgpl21-either")),
    ("agpl3-notice", "AGPL-3.0", ("agpl3-modify",)),
    ("unlicense-text", "Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("cc0-line", "CC0-1.0", ("cc0-line",)),
    ("cc-by-sa-text", "CC-BY-SA-4.0", ("cc-by-sa-full",)),
    ("cc-by-nc-text", "CC-BY-NC-4.0", ("cc-by-nc-full",)),
    ("cc-by-nc-line", "CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("cc-by-line", "CC-BY-4.0", ("cc-by-short",)),
    ("cc-by-sa-line", "CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("cc-by-text", "CC-BY-4.0", ("cc-by-full",)),
    ("mpl-notice", "MPL-2.0", ("mpl-form", "mpl-version")),
]
CUT = r"[\n\r]+|(?<=[.!?;:])[ \t]+"
#: The second reading: lines without letters or digits part sentences, single line ends do not.
BLANK, SIGN = r"\r?\n[^A-Za-z0-9\n\r]*\r?\n", r"([.!?;:])[ \t\n\r]+"


def normalise(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def dictionary(spark: SparkSession, sentences: dict[str, str] | None = None) -> DataFrame:
    known = sentences or SENTENCES
    return spark.createDataFrame([(s, k) for k, s in known.items()], "raw string, sentence_id string").select(normalise(F.col("raw")).alias("sentence"), "sentence_id").dropDuplicates(["sentence"])


def license_sentences(docs: DataFrame, sentences: dict[str, str] | None = None) -> DataFrame:
    """doc_id, row (one for each input row), wrapped (false: first reading), position (from 0, of all sentences) and sentence_id of the known sentences."""
    numbered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    lines = F.split("text", CUT)
    joined = F.split(F.regexp_replace(F.regexp_replace("text", BLANK, "\x01"), SIGN, "$1\x01"), "\x01")
    read = numbered.select("doc_id", "row", F.explode(F.array(F.struct(F.lit(False).alias("wrapped"), lines.alias("parts")), F.struct(F.lit(True).alias("wrapped"), joined.alias("parts")))).alias("r"))
    cut = read.select("doc_id", "row", "r.wrapped", F.posexplode("r.parts").alias("position", "raw"))
    return cut.select("doc_id", "row", "wrapped", "position", normalise(F.col("raw")).alias("sentence")).join(F.broadcast(dictionary(docs.sparkSession, sentences)), "sentence").select("doc_id", "row", "wrapped", "position", "sentence_id")


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """doc_id, license, rule, n_sentences, first_position and wrapped (its reading) of the longest rule that matches for each licence.

    A rule matches sentences that stand side by side in the text. Matches within a longer match of the same reading do not
    count, so the conditions of a licence are not taken for those of one whose text is a part of them.
    """
    spark, used = docs.sparkSession, rules or RULES
    own = ("doc_id", "row", "wrapped")
    ordered = W.partitionBy(*own).orderBy("position")
    longest = max((len(ids) for _, _, ids in used), default=1)
    ahead = license_sentences(docs, sentences).withColumn("ahead", F.collect_list(F.struct("position", "sentence_id")).over(ordered.rowsBetween(0, longest - 1)))
    known = spark.createDataFrame([(r, name, list(ids), len(ids)) for r, name, ids in used], "rule string, license string, ids array<string>, n_sentences int")
    # rules are looked up by the identifier that they begin with
    opened = ahead.join(F.broadcast(known.withColumn("sentence_id", F.get("ids", 0))), "sentence_id")
    whole = F.slice("ahead.sentence_id", F.lit(1), F.col("n_sentences")) == F.col("ids")
    ends = F.col("position") + F.col("n_sentences") - 1
    matched = opened.where(whole & (F.get("ahead", F.col("n_sentences") - 1)["position"] == ends)).withColumn("ends", ends)
    before = W.partitionBy(*own).orderBy("position", F.desc("n_sentences")).rowsBetween(W.unboundedPreceding, -1)
    free = matched.withColumn("covered", F.max("ends").over(before)).where("covered IS NULL OR covered < ends")
    best = free.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("n_sentences")).alias("less"), "wrapped", F.col("position").cast("long").alias("position"), "rule")).alias("b"))
    return best.select("doc_id", "license", "b.rule", (-F.col("b.less")).cast("long").alias("n_sentences"), F.col("b.position").alias("first_position"), "b.wrapped")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def _sql_rows() -> tuple[str, str]:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(s)}, {quote(k)})" for k, s in SENTENCES.items()), ", ".join(f"({quote(r)}, {quote(name)}, {quote('|' + '|'.join(ids) + '|')}, {len(ids)})" for r, name, ids in RULES)


OP5_SQL = r"""
WITH known AS (SELECT DISTINCT trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')) AS sentence, id FROM (VALUES {sentences}) v(raw, id)),
rules AS (SELECT * FROM (VALUES {rules}) v(rule, license, pattern, n_sentences)),
cut AS (SELECT doc_id, false AS wrapped, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t]+', E'\\1\n', 'g'), '[\n\r]+') AS parts FROM documents
        UNION ALL SELECT doc_id, true, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\r?\n[^A-Za-z0-9\n\r]*\r?\n', E'\x01', 'g'), '([.!?;:])[ \t\n\r]+', E'\\1\x01', 'g'), E'\x01') FROM documents),
one AS (SELECT doc_id, wrapped, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS raw FROM cut),
hit AS (SELECT doc_id, wrapped, i - 1 AS position, id FROM one JOIN known ON sentence = trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))),
ahead AS (SELECT *, list(id) OVER w AS ids, list(position) OVER w AS places FROM hit WINDOW w AS (PARTITION BY doc_id, wrapped ORDER BY position ROWS BETWEEN CURRENT ROW AND {more} FOLLOWING)),
matched AS (SELECT doc_id, wrapped, position, license, rule, n_sentences, position + n_sentences - 1 AS ends FROM ahead JOIN rules ON starts_with('|' || array_to_string(ids, '|') || '|', pattern) AND places[n_sentences] = position + n_sentences - 1),
free AS (SELECT *, max(ends) OVER (PARTITION BY doc_id, wrapped ORDER BY position, n_sentences DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM matched)
SELECT doc_id, license, rule, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(position AS BIGINT) AS first_position, wrapped FROM free WHERE covered IS NULL OR covered < ends
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY n_sentences DESC, wrapped, position, rule) = 1
""".replace("{sentences}", _sql_rows()[0]).replace("{rules}", _sql_rows()[1]).replace("{more}", str(max(len(ids) for _, _, ids in RULES) - 1))
