"""Operator 8: licence scan by Dice coefficient over word bigrams, with
DataFrame functions only.

The lines of a text, and its paragraphs of more than one line, are normalised
to lower-case words.  A unit can reach the threshold ``t`` with a template of
``m`` bigrams only if it has between ``t m / (2 - t)`` and ``m (2 - t) / t``
bigrams and shares at least ``t m / (2 - t)`` of them; so it must hold one of
any ``m - ceil(t m / (2 - t)) + 1`` bigrams of the template, and the rarer
word of it.  Texts without such a word aren't cut into units at all, units
without one are dropped before bigrams are made, templates of other sizes before bigrams are compared.  Nothing is lost.

Notices inside longer lines or blocks are found in windows over the words of
the whole text, line ends and comment marks being gaps like any other; lines
that are a template word for word are left out, so that no part of one counts
as another notice.  A window has at most ``m (2 - t) / t`` bigrams and begins
and ends with one of the template's: trimming others only raises the
coefficient.  The same bounds drop texts, templates and starts of windows.

All of it happens inside a row: no join, no shuffle, nothing that a common
licence line could skew.  Templates are a parameter, held in the plan.

Defined results: null and empty texts have no match; very long texts are scanned
whole; a unit of one word has no
bigrams and matches nothing; the best match is the highest coefficient, then
the first name; repeated rows are judged one by one; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table

THRESHOLD = 0.8

#: Wordings of public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-line": "This project is licensed under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-line": "This library is licensed under the GNU Lesser General Public License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
    # whole texts, without their copyright lines
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
}

#: What separates words: ASCII characters that are neither letters nor digits.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(GAP, " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


#: Words that most English texts hold: the last to be looked for.
COMMON = frozenset("a all an and any are as at be by for from in is it may not of on or that the this to was were which with you".split())


def gate_words(bigrams: list[str], threshold: float) -> set[str]:
    """A word for each of enough bigrams that a match can't miss them all,
    long ones where there is a choice: such words are rare in prose."""
    needed = math.ceil(threshold * len(bigrams) / (2 - threshold) - 1e-9)
    rank = lambda w: (w in COMMON, -len(w), w)
    rarer = sorted((min(b.split(), key=rank) for b in bigrams), key=rank)
    return set(rarer[: len(bigrams) - needed + 1])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, matches, embedded`` of every row: each unit's coefficient with
    each template that it reaches ``threshold`` with, as ``license, dice, unit``,
    and of the best window of each template, as ``license, dice, bigrams``."""
    sets = {k: b for k, v in sorted(templates.items()) if (b := template_bigrams(v))}
    low, high = lambda m: math.ceil(threshold * m / (2 - threshold) - 1e-9), lambda m: math.floor(m * (2 - threshold) / threshold + 1e-9)
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    known = F.array(*[F.struct(F.lit(k).alias("license"), strings(b).alias("bigrams"), F.lit(low(len(b))).alias("low"), F.lit(high(len(b))).alias("high")) for k, b in sets.items()])
    gates = strings(sorted(set().union(*[gate_words(b, threshold) for b in sets.values()])))
    # distinct bigrams are at most the words less one, and repeats in a unit only lower them
    fewest = min(low(len(b)) for b in sets.values()) + 1

    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(body, "\n")
    paragraphs = F.filter(F.split(body, "\n[ \\t\\r]*\n"), lambda p: F.instr(p, "\n") > 0)
    plain = lambda u: F.trim(F.regexp_replace(F.lower(u), GAP, " "))
    words: Column = F.transform(F.concat(lines, paragraphs), lambda u: F.split(plain(u), " "))
    likely = F.filter("gated", lambda w: F.size(w) >= fewest)
    pairs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    bigrams = F.transform(likely, lambda w: F.array_distinct(pairs(w)))

    def against(unit: Column, at: Column) -> Column:
        sized = F.filter(known, lambda t: F.size(unit).between(t["low"], t["high"]))
        scored = F.transform(sized, lambda t: F.struct(t["license"].alias("license"), (2 * F.size(F.array_intersect(unit, t["bigrams"])) / (F.size(unit) + F.size(t["bigrams"]))).alias("dice"), at.alias("unit")))
        return F.filter(scored, lambda x: x["dice"] >= threshold)

    whole = strings(sorted({re.sub(GAP, " ", v.lower()).strip() for v in templates.values()}))
    rest = F.split(F.concat_ws(" ", F.filter(F.transform(lines, plain), lambda u: (u != "") & ~F.array_contains(whole, u))), " ")
    every = strings(sorted(set().union(*sets.values())))
    run = F.col("run")

    def windows(t: Column) -> Column:
        """The best window of a template, or null."""
        ours = F.filter(F.sequence(F.lit(0), F.size(run) - 1), lambda i: F.array_contains(t["bigrams"], F.get(run, i)))
        # arrays of one, here and below, so that their element is computed once
        reach = F.flatten(F.transform(F.array(ours), lambda p: F.transform(p, lambda s, k: F.struct(s.alias("start"), F.filter(F.slice(p, k + 1, t["high"]), lambda e: e - s < t["high"]).alias("ends")))))
        enough = F.filter(reach, lambda x: F.size(F.array_distinct(F.transform(x["ends"], lambda e: F.get(run, e)))) >= t["low"])
        cut_ = lambda s, n: F.slice(run, s + 1, n)
        dice = lambda w: 2 * F.size(F.array_intersect(w, t["bigrams"])) / (F.size(F.array_distinct(w)) + F.size(t["bigrams"]))
        scored = F.transform(enough, lambda x: F.array_max(F.transform(F.filter(x["ends"], lambda e: e - x["start"] + 1 >= t["low"]), lambda e: F.struct(dice(cut_(x["start"], e - x["start"] + 1)).alias("dice"), (-x["start"]).alias("at"), (e - x["start"] + 1).alias("n")))))
        best = F.array_max(scored)
        return F.transform(F.filter(F.array(best), lambda b: b["dice"] >= threshold), lambda b: F.struct(t["license"].alias("license"), b["dice"].alias("dice"), cut_(-b["at"], b["n"]).alias("bigrams")))

    rows = columns(docs, doc_id, text).toDF("doc_id", "text")
    # most texts hold no such word: only the others are cut into units
    rows = rows.select("doc_id", "text", F.arrays_overlap(F.split(plain(body), " "), gates).alias("hopeful"))
    no_units = F.array().cast("array<array<string>>")
    rows = rows.select("doc_id", "text", F.when(F.col("hopeful"), F.filter(words, lambda w: F.arrays_overlap(w, gates))).otherwise(no_units).alias("gated"))
    rows = rows.select("doc_id", bigrams.alias("units"), F.when(F.size("gated") > 0, rest).alias("rest"))
    rows = rows.select("doc_id", F.flatten(F.transform("units", against)).alias("matches"), F.when((F.size("rest") >= fewest) & F.arrays_overlap("rest", gates), pairs(F.col("rest"))).alias("run"))
    rows = rows.select("doc_id", "matches", "run", F.array_intersect("run", every).alias("hits"))
    rows = rows.select("doc_id", "matches", "run", F.when(F.size("hits") >= fewest - 1, F.filter(known, lambda t: F.size(F.array_intersect("hits", t["bigrams"])) >= t["low"])).alias("sought"))
    none = F.array().cast("array<struct<license:string,dice:double,bigrams:array<string>>>")
    return rows.select("doc_id", "matches", F.coalesce(F.flatten(F.transform("sought", windows)), none).alias("embedded"))


def best_license(found: DataFrame) -> DataFrame:
    """``doc_id, license, dice, n_licenses``: the best match of each row."""
    found = found.select("doc_id", F.expr("concat(transform(matches, x -> struct(x.license, x.dice)), transform(embedded, x -> struct(x.license, x.dice)))").alias("matches"))
    best = F.expr("array_max(transform(matches, x -> x.dice))")
    name = F.expr("array_min(transform(filter(matches, x -> x.dice = best), x -> x.license))")
    return found.withColumn("best", best).select("doc_id", name.alias("license"), F.col("best").alias("dice"), F.size(F.array_distinct(F.col("matches.license"))).cast("long").alias("n_licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_license(scan(table(spark, sf_dir, "documents")))


def _oracle() -> str:
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = lambda x: rf"string_split(trim(regexp_replace(lower({x}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')), ' ')"
    return rf"""
WITH t AS (
  SELECT license, list_distinct([w[i] || ' ' || w[i+1] for i in range(1, len(w))]) AS b
  FROM (SELECT license, {words("text")} AS w FROM (VALUES {quoted}) v(license, text))
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), u AS (
  SELECT r, unnest(string_split(text, chr(10))) AS x FROM d
  UNION ALL
  SELECT r, x FROM (SELECT r, unnest(string_split_regex(text, '\n[ \t\r]*\n')) AS x FROM d) WHERE contains(x, chr(10))
), b AS (
  SELECT r, list_distinct([w[i] || ' ' || w[i+1] for i in range(1, len(w))]) AS b FROM (SELECT r, {words("x")} AS w FROM u) WHERE len(w) >= 2
), m AS (
  SELECT r, license, 2 * len(list_intersect(b.b, t.b)) / (len(b.b) + len(t.b)) AS dice FROM b, t
  WHERE list_has_any(b.b, t.b)
), g AS (
  SELECT r, max(dice) AS dice, arg_min(license, (-dice, license)) AS license, count(DISTINCT license) AS n FROM m WHERE dice >= {THRESHOLD} GROUP BY r
)
SELECT doc_id, license, dice, coalesce(n, 0)::BIGINT AS n_licenses FROM d LEFT JOIN g USING (r)
"""


ORACLE_SQL = _oracle()
