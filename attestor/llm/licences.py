"""Licence scans: canonical digest lookup.

A text becomes its canonical form: lower case, no copyright lines, one spelling for equivalent words, words joined by single
spaces. The SHA-256 of the whole form is joined with the digests of known licence texts; so are the digests of its lines and of
its sentences with those of known notices and of the licences' own sentences. Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that names a holder: with a year or a sign, or a capitalised holder to its end; comment marks may precede.
COPYRIGHT = r"^[ \t*#/;-]*(?:(?i:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|(?i:\(c\))|©)[^\n]*|(?:\([cC]\)|©)[^\n]*|Copyright(?: [A-Z][\w.,&'-]*)+|(?i:all rights reserved)[.]?)[ \t]*\r?$"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Spellings that mean the same in a licence.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorised": "authorized",
    "behaviour": "behavior", "favour": "favor", "fulfil": "fulfill", "honour": "honor", "judgement": "judgment", "noninfringement": "non infringement",
    "organisation": "organization", "recognised": "recognized", "sublicence": "sublicense", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while", "http": "https",
}

#: Texts of licences as their publishers give them, without copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD_CONDITION = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""
GPL_NOTICE = "{0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version"
#: Whole texts of licences, and identifiers as whole texts.
KNOWN = {
    "MIT": (MIT, "MIT License\n\n" + MIT, "The MIT License (MIT)\n\n" + MIT), "ISC": (ISC, "ISC License\n\n" + ISC), "Zlib": (ZLIB, "zlib License\n\n" + ZLIB), "Apache-2.0-notice": (APACHE_NOTICE,),
}
#: SPDX identifiers and the names that notices use.
NAMES = {
    "MIT": ("MIT License", "MIT Licence", "MIT"), "ISC": ("ISC License",), "Zlib": ("zlib License",), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD license"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"), "Apache-1.1": ("Apache License, Version 1.1",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPLv2", "GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPLv3", "GPL version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"), "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"), "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"), "MPL-1.1": ("Mozilla Public License, version 1.1",),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "Eclipse Public License 1.0"), "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"), "CDDL-1.0": ("Common Development and Distribution License 1.0", "CDDL 1.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"), "Artistic-2.0": ("Artistic License 2.0",), "Unlicense": ("Unlicense", "Unlicense License"), "WTFPL": ("WTFPL",), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "PostgreSQL": ("PostgreSQL License",), "Python-2.0": ("Python License 2.0", "PSF License"), "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"), "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL 1.2"),
    "NCSA": ("University of Illinois/NCSA Open Source License",), "AFL-3.0": ("Academic Free License 3.0",), "MS-PL": ("Microsoft Public License",), "UPL-1.0": ("Universal Permissive License 1.0",), "X11": ("X11 License",),
} | {
    f"CC-{x}-{v}": (f"CC {x} {v}", f"CC-{x}-{v}", f"Creative Commons {name} {v}", f"Creative Commons {name} {v} International License", f"Creative Commons {name} {v} License")
    for x, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    for v in ("2.0", "2.5", "3.0", "4.0")
}
#: What stands around a name in a notice.
SUBJECTS = ("", "this work is ", "this software is ", "this program is ", "this project is ", "this file is ", "this code is ")
VERBS = ("licensed under", "released under", "distributed under", "available under")
#: Sentences of longer licences and notices.
SENTENCES = {
    "BSD": (BSD_CONDITION,), "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "GPL-2.0-or-later": ("This program is free software; you can redistribute it and/or modify it under the terms of the " + GPL_NOTICE.format("GNU General Public License", "2").replace(",", ";", 1),),
    "GPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the " + GPL_NOTICE.format("GNU General Public License", "3"),),
    "AGPL-3.0-or-later": ("This program is free software: you can redistribute it and/or modify it under the terms of the " + GPL_NOTICE.format("GNU Affero General Public License", "3"),),
}
#: Marks of line and sentence ends, of Unicode's private characters; in a text they count as such ends.
LINE, END = "\ue001", "\ue002"
#: Hexadecimal digits of a part's digest that are compared.
PREFIX = 16


def _marked(text: Column) -> Column:
    """Lower-case words without copyright lines, one spelling a word, with marks at the ends of lines and sentences."""
    out = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "(?md)" + COPYRIGHT, "")
    out = F.regexp_replace(F.translate(out, UPPER, LOWER), "[.!?]+([ \t\r\n]|\\z)", f" {END} $1")
    out = F.regexp_replace(F.replace(out, F.lit("\n"), F.lit(f" {LINE} ")), MARKS, " ")
    # Two spaces between words, so that neighbours don't share one.
    out = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
    return out


def _without(marked: Column, *marks: str) -> Column:
    for mark in marks:
        marked = F.replace(marked, F.lit(mark), F.lit(""))
    return F.btrim(F.regexp_replace(marked, " +", " "))


def canonical(text: Column) -> Column:
    """The canonical form; empty for null."""
    return _without(_marked(text), LINE, END)


def known(spark: SparkSession, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """digest, licence of whole texts: a few rows, fixed by the texts."""
    own = texts or KNOWN | {f"SPDX-{name}": (f"SPDX-License-Identifier: {name}",) for name in (*NAMES, "BSD")}
    rows = spark.createDataFrame([(name, t) for name, all_of in own.items() for t in all_of], "licence string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def forms() -> list[tuple[str, str]]:
    """Names, and the notices, identifiers and sentences that stand for them as a line or a sentence."""
    out = [(name, f"{subject}{verb} {the}{title}") for name, titles in NAMES.items() for title in titles for subject in SUBJECTS for verb in VERBS for the in ("", "the ", "a ")]
    out += [(f"SPDX-{name}", f"SPDX-License-Identifier: {name}") for name in (*NAMES, "BSD")]
    out += [(name, x) for name, all_of in SENTENCES.items() for x in all_of]
    whole = {"MIT": MIT, "ISC": ISC, "Zlib": ZLIB, "Apache-2.0": APACHE_NOTICE}
    told = {name: {" ".join(x.split()) for x in re.split(r"(?<=[.!?])\s+", text) if len(x.split()) > 8} for name, text in whole.items()}
    return out + [(name, x) for name, own in told.items() for x in sorted(own) if sum(x in other for other in told.values()) == 1]


@lru_cache(maxsize=1)
def _parts(app: str, spark: SparkSession) -> tuple[list[str], list[int], list[str]]:
    """Digests of the forms, in order, the place of each one's name, and the names: a table of fixed size."""
    rows = spark.createDataFrame(forms(), "name string, text string").select("name", F.substring(F.sha2(canonical(F.col("text")), 256), 1, PREFIX).alias("d"))
    by = {r.d: r.name for r in rows.groupBy("d").agg(F.min("name").alias("name")).collect()}
    names = sorted(set(by.values()))
    return list(by), [names.index(n) for n in by.values()], names


def scan(docs: DataFrame, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, digest, licence (null if none), licences for every row of docs (doc_id, text).

    licence is what the whole text is; licences are the sorted names, each once, of those that a line or a sentence of the text
    is a notice, an identifier or a sentence of. Null and blank texts have the digest of the empty text and no licence. Repeated
    rows and rows without a doc_id stay; other columns aren't read. Both tables of known digests are of fixed size and go to
    every executor; no document is shuffled.
    """
    spark = docs.sparkSession
    digests, places, names = _parts(spark.sparkContext.applicationId, spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _marked(F.col("text")).alias("marked"))
    pieces = F.concat(F.split(_without(F.col("marked"), END), f" ?{LINE} ?"), F.split(_without(F.col("marked"), LINE), f" ?{END} ?"))
    rows = rows.select("doc_id", F.sha2(_without(F.col("marked"), LINE, END), 256).alias("digest"), F.transform(pieces, lambda p: F.substring(F.sha2(p, 256), 1, PREFIX)).alias("parts"))
    listed = ", ".join(f"'{d}'" for d in digests)
    rows = rows.withColumn("hits", F.expr(f"array_distinct(filter(parts, p -> p in ({listed})))"))
    table, places_of, names_of = F.expr(f"array({listed})"), F.expr(f"array({', '.join(map(str, places))})"), F.expr("array(" + ", ".join(f"'{n}'" for n in names) + ")")
    named = F.transform("hits", lambda p: F.get(names_of, F.get(places_of, F.array_position(table, p).cast("int") - 1)))
    found = F.when(F.size("hits") == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array_sort(F.array_distinct(named)))
    rows = rows.select("doc_id", "digest", found.alias("licences"))
    return rows.join(F.broadcast(known(spark, texts)), "digest", "left").select("doc_id", "digest", "licence", "licences")


def notices(docs: DataFrame) -> DataFrame:
    """doc_id, licences of scan()."""
    return scan(docs).select("doc_id", "licences")


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def marked(column: str) -> str:
        out = f"regexp_replace(coalesce({column}, ''), {quote('(?m)' + COPYRIGHT)}, '', 'g')"
        out = f"regexp_replace(translate({out}, '{UPPER}', '{LOWER}'), '[.!?]+([ \\t\\r\\n]|\\z)', ' {END} \\1', 'g')"
        out = f"regexp_replace(replace({out}, chr(10), ' {LINE} '), {quote(MARKS)}, ' ', 'g')"
        out = f"' ' || replace({out}, ' ', '  ') || ' '"
        for a, b in SPELLINGS.items():
            out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b} ')"
        return out

    def without(column: str, *marks: str) -> str:
        for mark in marks:
            column = f"replace({column}, '{mark}', '')"
        return f"trim(regexp_replace({column}, ' +', ' ', 'g'))"

    whole = KNOWN | {f"SPDX-{name}": (f"SPDX-License-Identifier: {name}",) for name in (*NAMES, "BSD")}
    values = lambda rows: ", ".join(f"({quote(n)}, {quote(t)})" for n, t in rows)
    digest = lambda x: f"sha256({without(x, LINE, END)})"
    return f"""with k as (select min(licence) as licence, {digest('m')} as digest from (select licence, {marked('text')} as m from (values {values((n, t) for n, own in whole.items() for t in own)}) v(licence, text)) group by 2),
f as (select {digest('m')}[1:{PREFIX}] as d, min(name) as name from (select name, {marked('text')} as m from (values {values(forms())}) v(name, text)) group by 1),
d as (select row_number() over () as i, doc_id, {marked('text')} as m from documents),
p as (select i, unnest(list_concat(string_split_regex({without('m', END)}, ' ?{LINE} ?'), string_split_regex({without('m', LINE)}, ' ?{END} ?'))) as part from d),
h as (select i, list(distinct name order by name) as licences from p join f on f.d = sha256(part)[1:{PREFIX}] group by 1)
select doc_id, {digest('m')} as digest, k.licence, coalesce(licences, []) as licences from d left join k on k.digest = {digest('m')} left join h using (i)"""


SQL = _sql()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What licence each document is, and which it holds notices of."""
    return scan(table(spark, sf_dir, "documents"))
