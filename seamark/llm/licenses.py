"""Licence scans: a digest of the canonical form of each text, joined to the digests of known licences.

The canonical form drops copyright lines, lowers case, takes equivalent spellings to one, and reduces all that isn't a letter
or digit to single spaces. Whole texts are looked up; so is each line that speaks of a licence, as a text of its own, since
notices are single lines.

Null and empty texts have the empty canonical form, which matches nothing. Rows are judged one by one, so repeated ids and rows
keep a result each. Of known licences with one digest the first id in code point order is reported. Texts and lines of any
length are taken whole. Further columns, of any name, are left away; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm.common import whole
from seamark.llm.license_digests import DIGESTS

#: Spellings that count as equal (fixed values): each is replaced by the one beside it.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisation", "capitalization"), ("catalogue", "catalog"), ("centre", "center"),
    ("customise", "customize"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil ", "fulfill "), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful ", "willful "),
    ("https:", "http:"), ("&", " and "), ("(c)", "©"),
)
#: A line that only states a copyright.
COPYRIGHT_LINE = r"(?m)^[\x20\t*#/;-]*(?:copyright\b[^\n]*(?:©|\d{4}|<year>|\[year\]|\{year\})|©)[^\n]*$|^[\x20\t*#/;-]*all rights reserved\.?[\x20\t]*$"
#: Words by which a line speaks of a licence, as the SQL has them; SPOKEN, which the scan uses, takes "cc0" as well.
SPEAKS = "licen[sc]e|public domain|spdx|creative commons|\\bcc[ -](?:by|0)"
SPOKEN = SPEAKS.replace("[ -](?:by|0)", "[ -]?(?:by|0)")

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known licences and notices (fixed values): id, text. Copyright lines are left out, as the canonical form drops them.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_2 + _BSD_3 + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(out, COPYRIGHT_LINE, ""), r"[^\p{L}\p{M}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple = KNOWN, digests: tuple = DIGESTS) -> DataFrame:
    """(known_digest, license_id): one row per digest, of known texts and of those that only their digests are kept of."""
    df = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", digest(F.col("text")).alias("known_digest"))
    df = df.unionByName(spark.createDataFrame([(i, d) for i, _, d in digests], "license_id string, known_digest string"))
    return df.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: tuple = KNOWN) -> DataFrame:
    """One row per row of docs: doc_id, digest, license_id (of the whole text, or null), n_lines, line_licenses.

    n_lines counts the lines that are a known notice, line_licenses their distinct ids, sorted and comma-joined.
    """
    t = whole(text)
    table = known_digests(docs.sparkSession, known)
    # The known digests are a fixed list, a few dozen rows: texts are joined to it, lines look it up where they stand.
    listed = table.collect()
    ids = F.map_from_arrays(F.array(*(F.lit(r.known_digest) for r in listed)), F.array(*(F.lit(r.license_id) for r in listed)))
    spoken = F.when(F.lower(t).rlike(SPOKEN), F.filter(F.split(t, "\n", -1), lambda x: F.lower(x).rlike(SPOKEN))).otherwise(F.array().cast("array<string>"))
    df = docs.select(F.col(doc_id).alias("doc_id"), digest(t).alias("digest"), spoken.alias("lines"))
    found = F.array_compact(F.transform("lines", lambda x: F.element_at(ids, digest(x))))
    df = df.withColumn("found", F.when(F.size("lines") > 0, found).otherwise(F.col("lines")))
    df = df.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left")
    n_lines, names = F.size("found").cast("long"), F.array_join(F.array_sort(F.array_distinct("found")), ",")
    return df.select("doc_id", "digest", "license_id", n_lines.alias("n_lines"), names.alias("line_licenses"))
