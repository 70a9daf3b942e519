"""Licence lookup by canonical digests.

A text is brought to a canonical form (case, punctuation, copyright lines and
equivalent spellings folded), and the digest of the entire form is joined by
hash to the digests of known licences. Units are the whole document and each of
its lines, so a licence that is the document and a notice on one line are both
found, and nothing that merely resembles one is. Only DataFrame functions run.

The known digests of a table of measured size go to all tasks as one map, so a
document's canonical form is made once and its units are looked up where they
are; a larger table is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brickledger.llm.support import stored, whole_text

#: Known digests up to which they are sent along as a map.
MAP_ENTRIES = 5_000

# Spellings read as one, the second form of each pair is kept.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sub license", "sublicense"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("organisation", "organization"), ("organisations", "organizations"), ("favour", "favor"),
    ("honour", "honor"), ("analogue", "analog"), ("catalogue", "catalog"), ("centre", "center"),
    ("initialise", "initialize"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"), ("whilst", "while"), ("wilful", "willful"), ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"), ("labour", "labor"), ("offence", "offense"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("utilisation", "utilization"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
]

# Licence names as notices write them, with their identifiers.
NOTICE_NAMES = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License, version 2.0"), ("ISC", "ISC License"),
    ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
]
NOTICE_OPENINGS = ["Licensed under", "Released under", "Distributed under", "This work is licensed under"]

# Short licences and file notices in full.
FULL_TEXTS = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR
ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    # the notices that the longer licences ask to be put into files
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""),
]

_BSD_2 = dict(FULL_TEXTS)["BSD-2-Clause"]
FULL_TEXTS.append(("BSD-3-Clause", _BSD_2.replace("with the distribution.\n", """with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.
""")))

# Titles that stand above the full texts.
TITLES = [
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("ISC", "The ISC License"),
    ("0BSD", "Zero-Clause BSD"), ("0BSD", "BSD Zero Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "The 2-Clause BSD License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "The 3-Clause BSD License"),
    ("Zlib", "zlib License"), ("Zlib", "The zlib License"), ("Unlicense", "The Unlicense"), ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
]
FULL_TEXTS = [(i, f"{title}\n{dict(FULL_TEXTS)[i]}") for i, title in TITLES] + FULL_TEXTS

# Runs on lower-case text, line by line.
# A copyright statement names a year, a sign, "by", a field to fill in or "the ... authors"; a sentence that goes on with "copyright holders" is none.
COPYRIGHT_LINE = (r"(^|\n)[ \t*#/-]*(copyright[ \t:,]*(\(c\)|©|[0-9]|by[ \t]|[<\[{]|the[ \t][^\n]*authors)|\(c\)|©)[^\n]*")
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
_HOLDERS = " (?:" + "|".join(a for a, _ in sorted(SPELLINGS, key=lambda p: -len(p[0]))) + ") "


def _spelled(text: Column) -> Column:
    """Equivalent spellings folded; texts without any are passed on as they are."""
    folded = text
    for seen, kept in SPELLINGS:
        folded = F.regexp_replace(folded, f"(?<= ){seen}(?= )", kept)
    return F.when(text.rlike(_HOLDERS), folded).otherwise(text)


def canonical_lines(text: Column) -> Column:
    """Canonical text with its lines still apart: ``" line one \\n line two "``."""
    bare = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    words = F.regexp_replace(bare, PUNCTUATION, " ")
    return _spelled(F.concat(F.lit(" "), F.regexp_replace(words, r" *\n *", " \n "), F.lit(" ")))


def canonical_whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_table(spark: SparkSession) -> DataFrame:
    """Known licences as (license_id, unit, text): full texts, and one-line notices built by rule."""
    rows = [(i, "text", t) for i, t in FULL_TEXTS]
    rows += [(i, "line", f"{opening} {article}{name}.") for i, name in NOTICE_NAMES for opening in NOTICE_OPENINGS
             for article in ("", "the ")]
    return spark.createDataFrame(rows, "license_id string, unit string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """``digest`` and ``license_id`` of a table of known licences; one id, the first by name, per digest."""
    return (known.select("license_id", F.sha2(canonical_whole(canonical_lines(whole_text("text"))), 256).alias("digest"))
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def scan(df: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``canonical_sha256``, ``license_id`` of the entire text (null: not a licence),
    ``line_licenses`` (distinct ids of its notice lines, sorted, comma-joined, empty: none) and ``n_license_lines``.

    Null reads as empty; an empty canonical text is never a licence. Repeated
    rows come back as often as they went in, each with its own count; an empty
    table gives an empty result. Other columns are not read.
    """
    licences = stored(known_digests(known).where(F.col("digest") != F.sha2(F.lit(""), 256)), "licences")
    texts = df.select(F.col(id_col).alias("doc_id"), canonical_lines(whole_text(text_col)).alias("lines"))
    digest = lambda unit: F.sha2(F.trim(unit), 256)
    if licences.count() > MAP_ENTRIES:
        return _joined(texts, licences, digest, id_col)
    entries = F.collect_list(F.struct("digest", "license_id"))
    table = licences.agg(F.map_from_entries(entries).alias("known"))  # one row of bounded size
    whole = texts.crossJoin(F.broadcast(table)).select(
        "doc_id", "known", F.sha2(canonical_whole(F.col("lines")), 256).alias("canonical_sha256"), F.split("lines", "\n").alias("units"))
    found = whole.withColumn("found", F.filter(F.transform("units", lambda u: F.try_element_at(F.col("known"), digest(u))), lambda x: x.isNotNull()))
    return found.select(
        F.col("doc_id").alias(id_col), "canonical_sha256", F.try_element_at(F.col("known"), F.col("canonical_sha256")).alias("license_id"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("line_licenses"), F.size("found").cast("bigint").alias("n_license_lines"))


def _joined(texts: DataFrame, licences: DataFrame, digest, id_col: str) -> DataFrame:
    """The same by joins, for any number of known licences. Rows of one id and equal lines share what is found in them."""
    keys = ["doc_id", "lines_sha256"]
    whole = texts.select("doc_id", F.sha2("lines", 256).alias("lines_sha256"), "lines", F.sha2(canonical_whole(F.col("lines")), 256).alias("canonical_sha256"))
    units = whole.dropDuplicates(keys).select(*keys, F.explode(F.split("lines", "\n")).alias("line"))
    hits = (units.select(*keys, digest(F.col("line")).alias("digest")).join(licences, "digest").groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"), F.count(F.lit(1)).alias("n_license_lines")))
    named = whole.select(*keys, "canonical_sha256").join(licences.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left")
    match = [named["doc_id"].eqNullSafe(hits["doc_id"]), named["lines_sha256"] == hits["lines_sha256"]]
    return named.join(hits, match, "left").select(
        named["doc_id"].alias(id_col), "canonical_sha256", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        F.coalesce("n_license_lines", F.lit(0).cast("bigint")).alias("n_license_lines"))
