"""License scans by canonical digest lookup.

A text is brought to one canonical form (case, punctuation, copyright lines, list marks, equivalent
spellings), digested, and joined by hash with the digests of known licences. The whole text is looked
up, and each of its lines too, as notices such as "Released under the MIT License." stand in a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, each brought to the second form.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"),
    ("merchantibility", "merchantability"), ("per cent", "percent"), ("favour", "favor"), ("favourable", "favorable"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("judgement", "judgment"),
    ("modelling", "modeling"), ("organisation", "organization"), ("organisations", "organizations"), ("recognise", "recognize"), ("authorise", "authorize"), ("authorised", "authorized"), ("whilst", "while"),
    ("wilful", "willful"), ("analogue", "analog"), ("analyse", "analyze"), ("centre", "center"), ("utilisation", "utilization"), ("optimisation", "optimization"), ("programme", "program"), ("http", "https"),
    ("v2", "version 2"), ("v3", "version 3"), ("v 2", "version 2"), ("v 3", "version 3"),
]

# Texts of well-known licences and the usual notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution."""
KNOWN = [
    ("MIT", MIT), ("MIT", "The MIT License (MIT)\n" + MIT), ("MIT", "MIT License\n" + MIT), ("ISC", ISC), ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", BSD_HEAD + "\n" + BSD_TAIL), ("BSD-3-Clause", BSD_HEAD + "\n" + BSD_THIRD + "\n" + BSD_TAIL), ("Zlib", ZLIB),
    ("Apache-2.0", APACHE_HEADER), ("GPL-2.0-or-later", GPL_HEADER.format(2)), ("GPL-3.0-or-later", GPL_HEADER.format(3)),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This work is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("ISC", "SPDX-License-Identifier: ISC"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
# Applied in this order to the lower-cased text, each match becoming a space.
STRIPPED = [
    r"(?m)^[^a-z\n]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by )|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$",
    r"(?m)^[ \t]*([0-9]{1,2}[.)]|[(][a-z0-9][)]|[-*])[ \t]+",
    r"[^a-z0-9]+",
]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines or list marks, words of a-z and 0-9 with one space between, one spelling each."""
    s = F.lower(text)
    for pattern in STRIPPED:
        s = F.regexp_replace(s, pattern, " ")
    s = F.concat(F.lit(" "), F.trim(s), F.lit(" "))
    for a, b in SPELLINGS:
        s = F.replace(s, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(s)


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license) of the known texts: one row per canonical form that isn't empty."""
    rows = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in (licenses or KNOWN)))
    flat = spark.range(1).select(F.inline(rows)).where(canonical(F.col("text")) != "")
    return flat.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def telling_words(spark: SparkSession, licenses: list[tuple[str, str]] | None = None) -> list[str]:
    """For each known text a word that any text of its canonical form holds as it is: its longest that is no equivalent spelling."""
    rows = F.array(*(F.lit(text) for _, text in (licenses or KNOWN)))
    texts = [r[0] for r in spark.range(1).select(F.explode(rows).alias("text")).select(canonical(F.col("text"))).collect()]  # the list given
    spelled = {w for _, to in SPELLINGS for w in to.split()}
    return sorted({max((w for w in t.split() if w not in spelled), key=lambda w: (len(w), w), default="") for t in texts if t})


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, whole_license, notices, n_notices.

    whole_license is the licence that the entire text is, null if none. notices are the distinct
    licences, sorted and comma-joined, whose known text an entire line or an entire paragraph
    (between blank lines) is; n_notices counts those lines and paragraphs. Null, empty and wordless
    texts match nothing. Repeated rows each give a row, null ids too; other columns are not read. The
    digest table has a row per known text, so it is broadcast. Texts and units that hold none of the
    known texts' telling words can match none and are not normalised; only matches are shuffled, keyed
    by id and the text's digest, which are the same whenever a lost task is run again.
    """
    spark = docs.sparkSession
    known = F.broadcast(known_digests(spark, licenses))
    told = telling_words(spark, licenses)
    told_in = lambda c: F.exists(F.array(*(F.lit(w) for w in told)), lambda w: F.contains(F.lower(c), w)) if len(told) > 32 else F.lower(c).rlike("|".join(told))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = rows.where(told_in(F.col("text"))).withColumn("key", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))
    parts = F.concat(F.split("text", "\n"), F.when(F.col("text").rlike("\n[ \t]*\n"), F.split("text", "\n[ \t]*\n")).otherwise(F.array()))
    whole = some.select("id", "key", F.lit(-1).alias("at"), digest(F.col("text")).alias("digest"))
    units = some.select("id", "key", F.posexplode(parts).alias("at", "unit")).where(told_in(F.col("unit"))).select("id", "key", "at", digest(F.col("unit")).alias("digest"))
    hits = whole.unionByName(units).join(known, "digest").select("id", "key", "at", "license").distinct()  # repeated rows give one hit each
    of = hits.groupBy("id", "key").agg(
        F.max(F.when(F.col("at") < 0, F.col("license"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.col("license")))), ",").alias("notices"),
        F.sum(F.when(F.col("at") < 0, 0).otherwise(1)).alias("n_notices"),
    )
    keyed = rows.select("id", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).alias("key")).alias("r")
    out = keyed.join(of.alias("o"), F.col("r.id").eqNullSafe(F.col("o.id")) & (F.col("r.key") == F.col("o.key")), "left")
    return out.select(F.col("r.id").alias(id_col), "whole_license", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
