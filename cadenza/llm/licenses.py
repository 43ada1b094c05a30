"""Licence scanning by canonical digests, with DataFrame functions.

A text is brought to a canonical form line by line: lower case; everything but letters and digits becomes one space;
lines that begin with a copyright mark and headings that only name the licence are dropped; equivalent spellings are
unified word by word.  The SHA-256 digest of the whole canonical text is hash-joined to the digests of known licences,
and so is that of each line, which finds one-line notices within longer texts.  Texts and lines whose number of words no
known text has are not digested: spelling does not change that number, so none is lost.

Known texts are ``NOTICES`` and those of a table that the caller gives (:func:`license_texts` reads a folder of them, such
as the one of common licences that many systems have).  They are counted before they are broadcast.

Defined cases: null and empty texts match nothing; a text of copyright lines alone matches nothing; several equal lines
count each; repeated rows give one result for each row of a doc_id with the counts of all of them; null doc_id rows are
returned without matches; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import broadcast_if_small

# Equivalent spellings, each replaced by the second form as a whole word.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Texts of known licences and one-line notices of them.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use of
this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
]


#: Lines that say whose the text is or what it is called, not what it permits.
DROPPED = r"^(copyright|c \d|all rights reserved$|(mit|isc|zlib|bsd 2 clause|bsd 3 clause|bsd zero clause) license$)"


def _plain_lines(text: Column) -> Column:
    """Lines in lower case, words set apart by single spaces; spelling is not unified yet."""
    plain = F.transform(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " "), "\n", -1), lambda x: F.trim(x))
    return F.filter(plain, lambda x: (x != "") & ~x.rlike(DROPPED))


def _spelled(line: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in SPELLINGS for x in pair))
    return F.array_join(F.transform(F.split(line, " ", -1), lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def license_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(license_id, body) of the files of a folder on the driver, the file's name being the licence's."""
    rows = [(p.stem if p.suffix == ".txt" else p.name, p.read_text("utf-8", "replace")) for p in sorted(Path(folder).iterdir()) if p.is_file() and not p.is_symlink()]
    return spark.createDataFrame(rows, "license_id string, body string")


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id, n_words): one row for each known text; of equal texts the first licence by name."""
    rows = spark.createDataFrame(NOTICES, "license_id string, body string")
    rows = rows if known is None else rows.unionByName(known.select("license_id", "body"))
    canon = F.array_join(F.transform(_plain_lines(F.col("body")), _spelled), " ")
    return rows.select("license_id", canon.alias("canon")).where("canon <> ''").groupBy("canon").agg(F.min("license_id").alias("license_id")).select(F.sha2("canon", 256).alias("digest"), "license_id", _n_words(F.col("canon")).alias("n_words"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """``id_col``, text_license (of the whole text, or null), n_notices (lines that match) and licenses of every row."""
    digests = known_digests(docs.sparkSession, known).persist()
    # One number for each length of a known text, as many as there are texts at most.
    lengths = sorted(r[0] for r in digests.select("n_words").distinct().collect())
    fits = lambda n: n.isin(lengths)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = narrow.where("id IS NOT NULL").select("id", _plain_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    # No 0: the whole text; then each line.
    total = F.aggregate(F.col("lines"), F.lit(0), lambda n, x: n + _n_words(x))
    whole = F.when(fits(total), F.array(F.struct(F.lit(0).alias("no"), F.sha2(F.array_join(F.transform("lines", _spelled), " "), 256).alias("digest")))).otherwise(F.array().cast("array<struct<no:int,digest:string>>"))
    single = F.transform(F.filter("lines", lambda x: fits(_n_words(x))), lambda x: F.struct(F.lit(1).alias("no"), F.sha2(_spelled(x), 256).alias("digest")))
    hits = lines.select("id", F.explode(F.concat(whole, single)).alias("part")).select("id", "part.no", "part.digest").join(broadcast_if_small(digests), "digest")
    found = hits.groupBy("id").agg(
        F.min(F.when(F.col("no") == 0, F.col("license_id"))).alias("text_license"),
        F.count(F.when(F.col("no") > 0, 1)).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"),
    )
    joined = narrow.select("id").join(found.withColumnRenamed("id", "fid"), F.col("id") == F.col("fid"), "left")
    return joined.select(F.col("id").alias(id_col), "text_license", F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def oracle() -> str:
    """DuckDB SQL of ``op9``: every line is brought to its canonical form and joined as text."""

    def canonical(text: str) -> str:
        x = "trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
        lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {x}), lambda x: x <> '' AND NOT regexp_matches(x, '{DROPPED}'))"
        return f"list_transform({lines}, lambda x: array_to_string(list_transform(string_split(x, ' '), lambda w: coalesce(spellings[w], w)), ' '))"

    values = ", ".join("('{}', '{}')".format(k, body.replace("'", "''")) for k, body in NOTICES)
    spellings = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS) + "}"
    return f"""
WITH words AS (SELECT {spellings} AS spellings),
known AS (
  SELECT array_to_string({canonical("body")}, ' ') AS canon, min(license_id) AS license_id FROM (VALUES {values}) v(license_id, body), words GROUP BY 1
), lined AS (
  SELECT doc_id, {canonical("text")} AS lines FROM documents, words
), parts AS (
  SELECT doc_id, 0 AS no, array_to_string(lines, ' ') AS canon FROM lined WHERE len(lines) > 0
  UNION ALL SELECT doc_id, 1 AS no, unnest(lines) AS canon FROM lined
), hits AS (SELECT p.doc_id, p.no, k.license_id FROM parts p JOIN known k ON p.canon = k.canon),
found AS (
  SELECT doc_id, min(CASE WHEN no = 0 THEN license_id END) AS text_license, count(*) FILTER (WHERE no > 0) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses FROM hits GROUP BY doc_id
)
SELECT d.doc_id, f.text_license, CAST(coalesce(f.n_notices, 0) AS BIGINT) AS n_notices, coalesce(f.licenses, '') AS licenses FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
