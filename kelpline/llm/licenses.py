"""License scans by canonical digests, in DataFrame functions only.

A text's canonical form has lower case, no copyright lines, one spelling of
equivalent words and single spaces for everything but letters and digits; its
SHA-256 digest is looked up among the digests of known licence texts and
notices.  The whole text is looked up by a hash join, and so is each of its
lines (notices are usually one line of a longer text).

Null text counts as empty; empty canonical forms match nothing; long texts are
hashed whole. Repeated rows keep a row each, other columns are ignored, an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.store import table

#: Spellings that count as one: pattern, replacement, in this order.
EQUIVALENT = (("licence", "license"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("per cent", "percent"))
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
OTHER, OTHER_IN_LINE = r"[^\p{L}\p{N}]+", r"[^\p{L}\p{N}\n]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: Known licence texts and one-line notices. Published texts, fixed values.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_TWO + "\n" + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + "\n" + _BSD_THREE + "\n" + _BSD_END),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)


def canonical_text(text: str) -> str:
    """The canonical form, for the known texts (ASCII)."""
    text = re.sub(COPYRIGHT_LINE, "\n", text.lower())
    for a, b in EQUIVALENT:
        text = text.replace(a, b)
    return re.sub(r"[^a-z0-9]+", " ", text).strip()


def full_texts() -> list[tuple[str, int, str]]:
    """(licence id, length, digest) of canonical full texts that are too long to stand here: whole, without what follows
    their terms, and with either spelling of their addresses."""
    rows = (line.split("\t") for line in Path(__file__).with_name("license_digests.tsv").read_text().splitlines())
    return [(i, int(n), d) for i, n, d in rows]


def known_digests() -> list[tuple[str, str]]:
    """(digest, licence id), each digest once."""
    short = {hashlib.sha256(canonical_text(t).encode()).hexdigest(): i for i, t in KNOWN}
    return sorted(({d: i for i, _, d in full_texts()} | short).items(), key=lambda x: (x[1], x[0]))


def canonical_lines(text: Column) -> Column:
    """The canonical form, line breaks kept."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, OTHER_IN_LINE, " ")


def unbroken(lines: Column) -> Column:
    """Canonical lines as one canonical text."""
    return F.trim(F.regexp_replace(F.translate(lines, "\n", " "), " {2,}", " "))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the whole text, ``license_id`` of the whole text or null, the number of its lines
    that are known notices and their licences, comma-joined."""
    known = F.broadcast(df.sparkSession.createDataFrame(known_digests(), "digest string, license string"))  # a fixed table
    pairs = [F.lit(x) for row in known_digests() for x in row]
    lengths = F.lit(sorted({len(canonical_text(t)) for _, t in KNOWN} | {n for _, n, _ in full_texts()}))
    rows = df.select(F.col(id_col), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("form"))
    lines = F.filter(F.transform(F.split("form", "\n"), lambda x: F.trim(x)), lambda x: F.array_contains(lengths, F.length(x)))  # others can't match
    rows = rows.select(id_col, F.sha2(unbroken(F.col("form")), 256).alias("digest"), F.transform(lines, lambda x: F.sha2(x, 256)).alias("lines"))
    rows = rows.join(known, "digest", "left")
    found = F.array_compact(F.transform("lines", lambda d: F.try_element_at(F.create_map(*pairs), d)))
    rows = rows.withColumn("found", found)
    return rows.select(
        id_col,
        F.col("digest").alias("text_sha256"),
        F.col("license").alias("license_id"),
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.sort_array(F.array_distinct("found")), ",").alias("notice_ids"),
    )


def oracle(documents: str = "documents") -> str:
    """The same in SQL."""

    def form(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{COPYRIGHT_LINE}', chr(10), 'g')"
        for a, b in EQUIVALENT:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim(regexp_replace({out}, '{OTHER}', ' ', 'g'))"

    values = ", ".join(f"('{d}', '{i}')" for d, i in known_digests())
    return f"""
WITH known(digest, license) AS (VALUES {values}),
base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {documents}),
whole AS (SELECT r, doc_id, sha256({form('text')}) AS digest FROM base),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base),
notices AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids
            FROM lines JOIN known ON known.digest = sha256({form('line')}) GROUP BY r)
SELECT doc_id, whole.digest AS text_sha256, license AS license_id, coalesce(n, 0) AS n_notices, coalesce(ids, '') AS notice_ids
FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (r)"""


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    """One row per document; see :func:`scan`."""
    return scan(table(spark, sf_dir, "documents"))
