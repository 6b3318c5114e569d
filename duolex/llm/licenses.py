"""Licence scan by canonical digest lookup.

A text is brought to a canonical form: ASCII letters lower-case; copyright lines and "all rights reserved" dropped; equivalent
spellings made one; everything but ASCII letters, digits and non-ASCII characters a single space. The SHA-256 of the form of
an entire text is joined to the digests of known licences. The same lookup on single lines finds licence notices in longer
texts. All of it is built-in expressions, with the same statement in SQL as a check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Spellings that count as the same, applied in this order to lower-cased text.
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("organisation", "organization"),
    ("authorise", "authorize"),
    ("recognise", "recognize"),
    ("merchantibility", "merchantability"),
    ("non-infringement", "noninfringement"),
    ("sub-license", "sublicense"),
    ("fulfil ", "fulfill "),
    ("percent", "per cent"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("&", " and "),
    ("(c)", " copyright "),
)
#: A line that holds no more than a copyright statement.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^a-z0-9\n]*(\(c\)|©|[0-9]{4}|<year>|\[year\]|\[yyyy\]|by )[^\n]*$"
RESERVED = r"all rights reserved"
NOT_KEPT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F“”‘’«»–—•©®™…]+"
#: What each canonical notice contains; lines without any of it aren't digested.
NOTICE_HINT = r"(?i)licen[cs]e|creative commons|public domain|(^|[^a-z])cc0|spdx"

# Licences whose entire text is known, without copyright line.
TEXTS = {
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause": "BSD 2-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "BSD 3-Clause License\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",
}
# Notices that name a licence in a line of their own.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "public-domain": ("This work is in the public domain.",),
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def known() -> list[tuple[str, str]]:
    """(licence, text) of everything that is looked up; its size is that of the tables above."""
    return [*TEXTS.items(), *((k, v) for k, vs in NOTICES.items() for v in vs)]


def canonical(text: Column) -> Column:
    """The canonical form; null is empty."""
    c = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    c = F.regexp_replace(F.regexp_replace(c, COPYRIGHT_LINE, ""), RESERVED, "")
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(c, NOT_KEPT, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan(docs: DataFrame, licences: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs (doc_id, text) to (doc_id, digest, license_id, n_notice_lines, notice_ids), a row for each row.

    license_id: the licence whose canonical digest the entire text has, else null. n_notice_lines: lines whose digest is that
    of a known text; notice_ids: their licences, sorted, joined by commas, empty if none. Null, empty and blank texts have
    the digest of the empty form and no licence. Digests of known texts are joined as a table with the size of the list
    given (a few dozen rows), the only thing that is broadcast. Rows that repeat give rows that repeat.
    """
    spark = docs.sparkSession
    table_ = spark.createDataFrame(licences or known(), "license_id string, t string").select("license_id", digest(F.col("t")).alias("digest"))
    table_ = table_.filter(F.col("digest") != F.sha2(F.lit(b""), 256)).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    pairs = table_.select("digest", "license_id").collect()  # a few dozen rows: those of the list given
    by_digest = F.create_map(*[F.lit(x) for r in pairs for x in r]) if pairs else F.create_map().cast("map<string,string>")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(NOTICE_HINT))
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), F.filter(F.transform(lines, lambda x: by_digest[digest(x)]), lambda x: x.isNotNull()).alias("ids"))
    with_notices = rows.join(F.broadcast(table_), "digest", "left")
    return with_notices.select("doc_id", "digest", "license_id", F.size("ids").cast("bigint").alias("n_notice_lines"), F.array_join(F.array_sort(F.array_distinct("ids")), ",").alias("notice_ids"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_form(x: str) -> str:
    c = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
    c = f"regexp_replace(regexp_replace({c}, {_quoted(COPYRIGHT_LINE)}, '', 'g'), '{RESERVED}', '', 'g')"
    for a, b in SPELLINGS:
        c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
    return f"sha256(trim(regexp_replace({c}, {_quoted(NOT_KEPT)}, ' ', 'g')))"


ORACLE = f"""
WITH raw(license_id, t) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in known())}),
lic AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_form("t")} AS digest FROM raw) GROUP BY digest HAVING digest <> sha256('')),
by_digest AS (SELECT map_from_entries(list((digest, license_id))) AS m FROM lic),
d AS (SELECT doc_id, {_sql_form("text")} AS digest, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_quoted(NOTICE_HINT)})) AS lines FROM documents),
n AS (SELECT doc_id, d.digest, lic.license_id, list_filter(list_transform(lines, lambda x: m[{_sql_form("x")}]), lambda x: x IS NOT NULL) AS ids
      FROM d LEFT JOIN lic ON lic.digest = d.digest, by_digest)
SELECT doc_id, digest, license_id, len(ids)::BIGINT AS n_notice_lines, array_to_string(list_sort(list_distinct(ids)), ',') AS notice_ids FROM n
"""

QUERIES = {"op1_licenses": op1_licenses}
ORACLES = {"op1_licenses": ORACLE}
