"""Licence texts and notices found by canonical digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksymbols.llm.common import small, text_or_empty

# Public licence texts by SPDX identifier, each without title and copyright line.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the'
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so"
)
_MIT_END = (
    f"\n\n{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT"
    " HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    f"\n\n{_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
    " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF"
    " CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS"
    " SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution."
)
_BSD_THIRD = (
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_END = (
    '\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF"
    " THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"
    " for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any"
    " purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following"
    " restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the"
    " original software. If you use this software in a product, an acknowledgment in the product documentation would be"
    " appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be"
    " misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source"
    " distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use,"
    " compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,"
    " commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors"
    " of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication"
    " for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to"
    " be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    + _MIT_END.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS").replace("CLAIM, DAMAGES OR OTHER", "CLAIM, DAMAGES OR OTHER")
    + "\n\nFor more information, please refer to <https://unlicense.org/>"
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
    ' accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and'
    " transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software"
    " is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement,"
    " including the above license grant, this restriction and the following disclaimer, must be included in all copies of the"
    " Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are"
    " solely in the form of machine-executable object code generated by a source language processor.\n\n"
    f"{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF"
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR"
    " ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,"
    " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the'
    " License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by"
    ' applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,'
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
    " governing permissions and limitations under the License."
)
_MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
    " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)


def _gnu_notice(name: str, version: str, or_later: bool, short: str) -> str:
    terms = f"either version {version} of the License, or (at your option) any later version" if or_later else f"version {version} of the License"
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by"
        f" the Free Software Foundation, {terms}.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT"
        " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        f" {name} for more details.\n\nYou should have received a copy of the {name} along with this program. If not, see"
        f" <https://www.gnu.org/licenses/>."
    ).replace("This program", short).replace("this program", short[0].lower() + short[1:])


_GNU = (
    ("GPL", "GNU General Public License", ("2", "3"), "This program"), ("LGPL", "GNU Lesser General Public License", ("2.1", "3"), "This library"),
    ("AGPL", "GNU Affero General Public License", ("3",), "This program"),
)
_GNU_NOTICES = tuple(
    (f"{key}-{version if '.' in version else version + '.0'}-{'or-later' if later else 'only'}", _gnu_notice(name, version, later, short))
    for key, name, versions, short in _GNU
    for version in versions
    for later in (True, False)
)
_WHOLE = (
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in"
            f" all copies or substantial portions of the Software.{_MIT_END}"),
    ("MIT-0", f"{_MIT_GRANT}.{_MIT_END}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.{_ISC_END}"),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
)
_NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", _APACHE_NOTICE), ("MPL-2.0", _MPL_NOTICE), *_GNU_NOTICES,
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)
_SPDX = (
    "MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause Zlib Unlicense BSL-1.0 Apache-2.0 MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only"
    " GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later EPL-2.0 CC0-1.0"
    " CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0"
).split()
KNOWN = (*_WHOLE, *_NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX))

# Spellings that count as the same, applied after case folding.
SPELLINGS = (
    ("licence", "license"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"),
)
#: A line of a copyright holder: it needs a sign, a year or a place for one; a line of a text that happens to begin with
#: the word has none of them.
COPYRIGHT_LINE = (
    r"(?m)^[ \t>*#/;-]*(?:copyright[^\n]*?(?:\(c\)|©|[^0-9][12][0-9]{3}(?:[^0-9]|$)|[<\[{](?:year|yyyy)[>\]}])"
    r"|\(c\)[ \t]+|©|all rights reserved[. \t]*$)[^\n]*$"
)
#: The usual heading of a licence, at the start of a text only.
TITLE_LINE = (
    r"\A[ \t\r\n>*#/;-]*(?:the )?(?:(?:mit|isc|zlib|boost software|(?:simplified |new |modified )?bsd|bsd (?:2|3|zero)[ -]clause|mit no attribution) license|unlicense)"
    r"(?: \((?:mit|isc|bsd-2-clause|bsd-3-clause|mit-0|0bsd)\))?(?:[ ,-]+version 1\.0)?[ \t.:=*-]*(?:\n|\z)"
)
NOT_WORDS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Case, punctuation, copyright and title lines and spellings normalised; line ends stay."""
    out = F.regexp_replace(F.lower(text_or_empty(text)), COPYRIGHT_LINE, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, TITLE_LINE, "\n")
    return F.regexp_replace(out, NOT_WORDS, " ")


def canonical_text(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, scope, license_id, n_matches``: documents that are, or hold as a line of their own, a known text.

    ``known`` has ``license_id, text``. ``scope`` is ``document`` if the whole canonical text has the digest of a known
    text, ``line`` if a line has; a document of one line gives both. Texts that are empty once normalised match nothing,
    known ones neither, and null is empty. A text known under two identifiers gives both. Documents without a match,
    and empty tables, give no rows; repeated ids are counted together. Digests are joined map-side while ``known``
    is small, else by shuffle.
    """
    spec = small(
        known.select("license_id", canonical_text(canonical_lines(F.col("text"))).alias("known_text"))
        .where("known_text <> '' AND license_id IS NOT NULL")
        .select("license_id", F.sha2("known_text", 256).alias("digest"))
        .distinct()
    )
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    whole = lines.select("doc_id", F.lit("document").alias("scope"), canonical_text(F.col("lines")).alias("piece"))
    pieces = lines.select("doc_id", F.lit("line").alias("scope"), F.explode(F.split("lines", "\n")).alias("piece"))
    found = (
        whole.unionByName(pieces)
        .select("doc_id", "scope", F.trim("piece").alias("piece"))
        .where("piece <> ''")
        .select("doc_id", "scope", F.sha2("piece", 256).alias("digest"))
    )
    return found.join(spec, "digest").groupBy("doc_id", "scope", "license_id").agg(F.count("*").alias("n_matches"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    out = f"regexp_replace({out}, '{TITLE_LINE}', chr(10))"
    return f"regexp_replace({out}, '{NOT_WORDS}', ' ', 'g')"


SQL = f"""
WITH known AS (SELECT DISTINCT license_id, trim(regexp_replace({_sql_lines("t")}, '[ \\n]+', ' ', 'g')) AS piece
               FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)}) AS k(license_id, t)),
lines AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents),
pieces AS (SELECT doc_id, 'document' AS scope, trim(regexp_replace(lines, '[ \\n]+', ' ', 'g')) AS piece FROM lines
           UNION ALL SELECT doc_id, 'line', trim(unnest(string_split(lines, chr(10)))) FROM lines)
SELECT doc_id, scope, license_id, count(*) AS n_matches FROM pieces JOIN known USING (piece)
WHERE piece <> '' GROUP BY ALL
"""
