"""License scan by canonical digest lookup.

A text is made canonical (case, copyright lines, equivalent spellings,
punctuation and white space) and the digest of the entire canonical text is
hash-joined to the digests of known license texts and notices. Entire texts are
looked up at two scopes: the document, and each line of it by itself, where
notices usually stand. Nothing shorter than a line is searched, nor runs of lines.

The known texts are ``KNOWN``, ``FULL`` (digests of long licenses), or a table
(license, text) of any size given to ``scan_licenses``.

Every known text holds one of ``WORDS`` in its canonical form, and so do all raw
texts that come to it: making canonical removes no letters but those of whole
lines, and no spelling adds one of these words. Units without any are therefore
passed over before they are made canonical. A table of known texts of which some
hold none of the words is looked up without that step.

Defined results
---------------
* null or empty text, or nothing left when canonical: no match.
* a line that repeats within a document: one row, with its number of lines.
* a document of one line that is a notice: one row for each scope.
* repeated rows of the table: matched together, as one id.
* very long texts: looked up whole, and line by line.   ids of any type.
* ties: of several known texts with one canonical form, the first listed names
  the license; of a given table, the least name. Its rows without a name, a text
  or anything left when canonical are left out.
* extra columns, whatever their names: ignored.  empty table: empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_upto, cut, named

#: Applied in order to lower-case text; plain strings.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("copyright owner", "copyright holder"),
    ("http://", "https://"),
    ("&", "and"),
    ("v2.0", "version 2.0"),
    ("v3", "version 3"),
    ("version 3.0", "version 3"),
]
_COPYRIGHT = r"(?m)^[^\S\n]*(?:copyright\b|\(c\)|©)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_LINK = "\nFor more information, please refer to <https://unlicense.org>"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_NAMES = {
    "MIT": ["the MIT License", "MIT License", "MIT"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL-3.0-only": ["the GNU General Public License, version 3", "the GNU General Public License version 3", "the GNU GPL, version 3", "GPLv3", "GPL-3.0"],
    "GPL-2.0-only": ["the GNU General Public License, version 2", "the GNU General Public License version 2", "GPLv2", "GPL-2.0"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0-only": ["the GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-clause BSD license", "BSD-3-Clause"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-clause BSD license", "BSD-2-Clause"],
    "ISC": ["the ISC License", "ISC"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"],
    "Unlicense": ["the Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0", "CC0-1.0"],
    **{
        f"CC-{k}-{v}": [f"CC {k} {v}", f"CC-{k}-{v}", f"a Creative Commons {long} {v} International License", f"the Creative Commons {long} {v} International License"]
        for v in ("4.0",)
        for k, long in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
_FRAMES = [
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "This work is licensed under {}.",
    "This project is licensed under {}.",
    "This software is licensed under {}.",
    "This software is released under {}.",
    "SPDX-License-Identifier: {}",
    "License: {}",
]

#: (license, full text or notice) in order of precedence.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    *((spdx, head + _BSD_HEAD + _BSD_1 + _BSD_2 + more + _BSD_TAIL) for spdx, more in (("BSD-2-Clause", ""), ("BSD-3-Clause", _BSD_3)) for head in ("", spdx.replace("-", " ", 1) + " License\n")),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_LINK),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0-or-later", _GPL),
    *((spdx, frame.format(name)) for spdx, names in _NAMES.items() for name in names for frame in _FRAMES),
]


#: Canonical digests of the full texts of long licenses, as published.
FULL: dict[str, str] = {
    "Apache-2.0": "27b676e8fc00faa43cb77ccb2920ab53",
    "GPL-3.0-only": "057f186a69ca5796ed5fd60ffc00e686",
    "GPL-2.0-only": "e374d0b43c25aed1a2b28951fe92a546",
    "LGPL-3.0-only": "b31b7335bc37919e8cdd79154e04d88d",
    "LGPL-2.1-only": "30f3ca192b711cce8cabbac60dd96b5b",
    "MPL-2.0": "c55ed6d02eb7d0551f9abd65bbf079a5",
    "CC0-1.0": "93a180096f6cfcf2c0dd24f75c2eec48",
    "GFDL-1.3-only": "9715992e76e496f0c0d0a6fcfb268fed",
}

#: One of these is in every known text.
WORDS = ("licen", "permission", "software", "released", "distributed")
#: Known texts of a given table up to this number are broadcast.
BROADCAST_KNOWN = 200_000


def canonical_text(text: str) -> str:
    """Canonical form, in Python."""
    t = text.lower()
    t = re.sub(r"(?m)^[^\S\n]*(?:copyright\b|\(c\)|©)[^\n]*$", "", t)
    for old, new in SPELLINGS:
        t = t.replace(old, new)
    return re.sub(r"[\W_]+", " ", t).strip(" ")


def canonical(text: Column) -> Column:
    """Canonical form, in the JVM."""
    t = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, _OTHER, " "))


def known_digests() -> dict[str, str]:
    """digest of canonical text -> license."""
    out: dict[str, str] = {}
    for spdx, text in KNOWN:
        out.setdefault(hashlib.md5(canonical_text(text).encode()).hexdigest(), spdx)
    for spdx, digest in FULL.items():
        out.setdefault(digest, spdx)
    return out


def _holds_word(text: Column) -> Column:
    low = F.lower(text)
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in WORDS])


def _known(docs: DataFrame, known: DataFrame | None) -> tuple[DataFrame, bool]:
    """(_gf_digest, license) and whether all of them hold one of ``WORDS``."""
    spark = docs.sparkSession
    if known is None:
        # Constants of this module, a few hundred rows whatever the corpus.
        table = F.broadcast(spark.createDataFrame(list(known_digests().items()), "_gf_digest string, license string"))
        return table, all(any(w in canonical_text(t) for w in WORDS) for _, t in KNOWN)
    text = canonical(named(known, "text"))
    rows = known.select(named(known, "license").cast("string").alias("license"), text.alias("_gf_text")).filter("license IS NOT NULL AND _gf_text <> ''")
    table = cut(
        rows.groupBy(F.md5(F.col("_gf_text").cast("binary")).alias("_gf_digest")).agg(F.min("license").alias("license"), F.bool_and(_holds_word(F.col("_gf_text"))).alias("_gf_holds"))
    )
    return broadcast_upto(table.drop("_gf_holds"), BROADCAST_KNOWN), not table.filter("NOT _gf_holds").limit(1).count()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(id_col, license, scope, n): known license texts, scope 'document' or 'line'.

    known: a table with columns license and text, in place of the built-in texts.
    """
    table, held = _known(docs, known)
    texts = docs.select(named(docs, id_col).alias("_gf_id"), named(docs, text_col).alias("_gf_text")).filter("_gf_text IS NOT NULL")
    lines = F.split("_gf_text", "[\r\n]+")
    if held:
        texts, lines = texts.filter(_holds_word(F.col("_gf_text"))), F.filter(lines, _holds_word)
    units = texts.select(
        "_gf_id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("document").alias("scope"), F.col("_gf_text").alias("unit"))),
                F.transform(lines, lambda x: F.struct(F.lit("line").alias("scope"), x.alias("unit"))),
            )
        ).alias("_gf_unit"),
    )
    digest = F.md5(canonical(F.col("_gf_unit.unit")).cast("binary"))
    return (
        units.select("_gf_id", F.col("_gf_unit.scope").alias("scope"), digest.alias("_gf_digest"))
        .join(table, "_gf_digest")
        .groupBy("_gf_id", "license", "scope")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_gf_id").alias(id_col), "license", "scope", "n")
    )


def _canonical_sql(column: str) -> str:
    t = f"regexp_replace(lower({column}), '{_COPYRIGHT}', '', 'g')"
    for old, new in SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    return f"trim(regexp_replace({t}, '{_OTHER}', ' ', 'g'), ' ')"


ORACLE_SQL = f"""
WITH known(digest, license) AS (VALUES {", ".join(f"('{d}', '{s}')" for d, s in known_digests().items())}),
units AS (
  SELECT doc_id, 'document' AS scope, text AS unit FROM documents
  UNION ALL
  SELECT doc_id, 'line' AS scope, unnest(string_split_regex(text, '[\\r\\n]+')) AS unit FROM documents
)
SELECT doc_id, license, scope, count(*) AS n
FROM (SELECT doc_id, scope, md5({_canonical_sql("unit")}) AS digest FROM units) JOIN known USING (digest)
GROUP BY doc_id, license, scope
"""
