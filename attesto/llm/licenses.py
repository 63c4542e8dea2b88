"""License scans by canonical digests.

A text is brought to a canonical form: copyright statements gone, lower case, equivalent
spellings unified, everything but letters and digits one space. The digest of the whole
form is joined to the digests of known licences, which come from the same expressions.
Each line and each paragraph is a text of its own and is looked up in the same table, so
that short notices within a document are found too. As equal digests need equal lengths,
only pieces that are as long as a known text are hashed; the lengths are part of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import small, written

#: Rows of the table of known texts that are broadcast at most, and lines found in documents.
BROADCAST_ROWS = 200_000
_GRANT_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_KEEP_MIT = ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS_MIT = (
    '\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_KEEP_ISC = ", provided that the above copyright notice and this permission notice appear in all copies."
_AS_IS_ISC = (
    '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_GRANT_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE_BSD = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY_BSD = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES_BSD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS_BSD = (
    '\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, "
    "and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
    "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
    "rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <https://unlicense.org/>"
)
_BOOST = (
    "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
    "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
    "subject to the following:\n\n"
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, "
    "in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language "
    "processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND '
    "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
    "http://www.apache.org/licenses/LICENSE-2.0\n\n"
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
    "or implied. See the License for the specific language governing permissions and limitations under the License."
)
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_CC0_HEADER = (
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed "
    "without any warranty."
)


def _gnu(work: str, license: str, versions: str) -> str:
    return (
        f"This program is free software{work} it under the terms of the {license} as published by the Free Software Foundation, {versions}\n\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the {license} for more details.\n\n"
        f"You should have received a copy of the {license} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


def _bsd(*conditions: str) -> str:
    return "\n\n".join((_GRANT_BSD, *conditions)) + _AS_IS_BSD


_OR_LATER = ": you can redistribute it and/or modify"
#: Texts of public licences and their customary notices, as (name, text).
KNOWN = (
    ("MIT", "MIT License\n\n" + _GRANT_MIT + _KEEP_MIT + _AS_IS_MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _GRANT_MIT + _KEEP_MIT + _AS_IS_MIT),
    ("MIT", _GRANT_MIT + _KEEP_MIT + _AS_IS_MIT),
    ("MIT-0", "MIT No Attribution\n\n" + _GRANT_MIT + "." + _AS_IS_MIT),
    ("MIT-0", _GRANT_MIT + "." + _AS_IS_MIT),
    ("ISC", _GRANT_ISC + _KEEP_ISC + _AS_IS_ISC),
    ("ISC", "ISC License\n\n" + _GRANT_ISC + _KEEP_ISC + _AS_IS_ISC),
    ("0BSD", _GRANT_ISC + "." + _AS_IS_ISC),
    ("0BSD", "BSD Zero Clause License\n\n" + _GRANT_ISC + "." + _AS_IS_ISC),
    ("BSD-2-Clause", _bsd("1. " + _SOURCE_BSD, "2. " + _BINARY_BSD)),
    ("BSD-2-Clause", _bsd("* " + _SOURCE_BSD, "* " + _BINARY_BSD)),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _bsd("1. " + _SOURCE_BSD, "2. " + _BINARY_BSD)),
    ("BSD-3-Clause", _bsd("1. " + _SOURCE_BSD, "2. " + _BINARY_BSD, "3. " + _NAMES_BSD)),
    ("BSD-3-Clause", _bsd("* " + _SOURCE_BSD, "* " + _BINARY_BSD, "* " + _NAMES_BSD)),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _bsd("1. " + _SOURCE_BSD, "2. " + _BINARY_BSD, "3. " + _NAMES_BSD)),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE_HEADER),
    ("MPL-2.0", _MPL_HEADER),
    ("CC0-1.0", _CC0_HEADER),
    ("GPL-2.0-or-later", _gnu("; you can redistribute it and/or modify", "GNU General Public License", "either version 2 of the License, or (at your option) any later version.")),
    ("GPL-2.0-or-later", _gnu(_OR_LATER, "GNU General Public License", "either version 2 of the License, or (at your option) any later version.")),
    ("GPL-3.0-or-later", _gnu(_OR_LATER, "GNU General Public License", "either version 3 of the License, or (at your option) any later version.")),
    ("GPL-3.0-only", _gnu(_OR_LATER, "GNU General Public License", "version 3 of the License.")),
    ("LGPL-3.0-or-later", _gnu(_OR_LATER, "GNU Lesser General Public License", "either version 3 of the License, or (at your option) any later version.")),
    ("AGPL-3.0-or-later", _gnu(_OR_LATER, "GNU Affero General Public License", "either version 3 of the License, or (at your option) any later version.")),
    *((name, f"{how} under {what}.") for how in ("Licensed", "Released", "Distributed", "This work is licensed", "This project is licensed", "This software is licensed") for name, what in (
        ("MIT", "the MIT License"), ("Apache-2.0", "the Apache License, Version 2.0"), ("GPL-2.0", "the GNU General Public License, version 2"),
        ("GPL-3.0", "the GNU General Public License, version 3"), ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
        ("BSD-2-Clause", "the BSD 2-Clause License"), ("BSD-3-Clause", "the BSD 3-Clause License"), ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("ISC", "the ISC License"),
        ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"), ("CC0-1.0", "CC0 1.0"),
    )),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "MPL-2.0", "ISC")),
)
#: Spellings that count as equal, as (pattern, form).
SPELLINGS = (
    (r"licenc", "licens"),
    (r"\bnon[ -]?infringement\b", "noninfringement"),
    (r"\bnon[ -]commercial\b", "noncommercial"),
    (r"\bsub[ -]licens", "sublicens"),
    (r"\borganisation", "organization"),
    (r"\bauthoris", "authoriz"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bhttps\b", "http"),
)
#: A copyright statement at the start of a line: the word or the sign with a year, a sign or a place for them, or with a
#: name in capitalised words to the line's end. It ends with the line, or before a licence notice that follows in it.
COPYRIGHT = (
    r"(?md)^[^\p{L}\n©]*(?:(?:(?i:copyright)[ \t]*(?:(?i:\(c\))|©|[12][0-9]{3}|\[|<)|(?i:\(c\))[ \t]*(?:(?i:copyright)|[12][0-9]{3})|©)[^\n]*?(?:\.[ \t]+((?i:licen[sc]ed|released|distributed|this [a-z]+ is licen)[^\n]*))?"
    r"|(?i:copyright)[ \t]+(?:(?i:by)[ \t]+)?\p{Lu}[\p{Ll}.]+(?:[ \t,&.]+\p{Lu}[\p{Ll}.]+)*[ \t\r]*|(?i:all rights reserved)[. \t\r]*)$"
)
PARAGRAPH = r"\n[ \t\r]*\n"
NOT_WORD = r"[^\p{L}\p{N}]+"


def unified(text):
    """The text without copyright statements, in lower case and one spelling; its lines are left."""
    text = F.lower(F.regexp_replace(text, COPYRIGHT, " $1"))
    for pattern, form in SPELLINGS:
        text = F.regexp_replace(text, pattern, form)
    return text


def bare(text):
    return F.trim(F.regexp_replace(text, NOT_WORD, " "))


def canonical(text):
    return bare(unified(text))


def known(spark: SparkSession, rows=KNOWN) -> DataFrame:
    """license, digest, length of the canonical text: one row a digest."""
    table = rows if isinstance(rows, DataFrame) else spark.createDataFrame(list(rows), "license string, text string")
    table = table.select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
    return table.select("license", F.sha2("c", 256).alias("digest"), F.length("c").alias("length")).groupBy("digest").agg(F.min("license").alias("license"), F.first("length").alias("length"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", table=KNOWN) -> DataFrame:
    """doc_id, digest, license, n_copyright_lines, notices for every row of docs.

    license is the known licence whose canonical text the whole text is, else null;
    notices are the licences whose text a line or a paragraph is, distinct, sorted and
    comma-joined. A licence of several paragraphs within a longer text is neither. table
    is a sequence or DataFrame of (license, text), by default KNOWN.
    Null and empty texts have the digest of the empty text and no licence. Rows that repeat
    have equal results; null ids are ids like others. Texts are canonicalised whole. Other
    columns are ignored.
    """
    licences = written(known(docs.sparkSession, table))
    lengths = [r.length for r in licences.select("length").distinct().limit(BROADCAST_ROWS).collect()] if licences.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else None
    text = F.coalesce(F.col("text"), F.lit(""))
    as_long = (lambda x: F.length(x).isin(lengths)) if lengths is not None else (lambda x: F.length(x) > 0)

    def pieces(t):
        every = F.concat(F.split(t, "\n"), F.filter(F.split(t, PARAGRAPH), lambda p: F.contains(p, F.lit("\n"))))
        return F.array_distinct(F.transform(F.filter(F.transform(every, bare), as_long), lambda x: F.sha2(x, 256)))

    # A lambda's variable is evaluated once; a column would be taken from the text again for each use.
    parts = F.transform(F.array(unified(text)), lambda t: F.struct(F.sha2(bare(t), 256).alias("digest"), pieces(t).alias("pieces")))
    rows = written(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        F.regexp_count(text, F.lit(COPYRIGHT)).cast("long").alias("n_copyright_lines"), F.inline(parts),
    ))
    held = small(licences.select("digest", "license"), BROADCAST_ROWS)
    found = rows.select("row", F.explode("pieces").alias("digest")).join(held, "digest")
    notices = written(found.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices")))
    whole = rows.drop("pieces").join(held, "digest", "left").join(small(notices, BROADCAST_ROWS), "row", "left")
    return whole.select("doc_id", "digest", "license", "n_copyright_lines", F.coalesce("notices", F.lit("")).alias("notices"))
