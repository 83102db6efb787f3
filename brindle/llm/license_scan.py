"""Licence scans: canonical digests of whole texts, joined to the digests of known licences. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words after "copyright" that make it part of a sentence, not of a notice; and those that begin an item "(c)" of a list.
BODY_WORDS = "notice notices holder holders owner owners ownership law laws interest interests license licenses licence licences statement statements permission permissions treaty treaties disclaimer disclaimers protection right rights claim claims material materials status act grant information and or in on of to for is are was as if that which under".split()
ITEM_WORDS = "you under if in for to any a an such where when must neither nor prohibiting".split()


def _other(words: list[str]) -> str:
    """Matches the beginning of a word that is none of words, with a character after it or at the line's end. A trie, as RE2 has no lookahead."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    rest = "".join(sorted(heads))
    out = [f"{c}{_other(x)}" for c, x in sorted(heads.items())]
    if "" not in words:
        out += [rf"[^{rest}\n]", r"\b"]
    elif others := "".join(c for c in LOWER if c not in heads):
        out.append(f"[{others}]")
    return f"(?:{'|'.join(out)})"


_NOTICE = rf"copyright(?:[^a-z \t\n,.;)/'\"-]|[ \t]+(?:[^a-z \t\n]|{_other(BODY_WORDS + [''])}))[^\n]*|\(c\)(?:[^a-z \t\n]|[ \t]+(?:[^a-z \t\n]|{_other(ITEM_WORDS + [''])}))[^\n]*|©[^\n]*"
#: Applied in order to the lower-cased text, in the dialect that Java and RE2 share. A copyright line goes, as do marks of lists and comments.
STEPS = (
    (rf"(^|\n)[ \t#*/;]*(?:{_NOTICE})", "\n"),
    (r"(^|\n)[ \t#*/;]*all rights reserved[^\n]*", "\n"),
    (r"(^|\n)[ \t]*(\(?[0-9a-z][.)]|[*#/;-]+)[ \t]+", "\n"),
    (r"https?://", ""),
    (r"[^a-z0-9]+", " "),
)
#: Equivalent spellings, as whole words of the text that STEPS leaves.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "organisation": "organization", "organisations": "organizations", "authorised": "authorized", "recognised": "recognized", "favour": "favor", "honour": "honor",
    "judgement": "judgment", "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "merchantibility": "merchantability", "noninfringement": "non infringement", "analogue": "analog", "catalogue": "catalog", "fulfil": "fulfill", "whilst": "while", "copyrightholder": "copyright holder",
    "v2": "version 2", "v3": "version 3", "gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "centre": "center", "utilisation": "utilization",
    "noncommercial": "non commercial", "sharealike": "share alike", "noderivatives": "no derivatives", "noderivs": "no derivatives",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _creative_commons() -> list[tuple[str, str]]:
    """Notices of the six licences, by version and without one, in short and long spellings. canonical() makes cc/by-nc and CC-BY-NC the same."""
    longs = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    plain = ("Licensed under {}.", "This work is licensed under {}.", "Licensed under the {} License.", "This work is licensed under the {} License.")
    out = []
    for kind, long in longs.items():
        for version, port in (("", ""), ("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            name = f"CC-{kind}-{version}".rstrip("-")
            texts = [x.format(f"CC {kind} {version}".strip()) for x in (*plain, "License: {}", "Released under the {} License.")]
            for full in dict.fromkeys(f"Creative Commons {long} {x}".strip() for x in (version, f"{version} {port}".strip())):
                texts += [x.format(full) for x in (*plain, "Licensed under a {} License.", "This work is licensed under a {} License.")]
            if version:
                url = f"https://creativecommons.org/licenses/{kind.lower()}/{version}/"
                texts += [f"SPDX-License-Identifier: {name}", f"Licensed under {url}", f"This work is licensed under {url}"]
            out += [(name, x) for x in texts]
    return out


#: (licence, text): public licences that are short enough to be kept here, each with and without its title, and notices of one line.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + _BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAME + _BSD_TAIL),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB), ("Unlicense", _UNLICENSE), ("Apache-2.0", _APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License 2.0."), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    *((x, f"SPDX-License-Identifier: {x}") for x in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-3.0-only", "MPL-2.0", "Unlicense", "Zlib", "CC0-1.0", "CC-BY-4.0")),
    *_creative_commons(),
)

#: (licence, digest of the canonical text) of long licences. AGPL, EPL and editions with other addresses are missing.
LONG: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "0f514ad177997cefd0881d134b0cd69b97e96a51610824faed1112806e878a33"),
    ("Apache-2.0", "d55a30b6ea3cb94b192108722fb09f157b6af953505f03622be762a33038db90"),  # up to the end of the terms
    ("GPL-1.0", "226ec257733c7ff7578cf817e50df013e011328b04c35b903608f8979c5aff95"),
    ("GPL-1.0", "7beecf55d9942099544f628d2c2cd364b7046a02828bdfcadb90800a13528269"),  # up to the end of the terms
    ("GPL-2.0", "392fbc9eea204dba2f725fb0cb16d100d14f199b0c50e6ebdcdf1a375a437d10"),
    ("GPL-2.0", "a50ebd34b230998ee6c1b17d1c8adbc5f9b2efc5aace9af21f78678764bcb09c"),  # up to the end of the terms
    ("GPL-3.0", "62dd5f754f69b36326f90555ba4036401c752656eb677a97e29860b8610cf2fd"),
    ("GPL-3.0", "2649605802f80a34f221663fc269c57089c6cd504add04b76b3f652c086728ae"),  # up to the end of the terms
    ("LGPL-2.0", "0babd739e1d1ab5d3abd70928db284f5eb138cd6026db54086178cdef5c22fef"),
    ("LGPL-2.0", "aade5d97185f3a0dcf4ca67ada3e92799ee451b4e56c79e329d8d7083811bcdc"),  # up to the end of the terms
    ("LGPL-2.1", "b3a541fcca69ff4b2ff91ea4ef34f7ae2a9e35ed6e9a9646acef423148221ac7"),
    ("LGPL-2.1", "526e02df5d182e7fdf201c4d829ce0b637a077b21211b90b487d42c3869a4793"),  # up to the end of the terms
    ("LGPL-3.0", "bb83ad61b05471df1642a68481d1fe137d448a7271fd3a89a2ce20aaf466f6fb"),
    ("MPL-1.1", "7512adcce5fd8054c7c0b13f4805ff92e2dc1c1845130312cf61d005e284bb57"),
    ("MPL-2.0", "b812fe1c9c2227ff7fa9e9d6deb3bc037aeead7ec139669b795e159bfb21adc9"),
    ("CC0-1.0", "51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa"),
)

_WORD = r"(^| )({})( |$)"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), without copyright lines, list marks and punctuation, in one spelling, single spaces. Null: empty."""
    x = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, by in STEPS:
        x = F.regexp_replace(x, pattern, by)
    x = F.trim(x)
    spelt = F.transform(F.split(x, " "), lambda w: F.coalesce(F.try_element_at(_spelling_map(), w), w))
    # a text without any variant keeps its characters, so the array is only built where one may occur
    return F.when(x.rlike(_WORD.format("|".join(sorted(SPELLINGS)))), F.array_join(spelt, " ")).otherwise(x)


def _spelling_map() -> Column:
    return F.create_map(*(F.lit(v) for pair in SPELLINGS.items() for v in pair))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license) of known licences: pairs of licence and text, or a DataFrame with columns license and text; with KNOWN itself, LONG's too. Of licences with one digest, the first by name stays."""
    table = known if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, text string")
    digests = table.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license")
    if known is KNOWN:
        digests = digests.union(spark.createDataFrame([(d, k) for k, d in LONG], "digest string, license string"))
    return digests.groupBy("digest").agg(F.min("license").alias("license"))


#: A line can only be a notice if it has one of these words; every notice of one line must.
LINE_HINT = r"licen[cs]|public domain"


def notices(known=KNOWN) -> list[tuple[str, str]]:
    """The texts of one line that have LINE_HINT; others are only known as whole texts. They become literals of the plan, so there may be 1,000 at most."""
    if isinstance(known, DataFrame):
        found = known.where(F.col("text").isNotNull() & ~F.col("text").contains("\n") & F.translate("text", UPPER, LOWER).rlike(LINE_HINT)).limit(1001).collect()
        out = [(r["license"], r["text"]) for r in found]
    else:
        out = [(k, x) for k, x in known if "\n" not in x and re.search(LINE_HINT, x.translate(str.maketrans(UPPER, LOWER)))]
    if len(out) > 1000:
        raise ValueError("at most 1,000 notices of one line")
    return out


def scan(docs: DataFrame, known=KNOWN, id: str = "doc_id", text: str = "text", most_broadcast: int = 100_000) -> DataFrame:
    """One row for each row of docs: doc_id, digest, license, n_notices, notices.

    digest: SHA-256 of the whole canonical text; license: the known licence with it, else null.
    Each line is a text of its own too, for the notices that stand among other text: n_notices
    counts the lines whose digest is a known notice's, notices lists their licences, sorted,
    comma-joined, each once (empty: none). A null or empty text has the digest of the empty
    string and no licence; repeated rows give repeated rows; other columns are not read.

    known's digests are broadcast up to most_broadcast rows of about 100 bytes, and shuffled
    beyond that. Only lines with a hint of a licence are digested.
    """
    spark = docs.sparkSession
    licences = known_digests(spark, known)
    if len(licences.take(most_broadcast + 1)) <= most_broadcast:
        licences = F.broadcast(licences)
    lines = notices(known)
    by_line = F.create_map(*(F.lit(v) for r in known_digests(spark, lines).collect() for v in (r["digest"], r["license"]))) if lines else F.create_map().cast("map<string,string>")
    held = F.coalesce(F.col(text), F.lit(""))
    candidates = F.filter(F.split(held, "\n"), lambda x: F.translate(x, UPPER, LOWER).rlike(LINE_HINT))
    found = F.filter(F.transform(candidates, lambda x: F.try_element_at(by_line, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.col(id).alias("doc_id"),
        F.sha2(canonical(F.col(text)), 256).alias("digest"),
        F.when(F.translate(held, UPPER, LOWER).rlike(LINE_HINT), found).otherwise(none).alias("found"),
    )
    return rows.join(licences, "digest", "left").select(
        "doc_id", "digest", "license", F.size("found").cast("bigint").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices")
    )


def oracle_sql(known=KNOWN) -> str:
    """DuckDB SQL for scan() over documents. It has no digests of LONG, so it gives a document that is such a licence none."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def clean(x: str) -> str:
        x = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
        for pattern, by in STEPS:
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"
        return f"trim({x})"

    pairs = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in SPELLINGS.items())
    texts = ", ".join(f"({quote(k)}, {quote(x)}, {str(chr(10) not in x).lower()})" for k, x in known)
    return f"""
        WITH spelt AS (SELECT map(list(a), list(b)) AS m FROM (VALUES {pairs}) AS t(a, b)),
        known_texts AS (SELECT license, sha256(array_to_string(list_transform(string_split({clean('x')}, ' '), lambda w: coalesce(m[w], w)), ' ')) AS digest, one FROM (VALUES {texts}) AS t(license, x, one), spelt),
        known AS (SELECT digest, min(license) AS license FROM known_texts GROUP BY digest),
        known_lines AS (SELECT digest, min(license) AS license FROM known_texts WHERE one GROUP BY digest),
        rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        whole AS (SELECT r, doc_id, sha256(array_to_string(list_transform(string_split({clean('text')}, ' '), lambda w: coalesce(m[w], w)), ' ')) AS digest FROM rows, spelt),
        lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM rows),
        line_digests AS (SELECT r, sha256(array_to_string(list_transform(string_split({clean('x')}, ' '), lambda w: coalesce(m[w], w)), ' ')) AS digest FROM lines, spelt WHERE regexp_matches(translate(x, '{UPPER}', '{LOWER}'), {quote(LINE_HINT)})),
        hits AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM line_digests JOIN known_lines USING (digest) GROUP BY r)
        SELECT doc_id, whole.digest AS digest, license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notices
        FROM whole LEFT JOIN known ON known.digest = whole.digest LEFT JOIN hits USING (r)"""
