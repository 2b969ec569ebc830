"""License scans by canonical digest.

A whole text is brought to a canonical form: lower case; lines that state a
copyright or reserve rights removed; every run of punctuation, symbols and white
space made one space; equivalent spellings replaced by one of them.  Its SHA-256
is then hash-joined with the digests of known licence texts: short ones pass
through the same expressions, long ones are known by their digests alone.  The
same look-up by line finds the known texts that stand within a text as a line of
their own.  The known table has a few dozen rows, fixed by the caller, so it is
broadcast.

Defined results: a null text is the empty text and matches nothing; texts of any
length are digested whole; a text that matches several known names (the same text
under two names) gets the first in order; a notice that stands in several lines
is named once for each; repeated rows each get a row; an empty table gives an
empty result; other columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
import operator
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import OWN

# Pairs of equivalent words after the public SPDX matching guidelines; replaced in this order.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("artefact", "artifact"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelled", "labeled"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("licencing", "licensing"),
    ("merchantable quality", "merchantability"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("owner s", "owners"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("sub licensed", "sublicensed"),
    ("sub licensing", "sublicensing"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Short licence texts and standard notices, as published.
KNOWN = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
}

#: A line that begins with copyright, (c) or the sign, whatever follows; but not where a sentence of a licence is wrapped before the word.
COPYRIGHT_LINE = (
    r"(^|\n)[\x00-\x09\x0B-\x20#*/;<\-\p{Z}\p{Cf}]*"
    r"(copyright(?![\p{Z}\x09]+(holders?|owners?|notices?|laws?|licen[cs]es?|and|or|in|interest|statement|treaty|treaties)\b)|\(c\)|©|all rights reserved)[^\n]*"
)
#: All punctuation, symbols, white space and controls.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]+"

KNOWN |= {
    "BSD-3-Clause": KNOWN["BSD-2-Clause"].replace(
        "\n\nTHIS SOFTWARE",
        "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
    ),
    "MIT-0": KNOWN["MIT"].replace(
        "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "to do so."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
    ),
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Headings under which the whole texts are published.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
}


# Digests, under the canonical form below, of long licences as published: whole files, and where they have
# an appendix also their terms alone, with and without the line that ends them.
DIGESTS = {
    "045649cdaf85384ba827242062f2f3b36409835c98d297e25177cb1faf7c2847": "Apache-2.0",
    "108490d21e2d3edc9128233e48fabc169818d0c7c5f0bbdd58231a367d2d6c87": "Apache-2.0",
    "6ed232a1aaf66db92997c53c056b853f2a64b9f74585489f71cbae1bb4d6d166": "Apache-2.0",
    "db00267c8c9852becb941e7e1521e9ab56350f5ba7e3388a8c5a675b35475a8d": "CC0-1.0",
    "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd": "GFDL-1.3",
    "c9150a998ddbe45123303bf71d093beee4baf803b1eaea84b34fd41189285f1f": "GPL-2.0",
    "f79b9e516923cc213c21d12fd8a51b4067992b2728a442e31fd53d078dd25632": "GPL-2.0",
    "b1a13b5262988058eb24fa2ecc2451ae813514d152b9361d66a115e43a210bf9": "GPL-2.0",
    "a32604dcaa93f4d8f3be608b8dae73ada612a157d878d7976fcd09daab0aa437": "GPL-3.0",
    "22eb3e82400f2536b74963f211af3daaacb548fcde0fe018459b6f2b53a06f8f": "GPL-3.0",
    "7d95968a306fd516a913cc925e63a43d0ad36b932d42d874d6093ea9fb83220c": "GPL-3.0",
    "bd41c353168fa7258dd575b15107e47406e00e0363f0b975ba9491152352df8a": "LGPL-2.1",
    "d07869bf5da5c86d37a7aa8ce3c2604cdd09807d9b2d8d7317e8f845e4d9ec81": "LGPL-2.1",
    "d04fa14390eef6fc26b89914eb26811d1b31d6830f3058081a2a5885cd5df5c6": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6": "MPL-1.1",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
}


def forms() -> list[tuple[str, str]]:
    """Names and texts: each with and without the numbers of its clauses, under no heading and under each one."""
    out = []
    for name, text in KNOWN.items():
        plain = text
        for n in "123":
            plain = plain.replace(f"\n\n{n}. ", "\n\n")
        for body in dict.fromkeys([text, plain]):
            out += [(name, body), *((name, f"{title}\n\n{body}") for title in TITLES.get(name, []))]
    return out


def canonical(text: Column) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    c = F.regexp_replace(c, COPYRIGHT_LINE, "\n")
    # two spaces between words: each has a space of its own on either side, so neighbours are replaced alike
    c = F.concat(F.lit(" "), F.regexp_replace(c, SEPARATORS, "  "), F.lit(" "))
    for this, one in EQUIVALENT:
        c = F.replace(c, F.lit(f" {this} ".replace(" ", "  ")[1:-1]), F.lit(f" {one} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(c, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_texts(spark: SparkSession, known: dict[str, str] | None = None) -> dict[str, list[str]]:
    """known: names and texts; by default all of this module's.  For each canonical form, which Spark works out as it does for documents, the names that it goes by."""
    rows = spark.createDataFrame(forms() if known is None else [*known.items()], "license string, known_text string").select("license", canonical(F.col("known_text")).alias("c"))
    found: dict[str, list[str]] = {}
    for r in rows.collect():  # as many as the caller knows
        found.setdefault(r.c, []).append(r.license)
    return found


def marks(canonical_texts: list[str]) -> list[str]:
    """A few words, one of which every text that is equal to a known one has in it, letter by letter in lower case: no spelling leads to them."""
    spelled = {w for _, one in EQUIVALENT for w in one.split()}
    left, chosen = [set(t.split()) - spelled for t in canonical_texts], []
    if not all(left):
        return [""]
    while left:
        words = Counter(w for own in left for w in own)
        best = max(words, key=lambda w: (min(len(w), 6), words[w], len(w), w))
        chosen.append(best)
        left = [own for own in left if best not in own]
    return chosen


def scan(docs: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``__loom_digest``, ``__loom_license`` (null: not a known licence text) and ``__loom_notices``, the names of its lines that are known texts, in their order."""
    spark = docs.sparkSession
    texts = known_texts(spark, known)
    names = {hashlib.sha256(c.encode()).hexdigest(): min(own) for c, own in texts.items()}
    every = names if known is not None else DIGESTS | names
    table = spark.createDataFrame([*every.items()], f"{OWN}digest string, {OWN}license string")
    rows = docs.withColumn(OWN + "digest", digest(F.col("text"))).join(F.broadcast(table), OWN + "digest", "left")
    if not names:
        return rows.withColumn(OWN + "notices", F.array().cast("array<string>"))
    words = marks([*texts])

    def marked(text: Column) -> Column:
        small = F.lower(text)
        return reduce(operator.or_, [F.contains(small, F.lit(w)) for w in words])

    # only lines that have one of the words are brought to the canonical form; most texts have none
    lines = F.filter(F.split(F.col("text"), r"\r\n?|\n"), marked)
    by_digest = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    hits = F.transform(F.filter(F.transform(lines, digest), lambda d: d.isin(list(names))), lambda d: F.element_at(by_digest, d))
    return rows.withColumn(OWN + "notices", F.when(F.coalesce(marked(F.col("text")), F.lit(False)), hits).otherwise(F.array().cast("array<string>")))
