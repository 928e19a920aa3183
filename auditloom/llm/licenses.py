"""Licence scans by canonical digest, in DataFrame operations only.

A text is brought to a canonical form (case, typographic marks, punctuation, copyright
lines, equivalent spellings) and its SHA-256 is joined with those of known licences, which
are brought to the same form. The whole text is looked up, and each of its lines, since
notices stand on lines of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Typographic marks and their plain forms.
_MARKS, _PLAIN = "“”„«»‘’‚‐‑‒–—− ", "\"\"\"\"\"'''------ "
#: A copyright line: begins, after marks, with the sign, with copyright and a sign, year or "by", or with (c) and one of these or a short name and a year, so not with a clause (c); or says all rights are reserved.
COPYRIGHT = (
    r"(?md)^[^A-Za-z0-9\n]*(?:[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt][ \t]+(?:©|\([Cc]\)|[0-9]|[Bb][Yy] ).*|©.*|\([Cc]\)[ \t]+(?:©|[12][0-9]{3}|[Bb][Yy] |[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]).*"
    r"|\([Cc]\)[ \t]+[^.;:\n]{0,60}[ ,][12][0-9]{3}[^A-Za-z0-9\n]*|[Aa][Ll][Ll] [Rr][Ii][Gg][Hh][Tt][Ss] [Rr][Ee][Ss][Ee][Rr][Vv][Ee][Dd].*)$"
)
#: Spellings taken as equal, to the right-hand form.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analyse": "analyze", "artefact": "artifact", "authoris": "authoriz", "calibre": "caliber",
    "cancelled": "canceled", "catalogue": "catalog", "categoris": "categoriz", "centre": "center", "copyright owner": "copyright holder",
    "emphasis": "emphasiz", "favour": "favor", "fulfil ": "fulfill ", "fulfilment": "fulfillment", "initialis": "initializ", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "maximis": "maximiz", "modelled": "modeled", "modelling": "modeling",
    "non commercial": "noncommercial", "offence": "offense", "optimis": "optimiz", "organis": "organiz", "per cent": "percent", "practise": "practice",
    "programme": "program", "realis": "realiz", "recognis": "recogniz", "signalling": "signaling", "sub license": "sublicense",
    "utilis": "utiliz", "whilst": "while", "wilful": "willful",
}
#: Known licences, in full where they are short, and the usual notices of others.
KNOWN: dict[str, list[str]] = {
    "MIT": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "SPDX-License-Identifier: ISC",
    ],
    "BSD-2-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
        "SPDX-License-Identifier: Zlib",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}

_BSD_3 = KNOWN["BSD-2-Clause"][0].replace("\nTHIS SOFTWARE", """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE""")
#: Titles that stand above whole texts.
_TITLED = {
    "MIT": (KNOWN["MIT"][0], "MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": (KNOWN["ISC"][0], "ISC License", "The ISC License"),
    "BSD-2-Clause": (KNOWN["BSD-2-Clause"][0], "BSD 2-Clause License", "The 2-Clause BSD License", "BSD-2-Clause License"),
    "BSD-3-Clause": (_BSD_3, "BSD 3-Clause License", "The 3-Clause BSD License", "BSD-3-Clause License"),
    "Zlib": (KNOWN["Zlib"][0], "zlib License", "The zlib License"),
}
#: Further forms of whole texts: those under their titles, and BSD-3-Clause.
FORMS: dict[str, list[str]] = {k: [*[_BSD_3] * (k == "BSD-3-Clause"), *(f"{t}\n{text}" for t in titles)] for k, (text, *titles) in _TITLED.items()}
#: Digests of the canonical forms of long licences, as published, with their title and without; of those with an appendix, also up to it, with its heading line "END OF TERMS" and without.
DIGESTS: dict[str, list[str]] = {
    "Apache-2.0": [
        "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",
        "6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64", "667b62a169edae7212be3c581edf5d6a1fa86c882eeef29e48612c852970f012",
        "fb388936c12fba660a278043424b3f9a17c6b2e536674e390813ac3d06e7e73a", "d7dd8e5c661e35d656a43688fc21624b0ba52216e4c419c747129bf83780d165",
    ],
    "GPL-2.0": [
        "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "e93929eeb2be8f9772ecbf192581530514e850081c975cb69e6e05a40e5060da",
        "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2", "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1",
    ],
    "GPL-3.0": [
        "df71f3c423c11bc52456a9775329f1d9a3168a6f071654750b9eb155fb3ec0eb", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", "cf2756d6526c29d12c3877ef46ee394d13b306906f3912911c81308f082c7bea",
        "4868f466a3292b095d887ce2ca00548d3969efb48c33f6aced9a20c59f578c19", "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2",
    ],
    "LGPL-2.1": [
        "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", "a587a956d736b2fba816989cb7a52371109f3efe93957a305615cb5f2a1a95fe",
        "98d365a8217633113a201b5777e4d26ae0eb1d88079c5e39838162abe1f18db4", "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",
    ],
    "MPL-2.0": [
        "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d", "61525901247b1a7c093fc10f73de8260d1d1a1a8b3bc78f417119ee4fcfb0979",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6",
    ],
}


def canonical(text: Column) -> Column:
    """The canonical form, lines kept; empty lines and copyright lines are gone. Null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT, "")
    out = F.translate(out, _UPPER + _MARKS, _LOWER + _PLAIN)
    # Punctuation and blanks are one blank, and next to a line's end nothing.
    out = F.regexp_replace(out, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    out = F.regexp_replace(out, r"[ \n]*\n[ \n]*", "\n")
    for left, right in EQUIVALENT.items():
        out = F.replace(out, F.lit(left), F.lit(right))
    return F.trim(F.regexp_replace(out, r"^\n|\n$", ""))


def digest(canon: Column) -> Column:
    return F.sha2(canon.cast("binary"), 256)


def whole(canon: Column) -> Column:
    """A canonical text as one line."""
    return F.translate(canon, "\n", " ")


def known_licenses(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """Digests of licences: license_id, license_digest. A digest of several licences belongs to the first by name.

    Without ``known`` they are those of ``KNOWN``, ``FORMS`` and ``DIGESTS``.
    """
    rows = [(k, t, None) for d in ((KNOWN, FORMS) if known is None else (known,)) for k, v in d.items() for t in v]
    rows += [(k, None, h) for k, v in DIGESTS.items() for h in v if known is None]
    table = spark.createDataFrame(rows, "license_id string, text string, made string")
    return table.select("license_id", F.coalesce("made", digest(whole(canonical(F.col("text"))))).alias("license_digest")).groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(documents: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, text_digest, text_license, n_license_lines, line_licenses (sorted array).

    ``text_digest`` is of the whole canonical text; ``text_license`` is the known licence
    with that digest, or null. ``n_license_lines`` counts the lines that are a known
    notice each. Null and empty texts, and such as only copyright lines, have the digest
    of the empty text, which no licence has. Rows that share id and text get a row each;
    extra columns are ignored; without known licences nothing is found. A text that is a
    licence and more has no ``text_license``; clauses lettered (c) are text.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("key")
    known = small(known.filter(F.col("license_digest") != digest(F.lit("")))).select("license_digest", "license_id")
    # A generator's output is worked out once; the optimizer would repeat an alias's expression.
    once = docs.select(key, F.explode(F.array(canonical(F.col("text")))).alias("canon"))
    units = once.select("key", F.posexplode_outer(F.concat(F.array(whole(F.col("canon"))), F.split("canon", "\n"))).alias("place", "unit"))
    looked = units.select("key", (F.col("place") == 0).alias("is_text"), digest(F.trim("unit")).alias("license_digest")).join(known, "license_digest", "left").filter("is_text OR license_id IS NOT NULL")
    # Each text leaves one row besides its known lines. Rows with the same key are copies of one another.
    line = F.when(~F.col("is_text"), F.col("license_id"))
    per = looked.groupBy("key").agg(
        F.count_if("is_text").alias("copies"), F.max(F.when(F.col("is_text"), F.col("license_digest"))).alias("text_digest"), F.max(F.when(F.col("is_text"), F.col("license_id"))).alias("text_license"),
        F.count(line).alias("n"), F.array_sort(F.collect_set(line)).alias("line_licenses"),
    )
    every = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select(F.col("key.doc_id").alias("doc_id"), "text_digest", "text_license", (F.col("n") / F.col("copies")).cast("long").alias("n_license_lines"), "line_licenses")
