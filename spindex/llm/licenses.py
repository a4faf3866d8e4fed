"""Operator 3: licence scans by canonical digests of entire texts.

Only DataFrame functions: the scan stays in the JVM.
"""

from __future__ import annotations

import functools
import pathlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Texts of short licences and notices (those of longer ones, as published, are in
# license_texts), and the words that licences spell in two ways.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
}
TITLES = ("the mit license", "mit license", "isc license", "bsd 2 clause license", "bsd zero clause license", "mit no attribution", "zlib license", "the zlib license")
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense",
    "acknowledgement": "acknowledgment", "authorisation": "authorization", "authorised": "authorized", "analogue": "analog", "favour": "favor",
    "favourable": "favorable", "honour": "honor", "modernise": "modernize", "organisation": "organization", "organisations": "organizations",
    "recognised": "recognized", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "merchantibility": "merchantability",
    "noncommercial": "non commercial", "noninfringement": "non infringement", "http": "https",
}
#: Lines that state a copyright: the word or sign with a sign, a year or a place for one after it, or
#: the word with a holder's usual ending; and those that reserve all rights.
_BEFORE = r"^[ \t#*/;-]*"
_YEAR = r"[ \t]*[,:]?[ \t]*(?:\(c\)|©|[0-9]{4}|[<\[{])"
_HOLDER = r"[ \t][^\n]*(?:authors|contributors|foundation|inc|ltd|llc|gmbh|corp|corporation|company|university|all rights reserved)[.,]?[ \t\r]*$"
RIGHTS = rf"{_BEFORE}copyright(?:{_YEAR}[^\n]*$|{_HOLDER})|{_BEFORE}\(c\)[ \t]*[0-9]{{4}}[^\n]*$|{_BEFORE}©[^\n]*$|{_BEFORE}all rights reserved\.?[ \t\r]*$"
#: Numbers and letters of a list, at a line's begin.
LISTED = rf"{_BEFORE}\(?(?:[0-9]{{1,2}}|[a-z])[.)][ \t]+"
MARKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
TITLE = f"^(?:{'|'.join(sorted(TITLES, key=len, reverse=True))}) "


@functools.cache
def known_texts() -> dict[str, str]:
    """All known licences: the short ones above and those of license_texts."""
    folder = pathlib.Path(__file__).parent / "license_texts"
    return KNOWN | {p.stem: p.read_text() for p in sorted(folder.glob("*.txt"))}


def canonical(text: Column) -> Column:
    """The text in the form whose digest is looked up.

    ASCII letters in lower case; lines that only state a copyright or reserve all
    rights dropped; numbers of a list dropped; every run of ASCII characters but letters and digits one space;
    spellings of SPELLINGS by their American form; a leading licence title
    dropped; trimmed.
    """
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lines = F.regexp_replace(low, f"(?md){RIGHTS}", "")
    words = F.regexp_replace(F.regexp_replace(lines, f"(?md){LISTED}", " "), MARKS, " ")
    found = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    two_ways = "|".join(sorted(SPELLINGS))
    spelled = found
    for other, american in SPELLINGS.items():
        # twice: neighbours share a space
        spelled = F.replace(F.replace(spelled, F.lit(f" {other} "), F.lit(f" {american} ")), F.lit(f" {other} "), F.lit(f" {american} "))
    spelled = F.trim(F.when(found.rlike(f" (?:{two_ways}) "), spelled).otherwise(found))
    return F.regexp_replace(spelled, TITLE, "")


def canonical_sql(text: str) -> str:
    """`canonical` in DuckDB's SQL."""
    quoted = [x.replace("'", "''") for x in (RIGHTS, MARKS, TITLE, LISTED)]
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"' ' || trim(regexp_replace(regexp_replace(regexp_replace({low}, '(?m){quoted[0]}', '', 'g'), '(?m){quoted[3]}', ' ', 'g'), '{quoted[1]}', ' ', 'g'), ' ') || ' '"
    for other, american in SPELLINGS.items():
        for _ in range(2):
            out = f"replace({out}, ' {other} ', ' {american} ')"
    return f"regexp_replace(trim({out}, ' '), '{quoted[2]}', '')"


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, license_digest) of the known licences; one row for each digest."""
    parts = [F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in (known_texts() if texts is None else texts).items()]
    rows = spark.range(1).select(F.explode(F.array(*parts)).alias("l")).select("l.license_id", digest(F.col("l.text")).alias("license_digest"))
    return rows.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, text_col: str = "text", digest_col: str = "text_digest", license_col: str = "license_id") -> DataFrame:
    """`docs` with the digest of each entire text and the licence it is, or null.

    A left hash join with the known digests.  Those of this module are a fixed
    list and are broadcast; others' size is left to Spark to judge, and a digest
    that many rows share is split by its handling of skewed joins.

    Null, empty and wordless texts have the digest of the empty text and no
    licence.  Repeated rows are scanned each; an empty table gives no rows.  The
    new columns replace columns of the same names.
    """
    kept = docs.drop(digest_col, license_col).withColumn(digest_col, digest(F.col(f"`{text_col}`")))
    own = F.broadcast(known_licenses(docs.sparkSession)) if known is None else known
    own = own.select(F.col("license_digest").alias("__digest"), F.col("license_id").alias(license_col))
    empty = F.sha2(F.lit(""), 256)
    joined = kept.join(own, (F.col(digest_col) == F.col("__digest")) & (F.col("__digest") != empty), "left")
    return joined.drop("__digest")
