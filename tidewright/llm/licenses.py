"""License scans by canonical digests, with DataFrame functions only.

A line's canonical form is lower case, without copyright lines, with equivalent spellings made one, and with every
stretch that is neither letter nor digit a space. A text's canonical form is that of its lines, joined. Digests of
whole texts and of whole lines are hash-joined to the digests of known licence texts and notices.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm._common import documents

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: MD5 of the canonical form of whole public licence texts, as `canonical` gives it.
WHOLE_TEXTS: list[tuple[str, str]] = [
    ("Apache-2.0", "29cd1b18334249e98bcf48ee185d0476"),
    ("Artistic-1.0", "2b49f1d876d50d9b0f484cfb042bda71"),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("GFDL-1.2", "6fae616a2084258d6f1635920433f2e2"),
    ("GFDL-1.3", "9715992e76e496f0c0d0a6fcfb268fed"),
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),
    ("GPL-2.0", "e374d0b43c25aed1a2b28951fe92a546"),
    ("GPL-3.0", "057f186a69ca5796ed5fd60ffc00e686"),
    ("LGPL-2.0", "188ee96c3fde3bf894b738168ecad5a0"),
    ("LGPL-2.1", "30f3ca192b711cce8cabbac60dd96b5b"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "b7edc06df79bc44a04f12befb8111960"),
    ("MPL-2.0", "0d0c617863ffeb16c5cb1f094c2d68b2"),
]
#: Known licence texts and notices, as (identifier, text).
LICENSES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]
#: Spellings that count as equal.
SPELLINGS: list[tuple[str, str]] = [("licence", "license"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder")]
_COPYRIGHT = r"^\s*(copyright\b|\(c\)|©|all rights reserved).*"


def canonical(text: str) -> str:
    """The same for one known text, on the driver."""
    out = []
    for line in text.split("\n"):
        line = re.sub(_COPYRIGHT, "", line.lower())
        line = re.sub(r"[^a-z0-9]+", " ", line).strip()
        for a, b in SPELLINGS:
            line = line.replace(a, b)
        out.append(line)
    return " ".join(x for x in out if x)


def known_digests() -> list[tuple[str, str]]:
    return sorted({(name, hashlib.md5(canonical(text).encode()).hexdigest()) for name, text in LICENSES} | set(WHOLE_TEXTS))


def canonical_line(line: Column) -> Column:
    line = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), _COPYRIGHT, ""), "[^a-z0-9]+", " "))
    for a, b in SPELLINGS:
        line = F.replace(line, F.lit(a), F.lit(b))
    return line


def digests(texts: DataFrame) -> DataFrame:
    """(license, digest) of whole texts (license, text), to be scanned for."""
    lines = F.filter(F.transform(F.split("text", "\n"), canonical_line), lambda x: x != "")
    return texts.select("license", F.md5(F.array_join(lines, " ").cast("binary")).alias("digest")).dropna().distinct()


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, license, n_lines, whole): documents that hold a known text as a line or are one as a whole.

    known: (license, digest), distinct, as `digests` gives it for a table of texts; by default the texts and notices named in this module.
    Null and empty texts hold none. Rows without a doc_id come under a null id. Equal rows add up their lines. An empty table gives no
    rows; very long texts are canonicalised whole; other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    given = known is not None
    known = known if given else spark.createDataFrame(known_digests(), "license string, digest string")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(F.split("text", "\n"), canonical_line).alias("lines"))
    filled = F.filter("lines", lambda x: x != "")
    whole = F.struct(F.lit(1).alias("whole"), F.md5(F.array_join(filled, " ").cast("binary")).alias("digest"))
    units = lines.select("doc_id", F.explode(F.concat(F.array(whole), F.transform(filled, lambda x: F.struct(F.lit(0).alias("whole"), F.md5(x.cast("binary")).alias("digest"))))).alias("u")).select("doc_id", "u.*")
    met = units.join(known.select("license", "digest") if given else F.broadcast(known), "digest")  # the list of this module is fixed
    return met.groupBy("doc_id", "license").agg(F.count_if(F.col("whole") == 0).alias("n_lines"), (F.max("whole") == 1).alias("whole"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, license, n_lines, whole) of all documents against the texts and notices of this module."""
    return scan(documents(spark, sf_dir))


def op10_sql() -> str:
    line = "trim(regexp_replace(regexp_replace(lower(x), '" + _COPYRIGHT + "', ''), '[^a-z0-9]+', ' ', 'g'))"
    for a, b in SPELLINGS:
        line = f"replace({line}, '{a}', '{b}')"
    known = ", ".join(f"('{n}', '{d}')" for n, d in known_digests())
    return f"""
    WITH known(license, digest) AS (VALUES {known}),
    lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {line}), lambda x: x <> '') AS l FROM documents),
    units AS (SELECT doc_id, 1 AS whole, md5(array_to_string(l, ' ')) AS digest FROM lines
              UNION ALL SELECT doc_id, 0 AS whole, md5(x) AS digest FROM (SELECT doc_id, unnest(l) AS x FROM lines))
    SELECT doc_id, license, CAST(count(*) FILTER (whole = 0) AS BIGINT) AS n_lines, max(whole) = 1 AS whole
    FROM units JOIN known USING (digest) GROUP BY doc_id, license
    """
