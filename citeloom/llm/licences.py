"""Operator 5: licence scans by canonical digest lookup (DataFrame functions only).

A text's canonical form is lower-cased, without copyright lines, with punctuation
and white space folded to single spaces, and with equivalent spellings made one.
The digest of a whole text, and of each of its lines, is looked up among the
digests of known licence texts and notices: a hash join with a table of a few dozen
rows (full texts of the common licences among them, kept as digests). No text is cut and nothing but narrow digest rows is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import table

#: Fixed: spellings that count as the same word (canonical form on the right).
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("http", "https"),
]
#: A line is a copyright line if its canonical form starts so.
COPYRIGHT = r"^(copyright( c)?|c|all rights reserved)( |$)"
COPYRIGHT_SIGN = "©"

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
#: Fixed: known licence texts and notices, (identifier, kind, text). A parameter of scan_licences.
KNOWN = [
    ("MIT", "text", f"MIT License {MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {MIT_WARRANTY}"),
    ("MIT", "text", f"{MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {MIT_WARRANTY}"),
    ("MIT-0", "text", f"MIT No Attribution {MIT_GRANT}. {MIT_WARRANTY}"),
    ("ISC", "text", f"ISC License {ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_WARRANTY}"),
    ("0BSD", "text", f"BSD Zero Clause License {ISC_GRANT}. {ISC_WARRANTY}"),
    ("BSD-2-Clause", "text", f"BSD 2-Clause License {BSD_HEAD}{BSD_WARRANTY}"),
    ("BSD-2-Clause", "text", f"{BSD_HEAD}{BSD_WARRANTY}"),
    ("BSD-3-Clause", "text", f"BSD 3-Clause License {BSD_HEAD}{BSD_THIRD}{BSD_WARRANTY}"),
    ("BSD-3-Clause", "text", f"{BSD_HEAD}{BSD_THIRD}{BSD_WARRANTY}"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
]


#: Fixed: digests of the canonical forms of further licences' entire texts, as their stewards publish them: the whole
#: file, and where it goes on after its terms, the terms alone, without and with the line that ends them.
DIGESTS = [
    ("Apache-2.0", "157e07fc7a377a56354ba8de489b7546"),  # whole
    ("Apache-2.0", "723a8effc594395d684a4e20e0d4fa46"),  # terms
    ("Apache-2.0", "1b22b13f09c7885dd689e759a0575834"),  # terms and their end
    ("Artistic-1.0-Perl", "e2f6e734be6918a2b8c32e507e8eec6b"),  # whole
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),  # whole
    ("CC0-1.0", "f002af1f33b9313a1372dcaae97670ab"),  # whole
    ("GFDL-1.2", "2ec286d7f493244d04156de708b05aaa"),  # whole
    ("GFDL-1.3", "812f3a50e76d2666f83dd4c3fbbd5e14"),  # whole
    ("GPL-1.0", "5036798ce47e4b74b7692d05edea2af7"),  # whole
    ("GPL-1.0", "976e92556d982b5333b1a39ef915384f"),  # terms
    ("GPL-1.0", "b7ea782c47477e5ee6f23b8abb62df88"),  # terms and their end
    ("GPL-2.0", "d3ee684d8a2d63f700afda4a0c09aafc"),  # whole
    ("GPL-2.0", "a457a4f24d02a7088b248e1ed6c2a907"),  # terms
    ("GPL-2.0", "5d1c7199d5ea662f450e2434f1b5369b"),  # terms and their end
    ("GPL-3.0", "3c57ead2a929d5c428065db7e5631f7a"),  # whole
    ("GPL-3.0", "f5294f80e46fb837525225fa88cdbc0d"),  # terms
    ("GPL-3.0", "42a8915bd33b601436b3efa40f9a37ba"),  # terms and their end
    ("LGPL-2.0", "9cda338f607b5473d799726a63fac6ec"),  # whole
    ("LGPL-2.0", "6abb1c138828fbc99e9a6a4cb1d334ab"),  # terms
    ("LGPL-2.0", "bdb0471066b058551c4299a5da9b88b5"),  # terms and their end
    ("LGPL-2.1", "9c8ddac0fb746db5ec6e21261a94f48a"),  # whole
    ("LGPL-2.1", "24a3d76b0e8ad577697d4e2729a690f3"),  # terms
    ("LGPL-2.1", "aca5ebf16463d30a158e98f30fc49a24"),  # terms and their end
    ("LGPL-3.0", "d5e3e63dd48d2946274ba8e9c86bdb21"),  # whole
    ("MPL-1.1", "33e41eb73b2b134db1e4f05906acc907"),  # whole
    ("MPL-2.0", "a27e119cd87d765a971af4667b2bf9b1"),  # whole
]
#: Known digests that may be broadcast; a larger table is joined by a shuffle.
BROADCAST = 10_000


def _folded(line: Column) -> Column:
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that is neither empty nor a copyright line."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit(COPYRIGHT_SIGN)))
    return F.filter(F.transform(lines, _folded), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def known_digests(spark: SparkSession, known: list[tuple[str, str, str]], digests: list[tuple[str, str]]) -> DataFrame:
    """(licence, digest) of known texts and known digests, each digest once."""
    rows = spark.createDataFrame(known, "licence string, kind string, body string")
    made = rows.select("licence", F.md5(F.array_join(canonical_lines(F.col("body")), " ")).alias("digest"))
    return made.unionByName(spark.createDataFrame(digests, "licence string, digest string")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: list[tuple[str, str, str]] | None = None, text: str = "text", digests: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add digest (of the whole text), licence (known whole text, else null) and notices (sorted ids of known lines).

    known: (licence, kind, text); digests: (licence, digest of a canonical form). A
    null text, or one without any canonical line, has a null digest and no notices.
    Repeated rows stay; other columns stay but for those named like the added ones.
    Empty tables give none.
    """
    spark = docs.sparkSession
    known = KNOWN if known is None else known
    digests = (DIGESTS if known is KNOWN else []) if digests is None else digests
    table_ = known_digests(spark, known, digests)
    base = docs.drop("digest", "licence", "notices").withColumn("_lines", canonical_lines(F.col(text)))
    base = base.withColumn("digest", F.when(F.size("_lines") > 0, F.md5(F.array_join("_lines", " "))))
    # Lines are looked up in a literal map of the known texts, which the caller gives as a list.
    lines = known_digests(spark, known, [])
    ids = {r["digest"]: r["licence"] for r in lines.collect()}
    lookup = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair]) if ids else F.lit(None).cast("map<string,string>")
    found = F.filter(F.transform("_lines", lambda x: F.element_at(lookup, F.md5(x))), lambda x: x.isNotNull())
    out = base.withColumn("notices", F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>"))).drop("_lines")
    few = len(known) + len(digests) <= BROADCAST
    return out.join(F.broadcast(table_) if few else table_, "digest", "left").select(*[c for c in docs.columns if c not in ("digest", "licence", "notices")], "digest", "licence", "notices")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return out.withColumn("notices", F.array_join("notices", ","))


def _sql_folded(line: str) -> str:
    out = f"' ' || trim(regexp_replace(lower({line}), '[^a-z0-9]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


def _sql_lines(text: str) -> str:
    lines = f"list_filter(string_split({text}, chr(10)), lambda x: NOT starts_with(ltrim(x), '{COPYRIGHT_SIGN}'))"
    return f"list_filter(list_transform({lines}, lambda x: {_sql_folded('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '{COPYRIGHT}'))"


SQL = f"""
WITH known AS (
  SELECT min(licence) AS licence, digest FROM (
    SELECT licence, md5(array_to_string({_sql_lines('body')}, ' ')) AS digest
    FROM (VALUES {', '.join("('" + i + "', '" + t.replace("'", "''") + "')" for i, _, t in KNOWN)}) AS k(licence, body)
    UNION ALL SELECT * FROM (VALUES {', '.join(f"('{i}', '{d}')" for i, d in DIGESTS)}) AS g(licence, digest)) GROUP BY digest
), d AS (SELECT doc_id, {_sql_lines('text')} AS lines FROM documents),
digests AS (SELECT doc_id, CASE WHEN len(lines) > 0 THEN md5(array_to_string(lines, ' ')) END AS digest FROM d),
notes AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT doc_id, unnest(lines) AS line FROM d) JOIN known ON md5(line) = known.digest GROUP BY doc_id
)
SELECT doc_id, digest, licence, coalesce(notices, '') AS notices FROM digests LEFT JOIN known USING (digest) LEFT JOIN notes USING (doc_id)
"""
