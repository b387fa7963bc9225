"""License scans by canonical digests, in DataFrame operations only.

A text is brought to a canonical form: lower case, copyright lines gone, punctuation and white space (typographic
forms too) reduced to single spaces, equivalent spellings unified.  The digest of the whole form is joined with the
digests of known licence texts.  So are the digests of a text's single lines, since notices stand alone in a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import known_licenses

# Spellings that licence guidelines treat as equal, in a text of plain words, applied in order.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("whilst", "while"), ("https www", "http www"),
)
# Words that follow "copyright" where a sentence speaks of it: such a place states none, even where a line begins there.
SENTENCE = r"copyright[ \t]+(holder|owner|notice|law|license|licence|interest|disclaimer|statement|permission|protection|claim|act |and |or |in |of |to |is )"
# A line that states a copyright: the word or sign with a year, a sign, "by", a blank to fill in, or a holder that is named as such; with the
# lines right below it that name more holders.
COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/;]*((portions )?copyright[ \t:,]*(\(c\)|©|[0-9]{4}|by |\[|<|\{)|\(c\)[ \t]*(copyright|[0-9]{4}|by |\[|<|\{)|©"
    r"|(portions )?copyright[ \t:,]+[^\n]{0,80}\b(authors|contributors|foundation|developers|maintainers|team|project|group|university|inc|llc|ltd|limited|corp|corporation|company|gmbh)[.,]?[ \t]*(\n|$))"
    r"[^\n]*(\n[ \t*#/;]*\(c\)[^\n]*)*"
)
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f\x{a0}-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}]+"

BROADCAST_KNOWN = 100_000  # known digests, some 10 MB, that are broadcast at most
RIGHTS = "all rights reserved"  # says nothing about the licence, so a whole text is compared without it

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
    "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
    "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Known licence texts and one-line notices with the licence each stands for.
KNOWN = (
    ("MIT", _GRANT),
    ("MIT", "MIT License " + _GRANT),
    ("MIT", "The MIT License (MIT) " + _GRANT),
    ("ISC", _ISC),
    ("ISC", "ISC License " + _ISC),
    *[("MIT", f"{head} {_GRANT}") for head in ("The MIT License", "MIT License (MIT)", "MIT", "License", "The MIT License (MIT License)", "Expat License", "MIT License:", "License (MIT)")],
    *[("ISC", f"{head} {_ISC}") for head in ("The ISC License", "ISC License (ISC)", "ISC", "License", "The ISC License (ISC)")],
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("all-rights-reserved", "All rights reserved."),
    *known_licenses(),
)


def _plain(text: Column) -> Column:
    """Lower case, copyright lines gone, punctuation and white space reduced to single spaces inside each line."""
    low = F.lower(text)
    stated = low.contains("copyright") | low.contains("(c)") | low.contains("©")  # other texts have no such line
    spoken = F.regexp_replace(low, SENTENCE, "copyright\x02$1")
    return F.regexp_replace(F.when(stated, F.regexp_replace(spoken, COPYRIGHT_LINE, "$1")).otherwise(low), PUNCTUATION, " ")


def _spelled(plain: Column) -> Column:
    """One line of words: the canonical form of what :func:`_plain` made."""
    out = F.regexp_replace(plain, "[ \\n]+", " ")
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(usual))
    return F.trim(out)


def _whole(plain: Column) -> Column:
    """The canonical form of a whole text: reserved rights are not said, unless nothing else is."""
    words = _spelled(plain)
    rest = F.trim(F.replace(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(f" {RIGHTS} "), F.lit(" ")))
    return F.when(rest == "", words).otherwise(rest)


def canonical(text: Column) -> Column:
    return _whole(_plain(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license) of known texts; of a text named twice the first licence in alphabetic order counts."""
    table = spark.createDataFrame(list(known), "license string, text string")
    return table.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the canonical text), license (of the whole text, or null) and notices for every row.

    ``known`` has digest and license (:func:`known_digests`) and may be of any size; null digests and null licences
    are left out, of a digest named twice the first licence counts.  ``notices`` is the sorted list of the licences
    whose text is one whole line, joined by commas, empty where there is none.  All distinct lines are looked up.
    Null text is empty.  Repeated rows and null ids stay rows of their own; an empty table gives an empty result;
    other columns of ``docs`` are not read.
    """
    known = known.where("digest is not null and license is not null").groupBy("digest").agg(F.min("license").alias("license"))
    if known.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN:  # then no text is shuffled to meet it
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.sha2("text", 256).alias("own"), _plain(F.col("text")).alias("plain"))
    # Notices are a text's own, so they are found by its digest; texts without one have no row here.
    lines = rows.select("own", F.explode(F.array_distinct(F.split("plain", "\n"))).alias("line")).where(F.length("line") > 1)
    found = lines.select("own", F.sha2(_spelled(F.col("line")), 256).alias("digest")).join(known, "digest")
    notices = found.groupBy("own").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = rows.select("doc_id", "own", F.sha2(_whole(F.col("plain")), 256).alias("digest")).join(known, "digest", "left")
    return whole.join(notices, "own", "left").select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), known_digests(spark))


def sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def plain(x: str) -> str:
        return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '{SENTENCE}', 'copyright' || chr(2) || '\\1', 'g'), '{COPYRIGHT_LINE}', '\\1', 'g'), '{PUNCTUATION}', ' ', 'g')"

    def whole(x: str) -> str:
        rest = f"trim(replace(' ' || {spelled(x)} || ' ', ' {RIGHTS} ', ' '))"
        return f"CASE WHEN {rest} = '' THEN {spelled(x)} ELSE {rest} END"

    def spelled(x: str) -> str:
        out = f"regexp_replace({x}, '[ \\n]+', ' ', 'g')"
        for other, usual in SPELLINGS:
            out = f"replace({out}, '{other}', '{usual}')"
        return f"trim({out})"

    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT sha256({whole(plain("t"))}) AS digest, min(l) AS license FROM (VALUES {values}) v(l, t) GROUP BY 1),
rows AS (SELECT row_number() OVER () AS r, doc_id, {plain("coalesce(text, '')")} AS t FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM rows),
notes AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT r, sha256({spelled("line")}) AS digest FROM lines WHERE length(line) > 1) JOIN known USING (digest) GROUP BY r)
SELECT doc_id, x.digest, license, coalesce(notices, '') AS notices
FROM (SELECT r, doc_id, sha256({whole("t")}) AS digest FROM rows) x LEFT JOIN known USING (digest) LEFT JOIN notes USING (r)"""
