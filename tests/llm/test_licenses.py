"""Licence lines and texts written here, apart from the table of known ones."""

import os

import pytest
from pyspark.sql import functions as F
from lineaspark.llm.license_scan import KNOWN, digest, known_digests, license_scan

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "All rights reserved.": "all-rights-reserved",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "Distributed under the Mozilla Public Licence, version 2.0": "MPL-2.0",
    "Unlicensed prose of no licence.": "",
}
BSD_2 = """BSD 2-Clause License

Copyright (c) 2021, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
SYSTEM = "/usr/share/common-licenses"


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license_scan(df, known_digests(spark)).collect()}


def test_planted_lines(spark):
    got = scan(spark, [f"Some words before.\n  {line}\nand after" for line in LINES])
    assert [got[i].notices for i in range(len(LINES))] == list(LINES.values())


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
# Stock wording, written as licences are found: what precedes the grant.
HEADS = (
    "MIT License\n\nCopyright (c) 2020 Some Body\n\n",
    "The MIT License\n\nCopyright (c) 2020 Some Body\n\n",
    "Copyright (c) 2020 Some Body\nAll rights reserved.\n\n",
    "Copyright OpenJS Foundation and other contributors\n\n",
    "Copyright The Foo Authors\n\n",
    "MIT License\n\nCopyright (c) 2020 A\n(c) B\n\n",
    "(The MIT License)\n\nCopyright: 2011 Some Body <some@body.org>\n\n",
    "© 2019 Some Body\n\n",
    "",
)


def test_forms_of_mit(spark):
    got = scan(spark, [head + MIT for head in HEADS] + [MIT.replace("COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE"), MIT + "More conditions.", "All rights reserved."])
    assert [got[i].license for i in range(len(HEADS) + 3)] == ["MIT"] * (len(HEADS) + 1) + [None, "all-rights-reserved"]


def test_released_under(spark):
    lines = ["This software is released under the MIT License.", "Copyright notice: see above", "Available under the Eclipse Public License 2.0"]
    got = scan(spark, lines)
    assert [got[i].notices for i in range(3)] == ["MIT", "", "EPL-2.0"]


def test_whole_texts(spark):
    got = scan(spark, [BSD_2, BSD_2.replace("All rights reserved.\n", ""), BSD_2 + "and more"])
    assert [got[i].license for i in range(3)] == ["BSD-2-Clause", "BSD-2-Clause", None]


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="no licence texts on this system")
def test_system_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    got = scan(spark, [" * " + open(f"{SYSTEM}/{x}").read().replace("\n", "\n * ") for x in names])
    assert [got[i].license for i in range(len(names))] == list(names.values())


def test_forms_of_one_text(spark):
    mit = KNOWN[1][1]
    isc = KNOWN[3][1]
    wrapped = mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS").replace("The above copyright notice", "The above\ncopyright notice")
    quoted = mit.replace('"Software"', "“Software”").replace('"AS IS"', "“AS IS”")
    dated = mit.replace("MIT License ", "MIT License\n\nCopyright (c) 2020 Some Body\n  Copyright 2021, Other\n© 2022 Third\n\n")
    spelled = mit.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    got = scan(spark, [wrapped, quoted, dated, spelled, "intro\n" + isc + "\noutro", mit + " x"])
    assert [got[i].license for i in range(6)] == ["MIT"] * 4 + [None, None]
    assert [got[i].notices for i in range(6)] == ["", "MIT", "MIT", "MIT", "ISC", ""]


def test_edges(spark):
    schema = "doc_id long, text string, digest string, license int, own string, line string"
    line = "x\nReleased under the MIT License.\nReleased under the MIT License.\nAll rights reserved."
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, line), (None, line), (4, line), (4, line), (5, "one long line " * 200_000)]
    df = spark.createDataFrame([(i, t, "d", 7, "o", "l") for i, t in rows], schema)
    more = spark.createDataFrame([(None, "none"), ("ab", None), ("ab", "AB")], "digest string, license string")
    known = known_digests(spark)
    twice = known.unionByName(known).unionByName(more)
    got = license_scan(df, twice).collect()
    assert sorted((str(r.doc_id), r.license, r.notices) for r in got) == sorted(
        [("1", None, ""), ("2", None, ""), ("3", None, ""), ("5", None, "")] + [("None", None, "MIT,all-rights-reserved")] * 2 + [("4", None, "MIT,all-rights-reserved")] * 2
    )
    assert license_scan(df.limit(0), known).count() == 0


def test_many_known(spark):
    """A table of known texts has no bound."""
    many = spark.range(5000).selectExpr("concat('L', id) AS license", "concat('notice number ', id, ' of many') AS text")
    known = many.select(digest(F.col("text")).alias("digest"), "license")
    df = spark.createDataFrame([(1, "a\nNotice number 4,321 of many"), (2, "notice   number 17 OF many!")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.notices) for r in license_scan(df, known.union(known)).collect()}
    assert got == {1: (None, ""), 2: ("L17", "L17")}
