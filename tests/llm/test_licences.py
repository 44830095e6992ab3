import textwrap
from importlib.resources import files

from gatemeter.llm.licences import KNOWN, _ISC, digests, query, scan

DDL = "doc_id bigint, text string"
MIT = dict(reversed(KNOWN))["MIT"]


def test_variants_of_one_licence_match(spark):
    body = next(t for n, t in KNOWN if n == "MIT")
    rows = [
        (1, body), (2, "Copyright (c) 2020 Some Body\n\n" + body), (3, body.upper()), (4, body.replace('"', "“").replace(" and ", "  and\n")), (5, "MIT Licence\n\n(c) 1999 X\nAll rights reserved.\n" + body),
        (6, body + " And more."), (7, None), (8, ""), (9, "Copyright 2001 A"), (10, "Released under the MIT licence"), (11, body.replace("\n", "\r\n")), (1, body), (None, body),
        (12, _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")), (13, body.replace("NONINFRINGEMENT", "non-infringement")), (14, "x " * 300_000),
    ]
    got = query(spark.createDataFrame(rows, DDL)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["licence"], r["digest"]) for r in got}
    assert all(by[k][0] == "MIT" for k in (1, 2, 3, 4, 5, 11, 13, None))
    assert by[6][0] is None and by[6][1] and by[7] == by[8] == by[9] == (None, None)
    assert by[10][0] == "MIT-notice" and by[12][0] == "ISC" and by[14][0] is None


def test_line_breaks_do_not_matter(spark):
    heads = ["", "Copyright (c) 2020 A B. All rights reserved.\n\n", "Copyright Joyent, Inc. and others\nCopyright Foo\n\n", "(c) A B\nAll rights reserved.\n\n", "/* (C) 1999 X */\n"]
    rows, want = [], []
    for name, text in [k for k in KNOWN if len(k[1]) < 3000]:
        for width in (30, 41, 55, 60, 64, 70, 72, 76, 79, 80, 100):
            body = "\n".join("\n".join(textwrap.wrap(line, width)) for line in text.split("\n"))
            rows += [(len(rows) + i, head + body) for i, head in enumerate(heads)]
            want += [name] * len(heads)
    rows += [(len(rows), "terms\n\n(c) You must retain the notices of the work in all copies that you make or\ngive away; all"), (len(rows) + 1, "terms\n\n(c) You must retain the notices of the work\nin all copies that you make or give away; all")]
    got = {r["doc_id"]: r for r in query(spark.createDataFrame(rows, DDL)).collect()}
    assert [got[i]["licence"] for i in range(len(want))] == want
    assert got[len(want)]["digest"] == got[len(want) + 1]["digest"]


def test_whole_licences_match(spark):
    folder = files("gatemeter.llm").joinpath("licence_texts")
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in folder.iterdir()}
    assert texts.keys() >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"}
    rows = [(n, t) for n, t in texts.items()] + [(n, t.replace("\n", "\r\n").replace("  ", " ")) for n, t in texts.items()]
    bsd = texts["BSD-3-Clause"]
    for k in "123":
        bsd = bsd.replace("    * ", f"{k}. ", 1)
    rows += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2024, A B\nAll rights reserved.\n\n" + bsd), ("BSD-2-Clause", "Copyright 2001 A\n\n" + texts["BSD-2-Clause"])]
    rows += [("Apache-2.0", texts["Apache-2.0"].split("   APPENDIX")[0]), ("GPL-2.0", texts["GPL-2.0"].split("How to Apply These Terms to Your")[0].rpartition("END OF")[0])]
    got = {r["doc_id"]: r["licence"] for r in query(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], DDL)).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_own_table_and_ties(spark):
    own = digests(spark.createDataFrame([("b", "Some terms."), ("a", "some TERMS"), ("c", None)], "licence string, text string"))
    docs = spark.createDataFrame([(1, "some terms", "x")], DDL + ", licence string")
    assert [tuple(r) for r in scan(docs, own).select("doc_id", "licence").collect()] == [(1, "a")]


def test_empty_table(spark):
    assert query(spark.createDataFrame([], DDL)).count() == 0
