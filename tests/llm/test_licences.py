import textwrap

import duckdb
import pytest

from stagecraft.llm import licences
from stagecraft.llm.queries.licences import SCAN_SQL, canonical_sql

MIT_BODY = licences.KNOWN["MIT"]
ISC_AS_PUBLISHED = """ISC License

Copyright (c) 2004-2010 by Some Consortium, Inc. ("SC")
Copyright (c) 1995-2003 by Some Software Consortium

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND SC DISCLAIMS ALL WARRANTIES WITH REGARD
TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL SC BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.
"""


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as licence", "1 as id")
    return [r.licence for r in sorted(licences.scan(df, licences.known_licences(spark)).collect())]


def wrapped(text, width, lead=""):
    """Paragraphs wrapped anew, but for those with a notice of their own."""
    out = []
    for part in text.split("\n\n"):
        notice = any(line.strip().lower().startswith(("copyright (c)", "copyright [")) for line in part.splitlines())
        lines = part.splitlines() if notice else textwrap.wrap(" ".join(part.split()), width, break_long_words=False, break_on_hyphens=False)
        out += [lead + line for line in lines] + [lead.rstrip()]
    return "\n".join(out)


@pytest.mark.parametrize("name", sorted(licences.KNOWN))
def test_whole_licences_are_found_in_other_dress(spark, name):
    text = licences.KNOWN[name]
    dressed = ["Copyright (c) 2020 Somebody\nAll rights reserved.\n\n" + text,
               "© 1999 X\n" + text.replace(" ", "  ").replace(",", " ,").replace("acknowledgment", "acknowledgement"),
               text + " More words.", text[: len(text) // 2]]
    assert scan(spark, dressed) == [name] * 2 + [None] * 2


def test_wrapping_does_not_matter(spark):
    given = [(name, wrapped(text, width, lead)) for name, text in sorted(licences.KNOWN.items())
             for width, lead in [(40, ""), (57, "// "), (66, " * "), (72, ""), (76, "# "), (79, ""), (100, "   "), (10_000, "")]]
    assert scan(spark, [text for _, text in given]) == [name for name, _ in given]


def test_every_line_break_before_copyright_is_harmless(spark):
    given = [(name, " ".join(part.split()).replace("copyright", "\ncopyright").replace("COPYRIGHT", "\nCOPYRIGHT"))
             for name, part in sorted(licences.KNOWN.items()) if "copyright (c)" not in part.lower() and "copyright [" not in part.lower()]
    assert len(given) > 8 and scan(spark, [text for _, text in given]) == [name for name, _ in given]


def test_published_files(spark):
    bsd = licences.KNOWN["BSD-3-Clause"]
    given = {
        "MIT License\n\nCopyright (c) 2019 A B\n\n" + wrapped(MIT_BODY, 77): "MIT",
        "The MIT License (MIT)\r\n=====\r\n\r\nCopyright 2011-2020 A and B.\r\n\r\n" + wrapped(MIT_BODY, 70).replace("\n", "\r\n"): "MIT",
        "Copyright Somebody, Inc. and other contributors. All rights reserved.\n" + MIT_BODY.replace("AUTHORS OR COPYRIGHT\nHOLDERS", "X"): "MIT",
        ISC_AS_PUBLISHED: "ISC",
        "BSD 3-Clause License\n\n(c) 2020, A\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "): "BSD-3-Clause",
        bsd.replace("the copyright holder nor", "the University of X nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS"): "BSD-3-Clause",
        licences.KNOWN["Apache-2.0"].split("APPENDIX")[0]: "Apache-2.0",
        licences.KNOWN["Zlib"].replace("1. ", "  a) ") + "\n": "Zlib",
        "MIT License": None, "Copyright (c) 2019 A B": None,
        MIT_BODY.replace("free of charge", "for a charge"): None,
        bsd.replace("this list of conditions", "all of it"): None,
    }
    assert scan(spark, list(given)) == list(given.values())


def test_odd_rows(spark, odd_documents, no_documents):
    known = licences.known_licences(spark)
    got = licences.scan(odd_documents, known)
    assert got.count() == odd_documents.count() and got.where("licence is not null").count() == 0
    assert licences.scan(no_documents, known).count() == 0
    assert scan(spark, [None, "", "...", "licence"]) == [None] * 4


def test_spelling_is_by_whole_words(spark):
    df = spark.createDataFrame([("Licence, LICENSE; licences",)], "t string")
    assert df.select(licences.canonical(df.t)).first()[0] == "license license licences"


def test_notices_go_and_body_lines_stay(spark):
    text = "// Copyright 2020 A\n© B\n(c) 1999 C\n(c) you must\ncopyright notice\n * copyright\nCopyright Holder Inc 1\nCopyright The D\nAll rights reserved.\nall rights reserved by law"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(licences.canonical(df.t)).first()[0] == "c you must copyright notice copyright copyright holder inc 1 all rights reserved by law"


def test_the_sql_gives_the_same_rows_on_licences(spark):
    texts = [*licences.KNOWN.values(), ISC_AS_PUBLISHED, None, "", *(wrapped(t, 60, "# ") for t in licences.KNOWN.values())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in licences.scan(df, licences.known_licences(spark)).select("id", "canonical_sha256", "licence").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    assert con.execute(f"SELECT {canonical_sql()} FROM documents WHERE doc_id = 0").fetchone()[0]
    assert sorted(con.execute(SCAN_SQL).fetchall()) == got
