from pyspark.sql import functions as F

from seamark.llm import licenses, registry

SMALL = "/root/testdata/sf0.01"


def test_whole_texts_and_lines(spark):
    mit = dict(licenses.KNOWN[::-1])["MIT"]
    varied = "MIT Licence\n\nCopyright (c) 2021 Some One <x@example.org>\n\n" + mit.replace(". ", ".\n  ").replace("sublicense", "sub-license").upper() + "\n\n"
    rows = [(1, varied), (2, mit + " and more"), (3, "prose\nReleased under the MIT Licence!\nmore\nlicensed under CC BY-NC 4.0\nno licence here"), (4, None), (4, ""), (None, "Released under the MIT License."), (5, "word " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license_id": F.lit("clash"), "digest": F.lit(1)})
    got = sorted(map(repr, ((r.doc_id, r.license_id, r.n_lines, r.line_licenses) for r in licenses.scan(df).collect())))
    want = [(1, "MIT", 0, ""), (2, None, 0, ""), (3, None, 2, "CC-BY-NC-4.0,MIT"), (4, None, 0, ""), (4, None, 0, ""), (None, "MIT", 1, "MIT"), (5, None, 0, "")]
    assert got == sorted(map(repr, want))
    assert licenses.scan(df.limit(0)).count() == 0


def test_query(spark):
    notices = {text: i for i, text in licenses.KNOWN if "\n" not in text and len(text) < 100}
    got = {r.doc_id: (r.n_lines, r.line_licenses) for r in registry.op4_license_scan(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    for d in docs:
        found = [notices[x] for x in d.text.split("\n") if x in notices]
        assert got[d.doc_id] == (len(found), ",".join(sorted(set(found))))
    assert sum(n for n, _ in got.values()) > 5


def test_edges(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "word " * 600_000), (3, "Released under the MIT License.\nx\nreleased UNDER the mit licence\nSPDX-License-Identifier: Apache-2.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("digest", "lines", "license_id", "known_digest")})
    got = licenses.scan(df).collect()
    assert [(r.doc_id, r.license_id, r.n_lines, r.line_licenses) for r in got] == [(1, None, 0, ""), (1, None, 0, ""), (None, None, 0, ""), (2, None, 0, ""), (3, None, 3, "Apache-2.0,MIT")]
    assert licenses.scan(df.limit(0)).count() == 0
