from pathlib import Path

import pytest

from seamark.llm import licenses

TEXTS = Path("/usr/share/common-licenses")


def test_each_notice_is_found_inside_a_text(spark):
    notices = [(i, t) for i, t in licenses.KNOWN if "\n" not in t and len(t) < 100]
    rows = [(n, f"Some prose before.\n{t}\nAnd prose after.") for n, (_, t) in enumerate(notices)]
    got = {r.doc_id: (r.n_lines, r.line_licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {n: (1, i) for n, (i, _) in enumerate(notices)} and "CC0-1.0" in {i for _, i in got.values()}


def test_unlicense_text(spark):
    text = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>
"""
    rows = [(1, text), (2, text.upper().replace("\n", " ")), (3, text + "More.")]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Unlicense", 2: "Unlicense", 3: None}


@pytest.mark.skipif(not TEXTS.is_dir(), reason="needs the system's licence texts")
def test_whole_texts_of_the_system(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = {n: (TEXTS / n).read_text() for n in names if (TEXTS / n).is_file()}
    filled = texts["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Some One")
    rows = [*texts.items(), ("filled", filled)]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {n: names[n] for n in texts} | {"filled": "Apache-2.0"}
