import hashlib
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seamark.llm import token_alignment as ta

FILES = f"{ta.FOLDER}/{ta.BYTE_BPE}", f"{ta.FOLDER}/{ta.PIECE_BPE}"
ODD = [None, "", " ", "a", "a ", " a", "a  b", "a \n b", "a \n b", "a  b", "tab\there\r\nand  there", "it's <|endoftext|> <s> <0x41>", "nul\x00x", "mixed ▁ mark", "a▁b c", "日本語 テキスト", "　wide", "é é ﬁ ", "\n\n", "\n lead", "trail \n ", "x\x1c y", "emoji 😀 😀‍👩", "word " * 300, "nospace" * 400, "don't we're  I'll", "12 345,67 a1b2"]


@pytest.fixture(scope="module")
def both():
    return ta.Models(open(FILES[0], encoding="utf-8").read(), open(FILES[1], "rb").read())


def brute(docs, m):
    """Whole texts, token by token."""
    back = ta.byte_of_letter()
    vocabulary = {i: t for t, i in m.a.get_vocab().items()}
    aligned = []
    for doc_id, text in docs:
        groups, links = [], []
        if text:
            a, b = m.a.encode(" " + text, add_special_tokens=False).ids, m.b.encode(text)
            of_a = [bytes(back[c] for c in vocabulary[i]) for i in a]
            of_b = [bytes([int(m.b.id_to_piece(i)[3:5], 16)]) if m.b.is_byte(i) else m.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(of_a) == (" " + text).encode() == b"".join(of_b):
                i = j = at_a = at_b = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        ga.append(a[i])
                        at_a += len(of_a[i])
                        i += 1
                    else:
                        gb.append(b[j])
                        at_b += len(of_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((ga, gb))
                        links.append((ga[-1], gb[-1]))
                        ga, gb = [], []
        aligned.append((doc_id, groups, links))
    count = Counter(x for *_, links in aligned for x in links)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for doc_id, groups, links in aligned:
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        n = sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links)
        out.append((doc_id, *n, sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_segments_are_the_text(both):
    assert both.split
    for text in filter(None, ODD):
        parts = [s for part in ta.segments(text, True) for s in part]
        assert "".join(parts) == " " + text and all(s[0] == " " for s in parts)
        whole = next(both.encode([" " + text]))
        by_part = list(both.encode(parts))
        assert [i for a, _ in by_part for i in a] == whole[0] and [i for _, b in by_part for i in b] == whole[1], text


def test_equals_brute_force_on_odd_rows(spark, both, monkeypatch):
    docs = [*enumerate(ODD), (None, "a null id"), (3, "a"), (3, "a"), (50, "common  words again " * 30 + "▁")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"chunk": F.lit(1), "segment": F.lit("x"), "n": F.lit(2), "groups": F.lit("")})
    assert rows(ta.align(df)) == brute(docs, both)


def test_equals_brute_force_on_documents(spark, both):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(ta.align(df)) == brute([(r.doc_id, r.text) for r in df.collect()], both)


def test_long_texts_in_parts(both, monkeypatch):
    text = "some words, a\nbreak  and more " * 200 + "\n  "
    want = [s for part in ta.segments(text, True) for s in part]
    monkeypatch.setattr(ta, "AT_ONCE", 50)
    parts = list(ta.segments(text, True))
    assert len(parts) > 10 and [s for part in parts for s in part] == want


def test_vocabulary_that_reaches_over_spaces(both):
    plain = {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}
    assert ta.separable(plain, [b" a", b"  ", "  ".encode()], [b"b"])
    for a, b, p in (([b"a b"], [b"b"], plain), ([b"a"], [b"in the"], plain), ([b"\xa0 "], [b"b"], plain), ([b"a"], [b"b"], None), ([b"a"], [b"b"], plain | {"use_regex": False})):
        assert not ta.separable(p, a, b)
    assert list(ta.segments("a b", False)) == [[" a b"]]


def test_files_are_a_parameter_and_empty_table(spark, tmp_path):
    a, b = (shutil.copy(f, tmp_path) for f in FILES)
    assert ta.align(spark.createDataFrame([], "doc_id long, text string"), a, b).collect() == []


def test_segments_of_many_chunks(spark, both, monkeypatch):
    monkeypatch.setattr(ta, "PLACES", 3)
    docs = [(i, f"the same words {i % 5} in all of them, and ▁" if i % 10 == 9 else f"the same words {i % 5} in all of them") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(20)
    assert rows(ta.align(df)) == brute(docs, both)
