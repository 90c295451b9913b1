"""Alignment of two tokenizers' tokens, with each distinct segment of text tokenised once.

A text, behind a space, is encoded by a byte-level BPE (A) and by a sentencepiece BPE with byte fallback (B). Where tokens of both
end at the same byte, they are cut into groups, and the two tokens that end there are linked. What a link is worth depends on
the corpus: how often its pair of ids is linked, and whether no other A id is linked to its B id more often.

Texts are split before each run of white space that begins with a space and follows something else (never within the white space
that ends a text). `separable` verifies from the two vocabularies that no token reaches over such a place, and from A's settings
that its words don't either; then the tokens of a text are those of its segments one after another. Otherwise a text is
one segment, which is slower and gives the same.

Texts are packed into chunks of a bounded size, and only what a chunk holds of distinct segments, numbered as they come and with
counts, leaves it. Equal segments meet in the order of their text, are tokenised and aligned once, and keep the chunks and numbers
they came from. Their links are exploded, counted with the segments' counts, and summed again by segment. Then each chunk is
sent its segments' alignments, packed, numbers its segments again and composes its documents.

A text that is null or empty, or that either tokenizer doesn't give back byte by byte, has no tokens: its numbers are 0, its digest
is empty, and it adds to no count. Repeated rows and ids count each and get a row each. Texts are read whole; a chunk holds one
text at least, however long. Ties for the highest count are all highest. Further columns change nothing; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import cut

FOLDER, BYTE_BPE, PIECE_BPE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a chunk's texts, and of a part of a text that is split at once.
CHUNK, AT_ONCE = 12_000_000, 1 << 20
#: Segments that are tokenised at once, places of a segment in one row, and rows that are packed for the chunks at once.
SEGMENTS, PLACES, ROWS = 10_000, 4096, 500_000
#: Leading white space, what follows up to the next space, and the white space that ends the text.
SEGMENT = re.compile(r"\s*+\S++(?:[^\S ]\s*+\S*+)*+(?:\s++\Z)?|\s++")
#: A place where a text may be split, with more than white space behind it.
PLACE = re.compile(r"(?<=\S) (?=\s*\S)")

#: What is summed for a document.
NUMBERS = ["n_a", "n_b", "n_best", "count_sum"]

_models: dict[str, Models] = {}
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))


class Models:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.a = tokenizers.Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        back = byte_of_letter()
        spelt = lambda token: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.a_bytes = [spelt(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.split = separable(json.loads(byte_bpe)["pre_tokenizer"], self.a_bytes, self.b_bytes)

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """A's and B's ids of texts that each begin with a space; B puts one in front itself."""
        of_a = self.a.encode_batch_fast(segments, add_special_tokens=False)
        of_b = self.b.encode([s[1:] for s in segments], num_threads=1)
        return zip((e.ids for e in of_a), of_b, strict=True)


def byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes bytes as letters: printable Latin-1 as itself, the other bytes in turn as the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def separable(pre_tokenizer: dict | None, a_bytes: list[bytes], b_bytes: list[bytes]) -> bool:
    """Whether no token has a space behind anything but white space, and A splits words before white space."""

    def reaches(token: bytes) -> bool:
        for i in range(1, len(token)):
            if token[i] == 0x20 and token[i - 1] != 0x20:
                before = token[:i].decode(errors="ignore")
                if not before or not before[-1].isspace() or not token[:i].endswith(before[-1].encode()):
                    return True
        return False

    p = pre_tokenizer or {}
    plain = p.get("type") == "ByteLevel" and p.get("use_regex") and not p.get("add_prefix_space")
    return bool(plain) and not any(map(reaches, a_bytes)) and not any(map(reaches, b_bytes))


def models(shared) -> Models:
    """The tokenizers of a broadcast pair of files, once for each Python worker."""
    key = hashlib.sha256(shared.value[0].encode() + shared.value[1]).hexdigest()
    if key not in _models:
        _models[key] = Models(*shared.value)
    return _models[key]


def segments(text: str, split: bool) -> Iterator[list[str]]:
    """The segments of a space and the text, in order, in lists."""
    text = " " + text
    if not split:
        yield [text]
        return
    a = 0
    while len(text) - a > AT_ONCE and (place := PLACE.search(text, a + AT_ONCE)):
        yield SEGMENT.findall(text[a : place.start()])
        a = place.start()
    yield SEGMENT.findall(text[a:])


def aligned(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[str, list[int]]:
    """The groups as text, and for each the last id of A and of B, which are linked, as one number. Both spell the same bytes."""
    said, links, i, j, last_b, end_a, end_b = [], [], 0, 0, -1, 0, 0
    for m, token in enumerate(a):
        end_a += len(a_bytes[token])
        while end_b < end_a:
            last_b += 1
            end_b += len(b_bytes[b[last_b]])
        if end_a == end_b:
            said.append(f"{','.join(map(str, a[i : m + 1]))}|{','.join(map(str, b[j : last_b + 1]))}")
            links.append(token << 32 | b[last_b])
            i, j = m + 1, last_b + 1
    return ";".join(said), links


def _blob(**columns) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of documents, each compressed into one row."""
    part, no = TaskContext.get().partitionId() << 16, 0
    ids, texts, size = [], [], 0

    def told() -> pd.DataFrame:
        return pd.DataFrame({"chunk": [part + no], "docs": [_blob(doc_id=pa.array(ids, pa.int64()), text=pa.array(texts, pa.large_string()))]})

    for batch in batches:
        for i, t in zip(batch["doc_id"], batch["text"], strict=True):
            ids.append(None if pd.isna(i) else int(i))
            texts.append(t or "")
            size += len(texts[-1]) + 16
            if size >= CHUNK:
                yield told()
                no, ids, texts, size = no + 1, [], [], 0
    if ids:
        yield told()


def _numbered(packed: bytes, split: bool) -> Iterator[tuple[int | None, Iterator[np.ndarray], dict[str, int]]]:
    """Each document of a chunk: its id and the numbers of its segments, in parts; and the numbers given so far, as segments come."""
    number: dict[str, int] = defaultdict(count().__next__)
    docs = _table(packed)
    for doc_id, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        yield doc_id, (np.fromiter((number[s] for s in part), np.int64, len(part)) for part in (segments(text, split) if text else ())), number


def _held(shared):
    """chunks(chunk, docs) -> (segment, place, n): distinct segments of each chunk; a place is the chunk and the segment's number there."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = models(shared).split
        for batch in batches:
            for chunk, packed in zip(batch["chunk"], batch["docs"], strict=True):
                total, number = np.zeros(0, dtype=np.int64), {}
                for _, parts, number in _numbered(packed, split):
                    for at in parts:
                        if len(number) > len(total):
                            total = np.concatenate((total, np.zeros(2 * len(number) - len(total), dtype=np.int64)))
                        np.add.at(total, at, 1)
                yield pd.DataFrame({"segment": list(number), "place": (chunk << 32) + np.arange(len(number)), "n": total[: len(number)]})

    return each


def _dictionary(shared):
    """(segment, place, n), equal segments one after another -> a row for each segment, tokenised and aligned, with its places.

    Of more than PLACES places, the rest come in rows of their own, which have no count and no links.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, task, no = models(shared), TaskContext.get().partitionId() << 40, 0
        last, known = None, None
        for batch in batches:
            found = batch["segment"].to_numpy(dtype=object)
            starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
            ends = np.append(starts[1:], len(found))
            sums = np.add.reduceat(batch["n"].to_numpy(), starts)
            places = batch["place"].to_numpy()
            names = found[starts].tolist()
            fresh = names[1:] if names[0] == last else names
            rows = [known] if names[0] == last else []
            for s, (a, b) in zip(fresh, m.encode(fresh), strict=True):
                want = s.encode()
                fine = b"".join([m.a_bytes[i] for i in a]) == want == b"".join([m.b_bytes[i] for i in b])
                rows.append((len(a), len(b), *aligned(a, b, m.a_bytes, m.b_bytes)) if fine else (0, 0, "", []))
            out = []
            for name, known, i, j, n in zip(names, rows, starts, ends, sums, strict=True):
                first = name != last
                no, last = no + first, name
                for k in range(i, j, PLACES):
                    out.append((task + no, name, int(n) if k == i else 0, bool(known[2]), known[0], known[1], known[2], known[3] if first and k == i else [], places[k : min(k + PLACES, j)]))
            yield pd.DataFrame(out, columns=["id", "segment", "n", "ok", "n_a", "n_b", "groups", "links", "places"])

    return each


def link_counts(known: DataFrame) -> DataFrame:
    """known(n, links) -> (link, count, best): how often each pair of ids is linked, and whether that is the highest count of its B id."""
    counts = cut(known.filter("n > 0").select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("count")), "alignment-counts")
    b = F.col("link").bitwiseAND((1 << 32) - 1)
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(highest, "b").select("link", "count", (F.col("count") == F.col("highest")).alias("best"))


def _by_chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Alignments with their places -> (chunk, told): for each chunk and so many rows, what its segments need, packed."""

    def packed(rows: list[pd.DataFrame]) -> pd.DataFrame:
        df = pd.concat(rows, ignore_index=True)
        place, of = np.concatenate(df["places"].to_list()), np.repeat(np.arange(len(df)), df["places"].map(len))
        at = np.argsort(place)
        chunk, number, of = place[at] >> 32, place[at] & 0xFFFFFFFF, of[at]
        groups = pa.array(df["groups"], pa.large_string())
        numbers = {c: df[c].to_numpy(dtype=np.int64) for c in NUMBERS}
        out = []
        for i, j in itertools.pairwise([*np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))), len(chunk)]):
            own = of[i:j]
            out.append((chunk[i], _blob(number=pa.array(number[i:j]), groups=groups.take(pa.array(own)), **{c: pa.array(v[own]) for c, v in numbers.items()})))
        return pd.DataFrame(out, columns=["chunk", "told"])

    rows, size = [], 0
    for batch in batches:
        rows.append(batch)
        size += int(batch["places"].map(len).sum())
        if size >= ROWS:
            yield packed(rows)
            rows, size = [], 0
    if size:
        yield packed(rows)


def align(docs: DataFrame, byte_bpe: str = f"{FOLDER}/{BYTE_BPE}", piece_bpe: str = f"{FOLDER}/{PIECE_BPE}") -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    byte_bpe, piece_bpe: the tokenizers' files, which the driver reads and sends to the tasks.
    """
    with open(byte_bpe, encoding="utf-8") as f, open(piece_bpe, "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # two files, whatever the input
    chunks = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_packed, "chunk long, docs binary"), "alignment-chunks", "none")
    found = chunks.mapInPandas(_held(shared), "segment string, place long, n long").repartition("segment").sortWithinPartitions("segment")
    schema = "id long, segment string, n long, ok boolean, n_a long, n_b long, groups string, links array<long>, places array<long>"
    known = cut(found.mapInPandas(_dictionary(shared), schema), "alignment-dictionary", "zstd")

    def without_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the documents hold that have one of the chunk's segments `bad`."""
        split = models(shared).split
        for batch in batches:
            for packed, bad in zip(batch["docs"], batch["bad"], strict=True):
                less, number = Counter(), {}
                for _, parts, number in _numbered(packed, split):
                    at = np.concatenate([*parts, np.zeros(0, dtype=np.int64)])
                    if np.isin(at, bad).any():
                        less.update(at.tolist())
                names = list(number)
                yield pd.DataFrame({"segment": [names[i] for i in less], "less": np.fromiter(less.values(), np.int64, len(less))})

    # A chunk's segments that don't come back: no more than the chunk holds.
    places = known.filter("NOT ok").select(F.explode("places").alias("place"))
    bad = places.groupBy(F.shiftright("place", 32).alias("chunk")).agg(F.collect_list(F.col("place").bitwiseAND((1 << 32) - 1)).alias("bad"))
    less = chunks.join(bad, "chunk").select("docs", "bad").mapInPandas(without_tokens, "segment string, less long").groupBy("segment").agg(F.sum("less").alias("less"))
    # Counts are at a segment's first rows, links at its very first: sums by id bring them together where there are several.
    fine = known.filter("ok")
    several = fine.filter("size(links) = 0").groupBy("id").agg(F.sum("n").alias("more"))
    counted = fine.filter("size(links) > 0").select("id", "segment", "n", "links").join(several, "id", "left").join(cut(less, "alignment-less"), "segment", "left")
    counted = counted.select("id", (F.col("n") + F.coalesce("more", F.lit(0)) - F.coalesce("less", F.lit(0))).alias("n"), "links")
    links = fine.select("id", F.explode("links").alias("link"))
    worth = links.join(link_counts(counted), "link").groupBy("id").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    told = known.select("id", "places", "groups", "n_a", "n_b").join(worth, "id", "left").fillna(0, ["n_best", "count_sum"])
    told = told.select("places", "groups", *NUMBERS).mapInPandas(_by_chunk, "chunk long, told binary")

    def composed(chunk: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        split = models(shared).split
        tables = [_table(t) for t in told["told"]]
        column = lambda c, kind: np.concatenate([np.asarray(t[c], dtype=kind) for t in tables]) if tables else np.zeros(0, dtype=kind)
        order = np.argsort(column("number", np.int64))
        numbers = np.stack([column(c, np.int64)[order] for c in NUMBERS], axis=1)
        said = column("groups", object)[order]
        del tables
        out = []
        for packed in chunk["docs"]:
            for doc_id, parts, _ in _numbered(packed, split):
                total, n_groups, digest, fine, n = np.zeros(len(NUMBERS), dtype=np.int64), 0, hashlib.sha256(), False, 0
                for n, at in enumerate(parts):
                    groups = said[at]
                    fine = all(groups) and (fine or n == 0)
                    total += numbers[at].sum(axis=0)
                    whole = ";" * (n > 0) + ";".join(groups)
                    n_groups += whole.count("|")
                    digest.update(whole.encode())
                out.append((doc_id, *(total if fine else [0] * len(NUMBERS)), n_groups if fine else 0, digest.hexdigest() if fine else ""))
        df = pd.DataFrame(out, columns=["doc_id", *NUMBERS, "n_groups", "groups_sha256"]).astype({"doc_id": "Int64"})
        return df.assign(n_links=df["n_groups"])[["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]]

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(composed, schema)
