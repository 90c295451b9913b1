"""Column functions on statements and guards: normal forms that later joins compare. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Transforms from the mildest to the hardest (fixed values).
TRANSFORMS = ("identity", "derived", "conditional", "aggregated")
SHAPE_LEAST, FRAGMENT_LEAST = 24, 8


def transform_rank(transform: Column) -> Column:
    """0 for identity to 3 for aggregated; null for anything else."""
    at = F.array_position(F.array(*map(F.lit, TRANSFORMS)), transform)
    return F.when(at > 0, at.cast("int") - 1)


def transform_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, TRANSFORMS)), rank)


def normal_guard(guard: Column) -> Column:
    """A guard in upper case: its AND parts once each and sorted, sides of equalities in order, NOT (x = y) as x <> y.

    Only an AND outside of parentheses parts a guard; a part with more than one comparison is left as it stands. Null stays null.
    """
    text = F.trim(F.regexp_replace(F.upper(guard), r"\s+", " "))

    def joined(acc, piece):
        last = F.element_at(acc, -1)
        open_ = (F.size(acc) > 0) & (F.length(F.regexp_replace(last, r"[^(]", "")) > F.length(F.regexp_replace(last, r"[^)]", "")))
        return F.when(open_, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat(last, F.lit(" AND "), piece))).otherwise(F.array_append(acc, piece))

    parts = F.aggregate(F.split(text, r" AND ", -1), F.array().cast("array<string>"), joined)

    def part(p: Column) -> Column:
        p = F.regexp_replace(F.trim(p), r"^NOT \(([^()=<>!]+?) ?= ?([^()=<>!]+?)\)$", "$1 <> $2")
        sides = F.split(p, r"\s*(?:<>|=)\s*", -1)
        mark = F.when(F.contains(p, F.lit("<>")), " <> ").otherwise(" = ")
        plain = (F.size(sides) == 2) & ~p.rlike("[<>!]=|<[^>]|[^<]>")
        ordered = F.array_sort(F.transform(sides, lambda x: F.trim(x)))
        return F.when(plain, F.concat(ordered[0], mark, ordered[1])).otherwise(p)

    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(parts, part), lambda p: p != ""))), " AND ")


def statement_shape(sql: Column) -> Column:
    """A statement without comments, with literals and numbers as ?, in upper case and single spaces; null if it is short."""
    text = F.when(F.contains(sql, F.lit("--")) | F.contains(sql, F.lit("/*")), F.regexp_replace(sql, r"(?s)/\*.*?\*/|--[^\n]*", " ")).otherwise(sql)
    text = F.regexp_replace(text, r"(?=['0-9])(?:'(?:[^']++|'')*'|\b\d+(?:\.\d+)?\b)", "?")
    # A space that is alone is no match, so that most of a text is only read.
    text = F.trim(F.regexp_replace(F.upper(text), r" [\s;]+|[;\t\n\x0B\f\r][\s;]*", " "))
    return F.get(F.filter(F.array(text), lambda x: F.char_length(x) >= SHAPE_LEAST), 0)  # when() would make the text twice


def literal_fragments(sql: Column) -> Column:
    """The quoted strings in upper case and single spaces, of eight characters at least, once each, the longest first.

    A doubled quote inside a string is a quote. Strings of equal length go by their text.
    """
    every = F.regexp_extract_all(sql, F.lit(r"'((?:[^']+|'')*+)'"), F.lit(1))
    plain = F.transform(every, lambda x: F.upper(F.trim(F.regexp_replace(F.replace(x, F.lit("''"), F.lit("'")), r"\s+", " "))))
    long = F.array_distinct(F.filter(plain, lambda x: F.char_length(x) >= FRAGMENT_LEAST))
    return F.transform(F.array_sort(F.transform(long, lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


def snippet(text: Column, line: Column, most: int = 200) -> Column:
    """The statement that begins at a line (from 1) of a text, to the line that ends in a semicolon, at most so many lines."""
    rest = F.slice(F.split(text, r"\r?\n", -1), line, F.greatest(F.size(F.split(text, r"\r?\n", -1)), F.lit(1)))
    end = F.array_position(F.transform(rest, lambda x: F.rtrim(x).endswith(";")), True).cast("int")
    taken = F.when(end > 0, F.slice(rest, F.lit(1), end)).otherwise(rest)
    over = F.size(taken) - most
    lines = F.when(over > 0, F.concat(F.slice(taken, 1, most), F.array(F.format_string("-- ... %d more lines of this statement", over)))).otherwise(taken)
    return F.when((line >= 1) & (text != ""), F.array_join(lines, "\n"))


def mention_lines(text: Column, line: Column, names: Column) -> Column:
    """Numbers of the lines of the statement that begins at a line which name one of the names, outside of comments, in any case."""
    word = F.concat(F.lit(r'(?i)(?<![\w$])"?('), F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|"), F.lit(r')"?(?![\w$])'))
    code = F.transform(F.split(snippet(text, line, 1 << 30), "\n", -1), lambda x, i: F.struct((line + i).alias("at"), F.regexp_replace(x, "--.*", "").alias("x")))
    found = F.transform(F.filter(code, lambda c: F.regexp_like(c["x"], word)), lambda c: c["at"])
    return F.when(F.size(names) > 0, found)
