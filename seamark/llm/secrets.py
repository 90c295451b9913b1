"""Secret scans through a trigram index.

From each rule's regular expression comes a Boolean query over trigrams that any match must contain. The index has a posting
for each trigram of some query and each document that holds it; postings are intersected and united as the query says, and only
the candidates are matched against the rule. A rule without mandatory trigrams scans every text.

A document's postings all come from its own row, so they are intersected there, as flags beside the text: grouping them by
document would give the same candidates after sending the texts, or their ids, through an exchange. Texts are lower-cased once.

Spans are code point offsets into the text, end exclusive. Null text is the empty text. Rows are judged one by one: repeated
and null ids and repeated rows give a result each, and further columns change nothing. Of spans that begin at one place, the
earlier rule's comes first. Texts are read whole, however long. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from functools import reduce
from operator import and_, or_
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import held, unwrapped, whole, wrapped

#: Rules (fixed values): kind, expression, whether letters match in either case, group and its least length.
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", False, 0, 18),
    ("hex", r"[0-9a-f]+", False, 0, 16),
)
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 36),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", False, 0, 39),
    ("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", False, 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 0, 27),
)
RULES = (*BASE_RULES, *MORE_RULES)
#: Sets of exact strings larger than this are no longer multiplied out.
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that must all hold; a clause holds if all trigrams of one of its alternatives occur. In lower case.

    Walks Python's parse of the pattern and keeps the set of strings that the part read so far ends in exactly; where a part
    can't be listed (a repeat, a class), the strings kept so far give a clause and the walk starts afresh.
    """
    clauses: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if grams and all(grams):
            # An alternative that asks for more than another one adds nothing.
            clauses.append(sorted((a for a in grams if not any(b < a for b in grams)), key=sorted))

    def listed(items) -> set[str] | None:
        """All strings that the items match, or None."""
        out = {""}
        for kind, arg in items:
            if kind is op.LITERAL:
                more = {chr(arg).lower()}
            elif kind is op.SUBPATTERN:
                more = listed(arg[3])
            elif kind is op.BRANCH:
                each = [listed(x) for x in arg[1]]
                more = None if None in each else set().union(*each)
            elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
                more = {chr(c).lower() for _, c in arg}
            elif kind is op.MAX_REPEAT and arg[1] != op.MAXREPEAT and arg[1] <= 2 and (one := listed(arg[2])) is not None:
                more = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(one, repeat=n)}
            else:
                more = None
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a, b in itertools.product(out, more)}
        return out

    kept = {""}
    for item in parser.parse(pattern):
        more = listed([item])
        if more is None or len(kept) * len(more) > MOST_STRINGS:
            flush(kept)
            kept = more or {""}
        else:
            kept = {a + b for a, b in itertools.product(kept, more)}
    flush(kept)
    return clauses


def postings(df: DataFrame, low: str, trigrams: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """df with a flag for each trigram, whether column low holds it, and the flags by trigram."""
    names = {g: f"{low}_{i}" for i, g in enumerate(trigrams)}
    return df.withColumns({c: F.contains(F.col(low), F.lit(g)) for g, c in names.items()}), {g: F.col(c) for g, c in names.items()}


def holds(query: list[list[frozenset[str]]], has: dict[str, Column]) -> Column:
    """A trigram query over the postings of a document."""
    return reduce(and_, (reduce(or_, (reduce(and_, (has[g] for g in sorted(alt))) for alt in clause)) for clause in query))


#: Elements that one step of a running sum takes together: arrays grow one by one only so far, as each growth copies them.
TOGETHER = 128


def _groups(items: Column) -> Column:
    """The items in groups of TOGETHER."""
    n = F.ceil(F.size(items) / F.lit(TOGETHER)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(items, k * TOGETHER + 1, F.lit(TOGETHER)))).otherwise(F.slice(F.array(items), 1, 0))


def _before(values: Column, join, kind: str = "int") -> Column:
    """For each value, what join makes of all values before it, from 0: within groups, and over what the groups come to."""
    none = lambda: F.struct(F.lit(0).cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    step = lambda acc, x: F.struct(join(acc["at"], x).cast(kind).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    inner = F.transform(_groups(values), lambda g: F.aggregate(g, none(), step))
    outer = F.aggregate(F.transform(inner, lambda x: x["at"]), none(), step, lambda acc: acc["out"])
    return F.flatten(F.zip_with(inner, outer, lambda x, o: F.transform(x["out"], lambda v: join(o, v).cast(kind))))


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end>>: the leftmost non-overlapping matches whose group has at least so many code points.

    The pieces between the matches and the matches themselves, in turn, make up the text, so running lengths give the offsets.
    """
    n = F.char_length
    hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def sized(x: Column) -> Column:
        own = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        return F.struct(n(x["p"]).alias("p"), n(x["m"]).alias("m"), (n(own) >= least).alias("kept"))

    sizes = F.transform(F.filter(hits, lambda x: x["m"].isNotNull()), sized)
    # As one value, so that it isn't worked out anew for each group.
    both = F.transform(F.array(sizes), lambda s: F.zip_with(s, _before(F.transform(s, lambda x: x["p"] + x["m"]), lambda a, b: a + b), lambda x, at: F.struct((at + x["p"]).alias("start"), (at + x["p"] + x["m"]).alias("end"), x["kept"].alias("kept"))))
    return F.transform(F.filter(F.get(both, F.lit(0)), lambda x: x["kept"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def _expression(pattern: str, any_case: bool, group: int, least: int) -> str:
    """The pattern for Spark; where the match is the group and one greedy class ends it, short runs needn't be listed."""
    if group == 0 and pattern == "[0-9a-f]+":
        pattern = f"[0-9a-f]{{{least},}}"  # the same maximal runs, without the short ones
    return f"(?i){pattern}" if any_case else pattern


def _labelled(no: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def with_found(df: DataFrame, text: str = "text", rules: tuple = RULES, name: str = "__found") -> DataFrame:
    """df with array<struct<start, kind_no, end, kind>> of all rules' spans, by start, then by rule."""
    queries = {kind: q for kind, pattern, *_ in rules if (q := trigram_query(pattern))}
    grams = sorted({g for q in queries.values() for clause in q for alt in clause for g in alt})
    own = df.columns
    df, has = postings(df.withColumn(f"{name}_low", F.lower(whole(text))), f"{name}_low", grams)
    t = whole(text)
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for no, (kind, pattern, any_case, group, least) in enumerate(rules):
        rx = _expression(pattern, any_case, group, least)
        tried = holds(queries[kind], has) if kind in queries else t.rlike(rx)
        parts.append(F.transform(F.when(tried, spans(t, rx, group, least)).otherwise(none), _labelled(no, kind)))
    return df.withColumn(name, held(F.array_sort(F.concat(*parts)))).select(*own, name)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """(doc_id, text, found) of each row; found as in with_found."""
    return with_found(docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text")), rules=rules, name="found")


def listing(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of their spans, and all spans as kind:start:end."""
    df = scan(docs, doc_id, text)
    base = F.filter("found", lambda s: s["kind_no"] < len(BASE_RULES))
    count = lambda i: F.size(F.filter("found", lambda s: s["kind_no"] == i)).cast("long")
    return df.select(
        "doc_id",
        *(count(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE_RULES)),
        F.sha2(listing(base), 256).alias("base_sha256"),
        listing(F.col("found")).alias("spans"),
    )


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mask.

    A run begins where no span before reaches. Pieces are taken out of parts of the text, as taking one costs what stands before it.
    """

    def runs(f: Column) -> Column:
        """array<struct<start, end>> of the runs, from spans in the order of their starts."""
        reach = _before(F.transform(f, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        first = F.filter(F.zip_with(f, reach, lambda s, r: F.struct(s["start"].alias("start"), r.alias("reach"))), lambda x: x["start"] >= x["reach"])
        # A run ends where all before the next one end.
        ends = F.concat(F.transform(F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))), lambda x: x["reach"]), F.array(F.array_max(F.transform(f, lambda s: s["end"]))))
        return F.zip_with(first, ends, lambda x, e: F.struct(x["start"].alias("start"), e.alias("end")))

    def pieces(r: Column) -> Column:
        """What lies before each run, and after the last one."""
        edge = lambda n: F.array(F.struct(n.cast("int").alias("start"), n.cast("int").alias("end")))
        return F.zip_with(F.concat(edge(F.lit(0)), r), F.concat(r, edge(F.char_length(text))), lambda before, after: F.struct(before["end"].alias("a"), after["start"].alias("b")))

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a value that is worked out once
    parts = once(runs(found), lambda r: F.transform(_groups(pieces(r)), lambda g: F.struct(F.substring(text, F.get(g, F.lit(0))["a"] + 1, F.element_at(g, -1)["b"] - F.get(g, F.lit(0))["a"]).alias("text"), F.get(g, F.lit(0))["a"].alias("at"), g.alias("g"))))
    joined = F.transform(parts, lambda p: F.array_join(F.transform(p["g"], lambda x: F.substring(p["text"], x["a"] - p["at"] + 1, x["b"] - x["a"])), mask))
    return F.when(F.size(found) > 0, F.array_join(joined, mask)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """All documents with all their columns; secrets in the text are masked, n_chars follows. A null text stays null."""
    df = with_found(wrapped(docs, "text"), name="found")
    new = {"text": F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col("found")))}
    if "n_chars" in docs.columns:
        df = df.withColumn("clean", new["text"])
        new = {"text": F.col("clean"), "n_chars": F.when(F.size("found") > 0, F.char_length("clean").cast("long")).otherwise(F.col("doc.n_chars"))}
    return unwrapped(df, docs.columns, new)
