"""Measurement of facts against labels, logs and sightings: joins, groups and windows over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamark.operators import builds

KEY = ("source", "target", "flow", "transform", "phase")


def score(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """truth, predicted(source, target, flow, transform, phase, guard, band) -> (band, flow, tp, fp, fn, precision, recall).

    Facts are multisets after exact duplicates go. Within a match key, facts of one guard pair first, then what is left over
    pairs in order. A pair counts at the true band, a surplus prediction at the band it claims, a missed truth at its own.
    Nulls in a key or guard equal each other. Precision and recall are null where they are undefined.
    """
    key = F.unhex(F.substring(F.sha2(F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}), 256), 1, 32))
    guard = F.coalesce(F.concat(F.lit("="), "guard"), F.lit("-"))
    ready = lambda df, side: df.select(key.alias("k"), guard.alias("g"), "flow", "band", F.lit(side).alias("side"))
    # Both sides are dealt by the match key once: all that follows numbers and groups inside a key, so nothing moves again.
    facts = ready(truth, 0).unionByName(ready(predicted, 1)).distinct().repartition("k")
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("band")))
    number = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by, "side").orderBy("band", "g", "flow")))
    meet = lambda df, *by: df.groupBy(*by, "n").agg(F.min("flow").alias("flow"), of(0).alias("tb"), of(1).alias("pb"), F.min("side").alias("low"), F.max("side").alias("high"))
    # Equal guards first: within (key, guard) both sides are numbered and meet by number.
    exact = meet(number(facts, "k", "g"), "k", "g")
    left = exact.filter("low = high").select("k", "g", "flow", F.col("low").alias("side"), F.coalesce("tb", "pb").alias("band"))
    rest = meet(number(left, "k"), "k")
    both = exact.filter("low < high").select("flow", "tb", "pb").unionByName(rest.select("flow", "tb", "pb"))
    out = both.groupBy(F.coalesce("tb", "pb").alias("band"), "flow").agg(
        F.count(F.when(F.col("tb").isNotNull() & F.col("pb").isNotNull(), 1)).alias("tp"),
        F.count(F.when(F.col("tb").isNull(), 1)).alias("fp"),
        F.count(F.when(F.col("pb").isNull(), 1)).alias("fn"),
    )
    return out.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def forbidden(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges that match a rule(source, target, flow, transform) in all that the rule states; a null transform states nothing."""
    r = rules.select(F.col("source").alias("rs"), F.col("target").alias("rt"), F.col("flow").alias("rf"), F.col("transform").alias("rx"))
    on = (F.col("source") == F.col("rs")) & (F.col("target") == F.col("rt")) & (F.col("flow") == F.col("rf")) & (F.col("rx").isNull() | (F.col("rx") == F.col("transform")))
    return edges.join(r, on, "left_semi")


def origin_violations(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges of an asserted (source, target, flow) whose (unit, line) isn't among the allowed ones."""
    asserted = allowed.select("source", "target", "flow").distinct()
    return edges.join(asserted, ["source", "target", "flow"], "left_semi").join(allowed, ["source", "target", "flow", "unit", "line"], "left_anti")


def discriminating_fragments(emitters: DataFrame) -> DataFrame:
    """emitters(unit, fragment) -> (fragment, unit) of fragments that one unit alone emits."""
    return emitters.dropna().groupBy("fragment").agg(F.countDistinct("unit").alias("n"), F.min("unit").alias("unit")).filter("n = 1").select("fragment", "unit")


def attribute_log(log: DataFrame, emitters: DataFrame) -> DataFrame:
    """log(sql_id, action, shape), emitters(unit, action, shape) -> (sql_id, unit, signal, n_candidates, candidates).

    An action, in any case, names its unit, the first by name where several have it. A shape gives candidates, by name, and never a
    unit, also where there is one candidate: texts that two units can emit are common. log_recovery.attributed reads whole texts.
    """
    action = emitters.groupBy(F.upper("action").alias("a")).agg(F.min("unit").alias("unit_a"))
    shape = emitters.groupBy(F.col("shape").alias("s")).agg(F.countDistinct("unit").alias("n_s"), F.sort_array(F.collect_set("unit")).alias("units_s"))
    df = log.join(action, F.upper("action") == F.col("a"), "left").join(shape, F.col("shape") == F.col("s"), "left")
    signal = F.when(F.col("unit_a").isNotNull(), "action").when(F.col("n_s").isNotNull(), "shape").otherwise("none")
    n = F.when(F.col("unit_a").isNotNull(), 1).otherwise(F.coalesce("n_s", F.lit(0))).cast("long")
    candidates = F.when(F.col("unit_a").isNotNull(), F.array("unit_a")).otherwise(F.coalesce("units_s", F.array().cast("array<string>")))
    return df.select("sql_id", F.col("unit_a").alias("unit"), signal.alias("signal"), n.alias("n_candidates"), candidates.alias("candidates"))


def recovery_report(attributed: DataFrame) -> DataFrame:
    """(signal, n, n_exact, rate): rows of each signal, those with a unit, and, the same in each row, the share of all rows that an action names."""
    per = attributed.groupBy("signal").agg(F.count("*").alias("n"), F.count("unit").alias("n_exact"))
    total = Window.partitionBy()  # a row for each signal
    high = F.coalesce(F.sum(F.when(F.col("signal") == "action", F.col("n"))).over(total), F.lit(0))
    return per.withColumn("rate", high / F.sum("n").over(total))


def witness(edges: DataFrame, units: DataFrame, sightings: DataFrame, unobservable: DataFrame) -> DataFrame:
    """edges(id, unit, line) -> (id, unexercised): false where sighted, null where it can't be known, else true."""
    cov = units.select(F.col("unit").alias("cu")).distinct()
    seen = sightings.select(F.col("unit").alias("su"), F.col("line").alias("sl")).distinct()
    hid = unobservable.select(F.col("unit").alias("hu"), F.col("line").alias("hl")).distinct()
    df = edges.join(cov, F.col("unit") == F.col("cu"), "left")
    df = df.join(seen, (F.col("unit") == F.col("su")) & (F.col("line") == F.col("sl")), "left")
    df = df.join(hid, (F.col("unit") == F.col("hu")) & (F.col("line") == F.col("hl")), "left")
    verdict = F.when(F.col("cu").isNull(), F.lit(None).cast("boolean")).when(F.col("su").isNotNull(), False).when(F.col("hu").isNotNull(), F.lit(None).cast("boolean")).otherwise(True)
    return df.select("id", verdict.alias("unexercised"))


def coverage_statement(reads: DataFrame, writes: DataFrame, tables: DataFrame) -> DataFrame:
    """reads, writes, tables(name) -> (kind, name): tables read and never written, never touched, and names that are no table."""
    r, w, t = (x.select("name").dropna().distinct() for x in (reads, writes, tables))
    orphan = r.subtract(w).intersect(t).withColumn("kind", F.lit("orphan_upstream"))
    untouched = t.subtract(r).subtract(w).withColumn("kind", F.lit("untouched"))
    dangling = r.union(w).distinct().subtract(t).withColumn("kind", F.lit("dangling"))
    return orphan.unionByName(untouched).unionByName(dangling).select("kind", "name")


def changed_columns(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_before, n_after, n_changed): multiset difference of each column's values, nulls ignored.

    Both sides are turned to (column, value) rows and counted once; no column is compared by a sort of its own.
    """
    tall = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*", F.lit(side).alias("side"))
    rows = tall(before, -1).unionByName(tall(after, 1)).filter("value IS NOT NULL")
    per = rows.groupBy("column", "value").agg(F.sum("side").alias("d"), F.count(F.when(F.col("side") < 0, 1)).alias("b"), F.count(F.when(F.col("side") > 0, 1)).alias("a"))
    return per.groupBy("column").agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"), F.sum(F.abs("d")).alias("n_changed"))


def inclusion_dependencies(frames: dict[str, DataFrame]) -> DataFrame:
    """{name: df(value)} -> (dependent, referenced): every distinct value of the dependent column occurs in the referenced one.

    Values go into one tall table of (value, column); the columns that share a value meet in that value's group, so each
    column loses the candidates that the value's group lacks, and no pair of columns is joined value by value.
    """
    spark = next(iter(frames.values())).sparkSession
    tall = None
    for name, df in frames.items():
        own = df.select(F.lit(name).alias("column"), F.col(df.columns[0]).cast("string").alias("value")).filter("value IS NOT NULL")
        tall = own if tall is None else tall.unionByName(own)
    # A value is in as many columns as there are at most, so its set is small.
    sets = tall.groupBy("value").agg(F.collect_set("column").alias("holders")).groupBy(F.array_sort("holders").alias("holders")).count()
    each = sets.select(F.explode("holders").alias("dependent"), "holders")
    names = spark.createDataFrame([(n,) for n in frames], "referenced string")
    # Bounded by the number of columns, not of rows.
    lost = each.join(F.broadcast(names), ~F.array_contains("holders", F.col("referenced"))).select("dependent", "referenced").distinct()
    every = each.select("dependent").distinct().join(F.broadcast(names), F.col("dependent") != F.col("referenced"))
    return every.join(lost, ["dependent", "referenced"], "left_anti")


def answer_score(expected: DataFrame, given: DataFrame) -> DataFrame:
    """expected, given(question, citation) -> (question, missing, extra, correct): correct if the sets of citations are equal."""
    e, g = (x.dropna().distinct() for x in (expected, given))
    both = e.withColumn("e", F.lit(1)).join(g.withColumn("g", F.lit(1)), ["question", "citation"], "full")
    out = both.groupBy("question").agg(F.count(F.when(F.col("g").isNull(), 1)).alias("missing"), F.count(F.when(F.col("e").isNull(), 1)).alias("extra"))
    return out.withColumn("correct", (F.col("missing") == 0) & (F.col("extra") == 0))


def metamorphic(facts: DataFrame) -> DataFrame:
    """facts(grp, relation, fact) -> (grp, n_relations, agrees): whether the relations of a group have the same set of facts.

    Sets are compared by digests that are summed, so none is gathered. A relation whose facts are all null has the empty set.
    """
    sets = facts.select("grp", "relation", "fact").distinct()
    empty = sets.select("grp", "relation").distinct()
    per = empty.alias("e").join(builds.digest(sets.filter("fact IS NOT NULL"), ["grp", "relation"]).alias("d"), F.col("e.grp").eqNullSafe(F.col("d.grp")) & F.col("e.relation").eqNullSafe(F.col("d.relation")), "left")
    return per.groupBy("e.grp").agg(F.count("*").alias("n_relations"), (F.countDistinct(F.coalesce("digest", F.lit(""))) == 1).alias("agrees"))


def manifest(texts: DataFrame) -> DataFrame:
    """texts(name, text) -> (name, sha256, n_lines, n_comment): lines, and those that begin with -- or # after white space."""
    lines = F.split("text", "\n", -1)
    comment = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(--|#)")))
    return texts.select("name", F.sha2("text", 256).alias("sha256"), F.size(lines).cast("long").alias("n_lines"), comment.cast("long").alias("n_comment"))


def boundary_score(expected: DataFrame, declared: DataFrame) -> DataFrame:
    """expected, declared(kind, subject) -> (kind, declared_n, missing, unexpected), subjects compared in any case, once each."""
    plain = lambda df, side: df.select("kind", F.upper("subject").alias("subject")).distinct().withColumn(side, F.lit(1))
    both = plain(expected, "e").join(plain(declared, "d"), ["kind", "subject"], "full")
    count = lambda c: F.count(F.when(c, 1))
    e, d = F.col("e").isNotNull(), F.col("d").isNotNull()
    return both.groupBy("kind").agg(count(e & d).alias("declared_n"), count(e & ~d).alias("missing"), count(~e & d).alias("unexpected"))


#: Limits of the criteria, written down before measuring (fixed values).
GATES = (("value precision", "least", 0.95), ("value recall", "least", 0.85), ("parse coverage", "least", 0.70), ("edges from refused statements", "most", 0.0))
#: Further ones: shares of edges on weak evidence and of dynamic statements, and units whose summaries don't end.
MORE_GATES = (("weak evidence", "most", 0.70), ("dynamic statements", "most", 0.30), ("summaries without end", "most", 0.0))


def kill_criteria(measured: DataFrame, gates: tuple = GATES) -> DataFrame:
    """measured(criterion, value) -> (criterion, value, verdict) of each gate: PASS, TRIGGERED, or PENDING where nothing was measured."""
    rules = measured.sparkSession.createDataFrame(list(gates), "criterion string, side string, bound double")
    df = rules.join(measured.groupBy("criterion").agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "criterion", "left")
    value = F.when(F.col("side") == "least", F.col("lo")).otherwise(F.col("hi"))
    ok = F.when(F.col("side") == "least", value >= F.col("bound")).otherwise(value <= F.col("bound"))
    return df.select("criterion", value.alias("value"), F.when(value.isNull(), "PENDING").when(ok, "PASS").otherwise("TRIGGERED").alias("verdict"))


def triage(spans: DataFrame, missed: DataFrame, spurious: DataFrame, broken: DataFrame) -> DataFrame:
    """spans(unit, first, last), facts(unit, line) -> (unit, first, n_missed, n_spurious, n_forbidden) of statements with any.

    Facts go to the statement whose lines hold theirs; lines are spread over a span, so that the join is by equality.
    """
    lines = spans.select("unit", "first", F.explode(F.sequence("first", F.greatest("first", "last"))).alias("line"))
    facts = None
    for df, name in ((missed, "missed"), (spurious, "spurious"), (broken, "forbidden")):
        own = df.select("unit", "line", F.lit(name).alias("what"))
        facts = own if facts is None else facts.unionByName(own)
    per = facts.groupBy("unit", "line").pivot("what", ["missed", "spurious", "forbidden"]).count()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}")
    return lines.join(per, ["unit", "line"]).groupBy("unit", "first").agg(total("missed"), total("spurious"), total("forbidden"))


def holdout_recall(expected: DataFrame, reached: DataFrame) -> DataFrame:
    """expected(target, heading, source), reached(target, source) -> (heading, n, n_found, recall), names in any case."""
    low = lambda df, *more: df.select(F.lower("target").alias("target"), F.lower("source").alias("source"), *more).distinct()
    both = low(expected, "heading").join(low(reached).withColumn("r", F.lit(1)), ["target", "source"], "left")
    out = both.groupBy("heading").agg(F.count("*").alias("n"), F.count("r").alias("n_found"))
    return out.withColumn("recall", F.col("n_found") / F.col("n"))


def ungrounded(cited: DataFrame, seen: DataFrame) -> DataFrame:
    """cited(question, id), seen(question, id) -> the citations that no tool of the question returned."""
    return cited.dropna().distinct().join(seen, ["question", "id"], "left_anti")


def ambiguous(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names(name) without a dot, nodes(node) -> (name, n, nodes): names that are the last part of several nodes."""
    last = nodes.dropna().distinct().select(F.regexp_extract("node", r"([^.]*)$", 1).alias("name"), "node")
    hit = last.join(names.filter(~F.contains("name", F.lit("."))).select("name").distinct(), "name", "left_semi")
    return hit.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("nodes")).filter("n > 1")


def coverage_gate(cited: DataFrame, edges: DataFrame, partial: DataFrame) -> DataFrame:
    """cited(question, id), edges(id, statement), partial(statement) -> questions whose citations rest on a statement analysed in part."""
    weak = cited.join(edges, "id").join(partial.distinct(), "statement", "left_semi")
    return weak.groupBy("question").agg(F.array_join(F.array_sort(F.collect_set("statement")), ",").alias("statements"))


def emitters(units: DataFrame, fragments) -> DataFrame:
    """units(unit, text), a column function of texts -> (unit, fragment): the literal fragments that each unit emits."""
    return units.select("unit", F.explode(fragments(F.col("text"))).alias("fragment")).distinct()


def met_targets(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """scores(band, flow, precision, recall), targets(band, flow, precision, recall) -> (band, flow, met): null where nothing was scored."""
    t = targets.select("band", "flow", F.col("precision").alias("p"), F.col("recall").alias("r"))
    met = (F.col("precision") >= F.col("p")) & (F.col("recall") >= F.col("r"))
    return t.join(scores.select("band", "flow", "precision", "recall"), ["band", "flow"], "left").select("band", "flow", met.alias("met"))


def spelling_pairs(marks: DataFrame, facts: DataFrame) -> DataFrame:
    """marks(pair, side, statement) with side A or B, facts(statement, fact) -> (pair, verdict, n_a, n_b, only_a, only_b).

    The two statements of a pair say the same in other words, so their facts should be equal as sets: EQUAL or DIFFER, with the
    numbers of facts that one side alone has; a pair without one of its sides is incomplete, and so has null numbers. Of several
    statements of a side all facts count. Facts are joined to pairs and counted; no set is gathered.
    """
    marks = marks.filter(F.col("side").isin("A", "B")).select("pair", "side", "statement").dropna().distinct()
    sides = marks.groupBy("pair").agg(F.countDistinct("side").alias("sides"))
    has = lambda x: F.max(F.when(F.col("side") == x, 1).otherwise(0))
    each = marks.join(facts.select("statement", "fact").dropna().distinct(), "statement").groupBy("pair", "fact").agg(has("A").alias("a"), has("B").alias("b"))
    per = each.groupBy("pair").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.count_if(F.col("a") > F.col("b")).alias("only_a"), F.count_if(F.col("b") > F.col("a")).alias("only_b"))
    df = sides.join(per, "pair", "left").fillna(0, ["n_a", "n_b", "only_a", "only_b"])
    verdict = F.when(F.col("sides") < 2, "incomplete").when(F.col("only_a") + F.col("only_b") == 0, "EQUAL").otherwise("DIFFER")
    return df.select("pair", verdict.alias("verdict"), *(F.when(F.col("sides") == 2, F.col(c)).cast("long").alias(c) for c in ("n_a", "n_b", "only_a", "only_b")))


def equal_spellings(statements: DataFrame, shape) -> DataFrame:
    """statements(id, text), a column function of texts -> (shape, n, first, last) of shapes that several statements have."""
    per = statements.select("id", shape(F.col("text")).alias("shape")).filter("shape IS NOT NULL")
    return per.groupBy("shape").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).filter("n > 1")
