"""What the graph knows about statements, and where it stops: joins over tables of facts.

statements(id, file, line, end_line, kind, status, reason); touches(statement, table, mode) with mode READS or WRITES;
acts(id, type, table, detail, file, line, statement) with type RESETS, DROPS or ALTERS; refusals(id, code, file, line, reason);
mentions(refusal, table); boundaries(id, kind, subject, statement, node); files(file, text). Null tables match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.frames import cut
from seamark.functions.texts import mention_lines, snippet
from seamark.operators.graph import MAX_DEPTH, downstream, relation, upstream

#: Statuses of statements that are plain lineage, or have none to tell (fixed values).
QUIET = ("column_level", "no_lineage")


def effects(acts: DataFrame, tables: DataFrame) -> DataFrame:
    """acts on tables(table): what empties, drops or alters them."""
    return acts.join(tables.select("table").distinct(), "table", "left_semi")


def statements(ledger: DataFrame, touches: DataFrame, acts: DataFrame, refused: DataFrame, files: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Statements of files(file) that aren't plain lineage; with tables(table), those that touch, act on or, being refused, mention
    one of them, and those that touch and act on none at all. refused(statement, table) has the mentions of refused statements.
    """
    loud = ledger.filter(F.col("status").isNotNull() & ~F.col("status").isin(*QUIET)).join(files.select("file").distinct(), "file", "left_semi")
    if tables is not None:
        own = touches.select("statement", "table").unionByName(acts.select("statement", "table"))
        named = own.unionByName(refused.select("statement", "table")).join(tables.select("table").distinct(), "table", "left_semi")
        hit = named.select(F.col("statement").alias("id")).distinct()
        other = own.filter("table IS NOT NULL").select(F.col("statement").alias("id")).distinct()
        free = loud.join(other, "id", "left_anti").join(hit, "id", "left_anti")
        loud = loud.join(hit, "id", "left_semi").unionByName(free.select(*loud.columns))
    return loud.select("id", "file", "line", "end_line", "kind", "status", "reason")


def refusals(refused: DataFrame, mentions: DataFrame, files: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Refusals of files(file) with the tables they mention; with tables(table), those that mention one of them, or none at all."""
    per = mentions.dropna().groupBy(F.col("refusal").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("table")), ",").alias("tables"))
    out = refused.join(files.select("file").distinct(), "file", "left_semi").join(per, "id", "left")
    if tables is not None:
        hit = mentions.join(tables.select("table").distinct(), "table", "left_semi").select(F.col("refusal").alias("id")).distinct().withColumn("hit", F.lit(True))
        out = out.join(hit, "id", "left").filter("hit OR tables IS NULL")
    return out.select("id", "code", "file", "line", "reason", F.coalesce("tables", F.lit("")).alias("tables"))


def explain_edges(edges: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """edges(id, type, source, target, file, line) of ids(id), each with the SQL of the statement that begins at its line."""
    out = edges.join(ids.select("id").distinct(), "id", "left_semi").join(files.select("file", "text"), "file", "left")
    return out.select("id", "type", "source", "target", "file", "line", snippet(F.col("text"), F.col("line")).alias("sql"))


def gaps(edges: DataFrame, node: str, boundaries: DataFrame, refused: DataFrame, mentions: DataFrame, acts: DataFrame, ledger: DataFrame, touches: DataFrame, refused_statements: DataFrame) -> DataFrame:
    """edges(id, type, source, target, file, statement) -> (what, id, about): where knowledge of a node's lineage stops.

    boundary: on a statement that made an edge of it (about: the statement), or at one of its nodes (about: null); refusal: in
    its files, naming one of its tables or none; unverified: an edge of it; effect: on one of its tables; statement: one in its
    files that isn't plain lineage and concerns its tables, or none. `about` is the file, target, table or status.
    """
    spark = edges.sparkSession
    start = spark.range(1).select(F.lit(node).alias("node"))
    walked = cut(upstream(edges, start, MAX_DEPTH), "gaps-walk")
    own = cut(walked.join(edges.select("id", "file", "statement"), "id"), "gaps-edges")
    files, made = own.select("file").distinct(), own.select("statement").distinct()
    nodes = start.unionByName(own.select(F.col("source").alias("node"))).distinct()
    ends = nodes.unionByName(own.select(F.col("target").alias("node")))
    tables = cut(ends.select(relation(F.col("node")).alias("table")).distinct(), "gaps-tables")
    row = lambda df, what, about: df.select(F.lit(what).alias("what"), F.col("id"), about.cast("string").alias("about"))
    parts = [
        row(boundaries.join(made, "statement", "left_semi"), "boundary", F.col("statement")),
        row(boundaries.join(nodes, "node", "left_semi"), "boundary", F.lit(None)),
        row(refusals(refused, mentions, files, tables), "refusal", F.col("file")),
        row(own.filter("unverified"), "unverified", F.col("target")),
        row(effects(acts, tables), "effect", F.col("table")),
        row(statements(ledger, touches, acts, refused_statements, files, tables), "statement", F.col("status")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def shared_names(touches: DataFrame, columns: DataFrame, names: DataFrame, subject: str) -> DataFrame:
    """columns(table, name), names(name) -> (statement, tables): the other tables that a statement reads which have such a column too."""
    low = names.select(F.lower("name").alias("low")).distinct()
    other = columns.filter(F.col("table") != subject).withColumn("low", F.lower("name")).join(low, "low", "left_semi").select("table").distinct()
    read = touches.filter("mode = 'READS'").join(other, "table", "left_semi")
    return read.groupBy("statement").agg(F.array_join(F.array_sort(F.collect_set("table")), ",").alias("tables"))


def statement_tables(touches: DataFrame) -> DataFrame:
    """(statement, reads, writes): the tables of each statement, sorted and comma-joined."""
    names = lambda mode: F.array_join(F.array_sort(F.collect_set(F.when(F.col("mode") == mode, F.col("table")))), ",")
    return touches.groupBy("statement").agg(names("READS").alias("reads"), names("WRITES").alias("writes"))


def edge_context(edges: DataFrame, files: DataFrame, around: int = 1) -> DataFrame:
    """edges(id, file, line) -> (id, first, lines): the line of each edge with so many before and after it, as far as the file goes."""
    out = edges.join(files.select("file", F.split("text", r"\r?\n", -1).alias("all")), "file")
    first = F.greatest(F.col("line") - around, F.lit(1))
    lines = F.array_join(F.slice("all", first, F.col("line") + around - first + 1), "\n")
    return out.filter("line BETWEEN 1 AND size(all)").select("id", first.alias("first"), lines.alias("lines"))


#: What a statement has to do with a column that changes (fixed values), in the order in which they are told.
REASONS = {"reads": "reads it", "writes": "writes it", "keys": "joins on it"}


def edit_list(edges: DataFrame, touches: DataFrame, columns: DataFrame, ledger: DataFrame, files: DataFrame, changed: DataFrame, subject: str) -> DataFrame:
    """edges(type, source, target, statement), changed(node, name) columns of one table -> (statement, file, line, reason, possible, lines).

    Statements to edit: those with lineage out of or into a changed column; else those where refused SQL mentions it; else those
    that touch the table and name the column in some line, which are only possible, and tell which other tables share the name.
    """
    end = lambda types, side, why: edges.filter(F.col("type").isin(*types)).join(changed, edges[side] == changed["node"], "left_semi").select("statement", F.lit(why).alias("why"))
    found = end(("FEEDS", "INFLUENCES", "FILTERS"), "source", "reads").unionByName(end(("FEEDS", "INFLUENCES"), "target", "writes"))
    found = found.unionByName(end(("KEYS",), "source", "keys")).unionByName(end(("MENTIONS_COL",), "source", "mentions"))
    found = found.unionByName(touches.filter(F.col("table") == subject).select("statement", F.lit("touches").alias("why")))
    per = found.groupBy("statement").agg(F.collect_set("why").alias("whys"))
    names = changed.agg(F.array_sort(F.collect_set("name")).alias("names"))  # the changed columns of one table
    out = per.join(ledger.select(F.col("id").alias("statement"), "file", "line"), "statement").join(files.select("file", "text"), "file", "left").join(F.broadcast(names))
    out = out.withColumn("lines", F.coalesce(mention_lines(F.col("text"), F.col("line"), F.col("names")), F.array().cast("array<int>")))
    out = out.join(shared_names(touches, columns, changed.select("name"), subject), "statement", "left")
    told = F.array_compact(F.array(*(F.when(F.array_contains("whys", k), v) for k, v in REASONS.items())))
    named = F.concat(F.lit("names it, without lineage"), F.coalesce(F.concat(F.lit("; the name is also a column of "), F.col("tables")), F.lit("")))
    reason = F.when(F.size(told) > 0, F.array_join(told, ", ")).when(F.array_contains("whys", "mentions"), "mentioned by refused SQL").when(F.size("lines") > 0, named)
    out = out.select("statement", "file", "line", reason.alias("reason"), (F.size(told) == 0).alias("possible"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))
    return out.filter("reason IS NOT NULL")


def impact_report(edges: DataFrame, changed: DataFrame, subject: str, touches: DataFrame, columns: DataFrame, ledger: DataFrame, files: DataFrame, boundaries: DataFrame, refused: DataFrame, mentions: DataFrame, acts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """What a change of columns of one table means, whole: (section, item, about, depth), a row for each thing to tell.

    edges(id, type, source, target, file, statement), changed(node, name), subject: their table.
    affected: every node downstream, at its nearest hop, about all flows that reach it there. edit: statements to edit, with the
    reason. unverified: affected nodes that only refused or opaque SQL leads to at that hop. boundary: on a statement that made an affected
    edge or is to be edited. refusal: one that mentions a table reached. statement: one in the files concerned that isn't plain
    lineage and concerns those tables. effect: what empties, drops or alters them. note: the subject is on no edge. summary: the number of
    rows of each other section. depth is null outside of affected. Nodes and statements are told once in a section.
    """
    walked = cut(downstream(edges, changed.select("node").distinct(), depth, join_keys=True), "impact-walk")
    near = walked.groupBy("target").agg(F.min("depth").alias("near"))
    own = cut(walked.join(near.withColumnRenamed("target", "t"), (F.col("target") == F.col("t")) & (F.col("depth") == F.col("near"))).join(edges.select("id", "file", "statement"), "id", "left"), "impact-edges")
    affected = own.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("about"), F.min("depth").alias("depth"), F.bool_and(F.col("type").isin("MENTIONS_COL", "OPAQUE")).alias("weak"))
    affected = cut(affected, "impact-affected")
    edit = cut(edit_list(edges, touches, columns, ledger, files, changed, subject), "impact-edit")
    tables = affected.select(relation(F.col("target")).alias("table")).unionByName(edges.sparkSession.range(1).select(F.lit(subject).alias("table"))).distinct()
    tables = cut(tables, "impact-tables")
    made = own.select("statement").unionByName(edit.select("statement")).dropna().distinct()
    where = own.select("file").unionByName(edit.select("file")).dropna().distinct()
    hit = mentions.join(tables, "table", "left_semi").select(F.col("refusal").alias("id")).distinct()
    loud = statements(ledger, touches, acts, mentions.select("statement", "table"), where, tables)
    row = lambda df, section, item, about: df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), about.cast("string").alias("about"), F.lit(None).cast("int").alias("depth"))
    on_edge = edges.join(changed, (edges["source"] == changed["node"]) | (edges["target"] == changed["node"])).select("node").distinct()
    parts = [
        affected.select(F.lit("affected").alias("section"), F.col("target").alias("item"), "about", F.col("depth").cast("int").alias("depth")),
        row(edit, "edit", "statement", F.col("reason")),
        row(affected.filter("weak"), "unverified", "target", F.col("about")),
        row(boundaries.join(made, "statement", "left_semi"), "boundary", "id", F.col("statement")),
        row(refused.join(hit, "id", "left_semi"), "refusal", "id", F.col("code")),
        row(loud, "statement", "id", F.col("status")),
        row(effects(acts, tables), "effect", "id", F.concat_ws(" ", "type", "table")),
        row(changed.select("node").distinct().join(on_edge, "node", "left_anti"), "note", "node", F.lit("in no lineage edge: only SQL that names it can break")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = cut(out.distinct(), "impact-report")
    per = out.groupBy("section").agg(F.count("*").alias("n"))
    return out.unionByName(per.select(F.lit("summary").alias("section"), F.col("section").alias("item"), F.col("n").cast("string").alias("about"), F.lit(None).cast("int").alias("depth")))
