"""Which unit emitted a logged statement, and which statements a log has seen: containment joins instead of comparing all with all.

contained() finds the patterns that texts hold. Words are what stands between single spaces. A pattern's inner words are words of a
text that holds it; its first word ends one, its last begins one, and a pattern of one word is within one. So patterns meet the
distinct words of all texts first, and each is looked up by the part that the fewest texts have; texts are read word by word twice and
verified in whole where they have such a word. Only for patterns of one word are runs of GRAM characters listed, of the distinct words:
such a pattern is found by its rarest run, and the characters around a run are compared before a candidate is sent anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.frames import cut
from seamark.functions import texts as normal
from seamark.operators import intervals

#: Characters of a key; characters before and after its start that are compared at once; of a block in which runs are listed.
GRAM, BACK, AHEAD, BLOCK = 8, 16, 32, 512
#: Words from which on a pattern is looked up by its inner words alone.
FEW = 4


def _runs(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """texts(id, text) -> (id, s, at, gram) of each place of a text that has the least size ahead: its run of each size, at a place of s.

    Texts are cut into blocks first, as taking a piece out of a text costs what comes before it.
    """
    own = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    own = F.when(F.char_length("text") <= BLOCK, F.array("text")).otherwise(own)
    df = texts.select("id", own.alias("own"))
    around = F.transform("own", lambda x, i: F.struct(F.coalesce(F.right(F.when(i > 0, F.get("own", i - 1)), F.lit(BACK)), F.lit("")).alias("l"), x.alias("x"), F.coalesce(F.left(F.get("own", i + 1), F.lit(AHEAD)), F.lit("")).alias("r")))
    df = df.select("id", F.explode(around).alias("s")).select("id", F.concat("s.l", "s.x", "s.r").alias("s"), F.char_length("s.l").alias("l"), F.char_length("s.x").alias("n"))
    last = F.least(F.col("l") + F.col("n"), F.char_length("s") - min(sizes) + 1)
    df = df.filter(last > F.col("l")).select("id", "s", F.explode(F.sequence(F.col("l") + 1, last)).alias("at"))
    if len(sizes) == 1:
        return df.select("id", "s", "at", F.substring("s", F.col("at"), F.lit(sizes[0])).alias("gram"))
    grams = F.array(*(F.substring("s", F.col("at"), F.lit(k)) for k in sizes))
    return df.select("id", "s", "at", F.explode(F.array_distinct(grams)).alias("gram"))


def _near(runs: DataFrame, places: DataFrame) -> DataFrame:
    """runs as above, places(pattern, gram, at) -> (id, pattern) where a text's run and what stands around it are those of the pattern's rarest."""
    often = runs.join(places.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # A pattern with a run that no text has is in no text; an inner join lets it go, if its rarest run is that one.
    rarest = places.join(often, "gram", "left").groupBy("pattern").agg(F.min_by(F.struct("gram", "at", "n"), F.struct(F.coalesce("n", F.lit(0)), "at")).alias("k"))
    keys = rarest.filter("k.n IS NOT NULL").select("pattern", F.col("k.gram").alias("gram"), F.col("k.at").alias("at"))
    before = lambda c: F.substring(c, F.greatest(F.col("at") - BACK, F.lit(1)), F.least(F.col("at") - 1, F.lit(BACK)))
    after = lambda c: F.substring(c, F.col("at"), F.lit(AHEAD))
    keys = cut(keys.select("gram", "pattern", before("pattern").alias("p_before"), after("pattern").alias("p_after")), "pattern-keys")
    near = runs.join(keys, "gram").filter(before("s").endswith(F.col("p_before")) & after("s").startswith(F.col("p_after")))
    return near.select("id", "pattern").distinct()


def _within(words: DataFrame, parts: DataFrame, gram: int) -> DataFrame:
    """words(no, word, n), parts(part) -> (word, n, part) where a word holds the part, which may be shorter than a key."""
    size = F.least(F.char_length("part"), F.lit(gram))
    p = parts.select(F.col("part").alias("pattern"), size.alias("size"))
    sizes = sorted(r.size for r in p.select(F.col("size")).distinct().collect())  # as many as a key has characters at most
    places = p.select("pattern", F.explode(F.sequence(F.lit(1), F.char_length("pattern") - F.col("size") + 1)).alias("at"), "size")
    places = cut(places.select("pattern", F.substring("pattern", F.col("at"), F.col("size")).alias("gram"), "at"), "patterns")
    near = _near(_runs(words.filter(F.char_length("word") >= sizes[0]).select(F.col("no").alias("id"), F.col("word").alias("text")), sizes), places)
    return words.join(near, F.col("no") == F.col("id")).filter(F.contains("word", F.col("pattern"))).select("word", "n", F.col("pattern").alias("part"))


def _ending(words: DataFrame, parts: DataFrame, side) -> DataFrame:
    """words(no, word, n), parts(part) -> (word, n, part) where a word begins (side left) or ends (right) with the part; by its first AHEAD characters."""
    p = parts.select("part", side("part", F.least(F.char_length("part"), F.lit(AHEAD))).alias("key"))
    sizes = sorted(r.size for r in p.select(F.char_length("key").alias("size")).distinct().collect())  # AHEAD at most
    keys = F.filter(F.array(*(F.when(F.char_length("word") >= k, side("word", F.lit(k))) for k in sizes)), lambda x: x.isNotNull())
    df = words.select("word", "n", F.explode(keys).alias("key")).join(p, "key")
    word, part = F.col("word"), F.col("part")
    return df.filter(word.startswith(part) if side is F.left else word.endswith(part)).select("word", "n", "part")


def contained(texts: DataFrame, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """texts(id, text), patterns(pattern) -> distinct (id, pattern) where a text of the id holds the pattern, as it is written.

    Patterns shorter than a key are keys themselves. Null and empty patterns, and texts without id or text, match nothing. Repeated
    texts and patterns count once.
    """
    texts = texts.select("id", "text").dropna()
    # What single spaces part; any part of a pattern, as of a text, may be empty.
    w, n = F.split("pattern", " ", -1), F.size(F.split("pattern", " ", -1))
    part = lambda x, role: F.struct(x.alias("part"), F.lit(role).alias("role"))
    ends = F.when(n == 1, F.array(part(F.get(w, 0), "in"))).when(n < FEW, F.array(part(F.get(w, 0), "ends"), part(F.get(w, n - 1), "begins")))
    inner = F.transform(F.slice(w, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda x: part(x, "is"))
    ends = F.filter(F.coalesce(ends, F.slice(F.array(part(F.lit(""), "is")), 1, 0)), lambda s: s["part"] != "")
    p = patterns.select("pattern").filter("pattern <> ''").distinct().select("pattern", F.array_distinct(F.concat(inner, ends)).alias("parts"))
    p = cut(p, "pattern-parts")
    each = cut(p.select("pattern", F.explode("parts").alias("s")).select("pattern", "s.part", "s.role"), "parts")
    roles = [r.role for r in each.select("role").distinct().collect()]  # four at most
    near = texts.select("id", F.lit("").alias("pattern")).limit(0)
    if not p.filter("size(parts) = 0").isEmpty():  # the single space alone
        near = texts.filter(F.contains("text", F.lit(" "))).select("id", F.lit(" ").alias("pattern"))
    if roles:
        spoken = texts.select("id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("word"))
        words = cut(spoken.groupBy("word").agg(F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()), "words")
        found = None
        for role in sorted(roles):
            own = each.filter(F.col("role") == role).select("part").distinct()
            if role == "is":
                of = words.join(own, F.col("word") == F.col("part")).select("word", "n", "part")
            else:
                of = _within(words, own, gram) if role == "in" else _ending(words, own, F.left if role == "begins" else F.right)
            of = of.withColumn("role", F.lit(role))
            found = of if found is None else found.unionByName(of)
        found = cut(found, "parts-found")
        often = found.groupBy("part", "role").agg(F.sum("n").alias("n"))
        # A pattern with a part that no text has is in no text; an inner join lets it go, as that part is its rarest.
        rarest = each.join(often, ["part", "role"], "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "role", "part")).alias("k"))
        keys = cut(rarest.select("pattern", "k.role", "k.part").join(found, ["part", "role"]).select("word", "pattern").distinct(), "pattern-words")
        near = near.unionByName(spoken.join(keys, "word").select("id", "pattern"))
    found = near.groupBy("id").agg(F.collect_set("pattern").alias("patterns"))
    held = texts.join(found, "id").select("id", F.explode(F.filter("patterns", lambda x: F.contains(F.col("text"), x))).alias("pattern"))
    return held.distinct()


def one_line(text: Column) -> Column:
    """In upper case, with single spaces. A space that is alone is no match, so that most texts are only read."""
    return F.trim(F.regexp_replace(F.upper(text), r" \s+|[\t\n\x0B\f\r]\s*", " "))


def _led(texts: DataFrame, emitters: DataFrame) -> DataFrame:
    """texts(id, text), an id for each text -> (id, candidates, n_candidates, lead) as in leads()."""
    own = emitters.select("unit", one_line(F.col("fragment")).alias("fragment")).filter("unit IS NOT NULL AND fragment <> ''")
    own = own.groupBy("fragment").agg(F.count_distinct("unit").alias("n"), F.min("unit").alias("unit")).filter("n = 1").select("fragment", "unit")
    found = contained(texts, own.select(F.col("fragment").alias("pattern")))
    per = found.join(own, F.col("pattern") == F.col("fragment")).groupBy("id", "unit").agg(F.count("*").alias("n"), F.max(F.char_length("fragment")).alias("longest"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("longest")).alias("longest"), "unit")))
    per = per.groupBy("id").agg(ranked.alias("c"))
    first, second = F.get("c", 0), F.get("c", 1)
    tied = second.isNotNull() & (first["n"] == second["n"]) & (first["longest"] == second["longest"])
    return per.select("id", F.transform("c", lambda x: x["unit"]).alias("candidates"), F.size("c").cast("long").alias("n_candidates"), F.when(~F.coalesce(tied, F.lit(False)), first["unit"]).alias("lead"))


def leads(log: DataFrame, emitters: DataFrame) -> DataFrame:
    """log(text), emitters(unit, fragment) -> (text, candidates, n_candidates, lead): units by their own fragments in a text.

    A fragment that two units have tells nothing. Units rank by the number of their fragments in the text, then by the longest of
    them, then by name. lead is the first where no other has as many and as long ones; else null, as a tie is told, not broken.
    """
    # Equal texts of a log are looked at once, under a digest: a text is listed at each of its words, and its id with it.
    texts = cut(log.select("text").dropna().distinct().select(F.sha2("text", 256).alias("id"), "text"), "log-texts")
    return _led(texts, emitters).join(texts, "id").select("text", "candidates", "n_candidates", "lead")


def attributed(log: DataFrame, emitters: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """log(sql_id, sql_text, action, first_load_time) -> (sql_id, unit, signal, candidates, n_candidates, lead), a row each.

    emitters(no, unit, action, fragments), windows(unit, start, stop). The first of these signals holds:
    action: a unit's own, in any case; of several units with it, the first by no. It alone is of high confidence.
    fragment: the text, of which the log may have cut off the end, holds fragments that one unit alone has. It gives candidates and a
    lead, and no unit: texts that two units can emit are common.
    shape: the text with literals as marks equals a unit's fragment of that shape. Candidates too, by name; no lead.
    timing: the statement was first loaded within a unit's window; of several windows the one that began last, as of that time.
    none. Null texts, actions and times give no such signal.
    """
    e = emitters.select("no", "unit", "action", "fragments").filter("unit IS NOT NULL")
    action = e.filter("action IS NOT NULL").groupBy(F.upper("action").alias("a")).agg(F.min_by("unit", F.struct("no", "unit")).alias("by_action"))
    # Lines and shapes are made once and written; what is joined afterwards are their digests.
    line, shape = one_line(F.col("sql_text")), normal.statement_shape(F.col("sql_text"))
    log = log.select("sql_id", F.upper("action").alias("__action"), line.alias("__text"), F.sha2(line, 256).alias("__id"), F.sha2(shape, 256).alias("__shape"), F.unix_micros(F.col("first_load_time").cast("timestamp")).alias("__at"))
    log = cut(log, "log-lines")
    each = e.select("unit", F.explode("fragments").alias("fragment"))
    texts = cut(log.select(F.col("__id").alias("id"), F.col("__text").alias("text")).dropna().distinct(), "log-texts")
    by_text = _led(texts, each)
    shapes = each.select("unit", F.sha2(normal.statement_shape(F.col("fragment")), 256).alias("s")).dropna().groupBy("s").agg(F.sort_array(F.collect_set("unit")).alias("by_shape"))
    log = log.drop("__text")
    df = log.join(action, F.col("__action") == F.col("a"), "left").join(by_text, F.col("__id") == F.col("id"), "left").join(shapes, F.col("__shape") == F.col("s"), "left")
    if windows is None:
        df = df.withColumn("by_time", F.lit(None).cast("string"))
    else:
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        spans = windows.select(F.lit("all").alias("g"), micros("start").alias("start"), micros("stop").alias("stop"), F.col("unit").alias("id"))
        times = log.select(F.lit("all").alias("g"), F.col("__at").alias("at")).dropna().distinct()
        # A day and more to a block of the sweep: job windows are minutes to hours.
        held = intervals.innermost(times, spans, group="g", at="at", width=1 << 37).select(F.col("at").alias("t"), F.col("span").alias("by_time"))
        df = df.join(held, F.col("__at") == F.col("t"), "left")
    signal = F.when(F.col("by_action").isNotNull(), "action").when(F.col("n_candidates").isNotNull(), "fragment").when(F.col("by_shape").isNotNull(), "shape").when(F.col("by_time").isNotNull(), "timing").otherwise("none")
    df = df.withColumn("signal", signal)
    none = F.array().cast("array<string>")
    unit = F.when(F.col("signal") == "action", F.col("by_action")).when(F.col("signal") == "timing", F.col("by_time"))
    candidates = F.when(F.col("signal") == "fragment", F.col("candidates")).when(F.col("signal") == "shape", F.col("by_shape")).otherwise(none)
    return df.select("sql_id", unit.alias("unit"), "signal", candidates.alias("candidates"), F.size(candidates).cast("long").alias("n_candidates"), F.when(F.col("signal") == "fragment", F.col("lead")).alias("lead"))


def recovery(attributed: DataFrame) -> DataFrame:
    """(signal, n, share, high_confidence, rate): rows of each signal, their share, and, the same in each row, how many rows of
    all are attributed with high confidence, and their share, which is null where there are none."""
    per = attributed.groupBy("signal").agg(F.count("*").alias("n"))
    total = Window.partitionBy()  # five rows at most
    high = F.coalesce(F.sum(F.when(F.col("signal") == "action", F.col("n"))).over(total), F.lit(0))
    return per.select("signal", "n", (F.col("n") / F.sum("n").over(total)).alias("share"), high.alias("high_confidence"), F.try_divide(high, F.sum("n").over(total)).alias("rate"))


# ---- execution witness ----


def known_shapes(statements: DataFrame) -> DataFrame:
    """statements(unit, line, text) -> (unit in upper case, line, shape), those of a shape long enough to tell."""
    return statements.select(F.upper("unit").alias("unit"), "line", normal.statement_shape(F.col("text")).alias("shape")).dropna().distinct()


def sighted(log: DataFrame, shapes: DataFrame) -> DataFrame:
    """log(action, sql_text, ...) with the (unit, line) it shows: the action names the unit and the unit has a statement of that shape.

    Either alone is no sighting: actions stick to a session, and shapes are shared. Works on streams too, as it keeps no state.
    """
    log = log.withColumns({"__unit": F.upper("action"), "__shape": normal.statement_shape(F.col("sql_text"))})
    return log.join(shapes, (F.col("__unit") == F.col("unit")) & (F.col("__shape") == F.col("shape"))).drop("__unit", "__shape", "shape")


def witness(log: DataFrame, statements: DataFrame) -> DataFrame:
    """(unit, line, verdict) of the statements that a log can tell about: exercised, unexercised, or unobservable.

    A unit is told about if its action is in the log and one of its statements was sighted; where none is, the log may have
    lost all it had. DDL leaves no trace in a log, so it is unobservable unless it was sighted; so is a statement too short for a shape.
    """
    shapes = known_shapes(statements)
    seen = cut(sighted(log.select("action", "sql_text").distinct(), shapes).select("unit", "line").distinct(), "sightings")
    all_ = statements.select(F.upper("unit").alias("unit"), "line", normal.statement_shape(F.col("text")).isNull().alias("short"), F.regexp_like(F.ltrim("text"), F.lit(DDL)).alias("ddl"))
    all_ = all_.groupBy("unit", "line").agg(F.bool_and(F.col("short") | F.coalesce("ddl", F.lit(False))).alias("hidden"))
    df = all_.join(seen.select("unit").distinct(), "unit", "left_semi").join(seen.withColumn("seen", F.lit(True)), ["unit", "line"], "left")
    return df.select("unit", "line", F.when(F.col("seen"), "exercised").when(F.col("hidden"), "unobservable").otherwise("unexercised").alias("verdict"))


#: How statements begin of which a log keeps no trace.
DDL = r"(?i)(CREATE|ALTER|DROP|TRUNCATE|GRANT|REVOKE|COMMENT|RENAME|ANALYZE)\b"
