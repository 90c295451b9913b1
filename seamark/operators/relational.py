"""The relational operators as queries over the order tables, each with the SQL that says the same.

Plans are left to Spark: no hints, no hand-made orders of joins. Ranges are joined through buckets of the range, so that they
hash like equal keys; as-of picks come from one sort of the union of both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.frames import cut, shared_dir
from seamark.operators import hierarchy
from seamark.sources import facts_io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables by attribute, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str):
    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLE[f.__name__] = sql
        return f

    return keep



def revenue():
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)


# ---- joins ----


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def join_left(t):
    o = t.orders.filter("o_orderstatus = 'F'")
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT s_suppkey, count(l_orderkey) AS n FROM (SELECT * FROM lineitem WHERE l_quantity > 49) RIGHT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def join_right(t):
    return t.lineitem.filter("l_quantity > 49").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "right").groupBy("s_suppkey").agg(F.count("l_orderkey").alias("n"))


@query("""SELECT coalesce(c, s) AS nation, coalesce(nc, 0) AS n_customers, coalesce(ns, 0) AS n_suppliers FROM (SELECT c_nationkey AS c, count(*) AS nc FROM customer WHERE c_acctbal < 0 GROUP BY 1)
FULL JOIN (SELECT s_nationkey AS s, count(*) AS ns FROM supplier GROUP BY 1) ON c = s""")
def join_full(t):
    c = t.customer.filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("c")).agg(F.count("*").alias("nc"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("s")).agg(F.count("*").alias("ns"))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return c.join(s, F.col("c") == F.col("s"), "full").select(F.coalesce("c", "s").alias("nation"), zero("nc").alias("n_customers"), zero("ns").alias("n_suppliers"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT CASE WHEN l_quantity > 10 THEN l_partkey ELSE 0 END FROM lineitem)")
def join_null_aware_anti(t):
    """NOT IN as a plain anti join, which is never broadcast whole: a null on the right leaves no row, a null on the left only stays where the right is empty."""
    v = t.lineitem.select(F.when(F.col("l_quantity") > 10, F.col("l_partkey")).otherwise(0).alias("v")).distinct()
    told = v.agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"))  # one row
    kept = t.part.join(v.dropna(), F.col("p_partkey") == F.col("v"), "left_anti").join(told, F.lit(True))
    return kept.filter("n = 0 OR (nulls = 0 AND p_partkey IS NOT NULL)").select("p_partkey")


@query("SELECT r_name, count(*) AS n FROM region, nation WHERE n_nationkey > r_regionkey * 4 GROUP BY 1")
def join_theta(t):
    return t.region.join(t.nation, F.col("n_nationkey") > F.col("r_regionkey") * 4).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("n1"), F.col("b.n_name").alias("n2"))


@query("SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer) JOIN (SELECT s_nationkey AS k FROM supplier) USING (k) GROUP BY 1")
def join_using(t):
    """Rows of a nation are counted on each side before they meet: its pairs, which grow with the square, are never made."""
    per = lambda df, key, n: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(n))
    return per(t.customer, "c_nationkey", "a").join(per(t.supplier, "s_nationkey", "b"), "k").select("k", (F.col("a") * F.col("b")).alias("n"))


@query("""SELECT n_name, r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2""")
def join_chain(t):
    df = t.lineitem.join(t.orders.filter("o_orderdate < TIMESTAMP '1997-01-01'"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    df = df.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), revenue().alias("revenue"))


@query("""SELECT e.event_id, count(*) AS n FROM events e JOIN events f ON f.user_id = e.user_id AND f.ts > e.ts AND f.ts <= e.ts + INTERVAL 1 HOUR GROUP BY 1""")
def join_range(t):
    """Events of a user within an hour: each event stands in its hour and the next, so the join is on (user, hour)."""
    hour = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 3_600_000_000)
    e = t.events.select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("a"), F.explode(F.array(hour("ts"), hour("ts") + 1)).alias("h"))
    f = t.events.select(F.col("user_id").alias("u"), F.col("ts").alias("b"), hour("ts").alias("h"))
    df = e.join(f, ["u", "h"]).filter("b > a AND b <= a + INTERVAL 1 HOUR")
    return df.groupBy("event_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = user_id AND o_orderdate <= ts) AS last_order FROM events""")
def join_as_of(t):
    """Both sides in one stream per customer, orders first among equals; the last order so far is carried along."""
    e = t.events.select("user_id", "ts", "event_id", F.lit(1).alias("side"))
    o = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("side"))
    w = Window.partitionBy("user_id").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = e.unionByName(o).withColumn("last_order", F.last(F.when(F.col("side") == 0, F.col("ts")), ignorenulls=True).over(w))
    return df.filter("side = 1").select("event_id", "last_order")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
def join_lateral_top(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = t.orders.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


# ---- aggregates ----


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_group(t):
    return t.lineitem.filter("l_shipdate <= TIMESTAMP '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), revenue().alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 200000")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top")).filter("n > 12 AND top > 200000")


_SETS = "l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INT) AS g1, CAST(grouping(l_linestatus) AS INT) AS g2, count(*) AS n, sum(l_quantity) AS q"


def _sets(df):
    return df.agg(F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


@query(f"SELECT {_SETS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t):
    return _sets(t.lineitem.rollup("l_returnflag", "l_linestatus"))


@query(f"SELECT {_SETS} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_cube(t):
    return _sets(t.lineitem.cube("l_returnflag", "l_linestatus"))


@query(f"SELECT {_SETS} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def agg_grouping_sets(t):
    return _sets(t.lineitem.groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1")
def agg_distinct(t):
    return t.orders.groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderstatus").alias("states"))


@query("SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_tax > 0.05) AS taxed FROM lineitem GROUP BY 1")
def agg_filter(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"), F.count(F.when(F.col("l_tax") > 0.05, 1)).alias("taxed"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY 1")
def agg_ordered_list(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name"), asc=False), ",").alias("names"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS med, quantile_disc(p_size, 0.9) AS p90 FROM part GROUP BY 1")
def agg_percentile(t):
    return t.part.groupBy("p_brand").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice)"), 4).alias("med"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("p90"))


@query("SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest, bool_or(c_acctbal < 0) AS any_debt, bool_and(c_acctbal > -1000) AS all_ok, round(stddev_samp(c_acctbal), 4) AS sd FROM customer GROUP BY 1")
def agg_by_extremes(t):
    return t.customer.groupBy("c_nationkey").agg(
        F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("richest"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("poorest"), F.bool_or(F.col("c_acctbal") < 0).alias("any_debt"),
        F.bool_and(F.col("c_acctbal") > -1000).alias("all_ok"), F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"))


@query("SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def agg_of_agg(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def pivot(t):
    df = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)
    return df.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("SELECT l_orderkey, l_linenumber, 'tax' AS kind, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount FROM lineitem")
def unpivot(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return df.unpivot(["l_orderkey", "l_linenumber"], ["tax", "discount"], "kind", "value")


# ---- windows ----


def _w():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")



@query("""SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(3) OVER w AS nt, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_ranking(t):
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.orders.select("o_orderkey", F.row_number().over(_w()).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.ntile(3).over(_w()).alias("nt"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"))


@query("""SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_key, nth_value(o_orderkey, 2) OVER w AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_values(t):
    whole = _w().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.lag("o_totalprice").over(_w()).alias("prev"), F.lead("o_orderkey", 2).over(_w()).alias("next2"), F.first("o_orderkey").over(_w()).alias("first_key"), F.last("o_orderkey").over(whole).alias("last_key"), F.nth_value("o_orderkey", 2).over(_w()).alias("second_key"))


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3,
round(max(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS top FROM orders""")
def window_frames(t):
    run, three = _w().rowsBetween(Window.unboundedPreceding, 0), _w().rowsBetween(-2, 0)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(run), 2).alias("running"), F.count("*").over(three).alias("last3"), F.round(F.max("o_totalprice").over(Window.partitionBy("o_custkey")), 2).alias("top"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
def window_range_frame(t):
    return t.part.select("p_partkey", F.count("*").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)).alias("near"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def window_latest_row(t):
    """The last row of each key as an aggregate: max_by combines on the map side, a window would shuffle every row."""
    newest = F.max_by("o_orderkey", F.struct("o_orderdate", -F.col("o_orderkey")))
    return t.orders.groupBy("o_custkey").agg(newest.alias("o_orderkey"))


@query("""SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def window_sessions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.col("ts") <= F.lag("ts").over(w) + F.expr("INTERVAL 6 HOURS"), 0).otherwise(1)
    df = t.events.withColumn("new", gap).withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("user_id", "s").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


# ---- sorting, sets, subqueries ----


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def top_offset(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").offset(20).limit(10)


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 7))")
def top_with_ties(t):
    """The seventh value comes from a top-k and bounds the rows: no window over the whole table."""
    least = t.part.select("p_size").orderBy(F.desc("p_size")).limit(7).agg(F.min("p_size").alias("least"))
    return t.part.join(least, F.col("p_size") >= F.col("least")).select("p_partkey", "p_size")


@query("SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_extendedprice DESC, l_linenumber")
def distinct_on(t):
    best = F.max_by(F.struct("l_linenumber", "l_partkey"), F.struct("l_extendedprice", -F.col("l_linenumber")))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.*")


_A, _B = (f"SELECT {x}_nationkey * 100 + CAST(floor({x}_acctbal / 1000) AS BIGINT) AS k FROM {table}" for x, table in (("c", "customer"), ("s", "supplier")))


def _arms(t):
    """Nation and thousands of the balance, of customers and of suppliers."""
    key = lambda df, x: df.select((F.col(f"{x}_nationkey") * 100 + F.floor(F.col(f"{x}_acctbal") / 1000)).alias("k"))
    return key(t.customer, "c"), key(t.supplier, "s")


@query(f"{_A} UNION ALL {_B}")
def set_union_all(t):
    a, b = _arms(t)
    return a.union(b)


@query(f"{_A} UNION {_B}")
def set_union(t):
    a, b = _arms(t)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def set_intersect(t):
    a, b = _arms(t)
    return a.intersect(b)


@query(f"{_A} INTERSECT ALL {_B}")
def set_intersect_all(t):
    a, b = _arms(t)
    return a.intersectAll(b)


@query(f"{_A} EXCEPT {_B}")
def set_except(t):
    a, b = _arms(t)
    return a.subtract(b)


@query(f"{_A} EXCEPT ALL {_B}")
def set_except_all(t):
    a, b = _arms(t)
    return a.exceptAll(b)


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS m FROM customer")
def subquery_scalar(t):
    per = t.orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("m"))
    return t.customer.join(per, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "m")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM orders)")
def subquery_compare(t):
    mean = t.orders.agg((F.avg("o_totalprice") * 1.8).alias("m"))
    return t.orders.join(mean, F.col("o_totalprice") > F.col("m")).select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%')")
def subquery_in(t):
    n = t.nation.join(t.region.filter("r_name LIKE 'A%'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("SELECT p_partkey FROM part p WHERE p_retailprice >= ALL (SELECT q.p_retailprice FROM part q WHERE q.p_brand = p.p_brand)")
def subquery_all(t):
    best = t.part.groupBy(F.col("p_brand").alias("b")).agg(F.max("p_retailprice").alias("m"))
    return t.part.join(best, (F.col("p_brand") == F.col("b")) & (F.col("p_retailprice") >= F.col("m"))).select("p_partkey")


@query("WITH RECURSIVE r(k, n, steps) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT k, n // 2, steps + 1 FROM r WHERE n > 1) SELECT k, n, steps FROM r")
def recursive_numbers(t):
    """Each part's number halved until it is one: a recursion from all rows of a table, by the traversal that cuts each level."""
    p = t.part.select(F.col("p_partkey").alias("k"))
    links = p.filter("k > 1").select(F.col("k").alias("parent"), F.floor(F.col("k") / 2).cast("long").alias("child"))
    return hierarchy.traverse(links, p.withColumnRenamed("k", "id")).select(F.get("path", 0).alias("k"), F.col("id").alias("n"), F.col("level").alias("steps"))


# ---- writes, as the rows they leave ----


@query("""SELECT coalesce(c.c_custkey, u.k) AS k, coalesce(u.v, c.c_acctbal) AS v, CASE WHEN c.c_custkey IS NULL THEN 'insert' WHEN u.k IS NULL THEN 'keep' ELSE 'update' END AS act
FROM customer c FULL JOIN (SELECT o_custkey + 5 AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) u ON c.c_custkey = u.k""")
def merge_result(t):
    u = t.orders.filter("o_orderstatus = 'O'").groupBy((F.col("o_custkey") + 5).alias("k0")).agg(F.max("o_totalprice").alias("v0"))
    df = t.customer.join(u, F.col("c_custkey") == F.col("k0"), "full")
    act = F.when(F.col("c_custkey").isNull(), "insert").when(F.col("k0").isNull(), "keep").otherwise("update")
    return df.select(F.coalesce("c_custkey", "k0").alias("k"), F.coalesce("v0", "c_acctbal").alias("v"), act.alias("act"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0 AND c_custkey = o_custkey)")
def delete_survivors(t):
    return t.orders.join(t.customer.filter("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("""SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events""")
def history_intervals(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_type", F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY 1""")
def history_as_of(t):
    return t.events.filter("ts <= TIMESTAMP '2024-01-15'").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


# ---- nested and semi-structured values, scalar functions ----


@query("SELECT label, i, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2")
def explode_positions(t):
    return t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("x"), 5).alias("mean"))


@query("SELECT event_type, sum(CAST(props ->> '$.k' AS BIGINT)) AS total, count(props ->> '$.missing') AS none FROM events GROUP BY 1")
def json_paths(t):
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"), F.count(F.get_json_object("props", "$.missing")).alias("none"))


@query("""SELECT p_partkey, upper(p_name) AS up, substr(p_name, 1, 4) AS head, length(p_type) AS n, replace(p_brand, '#', '-') AS brand, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, split_part(p_type, ' ', 1) AS first_word,
concat_ws('/', p_brand, p_type) AS joined, instr(p_name, 'a') AS at_a, reverse(p_brand) AS rev, trim('  x ') AS trimmed, starts_with(p_type, 'S') AS s FROM part""")
def scalar_text(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), F.substring("p_name", 1, 4).alias("head"), F.length("p_type").alias("n"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"),
        F.lpad(F.col("p_size").cast("string"), 5, "0").alias("padded"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("first_word"), F.concat_ws("/", "p_brand", "p_type").alias("joined"),
        F.instr("p_name", "a").alias("at_a"), F.reverse("p_brand").alias("rev"), F.trim(F.lit("  x ")).alias("trimmed"), F.startswith("p_type", F.lit("S")).alias("s"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS start, CAST(last_day(o_orderdate) AS DATE) AS stop,
date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM orders""")
def scalar_dates(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.quarter(d).alias("q"), F.dayofyear(d).alias("d"), F.trunc(d, "month").alias("start"), F.last_day(d).alias("stop"),
        F.datediff(F.to_date(d), F.lit("1992-01-01").cast("date")).alias("days"), F.date_format(d, "yyyy-MM").alias("ym"))


@query("""SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) < 0.03 AS close, CAST(floor(l_quantity / 7) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) % 7 AS r, round(sqrt(l_quantity), 6) AS s,
greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS l, nullif(l_tax, 0) AS nz, coalesce(nullif(l_discount, 0), l_tax) AS cd, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size, bit_count(CAST(l_quantity AS BIGINT)) AS bits FROM lineitem""")
def scalar_numbers(t):
    q, tax, dis = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.abs(tax - dis) < 0.03).alias("close"), F.floor(q / 7).alias("f"), F.ceil(q / 7).alias("c"), (q.cast("long") % 7).alias("r"), F.round(F.sqrt(q), 6).alias("s"),
        F.greatest(tax, dis).alias("g"), F.least(tax, dis).alias("l"), F.nullif(tax, F.lit(0.0)).alias("nz"), F.coalesce(F.nullif(dis, F.lit(0.0)), tax).alias("cd"), F.when(q > 25, "big").otherwise("small").alias("size"),
        F.bit_count(q.cast("long")).alias("bits"))


@query("""SELECT vec_id, len(embedding) AS n, round(list_sum(embedding), 4) AS total, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_sum(list_transform(embedding, lambda x: x * x)), 4) AS norm2 FROM embeddings""")
def array_functions(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), F.round(add(e), 4).alias("total"), F.round(F.array_max(e), 6).alias("top"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.round(add(F.transform(e, lambda x: x * x)), 4).alias("norm2"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice BETWEEN 50000 AND 150000 AND o_orderstatus IN ('F', 'O') AND o_orderstatus IS DISTINCT FROM 'P' AND NOT regexp_matches(o_orderpriority, 'LOW$')""")
def predicates(t):
    p = F.col("o_orderpriority").like("1%") & F.col("o_totalprice").between(50000, 150000) & F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderstatus").eqNullSafe("P") & ~F.col("o_orderpriority").rlike("LOW$")
    return t.orders.filter(p).select("o_orderkey")


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def time_windows(t):
    return t.events.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(t):
    """Two tables of five rows; the only cross product here."""
    return t.region.select(F.col("r_name").alias("a")).crossJoin(t.region.select(F.col("r_name").alias("b")))


@query("SELECT n_name, kind FROM nation JOIN (VALUES (0, 'near'), (1, 'far'), (3, 'far')) v(k, kind) ON n_regionkey = k")
def values_source(t):
    v = t.spark.sql("SELECT k, kind FROM VALUES (0, 'near'), (1, 'far'), (3, 'far') v(k, kind)")
    return t.nation.join(v, F.col("n_regionkey") == F.col("k")).select("n_name", "kind")


@query("SELECT key AS k, count(*) AS n, sum(CAST(json_each.value AS BIGINT)) AS total FROM events, json_each(props) GROUP BY 1")
def json_to_map(t):
    df = t.events.select(F.explode(F.from_json("props", "map<string,bigint>")).alias("k", "v"))
    return df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("SELECT p_partkey, md5(p_name) AS m, sha256(p_type) AS s, regexp_extract(p_type, '^(\\w+)', 1) AS w, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS masked, len(string_split(p_type, ' ')) AS n FROM part")
def scalar_regex_hash(t):
    return t.part.select("p_partkey", F.md5("p_name").alias("m"), F.sha2("p_type", 256).alias("s"), F.regexp_extract("p_type", r"^(\w+)", 1).alias("w"), F.regexp_replace("p_type", "[AEIOU]", "_").alias("masked"), F.size(F.split("p_type", " ")).alias("n"))


@query("SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def explode_words(t):
    return _word_counts(t.documents.select("doc_id", F.explode(F.split("text", " ", -1)).alias("w")))


@query("SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def explode_words_all(t):
    """explode_words, which takes words of any length too; the name stays for its users."""
    return explode_words(t)


def _word_counts(df):
    # Words per document are counted first, so a word's documents need no distinct over all its rows.
    return df.groupBy("w", "doc_id").agg(F.count("*").alias("c")).groupBy("w").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority LIKE '1%' THEN 'urgent' END AS target FROM orders
WHERE o_totalprice > 200000 OR o_orderstatus = 'F' OR o_orderpriority LIKE '1%'""")
def insert_first(t):
    """Rows to the first target whose condition holds, as one pass that names the target."""
    target = F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderpriority").like("1%"), "urgent")
    return t.orders.select("o_orderkey", target.alias("target")).filter("target IS NOT NULL")


@query("""SELECT o_orderkey, 'large' AS target FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'closed' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority LIKE '1%'""")
def insert_all(t):
    """Rows to every target whose condition holds: the source is read once and each row is spread over its targets."""
    arms = (F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderstatus") == "F", "closed"), F.when(F.col("o_orderpriority").like("1%"), "urgent"))
    return t.orders.select("o_orderkey", F.explode(F.array_compact(F.array(*arms))).alias("target"))


@query("""SELECT o_orderkey, o_totalprice * CASE WHEN c_acctbal < 0 THEN 0.9 ELSE 1 END AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def update_from(t):
    factor = F.when(F.col("c_acctbal") < 0, 0.9).otherwise(1.0)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", (F.col("o_totalprice") * factor).alias("price"))


@query("""SELECT o_orderkey, CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS later, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, isodow(o_orderdate) AS dow, hour(o_orderdate) AS h, make_date(year(o_orderdate), 1, 1) AS new_year,
CASE WHEN o_orderdate >= TIMESTAMP '1995-01-01' THEN 'new' ELSE 'old' END AS age FROM orders""")
def scalar_date_arithmetic(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.add_months(d, 3).alias("later"), F.trunc(d, "week").alias("week"), (F.weekday(d) + 1).alias("dow"), F.hour(d).alias("h"), F.make_date(F.year(d), F.lit(1), F.lit(1)).alias("new_year"), F.when(d >= F.lit("1995-01-01").cast("timestamp_ntz"), "new").otherwise("old").alias("age"))


@query("""SELECT l_suppkey, histogram[1] AS low, histogram[2] AS mid, histogram[3] AS high FROM (SELECT l_suppkey, [count(*) FILTER (l_quantity <= 10), count(*) FILTER (l_quantity > 10 AND l_quantity <= 40), count(*) FILTER (l_quantity > 40)] AS histogram FROM lineitem GROUP BY 1)""")
def agg_histogram(t):
    q = F.col("l_quantity")
    n = lambda p, name: F.count(F.when(p, 1)).alias(name)
    return t.lineitem.groupBy("l_suppkey").agg(n(q <= 10, "low"), n((q > 10) & (q <= 40), "mid"), n(q > 40, "high"))


@query("""SELECT n_nationkey, coalesce(o.n, 0) AS n_orders, coalesce(s.n, 0) AS n_suppliers FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON n_nationkey = c_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey""")
def join_pre_aggregated(t):
    """Each side is summed to its key before it is joined, so no side multiplies the other."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("no"))
    s = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("ns"))
    df = t.nation.join(o, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return df.select("n_nationkey", F.coalesce("no", F.lit(0)).alias("n_orders"), F.coalesce("ns", F.lit(0)).alias("n_suppliers"))


# ---- samples, casts, structs, named parts of a statement ----


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 4) AS INT) < 6554")
def sample_rows(t):
    """A tenth of the rows by a digest of their key: the same rows whatever the partitions, which sample() doesn't promise."""
    share = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4), 16, 10).cast("int")
    return t.orders.filter(share < 6554).select("o_orderkey", "o_totalprice")


@query("""SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, CAST(value AS VARCHAR) = CAST(CAST(CAST(value AS VARCHAR) AS DOUBLE) AS VARCHAR) AS same, CAST(value AS DECIMAL(12, 2)) AS amount, CAST(ts AS DATE) AS day, try_cast(event_type AS INT) AS no_number FROM events""")
def casts(t):
    k = F.expr("try_cast(get_json_object(props, '$.k') AS INT)")
    text = F.col("value").cast("string")
    return t.events.select("event_id", k.alias("k"), (text == text.cast("double").cast("string")).alias("same"), F.col("value").cast("decimal(12,2)").alias("amount"), F.col("ts").cast("date").alias("day"), F.expr("try_cast(event_type AS INT)").alias("no_number"))


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def whole_row(t):
    """A row as one value that is joined, filtered by a field, and taken apart again."""
    c = t.customer.select(F.struct("*").alias("c")).join(t.nation.select(F.struct("*").alias("n")), F.col("c.c_nationkey") == F.col("n.n_nationkey"))
    return c.filter("c.c_acctbal > 0").select("c.c_custkey", F.col("c.c_name").alias("name"), F.col("c.c_acctbal").alias("balance"), F.col("n.n_name").alias("nation"))


@query("SELECT s.*, n_name FROM supplier s JOIN nation ON s_nationkey = n_nationkey")
def select_star(t):
    return t.supplier.alias("s").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s.*", "n_name")


@query("""SELECT o_orderkey, sum(o_totalprice) OVER w AS running, count(*) OVER w AS n, row_number() OVER v AS place FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def window_named(t):
    """Two windows, each defined once and used where it is needed."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_orderkey", F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.count("*").over(w).alias("n"), F.row_number().over(v).alias("place"))


@query("""WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1), mean AS (SELECT avg(total) AS m FROM spent)
SELECT o_custkey, round(total, 2) AS total FROM spent, mean WHERE total > m""")
def with_tables(t):
    """A named table that two others use; the mean is one row."""
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    mean = spent.agg(F.avg("total").alias("m"))
    return spent.join(F.broadcast(mean), F.col("total") > F.col("m")).select("o_custkey", F.round("total", 2).alias("total"))


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r <= 2""")
def join_ranked(t):
    """A rank that cuts inside the join's condition: customers without orders stay."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.customer.join(t.orders.withColumn("r", r).filter("r <= 2"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT o_custkey, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1")
def create_table_as(t):
    """A query's result, written as a table and read again."""
    made = cut(t.orders.select("o_custkey", "o_orderpriority").distinct(), "created")
    return made.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) UNION ALL (SELECT * FROM (VALUES (-1), (-2)) v(k) INTERSECT SELECT -1)""")
def set_nested(t):
    """Arms of set operations that are set operations, and VALUES."""
    c = t.customer
    poor = c.filter("c_acctbal < 0").select("c_custkey").union(c.filter("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()
    values = t.spark.createDataFrame([(-1,), (-2,)], "k long")
    return t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).subtract(poor).union(values.intersect(values.filter("k = -1")))


@query("""WITH x AS (SELECT s_suppkey, '<s><name>' || s_name || '</name><at nation="' || s_nationkey || '"/>' || repeat('<at/>', CAST(s_suppkey % 3 AS INT)) || '</s>' AS x FROM supplier)
SELECT s_suppkey, regexp_extract(x, '<name>([^<]*)</name>', 1) AS name, CAST(regexp_extract(x, 'nation="([0-9]+)"', 1) AS BIGINT) AS nation, CAST(len(regexp_extract_all(x, '<at')) AS INTEGER) AS n FROM x""")
def xml_paths(t):
    """Texts, attributes and counts read from XML by path."""
    doc = F.concat(F.lit("<s><name>"), "s_name", F.lit('</name><at nation="'), "s_nationkey", F.lit('"/>'), F.repeat(F.lit("<at/>"), (F.col("s_suppkey") % 3).cast("int")), F.lit("</s>"))
    x = t.supplier.select("s_suppkey", doc.alias("x"))
    return x.select("s_suppkey", F.xpath_string("x", F.lit("s/name")).alias("name"), F.xpath_long("x", F.lit("s/at[1]/@nation")).alias("nation"), F.xpath_int("x", F.lit("count(s/at)")).alias("n"))


@query("""SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand, greatest(p_size, 10) AS at_least, CASE WHEN p_size % 2 = 0 THEN 'even' WHEN p_size > 25 THEN 'large' END AS kind,
p_size BETWEEN 10 AND 20 AS mid, p_type LIKE '%A%' AS has_a, p_size IN (1, 5, 9) AS listed, p_name IS DISTINCT FROM p_type AS differs FROM part""")
def conditionals(t):
    p = F.col
    kind = F.when(p("p_size") % 2 == 0, "even").when(p("p_size") > 25, "large")
    return t.part.select("p_partkey", F.coalesce(F.nullif("p_brand", F.lit("Brand#1")), F.lit("none")).alias("brand"), F.greatest("p_size", F.lit(10)).alias("at_least"), kind.alias("kind"), p("p_size").between(10, 20).alias("mid"), p("p_type").like("%A%").alias("has_a"), p("p_size").isin(1, 5, 9).alias("listed"), (~p("p_name").eqNullSafe(p("p_type"))).alias("differs"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS any_p, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice <= 1000) AS all_dear,
(SELECT string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS priorities FROM customer""")
def subquery_quantified(t):
    """ANY, ALL and ARRAY over a customer's orders: one grouping and one join."""
    o = t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("p"), F.bool_and(F.col("o_totalprice") > 1000).alias("d"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("p", F.lit(False)).alias("any_p"), F.coalesce("d", F.lit(True)).alias("all_dear"), "priorities")


@query("""SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med, min(o_orderstatus) AS least, count(DISTINCT o_custkey) AS customers, stddev_samp(o_totalprice) AS sd, corr(o_totalprice, o_custkey) AS c, bool_or(o_totalprice > 400000) AS any_dear FROM orders GROUP BY 1""")
def agg_statistics(t):
    o = F.col("o_totalprice")
    return t.orders.groupBy("o_orderpriority").agg(F.percentile(o, F.lit(0.25)).alias("q1"), F.median(o).alias("med"), F.min("o_orderstatus").alias("least"), F.countDistinct("o_custkey").alias("customers"), F.stddev_samp(o).alias("sd"), F.corr("o_totalprice", "o_custkey").alias("c"), F.bool_or(o > 400000).alias("any_dear"))


@query("""SELECT p_partkey, (p_partkey * 7) % 13 AS m, round(sqrt(p_retailprice), 6) AS root, floor(p_retailprice / 3) AS f, ceil(p_retailprice / 3) AS c, sign(p_size - 25) AS s, bit_count(p_partkey) AS bits, p_partkey & 6 AS masked, round(ln(p_retailprice), 6) AS l, round(pi() * p_size, 4) AS area FROM part""")
def scalar_math(t):
    p = F.col
    return t.part.select("p_partkey", ((p("p_partkey") * 7) % 13).alias("m"), F.round(F.sqrt("p_retailprice"), 6).alias("root"), F.floor(p("p_retailprice") / 3).cast("double").alias("f"), F.ceil(p("p_retailprice") / 3).cast("double").alias("c"), F.signum(p("p_size") - 25).alias("s"), F.bit_count("p_partkey").alias("bits"), p("p_partkey").bitwiseAND(6).alias("masked"), F.round(F.log("p_retailprice"), 6).alias("l"), F.round(F.pi() * p("p_size"), 4).alias("area"))


@query("""SELECT p_partkey, reverse(p_name) AS r, left(p_name, 3) AS l, right(p_name, 2) AS e, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, position('a' IN p_name) AS at, upper(p_name) AS u, length(p_name) AS n, repeat('x', p_size % 4) AS x, translate(p_name, 'abc', 'xyz') AS t, split_part(p_type, ' ', 1) AS head, starts_with(p_name, 'a') AS a, md5(p_name) AS digest, concat_ws('-', p_brand, p_size) AS joined FROM part""")
def scalar_strings(t):
    p = F.col
    return t.part.select(
        "p_partkey", F.reverse("p_name").alias("r"), F.left("p_name", F.lit(3)).alias("l"), F.right("p_name", F.lit(2)).alias("e"), F.lpad(p("p_size").cast("string"), 5, "0").alias("padded"), F.instr("p_name", "a").alias("at"), F.upper("p_name").alias("u"),
        F.length("p_name").alias("n"), F.repeat(F.lit("x"), p("p_size") % 4).alias("x"), F.translate("p_name", "abc", "xyz").alias("t"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"), p("p_name").startswith("a").alias("a"), F.md5("p_name").alias("digest"), F.concat_ws("-", "p_brand", "p_size").alias("joined"),
    )


@query("""SELECT event_id, date_trunc('month', ts) AS month, extract(dow FROM ts) AS dow, extract(quarter FROM ts) AS quarter, CAST(ts AS DATE) + INTERVAL 10 DAY AS later, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days, last_day(CAST(ts AS DATE)) AS month_end, strftime(ts, '%Y/%m/%d %H:%M') AS told FROM events""")
def scalar_times(t):
    day = F.to_date("ts")
    return t.events.select(
        "event_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), (F.dayofweek("ts") - 1).alias("dow"), F.quarter("ts").alias("quarter"), F.date_add(day, 10).cast("timestamp_ntz").alias("later"),
        F.datediff(day, F.lit("2024-01-01").cast("date")).alias("days"), F.last_day(day).alias("month_end"), F.date_format("ts", "yyyy/MM/dd HH:mm").alias("told"),
    )


@query("""WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1) SELECT o_custkey, len(k) AS n, k[1] AS first, list_contains(k, 7) AS has_7, list_sum(list_filter(k, lambda x: x % 2 = 0)) AS evens, list_sum(list_transform(k, lambda x: x * 2)) AS doubled, k[2:3] AS part, list_max(k) AS top FROM a""")
def array_lambdas(t):
    a = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    even = F.filter("k", lambda x: x % 2 == 0)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    return a.select("o_custkey", F.size("k").alias("n"), F.get("k", 0).alias("first"), F.array_contains("k", 7).alias("has_7"), F.when(F.size(even) > 0, total(even)).alias("evens"), total(F.transform("k", lambda x: x * 2)).alias("doubled"), F.slice("k", 2, 2).alias("part"), F.array_max("k").alias("top"))


@query("""SELECT 'kept' AS side, o_orderstatus AS part, count(*) AS n, sum(o_orderkey) AS keys FROM (SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'F', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) GROUP BY 2
UNION ALL SELECT 'staged', 'F', count(*), sum(o_orderkey) FROM orders WHERE o_orderstatus = 'F'""")
def exchange_partition(t):
    """A table in partitions by status, of which F is exchanged for a staging table; both as they are read back from their folders."""
    top = f"{shared_dir(t.spark)}/exchange-{uuid.uuid4().hex}"
    kept, staged = f"{top}/kept", f"{top}/staged"
    o = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("part"))
    o.write.partitionBy("part").parquet(kept)
    o.filter("part = 'O' AND k % 2 = 0").select("k", F.lit("F").alias("part")).write.partitionBy("part").parquet(staged)
    facts_io.exchange_partition(t.spark, kept, staged, "part", "F")
    read = lambda side, path: t.spark.read.schema("k long, part string").parquet(path).groupBy(F.lit(side).alias("side"), "part").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))
    return read("kept", kept).unionByName(read("staged", staged))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def copy_file(t):
    """Rows copied to CSV files in the shared folder and from there, with their types."""
    path = f"{shared_dir(t.spark)}/copied-{uuid.uuid4().hex}"
    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    o.write.option("header", "true").csv(path)
    back = t.spark.read.schema(o.schema).option("header", "true").option("mode", "FAILFAST").csv(path)
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT 'nation.parquet' AS file, count(*) AS n, min(n_name) AS first FROM nation")
def system_columns(t):
    """The file that each row was read from."""
    return t.nation.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min("n_name").alias("first"))


@query("""WITH n AS (SELECT l_suppkey, l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, arg_max(v, (n, -v)) AS mode, max(n) AS n FROM n GROUP BY 1""")
def agg_mode(t):
    """The most frequent value in its order, as mode() WITHIN GROUP (ORDER BY ...): of equally frequent ones the first."""
    per = t.lineitem.groupBy("l_suppkey", F.col("l_quantity").alias("v")).agg(F.count("*").alias("n"))
    return per.groupBy("l_suppkey").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"), F.max("n").alias("n"))


@query("""WITH n AS (SELECT c_nationkey, c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}' AS object, string_agg('<s n="' || n || '">' || k || '</s>', '' ORDER BY k) AS xml FROM n GROUP BY 1""")
def agg_objects(t):
    """A JSON object and an XML fragment of each nation's segments, which are a few: counted before they are gathered."""
    per = t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("n"))
    every = F.array_sort(F.collect_list(F.struct("k", "n")))
    xml = F.transform("e", lambda x: F.concat(F.lit('<s n="'), x["n"], F.lit('">'), x["k"], F.lit("</s>")))
    return per.groupBy("c_nationkey").agg(every.alias("e")).select("c_nationkey", F.to_json(F.map_from_entries("e")).alias("object"), F.array_join(xml, "").alias("xml"))


@query("""SELECT doc_id, unnest(range(1, len(s) + 1)) AS no, length(unnest(s)) AS n_chars FROM (SELECT doc_id, string_split_regex(text, '[.!?]+[ \\n]*') AS s FROM documents WHERE text IS NOT NULL)""")
def explode_regexp(t):
    """Each text split at an expression, a row for each part with its subscript; null texts have none."""
    parts = t.documents.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", r"[.!?]+[ \n]*", -1)).alias("i", "s"))
    return parts.select("doc_id", (F.col("i") + 1).cast("long").alias("no"), F.char_length("s").cast("long").alias("n_chars"))
