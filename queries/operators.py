"""One query per operator over the provided tables, each next to its checking SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import dates as fd
from foliospark.functions import measures
from foliospark.functions import scalars as fs
from foliospark.operators import history, joins, pivot, reduction, rules, sets, skew, windows
from foliospark.operators.history import Months
from foliospark.plans import accounts, ladders, policy, tracking
from foliospark.sources import catalog, io, published
from queries import checking_values
from queries.oracle_steps import (
    channel_sql, cross_sql, ladder_sql, rollup_sql, waterfall_sql, with_inputs,
)
from queries.mapping import Inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def add(name: str, sql: str) -> Callable:
    """Registers a function of the tables under ``name``."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        SQL[name] = with_inputs(sql)
        return build

    return register


# ---- shared shapes ---------------------------------------------------------------------
def cells(t: Inputs, status: str | None = None) -> DataFrame:
    """Orders per customer (k) and month (m): largest price (v), number (n)."""
    o = t("orders") if status is None else t("orders").filter(c("o_orderstatus") == status)
    return o.groupBy(c("o_custkey").alias("k"), fd.month_start(c("o_orderdate").cast("date")).alias("m")).agg(
        F.max(F.floor("o_totalprice").cast("double")).alias("v"), F.count(F.lit(1)).alias("n")
    )


def cells_sql(where: str = "true") -> str:
    return f"""(SELECT o_custkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
      max(CAST(floor(o_totalprice) AS DOUBLE)) AS v, count(*) AS n FROM orders WHERE {where} GROUP BY 1, 2)"""


def order_days(t: Inputs) -> DataFrame:
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice", c("o_orderdate").cast("date").alias("d"))


DAYS = "(SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders)"


def line_days(t: Inputs) -> DataFrame:
    """Order lines with both their dates."""
    o = t("orders").select("o_orderkey", "o_custkey", c("o_orderdate").cast("date").alias("od"))
    l = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        c("l_shipdate").cast("date").alias("sd"),
    )
    return l.join(o, c("l_orderkey") == c("o_orderkey")).drop("o_orderkey")


LINES = """(SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, o_custkey,
  CAST(l_shipdate AS DATE) AS sd, CAST(o_orderdate AS DATE) AS od FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
KEY = ["l_orderkey", "l_linenumber"]


# ---- sources, projections, filters -----------------------------------------------------
@add("q_snapshot_in_list", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE))")
def _(t):
    kept = io.snapshots(t("orders"), "o_orderdate", fd.month_ends("1995-01-01", "2001-12-01"))
    return kept.select("o_orderkey", "o_custkey", "o_totalprice")


@add("q_snapshot_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def _(t):
    return io.date_range(t("lineitem"), "l_shipdate", "1996-01-01", "1997-12-31").select(*KEY, "l_quantity")


@add("q_replace_from_itself", """SELECT o_orderkey, o_totalprice * 4 AS price, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders
  WHERE o_orderstatus <> 'F'""")
def _(t):
    """A table by month that is replaced twice by a plan that reads it."""
    path = f"{io.stored_folder(t.spark)}/{uuid.uuid4().hex}"
    rows = t("orders").select("o_orderkey", "o_orderstatus", c("o_totalprice").alias("price"), fd.month_start(c("o_orderdate").cast("date")).alias("month"))
    published.publish(rows, path, "month")
    for dropped in ("F", "none"):
        before = published.read_published(t.spark, path)
        published.publish(before.filter(c("o_orderstatus") != dropped).withColumn("price", c("price") * 2), path, "month")
    published.clean(t.spark, path, keep=1, grace=0)
    return published.read_published(t.spark, path).drop("o_orderstatus")


@add("q_catalog_snapshots", """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority, count(*) AS n, sum(CAST(floor(o_totalprice) AS DOUBLE)) AS price
  FROM orders WHERE CAST(date_trunc('month', o_orderdate) AS DATE) IN (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) FROM lineitem WHERE l_linenumber = 7 AND l_quantity >= 49) GROUP BY ALL""")
def _(t):
    """A catalog table by month, of which only the months in a joined list are read."""
    rows = t("orders").select("o_orderpriority", F.floor("o_totalprice").cast("double").alias("price"), fd.month_start(c("o_orderdate").cast("date")).alias("month"))
    name = io.store_partitioned(rows, "orders_by_month", "month")
    dates = t("lineitem").filter((c("l_linenumber") == 7) & (c("l_quantity") >= 49)).select(fd.month_start(c("l_shipdate").cast("date")).alias("d"))
    kept = catalog.snapshots_listed(catalog.read_table(t.spark, name), "month", dates, "d")
    return kept.groupBy("month", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))


@add("q_project_rename", "SELECT o_orderkey AS id, o_custkey AS client, o_totalprice * 2 AS doubled FROM orders")
def _(t):
    return t("orders").select(c("O_ORDERKEY").alias("id"), c("o_custkey").alias("client"), (c("o_totalprice") * 2).alias("doubled"))


@add("q_star_plus", "SELECT *, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def _(t):
    return t("orders").select("*", fd.month_start(c("o_orderdate").cast("date")).alias("month"))


@add("q_star_except", "SELECT * EXCLUDE (p_name, p_type) FROM part")
def _(t):
    return io.read(t.spark, t.sf_dir, "part").drop("p_name", "p_type")


@add("q_const_flag", "SELECT c_custkey AS client, 1 AS listed, '' AS alternate FROM customer WHERE c_acctbal < 0")
def _(t):
    return t("customer").filter(c("c_acctbal") < 0).select(c("c_custkey").alias("client"), F.lit(1).alias("listed"), F.lit("").alias("alternate"))


@add("q_coalesce_shadow", """SELECT o_orderkey, coalesce(a, b) AS a, a AS a_before, coalesce(a, b) AS b
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders)""")
def _(t):
    rows = t("orders").select(
        "o_orderkey", F.when(c("o_orderkey") % 3 != 0, c("o_totalprice")).alias("a"), c("o_custkey").cast("double").alias("b")
    )
    return rows.select("o_orderkey", F.coalesce("a", "b").alias("a"), c("a").alias("a_before"), F.coalesce("a", "b").alias("b"))


@add("q_filter_compare", """SELECT l_orderkey, l_linenumber FROM lineitem
  WHERE l_quantity >= 10 AND l_discount < 0.05::DOUBLE AND l_returnflag <> 'A' AND l_shipdate > DATE '1996-06-30' AND l_linestatus = 'F'""")
def _(t):
    return t("lineitem").filter(
        (c("l_quantity") >= 10) & (c("l_discount") < 0.05) & (c("l_returnflag") != "A")
        & (c("l_shipdate") > fd.date_lit("1996-06-30")) & (c("l_linestatus") == "F")
    ).select(*KEY)


@add("q_filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(t):
    return t("orders").filter(c("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", "o_orderpriority")


@add("q_filter_not_in", """SELECT * FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS f FROM lineitem)
  WHERE f NOT IN ('A')""")
def _(t):
    f = F.when(c("l_linenumber") != 3, c("l_returnflag"))
    return t("lineitem").select(*KEY, f.alias("f")).filter(~c("f").isin("A"))


@add("q_null_tests", """SELECT n IS NULL AS missing, n IS NOT NULL AS present, count(*) AS rows
  FROM (SELECT CASE WHEN l_quantity > 10 THEN l_tax END AS n FROM lineitem) GROUP BY 1, 2""")
def _(t):
    n = F.when(c("l_quantity") > 10, c("l_tax"))
    return t("lineitem").select(n.alias("n")).groupBy(c("n").isNull().alias("missing"), c("n").isNotNull().alias("present")).agg(
        F.count(F.lit(1)).alias("rows")
    )


@add("q_exclude_test_rows", """SELECT l_orderkey, l_linenumber FROM lineitem
  WHERE l_returnflag <> 'A' OR l_linenumber <> 1 OR CASE WHEN l_quantity > 5 THEN l_tax END <> 0""")
def _(t):
    tax = F.when(c("l_quantity") > 5, c("l_tax"))
    real = measures.not_trial(c("l_returnflag"), c("l_linenumber"), tax, (F.lit("A"), F.lit(1), F.lit(0.0)))
    return t("lineitem").filter(real).select(*KEY)


@add("q_month_end_only", f"SELECT o_orderkey, d FROM {DAYS} WHERE month(d + 1) <> month(d)")
def _(t):
    return order_days(t).filter(fd.is_month_end("d")).select("o_orderkey", "d")


# ---- joins -----------------------------------------------------------------------------
@add("q_left_join_one", "SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def _(t):
    rich = t("customer").filter(c("c_acctbal") > 0).select(c("c_custkey").alias("o_custkey"), "c_name")
    return skew.skew_join(t("orders").select("o_orderkey", "o_custkey"), rich, ["o_custkey"]).drop("o_custkey")


@add("q_left_join_month", f"""SELECT a.k, a.m, a.v, b.v AS other FROM {cells_sql("o_orderstatus = 'F'")} a
  LEFT JOIN {cells_sql("o_orderstatus = 'O'")} b ON a.k = b.k AND a.m = b.m""")
def _(t):
    return skew.skew_join(cells(t, "F").drop("n"), cells(t, "O").select("k", "m", c("v").alias("other")), ["k", "m"])


@add("q_left_join_using", """SELECT o_custkey, o_orderkey, coalesce(listed, 0) AS listed FROM orders
  LEFT JOIN (SELECT c_custkey AS o_custkey, 1 AS listed FROM customer WHERE c_mktsegment = 'BUILDING') USING (o_custkey)""")
def _(t):
    listed = t("customer").filter(c("c_mktsegment") == "BUILDING").select(c("c_custkey").alias("o_custkey"), F.lit(1).alias("listed"))
    joined = skew.skew_join(t("orders").select("o_custkey", "o_orderkey"), listed, ["o_custkey"])
    return joined.select("o_custkey", "o_orderkey", fs.or_zero("listed").alias("listed"))


@add("q_left_notnull_inner", """SELECT c_custkey, c_name, o_orderkey FROM customer
  LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON o_custkey = c_custkey WHERE o_orderkey IS NOT NULL""")
def _(t):
    big = t("orders").filter(c("o_totalprice") > 300000).select(c("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.matched(t("customer").select("c_custkey", "c_name"), big, ["c_custkey"])


@add("q_match_flag", """SELECT c_custkey, CASE WHEN EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
  THEN 'Con pedido' ELSE 'Sin pedido' END AS mark FROM customer""")
def _(t):
    big = t("orders").filter(c("o_totalprice") > 450000).select(c("o_custkey").alias("c_custkey")).distinct()
    joined = skew.skew_join(t("customer").select("c_custkey"), big.withColumn("__hit", F.lit(1)), ["c_custkey"])
    return joined.select("c_custkey", F.when(c("__hit").isNull(), "Sin pedido").otherwise("Con pedido").alias("mark"))


@add("q_lagged_join", f"""SELECT a.k, a.m, a.v, b.v AS before FROM {cells_sql()} a
  LEFT JOIN {cells_sql()} b ON a.k = b.k AND date_diff('month', b.m, a.m) = 1""")
def _(t):
    month = cells(t).drop("n")
    return skew.skew_join(month, joins.shift_month(month, "m", 1).withColumnRenamed("v", "before"), ["k", "m"])


@add("q_vintage_horizons", f"""SELECT k, m, max(exact) FILTER (h = 2) AS v02, max(top) FILTER (h = 2) AS top02, max(seen) FILTER (h = 2) AS seen02,
    max(exact) FILTER (h = 3) AS v03, max(top) FILTER (h = 3) AS top03, max(seen) FILTER (h = 3) AS seen03,
    max(exact) FILTER (h = 6) AS v06, max(top) FILTER (h = 6) AS top06, max(seen) FILTER (h = 6) AS seen06,
    max(exact) FILTER (h = 12) AS v12, max(top) FILTER (h = 12) AS top12, max(seen) FILTER (h = 12) AS seen12
  FROM (SELECT a.k, a.m, h, max(CASE WHEN date_diff('month', a.m, b.m) = h THEN b.v ELSE 0 END) AS exact, max(b.v) AS top,
      count(DISTINCT b.m) AS seen FROM {cells_sql()} a CROSS JOIN (VALUES (2), (3), (6), (12)) x(h)
    JOIN {cells_sql()} b ON a.k = b.k AND date_diff('month', a.m, b.m) BETWEEN 0 AND h GROUP BY a.k, a.m, h)
  GROUP BY k, m""")
def _(t):
    month = cells(t)
    horizons = {h: {f"v{h:02d}": ("v", "at"), f"top{h:02d}": ("v", "max")} for h in (2, 3, 6, 12)}
    seen = {h: f"seen{h:02d}" for h in horizons}
    return joins.outcome_window(month, month, ["k", "m"], "k", "m", horizons, seen)


def _trailing_sql(months: int) -> str:
    return f"""SELECT a.k, a.m, sum(b.v) AS total, sum(b.v) / count(*) AS average, count(*) AS months, CAST(sum(b.n) AS BIGINT) AS orders
      FROM {cells_sql()} a JOIN {cells_sql()} b ON a.k = b.k AND date_diff('month', b.m, a.m) BETWEEN 0 AND {months - 1} GROUP BY a.k, a.m"""


def _trailing(t: Inputs, months: int) -> DataFrame:
    out = windows.trailing(
        cells(t).withColumn("one", F.lit(1)), ["k"], "m", months, {"total": "v", "months": "one", "orders": "n"}
    )
    return out.select("k", "m", "total", (c("total") / c("months")).alias("average"), "months", "orders")


add("q_trailing_3m", _trailing_sql(3))(lambda t: _trailing(t, 3))
add("q_trailing_6m", _trailing_sql(6))(lambda t: _trailing(t, 6))

HISTORY = Months(dt.date(1992, 1, 1), dt.date(2002, 12, 1))


@add("q_history_horizons", f"""SELECT a.k, a.m, count(DISTINCT b.m) FILTER (b.m <= CAST(a.m + INTERVAL 3 MONTH AS DATE)) AS seen_3, count(DISTINCT b.m) AS seen_40,
  coalesce(max(CASE WHEN b.v >= 200000 AND b.m <= CAST(a.m + INTERVAL 12 MONTH AS DATE) THEN 1 END), 0) AS high_12,
  max(b.v) FILTER (b.m = CAST(a.m + INTERVAL 6 MONTH AS DATE)) AS price_6
  FROM {cells_sql()} a JOIN {cells_sql()} b ON b.k = a.k AND b.m BETWEEN a.m AND CAST(a.m + INTERVAL 40 MONTH AS DATE) GROUP BY a.k, a.m""")
def _(t):
    """Months ahead of every month of a customer, from one packed history of each."""
    rows = cells(t)
    histories = history.packed(rows, "k", "m", HISTORY, {"high": c("v") >= 200000}, {"price": c("v")})
    asked = rows.select("k", "m").join(histories, "k").withColumn("at", HISTORY.place("m"))
    count = lambda h: F.bit_count(history.ahead("seen", "at", h)).cast("bigint").alias(f"seen_{h}")
    return asked.select("k", "m", count(3), count(40), fs.flag(history.ahead("high", "at", 12) != 0).alias("high_12"), history.amount_at("price", "at", 6).alias("price_6"))


REDUCED_SQL = """SELECT o_custkey, count(*) AS n, max(o_totalprice) AS price FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey"""


def reduced(t: Inputs, policy: reduction.ReductionPolicy) -> DataFrame:
    """Sums of the orders of few customers; others are held back before the grouping's shuffle, what slips through is joined away after."""
    few = t("customer").filter(c("c_acctbal") < 0).select(c("c_custkey").alias("o_custkey"))
    orders = reduction.key_filter(few, "o_custkey", policy).reduce(t("orders").select("o_custkey", "o_totalprice"), "o_custkey")
    sums = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("price"))
    return sums.join(few, "o_custkey")


@add("q_reduce_by_keys", REDUCED_SQL)
def _(t):
    return reduced(t, reduction.ReductionPolicy())


@add("q_reduce_by_bloom_filter", REDUCED_SQL)
def _(t):
    return reduced(t, reduction.ReductionPolicy(exact_keys=0))



def _asof_sql(limit: str) -> str:
    return f"""SELECT k, m, v FROM (SELECT a.k, a.m, b.v, row_number() OVER (PARTITION BY a.k, a.m ORDER BY b.m DESC NULLS LAST) AS r
      FROM {cells_sql("o_orderstatus = 'F'")} a LEFT JOIN {cells_sql("o_orderstatus = 'O'")} b ON a.k = b.k AND b.m <= a.m {limit}) WHERE r = 1"""


add("q_asof_within_12m", _asof_sql("AND date_diff('month', b.m, a.m) <= 12"))(
    lambda t: joins.asof_within(cells(t, "F"), cells(t, "O"), "k", "m", "v", 12)
)
add("q_asof_latest", _asof_sql(""))(lambda t: joins.asof_within(cells(t, "F"), cells(t, "O"), "k", "m", "v", None))


@add("q_event_before_deadline", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate <= o_orderdate + INTERVAL 1 MONTH""")
def _(t):
    due = t("orders").select(c("o_orderkey").alias("l_orderkey"), fd.add_months(c("o_orderdate").cast("date"), 1).alias("__limit"))
    events = t("lineitem").select(*KEY, "l_quantity", "l_shipdate")
    in_time = skew.skew_join(events, due, ["l_orderkey"], "inner", residual=lambda: c("l_shipdate") <= c("__limit"))
    return in_time.select(*KEY, "l_quantity")


def first_cells(t: Inputs) -> DataFrame:
    return windows.first_per(cells(t), ["k"], [c("m").asc()])


@add("q_cohort_follow_up", f"""SELECT a.k, a.m, b.m AS seen, b.v, date_diff('month', a.m, b.m) AS months
  FROM (SELECT k, CAST(min(m) + INTERVAL 2 MONTH AS DATE) AS m FROM {cells_sql()} GROUP BY k) a
  LEFT JOIN {cells_sql()} b ON a.k = b.k AND date_diff('month', a.m, b.m) >= -1""")
def _(t):
    base = joins.shift_month(first_cells(t).select("k", "m"), "m", 2)
    panel = cells(t).select("k", c("m").alias("seen"), "v")
    out = joins.follow_up(base, panel, "k", "m", "seen", -1)
    return out.withColumn("months", fd.month_diff("seen", "m"))


@add("q_star_enrich", f"""SELECT a.k, a.m, a.v, f.v AS v_f, o.v AS v_o, p.v AS v_p, u.c_name, u.c_mktsegment, x.events
  FROM {cells_sql()} a LEFT JOIN {cells_sql("o_orderstatus = 'F'")} f ON f.k = a.k AND f.m = a.m
  LEFT JOIN {cells_sql("o_orderstatus = 'O'")} o ON o.k = a.k AND date_diff('month', o.m, a.m) = 1
  LEFT JOIN {cells_sql("o_orderstatus = 'P'")} p ON p.k = a.k AND date_diff('month', p.m, a.m) = 2
  LEFT JOIN customer u ON u.c_custkey = a.k
  LEFT JOIN (SELECT user_id, count(*) AS events FROM events GROUP BY user_id) x ON x.user_id = a.k""")
def _(t):
    side = lambda status, n, name: joins.shift_month(cells(t, status).select("k", "m", c("v").alias(name)), "m", n)
    month, single = ["k", "m"], ["k"]
    return joins.enrich(
        cells(t).drop("n"),
        [
            (side("F", 0, "v_f"), month), (side("O", 1, "v_o"), month), (side("P", 2, "v_p"), month),
            (t("customer").select(c("c_custkey").alias("k"), "c_name", "c_mktsegment"), single),
            (t("events").groupBy(c("user_id").alias("k")).agg(F.count(F.lit(1)).alias("events")), single),
        ],
    )


@add("q_id_translate", """SELECT u.id, c_custkey AS client, u.events FROM (SELECT printf('Customer#%09d', user_id * 17) AS id, count(*) AS events FROM events GROUP BY 1) u
  LEFT JOIN customer ON c_name = u.id""")
def _(t):
    users = t("events").groupBy(F.format_string("Customer#%09d", c("user_id") * 17).alias("id")).agg(F.count(F.lit(1)).alias("events"))
    ids = t("customer").select(c("c_name").alias("id"), c("c_custkey").alias("client"))
    return joins.translate_id(users, ids, "id", "client")


# ---- aggregations ----------------------------------------------------------------------
@add("q_max_per_key", "SELECT l_partkey, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY l_partkey")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").cast("date").alias("last"))


@add("q_union_max", """SELECT client, CAST(max(d) AS DATE) AS last, 1 AS listed FROM (
    SELECT o_custkey AS client, max(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
    UNION ALL SELECT o_custkey, max(o_orderdate) FROM orders WHERE o_totalprice > 200000 GROUP BY 1
    UNION ALL SELECT user_id, max(ts) FROM events GROUP BY 1) GROUP BY client""")
def _(t):
    orders = t("orders").select(c("o_custkey").alias("client"), c("o_orderdate").alias("d"), "o_orderstatus", "o_totalprice")
    feeds = sets.union_all(
        orders.filter(c("o_orderstatus") == "F").select("client", "d"),
        orders.filter(c("o_totalprice") > 200000).select("client", "d"),
        t("events").select(c("user_id").alias("client"), c("ts").alias("d")),
    )
    return feeds.groupBy("client").agg(F.max("d").cast("date").alias("last"), F.lit(1).alias("listed"))


@add("q_sum_group", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, CAST(sum(CASE WHEN l_quantity > 60 THEN 1 END) AS BIGINT) AS never
  FROM lineitem GROUP BY 1, 2""")
def _(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("quantity"), F.sum(F.when(c("l_quantity") > 60, 1)).alias("never")
    )


@add("q_avg_group", "SELECT l_suppkey, avg(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey")
def _(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"))


@add("q_count_col", "SELECT l_returnflag, count(CASE WHEN l_quantity > 10 THEN l_tax END) AS taxed, count(*) AS rows FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(
        F.count(F.when(c("l_quantity") > 10, c("l_tax"))).alias("taxed"), F.count(F.lit(1)).alias("rows")
    )


@add("q_count_distinct", "SELECT o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.countDistinct(F.trunc(c("o_orderdate").cast("date"), "MONTH")).alias("months"))


@add("q_conditional_max", f"""SELECT o_custkey, max(CASE WHEN sd >= od + INTERVAL 2 MONTH THEN greatest(l_extendedprice - 50000, 0) ELSE 0 END) AS late,
    max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned FROM {LINES} GROUP BY 1""")
def _(t):
    late = c("sd") >= fd.add_months("od", 2)
    return line_days(t).groupBy("o_custkey").agg(
        F.max(F.when(late, fs.floor_zero(c("l_extendedprice") - 50000)).otherwise(0)).alias("late"),
        F.max(fs.flag(c("l_returnflag") == "R")).alias("returned"),
    )


@add("q_group_many_keys", """SELECT l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax, CAST(year(l_shipdate) AS INTEGER) AS y, count(*) AS n, sum(l_quantity) AS q
  FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6""")
def _(t):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", F.year("l_shipdate").alias("y")]
    return t("lineitem").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@add("q_group_distinct", "SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2")
def _(t):
    return t("lineitem").select("l_partkey", "l_suppkey").distinct()


@add("q_pivot_multi_agg", """SELECT y, """ + ", ".join(
    f"count(o_custkey) FILTER (s = '{s}') AS N_{s}, sum(price) FILTER (s = '{s}') AS price_{s}, CAST(sum(big) FILTER (s = '{s}') AS BIGINT) AS big_{s}" for s in "FOPX"
) + """ FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey, o_orderstatus AS s, CAST(floor(o_totalprice) AS DOUBLE) AS price,
    CAST(CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS BIGINT) AS big FROM orders) GROUP BY y""")
def _(t):
    rows = t("orders").select(
        F.year("o_orderdate").alias("y"), "o_custkey", c("o_orderstatus").alias("s"),
        F.floor("o_totalprice").cast("double").alias("price"), fs.flag(c("o_totalprice") > 300000).alias("big"),
    )
    return pivot.pivot_wide(rows, ["y"], "s", list("FOPX"), "o_custkey", "N", ["price", "big"])


# ---- windows ---------------------------------------------------------------------------
@add("q_lag_prev", f"SELECT k, m, v, lag(v) OVER (PARTITION BY k ORDER BY m) AS before FROM {cells_sql()}")
def _(t):
    return skew.previous_row(cells(t).drop("n"), ["k"], "m", {"before": "v"})


@add("q_change_direction", f"""SELECT k, m, CASE WHEN v > p THEN 'Aumento' WHEN v < p THEN 'Disminuyo' ELSE '' END AS change
  FROM (SELECT k, m, v, lag(v) OVER (PARTITION BY k ORDER BY m) AS p FROM {cells_sql()})""")
def _(t):
    seen = skew.previous_row(cells(t).drop("n"), ["k"], "m", {"p": "v"})
    arms = [(c("v") > c("p"), "Aumento"), (c("v") < c("p"), "Disminuyo")]
    return seen.select("k", "m", rules.first_true(arms, "").alias("change"))


@add("q_first_event", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, d FROM (SELECT *, min(d) OVER (PARTITION BY o_custkey) AS first FROM " + DAYS + ") WHERE d = first GROUP BY o_custkey, d")
def _(t):
    return windows.first_per(order_days(t), ["o_custkey"], [c("d").asc(), c("o_orderkey").asc()]).select("o_custkey", "o_orderkey", "d")


@add("q_latest_record", """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def _(t):
    newest = [c("ts").desc_nulls_last(), c("event_id").desc()]
    return windows.first_per(t("events").drop("props"), ["user_id"], newest).select("user_id", "event_id", "event_type")


@add("q_first_n_events", """SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)
  WHERE r <= 10 AND event_type = 'error'""")
def _(t):
    early = windows.top_n(t("events").drop("props"), ["user_id"], [c("ts").asc(), c("event_id").asc()], 10)
    return early.filter(c("event_type") == "error").select("user_id", "event_id")


@add("q_dup_rank", f"""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', d) ORDER BY d DESC, o_orderkey) AS r FROM {DAYS}""")
def _(t):
    rows = order_days(t).select("o_custkey", "o_orderkey", "d", fd.month_start("d").alias("m"))
    return skew.row_numbers(rows, ["o_custkey", "m"], [("d", "desc"), ("o_orderkey", "asc")], "r").select("o_custkey", "o_orderkey", "r")


# ---- set operations --------------------------------------------------------------------
@add("q_union_all", "SELECT l_partkey AS id, l_shipdate AS d FROM lineitem UNION ALL SELECT o_custkey, o_orderdate FROM orders")
def _(t):
    return sets.union_all(
        t("lineitem").select(c("l_partkey").alias("id"), c("l_shipdate").alias("d")), t("orders").select("o_custkey", "o_orderdate")
    )


@add("q_union_distinct", """SELECT CAST(l_suppkey AS BIGINT) AS id, CAST(l_shipdate AS DATE) AS d, l_returnflag AS kind FROM lineitem
  UNION SELECT user_id, CAST(ts AS DATE), 'E' FROM events""")
def _(t):
    return sets.union_distinct(
        [("id", "bigint"), ("d", "date"), ("kind", "string")],
        t("lineitem").select("l_suppkey", "l_shipdate", "l_returnflag"), t("events").select("user_id", "ts", F.lit("E")),
    )


# ---- scalar functions ------------------------------------------------------------------
@add("q_ifnull", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_quantity > 10 THEN l_tax END, 0) AS tax FROM lineitem")
def _(t):
    return t("lineitem").select(*KEY, fs.or_zero(F.when(c("l_quantity") > 10, c("l_tax"))).alias("tax"))


@add("q_safe_cast", """SELECT event_id, try_cast(x AS BIGINT) AS n, try_cast(replace(x, 'k', '2024-01-0') AS DATE) AS d FROM (
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'k' || (event_id % 12) WHEN 2 THEN '' ELSE NULL END AS x FROM events)""")
def _(t):
    k = c("event_id") % 4
    x = F.when(k == 0, c("user_id").cast("string")).when(k == 1, F.concat(F.lit("k"), (c("event_id") % 12).cast("string"))).when(k == 2, "")
    rows = t("events").select("event_id", x.alias("x"))
    return rows.select("event_id", fs.safe_cast("x", "bigint").alias("n"), fs.safe_cast(F.replace("x", F.lit("k"), F.lit("2024-01-0")), "date").alias("d"))


@add("q_cast", "SELECT event_id, CAST(split_part(CAST(event_id * 3 AS VARCHAR), '.', 1) AS BIGINT) AS n, CAST(ts AS DATE) AS d, CAST(round(value) AS BIGINT) AS v FROM events")
def _(t):
    return t("events").select(
        "event_id", (c("event_id") * 3).cast("string").cast("bigint").alias("n"), c("ts").cast("date").alias("d"), fs.to_int("value").alias("v")
    )


@add("q_datetime_to_date", "SELECT event_id, CAST(ts AS DATE) AS d FROM events")
def _(t):
    return t("events").select("event_id", fd.datetime_text_to_date(c("ts").cast("string")).alias("d"))


@add("q_month_trunc", f"SELECT o_orderkey, CAST(make_date(year(d), month(d), 1) AS DATE) AS m FROM {DAYS}")
def _(t):
    return order_days(t).select("o_orderkey", fd.month_start("d").alias("m"))


@add("q_add_months", f"""SELECT o_orderkey, CAST(d + INTERVAL 1 MONTH AS DATE) AS plus1, CAST(d + INTERVAL 12 MONTH AS DATE) AS plus12,
  CAST(last_day(d) - INTERVAL 2 MONTH AS DATE) AS minus2 FROM {DAYS}""")
def _(t):
    return order_days(t).select(
        "o_orderkey", fd.add_months("d", 1).alias("plus1"), fd.add_months("d", 12).alias("plus12"), fd.add_months(F.last_day("d"), -2).alias("minus2")
    )


@add("q_month_diff", f"SELECT l_orderkey, l_linenumber, date_diff('month', od, sd) AS months FROM {LINES}")
def _(t):
    return line_days(t).select(*KEY, fd.month_diff("sd", "od").alias("months"))


@add("q_year_diff", f"SELECT l_orderkey, l_linenumber, date_diff('year', od, sd) AS years FROM {LINES}")
def _(t):
    return line_days(t).select(*KEY, fd.year_diff("sd", "od").alias("years"))


@add("q_day_diff", f"SELECT l_orderkey, l_linenumber, sd - od AS days FROM {LINES}")
def _(t):
    return line_days(t).select(*KEY, fd.day_diff("sd", "od").alias("days"))


@add("q_greatest_floor", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS balance FROM customer")
def _(t):
    return t("customer").select("c_custkey", fs.floor_zero("c_acctbal").alias("balance"))


@add("q_least_nullstrict", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 4 THEN least(a, b) END AS least FROM (
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS a, CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS b FROM lineitem)""")
def _(t):
    a, b = fs.flag(c("l_quantity") > 25), fs.flag(c("l_tax") > 0)
    return t("lineitem").select(*KEY, fs.strict_least(a, F.when(c("l_linenumber") != 4, b)).alias("least"))


@add("q_concat_prefix", "SELECT p_partkey, '00' || p_brand AS padded FROM part")
def _(t):
    return io.read(t.spark, t.sf_dir, "part").select("p_partkey", fs.prefixed("00", "p_brand").alias("padded"))


@add("q_year_text_to_date", """SELECT o_orderkey, make_date(greatest(y, 1900), 1, 1) AS d FROM (
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN year(o_orderdate) - 1000 ELSE 0 END AS y FROM orders)""")
def _(t):
    k = c("o_orderkey") % 3
    y = F.year("o_orderdate")
    written = F.when(k == 0, y.cast("string")).when(k == 1, (y - 1000).cast("string"))
    return t("orders").select("o_orderkey", fd.year_text_to_date(written).alias("d"))


@add("q_clean_amount_text", """SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 2) THEN 0 ELSE p_retailprice END AS amount FROM part""")
def _(t):
    k, price = c("p_partkey") % 5, c("p_retailprice").cast("string")
    written = F.when(k == 0, "  ").when(k == 1, "null").when(k == 3, F.concat(F.lit("\t "), price, F.lit(" "))).when(k == 4, price)
    return io.read(t.spark, t.sf_dir, "part").select("p_partkey", fs.clean_amount(written).alias("amount"))


RATIO = "CASE WHEN a IS NULL OR a + b = 0 THEN -1 ELSE a / (a + b) END"
PAIR = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_discount * 100 END AS a, l_tax * 100 AS b FROM lineitem)"""


def ratio(t: Inputs) -> DataFrame:
    a, b = F.when(c("l_linenumber") != 2, c("l_discount") * 100), c("l_tax") * 100
    return t("lineitem").select(*KEY, fs.ratio_or(a, a + b, a.isNull(), -1.0).alias("ratio"))


add("q_ratio_guarded", f"SELECT l_orderkey, l_linenumber, {RATIO} AS ratio FROM {PAIR}")(ratio)


@add("q_code_map", """SELECT c_custkey, CAST(CASE c_nationkey WHEN 3 THEN 152 ELSE c_nationkey END AS BIGINT) AS number,
  CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 152 ELSE 999 END AS BIGINT) AS letter FROM customer""")
def _(t):
    written = F.when(c("c_nationkey") == 3, "CL").otherwise(c("c_nationkey").cast("string"))
    letter = F.when(c("c_mktsegment") == "BUILDING", "C").when(c("c_mktsegment") == "MACHINERY", "E")
    return t("customer").select(
        "c_custkey", fs.nationality_from_code(written).alias("number"), fs.nationality_from_letter(letter).alias("letter")
    )


@add("q_presence_flag", "SELECT c_custkey, CAST(c_acctbal > 0 AS INT) AS positive FROM customer")
def _(t):
    return t("customer").select("c_custkey", fs.flag(c("c_acctbal") > 0).alias("positive"))


# ---- rules -----------------------------------------------------------------------------
SCORE = "(l_partkey * 37 % 1024) / 2048.0::DOUBLE"


def _band(name: str, ladder: str, sql: str, value: Callable[[], Column]) -> None:
    """The band of one expression over the order lines, written in both languages."""
    add(name, f"SELECT l_orderkey, l_linenumber, {ladder_sql(ladder, 'x')} AS band FROM (SELECT l_orderkey, l_linenumber, {sql} AS x FROM lineitem)")(
        lambda t: t("lineitem").select(*KEY, value().alias("x")).select(*KEY, rules.band("x", getattr(ladders, ladder)).alias("band"))
    )


def _nulled(sql: str) -> str:
    return f"CASE WHEN l_linenumber <> 6 THEN {sql} END"


def _null(value):
    return F.when(c("l_linenumber") != 6, value)


def _score() -> Column:
    return (c("l_partkey") * 37 % 1024) / F.lit(2048.0)


_band("q_band_prob", "PROBABILITY", _nulled(SCORE), lambda: _null(_score()))
_band("q_band_pd", "PROBABILITY", SCORE, _score)
_band("q_band_debt", "CONSUMER_DEBT", "(l_quantity - 1) * floor(l_extendedprice)", lambda: (c("l_quantity") - 1) * F.floor("l_extendedprice"))
_band("q_band_ratio", "DEBT_RATIO", _nulled("CASE WHEN l_linenumber = 1 THEN -1 ELSE l_quantity / 40 END"), lambda: _null(F.when(c("l_linenumber") == 1, -1.0).otherwise(c("l_quantity") / 40)))
_band("q_band_limit", "LIMIT", _nulled("(l_quantity - 1) * 50000"), lambda: _null((c("l_quantity") - 1) * 50000))
_band("q_band_age", "AGE", _nulled("l_quantity * 20"), lambda: _null(c("l_quantity") * 20))
_band("q_band_income", "EVALUATED_INCOME", "(l_quantity - 1) * 50000", lambda: (c("l_quantity") - 1) * 50000)
_band("q_band_income_pilot", "PILOT_INCOME", "(l_quantity - 1) * 50000", lambda: (c("l_quantity") - 1) * 50000)
_band("q_band_wealth", "WEALTH", _nulled("(l_quantity - 1) * 2500000"), lambda: _null((c("l_quantity") - 1) * 2500000))


@add("q_band_dti", f"""SELECT l_orderkey, l_linenumber, CASE WHEN income = 0 THEN '00. Sin renta' ELSE {ladder_sql('DTI', 'dti')} END AS band
  FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE 1 END AS income,
      CASE WHEN l_linenumber <= 3 THEN -1 ELSE l_quantity / 20 END AS dti FROM lineitem)""")
def _(t):
    n = c("l_linenumber")
    rows = t("lineitem").select(
        *KEY, F.when(n == 1, 0).when(n > 2, 1).alias("income"), F.when(n <= 3, -1.0).otherwise(c("l_quantity") / 20).alias("dti")
    )
    return rows.select(*KEY, F.when(c("income") == 0, "00. Sin renta").otherwise(rules.band("dti", ladders.DTI)).alias("band"))


@add("q_band_regime", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < DATE '1998-08-01' THEN {ladder_sql('GRADE_BEFORE', 'x')}
    ELSE {ladder_sql('GRADE', 'x')} END AS grade FROM (SELECT *, {_nulled(SCORE)} AS x FROM lineitem)""")
def _(t):
    changed = c("l_shipdate") >= fd.date_lit("1998-08-01")
    return t("lineitem").select(*KEY, rules.band_by_regime(_null(_score()), changed, ladders.GRADE_BEFORE, ladders.GRADE).alias("grade"))


@add("q_code_category", """SELECT l_orderkey, l_linenumber, CASE WHEN n IN (1, 3, 5, 8, 15) THEN 'Independiente' WHEN n IN (2, 4, 6, 7, 9, 10, 14, 16) THEN 'Dependiente'
    WHEN n = 11 THEN 'Jubilado' WHEN n = 12 THEN 'Dueña de Casa' WHEN n = 13 THEN 'Estudiante' ELSE 'Otros' END AS job
  FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 20 THEN l_quantity END AS n FROM lineitem)""")
def _(t):
    written = F.when(c("l_quantity") < 20, c("l_quantity").cast("int").cast("string")).otherwise("x")
    code = fs.or_zero(fs.safe_cast(written, "bigint"))
    return t("lineitem").select(*KEY, rules.category(code, accounts.EMPLOYMENT, "Otros").alias("job"))


FLAGS = """(SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INT) AS MarcaBancarizadoU06M, CAST(l_tax > 0.04 AS INT) AS TenenciaPatrimonio,
  CAST(l_discount > 0.05 AS INT) AS TenenciaRetailML, CAST(l_linestatus = 'F' AS INT) AS AperturaWeb FROM lineitem)"""


def flags(t: Inputs) -> DataFrame:
    return t("lineitem").select(
        *KEY, fs.flag(c("l_quantity") > 25).alias("MarcaBancarizadoU06M"), fs.flag(c("l_tax") > 0.04).alias("TenenciaPatrimonio"),
        fs.flag(c("l_discount") > 0.05).alias("TenenciaRetailML"), fs.flag(c("l_linestatus") == "F").alias("AperturaWeb"),
    )


@add("q_segment_2x2", f"SELECT l_orderkey, l_linenumber, {channel_sql('MarcaBancarizadoU06M', 'Bancarizado')} AS segment FROM {FLAGS}")
def _(t):
    return flags(t).select(*KEY, rules.segment([c("MarcaBancarizadoU06M"), c("AperturaWeb")], tracking.by_channel("Bancarizado")).alias("segment"))


@add("q_segment_2x2x2", f"SELECT l_orderkey, l_linenumber, {cross_sql('MarcaBancarizadoU06M')} AS segment FROM {FLAGS}")
def _(t):
    trio = [c("MarcaBancarizadoU06M"), c("TenenciaPatrimonio"), c("TenenciaRetailML")]
    return flags(t).select(*KEY, rules.segment(trio, tracking.BANKED_WEALTH_RETAIL).alias("segment"))


@add("q_priority_segment", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 2 THEN '03. Suspendido' WHEN l_linenumber = 3 THEN '04. Castigado'
  WHEN l_returnflag = 'R' THEN '05. Fraude' WHEN l_discount > 0.05::DOUBLE THEN '06. Fallecido' ELSE 'Otros' END AS segment FROM lineitem""")
def _(t):
    return t("lineitem").select(*KEY, measures.exclusion(c("l_linenumber"), c("l_returnflag") == "R", c("l_discount") > 0.05).alias("segment"))


STATUS = """(SELECT o_custkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS m,
  max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS s FROM orders GROUP BY 1, 2)"""


@add("q_status_transition", f"""SELECT k, m, CASE WHEN s = 1 AND p = 2 THEN if(m < DATE '1998-08-01' OR k % 2 = 0, 'Reapertura', 'Desbloqueo') ELSE 'Originacion' END AS arrival
  FROM (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY m) AS p FROM {STATUS})""")
def _(t):
    status = F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 2).otherwise(3)
    panel = t("orders").groupBy(c("o_custkey").alias("k"), fd.month_start(c("o_orderdate").cast("date")).alias("m")).agg(F.max(status).alias("s"))
    seen = skew.previous_row(panel, ["k"], "m", {"p": "s"})
    block = F.when(c("k") % 2 == 0, "x")
    return seen.select("k", "m", measures.arrival(c("s"), c("p"), c("m"), block, "1998-08-01").alias("arrival"))


@add("q_fresh_else_fallback", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 5 THEN l_tax WHEN l_linenumber = 6 THEN 0
    WHEN od - sd <= 60 THEN l_discount ELSE l_tax END AS chosen FROM {LINES}""")
def _(t):
    n = c("l_linenumber")
    rows = line_days(t).select(*KEY, F.when(n != 6, c("od")).alias("od"), F.when(n != 5, c("sd")).alias("sd"), "l_discount", "l_tax")
    age = fd.day_diff("od", "sd")
    return rows.select(*KEY, rules.fresh_else(age, c("l_discount"), c("l_tax"), F.lit(0.0), c("sd").isNull()).alias("chosen"))


# accounts for the policy rules: every order line with scores and flags derived from it
POLICY_SQL = f"""(SELECT l_orderkey, l_linenumber, CAST(date_trunc('month', l_shipdate + INTERVAL 26 YEAR) AS DATE) AS FechaFoto,
  CASE WHEN l_linenumber <> 7 THEN (l_partkey * 37 % 1024) / 4096.0::DOUBLE END AS ProbPreaprobados, (l_partkey * 53 % 1024) / 3072.0::DOUBLE AS ProbPreaprobados_Antiguo,
  CAST(l_quantity * 15 + 200 AS BIGINT) AS EdadMeses, CAST(l_tax > 0.03 AS INT) AS MarcaBancarizadoU06M, CAST(l_discount > 0.05 AS INT) AS TenenciaPatrimonio,
  CASE WHEN l_suppkey % 3 = 0 THEN l_quantity END AS ComprasSU12M, CASE WHEN l_suppkey % 5 = 0 THEN l_quantity ELSE 0 END AS ComprasFU12M,
  CAST(l_suppkey % 3 = 0 OR l_suppkey % 5 = 0 AS INT) AS TenenciaRetailML, CASE WHEN l_suppkey % 2 = 0 THEN l_quantity * 20000 ELSE 0 END AS RentaEvaluacion,
  if(l_partkey % 17 = 0, 'Dueña de Casa', 'Otros') AS TipoEmpleo, if(l_returnflag = 'R', 'Extranjero', 'Chileno') AS Nacionalidad,
  if(l_linestatus = 'F', 'Espontaneo', 'Preaprobado') AS MarcaPreaprobado,
  CASE l_partkey % 5 WHEN 0 THEN 'BANCARIZADO MAYOR 21' WHEN 1 THEN 'NO BANCARIZADO MAYOR 21' WHEN 2 THEN 'EXTRANJERO NO BANCARIZADO' WHEN 3 THEN 'MENOR 21' END AS ClasificacionPreaprobados
  FROM lineitem)"""


def policy_rows(t: Inputs) -> DataFrame:
    part, supp, quantity = c("l_partkey"), c("l_suppkey"), c("l_quantity")
    model = ["BANCARIZADO MAYOR 21", "NO BANCARIZADO MAYOR 21", "EXTRANJERO NO BANCARIZADO", "MENOR 21"]
    spend = (supp % 3 == 0) | (supp % 5 == 0)
    return t("lineitem").select(
        *KEY, fd.month_start(fd.add_months(c("l_shipdate").cast("date"), 26 * 12)).alias("FechaFoto"),
        F.when(c("l_linenumber") != 7, (part * 37 % 1024) / 4096.0).alias("ProbPreaprobados"), ((part * 53 % 1024) / 3072.0).alias("ProbPreaprobados_Antiguo"),
        (quantity * 15 + 200).cast("bigint").alias("EdadMeses"), fs.flag(c("l_tax") > 0.03).alias("MarcaBancarizadoU06M"),
        fs.flag(c("l_discount") > 0.05).alias("TenenciaPatrimonio"), F.when(supp % 3 == 0, quantity).alias("ComprasSU12M"),
        F.when(supp % 5 == 0, quantity).otherwise(0.0).alias("ComprasFU12M"), fs.flag(spend).alias("TenenciaRetailML"),
        F.when(supp % 2 == 0, quantity * 20000).otherwise(0.0).alias("RentaEvaluacion"),
        F.when(part % 17 == 0, "Dueña de Casa").otherwise("Otros").alias("TipoEmpleo"),
        F.when(c("l_returnflag") == "R", "Extranjero").otherwise("Chileno").alias("Nacionalidad"),
        F.when(c("l_linestatus") == "F", "Espontaneo").otherwise("Preaprobado").alias("MarcaPreaprobado"),
        rules.first_true([(part % 5 == i, label) for i, label in enumerate(model)], None).alias("ClasificacionPreaprobados"),
    )


@add("q_policy_waterfall_spontaneous", f"SELECT l_orderkey, l_linenumber, {waterfall_sql(checking_values.SPONTANEOUS)} AS reason FROM {POLICY_SQL}")
def _(t):
    return policy_rows(t).select(*KEY, policy.waterfall(policy.SPONTANEOUS).alias("reason"))


@add("q_policy_waterfall_preapproved", f"SELECT l_orderkey, l_linenumber, {waterfall_sql(checking_values.PREAPPROVED)} AS reason FROM {POLICY_SQL}")
def _(t):
    return policy_rows(t).select(*KEY, policy.waterfall(policy.PREAPPROVED).alias("reason"))


@add("q_policy_rollup", f"""SELECT l_orderkey, l_linenumber, {rollup_sql()} AS total FROM (SELECT *, {waterfall_sql(checking_values.SPONTANEOUS)} AS CambiosEspontaneo,
  {waterfall_sql(checking_values.PREAPPROVED)} AS CambiosPreaprobadoSinT FROM {POLICY_SQL})""")
def _(t):
    decided = policy_rows(t).select(
        "*", policy.waterfall(policy.SPONTANEOUS).alias("CambiosEspontaneo"), policy.waterfall(policy.PREAPPROVED).alias("CambiosPreaprobadoSinT")
    )
    return decided.select(*KEY, policy.total_changes().alias("total"))


@add("q_cohort_label", f"""SELECT l_orderkey, l_linenumber, CASE WHEN k = -1 THEN 'Mmenos1' WHEN k BETWEEN 0 AND 10 THEN 'M' || k ELSE 'M_Otros' END AS label
  FROM (SELECT l_orderkey, l_linenumber, date_diff('month', od, sd) % 15 AS k FROM {LINES})""")
def _(t):
    return line_days(t).select(*KEY, rules.cohort_label(fd.month_diff("sd", "od") % 15).alias("label"))


@add("q_cohort_gated_values", f"""SELECT l_orderkey, l_linenumber, CASE WHEN k BETWEEN -1 AND 10 THEN l_quantity ELSE 0 END AS debt,
    CASE WHEN k BETWEEN -1 AND 10 AND l_returnflag = 'R' THEN l_quantity ELSE 0 END AS late
  FROM (SELECT *, date_diff('month', od, sd) % 15 AS k FROM {LINES})""")
def _(t):
    k = fd.month_diff("sd", "od") % 15
    return line_days(t).select(
        *KEY, rules.gated_by_offset(k, c("l_quantity")).alias("debt"),
        rules.gated_by_offset(k, c("l_quantity"), also=c("l_returnflag") == "R").alias("late"),
    )


@add("q_dpd_flags", f"""SELECT l_orderkey, l_linenumber, CAST(x >= 30 AS INT) AS dpd30, CAST(x >= 60 AS INT) AS dpd60, CAST(x >= 90 AS INT) AS dpd90, CAST(x > 0 AS INT) AS late
  FROM (SELECT l_orderkey, l_linenumber, abs(sd - od) % 120 AS x FROM {LINES})""")
def _(t):
    rows = line_days(t).select(*KEY, (F.abs(fd.day_diff("sd", "od")) % 120).alias("x"))
    return rows.select(*KEY, *[fs.flag(c("x") >= d).alias(f"dpd{d}") for d in (30, 60, 90)], fs.flag(c("x") > 0).alias("late"))


@add("q_delinquent_balance", f"""SELECT l_orderkey, l_linenumber, CASE WHEN x >= 30 THEN l_extendedprice ELSE 0 END AS debt, CASE WHEN x >= 30 THEN 1 ELSE 0 END AS cases
  FROM (SELECT *, abs(sd - od) % 120 AS x FROM {LINES})""")
def _(t):
    late = F.abs(fd.day_diff("sd", "od")) % 120 >= 30
    return line_days(t).select(*KEY, measures.delinquent(late, c("l_extendedprice")).alias("debt"), fs.flag(late).alias("cases"))


BURDEN = "l_extendedprice * 0.035::DOUBLE + l_quantity / 240 + coalesce(CASE WHEN l_linenumber <> 3 THEN l_discount END, 0) / 6 + l_tax / 24"


@add("q_dti", f"""SELECT l_orderkey, l_linenumber, {BURDEN} AS burden, CASE WHEN l_quantity > 5 THEN ({BURDEN}) / (l_quantity * 1000) ELSE -1 END AS dti FROM lineitem""")
def _(t):
    load = measures.burden(c("l_extendedprice"), c("l_quantity"), F.when(c("l_linenumber") != 3, c("l_discount")), c("l_tax"))
    income = F.when(c("l_quantity") > 5, c("l_quantity") * 1000)
    return t("lineitem").select(*KEY, load.alias("burden"), measures.debt_to_income(load, income).alias("dti"))


@add("q_leverage", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND l_quantity * 20000 >= 300000 THEN l_extendedprice / (l_quantity * 20000) END AS leverage FROM lineitem")
def _(t):
    income = c("l_quantity") * 20000
    return t("lineitem").select(*KEY, measures.leverage(c("l_returnflag") == "R", income, c("l_extendedprice")).alias("leverage"))


@add("q_valid_income", """SELECT l_orderkey, l_linenumber, greatest(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END,
  CASE WHEN l_quantity <= 45 AND l_linenumber <> 2 THEN l_quantity * 1000 ELSE 0 END) AS income FROM lineitem""")
def _(t):
    declared = F.when(c("l_returnflag") == "R", c("l_extendedprice")).otherwise(0.0)
    pension = F.when(c("l_linenumber") != 2, c("l_quantity") * 1000)
    valid = measures.pension_income(c("l_quantity"), pension)
    return t("lineitem").select(*KEY, measures.evaluated_income(declared, valid).alias("income"))
