"""Audit query library over the test tables.

orders / customer / lineitem stand in for the silver audit tables: an order is
a spending record (value ``o_totalprice``, status ``o_orderstatus``, month from
``o_orderdate``), a customer segment is a budget function, a supplier is a
recipient. Text-typed codes are compared as text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from erario.functions.dates import julian_day, month_ref, months_apart, shift_months, year_text
from erario.functions.money import money, money_sum
from erario.operators import audit as A
from erario.operators import relational as R
from erario.operators.intervals import earlier_higher, overlap_join
from erario.plans.registry import register
from erario.sources.tables import table

TS = "timestamp_ntz"


def _ts(s: str):
    return F.lit(s).cast(TS)


# --------------------------------------------------------------------------
# C17 + C9 + C15: the minimum slice, also ``entry()``
# --------------------------------------------------------------------------

def compare_segments_1997(spark, sf_dir):
    """1997 order value of the BUILDING vs the AUTOMOBILE segment.

    Orders are summed per customer before the join (exact decimal partial
    sums, combined map-side), so the join sees one row per customer instead of
    one per order; the segment filter is pushed into the customer scan.
    """
    o = (table(spark, sf_dir, "orders")
         .filter(A.year_range("o_orderdate", 1997, 1997))
         .groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("v")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return A.compare_slices(j, "v", "c_mktsegment", "BUILDING", "AUTOMOBILE",
                            names=("building_total", "automobile_total", "difference"))


register("compare_slices", "C17 C9 C15", """
SELECT CAST(COALESCE(SUM(CASE WHEN c.c_mktsegment = 'BUILDING' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS building_total,
       CAST(COALESCE(SUM(CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS automobile_total,
       CAST(COALESCE(SUM(CASE WHEN c.c_mktsegment = 'BUILDING' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END), 0)
          - COALESCE(SUM(CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS difference
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderdate >= TIMESTAMP '1997-01-01' AND o.o_orderdate < TIMESTAMP '1998-01-01'
  AND c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE')
""")(compare_segments_1997)


# --------------------------------------------------------------------------
# Filter + projection + default limit 5
# --------------------------------------------------------------------------

@register("filter_limit", "C1 C26 C5", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_totalprice > 10000
ORDER BY o_totalprice DESC, o_orderkey LIMIT 5
""")
def filter_limit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return A.filter_limit(o, F.col("o_totalprice") > 10000,
                          ["o_orderkey", "o_custkey", "o_totalprice"],
                          [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


# --------------------------------------------------------------------------
# Filtered global SUM with month and code compared as text
# --------------------------------------------------------------------------

@register("filtered_sum", "C2 C3 C15", """
SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS n_rows
FROM orders
WHERE strftime(o_orderdate, '%Y%m') = '199701' AND o_orderpriority = '1-URGENT'
""")
def filtered_sum(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    # the month range is stated once more on the raw column so it reaches the scan
    o = o.filter((F.col("o_orderdate") >= _ts("1997-01-01")) & (F.col("o_orderdate") < _ts("1997-02-01")))
    cond = (month_ref("o_orderdate") == F.lit("199701")) & (F.col("o_orderpriority") == F.lit("1-URGENT"))
    return A.filtered_total(o, cond, "o_totalprice")


@register("text_year_equality", "C3", """
SELECT o_orderstatus, COUNT(*) AS n_orders FROM orders
WHERE strftime(o_orderdate, '%Y') = '1997' GROUP BY o_orderstatus
""")
def text_year_equality(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(A.year_range("o_orderdate", 1997, 1997))
    return (o.filter(year_text("o_orderdate") == F.lit("1997"))
            .groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders")))


# --------------------------------------------------------------------------
# C4: BETWEEN is inclusive on both ends
# --------------------------------------------------------------------------

@register("between_inclusive", "C4", """
SELECT l_returnflag, COUNT(*) AS n_lines,
       CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty
FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
GROUP BY l_returnflag
""")
def between_inclusive(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return (li.filter(F.col("l_shipdate").between(_ts("1996-01-01"), _ts("1996-12-31")))
            .groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("n_lines"), money_sum("l_quantity").alias("sum_qty")))


# --------------------------------------------------------------------------
# Status exclusion before summing (explicit NULL rule: NULL is kept)
# --------------------------------------------------------------------------

@register("status_exclusion", "C6", """
SELECT strftime(o_orderdate, '%Y') AS year, COUNT(*) AS n_orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F')
GROUP BY 1
""")
def status_exclusion(spark, sf_dir):
    o = A.exclude_status(table(spark, sf_dir, "orders"), "o_orderstatus", ["F"], keep_null=True)
    return (o.groupBy(year_text("o_orderdate").alias("year"))
            .agg(F.count(F.lit(1)).alias("n_orders"), money_sum("o_totalprice").alias("total")))


# --------------------------------------------------------------------------
# Retention window (last n fiscal years up to a fixed "current" year)
# --------------------------------------------------------------------------

@register("retention_window", "C8", """
SELECT strftime(o_orderdate, '%Y') AS year, COUNT(*) AS n_orders FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '2002-01-01'
GROUP BY 1
""")
def retention_window(spark, sf_dir):
    o = A.retention_window(table(spark, sf_dir, "orders"), "o_orderdate", current_year=2001, years=5)
    return o.groupBy(year_text("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n_orders"))


# --------------------------------------------------------------------------
# GROUP BY + HAVING
# --------------------------------------------------------------------------

@register("group_having", "C16", """
SELECT o_custkey, COUNT(*) AS n_orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15
""")
def group_having(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return A.group_having(o, ["o_custkey"],
                          [F.count(F.lit(1)).alias("n_orders"), money_sum("o_totalprice").alias("total")],
                          F.col("n_orders") >= 15)


# --------------------------------------------------------------------------
# Evolution of counts over the last three years
# --------------------------------------------------------------------------

@register("evolution", "C18", """
SELECT strftime(o_orderdate, '%Y') AS year, COUNT(*) AS n FROM orders
WHERE strftime(o_orderdate, '%Y') IN ('1996', '1997', '1998') GROUP BY 1
""")
def evolution(spark, sf_dir):
    return A.evolution(table(spark, sf_dir, "orders"), "o_orderdate", [1996, 1997, 1998])


# --------------------------------------------------------------------------
# Year over year per priority
# --------------------------------------------------------------------------

@register("year_over_year", "C19", """
WITH t AS (
  SELECT o_orderpriority, strftime(o_orderdate, '%Y') AS year,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS t
  FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, year, CAST(t AS DOUBLE) AS total,
       CAST(LAG(t) OVER (PARTITION BY o_orderpriority ORDER BY year) AS DOUBLE) AS previous_total,
       CAST(t - LAG(t) OVER (PARTITION BY o_orderpriority ORDER BY year) AS DOUBLE) AS change
FROM t
""")
def year_over_year(spark, sf_dir):
    return A.year_over_year(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice",
                            keys=["o_orderpriority"])


# --------------------------------------------------------------------------
# C20: budget execution stages and ratios (exact decimal arithmetic)
# --------------------------------------------------------------------------

@register("budget_execution", "C20", """
WITH s AS (
  SELECT l_returnflag, l_linestatus,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS g,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS n,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))
             * (1 + CAST(l_tax AS DECIMAL(18,2)))) AS c
  FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, CAST(g AS DOUBLE) AS gross, CAST(n AS DOUBLE) AS net,
       CAST(c AS DOUBLE) AS charged,
       CAST(n AS DOUBLE) / NULLIF(CAST(g AS DOUBLE), 0) AS net_ratio,
       CAST(c AS DOUBLE) / NULLIF(CAST(g AS DOUBLE), 0) AS charged_ratio
FROM s
""")
def budget_execution(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ep, disc, tax = money("l_extendedprice"), money("l_discount"), money("l_tax")
    net = ep * (F.lit(1) - disc)
    return A.budget_execution(li, [("gross", ep), ("net", net), ("charged", net * (F.lit(1) + tax))],
                              keys=["l_returnflag", "l_linestatus"])


# --------------------------------------------------------------------------
# Top recipients (aggregate first, then attach the name)
# --------------------------------------------------------------------------

@register("top_recipients", "C25 C26", """
WITH t AS (
  SELECT l_suppkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS v
  FROM lineitem GROUP BY l_suppkey)
SELECT s.s_suppkey, s.s_name, CAST(t.v AS DOUBLE) AS total
FROM t JOIN supplier s ON s.s_suppkey = t.l_suppkey
ORDER BY t.v DESC, s.s_suppkey LIMIT 5
""")
def top_recipients(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    top = A.top_recipients(li, "l_suppkey", money("l_extendedprice") * (F.lit(1) - money("l_discount")))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return s.join(top, s.s_suppkey == top.l_suppkey).select("s_suppkey", "s_name", "total")


# --------------------------------------------------------------------------
# UNION ALL vs UNION
# --------------------------------------------------------------------------

_URGENT_97 = ("o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1997-01-01' "
              "AND o_orderdate < TIMESTAMP '1998-01-01'")
_FAILED_97 = ("o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01' "
              "AND o_orderdate < TIMESTAMP '1998-01-01'")


def _urgent_97(spark, sf_dir):
    return (table(spark, sf_dir, "orders").filter(A.year_range("o_orderdate", 1997, 1997))
            .filter(F.col("o_orderpriority") == "1-URGENT"))


def _failed_97(spark, sf_dir):
    return (table(spark, sf_dir, "orders").filter(A.year_range("o_orderdate", 1997, 1997))
            .filter(F.col("o_orderstatus") == "F"))


@register("union_all", "C27", f"""
SELECT o_custkey, 'urgent' AS src FROM orders WHERE {_URGENT_97}
UNION ALL
SELECT o_custkey, 'failed' AS src FROM orders WHERE {_FAILED_97}
""")
def union_all(spark, sf_dir):
    a = _urgent_97(spark, sf_dir).select("o_custkey", F.lit("urgent").alias("src"))
    b = _failed_97(spark, sf_dir).select("o_custkey", F.lit("failed").alias("src"))
    return R.union_all(a, b)


@register("union_distinct", "C27", f"""
SELECT o_custkey FROM orders WHERE {_URGENT_97}
UNION
SELECT o_custkey FROM orders WHERE {_FAILED_97}
""")
def union_distinct(spark, sf_dir):
    return R.union_distinct(_urgent_97(spark, sf_dir).select("o_custkey"),
                            _failed_97(spark, sf_dir).select("o_custkey"))


# --------------------------------------------------------------------------
# INTERSECT / EXCEPT / ORDER BY + OFFSET
# --------------------------------------------------------------------------

@register("intersect_keys", "C28", f"""
SELECT o_custkey FROM orders WHERE {_URGENT_97}
INTERSECT
SELECT o_custkey FROM orders WHERE {_FAILED_97}
""")
def intersect_keys(spark, sf_dir):
    return (_urgent_97(spark, sf_dir).select("o_custkey")
            .intersect(_failed_97(spark, sf_dir).select("o_custkey")))


@register("except_keys", "C28", f"""
SELECT o_custkey FROM orders WHERE {_URGENT_97}
EXCEPT
SELECT o_custkey FROM orders WHERE {_FAILED_97}
""")
def except_keys(spark, sf_dir):
    return (_urgent_97(spark, sf_dir).select("o_custkey")
            .subtract(_failed_97(spark, sf_dir).select("o_custkey")))


@register("except_all_keys", "C28", f"""
SELECT o_custkey FROM orders WHERE {_URGENT_97}
EXCEPT ALL
SELECT o_custkey FROM orders WHERE {_FAILED_97}
""")
def except_all_keys(spark, sf_dir):
    return (_urgent_97(spark, sf_dir).select("o_custkey")
            .exceptAll(_failed_97(spark, sf_dir).select("o_custkey")))


@register("order_offset", "C28", """
WITH t AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1)
SELECT o_custkey, CAST(v AS DOUBLE) AS total FROM t ORDER BY v DESC, o_custkey LIMIT 10 OFFSET 5
""")
def order_offset(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("_v"))
    return (t.orderBy(F.col("_v").desc(), F.col("o_custkey")).offset(5).limit(10)
            .select("o_custkey", F.col("_v").cast("double").alias("total")))


# --------------------------------------------------------------------------
# Inner equi-joins across four tables
# --------------------------------------------------------------------------

@register("join_region_revenue", "C9", """
SELECT r.r_name, n.n_name, COUNT(*) AS n_orders,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE o.o_orderdate >= TIMESTAMP '1997-01-01' AND o.o_orderdate < TIMESTAMP '1998-01-01'
GROUP BY r.r_name, n.n_name
""")
def join_region_revenue(spark, sf_dir):
    o = (table(spark, sf_dir, "orders").filter(A.year_range("o_orderdate", 1997, 1997))
         .select("o_custkey", "o_totalprice"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation and region have a fixed size (25 and 5 rows): broadcast by name.
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    r = F.broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    # aggregate orders per customer before the dimension joins: the join input
    # shrinks from #orders to #customers rows.
    per_c = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n"), F.sum(money("o_totalprice")).alias("_v"))
    j = (per_c.join(c, per_c.o_custkey == c.c_custkey)
         .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    return (j.groupBy("r_name", "n_name")
            .agg(F.sum("_n").alias("n_orders"), F.sum("_v").cast("double").alias("total")))


# --------------------------------------------------------------------------
# Null-safe NOT IN, and NOT EXISTS
# --------------------------------------------------------------------------

_F_BEFORE_96 = "o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1996-01-01'"


@register("not_in_subquery", "C10", f"""
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_F_BEFORE_96})
""")
def not_in_subquery(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = (table(spark, sf_dir, "orders")
         .filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < _ts("1996-01-01"))))
    return R.not_in(c, "c_custkey", o, "o_custkey")


@register("not_exists_anti_join", "C10 C12", f"""
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND {_F_BEFORE_96})
""")
def not_exists_anti_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = (table(spark, sf_dir, "orders")
         .filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < _ts("1996-01-01")))
         .select("o_custkey"))
    return R.not_exists(c, o, c.c_custkey == o.o_custkey)


# --------------------------------------------------------------------------
# C11: outer joins
# --------------------------------------------------------------------------

@register("left_outer_join", "C11", """
SELECT n.n_nationkey, n.n_name, COUNT(s.s_suppkey) AS n_suppliers
FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey
GROUP BY n.n_nationkey, n.n_name
""")
def left_outer_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier")
    per = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("_n"))
    return (n.join(per, n.n_nationkey == per.s_nationkey, "left")
            .select("n_nationkey", "n_name", F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("n_suppliers")))


@register("full_outer_join", "C11", """
WITH c AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1),
     s AS (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT COALESCE(c.k, s.k) AS nationkey, COALESCE(c.n, 0) AS n_customers, COALESCE(s.n, 0) AS n_suppliers
FROM c FULL OUTER JOIN s ON c.k = s.k
""")
def full_outer_join(spark, sf_dir):
    c = (table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 9000)
         .groupBy(F.col("c_nationkey").alias("ck")).agg(F.count(F.lit(1)).alias("cn")))
    s = (table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 5000)
         .groupBy(F.col("s_nationkey").alias("sk")).agg(F.count(F.lit(1)).alias("sn")))
    return (c.join(s, c.ck == s.sk, "full")
            .select(F.coalesce("ck", "sk").alias("nationkey"),
                    F.coalesce("cn", F.lit(0)).cast("long").alias("n_customers"),
                    F.coalesce("sn", F.lit(0)).cast("long").alias("n_suppliers")))


@register("right_outer_join", "C11", """
SELECT c.c_custkey, COUNT(o.o_orderkey) AS n_orders_1995
FROM (SELECT o_orderkey, o_custkey FROM orders
      WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01') o
RIGHT JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey
""")
def right_outer_join(spark, sf_dir):
    o = (table(spark, sf_dir, "orders")
         .filter((F.col("o_orderdate") >= _ts("1995-01-01")) & (F.col("o_orderdate") < _ts("1995-02-01")))
         .groupBy("o_custkey").agg(F.count(F.lit(1)).alias("_n")))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return (o.join(c, o.o_custkey == c.c_custkey, "right")
            .select("c_custkey", F.coalesce("_n", F.lit(0)).cast("long").alias("n_orders_1995")))


# --------------------------------------------------------------------------
# Semi and anti joins (EXISTS / IN / NOT IN)
# --------------------------------------------------------------------------

@register("semi_join", "C12", """
SELECT p_partkey, p_name FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
""")
def semi_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 45).select("l_partkey")
    return R.exists(p, li, p.p_partkey == li.l_partkey)


@register("anti_join", "C12", """
SELECT p_partkey, p_name FROM part p
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)
""")
def anti_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") > 45).select("l_partkey")
    return R.not_exists(p, li, p.p_partkey == li.l_partkey)


# --------------------------------------------------------------------------
# Range conditions — equi-join plus a range, and a band join
# --------------------------------------------------------------------------

@register("range_join", "C13", """
SELECT l.l_returnflag, COUNT(*) AS n_lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_shipdate >= o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL 30 DAY
GROUP BY l.l_returnflag
""")
def range_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    cond = ((li.l_orderkey == o.o_orderkey) & (li.l_shipdate >= o.o_orderdate)
            & (li.l_shipdate <= o.o_orderdate + F.expr("INTERVAL 30 DAYS")))
    return li.join(o, cond).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_lines"))


@register("band_join", "C13", """
SELECT c.c_custkey, s.s_suppkey, c.c_nationkey
FROM customer c JOIN supplier s
  ON c.c_nationkey = s.s_nationkey AND abs(c.c_acctbal - s.s_acctbal) <= 25.0
""")
def band_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    j = R.band_join(c, s, "c_acctbal", "s_acctbal", 25.0, keys=[("c_nationkey", "s_nationkey")])
    return j.select("c_custkey", "s_suppkey", "c_nationkey")


_SPAN = "CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 40 ELSE 1000 END"


@register("overlap_join", "C13", f"""
WITH w AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS lo, CAST(o_orderdate AS DATE) + CAST({_SPAN} AS INTEGER) AS hi FROM orders)
SELECT a.o_orderkey AS order_a, b.o_orderkey AS order_b
FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.lo <= b.hi AND b.lo <= a.hi AND a.o_orderkey < b.o_orderkey
""")
def overlap_join_q(spark, sf_dir):
    """Pairs of orders of one customer whose delivery windows (0 to 1,000 days
    long) overlap."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    w = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day.alias("lo"), (day + F.expr(_SPAN)).alias("hi"))
    pairs = overlap_join(w, w, ("lo", "hi"), ("lo", "hi"), [("o_custkey", "o_custkey")])
    a, b = F.col("left.o_orderkey"), F.col("right.o_orderkey")
    return pairs.where(a < b).select(a.alias("order_a"), b.alias("order_b"))


# C14: correlated subqueries

@register("rank_by_dominance", "C14", """
SELECT o_orderkey, (SELECT COUNT(*) FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_totalprice > o.o_totalprice
                    AND CAST(i.o_orderdate AS DATE) < CAST(o.o_orderdate AS DATE)) AS earlier_higher
FROM orders o
""")
def rank_by_dominance(spark, sf_dir):
    """For each order how many earlier orders of its customer were dearer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                              F.unix_date(F.to_date("o_orderdate")).alias("day"))
    r = earlier_higher(o, ["o_custkey"], "day", "o_totalprice", F.floor(F.col("o_totalprice") / 20_000))
    return r.select("o_orderkey", "earlier_higher")



@register("correlated_subquery", "C14", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o
WHERE CAST(o.o_totalprice AS DECIMAL(18,2)) * (SELECT COUNT(*) FROM orders i WHERE i.o_custkey = o.o_custkey)
    > (SELECT SUM(CAST(i.o_totalprice AS DECIMAL(18,2))) FROM orders i WHERE i.o_custkey = o.o_custkey)
""")
def correlated_subquery(spark, sf_dir):
    """Orders above their own customer's average, compared exactly:
    ``price * n > sum`` (no rounded average). The per-customer aggregate is
    partial-combined; the join back is a shuffle join that AQE splits when a
    customer is hot."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    per = (o.groupBy(F.col("o_custkey").alias("_ck"))
           .agg(F.count(F.lit(1)).alias("_n"), F.sum(money("o_totalprice")).alias("_s")))
    j = o.join(per, o.o_custkey == per._ck)
    return (j.filter(money("o_totalprice") * F.col("_n") > F.col("_s"))
            .select("o_orderkey", "o_custkey", "o_totalprice"))


# --------------------------------------------------------------------------
# AVG MIN MAX TOTAL, DISTINCT aggregates, FILTER, GROUP_CONCAT
# --------------------------------------------------------------------------

@register("aggregate_functions", "C21 C15", """
SELECT o_orderpriority,
       COUNT(*) AS n_orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice) AS avg_price,
       MIN(o_totalprice) AS min_price, MAX(o_totalprice) AS max_price,
       CAST(COALESCE(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total_price,
       COUNT(DISTINCT o_custkey) AS n_customers,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS failed_total,
       string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses
FROM orders GROUP BY o_orderpriority
""")
def aggregate_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = F.sum(money("o_totalprice"))
    return o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"),
        (s.cast("double") / F.count("o_totalprice")).alias("avg_price"),
        F.min("o_totalprice").alias("min_price"),
        F.max("o_totalprice").alias("max_price"),
        F.coalesce(s, F.lit(0).cast("decimal(28,2)")).cast("double").alias("total_price"),
        F.countDistinct("o_custkey").alias("n_customers"),
        F.sum(F.when(F.col("o_orderstatus") == "F", money("o_totalprice"))).cast("double").alias("failed_total"),
        # the status domain is small and fixed; collect_set is partial-combined
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"),
    )


# --------------------------------------------------------------------------
# §2.9 scalar functions delegated to the SQL engine (string, date, math,
# conditional). Division by zero is NULL (try_divide), as in SQLite.
# --------------------------------------------------------------------------

@register("scalar_functions", "§2.9 S5 S6 S10", """
SELECT o.o_orderkey,
       substr(c.c_name, 1, 8) AS name8,
       CAST(instr(c.c_name, '#') AS INTEGER) AS hash_pos,
       replace(c.c_name, 'Customer', 'C') AS short_name,
       upper(trim('  ' || lower(c.c_mktsegment) || ' ')) AS segment,
       printf('%05d', c.c_nationkey) AS nation_code,
       CAST(length(c.c_name) AS INTEGER) AS name_len,
       strftime(o.o_orderdate, '%Y-%m-%d') AS order_day,
       date_diff('day', TIMESTAMP '1995-01-01', o.o_orderdate) AS days_since_1995,
       strftime(o.o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due_day,
       o.o_totalprice / NULLIF(c.c_nationkey, 0) AS price_per_nation_code,
       o.o_custkey % 7 AS bucket7,
       CAST(round(CAST(c.c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE) AS acctbal_1,
       sqrt(abs(c.c_acctbal)) AS acctbal_sqrt,
       CASE WHEN c.c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS balance_kind,
       COALESCE(NULLIF(c.c_mktsegment, 'BUILDING'), 'B') AS segment_or_b
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def scalar_functions(spark, sf_dir):
    """String, date, math and conditional functions over every order and its
    customer."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        "o_orderkey",
        F.substring("c_name", 1, 8).alias("name8"),
        F.instr("c_name", "#").alias("hash_pos"),
        F.replace(F.col("c_name"), F.lit("Customer"), F.lit("C")).alias("short_name"),
        F.upper(F.trim(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" ")))).alias("segment"),
        F.format_string("%05d", "c_nationkey").alias("nation_code"),
        F.length("c_name").alias("name_len"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"),
        F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("days_since_1995"),
        F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd").alias("due_day"),
        F.try_divide(F.col("o_totalprice"), F.col("c_nationkey").cast("double")).alias("price_per_nation_code"),
        (F.col("o_custkey") % 7).alias("bucket7"),
        F.round(money("c_acctbal"), 1).cast("double").alias("acctbal_1"),
        F.sqrt(F.abs("c_acctbal")).alias("acctbal_sqrt"),
        F.when(F.col("c_acctbal") < 0, F.lit("debt")).otherwise(F.lit("credit")).alias("balance_kind"),
        F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("B")).alias("segment_or_b"),
    )


@register("date_functions", "§2.9 S10", """
SELECT l_orderkey, l_linenumber,
       epoch(l_shipdate) / 86400.0 + 2440587.5 AS julian_shipped,
       CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0) AS BIGINT) AS days_to_ship,
       strftime(CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) + CAST(day(l_shipdate) - 1 AS INTEGER), '%Y-%m-%d') AS due_next_month,
       strftime(CAST(date_trunc('month', l_shipdate) - INTERVAL 11 MONTH AS DATE) + CAST(day(l_shipdate) - 1 AS INTEGER), '%Y-%m-%d') AS eleven_before,
       strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS month_start,
       strftime(last_day(l_shipdate), '%Y-%m-%d') AS month_end,
       CAST(date_diff('month', o_orderdate, l_shipdate) AS INTEGER) AS months_to_ship,
       CAST(dayofweek(l_shipdate) AS INTEGER) AS weekday,
       CAST(dayofyear(l_shipdate) AS INTEGER) AS day_of_year,
       CAST(epoch(l_shipdate) AS BIGINT) AS unix_shipped
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def date_functions(spark, sf_dir):
    """Julian days, month arithmetic and date parts of every lineitem and its order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    li = li.join(o, li.l_orderkey == o.o_orderkey)
    shipped = F.col("l_shipdate").cast("timestamp")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return li.select(
        "l_orderkey", "l_linenumber",
        julian_day("l_shipdate").alias("julian_shipped"),
        F.floor(julian_day("l_shipdate") - julian_day("o_orderdate")).alias("days_to_ship"),
        text(shift_months("l_shipdate", 1)).alias("due_next_month"),
        text(shift_months("l_shipdate", -11)).alias("eleven_before"),
        text(F.trunc("l_shipdate", "month")).alias("month_start"),
        text(F.last_day("l_shipdate")).alias("month_end"),
        months_apart("l_shipdate", "o_orderdate").alias("months_to_ship"),
        (F.dayofweek(shipped) - 1).alias("weekday"),
        F.dayofyear(shipped).alias("day_of_year"),
        F.unix_seconds(shipped).alias("unix_shipped"),
    )
