"""Window-function queries, ordered transcripts (T5)
and span statistics with exact percentiles (T13). Windows over raw rows go by
order buckets rather than per-key window tasks; a window over an aggregate whose
size the calendar bounds (one row per month) is a plain one.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from erario.functions.dates import month_ref
from erario.functions.money import money
from erario.operators.traces import span_stats as trace_span_stats, trace_rollup
from erario.operators.windows import cume_dist, ntile, over_buckets, percent_rank
from erario.plans.registry import register
from erario.sources.tables import table


def _cents(c):
    return (money(c) * 100).cast("long")


# --------------------------------------------------------------------------
# Ranking functions
# --------------------------------------------------------------------------

@register("ranking_functions", "C22", """
WITH t AS (
  SELECT c.c_custkey, c.c_nationkey, SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS v
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2)
SELECT c_custkey, c_nationkey, CAST(v AS DOUBLE) AS total,
       row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC, c_custkey) AS row_number,
       rank() OVER (PARTITION BY c_nationkey ORDER BY v DESC) AS rank,
       dense_rank() OVER (PARTITION BY c_nationkey ORDER BY v DESC) AS dense_rank,
       ntile(4) OVER (PARTITION BY c_nationkey ORDER BY v DESC, c_custkey) AS quartile,
       percent_rank() OVER (PARTITION BY c_nationkey ORDER BY v DESC) AS percent_rank,
       cume_dist() OVER (PARTITION BY c_nationkey ORDER BY v DESC) AS cume_dist
FROM t
""")
def ranking_functions(spark, sf_dir):
    """Customers ranked by total spend within their nation."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per = o.groupBy("o_custkey").agg(F.sum(money("o_totalprice")).alias("v"))
    t = per.join(c, per.o_custkey == c.c_custkey).select("c_custkey", "c_nationkey", _cents("v").alias("cents"))
    # a nation's customers are dealt by their spend in steps of 10,000
    r = over_buckets(t, ["c_nationkey"], [("cents", False), "c_custkey"], F.floor(F.col("cents") / 1_000_000), ties=1)
    return r.select("c_custkey", "c_nationkey", (F.col("cents").cast("decimal(20,0)") / 100).cast("double").alias("total"),
                    "row_number", "rank", "dense_rank", ntile(4).alias("quartile"),
                    percent_rank().alias("percent_rank"), cume_dist().alias("cume_dist"))


# --------------------------------------------------------------------------
# Analytic functions over raw rows per key
# --------------------------------------------------------------------------

@register("analytic_functions", "C23", """
SELECT o_orderkey, o_custkey,
       row_number() OVER w AS row_number,
       lag(o_totalprice) OVER w AS prev_price,
       lead(o_totalprice) OVER w AS next_price,
       first_value(o_totalprice) OVER w AS first_price,
       nth_value(o_totalprice, 2) OVER w AS second_price,
       last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_price
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def analytic_functions(spark, sf_dir):
    """Per customer, orders in date order: previous/next price, first price,
    second price (NULL before the 2nd row) and last price of the customer.
    A customer's orders are dealt by year."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    price = "o_totalprice"
    r = over_buckets(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.year("o_orderdate"), lag={"prev_price": price},
                     lead={"next_price": price}, first={"first_price": price}, nth={"second_price": (price, 2)},
                     last={"last_price": price})
    return r.select("o_orderkey", "o_custkey", "row_number", "prev_price", "next_price", "first_price", "second_price",
                    "last_price")


# --------------------------------------------------------------------------
# Running totals (ROWS frame), global and per key
# --------------------------------------------------------------------------

@register("running_total", "C24", """
WITH m AS (SELECT strftime(o_orderdate, '%Y%m') AS month_ref, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS t
           FROM orders GROUP BY 1)
SELECT month_ref, CAST(t AS DOUBLE) AS total,
       CAST(SUM(t) OVER (ORDER BY month_ref ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total
FROM m
""")
def running_total(spark, sf_dir):
    """Cumulative monthly total. Months are aggregated first; the running sum
    then runs over one row per month — a size bounded by the calendar, not by
    the data — so a single ordered window is the right tool here."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(month_ref("o_orderdate").alias("month_ref")).agg(F.sum(money("o_totalprice")).alias("t"))
    w = Window.orderBy("month_ref").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("month_ref", F.col("t").cast("double").alias("total"),
                    F.sum("t").over(w).cast("double").alias("running_total"))


@register("running_total_by_key", "C24", """
SELECT o_orderkey, o_custkey,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_total
FROM orders
""")
def running_total_by_key(spark, sf_dir):
    """Per customer, running total of order value in date order (raw rows)."""
    o = (table(spark, sf_dir, "orders")
         .select("o_orderkey", "o_custkey", "o_orderdate", _cents("o_totalprice").alias("cents")))
    r = over_buckets(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.year("o_orderdate"), running={"sum_cents": "cents"})
    return r.select("o_orderkey", "o_custkey",
                    (F.col("sum_cents").cast("decimal(20,0)") / 100).cast("double").alias("running_total"))


# --------------------------------------------------------------------------
# T5: transcript as ordered rows
# --------------------------------------------------------------------------

@register("transcript", "T5", """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, turn, role, text,
       lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role
FROM conversations
""")
def transcript(spark, sf_dir):
    """The append-only message list of each conversation as ordered rows:
    0-based position, previous speaker. Rows rather than one array per
    conversation, so a very long conversation is never one value; its turns
    are dealt by the thousand."""
    c = table(spark, sf_dir, "conversations")
    r = over_buckets(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000), lag={"prev_role": "role"})
    return r.select("conv_id", (F.col("row_number") - 1).alias("seq"), "turn", "role", "text", "prev_role")


# --------------------------------------------------------------------------
# Span statistics (calls, errors, exact percentiles, totals)
# --------------------------------------------------------------------------

_PS = (0.5, 0.9, 0.99)


def _pct_sql(p):
    h = f"(CAST(n - 1 AS DOUBLE) * CAST({p} AS DOUBLE))"
    return (f"MAX(CASE WHEN rn - 1 = floor({h}) THEN value END) + ({h} - floor({h})) * "
            f"(MAX(CASE WHEN rn - 1 = ceil({h}) THEN value END) - MAX(CASE WHEN rn - 1 = floor({h}) THEN value END))")


def _spans(spark, sf_dir):
    """Events as trace spans: the type as component, a failed call from 400 up,
    the value as latency, the user as trace and token count."""
    e = table(spark, sf_dir, "events")
    none = F.lit(None).cast("double")
    return e.select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_type").alias("component"),
                    F.when(F.col("event_id") % 2 == 0, F.lit("call")).alias("event_type"), "ts",
                    F.when(F.col("value") >= 400, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
                    F.col("value").alias("latency_ms"),
                    F.struct(F.col("user_id").alias("total_tokens"), F.col("event_id").alias("prompt_tokens"),
                             F.lit(1).cast("long").alias("completion_tokens"), none.alias("total_cost")).alias("tokens"))


@register("span_stats", "T13", f"""
WITH s AS (SELECT event_type AS component, CASE WHEN event_id % 2 = 0 THEN 'call' END AS event_type, value, user_id, event_id
           FROM events),
r AS (SELECT component, event_type, value, row_number() OVER (PARTITION BY component, event_type ORDER BY value) AS rn,
             COUNT(*) OVER (PARTITION BY component, event_type) AS n FROM s WHERE value IS NOT NULL),
p AS (SELECT component, event_type, {_pct_sql(0.5)} AS p50, {_pct_sql(0.9)} AS p90, {_pct_sql(0.99)} AS p99
      FROM r GROUP BY component, event_type, n),
a AS (SELECT component, event_type, COUNT(*) AS calls, COUNT(*) FILTER (value >= 400) AS errors,
             CAST(SUM(user_id) AS BIGINT) AS total_tokens, CAST(SUM(event_id) AS BIGINT) AS prompt_tokens,
             COUNT(*) AS completion_tokens, CAST(NULL AS DOUBLE) AS total_cost,
             CAST(COUNT(*) FILTER (value >= 400) AS DOUBLE) / COUNT(*) AS error_rate FROM s GROUP BY 1, 2)
SELECT a.*, p.p50, p.p90, p.p99
FROM a JOIN p ON a.component = p.component AND a.event_type IS NOT DISTINCT FROM p.event_type
""")
def span_stats(spark, sf_dir):
    """Per component and event type (half of them NULL): calls, errors, tokens
    and exact p50/p90/p99 of the latency."""
    return trace_span_stats(_spans(spark, sf_dir)).drop("avg_latency_ms")


@register("trace_rollup", "T14", """
SELECT CAST(user_id AS VARCHAR) AS trace_id, COUNT(*) AS spans, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ended, CAST(SUM(user_id) AS BIGINT) AS total_tokens,
       CAST(NULL AS DOUBLE) AS total_cost, bool_or(value >= 400) AS failed,
       array_to_string(list_sort(list(DISTINCT event_type)), ',') AS components
FROM events GROUP BY user_id
""")
def trace_rollup_q(spark, sf_dir):
    """Every user's events as one trace."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    r = trace_rollup(_spans(spark, sf_dir))
    return r.select("trace_id", "spans", stamp("started"), stamp("ended"), "total_tokens", "total_cost", "failed",
                    F.array_join("components", ",").alias("components"))
