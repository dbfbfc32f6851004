"""Ingest, key, upsert and ledger operators over the test tables
(SURVEY §2.1-§2.4): calendar spines, month strings, surrogate keys, JSON
columns, affinity coercion, latest-version upsert, ledger state, pending tasks,
coverage gaps, record counts and code decoding.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from erario.functions.dates import fiscal_year_param, month_bounds, month_ref
from erario.functions.jsontext import NUMERIC_TEXT, py_float_text, real_affinity_of
from erario.operators import ledger as L
from erario.operators.catalog import decode
from erario.operators.ingest import surrogate_key
from erario.operators.upsert import latest_per_key
from erario.plans.registry import register
from erario.sources.tables import table


# --------------------------------------------------------------------------
# A1: calendar spine x status, zero-filled
# --------------------------------------------------------------------------

@register("calendar_coverage", "A1", """
WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM orders),
m AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS month_start FROM b),
s AS (SELECT DISTINCT o_orderstatus FROM orders),
c AS (SELECT date_trunc('month', o_orderdate) AS ms, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2)
SELECT strftime(m.month_start, '%Y%m') AS month_ref, s.o_orderstatus, COALESCE(c.n, 0) AS n_orders
FROM m CROSS JOIN s LEFT JOIN c ON c.ms = m.month_start AND c.o_orderstatus = s.o_orderstatus
""")
def calendar_coverage(spark, sf_dir):
    """Month spine from the first to the last order month, times every status;
    months without orders count 0. One aggregate to (month, status) feeds the
    bounds, the statuses and the counts."""
    o = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderstatus")
    counts = (o.groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).alias("month_index"), "o_orderstatus")
              .agg(F.count(F.lit(1)).alias("n")))
    ends = counts.agg(F.min("month_index").alias("lo"), F.max("month_index").alias("hi"))
    grid = L.month_grid(counts.select("o_orderstatus").distinct(), ends.select("lo").scalar(), ends.select("hi").scalar())
    m = F.col("month_index")
    ref = month_ref(F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1)))
    return (grid.join(counts, ["month_index", "o_orderstatus"], "left")
            .select(ref.alias("month_ref"), "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders")))


# --------------------------------------------------------------------------
# A2 / A3: month bounds, YYYYMM, fiscal-year parameter
# --------------------------------------------------------------------------

@register("month_bounds", "A2 A3", """
WITH m AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS mo FROM orders)
SELECT strftime(make_date(y, mo, 1), '%Y%m') AS month_ref,
       strftime(make_date(y, mo, 1), '%Y-%m-%d') AS first_day,
       strftime(last_day(make_date(y, mo, 1)), '%Y-%m-%d') AS last_day,
       strftime(make_date(y, mo, 1), '%Y-%m-%d') || '_' || strftime(last_day(make_date(y, mo, 1)), '%Y-%m-%d') AS start_end,
       lpad(CAST(y AS VARCHAR), 4, '0') || '00' AS fiscal_param
FROM m
""")
def month_bounds_q(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")).distinct()
    b = month_bounds("y", "mo")
    return m.select(month_ref(b["first_day"]).alias("month_ref"),
                    F.date_format(b["first_day"], "yyyy-MM-dd").alias("first_day"),
                    F.date_format(b["last_day"], "yyyy-MM-dd").alias("last_day"),
                    b["start_end"].alias("start_end"),
                    fiscal_year_param("y").alias("fiscal_param"))


# --------------------------------------------------------------------------
# Surrogate keys with Python-style float text
# --------------------------------------------------------------------------

@register("surrogate_keys", "A13 A3", """
SELECT concat_ws('_', CAST(l_orderkey AS VARCHAR), strftime(l_shipdate, '%Y%m'),
                 CAST(l_linenumber AS VARCHAR), CAST(l_extendedprice AS VARCHAR)) AS id,
       strftime(l_shipdate, '%Y%m') AS mes_referencia
FROM lineitem
""")
def surrogate_keys(spark, sf_dir):
    """``{orderkey}_{YYYYMM}_{linenumber}_{price}`` as the reference's
    f-string would print it (floats in Python's repr form)."""
    li = table(spark, sf_dir, "lineitem")
    price = py_float_text(F.col("l_extendedprice").cast("string"))
    return li.select(surrogate_key([F.col("l_orderkey"), month_ref("l_shipdate"),
                                    F.col("l_linenumber"), price]).alias("id"),
                     month_ref("l_shipdate").alias("mes_referencia"))


# --------------------------------------------------------------------------
# JSON column extraction
# --------------------------------------------------------------------------

@register("json_extract", "A8", """
SELECT event_type, COUNT(*) AS n_events, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k,
       MAX(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k
FROM events GROUP BY event_type
""")
def json_extract(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum(k).alias("sum_k"),
                                       F.max(k).alias("max_k"))


# --------------------------------------------------------------------------
# REAL affinity over money text (plain and thousands-separated)
# --------------------------------------------------------------------------

_NUM_RE = NUMERIC_TEXT.replace("\\s", "[ \\t\\n\\r]")


@register("coerce_affinity", "A14", rf"""
WITH t AS (
  SELECT l_returnflag, CAST(l_extendedprice AS VARCHAR) AS plain, format('{{:,.2f}}', l_extendedprice) AS grouped FROM lineitem)
SELECT l_returnflag,
       CAST(SUM(CASE WHEN regexp_matches(plain, '{_NUM_RE}') THEN 1 ELSE 0 END) AS BIGINT) AS n_plain_ok,
       CAST(SUM(CASE WHEN regexp_matches(grouped, '{_NUM_RE}') THEN 1 ELSE 0 END) AS BIGINT) AS n_grouped_ok,
       CAST(SUM(CASE WHEN regexp_matches(grouped, '{_NUM_RE}') THEN 0 ELSE 1 END) AS BIGINT) AS n_quarantined,
       CAST(SUM(CAST(TRY_CAST(trim(plain) AS DOUBLE) AS DECIMAL(18,2))) AS DOUBLE) AS plain_total
FROM t GROUP BY l_returnflag
""")
def coerce_affinity(spark, sf_dir):
    """Money text coerced with SQLite REAL-affinity rules: plain numbers pass,
    thousands-separated text (``1,234.50``) is quarantined, not misread."""
    li = table(spark, sf_dir, "lineitem")
    s = F.lit("string")
    plain = real_affinity_of(s, F.col("l_extendedprice").cast("string"))
    grouped = real_affinity_of(s, F.format_number("l_extendedprice", 2))
    return (li.select("l_returnflag", plain.alias("p"), grouped.alias("g"))
            .groupBy("l_returnflag")
            .agg(F.count(F.when(~F.col("p.bad"), 1)).alias("n_plain_ok"),
                 F.count(F.when(~F.col("g.bad"), 1)).alias("n_grouped_ok"),
                 F.count(F.when(F.col("g.bad"), 1)).alias("n_quarantined"),
                 F.sum(F.col("p.value").cast("decimal(18,2)")).cast("double").alias("plain_total")))


# --------------------------------------------------------------------------
# Latest version per key (INSERT OR REPLACE semantics)
# --------------------------------------------------------------------------

@register("upsert_latest", "A15", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                   ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
      FROM lineitem) WHERE rn = 1
""")
def upsert_latest_q(spark, sf_dir):
    """(l_orderkey, l_linenumber) has up to 6 versions; the latest by
    (shipdate, partkey, suppkey) wins. ``max_by`` aggregation, not a window."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                   "l_shipdate", "l_quantity")
    out = latest_per_key(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


# --------------------------------------------------------------------------
# Ledger state = latest event per key
# --------------------------------------------------------------------------

@register("ledger_state", "A17", """
SELECT user_id, event_type AS status, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS last_updated
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""")
def ledger_state(spark, sf_dir):
    """Events as status updates per user; current state = the latest one (ties:
    the largest event_id)."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), "value", "ts", "event_id")
    cur = L.ledger_current(e, ["user_id"], ts="ts", tie="event_id")
    return cur.select("user_id", "status", "value",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_updated"))


# --------------------------------------------------------------------------
# Rows saved vs distinct ids
# --------------------------------------------------------------------------

@register("record_count", "A18", """
SELECT strftime(l_shipdate, '%Y') AS year, COUNT(*) AS n_saved,
       COUNT(DISTINCT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)) AS n_ids,
       COUNT(*) - COUNT(DISTINCT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)) AS n_collapsed
FROM lineitem GROUP BY 1
""")
def record_count(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.date_format("l_shipdate", "yyyy").alias("year"),
                     surrogate_key([F.col("l_orderkey"), F.col("l_linenumber")]).alias("id"))
    return L.record_counts(rows, ["year"])


# --------------------------------------------------------------------------
# Pending tasks = grid minus COMPLETED
# --------------------------------------------------------------------------

@register("pending_tasks", "A19", """
WITH y AS (SELECT CAST(unnest(generate_series(min(year(o_orderdate)), max(year(o_orderdate)))) AS INTEGER) AS year FROM orders),
done AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS year FROM orders WHERE o_orderstatus = 'F')
SELECT c.c_custkey, y.year FROM customer c CROSS JOIN y
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.o_custkey = c.c_custkey AND d.year = y.year)
""")
def pending_tasks_q(spark, sf_dir):
    """Tasks = every customer x every order year; a task is COMPLETED when the
    customer has a status-F order that year. Pending = the rest (left anti)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    years = o.agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    # the year range is one row; attach it with a scalar subquery, not a join
    grid = c.select("c_custkey", F.explode(F.sequence(years.select("lo").scalar(),
                                                      years.select("hi").scalar())).alias("year"))
    ledger = (o.filter(F.col("o_orderstatus") == "F")
              .select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"),
                      F.lit("COMPLETED").alias("status")))
    return L.pending_tasks(grid, ledger, key=["c_custkey", "year"])


# --------------------------------------------------------------------------
# Coverage gaps per customer
# --------------------------------------------------------------------------

@register("coverage_gaps", "A20", """
WITH span AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi
              FROM orders GROUP BY o_custkey),
g AS (SELECT o_custkey, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM span),
have AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS m FROM orders)
SELECT g.o_custkey, strftime(g.m, '%Y%m') AS month_ref FROM g
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.o_custkey = g.o_custkey AND h.m = g.m)
""")
def coverage_gaps_q(spark, sf_dir):
    """Months between a customer's first and last order with no order: the
    silent gaps. Spine per key via ``explode(sequence)`` over integer month
    indexes; gaps via an anti join on (key, month index); only the gap rows
    are formatted as ``YYYYMM``."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    idx = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    # one scan: the distinct (customer, month) set feeds both the span and the
    # anti join (the same exchange is reused)
    have = o.select("o_custkey", idx.alias("m")).distinct()
    span = have.groupBy("o_custkey").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    grid = L.month_grid(span, F.col("lo"), F.col("hi")).withColumnRenamed("month_index", "m")
    gaps = L.coverage_gaps(grid, have.withColumn("http_status", F.lit(200)), ["o_custkey", "m"])
    return gaps.select("o_custkey", F.format_string("%04d%02d", F.floor(F.col("m") / 12).cast("int"),
                                                    (F.col("m") % 12 + 1).cast("int")).alias("month_ref"))


# --------------------------------------------------------------------------
# Code decoding through a bounded dimension (unknown -> NULL)
# --------------------------------------------------------------------------

@register("decode_codes", "B5", """
SELECT s.s_suppkey, s.s_nationkey, n.n_name, r.r_name
FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
""")
def decode_codes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    named = decode(s, n, "s_nationkey", "n_nationkey")
    return (decode(named, r, "n_regionkey", "r_regionkey")
            .select("s_suppkey", "s_nationkey", "n_name", "r_name"))


# --------------------------------------------------------------------------
# Explode with 0-based position (lines of every document)
# --------------------------------------------------------------------------

@register("explode_lines", "A7", r"""
SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos,
       unnest(string_split(text, chr(10))) AS line
FROM documents
""")
def explode_lines(spark, sf_dir):
    """Every line of every document with its 0-based position (``posexplode``,
    the same operator that numbers the items of a payload)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


# --------------------------------------------------------------------------
# §2.9 json_each: every key/value of a JSON object column
# --------------------------------------------------------------------------

@register("json_each", "A8 §2.9", """
SELECT e.event_id, j.key AS key, CAST(j.value AS BIGINT) AS value
FROM events e, json_each(e.props) j
""")
def json_each(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


# --------------------------------------------------------------------------
# A4-A14 end to end: landed expense payloads -> silver rows
# --------------------------------------------------------------------------

_ITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

# Stand-in municipalities are groups of keys, so that a month of one holds a few
# hundred items at any scale: 40 suppliers, 1,000 customers, 5 users.
SUPPLIERS, CUSTOMERS, USERS = 40, 1000, 5


def _delivered(grouped, deliveries):
    """A month's row for each of its ``deliveries`` (an array of run_id, http_status,
    again and empty), by default once as run r1."""
    if deliveries is None:
        deliveries = F.array(F.struct(F.lit("r1").alias("run_id"), F.lit(200).alias("http_status"),
                                      F.lit(False).alias("again"), F.lit(False).alias("empty")))
    given = grouped.select("*", F.explode(deliveries).alias("_d"))
    return given.select("*", "_d.*").drop("_d")


def _or_empty(body):
    """The body of a delivery (``_delivered``)."""
    return F.when(F.col("empty"), F.lit('{"data":[]}')).otherwise(body)


def expense_payloads(spark, sf_dir, revised=None, bad_money=None, tasks=None, deliveries=None):
    """Stand-in landed responses built from ``lineitem``: one expense item per
    line, one response per (group of suppliers as municipality, year, month) with
    the whole month in item order, wrapped in one of the three envelopes the
    finance feed uses. Only rows in the payload schema; the ingest does the work.

    With ``tasks`` the months are dealt out into that many partitions, whatever
    their bytes: few bytes of lines are much work to parse. ``deliveries`` says how
    often a month is delivered (``_delivered``): again with revised values, or
    empty; the lines are gathered once for all of them."""
    li = table(spark, sf_dir, "lineitem")
    key = [F.floor(F.col("l_suppkey") / SUPPLIERS).cast("string").alias("municipio_id"),
           F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")]
    # a line is collected once, as its own columns (and what was given to revise
    # it); its item is made of them when the month is in order
    given = {}
    if revised is not None:
        given["paid"] = F.when(revised, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    if bad_money is not None:
        given["cleared"] = F.when(bad_money, F.lit("1,5")).otherwise(F.col("l_extendedprice").cast("string"))
    line = F.struct(*_ITEM_ORDER, *[c.alias(n) for n, c in given.items()])
    lines = li.select(*key, line.alias("_line"))
    if tasks is not None:
        lines = lines.repartition(tasks, "municipio_id", "year", "month")
    grouped = lines.groupBy("municipio_id", "year", "month").agg(
        F.sort_array(F.collect_list("_line")).alias("_rows"))
    grouped = _delivered(grouped, deliveries)
    again = F.col("again")

    def item(r):
        paid = r["paid" if "paid" in given else "l_quantity"]
        return F.struct(r["l_returnflag"].alias("codigo_orgao"),
                        r["l_linestatus"].alias("codigo_unidade_orcamentaria"),
                        r["l_suppkey"].cast("string").alias("codigo_funcao"),
                        r["l_partkey"].cast("string").alias("codigo_subfuncao"),
                        r["l_orderkey"].cast("string").alias("codigo_programa"),
                        r["l_linenumber"].cast("string").alias("codigo_elemento_despesa"),
                        r["l_extendedprice"].alias("valor_empenhado_no_mes"),
                        r["cleared" if "cleared" in given else "l_extendedprice"].alias("valor_liquidado_no_mes"),
                        F.when(again, paid + 1).otherwise(paid).alias("valor_pago_no_mes"))

    items = F.transform("_rows", item)
    env = F.col("month") % 3
    body = (F.when(env == 0, F.to_json(F.struct(items.alias("data"))))
            .when(env == 1, F.to_json(F.struct(F.struct(items.alias("_content")).alias("rsp"))))
            .otherwise(F.to_json(F.struct(items.alias("balancete_despesa_orcamentaria")))))
    return grouped.select("run_id", F.lit("despesas").alias("source"), "municipio_id",
                          "year", "month", "http_status", _or_empty(body).alias("body"),
                          F.lit(None).cast("string").alias("path"))


@register("ingest_expenses", "A6 A7 A12 A13 A14", f"""
WITH li AS (SELECT *, CAST(l_suppkey // {SUPPLIERS} AS VARCHAR) AS muni FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY muni, year(l_shipdate), month(l_shipdate)
                                   ORDER BY {", ".join(_ITEM_ORDER)}) - 1 AS pos FROM li)
SELECT concat_ws('_', muni, strftime(l_shipdate, '%Y%m'), CAST(l_linenumber AS VARCHAR),
                 CAST(l_quantity AS VARCHAR), CAST(pos AS VARCHAR)) AS id,
       muni AS municipio_id, strftime(l_shipdate, '%Y') AS exercicio_orcamento,
       strftime(l_shipdate, '%Y%m') AS mes_referencia, l_returnflag AS codigo_orgao,
       l_linestatus AS codigo_unidade_orcamentaria, CAST(l_suppkey AS VARCHAR) AS codigo_funcao,
       CAST(l_partkey AS VARCHAR) AS codigo_subfuncao, CAST(l_orderkey AS VARCHAR) AS codigo_programa,
       CAST(l_linenumber AS VARCHAR) AS codigo_elemento_despesa, l_extendedprice AS valor_empenhado,
       l_extendedprice AS valor_liquidado, l_quantity AS valor_pago, CAST(NULL AS VARCHAR) AS quarantine_reason
FROM r
""")
def ingest_expenses(spark, sf_dir):
    """The ingest job (envelope unwrap, item explode with positions, field
    projection, surrogate keys, TEXT/REAL affinity, quarantine flag) over
    landed expense responses built from ``lineitem``."""
    from erario.operators.ingest import ingest

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ingest(expense_payloads(spark, sf_dir, tasks=tasks), "despesas")
    return rows.drop("raw_data", "run_id", "month", "path", "pos")


def tender_payloads(spark, sf_dir, deliveries=None):
    """Stand-in landed tender responses built from ``orders``: one tender per
    order (the customer as tender number, so numbers repeat within a year),
    one response per (group of customers as municipality, year, month), as a bare
    list or as ``{"data": [...]}``."""
    o = table(spark, sf_dir, "orders")
    key = [F.floor(F.col("o_custkey") / CUSTOMERS).cast("string").alias("municipio_id"), F.year("o_orderdate").alias("year"),
           F.month("o_orderdate").alias("month")]
    o = o.select(*key, "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice")
    item = F.struct(F.col("o_custkey").cast("string").alias("numero_licitacao"),
                    F.col("o_orderkey").cast("string").alias("numero_processo_licitatorio"),
                    F.col("o_orderstatus").alias("objeto_licitacao"),
                    F.col("o_orderpriority").alias("modalidade_licitacao"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("data_realizacao_licitacao"),
                    F.col("o_totalprice").alias("valor_licitacao"),
                    F.col("o_orderstatus").alias("situacao_licitacao"))
    g = o.groupBy("municipio_id", "year", "month").agg(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey"), item.alias("item")))).alias("_rows"))
    g = _delivered(g, deliveries)
    items = F.transform("_rows", lambda r: F.when(F.col("again"), r["item"].withField("situacao_licitacao", F.lit("X")))
                        .otherwise(r["item"]))
    body = F.when(F.col("month") % 2 == 0, F.to_json(items)).otherwise(F.to_json(F.struct(items.alias("data"))))
    return g.select("run_id", F.lit("licitacoes").alias("source"), "municipio_id", "year",
                    "month", "http_status", _or_empty(body).alias("body"),
                    F.lit(None).cast("string").alias("path"))


@register("ingest_tenders", "A5 A7 A12 A13 A15 F11", f"""
WITH r AS (SELECT *, CAST(o_custkey // {CUSTOMERS} AS VARCHAR) AS muni FROM orders),
k AS (SELECT *, muni || '_' || CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y') AS id FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY month(o_orderdate) DESC, o_orderkey DESC) AS rn FROM k)
SELECT id, muni AS municipio_id, CAST(o_custkey AS VARCHAR) AS numero_licitacao,
       CAST(o_orderkey AS VARCHAR) AS numero_processo, o_orderstatus AS objeto_licitacao,
       o_orderpriority AS modalidade_licitacao, strftime(o_orderdate, '%Y-%m-%d') AS data_realizacao_licitacao,
       o_totalprice AS valor_estimado, o_orderstatus AS situacao_licitacao,
       strftime(o_orderdate, '%Y') AS exercicio_orcamento
FROM w WHERE rn = 1
""")
def ingest_tenders(spark, sf_dir):
    """The tender ingest (list / ``data`` envelopes, lossy ``municipio_numero_ano``
    key) followed by INSERT-OR-REPLACE semantics: per id the last month, file
    and position wins (``upsert_latest``)."""
    from erario.operators.ingest import ingest, valid
    from erario.operators.upsert import upsert_latest

    rows = valid(ingest(tender_payloads(spark, sf_dir), "licitacoes"))
    latest = upsert_latest(None, rows, ["id"], ["run_id", "month", "path", "pos"], stamp=None)
    return latest.drop("raw_data", "run_id", "month", "path", "pos")


def revenue_payloads(spark, sf_dir, deliveries=None):
    """Stand-in landed revenue responses built from ``events``: one revenue
    item per event (its JSON ``props`` text as the description), one response
    per (group of users as municipality, year, month), in one of the three
    finance envelopes."""
    e = table(spark, sf_dir, "events")
    key = [F.floor(F.col("user_id") / USERS).cast("string").alias("municipio_id"), F.year("ts").alias("year"),
           F.month("ts").alias("month")]
    e = e.select(*key, "event_id", "event_type", "value", "props")
    item = F.struct(F.lit("01").alias("codigo_orgao"), F.col("municipio_id").alias("codigo_unidade_orcamentaria"),
                    F.col("event_type").alias("codigo_receita"), F.col("props").alias("descricao_receita"),
                    F.col("value").alias("valor_previsto_arrecadacao"),
                    F.col("value").alias("valor_arrecadado_no_mes"))
    g = e.groupBy("municipio_id", "year", "month").agg(
        F.array_sort(F.collect_list(F.struct(F.col("event_id"), item.alias("item")))).alias("_rows"))
    g = _delivered(g, deliveries)
    raised = lambda i: i.withField("valor_arrecadado_no_mes", i["valor_arrecadado_no_mes"] + 1)
    items = F.transform("_rows", lambda r: F.when(F.col("again"), raised(r["item"])).otherwise(r["item"]))
    env = F.col("municipio_id").cast("long") % 3
    body = (F.when(env == 0, F.to_json(F.struct(F.struct(items.alias("_content")).alias("rsp"))))
            .when(env == 1, F.to_json(F.struct(items.alias("balancete_receita_orcamentaria"))))
            .otherwise(F.to_json(F.struct(F.array().cast("array<string>").alias("data"), items.alias("rows")))))
    return g.select("run_id", F.lit("receitas").alias("source"), "municipio_id", "year",
                    "month", "http_status", _or_empty(body).alias("body"),
                    F.lit(None).cast("string").alias("path"))


@register("ingest_revenue", "A6 A7 A12 A13 A14", f"""
WITH u AS (SELECT *, CAST(user_id // {USERS} AS VARCHAR) AS muni FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY muni, year(ts), month(ts) ORDER BY event_id) - 1 AS pos FROM u)
SELECT concat_ws('_', muni, strftime(ts, '%Y%m'), event_type, CAST(value AS VARCHAR),
                 CAST(pos AS VARCHAR)) AS id,
       muni AS municipio_id, strftime(ts, '%Y') AS exercicio_orcamento,
       strftime(ts, '%Y%m') AS mes_referencia, '01' AS codigo_orgao,
       muni AS codigo_unidade_orcamentaria, event_type AS codigo_receita,
       props AS descricao_receita, value AS valor_orcado, value AS valor_arrecadado,
       CAST(NULL AS VARCHAR) AS quarantine_reason
FROM r
""")
def ingest_revenue(spark, sf_dir):
    """The revenue ingest (``rsp._content``, ``balancete_receita_orcamentaria``
    and ``rows``-after-empty-``data`` envelopes, renamed money fields, keys
    with the collected value) over landed responses built from ``events``."""
    from erario.operators.ingest import ingest

    rows = ingest(revenue_payloads(spark, sf_dir), "receitas")
    return rows.drop("raw_data", "run_id", "month", "path", "pos")
