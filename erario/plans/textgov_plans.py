"""Text governance over the test tables:
accent folding and search, redaction, sensor counts, screening, last turns,
statement checks, truncation and BRL formatting. Whole texts, every row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from erario.functions import text as X
from erario.operators.conversations import last_turn
from erario.operators.search import search_folded, write_trigram_index
from erario.plans.registry import register
from erario.session import scratch_dir
from erario.sources.tables import table

_SENSOR_SQL = ",\n       ".join(
    f"CAST(SUM(len(regexp_extract_all(text, '{X._sql_str(p)}'))) AS BIGINT) AS n_{n}" for n, p, _ in X.REDACTION_RULES)
_VERDICT_SQL, _HITS_SQL = X.screen_sql("text")


@register("accent_fold", "B4", """
SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents
""")
def accent_fold_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.accent_fold("text").alias("folded"))


@register("accent_search", "B4 B3", """
SELECT lang, COUNT(*) AS n_docs,
       CAST(SUM(CASE WHEN contains(lower(strip_accents(text)), 'ete') THEN 1 ELSE 0 END) AS BIGINT) AS n_match
FROM documents GROUP BY lang
""")
def accent_search(spark, sf_dir):
    """Documents containing 'ÉTÉ' regardless of accents and case, per language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"),
                                 F.count(F.when(X.contains_folded("text", "ÉTÉ"), 1)).alias("n_match"))


#: Rare words, a common one, one without a trigram, and words of no text.
_KEYWORDS = ("ÉTÉ", "übung", "Niño", "contract", "é", "número", "xqzw", "licença")


def _search_sql() -> str:
    parts = []
    for k in _KEYWORDS:
        folded = f"lower(strip_accents('{k}'))"
        counts = f"(SELECT list_min(list_transform(range(1, length({folded}) - 1), lambda i: n[i])) FROM (SELECT [" + ", ".join(
            f"count(*) FILTER (contains(f, substr({folded}, {i + 1}, 3)))" for i in range(max(len(k) - 2, 0))) + "] AS n FROM t))"
        n_read = counts if len(k) >= 3 else "(SELECT count(*) FROM t)"
        parts.append(f"SELECT '{k}' AS keyword, doc_id, {n_read}::BIGINT AS n_read FROM t WHERE contains(f, {folded})")
    return ("WITH t AS (SELECT doc_id, lower(strip_accents(text)) AS f FROM documents WHERE text IS NOT NULL)\n"
            + "\nUNION ALL ".join(parts))


@register("folded_search", "B3 B4", _search_sql())
def folded_search(spark, sf_dir):
    """Documents that contain each of several keywords regardless of accents and
    case, found by their rarest trigrams, and how many texts were read for each."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = scratch_dir(spark, "trigrams")
    write_trigram_index(d, "doc_id", "text", index)
    return search_folded(d, "doc_id", "text", index, _KEYWORDS)


@register("redact_documents", "T1", f"""
SELECT doc_id, {X.redact_sql('text')} AS redacted FROM documents
""")
def redact_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.redact("text").alias("redacted"))


@register("sensor_counts", "T2", f"""
SELECT lang, source, COUNT(*) AS n_docs,
       {_SENSOR_SQL}
FROM documents GROUP BY lang, source
""")
def sensor_counts(spark, sf_dir):
    """Hits per sensor, per language and source."""
    d = table(spark, sf_dir, "documents")
    per_doc = d.select("lang", "source", *X.sensor_counts("text"))
    names = [f"n_{n}" for n, _, _ in X.REDACTION_RULES]
    return per_doc.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"),
                                                 *[F.sum(c).alias(c) for c in names])


@register("screen_messages", "T3", f"""
SELECT conv_id, turn, {_VERDICT_SQL} AS verdict, {_HITS_SQL} AS hits
FROM conversations WHERE role = 'user'
""")
def screen_messages(spark, sf_dir):
    """Every user message screened SAFE/UNSAFE by the rule table."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    c = c.select("conv_id", "turn", X.screen_hits("text").alias("hits"))
    return c.select("conv_id", "turn", X.verdict_of(F.col("hits")).alias("verdict"), "hits")


@register("last_turn", "T4", """
SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text
FROM conversations WHERE role = 'user' GROUP BY conv_id
""")
def last_turn_q(spark, sf_dir):
    """Last user message of each conversation (``max_by``, map-side combined)."""
    return last_turn(table(spark, sf_dir, "conversations"), role="user")


@register("last_context_free_turn", "T4", """
SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text
FROM conversations WHERE role <> 'system' GROUP BY conv_id
""")
def last_context_free_turn(spark, sf_dir):
    """Last message of each conversation that is not context (system role)."""
    return last_turn(table(spark, sf_dir, "conversations"), exclude_roles=["system"])


@register("statement_check", "T7", f"""
SELECT role, COUNT(*) AS n_messages,
       CAST(SUM(CASE WHEN starts_with(upper(regexp_replace(s, '^[{X.BLANKS}]+', '')), 'SELECT') THEN 1 ELSE 0 END) AS BIGINT) AS n_select
FROM (SELECT role, CASE turn % 5 WHEN 0 THEN 'SELECT ' WHEN 1 THEN chr(10) || chr(9) || ' sElEcT' WHEN 2 THEN 'insert select '
             WHEN 3 THEN '-- select' || chr(10) ELSE '' END || text AS s FROM conversations) GROUP BY role
""")
def statement_check(spark, sf_dir):
    """How many messages would pass the read-only SELECT gate, per role; some
    start with the word in any case and after blanks, some hold it later."""
    c = table(spark, sf_dir, "conversations")
    kind = F.col("turn") % 5
    start = (F.when(kind == 0, "SELECT ").when(kind == 1, "\n\t sElEcT").when(kind == 2, "insert select ")
             .when(kind == 3, "-- select\n").otherwise(""))
    c = c.select("role", F.concat(start, "text").alias("text"))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n_messages"),
                                 F.count(F.when(X.is_readonly_select("text"), 1)).alias("n_select"))


@register("truncate_marked", "T11", """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '... [TRUNCATED]' ELSE text END AS summary
FROM documents
""")
def truncate_marked(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.truncate_marked("text", 2000).alias("summary"))


@register("format_brl", "T12", """
SELECT c_custkey,
       CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) < 0 THEN '-' ELSE '' END || 'R$ ' ||
       translate(format('{:,.2f}', abs(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE))), ',.', '.,') AS balance
FROM customer
""")
def format_brl(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.format_brl("c_acctbal").alias("balance"))


@register("strip_code_fences", "T6", f"""
SELECT doc_id, regexp_replace(replace(replace(t, '```sql', ''), '```', ''), '^[{X.BLANKS}]+|[{X.BLANKS}]+$', '', 'g') AS code,
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^[{X.BLANKS}]+|[{X.BLANKS}]+$', '', 'g'), '^```(python)?', ''), '```$', ''),
                      '^[{X.BLANKS}]+|[{X.BLANKS}]+$', '', 'g') AS script
FROM (SELECT doc_id, '  ```sql' || chr(10) || replace(text, chr(10), chr(10) || '``` a' || chr(10) || '```sql ') || chr(10) || '``` ' AS t,
             chr(10) || CASE doc_id % 2 WHEN 0 THEN '```python' ELSE '```' END || chr(10) || replace(text, chr(10), chr(10) || '```') || '``` ' AS p
      FROM documents)
""")
def strip_code_fences(spark, sf_dir):
    """Every document fenced as SQL and as a script, with fences inside: the SQL
    variant takes all of them off, the other the outer ones alone."""
    d = table(spark, sf_dir, "documents")
    sql = F.concat(F.lit("  ```sql\n"), F.replace("text", F.lit("\n"), F.lit("\n``` a\n```sql ")), F.lit("\n``` "))
    script = F.concat(F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "```python").otherwise("```"), F.lit("\n"),
                      F.replace("text", F.lit("\n"), F.lit("\n```")), F.lit("``` "))
    return d.select("doc_id", X.strip_code_fence(sql, anywhere=True).alias("code"), X.strip_code_fence(script).alias("script"))


_AUDIT_SQL = """SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM {orders} WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderpriority HAVING count(*) > 1"""


@register("readonly_sql", "Q1", _AUDIT_SQL.format(orders="orders"))
def readonly_sql(spark, sf_dir):
    """A statement that passes the read-only gate, run over the orders."""
    from erario.operators.readonly import run_readonly_sql

    table(spark, sf_dir, "orders").createOrReplaceTempView("audit_orders")
    return run_readonly_sql(spark, _AUDIT_SQL.format(orders="audit_orders"))


@register("decode_results", "T8", """
SELECT event_id, CAST(p.pos AS INTEGER) AS pos, CASE WHEN p.ok THEN coalesce(json_extract_string(props, '$.k'), '0') END AS k, p.raw
FROM events, LATERAL (SELECT unnest(CASE event_id % 3 WHEN 0 THEN [0, 1] ELSE [NULL] END) AS pos,
                             event_id % 3 <> 2 AS ok, CASE WHEN event_id % 3 = 2 THEN 'props: ' || props END AS raw) p
""")
def decode_results(spark, sf_dir):
    """Event properties as tool results: a list of two, an object, or text that
    is no JSON, decoded to rows."""
    from erario.operators.decode import decode_rows

    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 3
    result = (F.when(kind == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]")))
              .when(kind == 1, F.col("props")).otherwise(F.concat(F.lit("props: "), "props")))
    return decode_rows(e.select("event_id", result.alias("result")), "result", {"k": 0})


@register("classify_outcomes", "T9", """
SELECT conv_id, turn, CASE WHEN starts_with(o, 'Execution Error') OR starts_with(o, 'System Error') OR contains(o, 'Traceback')
       THEN 'error' ELSE 'ok' END AS outcome
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Execution Error: ' WHEN 1 THEN 'result: Execution Error ' WHEN 2 THEN 'Traceback ' ELSE '' END
             || text AS o FROM conversations)
""")
def classify_outcomes(spark, sf_dir):
    """Every message as the output of a run."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn") % 4
    start = (F.when(t == 0, F.lit("Execution Error: ")).when(t == 1, F.lit("result: Execution Error "))
             .when(t == 2, F.lit("Traceback ")).otherwise(F.lit("")))
    return c.select("conv_id", "turn", X.classify_outcome(F.concat(start, "text")).alias("outcome"))


@register("parse_verdicts", "T10", """
SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 'APPROVE' ELSE 'REJECT' END AS verdict,
       CASE turn % 3 WHEN 0 THEN 'CODE' END AS target, CASE WHEN turn % 3 < 2 THEN nullif(ltrim(text, ' '), '') END AS reason
FROM conversations
""")
def parse_verdicts(spark, sf_dir):
    """Every whole message, of one line or several, as a reviewer's reason."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn") % 3
    head = F.when(t == 0, F.lit("REJECT [CODE]: ")).when(t == 1, F.lit("REJECT: ")).otherwise(F.lit("APPROVE: "))
    v = X.parse_verdict(F.concat(head, "text"))
    return c.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.verdict", "v.target", "v.reason")


@register("trace_log", "A11", """
SELECT event_type AS component, count(*) FILTER (event_id % 50 <> 0) AS spans, count(*) FILTER (event_id % 50 = 0) AS corrupt
FROM events GROUP BY event_type
""")
def trace_log(spark, sf_dir):
    """Events as a landed trace log with a broken line now and then, read back:
    spans and corrupt lines per component."""
    from erario.session import scratch_dir
    from erario.sources.logs import read_trace_log

    e = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("component"), F.col("ts").cast("string").alias("timestamp"),
                              F.col("value").alias("latency_ms")))
    path = scratch_dir(spark, "trace-log")
    (e.select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("{broken "), "event_type")).otherwise(line).alias("value"))
     .write.text(path))
    log = read_trace_log(spark, path)
    named = F.coalesce("component", F.regexp_extract("_corrupt_record", "^\\{broken (.*)$", 1))
    return (log.groupBy(named.alias("component"))
            .agg(F.count(F.when(~F.col("corrupt"), 1)).alias("spans"), F.count(F.when(F.col("corrupt"), 1)).alias("corrupt")))


@register("etl_log", "A11", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'INFO' ELSE 'WARNING' END AS level,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS at,
       CASE WHEN event_id % 3 = 0 THEN 'Traceback (most recent call last):' || chr(10) || '  ' || event_type || chr(10) || 'ValueError: ' || props END AS detail,
       CAST(CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END AS BIGINT) AS n_lines
FROM events
""")
def etl_log(spark, sf_dir):
    """Events as a landed load log in which every third record has a traceback,
    read back as whole records, across the splits of its files."""
    from erario.session import scratch_dir
    from erario.sources.logs import read_etl_records

    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 3
    level = F.when(kind == 0, "ERROR").when(kind == 1, "INFO").otherwise("WARNING")
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",000 - "), level, F.lit(" - event "), F.col("event_id").cast("string"))
    trace = F.concat(F.lit("\nTraceback (most recent call last):\n  "), "event_type", F.lit("\nValueError: "), "props")
    path = scratch_dir(spark, "etl-log")
    e.select(F.concat(head, F.when(kind == 0, trace).otherwise("")).alias("value")).write.text(path)
    r = read_etl_records(spark, path)
    return r.select(F.regexp_extract("message", "^event (.*)$", 1).cast("long").alias("event_id"), "level",
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "detail", "n_lines")


@register("month_refs", "C7", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE strftime(l_shipdate, '%Y%m') END AS month_ref
FROM lineitem
""")
def month_refs(spark, sf_dir):
    """Month references in their three spellings and a wrong one, normalised."""
    from erario.functions.dates import normalize_month_ref

    li = table(spark, sf_dir, "lineitem")
    kind, d = F.col("l_linenumber") % 4, F.col("l_shipdate")
    mes = (F.when(kind == 0, F.date_format(d, "yyyyMM")).when(kind == 1, F.date_format(d, "MM"))
           .when(kind == 2, F.month(d).cast("string")).otherwise(F.lit("13")))
    return li.select("l_orderkey", "l_linenumber", normalize_month_ref(mes, F.year(d)).alias("month_ref"))
