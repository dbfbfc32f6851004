"""Streaming: payload feed (ST1) and windowed event counts (ST2)."""

import json

from conftest import SF_SMALL, land
from pyspark.sql import functions as F

from erario.operators.ledger import ledger_current
from erario.operators.load import ledger, run_load
from erario.streaming.events import late_counts, run_window_counts, window_counts
from erario.streaming.payload_feed import start_payload_feed

EXP = {"codigo_funcao": "10", "codigo_elemento_despesa": "339039", "valor_pago_no_mes": 80.0}


def test_payload_feed_incremental(spark, tmp_root):
    landing, silver, ck = tmp_root + "/landing", tmp_root + "/silver", tmp_root + "/ck"
    land(landing, "r1", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP]}))
    land(landing, "r1", "licitacoes", "0162", 2024, 1, 200, json.dumps([{"numero_licitacao": "A", "valor_licitacao": 1.0}]))
    start_payload_feed(spark, landing, silver, checkpoint=ck).awaitTermination()
    assert spark.read.parquet(silver + "/despesas").count() == 1
    # a later delivery: a new month, and January re-sent with two items
    land(landing, "r2", "despesas", "0162", 2024, 2, 200, json.dumps({"data": [EXP]}))
    land(landing, "r2", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP, dict(EXP, codigo_funcao="12")]}))
    land(landing, "r2", "licitacoes", "0162", 2024, 3, 200, json.dumps([{"numero_licitacao": "A", "valor_licitacao": 3.0}]))
    start_payload_feed(spark, landing, silver, checkpoint=ck).awaitTermination()
    d = spark.read.parquet(silver + "/despesas")
    per = {r.mes_referencia: r.n for r in d.groupBy("mes_referencia").agg(F.count("*").alias("n")).collect()}
    assert per == {"202401": 2, "202402": 1}
    t = spark.read.parquet(silver + "/licitacoes").collect()
    assert [(r.id, r.valor_estimado) for r in t] == [("0162_A_2024", 3.0)]


def test_feed_does_not_depend_on_batch_size(spark, tmp_root):
    landing = tmp_root + "/landing"
    for name in ("a.json", "b.json", "c.json"):  # three files of one month
        land(landing, "r1", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP]}), name)
    land(landing, "r1", "receitas", "0162", 2024, 1, 200, json.dumps({"data": [{"codigo_receita": "1"}]}))
    got = []
    for n in (None, 1):
        silver = f"{tmp_root}/silver{n}"
        start_payload_feed(spark, landing, silver, checkpoint=f"{tmp_root}/ck{n}", max_files=n).awaitTermination()
        tables = [spark.read.parquet(f"{silver}/despesas"), spark.read.parquet(f"{silver}/receitas"), ledger_current(ledger(spark, silver))]
        got.append([sorted(map(str, t.drop("updated_at", "last_updated", "load_id").collect())) for t in tables])
    assert got[0] == got[1] and len(got[0][0]) == 3
    run_load(spark, landing, tmp_root + "/batch")
    assert got[0][0] == sorted(map(str, spark.read.parquet(tmp_root + "/batch/despesas").drop("updated_at").collect()))


def test_window_counts_over_many_files(spark, tmp_root):
    ev = spark.read.parquet(SF_SMALL + "/events.parquet")
    ev.repartition(48, "event_id").write.parquet(tmp_root + "/in/events.parquet")
    batch = window_counts(ev)
    streamed = run_window_counts(spark, tmp_root + "/in/events.parquet", "*.parquet")
    closed = streamed.select("window_start").distinct()
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.join(closed, "window_start").collect()))
    assert closed.count() == batch.select("window_start").distinct().count() - 1


def test_window_counts_batch_equals_stream_for_closed_windows(spark):
    ev = spark.read.parquet(SF_SMALL + "/events.parquet")
    batch = window_counts(ev)
    streamed = run_window_counts(spark, SF_SMALL, "events.parquet")
    closed = streamed.select("window_start").distinct()
    b = sorted(map(tuple, batch.join(closed, "window_start").collect()))
    s = sorted(map(tuple, streamed.collect()))
    assert s == b and len(s) > 0
    # the open last day is not emitted
    assert streamed.select("window_start").distinct().count() == batch.select("window_start").distinct().count() - 1


def test_late_events_are_counted(spark, tmp_root):
    source, sink, ck = tmp_root + "/in", tmp_root + "/sink", tmp_root + "/ck"

    def arrive(rows):
        df = spark.createDataFrame(rows, "t string, event_type string, value double")
        df.selectExpr("cast(t as timestamp) AS ts", "event_type", "value").coalesce(1).write.mode("append").parquet(source)
        return run_window_counts(spark, source, "*.parquet", sink=sink, checkpoint=ck)

    emitted = arrive([("2024-01-01 05:00:00", "a", 1.0), ("2024-01-02 05:00:00", "a", 2.0), ("2024-01-04 05:00:00", None, 4.0)])
    events = spark.read.parquet(source)
    assert emitted.count() == 2 and late_counts(events, emitted).collect() == []
    # a and b of the first day are late, the third day's window has closed without an event
    emitted = arrive([("2024-01-01 06:00:00", "a", 0.25), ("2024-01-01 07:00:00", "b", 3.5), ("2024-01-01 08:00:00", "b", None),
                      ("2024-01-04 06:00:00", None, 1.0), ("2024-01-06 00:00:00", "a", 9.0)])
    got = sorted(map(tuple, late_counts(spark.read.parquet(source), emitted).collect()))
    assert got == [("2024-01-01 00:00:00", "a", 1, 0.25), ("2024-01-01 00:00:00", "b", 2, 3.5)]
    assert ("2024-01-04 00:00:00", None, 2, 5.0) in set(map(tuple, emitted.collect()))
    assert late_counts(events, emitted.limit(0)).collect() == []
