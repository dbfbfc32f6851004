"""Catalog (B1-B3, B5) and the end-to-end load job."""

import json
import os
import uuid

import pytest
from conftest import land
from pyspark.sql import functions as F

from erario.operators import catalog as C
from erario.operators.ledger import ledger_current, pending_tasks, task_grid
from erario.operators.load import compact_records, ledger, pending_payloads, quarantine, run_load, touching
from erario.operators.readonly import run_readonly_sql
from erario.sources.payloads import scan_payloads

EXP = {"codigo_orgao": "01", "codigo_funcao": "10", "codigo_elemento_despesa": "339039",
       "valor_empenhado_no_mes": 100.0, "valor_liquidado_no_mes": 90.0, "valor_pago_no_mes": 80.0}


def test_catalog_search_and_describe(spark, tmp_root):
    db = "audit_" + uuid.uuid4().hex[:8]
    C.create_audit_tables(spark, db, root=tmp_root + "/wh")
    names = sorted(r.table for r in C.list_tables(spark, db).collect())
    assert names == ["despesas", "etl_metadata", "licitacoes", "receitas"]
    assert "codigo_funcao" in C.describe_table(spark, "despesas", db)
    assert C.describe_table(spark, "nope", db) == "Table 'nope' not found."
    hits = sorted(r.table for r in C.search_definitions(spark, "SAUDE", db).collect())
    assert hits == ["despesas"]
    assert sorted(r.table for r in C.search_definitions(spark, "receita", db).collect()) == ["etl_metadata", "receitas"]
    assert C.search_definitions(spark, "zzzz", db).count() == 0


def test_decode_function(spark):
    df = spark.createDataFrame([("10",), ("12",), ("99",)], "codigo_funcao string")
    got = {r.codigo_funcao: r.funcao for r in C.decode_function(df).collect()}
    assert got == {"10": "Saúde", "12": "Educação", "99": None}


def _rows(spark, path, *drop):
    df = spark.read.parquet(path).drop("updated_at", "last_updated", *drop)
    return sorted(map(str, df.collect()))


def test_load_job_idempotent(spark, tmp_root):
    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    land(landing, "r1", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP, dict(EXP, codigo_funcao="12")]}))
    land(landing, "r1", "despesas", "0162", 2024, 2, 200, json.dumps({"data": [dict(EXP, valor_liquidado_no_mes="1,5")]}))
    land(landing, "r1", "despesas", "0163", 2024, 2, 200, json.dumps({"data": [dict(EXP, codigo_orgao={"a": 1}), EXP]}))
    land(landing, "r1", "receitas", "0162", 2024, 1, 200, json.dumps({"data": [{"codigo_receita": "1", "valor_arrecadado_no_mes": 5}]}))
    land(landing, "r1", "receitas", "0163", 2024, 1, 200, json.dumps({"data": []}))
    land(landing, "r1", "receitas", "0164", 2024, 1, 404, "")
    land(landing, "r1", "licitacoes", "0162", 2024, 1, 200, json.dumps([{"numero_licitacao": "A", "valor_licitacao": 1.0}]))
    land(landing, "r1", "licitacoes", "0162", 2024, 2, 200, json.dumps([{"numero_licitacao": "A", "valor_licitacao": 2.0}]))
    c1 = run_load(spark, landing, silver)
    # money that is no number: the row is saved with NULL and recorded beside
    assert c1["despesas"] == {"saved": 4, "quarantined": 2}
    d = spark.read.parquet(silver + "/despesas")
    assert sorted((r.municipio_id, r.mes_referencia, r.valor_liquidado) for r in d.collect()
                  if r.mes_referencia == "202402") == [("0162", "202402", None), ("0163", "202402", 90.0)]
    t = spark.read.parquet(silver + "/licitacoes").collect()
    assert [(r.id, r.valor_estimado) for r in t] == [("0162_A_2024", 2.0)]
    names = ["despesas", "licitacoes", "receitas"]

    def state():
        records = [ledger_current(ledger(spark, silver)), quarantine(spark, silver)]
        return ({n: _rows(spark, f"{silver}/{n}") for n in names},
                [sorted(map(str, r.drop("last_updated", "load_id").collect())) for r in records])

    before = state()
    run_load(spark, landing, silver)  # same load again: nothing but time stamps and load ids changes
    assert state() == before
    compact_records(spark, silver, files=1)
    assert state() == before
    cur = {(r.source, r.municipio_id, r.status, r.record_count) for r in ledger_current(ledger(spark, silver)).collect()}
    assert cur == {("despesas", "0162", "COMPLETED", 3), ("despesas", "0163", "FAILED", 0),
                   ("receitas", "0162", "COMPLETED", 1), ("receitas", "0163", "COMPLETED", 0),
                   ("receitas", "0164", "COMPLETED", 0), ("licitacoes", "0162", "COMPLETED", 2)}
    q = quarantine(spark, silver).filter(F.col("source") == "despesas")
    assert sorted(r.quarantine_reason for r in q.collect()) == ["nested_value", "non_numeric_money"]
    todo = pending_payloads(scan_payloads(spark, landing), silver)
    assert [(r.source, r.municipio_id) for r in todo.collect()] == [("despesas", "0163")]


def test_redelivery_takes_the_latest_run(spark, tmp_root):
    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    land(landing, "r9", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP]}))
    land(landing, "r9", "despesas", "0162", 2024, 2, 200, json.dumps({"data": [EXP, EXP]}))
    land(landing, "r9", "despesas", "0162", 2024, 3, 200, json.dumps({"data": [EXP]}))
    run_load(spark, landing, silver, sources=["despesas"])
    assert spark.read.parquet(silver + "/despesas").count() == 4
    land(landing, "r10", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [dict(EXP, valor_pago_no_mes=90.0)]}))
    land(landing, "r10", "despesas", "0162", 2024, 2, 200, json.dumps({"data": []}))
    land(landing, "r10", "despesas", "0162", 2024, 3, 500, "")
    run_load(spark, landing, silver, sources=["despesas"])
    d = spark.read.parquet(silver + "/despesas").collect()
    assert sorted((r.mes_referencia, r.valor_pago) for r in d) == [("202401", 90.0), ("202403", 80.0)]
    # several files of one month are numbered through
    land(landing, "r11", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP, EXP]}), "a.json")
    land(landing, "r11", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP]}), "b.json")
    run_load(spark, landing, silver, sources=["despesas"])
    d = spark.read.parquet(silver + "/despesas").filter("mes_referencia = '202401'").collect()
    assert sorted(r.id for r in d) == [f"0162_202401_339039_80.0_{i}" for i in range(3)]


def test_year_window(spark, tmp_root):
    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    for y in (2021, 2023, 2024):
        land(landing, "r1", "despesas", "0162", y, 1, 200, json.dumps({"data": [EXP]}))
    run_load(spark, landing, silver, sources=["despesas"], current_year=2024, lookback=2)
    assert sorted(r.exercicio_orcamento for r in spark.read.parquet(silver + "/despesas").collect()) == ["2023", "2024"]


def test_a_table_that_cannot_be_read_is_not_overwritten(spark, tmp_root):
    import os

    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    land(landing, "r1", "licitacoes", "0162", 2024, 1, 200, json.dumps([{"numero_licitacao": "A"}]))
    part = f"{silver}/licitacoes/municipio_id=0162/exercicio_orcamento=2024"
    os.makedirs(part)
    with open(f"{part}/part-0.parquet", "w") as f:
        f.write("broken")
    with pytest.raises(Exception):
        run_load(spark, landing, silver, sources=["licitacoes"])
    assert os.path.exists(f"{part}/part-0.parquet")


def test_upsert_prunes_partitions(spark, tmp_root):
    root = tmp_root + "/t"
    spark.createDataFrame([(i, str(i % 3), str(2020 + i % 4)) for i in range(24)], "id int, municipio_id string, exercicio_orcamento string") \
        .write.partitionBy("municipio_id", "exercicio_orcamento").parquet(root)
    keys = spark.createDataFrame([("1", "2021")], "municipio_id string, exercicio_orcamento string")
    got = touching(spark.read.parquet(root), keys, ["municipio_id", "exercicio_orcamento"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "(municipio_id" in plan.split("PartitionFilters:")[1].split("]")[0] and " = 1)" in plan
    assert sorted(r.id for r in got.collect()) == [1, 13]


def test_loaded_rows_are_visible_to_sql(spark, tmp_root):
    db = "audit_" + uuid.uuid4().hex[:8]
    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    C.create_audit_tables(spark, db, root=silver)
    land(landing, "r1", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP, EXP]}))
    land(landing, "r1", "licitacoes", "0162", 2024, 1, 200, json.dumps([{"numero_licitacao": "A", "valor_licitacao": 1.0}]))
    run_load(spark, landing, silver)
    C.refresh_audit_tables(spark, db)
    one = lambda q: run_readonly_sql(spark, q).first()
    assert one(f"SELECT count(*), sum(valor_pago) FROM {db}.despesas WHERE municipio_id = '0162'")[:] == (2, 160.0)
    assert one(f"SELECT valor_estimado FROM {db}.licitacoes")[0] == 1.0
    assert one(f"SELECT count(DISTINCT source) FROM {db}.etl_metadata WHERE status = 'COMPLETED'")[0] == 2
    for name, _, cols, _ in C.AUDIT_TABLES[:2]:
        assert set(spark.read.parquet(f"{silver}/{name}").columns) == {c for c, _, _ in cols}
    land(landing, "r2", "despesas", "0162", 2024, 1, 200, json.dumps({"data": []}))
    run_load(spark, landing, silver, sources=["despesas"])
    C.refresh_audit_tables(spark, db)
    assert one(f"SELECT count(*) FROM {db}.despesas")[0] == 0
    assert [r.table for r in C.definitions(spark, db, ["receitas", "nope"]).collect()] == ["receitas"]


def test_budget_execution_on_loaded_expenses(spark, tmp_root):  # C20 + B5
    from erario.operators.audit import budget_execution

    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    land(landing, "r1", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [
        EXP, dict(EXP, codigo_elemento_despesa="2", valor_empenhado_no_mes=50.0, valor_liquidado_no_mes=25.0,
                  valor_pago_no_mes=0.0),
        dict(EXP, codigo_funcao="12", valor_empenhado_no_mes=0.0, valor_liquidado_no_mes=0.0, valor_pago_no_mes=0.0)]}))
    run_load(spark, landing, silver, sources=["despesas"])
    d = C.decode_function(spark.read.parquet(silver + "/despesas"))
    got = {r.funcao: r for r in budget_execution(
        d, [("empenhado", "valor_empenhado"), ("liquidado", "valor_liquidado"), ("pago", "valor_pago")],
        keys=["funcao"]).collect()}
    s = got["Saúde"]
    assert (s.empenhado, s.liquidado, s.pago) == (150.0, 115.0, 80.0)
    assert abs(s.liquidado_ratio - 115 / 150) < 1e-12 and abs(s.pago_ratio - 80 / 150) < 1e-12
    assert got["Educação"].pago_ratio is None  # 0 / 0 -> NULL, not an error


def test_upsert_load_reads_back_codes_as_text(spark, tmp_root):
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "true")
    try:
        landing, silver = tmp_root + "/landing", tmp_root + "/silver"
        land(landing, "r1", "licitacoes", "0162", 2024, 1, 200, json.dumps([{"numero_licitacao": "A", "valor_licitacao": 1.0}]))
        run_load(spark, landing, silver, sources=["licitacoes"])
        land(tmp_root + "/landing2", "r2", "licitacoes", "0162", 2024, 2, 200,
             json.dumps([{"numero_licitacao": "A", "valor_licitacao": 2.0}, {"numero_licitacao": "B", "valor_licitacao": 3.0}]))
        run_load(spark, tmp_root + "/landing2", silver, sources=["licitacoes"])
        from erario.operators.load import PARTITIONS  # noqa: F401
        t = spark.read.schema("id string, valor_estimado double, municipio_id string, exercicio_orcamento string") \
            .parquet(silver + "/licitacoes").collect()
        assert sorted((r.id, r.valor_estimado, r.municipio_id) for r in t) == [
            ("0162_A_2024", 2.0, "0162"), ("0162_B_2024", 3.0, "0162")]
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")


def test_empty_answers_are_known_requests(spark, tmp_root):
    """Files of 0 bytes: a refused month completes its task, a 200 without a body
    is quarantined; names are unescaped; a landed file next to an empty one counts."""
    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    land(landing, "r1", "receitas", "0164", 2024, 1, 404, "")
    land(landing, "r1", "receitas", "0165", 2024, 1, 200, "")
    land(landing, "r1", "receitas", "0166", 2024, 1, 200, json.dumps({"data": [{"codigo_receita": "1"}]}), "a.json")
    land(landing, "r1", "receitas", "0166", 2024, 1, 200, "", "b.json")
    land(landing, "r 1+%25", "receitas", "0167", 2024, 1, 404, "")
    got = {(r.municipio_id, r.run_id, r.month, r.http_status, r.body) for r in scan_payloads(spark, landing).collect()}
    assert {g[:4] for g in got} == {("0164", "r1", 1, 404), ("0165", "r1", 1, 200), ("0166", "r1", 1, 200), ("0167", "r 1+%", 1, 404)}
    assert len(got) == 4 and sum(g[4] == "" for g in got) == 3
    assert spark.catalog.listTables() == []
    run_load(spark, landing, silver, sources=["receitas"], municipios=["0164", "0999"], current_year=2024, lookback=1)
    state = {(r.municipio_id, r.status, r.record_count) for r in ledger_current(ledger(spark, silver)).collect()}
    assert state == {("0164", "COMPLETED", 0), ("0165", "FAILED", 0), ("0166", "COMPLETED", 1), ("0167", "COMPLETED", 0),
                     ("0999", "STARTED", 0)}
    assert [(r.municipio_id, r.quarantine_reason) for r in quarantine(spark, silver).collect()] == [("0165", "invalid_json")]
    todo = pending_tasks(task_grid(spark, ["0164", "0999"], ["receitas"], 2024, 1), ledger_current(ledger(spark, silver)))
    assert [r.municipio_id for r in todo.collect()] == ["0999"]


def test_a_load_that_breaks_off_loses_nothing(spark, tmp_root, monkeypatch):
    from erario.operators import eventlog, load as job

    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    land(landing, "r1", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [dict(EXP, codigo_orgao={"a": 1})]}))
    land(landing, "r1", "despesas", "0163", 2024, 1, 200, json.dumps({"data": [EXP]}))
    run_load(spark, landing, silver, sources=["despesas"])

    def records():
        return [sorted(map(str, r.collect())) for r in (ledger(spark, silver), quarantine(spark, silver))]

    before = records()
    land(landing, "r2", "despesas", "0162", 2024, 1, 200, json.dumps({"data": [EXP]}))
    real = job.append

    def broken(df, table):  # the quarantine is written, the ledger is not
        if table.endswith("etl_metadata"):
            raise RuntimeError("lost")
        real(df, table)

    monkeypatch.setattr(job, "append", broken)
    with pytest.raises(RuntimeError):
        run_load(spark, landing, silver, sources=["despesas"])
    assert records() == before
    monkeypatch.setattr(job, "append", real)
    # a compaction that stops before its pointer is written
    with monkeypatch.context() as m:
        m.setattr(eventlog, "_fs", lambda s, p, f=eventlog._fs: f(s, p) if "_versions/" not in p else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            job.compact_records(spark, silver, files=0)
    assert records() == before
    job.compact_records(spark, silver, files=0)
    job.compact_records(spark, silver, files=0)
    assert records() == before and eventlog.version(spark, f"{silver}/etl_metadata") == 2
    run_load(spark, landing, silver, sources=["despesas"])
    state = {(r.municipio_id, r.status, r.record_count) for r in ledger_current(ledger(spark, silver)).collect()}
    assert state == {("0162", "COMPLETED", 1), ("0163", "COMPLETED", 1)} and quarantine(spark, silver).collect() == []


def test_a_load_appends_its_own_rows_and_writes_few_files(spark, tmp_root):
    import glob

    landing, silver = tmp_root + "/landing", tmp_root + "/silver"
    for m in range(1, 13):
        land(landing, "r1", "despesas", "0162", 2024, m, 200, json.dumps({"data": [EXP] * 30}))
    run_load(spark, landing, silver, sources=["despesas"])
    months = glob.glob(f"{silver}/despesas/*/*/*")
    assert len(months) == 12 and all(1 <= len(glob.glob(f"{m}/*.parquet")) <= 2 for m in months)
    files = set(glob.glob(f"{silver}/etl_metadata/*/*.parquet"))
    land(landing, "r1", "despesas", "0163", 2024, 1, 200, json.dumps({"data": [EXP]}))
    run_load(spark, landing, silver, sources=["despesas"], only_pending=True)
    added = set(glob.glob(f"{silver}/etl_metadata/*/*.parquet")) - files
    assert files <= set(glob.glob(f"{silver}/etl_metadata/*/*.parquet"))
    assert {r.municipio_id for r in spark.read.parquet(*added).collect()} == {"0163"}


def test_a_query_lands_its_own_source(spark):
    """A load of tenders does not wait for the files of expenses and revenue; a
    source that is there is not written again."""
    from conftest import SF_SMALL
    from erario.plans import load_plans

    key = (spark.sparkContext.applicationId, SF_SMALL)
    before = load_plans._LANDED.pop(key, None)
    try:
        root, _ = load_plans.landed(spark, SF_SMALL, ["licitacoes"])
        tenders = {r.path for r in scan_payloads(spark, root).collect()}
        assert {r.source for r in scan_payloads(spark, root).collect()} == {"licitacoes"}
        assert load_plans.landed(spark, SF_SMALL, ["licitacoes", "receitas"])[0] == root
        rows = scan_payloads(spark, root).collect()
        assert {r.path for r in rows if r.source == "licitacoes"} == tenders
        assert {r.source for r in rows} == {"licitacoes", "receitas"}
        # one file a request, and the empty bodies
        assert len({(r.run_id, r.source, r.municipio_id, r.year, r.month, r.http_status) for r in rows}) == len(rows)
        assert {r.municipio_id for r in rows} >= {"900000", "900001", "900002", "900003"}
    finally:
        if before:
            load_plans._LANDED[key] = before


def test_bundles_load_as_single_files_do(spark, tmp_root):
    """Responses in bundles and in files of their own make the same tables, and
    a load reads the landing once."""
    from erario.sources import payloads as P

    item = {"codigo_elemento_despesa": "1", "valor_pago_no_mes": 1.5}
    responses = [("r9", "despesas", "0162", 2024, m, 200, json.dumps({"data": [item] * m})) for m in (1, 2, 3)]
    responses += [("r10", "despesas", "0162", 2024, 2, 200, '{"data":[]}'), ("r10", "despesas", "0162", 2024, 3, 404, "no"),
                  ("r9", "licitacoes", "7", 2024, 1, 200, "")]
    got = []
    for name in ("files", "bundles"):
        landing, silver = f"{tmp_root}/{name}", f"{tmp_root}/silver-{name}"
        if name == "files":
            for r in responses:
                land(landing, *r)
        else:
            rows = spark.createDataFrame(responses, "run_id string, source string, municipio_id string, year int, month int, "
                                                    "http_status int, body string")
            os.makedirs(landing)
            P.write_bundles(rows, landing)
            assert len({r.path for r in scan_payloads(spark, landing).collect()}) == len(responses)
        run_load(spark, landing, silver, sources=["despesas", "licitacoes"])
        assert run_load(spark, landing, silver, sources=["despesas"], only_pending=True)["despesas"] == {"saved": 0, "quarantined": 0}
        saved = spark.read.parquet(f"{silver}/despesas").select("id", "municipio_id", "mes_referencia", "valor_pago")
        state = ledger_current(ledger(spark, silver)).select("municipio_id", "source", "status", "record_count")
        got.append((sorted(map(tuple, saved.collect())), sorted(map(tuple, state.collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 4
    assert ("7", "licitacoes", "FAILED", 0) in got[0][1]
