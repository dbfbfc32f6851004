"""Catalog of the audit tables: definitions, listing, description, search and
the budget-function dimension.

The reference documented its tables with SQL comments inside the DDL text
(including the code -> name mapping of budget functions) and searched that
text accent- and case-insensitively. Here the documentation lives in table
and column COMMENTs of catalog tables, ``SHOW CREATE TABLE`` renders it, and
the search is a DataFrame filter with the accent-fold operator. Catalog
metadata is small and lives on the driver by nature; table data never does.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erario.functions.text import contains_folded
from erario.operators.eventlog import folder

# Budget function codes and names (the 12 codes documented for
# codigo_funcao).
FUNCOES = [
    ("01", "Legislativa"), ("04", "Administração"), ("06", "Segurança Pública"),
    ("08", "Assistência Social"), ("10", "Saúde"), ("12", "Educação"), ("13", "Cultura"),
    ("15", "Urbanismo"), ("18", "Gestão Ambiental"), ("26", "Transporte"),
    ("27", "Desporto e Lazer"), ("28", "Encargos Especiais"),
]

_FUNCAO_DOC = "Budget function code. " + "; ".join(f"{c}: {n}" for c, n in FUNCOES)

# Table definitions: (name, table comment, [(column, type, comment)], partition columns)
AUDIT_TABLES = [
    ("licitacoes", "Tenders and contracts (licitacao): purchases, works and services.", [
        ("id", "STRING", "municipio_numero_ano; one row per tender number and fiscal year"),
        ("municipio_id", "STRING", "municipality code"),
        ("numero_licitacao", "STRING", "tender number"),
        ("numero_processo", "STRING", "procurement process number"),
        ("objeto_licitacao", "STRING", "object of the tender (e.g. merenda escolar, reforma)"),
        ("modalidade_licitacao", "STRING", "procurement type (e.g. Pregão, Concorrência)"),
        ("data_realizacao_licitacao", "STRING", "date of the tender, ISO YYYY-MM-DD text"),
        ("valor_estimado", "DOUBLE", "estimated value: the most the government expects to pay"),
        ("situacao_licitacao", "STRING", "status (e.g. Concluída, Deserta, Fracassada)"),
        ("exercicio_orcamento", "STRING", "fiscal year YYYY"),
        ("raw_data", "STRING", "the source item as JSON text"),
        ("updated_at", "TIMESTAMP", "time the row was last written"),
    ], ["municipio_id", "exercicio_orcamento"]),
    ("despesas", "Public expenses and spending: education (educacao), health (saude), "
                 "infrastructure and other budget functions.", [
        ("id", "STRING", "municipio_YYYYMM_elemento_valor_posicao"),
        ("municipio_id", "STRING", "municipality code"),
        ("exercicio_orcamento", "STRING", "fiscal year YYYY"),
        ("mes_referencia", "STRING", "reference month YYYYMM"),
        ("codigo_orgao", "STRING", "organ code"),
        ("codigo_unidade_orcamentaria", "STRING", "budget unit code"),
        ("codigo_funcao", "STRING", _FUNCAO_DOC),
        ("codigo_subfuncao", "STRING", "sub-function code (more specific area)"),
        ("codigo_programa", "STRING", "program code"),
        ("codigo_elemento_despesa", "STRING", "expense element code (nature of the expense)"),
        ("valor_empenhado", "DOUBLE", "committed value: funds reserved"),
        ("valor_liquidado", "DOUBLE", "verified value: service or product delivered and checked"),
        ("valor_pago", "DOUBLE", "paid value: money actually transferred"),
        ("raw_data", "STRING", "the source item as JSON text"),
        ("updated_at", "TIMESTAMP", "time the row was last written"),
    ], ["municipio_id", "exercicio_orcamento", "mes_referencia"]),
    ("receitas", "Revenue and collection (receita).", [
        ("id", "STRING", "municipio_YYYYMM_codigo_valor_posicao"),
        ("municipio_id", "STRING", "municipality code"),
        ("exercicio_orcamento", "STRING", "fiscal year YYYY"),
        ("mes_referencia", "STRING", "reference month YYYYMM"),
        ("codigo_orgao", "STRING", "organ code"),
        ("codigo_unidade_orcamentaria", "STRING", "budget unit code"),
        ("codigo_receita", "STRING", "revenue code"),
        ("descricao_receita", "STRING", "revenue source (e.g. IPTU taxes, FPM, royalties)"),
        ("valor_orcado", "DOUBLE", "budgeted value: expected revenue"),
        ("valor_arrecadado", "DOUBLE", "collected value: revenue actually received"),
        ("raw_data", "STRING", "the source item as JSON text"),
        ("updated_at", "TIMESTAMP", "time the row was last written"),
    ], ["municipio_id", "exercicio_orcamento", "mes_referencia"]),
    ("etl_metadata", "Load ledger: one state per municipality, year and source.", [
        ("municipio_id", "STRING", "municipality code"),
        ("year", "INT", "fiscal year"),
        ("status", "STRING", "STARTED, COMPLETED or FAILED"),
        ("record_count", "BIGINT", "rows saved by the load"),
        ("run_id", "STRING", "latest run among the task's payloads"),
        ("last_updated", "TIMESTAMP", "time of the status change"),
        ("source", "STRING", "licitacoes, despesas or receitas"),
    ], []),
]


def _q(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def create_audit_tables(spark: SparkSession, database: str = "audit", root: str | None = None) -> None:
    """Create the database and the documented tables (Parquet, partitioned by
    municipality / year / month so that audit filters prune partitions)."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, comment, cols, parts in AUDIT_TABLES:
        body = ",\n  ".join(f"`{c}` {t} COMMENT '{_q(doc)}'" for c, t, doc in cols)
        part = f"\nPARTITIONED BY ({', '.join(parts)})" if parts else ""
        loc = f"\nLOCATION '{root.rstrip('/')}/{name}'" if root else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` (\n  {body}\n) USING parquet"
                  f"{part}\nCOMMENT '{_q(comment)}'{loc}")


def refresh_audit_tables(spark: SparkSession, database: str = "audit") -> None:
    """Make what the load has written visible to SQL: register the partitions
    found under each table's folder and drop those that are gone; the ledger's
    table is set to the version in force."""
    for name, _, _, parts in AUDIT_TABLES:
        if parts:
            spark.sql(f"MSCK REPAIR TABLE `{database}`.`{name}` SYNC PARTITIONS")
        else:
            told = spark.sql(f"DESCRIBE TABLE EXTENDED `{database}`.`{name}`").where("col_name = 'Location'").first()
            base = re.sub(r"/v\d{6}$", "", told.data_type)
            spark.sql(f"ALTER TABLE `{database}`.`{name}` SET LOCATION '{_q(folder(spark, base))}'")
        spark.catalog.refreshTable(f"`{database}`.`{name}`")


def list_tables(spark: SparkSession, database: str = "audit") -> DataFrame:
    """B1: table names (the ledger included)."""
    return spark.sql(f"SHOW TABLES IN `{database}`").select(F.col("tableName").alias("table"))


def table_definition(spark: SparkSession, name: str, database: str = "audit") -> str | None:
    """B2: the table's DDL with its comments, or None when absent."""
    if not spark.catalog.tableExists(f"{database}.{name}"):
        return None
    return spark.sql(f"SHOW CREATE TABLE `{database}`.`{name}`").first()[0]


def describe_table(spark: SparkSession, name: str, database: str = "audit") -> str:
    """B2: DDL text, or the reference's "not found" text."""
    ddl = table_definition(spark, name, database)
    return ddl if ddl is not None else f"Table '{name}' not found."


def definitions(spark: SparkSession, database: str = "audit", tables: Sequence[str] | None = None) -> DataFrame:
    """(table, definition) for every table of the database, or for those of
    ``tables`` that it holds."""
    names = [r.table for r in list_tables(spark, database).collect() if tables is None or r.table in tables]
    rows = [(n, table_definition(spark, n, database)) for n in names]
    return spark.createDataFrame(rows, "table string, definition string")


def search_definitions(spark: SparkSession, keyword: str, database: str = "audit") -> DataFrame:
    """Tables whose name or definition contains ``keyword`` regardless of
    accents and case ('saude' finds the 10: Saúde code of despesas)."""
    d = definitions(spark, database)
    return d.filter(contains_folded("table", keyword) | contains_folded("definition", keyword))


def dim_funcao(spark: SparkSession) -> DataFrame:
    """The budget-function dimension (12 rows)."""
    return spark.createDataFrame(FUNCOES, "codigo string, nome string")


def decode(df: DataFrame, dimension: DataFrame, code: str, key: str) -> DataFrame:
    """Attach the columns of a dimension with a fixed, small number of codes
    (it is broadcast) to the rows with its codes; unknown codes give NULL."""
    return df.join(F.broadcast(dimension), df[code] == dimension[key], "left").drop(dimension[key])


def decode_function(df: DataFrame, code_col: str = "codigo_funcao", name_col: str = "funcao") -> DataFrame:
    """Attach the function name; unknown codes give NULL."""
    return decode(df, dim_funcao(df.sparkSession).withColumnRenamed("nome", name_col), code_col, "codigo")
