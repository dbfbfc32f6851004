"""Read-only SQL entry (Q1).

The reference accepted any text that starts with SELECT. In Spark such a text
can start a process (``TRANSFORM ... USING``), call JVM methods (``reflect``) or
read any file (``parquet.`/path` ``). ``check_readonly`` has Spark's own parser
read the statement and looks at the unresolved plan, whatever the text looks
like: one query, no command, no script, no reflection, and only relations of
the catalog. ``run_readonly_sql`` then plans it; the result is a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class ReadOnlyViolation(ValueError):
    pass


# Functions that call JVM methods; plan nodes that run a script.
_REFLECTION = {"reflect", "java_method", "try_reflect"}
_SCRIPT = "ScriptTransformation"
_CATALYST = "org.apache.spark.sql.catalyst"


def _each(seq) -> Iterator:
    for i in range(seq.size()):
        yield seq.apply(i)


def check_readonly(sql: str, spark: SparkSession | None = None) -> str:
    """Return the statement if it is one read-only query over catalog tables and
    views, else raise ``ReadOnlyViolation``."""
    spark = spark or SparkSession.active()
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kind = lambda name: loader.loadClass(f"{_CATALYST}.{name}")
    command, relation, function = (kind(x) for x in ("plans.logical.Command", "analysis.UnresolvedRelation",
                                                     "analysis.UnresolvedFunction"))
    plan_type, holder = kind("plans.logical.LogicalPlan"), kind("expressions.PlanExpression")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ReadOnlyViolation("not one SQL query") from e
    todo = [plan]
    while todo:
        node = todo.pop()
        if plan_type.isInstance(node):
            name = node.nodeName()
            if command.isInstance(node) or "Insert" in name or "Statement" in name or "Explain" in name:
                raise ReadOnlyViolation("only queries are allowed")
            if _SCRIPT in name:
                raise ReadOnlyViolation("scripts are not allowed")
            if relation.isInstance(node):
                _check_relation(spark, list(_each(node.multipartIdentifier())))
            todo += _each(node.expressions())
        elif function.isInstance(node) and list(_each(node.nameParts()))[-1].lower() in _REFLECTION:
            raise ReadOnlyViolation("JVM reflection is not allowed")
        if holder.isInstance(node):
            todo.append(node.plan())
        todo += _each(node.children())
        todo += _each(node.innerChildren())
    return sql.strip().rstrip(";")


def _check_relation(spark: SparkSession, parts: list[str]) -> None:
    """A view, a table of the current database, or a table of a database that exists."""
    if len(parts) > 1 and not (parts[-2] == "global_temp" or spark.catalog.databaseExists(".".join(f"`{p}`" for p in parts[:-1]))):
        raise ReadOnlyViolation(f"relation {'.'.join(parts)} is not in the catalog")


def run_readonly_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Run one read-only query over the registered tables/views."""
    return spark.sql(check_readonly(sql, spark))
