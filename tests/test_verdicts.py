"""The validation report: odd tables against DuckDB, and what its plan shuffles and compiles."""

import re

import duckdb
import pytest

from framekit.operators import report, rules
from framekit.plans import q_rules
from framekit.plans.fixtures import TABLES
from framekit.plans.registry import ORACLES
from tests.oracle_check import difference, duck

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """sf0.001 with orders that are given again (alike, and with another state), a null order, lines given again, lines of one section
    in one place, a project with a fifth of all lines, orders without lines and lines without orders."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    con.execute("INSERT INTO orders SELECT * FROM orders WHERE o_orderkey % 5 = 0")
    con.execute("INSERT INTO orders SELECT * REPLACE (CASE o_orderstatus WHEN 'F' THEN 'O' ELSE 'F' END AS o_orderstatus, '1-URGENT' AS o_orderpriority) FROM orders WHERE o_orderkey % 7 = 0")
    con.execute("INSERT INTO orders SELECT * REPLACE (NULL AS o_orderkey) FROM orders LIMIT 3")
    con.execute("DELETE FROM orders WHERE o_orderkey % 11 = 3")
    con.execute("DELETE FROM lineitem WHERE l_orderkey % 13 = 5")
    con.execute("UPDATE lineitem SET l_orderkey = 21 WHERE l_partkey % 5 = 0")
    con.execute("INSERT INTO lineitem SELECT * FROM lineitem WHERE l_orderkey % 3 = 0")
    con.execute("UPDATE lineitem SET l_linenumber = 0 WHERE l_orderkey % 17 = 0")
    for name in TABLES:
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_odd_tables(spark, odd):
    assert difference(spark, duck(odd), q_rules.validation_report, ORACLES["validation_report"], odd) is None


def test_lines_are_shuffled_once_in_short_methods(spark):
    """Also where Spark's limit of method lengths is not set, the JVM compiles all of it."""
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    settings = {"spark.sql.codegen.hugeMethodLimit": "65535", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        query = q_rules.validation_report(spark, SMALL)._jdf.queryExecution()
        plan = query.executedPlan().toString()
        text = query.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", limit)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", plan)) == 1
    assert plan.count("Exchange hashpartitioning(l_") == 1 and plan.count("Exchange hashpartitioning(project_id") == 1  # other findings
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)) <= 8000


def test_tasks_hold_few_lines(spark, monkeypatch):
    """Large tables are dealt to more tasks than the session's shuffles have, small ones are not."""
    monkeypatch.setattr(q_rules, "LINES_OF_TASK", 100)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    plan = q_rules.validation_report(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert lines > 500 and set(re.findall(r"RepartitionByExpression \[[lo]_orderkey#\d+L?\], (\d+)", plan)) == {str(lines // 100)}


def test_sheets_name_failed_rules(spark):
    from pyspark.sql import functions as F

    sheets = {"a": report.Sheet(), "b": report.Sheet()}
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 0)], "project_id bigint, n int")
    yes = F.lit(None)
    a = sheets["a"].marks([("x.high", rules.ERROR, F.col("n") > 3, yes), ("x.low", rules.WARNING, F.col("n") < 9, yes)])
    b = sheets["b"].marks([("a.first", rules.ERROR, F.col("n") >= 0, yes), ("x.high", rules.ERROR, F.col("n").isNull(), yes)])
    marked = rows.select("project_id", a.alias("a"), b.alias("b"))
    got = marked.select("project_id", report.failed_rules(sheets), sheets["a"].count(F.col("a"), rules.WARNING)).collect()
    assert sorted(map(tuple, got)) == [(1, "a.first,x.high", 1), (2, "x.high", 0), (3, "a.first", 1)]


def test_summary_is_that_of_the_findings(spark):
    found = spark.createDataFrame([
        (1, None, "r", "error"), (1, 2, "q", "error"), (1, 2, "q", "error"), (1, 3, "r", "error"), (1, 1, "q", "warning"),
        (2, 0, "q", "error"), (2, 4, "r", "error"), (3, None, "q", "warning"), (None, 1, "q", "error"),
    ], "project_id bigint, section_no int, rule string, severity string")
    sheet = report.Sheet()
    sheet.rules += [("q", rules.ERROR), ("r", rules.ERROR)]
    got = sorted(map(tuple, report.summary(found, sheet).collect()))
    assert got == [(1, 4, 1, 1, 2, 2, 3), (2, 2, 0, 0, 0, 1, 3), (3, 0, 1, 0, None, None, 0)]
