"""Exact value rules."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.plans.query import compile_sql
from emberlog.sql.errors import UnknownColumn, UnsupportedFunction


@pytest.fixture(scope="module")
def logs(spark):
    meta = F.struct(F.lit("syslog").alias("source_id"))
    return spark.createDataFrame([("hello", 4)], "message string, syslog_severity long").withColumn("_meta", meta)


def rows(sql, df):
    return [tuple(r) for r in compile_sql(sql).apply(df).collect()]


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        ("SELECT syslog_severity, message FROM logs WHERE syslog_severity <= 4", [(4, "hello")]),
        ("SELECT message FROM logs WHERE syslog_severity <= 2", []),
        ("SELECT missing FROM logs", [(None,)]),
        ("SELECT * FROM logs", [("hello", 4)]),
        ("SELECT * AS x FROM logs", [("hello", 4)]),
        ("SELECT logs.message FROM logs", [("hello",)]),
        ("SELECT l.message, logs.SYSLOG_SEVERITY FROM logs l", [("hello", 4)]),
        ("SELECT *, syslog_severity + 1 AS more FROM logs", [("hello", 4, 5)]),
        ("SELECT source_id FROM logs", [("syslog",)]),
        ('SELECT "source_id", "Message" FROM logs', [(None, None)]),
        ("SELECT 1", [(1,)]),
        # null and families
        ("SELECT 1 FROM logs WHERE missing = NULL", [(1,)]),
        ("SELECT 1 FROM logs WHERE message = NULL", []),
        ("SELECT 1 FROM logs WHERE message != NULL", [(1,)]),
        ("SELECT 1 FROM logs WHERE message = 4", []),
        ("SELECT 1 FROM logs WHERE message <> 4", [(1,)]),
        ("SELECT 1 FROM logs WHERE TRUE = 1", []),
        ("SELECT 1 FROM logs WHERE syslog_severity = 4.0", [(1,)]),
        # errors drop the event
        ("SELECT 1 FROM logs WHERE message = 'hello' OR missing < 5", []),
        ("SELECT 1 FROM logs WHERE NOT syslog_severity = 4", []),
        ("SELECT 1 FROM logs WHERE syslog_severity", []),
        ("SELECT 1 FROM logs WHERE message AND TRUE", []),
        ("SELECT 1 FROM logs WHERE message < 4", []),
        ("SELECT 1 FROM logs WHERE TRUE < FALSE", []),
        ("SELECT syslog_severity / 0 FROM logs", []),
        ("SELECT -message FROM logs", []),
        ("SELECT missing + 1 FROM logs", []),
        ("SELECT 9223372036854775807 + syslog_severity FROM logs", []),
        ("SELECT (-9223372036854775807 - syslog_severity) AS x FROM logs", []),
        ("SELECT 9223372036854775807 * syslog_severity FROM logs", []),
        # arithmetic
        ("SELECT syslog_severity / 8, 7 - 2 * 3, +message, -syslog_severity, 1 + .5 FROM logs", [(0.5, 1, "hello", -4, 1.5)]),
        ("SELECT 1 FROM logs WHERE 9007199254740993 > 9007199254740992", []),
        ("SELECT 1 FROM logs WHERE message >= 'hello' AND message < 'i'", [(1,)]),
        ("SELECT ABS(0 - syslog_severity) AS x FROM logs", [(4,)]),
    ],
)
def test_rules(logs, sql, expected):
    assert rows(sql, logs) == expected


def test_qualifiers_must_match(logs):
    for sql in ("SELECT foo.message FROM logs", "SELECT foo.* FROM logs", 'SELECT "logs".message FROM logs'):
        with pytest.raises(UnknownColumn):
            compile_sql(sql).apply(logs)
    with pytest.raises(UnsupportedFunction):
        compile_sql("SELECT NO_SUCH_FUNCTION(message) FROM logs").apply(logs)


def test_labels(logs):
    out = compile_sql("SELECT Message, syslog_severity + 1, missing AS gone FROM logs").apply(logs)
    assert out.columns == ["Message", "<expr>", "gone"]


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as double) v", "cast(id as string) s").write.parquet(str(tmp_path / "t"))
    df = compile_sql("SELECT id FROM t WHERE v >= 5.0 AND s = '7'").apply(spark.read.parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,5.0)" in plan and "EqualNullSafe(s,7)" in plan and "IsNotNull(v)" in plan
    assert [r.id for r in df.collect()] == [7]


def test_long_or_chains(spark):
    df = spark.range(3).withColumnRenamed("id", "a")
    sql = "SELECT a FROM t WHERE " + " OR ".join(f"a = {i + 2}" for i in range(1000))
    assert [r.a for r in compile_sql(sql).apply(df).collect()] == [2]


def test_errors_are_counted(spark):
    from pyspark.sql import Observation

    df = spark.createDataFrame([(1,), (None,), (3,)], "a long")
    seen = Observation("q")
    from emberlog.functions.values import Compiler, failed
    from emberlog.operators.events import Events, _resolver

    q = compile_sql("SELECT a FROM t WHERE a > 1").statement
    where = Compiler(df, _resolver(Events(df), q.sources[0].relation)[0]).value(q.where)
    df.observe(seen, F.count_if(failed(where, [])).alias("errors")).collect()
    assert seen.get["errors"] == 1


def test_sums_in_any_grouping_agree(spark):
    rng = random.Random(0xBEEF)
    df = spark.createDataFrame([tuple(rng.randint(-1000, 1000) for _ in range(3)) for _ in range(200)], "a long, b long, c long")
    out = compile_sql("SELECT (a + (b + c)) AS x, ((a + b) + c) AS y FROM t").apply(df).collect()
    assert len(out) == 200 and all(r.x == r.y for r in out)


def test_statements_can_follow_each_other(spark):
    df = spark.createDataFrame([("hello", 4), ("low", 7)], "message string, syslog_severity long").withColumn("_meta", F.struct(F.lit("test_source").alias("source_id")))
    first = compile_sql("SELECT syslog_severity AS severity FROM logs WHERE syslog_severity <= 4").apply(df, carry=True)
    second = compile_sql("SELECT severity, message FROM logs WHERE severity = 4 AND source_id = 'test_source'").apply(first)
    assert [tuple(r) for r in second.collect()] == [(4, "hello")]
