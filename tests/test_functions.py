import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricspark.functions import calendar, logic, paths
from metricspark.functions.formatting import format_value, render
from metricspark.lang import nodes as N
from metricspark.operators import facts as ops


def one(spark, schema, row, col):
    return spark.createDataFrame([row], schema).select(col.alias("x")).first()["x"]


def test_keys_and_numbers(spark):
    df = spark.createDataFrame([(3.0, 2.5, float("nan"), True, "", ["a", "", None, "a", "b"], [(1.0,), (None,)], [(1.0,), (2.0,)])], "a double, b double, c double, d boolean, e string, f array<string>, g array<struct<n:double>>, h array<struct<n:double>>")
    s = df.schema
    got = df.select(*[paths.keys(s, c).alias(c) for c in "abcdef"], paths.number(s, "g.n").alias("g"), paths.number(s, "h.n").alias("h"), paths.keys(s, "no.such").alias("z")).first().asDict()
    assert got == {"a": ["3"], "b": ["2.5"], "c": [], "d": ["true"], "e": [], "f": ["a", "b"], "g": 1.0, "h": None, "z": []}


@pytest.mark.parametrize("text,ok", [("2026", False), ("2026-06", False), ("2026-06-30", True), ("2026-06-30T10:00:00Z", True), ("2026-06-30 10:00", True), ("2026-06-30T10:00:00+09:00", True), ("2026-13-01", False), ("soon", False)])
def test_instants(spark, text, ok):
    assert (one(spark, "t string", (text,), paths.instant(spark.createDataFrame([], "t string").schema, "t")) is not None) == ok


@pytest.mark.parametrize("value,schema,is_set", [("", "string", False), ("a", "string", True), (0.0, "double", False), (2.0, "double", True), (False, "boolean", True), (None, "string", False)])
def test_presence(spark, value, schema, is_set):
    df = spark.createDataFrame([(value,)], f"x {schema}")
    assert df.select(paths.is_set(df.schema, "x")).first()[0] == is_set


def test_labels_across_zones_and_years(spark):
    ts = dt.datetime(2026, 10, 25, 0, 30), dt.datetime(2027, 1, 1, 3, 0), dt.datetime(2026, 3, 29, 1, 30), dt.datetime(2024, 12, 30, 23, 0)
    for zone in ("UTC", "Europe/London", "Asia/Tokyo", "America/New_York"):
        for t in ts:
            for grain in N.GRAINS:
                got = one(spark, "t string", (t.isoformat(sep=" "),), calendar.label(calendar.local(F.col("t").cast("timestamp"), zone), grain))
                assert got == calendar.name_of(calendar.wall(t, zone), grain), (zone, t, grain)


def test_ordinal_weekdays(spark):
    for d in range(1, 29):
        day = dt.datetime(2026, 6, d, 12)
        got = one(spark, "t string", (day.isoformat(sep=" "),), calendar.ordinal_label(F.col("t").cast("timestamp"), 2, 0))
        assert got == ("2026-06-08" if d == 8 else None)
    assert calendar.window_labels(dt.datetime(2026, 8, 24), None, "3", None, (1, 0)) == ["2026-06-01", "2026-07-06", "2026-08-03"]
    assert calendar.window_labels(dt.datetime(2026, 8, 24), None, "2", None, (5, 0)) == ["2026-03-30", "2026-06-29"]


def test_spans(spark):
    def labels(a, b, grain="week"):
        return one(spark, "a string, b string", (a, b), calendar.span_labels(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"), grain))

    assert labels("2026-08-03", "2026-09-06") == [f"2026-W{w}" for w in range(32, 37)]
    assert labels("2026-12-28", "2027-01-05") == ["2026-W53", "2027-W01"]
    assert labels("2026-09-06", "2026-08-03") == [] and labels("2026-09-06", None) == [] and labels(None, "2026-09-06") == []
    assert labels("2026-01-31", "2026-03-01", "month") == ["2026-01", "2026-02", "2026-03"]
    assert labels("2025-11-30", "2026-05-01", "quarter") == ["2025-Q4", "2026-Q1", "2026-Q2"]


def test_windows():
    at = dt.datetime(2026, 8, 24, 12)
    assert calendar.window_labels(at, "UTC", "2", "quarter") == ["2026-Q2", "2026-Q3"]
    assert calendar.window_labels(at, "UTC", "2-3", "week") == ["2026-W33", "2026-W34"]
    assert calendar.window_labels(at, "UTC", "2", "15 minutes") == ["2026-08-24T11:45", "2026-08-24T12:00"]
    assert calendar.window_labels(dt.datetime(1, 2, 1), "UTC", "5", "month") == ["0001-01", "0001-02"]
    assert calendar.expand(["each:2-4", "7"], "day") == ["2-2", "3-3", "4-4", "7"]
    for bad in (["0"], ["4-2"], ["x"], ["1-2-3"], ["٣"], ["3661"], ["each:1-367"], ["7", "1-7"], ["3", "each:1-3", "2-2"], ["1234567890"]):
        with pytest.raises(calendar.WindowError):
            calendar.expand(bad, "day")
    assert calendar.end_of_day(dt.date(2026, 6, 25), "Asia/Tokyo") == dt.datetime(2026, 6, 25, 14, 59, 59, 999999)


def test_ladders_stop_at_the_unknown(spark):
    low = logic.Lowering(lambda e: F.col(e.name), lambda n: n == "w")
    rung = lambda op, a, b, v: (N.Cond(op, a, b), N.Text(v))
    ladder = N.Ladder((rung(">", N.Ref("a"), N.Num(5), "big"), rung(">", N.Ref("b"), N.Num(0), "some")), N.Text("none"))
    run = lambda row, e=ladder: one(spark, "a double, b double, w string", row, low.value(e))
    assert run((6.0, None, "x")) == "big"  # decided before the unknown
    assert run((1.0, None, "x")) is None and run((None, 1.0, "x")) is None
    assert run((1.0, 0.0, "x")) == "none"
    known = N.Ladder(((N.Known(N.Ref("a"), False), N.Text("nothing")), (N.Known(N.Ref("w"), True), N.Text("word"))), N.Text("no word"))
    assert run((None, 1.0, "x"), known) == "nothing" and run((1.0, 1.0, ""), known) == "no word"
    mixed = N.Ladder((rung("!=", N.Ref("w"), N.Num(3), "differs"),), N.Text("same"))
    assert run((1.0, 1.0, "3"), mixed) == "differs"


def test_arithmetic_keeps_the_unknown(spark):
    low = logic.Lowering(lambda e: F.col(e.name))
    run = lambda e, a=None, b=5.0: one(spark, "a double, b double", (a, b), low.value(e))
    assert run(N.Pick("max", N.Ref("a"), N.Ref("b"))) is None and run(N.Pick("min", N.Ref("a"), N.Ref("b")), 3.0) == 3.0
    assert run(N.Arith("/", N.Ref("b"), N.Num(0))) is None and run(N.Arith("+", N.Ref("a"), N.Num(1))) is None
    assert run(N.Num(2, "weeks")) == 1209600.0


def test_statistics_of_arrays(spark):
    values = [float(x) for x in range(1, 101)]
    for rank, want in ((1, 1.0), (7, 7.0), (50, 50.0), (90, 90.0), (99, 99.0)):
        assert one(spark, "v array<double>", (values,), logic.percentile(F.col("v"), rank)) == want
    assert one(spark, "v array<double>", ([600.0, 3000.0, 1800.0],), logic.median(F.col("v"))) == 1800.0
    assert one(spark, "v array<double>", ([1.0, 2.0, 4.0, 9.0],), logic.median(F.col("v"))) == 3.0
    assert one(spark, "v array<double>", ([],), logic.median(F.col("v"))) is None and one(spark, "v array<double>", ([],), logic.percentile(F.col("v"), 5)) is None


def test_formats():
    said = [(None, None, "—"), (0.1234, "share", "12.3%"), (14.4, "days", "14d"), (59.0, "duration", "59s"), (90.0, "duration", "2m"), (7200.0, "duration", "2.0h"), (172800.0, "duration", "2.0d"), (5400.0, "effort", "1.5h"), (999_999.0, "amount", "1M"), (1234.0, "amount", "1.2k"), (12.5, "amount", "12.5"), (0.0, "moment", "1970-01-01"), (1234567.0, "count", "1234567"), (2.5, None, "2.5"), ([1.0, None], None, "1, —"), ("word", None, "word")]
    for value, unit, want in said:
        assert format_value(value, unit) == want, (value, unit)
    assert render("{n} {n|item is:items are} {gone}", {"n": 1.0}) == "1 item is —" and render("{n|item:items}", {"n": 2}) == "items"


def test_pages_and_ranges(spark):
    df = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(9)], "key string, t string")
    assert [r["key"] for r in ops.page(df, "k2", 3).collect()] == ["k3", "k4", "k5", "k6"]
    assert [r["key"] for r in ops.page(df, None, 3, "t 7").collect()] == ["k7"]
    v = spark.createDataFrame([("a%", "2026-01", 1.0), ("ab", "2026-02", 2.0)], "subject string, tail string, value double")
    assert [r["subject"] for r in ops.under(v, "a%").collect()] == ["a%"]
    assert [r["tail"] for r in ops.between(v, "2026-02", "2026-12").collect()] == ["2026-02"]
    kept = ops.insert_absent(v, spark.createDataFrame([("ab", "2026-02", 9.0), ("c", "2026-02", None)], v.schema), ["subject", "tail"])
    assert sorted((r["subject"], r["value"]) for r in kept.collect()) == [("a%", 1.0), ("ab", 2.0), ("c", None)]
