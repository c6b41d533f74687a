"""Readings: window statistics over a figure's buckets, one row for each subject and window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.logic import Lowering, median, percentile
from ..lang import nodes as N
from .figures import Planner, walk

#: Statistics that nothing is known of without values, and so need one at least.
NEEDS_VALUES = ("mean", "median", "worst", "per_bucket", "percentile")
COLUMNS = {"mean": "mean", "median": "median", "worst": "worst", "sum": "total", "count": "count", "per_bucket": "per_bucket", "percentile": "percentile", "series": "series", "delta": "delta"}


def floor_of(r: N.Reading) -> int:
    """Values that a window needs: what is declared, else one where a statistic of a distribution is asked for."""
    return r.floor or (1 if any(s in NEEDS_VALUES for s, _ in r.stats) else 0)


def _statistic(stat: str, rank: int | None, values: Column, requested: Column) -> Column:
    """One statistic of an array of sample values."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    some = F.size(values) > 0
    if stat == "mean":
        return F.when(some, total / F.size(values))
    if stat == "median":
        return median(values)
    if stat == "worst":
        return F.array_max(values)
    if stat == "sum":
        return total
    if stat == "count":
        return F.size(values).cast("double")
    if stat == "per_bucket":
        return F.when(some, total / requested)
    return percentile(values, rank)


def _live_statistic(stat: str, rank: int | None) -> Column:
    """The same of the rows of a group (column v), as an aggregate; only a percentile needs its values together."""
    v = F.col("v")
    if stat == "percentile":
        return percentile(F.collect_list(v), rank)
    return {"mean": F.avg(v), "median": F.median(v), "worst": F.max(v), "sum": F.sum(v), "count": F.count(v).cast("double"), "per_bucket": F.sum(v)}[stat]


class Readings:
    """Plans readings on top of a planner's figures."""

    def __init__(self, planner: Planner):
        self.planner, self.library = planner, planner.library

    # windows

    def labels(self, figure: str, specs: list[str], at: dt.datetime) -> DataFrame:
        """(zone, window, idx, n, tail): the labels of each window for each calendar in use, oldest first."""
        p = self.planner
        part = p.tail_part(figure)
        windows = calendar.expand(specs, part.grain or "month")
        zones = [part.zone or "UTC"]
        if part.zone_field:
            kind, field = part.zone_field
            df, zone = p.membership.zone(p.roster(p.library.figures[figure].scope), part, "subject")
            zones = sorted(r["z"] for r in df.select(zone.alias("z")).distinct().collect())  # no more than there are time zones
        rows = []
        for z in zones:
            for w in windows:
                found = calendar.window_labels(at, z, w, part.grain, part.ordinal)
                rows += [(z, w, i, len(found), t) for i, t in enumerate(found)]
        return p.membership.records[p.library.figures[figure].scope].sparkSession.createDataFrame(rows, "zone string, window string, idx int, n int, tail string")

    def samples(self, figure: str, labels: DataFrame, pooled: list[str] | None = None, subjects: list[str] | None = None) -> DataFrame:
        """(subject, window, n, points, sample): a point (idx, values, value) for each bucket that has a value, oldest first.

        Subjects are those with a row in any window's buckets. A list's bucket counts each of its values, and its
        mean is its point. Pooled subjects are one: lists are put together, other values of a bucket added.
        """
        p = self.planner
        f = p.library.figures[figure]
        df = p.figure(figure)
        if subjects is not None:
            df = df.where(F.col("subject").isin(*subjects))
        is_list = p.type_of(figure) == "list"
        df, zone = p.zone_of(f, df)
        df = df.withColumn("zone", zone if isinstance(zone, Column) else F.lit(zone or "UTC"))
        met = df.join(F.broadcast(labels), ["zone", "tail"])
        values = F.coalesce(F.col("value"), F.array().cast("array<double>")) if is_list else F.when(F.col("value").isNotNull(), F.array("value")).otherwise(F.array().cast("array<double>"))
        met = met.select(F.lit("pool:" + ",".join(pooled)).alias("subject") if pooled else F.col("subject"), F.lit("pool").alias("zone") if pooled else F.col("zone"), "window", "n", "idx", values.alias("values"))
        if pooled:
            every = met.groupBy("subject", "zone", "window", "n", "idx").agg(F.flatten(F.collect_list("values")).alias("values"))
            met = every if is_list else every.withColumn("values", F.when(F.size("values") > 0, F.array(_statistic("sum", None, F.col("values"), F.lit(1)))).otherwise(F.col("values")))
        size = F.size("values")
        point = F.when(size > 0, F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / size)
        grouped = met.groupBy("subject", "window", "n").agg(F.array_sort(F.collect_list(F.struct("idx", "values", point.alias("value")))).alias("points"))
        # a subject with a row in one window has a row for each
        windows = labels.groupBy("window").agg(F.max("n").alias("n")).withColumn("zone", F.lit("pool")) if pooled else labels.select("zone", "window", "n").distinct()
        everyone = met.select("subject", "zone").distinct().join(F.broadcast(windows), "zone").drop("zone")
        grouped = everyone.join(grouped, ["subject", "window", "n"], "left").withColumn("points", F.coalesce("points", F.array().cast(grouped.schema["points"].dataType)))
        return grouped.withColumn("sample", F.flatten(F.transform("points", lambda x: x["values"])))

    # rows

    def reading(self, name: str, specs: list[str] | None = None, at: dt.datetime | None = None, subjects: list[str] | None = None, pool: bool = False) -> DataFrame:
        """subject, window, sample, buckets_covered, buckets_requested, a column for each statistic, level.

        Below the floor of values all statistics are unknown. `at` moves the anchor back (never the records).
        """
        r = self.library.readings[name]
        if r.live is not None:
            return self.live(r, subjects)
        at = at or self.planner.at
        specs = list(specs or calendar.DEFAULT_WINDOWS)
        labels = self.labels(r.source, specs, at)
        df = self.samples(r.source, labels, subjects if pool else None, subjects)
        covered = F.size(F.filter("points", lambda x: x["value"].isNotNull()))
        df = df.withColumn("buckets_covered", covered).withColumn("buckets_requested", F.col("n"))
        stats: dict[str, Column] = {}
        for stat, rank in r.stats:
            if stat in ("series", "delta"):
                continue
            stats[COLUMNS[stat]] = _statistic(stat, rank, F.col("sample"), F.col("n"))
        if any(s in ("series", "delta") for s, _ in r.stats):
            df = df.withColumn("_at", F.map_from_entries(F.transform("points", lambda x: F.struct(x["idx"], x["value"]))))
            series = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.try_element_at(F.col("_at"), i))
            df = df.withColumn("_series", F.when(F.col("n") > 0, series).otherwise(F.array().cast("array<double>")))
            if any(s == "series" for s, _ in r.stats):
                stats["series"] = F.col("_series")
                peak = F.array_max("_series")
                stats["series_scale"] = F.transform("_series", lambda x: F.when(x.isNotNull(), F.when(peak > 0, x / peak).otherwise(0.0)))
            if any(s == "delta" for s, _ in r.stats):
                stats["delta"] = F.transform("_series", lambda x, i: F.when(i > 0, x - F.try_element_at(F.col("_series"), i)))
        judged = dict(r.stats).get(r.band_on) if r.band_on == "percentile" else None
        df = df.withColumn("_value", _statistic(r.band_on, judged, F.col("sample"), F.col("n"))) if r.band else df
        enough = F.size("sample") >= floor_of(r)
        df = df.withColumn("_enough", enough)
        if r.band is not None:
            df = self.band(r, df, labels, judged, subjects if pool else None, subjects)
        else:
            df = df.withColumn("level", F.lit(None).cast("string"))
        return df.select("subject", "window", F.size("sample").alias("sample"), "buckets_covered", "buckets_requested", *[F.when(F.col("_enough"), c).alias(n) for n, c in stats.items()], "level")

    def band(self, r: N.Reading, df: DataFrame, labels: DataFrame, rank: int | None, pooled: list[str] | None, subjects: list[str] | None) -> DataFrame:
        """level: the band's word for the statistic it is on.

        A goal that is a figure by bucket is reduced over the same window by the same statistic, and is known only
        where it has a value in each bucket that the judged value has one in; goals of pooled subjects are put together.
        """
        p = self.planner
        cols = {"value": "_value"}
        for e in walk(r.band):
            if not isinstance(e, (N.Ref, N.Coord)) or e.name in cols:
                continue
            cols[e.name] = c = f"_g{len(cols)}"
            if e.name in self.library.figures and p.grained(e.name):
                goal = self.samples(e.name, labels, pooled, subjects)
                known = F.transform(F.filter("points", lambda x: x["value"].isNotNull()), lambda x: x["idx"])
                goal = goal.select("subject", "window", _statistic(r.band_on, rank, F.col("sample"), F.col("n")).alias(c), known.alias("_known"))
                has = F.transform(F.filter("points", lambda x: x["value"].isNotNull()), lambda x: x["idx"])
                df = df.join(goal, ["subject", "window"], "left")
                df = df.withColumn(c, F.when(F.size(F.array_except(has, F.coalesce("_known", F.array().cast("array<int>")))) == 0, F.col(c))).drop("_known")
            elif e.name in self.library.figures:
                df = df.join(p.figure(e.name).select("subject", F.col("value").alias(c)), "subject", "left")
            else:
                kind, _, path = e.name.partition(".")
                body = p.records[kind]
                df = df.join(body.select(F.col("key").alias("subject"), p.subject_value(body, path).alias(c)), "subject", "left")
        low = Lowering(lambda e: F.col(cols[e.name]), lambda n: n != "value" and p.is_text(n))
        return df.withColumn("level", F.when(F.col("_enough"), F.coalesce(low.ladder(r.band), F.lit("unknown"))).otherwise("unknown"))

    def live(self, r: N.Reading, subjects: list[str] | None) -> DataFrame:
        """A reading of a clock measure over a set, at the pass's instant; one row for each subject of the roster."""
        p = self.planner
        measure, over = r.live
        shape = N.Figure(r.name, r.scope, N.Agg("list", measure, over))
        m = self.library.measures[measure]
        s = p.set(over, shape)
        body = p.records[m.kind].select(F.col("key").alias("member"), p.measure(m, p.records[m.kind]).alias("v"))
        stats = {COLUMNS[s]: (s, rank) for s, rank in r.stats}
        judged = [(r.band_on, None)] if r.band else []
        wanted = [_live_statistic(s, rank).alias(f"_s{k}") for k, (s, rank) in enumerate([*stats.values(), *judged])]
        got = s.df.join(body, "member").groupBy("subject").agg(F.count("v").cast("int").alias("sample"), *wanted)
        roster = p.roster(r.scope)
        if subjects is not None:
            roster = roster.where(F.col("subject").isin(*subjects))
        df = roster.join(got, "subject", "left").withColumn("sample", F.coalesce("sample", F.lit(0))).withColumn("window", F.lit("now")).withColumn("n", F.lit(1)).withColumn("points", F.expr("cast(array() as array<struct<idx:int,values:array<double>,value:double>>)"))
        cols = {}
        for k, (stat, _) in enumerate([*stats.values(), *judged]):
            cols[k] = F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) if stat in ("sum", "count") else F.col(f"_s{k}")
        if r.band:
            df = df.withColumn("_value", cols[len(stats)])
        df = df.withColumn("_enough", F.col("sample") >= floor_of(r))
        df = self.band(r, df, None, None, None, None) if r.band else df.withColumn("level", F.lit(None).cast("string"))
        return df.select("subject", "window", "sample", F.lit(1).alias("buckets_covered"), F.lit(1).alias("buckets_requested"), *[F.when(F.col("_enough") | F.lit(n == "count"), cols[k]).alias(n) for k, n in enumerate(stats)], "level")
