"""Figures: one frame for all subjects of a figure, (subject[, tail], value)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, paths
from ..functions.logic import Lowering
from ..lang import nodes as N
from .membership import Membership, Records

#: Aggregates whose value over nothing is 0; that of the others is unknown.
ZERO = ("count", "sum")


def walk(e: object) -> Iterator[object]:
    """An expression and all below it."""
    yield e
    for below in (
        [e.left, e.right] if isinstance(e, (N.Arith, N.Pick, N.Cond, N.SetOp)) else [e.value] if isinstance(e, N.Known)
        else [x for c, v in e.rungs for x in (c, v)] + [e.otherwise] if isinstance(e, N.Ladder) else []
    ):
        yield from walk(below)


def buckets(e: object, depends: dict[str, object]) -> Iterator[N.Bucket]:
    """The index reads of a set."""
    if isinstance(e, N.Bucket):
        yield e
    elif isinstance(e, N.Named):
        yield from buckets(depends[e.name], depends)
    elif isinstance(e, N.SetOp):
        yield from buckets(e.left, depends)
        yield from buckets(e.right, depends)


class SetFrame:
    """A set per subject (scoped), or one for all: columns member and, scoped, subject[, tail]."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...]):
        self.df, self.keys = df, keys


class Planner:
    """Lowers a library's figures over records at one instant; frames are lazy and kept, so figures share them."""

    def __init__(self, library: N.Library, records: Records, at: dt.datetime, stored: dict[str, DataFrame] | None = None):
        self.library, self.records, self.at = library, records, at
        self.membership = Membership(records, at)
        self.indexes: dict[str, DataFrame] = {}
        self.frames: dict[str, DataFrame] = dict(stored or {})

    # what a figure is

    def population(self, f: N.Figure) -> list[N.Agg]:
        return [e for e in walk(f.calc) if isinstance(e, N.Agg)]

    def scope_group(self, f: N.Figure) -> N.Group | None:
        """The group that deals the figure out to its subjects."""
        depends = dict(f.depends)
        for a in self.population(f):
            for b in buckets(a.over, depends):
                if b.scope is not None:
                    return self.library.groups[b.index]
        return None

    def sources(self, f: N.Figure) -> list[str]:
        """Figures that a figure reads, its band aside."""
        out = []
        for e in walk(f.calc):
            name = e.figure if isinstance(e, N.Rollup) else e.name if isinstance(e, (N.Ref, N.Coord)) else e.what if isinstance(e, N.Agg) else None
            if name in self.library.figures and name not in out:
                out.append(name)
        return out

    def tail_part(self, name: str) -> N.Part | None:
        """The part that a figure's tail comes from."""
        f = self.library.figures[name]
        g = self.scope_group(f)
        if g is not None:
            return g.tail
        for e in walk(f.calc):
            if isinstance(e, N.Coord):
                return self.tail_part(e.name)
        return None

    def grained(self, name: str) -> bool:
        return self.tail_part(name) is not None

    def keys(self, name: str) -> list[str]:
        return ["subject", "tail"] if self.grained(name) else ["subject"]

    def type_of(self, name: str) -> str:
        """number, text or list."""
        f = self.library.figures[name]
        c = f.calc
        if isinstance(c, N.Agg):
            if c.fn == "list":
                return "list"
            if c.fn in ("latest", "earliest") and c.what not in self.library.measures:
                kind, _, path = c.what.partition(".")
                fact = self.library.facts.get(kind)
                return "text" if fact and fact.type_of(path) == "text" else "number"
            return "number"
        if isinstance(c, N.Ladder):
            return "text" if isinstance(c.otherwise, N.Text) or any(isinstance(v, N.Text) for _, v in c.rungs) else "number"
        return "number"

    # sets

    def index(self, name: str) -> DataFrame:
        if name not in self.indexes:
            self.indexes[name] = self.membership.of(self.library.index(name))
        return self.indexes[name]

    def roster(self, scope: str) -> DataFrame:
        return self.records[scope].select(F.col("key").alias("subject"))

    def set(self, e: object, f: N.Figure, only: DataFrame | None = None) -> SetFrame:
        """A set's members; with `only`, at least those of its subjects."""
        depends = dict(f.depends)
        if isinstance(e, N.Named):
            return self.set(depends[e.name], f, only)
        if isinstance(e, N.Bucket):
            df = self.index(e.index)
            if only is not None and "subject" in df.columns:
                df = df.join(only.select("subject"), "subject", "left_semi").select(df.columns)
            return SetFrame(df, tuple(c for c in ("subject", "tail") if c in df.columns))
        a, b = self.set(e.left, f, only), self.set(e.right, f, only)
        if e.op == "&":
            if not a.keys and b.keys:
                a, b = b, a
            return SetFrame(a.df.join(b.df, ["member", *b.keys], "left_semi"), a.keys)
        if len(a.keys) != len(b.keys) and (e.op == "|" or not a.keys):
            # the unscoped side is everybody's: only here are members written once for each subject
            keys = a.keys or b.keys
            everybody = (a if a.keys else b).df.select(*keys).distinct()
            if keys == ("subject",):
                everybody = self.roster(f.scope)
            if not a.keys:
                a = SetFrame(a.df.crossJoin(everybody), keys)
            else:
                b = SetFrame(b.df.crossJoin(everybody), keys)
        if e.op == "|":
            return SetFrame(a.df.select("member", *a.keys).unionByName(b.df.select("member", *b.keys)).distinct(), a.keys)
        return SetFrame(a.df.join(b.df, ["member", *b.keys], "left_anti"), a.keys)

    # what members carry

    def measure(self, m: N.Measure, df: DataFrame) -> Column:
        s = df.schema
        if m.shape == "field":
            return paths.number(s, m.later)
        if m.shape == "moment":
            return paths.millis(paths.instant(s, m.later))
        if m.shape == "clock":
            return (paths.millis(self.membership.now) - paths.millis(paths.instant(s, m.earlier))) / 1000.0
        return (paths.millis(paths.instant(s, m.later)) - paths.millis(paths.instant(s, m.earlier))) / 1000.0

    def carried_column(self, a: N.Agg, f: N.Figure) -> tuple[str | None, Column | None, Column | None]:
        """(kind, value, order) that an aggregate reads off each member's record; a kind of None reads none."""
        if a.what is None or a.what in self.library.figures:
            return None, None, None
        if a.what in self.library.measures:
            m = self.library.measures[a.what]
            return m.kind, self.measure(m, self.records[m.kind]), None
        kind, _, path = a.what.partition(".")
        df = self.records[kind]
        if a.fn == "sum":
            return kind, paths.number(df.schema, path), None
        col, data_type, _ = paths.walk(df.schema, path)
        g = self.scope_group(f)
        order = paths.instant(df.schema, g.tail.path) if g and g.tail and g.tail.timed else F.lit(None).cast("timestamp")
        text = self.type_of(f.name) == "text" or data_type.simpleString() == "string"
        return kind, (paths.as_text(col, data_type) if text else col.cast("double")), order

    def aggregate(self, a: N.Agg, v: str, o: str) -> Column:
        x = F.col(v)
        if a.fn == "count":
            return F.count("member").cast("double")
        if a.fn == "sum":
            return F.coalesce(F.sum(x), F.lit(0.0))
        if a.fn == "list":
            return F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("member", x.alias("x"))))), lambda s: s.x)
        if a.fn in ("latest", "earliest"):
            if a.what in self.library.measures:
                return F.max(x) if a.fn == "latest" else F.min(x)
            by = F.when(F.col(o).isNotNull(), F.struct(o, "member"))
            got = (F.max_by if a.fn == "latest" else F.min_by)(F.struct(x.alias("x")), by)
            return got.x
        return {"mean": F.avg, "median": F.median, "worst": F.max}[a.fn](x)

    # frames

    def figure(self, name: str) -> DataFrame:
        """(subject[, tail], value) of all subjects."""
        if name not in self.frames:
            self.frames[name] = self.build(name)
        return self.frames[name]

    def build(self, name: str, only: DataFrame | None = None) -> DataFrame:
        """The figure's frame, or the part of it that the subjects in `only` have."""
        f = self.library.figures[name]
        keys = self.keys(name)
        cols: dict[object, str] = {}
        by_set: dict[object, list[N.Agg]] = {}
        for e in walk(f.calc):
            if isinstance(e, N.Agg) and e not in cols:
                cols[e] = f"_a{len(cols)}"
                by_set.setdefault(("spread", e) if e.fn == "spread" else ("total", e) if e.what in self.library.figures else e.over, []).append(e)
        group = self.scope_group(f)
        alone = self.alone(f, by_set, keys) if only is None else None
        if alone is not None:
            spine = self.living(self.of_set(alone, by_set.pop(alone), f, keys, cols, None, every=True), f)
        else:
            spine = self.spine(f, keys, only)
        for over, aggs in by_set.items():
            if isinstance(over, tuple):
                spine = spine.join(self.of_figures(over[1], f, keys, cols[over[1]], only), keys, "left")
                continue
            spine = spine.join(self.of_set(over, aggs, f, keys, cols, only), keys, "left")
        for e, c in cols.items():
            if e.fn in ZERO and not (e.what in self.library.figures):
                spine = spine.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
            if e.fn == "list" and group is not None and len(keys) == 1:
                spine = spine.withColumn(c, F.coalesce(F.col(c), F.array().cast("array<double>")))
        for e in walk(f.calc):
            if e in cols or not isinstance(e, (N.Rollup, N.Ref, N.Coord)):
                continue
            cols[e] = c = f"_s{len(cols)}"
            if isinstance(e, N.Rollup):
                parts = self.figure(e.figure)
                got = parts.groupBy("subject").agg(F.sum("value").alias(c))
                spine = spine.join(got, "subject", "left").withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
            elif e.name in self.library.figures:
                on = [k for k in keys if k in self.keys(e.name)]
                spine = spine.join(self.figure(e.name).select(*on, F.col("value").alias(c)), on, "left")
            else:
                kind, _, path = e.name.partition(".")
                df = self.records[kind]
                spine = spine.join(df.select(F.col("key").alias("subject"), self.subject_value(df, path).alias(c)), "subject", "left")
        low = Lowering(lambda e: F.col(cols[e]), self.is_text)
        out = spine.select(*keys, low.value(f.calc).alias("value"))
        if isinstance(f.calc, N.Agg) and f.calc.fn == "list" and len(keys) == 2:
            out = out.where(F.size("value") > 0)
        return self.carry(f, out) if f.carried else out

    def is_text(self, name: str) -> bool:
        if name in self.library.figures:
            return self.type_of(name) == "text"
        kind, _, path = name.partition(".")
        fact = self.library.facts.get(kind)
        return bool(fact and fact.type_of(path) == "text")

    @staticmethod
    def subject_value(df: DataFrame, path: str) -> Column:
        col, kind, _ = paths.walk(df.schema, path)
        return col.cast("string") if kind.simpleString() == "string" else paths.number(df.schema, path)

    def spine(self, f: N.Figure, keys: list[str], only: DataFrame | None = None) -> DataFrame:
        """The subjects that have a row: the roster; with a tail, the index's pairs with a living subject (and dimension)."""
        roster = self.roster(f.scope)
        if only is not None:
            roster = roster.join(only.select("subject").distinct(), "subject", "left_semi")
        if len(keys) == 1:
            return roster
        g = self.scope_group(f)
        if g is None:
            found = [self.figure(s).select(*keys) for s in self.sources(f) if self.keys(s) == keys]
            pairs = reduce(DataFrame.unionByName, found).distinct()
        else:
            return self.living(self.index(g.name).select(*keys).distinct(), f, roster).select(*keys)
        return pairs.join(roster, "subject", "left_semi").select(*keys)

    def living(self, pairs: DataFrame, f: N.Figure, roster: DataFrame | None = None) -> DataFrame:
        """The rows whose subject (and dimension) has a record."""
        if f.across:
            pairs = pairs.join(self.records[f.across].select(F.col("key").alias("tail")), "tail", "left_semi")
        return pairs.join(self.roster(f.scope) if roster is None else roster, "subject", "left_semi")

    def alone(self, f: N.Figure, by_set: dict[object, list[N.Agg]], keys: list[str]) -> object | None:
        """The only set of a figure with a tail, where one scan of its group's kind tells both the pairs and all values."""
        if len(keys) != 2 or len(by_set) != 1:
            return None
        over, aggs = next(iter(by_set.items()))
        scan = None if isinstance(over, tuple) else self.one_scan(over, f)
        if scan is None or self.scope_group(f) is not scan[0]:
            return None
        return over if all(self.carried_column(a, f)[0] in (None, scan[0].kind) for a in aggs) else None

    def one_scan(self, e: object, f: N.Figure) -> tuple[N.Group, list[N.Filter]] | None:
        """The group and filters of a set that one scan of one kind can tell: an intersection without ages or owners."""
        depends = dict(f.depends)

        def flat(x: object) -> list[N.Bucket] | None:
            if isinstance(x, N.Named):
                return flat(depends[x.name])
            if isinstance(x, N.Bucket):
                return [x]
            if isinstance(x, N.SetOp) and x.op == "&":
                a, b = flat(x.left), flat(x.right)
                return None if a is None or b is None else a + b
            return None

        parts = flat(e)
        if parts is None:
            return None
        indexes = [self.library.index(b.index) for b in parts]
        groups = [g for g in indexes if isinstance(g, N.Group)]
        filters = [x for x in indexes if isinstance(x, N.Filter)]
        if len(groups) != 1 or any(p.gone or p.overdue for p in groups[0].parts):
            return None
        kind = groups[0].kind
        if any(x.kind != kind or x.keyed_as not in (None, kind) or isinstance(x.test, N.Age) for x in filters):
            return None
        return groups[0], filters

    def of_set(self, over: object, aggs: list[N.Agg], f: N.Figure, keys: list[str], cols: dict, only: DataFrame | None, every: bool = False) -> DataFrame:
        """All aggregates over one set in one sum; each kind's values are read in one join, or with the set in one scan.

        With `every`, which needs one scan, all pairs of the group have a row, whether or not its filters leave any.
        Of a few subjects, the stored indexes' members are read first and only their records.
        """
        reads: dict[str, list[Column]] = {}
        names: dict[N.Agg, tuple[str, str]] = {}
        for a in aggs:
            kind, value, order = self.carried_column(a, f)
            v, o = f"{cols[a]}v", f"{cols[a]}o"
            names[a] = (v, o)
            if kind is not None:
                reads.setdefault(kind, []).append(value.alias(v))
                if order is not None:
                    reads[kind].append(order.alias(o))
        scan = self.one_scan(over, f) if only is None else None
        if scan is not None and set(reads) <= {scan[0].kind}:
            group, filters = scan
            body = self.records[group.kind]
            tests = [self.membership.plain(x, body.schema) for x in filters]
            columns = [c for wanted in reads.values() for c in wanted]
            body = body.select("*", *columns)
            carried = tuple(n for v, o in names.values() for n in (v, o) if n in body.columns)
            if every and tests:
                held = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
                body = body.withColumns({"_held": held} | {n: F.when(held, F.col(n)) for n in carried})
                df = self.membership.group(group, body, (*carried, "_held")).withColumn("member", F.when(F.col("_held"), F.col("member")))
            else:
                for t in tests:
                    body = body.where(t)
                df = self.membership.group(group, body, carried)
            reads = {}
        else:
            df = self.set(over, f, only).df
            if only is not None:
                df = df.join(only, "subject", "left_semi")
        for kind, wanted in reads.items():
            df = df.join(self.records[kind].select(F.col("key").alias("member"), *wanted), "member", "left")
        return df.groupBy(*keys).agg(*[self.aggregate(a, *names[a]).alias(cols[a]) for a in aggs])

    def of_figures(self, a: N.Agg, f: N.Figure, keys: list[str], c: str, only: DataFrame | None) -> DataFrame:
        """sum(figure over set): unknown if a member's is; spread: a subject's value over its number of buckets."""
        source = self.figure(a.what)
        if a.fn == "spread":
            pairs = self.index(self.scope_group(f).name).select("subject", "tail").distinct()
            n = pairs.withColumn("_n", F.count("tail").over(Window.partitionBy("subject")))
            return n.join(source, "subject").select("subject", "tail", F.try_divide(F.col("value"), F.col("_n")).alias(c))
        s = self.set(a.over, f)
        df = s.df if only is None else s.df.join(only.select("subject").distinct(), "subject", "left_semi")
        on = ["member", "tail"] if self.grained(a.what) and len(keys) == 2 else ["member"]
        joined = df.join(source.withColumnRenamed("subject", "member"), on, "left")
        total = joined.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == F.count("value"), F.sum("value")).alias("_t"))
        everyone = self.spine(f, keys, only)
        held = total.withColumn("_there", F.lit(True))
        return everyone.join(held, keys, "left").select(*keys, F.when(F.col("_there"), F.col("_t")).otherwise(F.lit(0.0)).alias(c))

    # carrying

    def zone_of(self, f: N.Figure, df: DataFrame) -> tuple[DataFrame, Column | str | None]:
        """df with its subjects' calendars, where the figure's sequence has one."""
        part = self.tail_part(f.name)
        if part is None or part.zone_field is None:
            return df, part.zone if part else None
        return self.membership.zone(df, part, "subject")

    def carry(self, f: N.Figure, anchors: DataFrame) -> DataFrame:
        """Each bucket's value until the next anchor's, or the present; never beyond, and no farther than the ceiling.

        An unknown anchor is carried as unknown; one that lies ahead keeps its own row. Each anchor fills the gap
        to the next by itself, so no calendar is joined.
        """
        part = self.tail_part(f.name)
        grain = part.grain
        step = F.expr({"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months"}[grain])
        df, zone = self.zone_of(f, anchors)
        now = F.to_date(F.date_trunc({"day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER"}[grain], calendar.local(self.membership.now, zone)))
        order = Window.partitionBy("subject").orderBy("_d")
        df = df.withColumn("_now", now).withColumn("_d", label_date(F.col("tail"), grain))
        df = df.withColumn("_next", F.lead("_d").over(order)).withColumn("_first", F.min("_d").over(Window.partitionBy("subject")))
        last = F.least(F.coalesce(F.date_sub(F.col("_next"), 1), F.col("_now")), F.col("_now"))
        far = F.datediff("_now", "_first") > calendar.MOST_CARRIED * calendar.WIDTH_DAYS[grain]
        filled = F.when(far | (last <= F.col("_d")), F.array("_d")).otherwise(F.sequence(F.col("_d"), last, step))
        return df.select("subject", F.explode(filled).alias("_d"), "value").select("subject", calendar.label(F.col("_d").cast("timestamp"), grain).alias("tail"), "value")

    # bands and evidence

    def banded(self, name: str) -> DataFrame:
        """The figure's frame with `level`, its band's word: `unknown` where a threshold or the value is."""
        f = self.library.figures[name]
        keys, df = self.keys(name), self.figure(name)
        if f.band is None:
            return df.withColumn("level", F.lit(None).cast("string"))
        cols: dict[str, str] = {"value": "value"}
        for e in walk(f.band):
            if isinstance(e, (N.Ref, N.Coord)) and e.name not in cols:
                cols[e.name] = c = f"_t{len(cols)}"
                if e.name in self.library.figures:
                    on = [k for k in keys if k in self.keys(e.name)]
                    df = df.join(self.figure(e.name).select(*on, F.col("value").alias(c)), on, "left")
                else:
                    kind, _, path = e.name.partition(".")
                    body = self.records[kind]
                    df = df.join(body.select(F.col("key").alias("subject"), self.subject_value(body, path).alias(c)), "subject", "left")
        low = Lowering(lambda e: F.col(cols[e.name]), lambda n: n != "value" and self.is_text(n))
        return df.select(*keys, "value", F.coalesce(low.ladder(f.band), F.lit("unknown")).alias("level"))

    def citations(self, name: str) -> DataFrame:
        """(subject[, tail], member): the records, or for figures of figures the rows, that stand behind each value."""
        f = self.library.figures[name]
        keys = self.keys(name)
        found = []
        for a in self.population(f):
            df = self.set(a.over, f).df.select(*keys, "member")
            kind, value, order = self.carried_column(a, f)
            if kind is not None and (a.fn in ("list", "mean", "median", "worst") or a.what not in self.library.measures):
                body = self.records[kind].select(F.col("key").alias("member"), value.alias("_v"), (order if order is not None else F.lit(None).cast("timestamp")).alias("_o"))
                df = df.join(body, "member")
                if a.fn in ("latest", "earliest"):
                    by = F.when(F.col("_o").isNotNull(), F.struct("_o", "member"))
                    df = df.groupBy(*keys).agg((F.max_by if a.fn == "latest" else F.min_by)("member", by).alias("member")).where("member is not null")
                else:
                    df = df.where("_v is not null")
            found.append(df.select(*keys, "member"))
        if not found:
            for s in self.sources(f):
                src = self.figure(s)
                address = F.concat_ws("@", *[F.col(k) for k in self.keys(s)])
                on = [k for k in keys if k in self.keys(s)]
                found.append(self.figure(name).select(*keys).join(src.select(*on, F.concat(F.lit(f"{s}:"), address).alias("member")), on))
        out = reduce(DataFrame.unionByName, found).distinct()
        if f.carried:
            full = self.figure(name).select("subject", "tail")
            anchors = out.select("subject", "tail").distinct().withColumn("_a", F.col("tail"))
            w = Window.partitionBy("subject").orderBy("tail").rowsBetween(Window.unboundedPreceding, 0)
            held = full.join(anchors, ["subject", "tail"], "left").select("subject", "tail", F.last("_a", True).over(w).alias("_a"))
            out = held.join(out.withColumnRenamed("tail", "_a"), ["subject", "_a"]).select("subject", "tail", "member")
        return out


def label_date(label: Column, grain: str) -> Column:
    """The first day of a label's bucket."""
    if grain == "month":
        return F.to_date(F.concat(label, F.lit("-01")))
    if grain == "quarter":
        return F.make_date(F.substring(label, 1, 4).cast("int"), F.substring(label, 7, 1).cast("int") * 3 - 2, F.lit(1))
    if grain == "week":
        fourth = F.make_date(F.substring(label, 1, 4).cast("int"), F.lit(1), F.lit(4))
        return F.date_add(F.to_date(F.date_trunc("WEEK", fourth)), (F.substring(label, 7, 2).cast("int") - 1) * 7)
    return F.to_date(label)
