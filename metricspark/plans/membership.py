"""Groups and filters over records: which member is in which bucket."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar, paths
from ..lang import nodes as N

#: Rows of record kinds, each with a column `key` and its fields.
Records = dict[str, DataFrame]


def owners(records: Records, kind: str, path: str) -> DataFrame:
    """(v, owner): each usable key that records of a kind hold at a path, once for each of its holders."""
    df = records[kind]
    v = paths.key_of_one(df.schema, path) if not paths.crosses(df.schema, path) else F.explode(paths.keys(df.schema, path))
    return df.select(v.alias("v"), F.col("key").alias("owner")).where("v is not null").distinct()


class Membership:
    """Plans membership frames: groups give (member, subject[, tail]), filters (member); rows are distinct."""

    def __init__(self, records: Records, at: dt.datetime):
        self.records, self.at = records, at

    @property
    def now(self) -> Column:
        return F.lit(self.at).cast("timestamp") if self.at.tzinfo else F.to_timestamp(F.lit(self.at.isoformat(sep=" ")))

    def of(self, index: N.Group | N.Filter, keys: DataFrame | None = None) -> DataFrame:
        """All of an index, or the part of it that the members in `keys` (column member) make."""
        df = self.records[index.kind]
        if keys is not None:
            df = df.join(keys.select(F.col("member").alias("key")), "key", "left_semi")
        return self.group(index, df) if isinstance(index, N.Group) else self.filter(index, df)

    # filters

    def filter(self, f: N.Filter, df: DataFrame) -> DataFrame:
        t = f.test
        test = self.plain(f, df.schema)
        if test is None:
            if t.days is not None:
                limit: Column = F.lit(float(t.days))
            elif t.owner is None:
                limit = paths.loose_number(df.schema, t.field)
            else:
                df, limit = self.owner_limit(df, t)
            age = (paths.millis(self.now) - paths.millis(paths.instant(df.schema, t.path))) / 86400000.0
            test = age >= limit if t.older else age < limit
        return df.where(F.coalesce(test, F.lit(False))).select(F.col("key").alias("member"))

    def plain(self, f: N.Filter, schema: T.StructType) -> Column | None:
        """The test as a column of the record alone, if time and owners have no part in it; never unknown."""
        t = f.test
        if isinstance(t, N.Compare):
            return self.compare(schema, t)
        if isinstance(t, N.IsSet):
            test = paths.is_set(schema, t.path)
            return test if t.wanted else ~test
        return None

    @staticmethod
    def compare(schema: T.StructType, t: N.Compare) -> Column:
        """Equal to any text that is said; not equal if none is."""
        want = ("true" if t.value else "false") if isinstance(t.value, bool) else f"{t.value:.0f}" if isinstance(t.value, float) and t.value == int(t.value) else str(t.value)
        col, kind, many = paths.walk(schema, t.path)
        hit = F.exists(col, lambda x: F.coalesce(paths.as_text(x, kind) == want, F.lit(False))) if many else paths.as_text(col, kind) == want
        hit = F.coalesce(hit, F.lit(False))
        return hit if t.equal else ~hit

    def owner_limit(self, df: DataFrame, t: N.Age) -> tuple[DataFrame, Column]:
        """The threshold on the one owner of the one local value; several or none leave it unknown."""
        local, kind, path = t.owner
        held = owners(self.records, kind, path)
        body = self.records[kind]
        limits = held.join(body.select(F.col("key").alias("owner"), paths.loose_number(body.schema, t.field).alias("_n")), "owner")
        one = limits.groupBy("v").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_limit")).where("_c = 1").select("v", "_limit")
        mine = paths.keys(df.schema, local)
        out = df.withColumn("v", F.when(F.size(mine) == 1, F.try_element_at(mine, F.lit(1)))).join(one, "v", "left")
        return out, F.col("_limit")

    # groups

    def group(self, g: N.Group, df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """Memberships of the records in df, with columns of theirs to carry along.

        A record's keys and labels are distinct, so rows can only repeat where several of its values lead to one owner.
        """
        many = False
        cols: list[str] = []
        taken = set(df.columns)
        name = lambda s: s if s not in taken else f"{s}__"
        for i, part in enumerate(g.parts):
            out = name(f"_p{i}")
            if part.timed:
                df = self.timed(df, part, out, cols[0] if cols else None)
            else:
                crosses = paths.crosses(df.schema, part.path)
                if crosses:
                    df, many = df.withColumn(out, F.explode(paths.keys(df.schema, part.path))), many or part.through is not None
                else:
                    df = df.withColumn(out, paths.key_of_one(df.schema, part.path)).where(F.col(out).isNotNull())
                if part.through:
                    held = owners(self.records, *part.through)
                    df = df.join(held.select(F.col("v").alias(out), F.col("owner").alias(f"{out}o")), out).drop(out).withColumnRenamed(f"{out}o", out)
            cols.append(out)
        found = df.select(F.col("key").alias("member"), *[F.col(c).alias(n) for c, n in zip(cols, ("subject", "tail", *(f"part{i}" for i in range(2, 9))))], *carry)
        return found.distinct() if many else found

    def zone(self, df: DataFrame, part: N.Part, subject: str | None) -> tuple[DataFrame, Column | str | None]:
        """The frame with the calendar of each row's subject, where the part has one."""
        if part.zone_field is None:
            return df, part.zone
        kind, field = part.zone_field
        body = self.records[kind]
        said = paths.keys(body.schema, field)
        calendars = body.select(F.col("key").alias(subject), calendar.usable(F.when(F.size(said) == 1, F.try_element_at(said, F.lit(1)))).alias("_zone"))
        return df.join(calendars.where("_zone is not null"), subject), F.col("_zone")

    def timed(self, df: DataFrame, part: N.Part, out: str, subject: str | None) -> DataFrame:
        schema = df.schema
        if part.until is None:
            df = df.withColumn("_ts", paths.instant(schema, part.path))
            df, zone = self.zone(df, part, subject)
            wall = calendar.local(F.col("_ts"), zone)
            made = calendar.ordinal_label(wall, *part.ordinal) if part.ordinal else calendar.label(wall, part.grain)
            made = F.when(F.col("_ts").isNotNull(), made)
            return df.withColumn(out, made).where(F.col(out).isNotNull()).drop("_ts", "_zone")
        df = df.withColumn("_ts", paths.earliest(schema, part.path)).withColumn("_end", paths.instant(schema, part.until))
        df, zone = self.zone(df, part, subject)
        labels = calendar.span_labels(calendar.local(F.col("_ts"), zone), calendar.local(F.col("_end"), zone), part.grain)
        df = df.withColumn("_labels", labels).withColumn("_now", calendar.label(calendar.local(self.now, zone), part.grain))
        now, held = F.col("_now"), F.col("_labels")
        left = F.filter(held, lambda x: x >= now) if part.gone else held
        if part.overdue:
            past = (F.size(held) > 0) & (F.element_at(held, -1) < now)
            here = F.array(now)
            left = F.when(F.size(left) > 0, left).when(F.size(held) > 0, here) if part.gone else F.when(past, here)
        return df.withColumn("_kept", left).withColumn(out, F.explode("_kept")).drop("_ts", "_end", "_labels", "_now", "_kept", "_zone")
