"""Projections give a row for each record, summaries one row over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.logic import Lowering
from ..lang import nodes as N
from .figures import Planner
from .membership import owners


def named(rows: DataFrame) -> DataFrame:
    """Projected rows with row_name, what a row is called: its `key`, else its `name`, else its id."""
    said = [F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in ("key", "name") if c in rows.columns]
    return rows.withColumn("row_name", F.coalesce(*said, F.col("id")))


class Projections:
    """Plans projections and summaries on top of a planner's figures."""

    def __init__(self, planner: Planner):
        self.planner, self.library = planner, planner.library

    def field(self, df: DataFrame, f: N.Field) -> Column:
        """A field of a record as its declared type.

        Texts: the smallest that isn't empty, else the empty one, else unknown. Dates: as texts, then read.
        Flags: the one that is said.
        """
        said = paths.texts(df.schema, f.path)
        if f.type == "number":
            return paths.number(df.schema, f.path)
        if f.type == "flag":
            return F.when(F.size(said) == 1, F.try_element_at(said, F.lit(1)) == "true")
        if f.type == "date":
            return paths.instant(df.schema, f.path)
        full = F.filter(said, lambda x: x != "")
        return F.when(F.size(full) > 0, F.array_min(full)).when(F.size(said) > 0, F.lit(""))

    def population(self, p: N.Projection, scope: tuple[str, str] | None) -> DataFrame:
        df = self.planner.records[p.kind]
        if p.population is not None:
            members = self.planner.set(p.population, N.Figure(p.name, p.kind, None)).df
            df = df.join(members.select(F.col("member").alias("key")), "key", "left_semi")
        if p.scoped_by is not None:
            if scope is None:
                raise ValueError(f"{p.name} is scoped by {p.scoped_by}: name a subject and a bucket")
            members = self.planner.index(p.scoped_by).where((F.col("subject") == scope[0]) & (F.col("tail") == scope[1]))
            df = df.join(members.select(F.col("member").alias("key")), "key", "left_semi")
        return df

    def rows(self, name: str, scope: tuple[str, str] | None = None) -> DataFrame:
        """All rows: key, fields, reads, values, and `flags`, the names of those that fire; omitted rows left out."""
        p = self.library.projections[name]
        base = self.population(p, scope)
        plain = {n: self.field(base, f) for n, f in p.fields if f.owner is None}
        locals_: dict[str, Column] = {}
        for n, f in p.fields:
            if f.owner:
                mine = paths.keys(base.schema, f.owner[0])
                locals_[n] = F.when(F.size(mine) == 1, F.try_element_at(mine, F.lit(1)))
        rename = {n: f"_c_{n}" for n, _ in p.fields}
        df = base.select(F.col("key").alias("_key"), *[c.alias(rename[n]) for n, c in plain.items()], *[c.alias(f"_l_{n}") for n, c in locals_.items()])
        for n, f in p.fields:
            if f.owner:
                _, kind, path = f.owner
                body = self.planner.records[kind]
                held = owners(self.planner.records, kind, path).join(body.select(F.col("key").alias("owner"), self.field(body, f).alias("_x")), "owner")
                one = held.groupBy("v").agg(F.count(F.lit(1)).alias("_n"), F.first("_x").alias(rename[n])).where("_n = 1").drop("_n")
                df = df.join(one.withColumnRenamed("v", f"_l_{n}"), f"_l_{n}", "left").drop(f"_l_{n}")
        texts = {n for n, f in p.fields if f.type == "text"}
        dates = {n for n, f in p.fields if f.type == "date"}
        cols = dict(rename)
        for n, figure, band in p.reads:
            source = self.planner.banded(figure) if band else self.planner.figure(figure)
            cols[n] = f"_c_{n}"
            df = df.join(source.select(F.col("subject").alias("_key"), F.col("level" if band else "value").alias(cols[n])), "_key", "left")
            if band or self.planner.type_of(figure) == "text":
                texts.add(n)
        low = self.lowering(cols, texts, dates, df)
        for n, _, e in p.values:
            df = df.withColumn(f"_c_{n}", low.value(e))
            cols[n] = f"_c_{n}"
            if low.is_text(e):
                texts.add(n)
        if p.omit is not None:
            df = df.where(~F.coalesce(low.cond(p.omit), F.lit(False)))
        fired = F.filter(F.array(*[F.when(low.cond(f.when), F.lit(f.name)) for f in p.flags]), lambda x: x.isNotNull()) if p.flags else F.array().cast("array<string>")
        return df.select(F.col("_key").alias("id"), *[F.col(c).alias(n) for n, c in cols.items()], fired.alias("flags"))

    def lowering(self, cols: dict[str, str], texts: set[str], dates: set[str], df: DataFrame) -> Lowering:
        flags = {c for c, t in df.dtypes if t == "boolean"}

        def leaf(e: object) -> Column:
            c = cols[e.name]
            return F.col(c).cast("double") if c in flags else paths.millis(F.col(c)) if e.name in dates else F.col(c)

        def instant(n: str) -> Column:
            return self.planner.membership.now if n == "now" else F.col(cols[n])

        return Lowering(leaf, lambda n: n in texts, lambda a, b: (paths.millis(instant(b)) - paths.millis(instant(a))) / 86400000.0)

    def projection(self, name: str, scope: tuple[str, str] | None = None, rows: DataFrame | None = None) -> DataFrame:
        """The rows in order and within the limit; unknown values sort last, ties by id."""
        p = self.library.projections[name]
        df = self.rows(name, scope) if rows is None else rows
        if p.sort is not None:
            by, down = p.sort
            df = df.orderBy(F.col(by).desc_nulls_last() if down else F.col(by).asc_nulls_last(), F.col("id"))
            if p.limit is not None:
                df = df.limit(p.limit)
        return df

    def summary(self, name: str, rows: DataFrame | None = None) -> DataFrame:
        """One row over all projected rows, before any limit. A total with an unknown value is unknown."""
        s = self.library.summaries[name]
        df = self.rows(s.over) if rows is None else rows
        texts = {n for n, t in df.dtypes if t == "string"}
        dates = {n for n, t in df.dtypes if t == "timestamp"}
        low = self.lowering({n: n for n in df.columns}, texts, dates, df)
        sums: list[Column] = []
        for n, where in s.counts:
            sums.append(F.count_if(F.coalesce(low.cond(where), F.lit(False)) if where is not None else F.lit(True)).cast("double").alias(n))
        for n, _, col, where in s.totals:
            taken = F.coalesce(low.cond(where), F.lit(False)) if where is not None else F.lit(True)
            x = F.col(col).cast("double")
            sums.append(F.when(F.count_if(taken & x.isNull()) == 0, F.coalesce(F.sum(F.when(taken, x)), F.lit(0.0))).alias(n))
        out = df.agg(*sums)
        cols = {n: n for n in out.columns}
        words: set[str] = set()
        after = self.lowering(cols, words, set(), out)
        for n, _, e in s.values:
            out = out.withColumn(n, after.value(e))
            cols[n] = n
            if after.is_text(e):
                words.add(n)
        fired = F.filter(F.array(*[F.when(after.cond(f.when), F.lit(f.name)) for f in s.flags]), lambda x: x.isNotNull()) if s.flags else F.array().cast("array<string>")
        return out.withColumn("flags", fired)


