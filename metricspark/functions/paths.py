"""Dotted paths over nested records as columns: what a predicate sees, what a key is, what a number or an instant is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as an ISO-8601 instant: Spark alone would also take '2026' or '2026-06'.
ISO = r"^\s*\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?\s*$"


def _field(name: str):
    return lambda x: x.getField(name)


def walk(schema: T.StructType, path: str, base: Column | None = None) -> tuple[Column, T.DataType, bool]:
    """The column at a path, its element type, and whether lists were crossed (it is then a flat array)."""
    col, kind, many = base, schema, False
    for step in path.split("."):
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return F.lit(None).cast("string"), T.StringType(), False
        inner = kind[step].dataType
        if many:
            col = F.transform(col, _field(step))
            if isinstance(inner, T.ArrayType):
                col = F.flatten(F.filter(col, lambda x: x.isNotNull()))
        else:
            col = F.col(f"`{step}`") if col is None else col.getField(step)
        if isinstance(inner, T.ArrayType):
            many, inner = True, inner.elementType
        kind = inner
    return col, kind, many


def number_key(x: Column) -> Column:
    """A number's canonical text: 3.0 is "3", 2.5 is "2.5"; NaN and infinities have none."""
    x = x.cast("double")
    whole = F.when(F.abs(x) < 1e16, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).when(x == F.floor(x), whole).otherwise(x.cast("string"))


def as_text(x: Column, kind: T.DataType) -> Column:
    """A scalar as predicates and keys see it."""
    if isinstance(kind, T.BooleanType):
        return F.when(x, "true").when(~x, "false")
    if isinstance(kind, T.IntegralType):
        return x.cast("string")
    if isinstance(kind, T.NumericType):
        return number_key(x)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.lit(None).cast("string")
    return x.cast("string")


def texts(schema: T.StructType, path: str) -> Column:
    """array<string> of what is said at a path, lists flattened, without nulls."""
    col, kind, many = walk(schema, path)
    out = F.transform(col, lambda x: as_text(x, kind)) if many else F.array(as_text(col, kind))
    return F.filter(F.coalesce(out, F.array().cast("array<string>")), lambda x: x.isNotNull())


def keys(schema: T.StructType, path: str) -> Column:
    """array<string> of usable keys: texts that aren't empty, each once."""
    return F.array_distinct(F.filter(texts(schema, path), lambda x: x != ""))


def key_of_one(schema: T.StructType, path: str) -> Column:
    """The key of a path without lists; null where there is none."""
    col, kind, _ = walk(schema, path)
    t = as_text(col, kind)
    return F.when(t != "", t)


def crosses(schema: T.StructType, path: str) -> bool:
    return walk(schema, path)[2]


def number(schema: T.StructType, path: str) -> Column:
    """The one finite number at a path; several, none, texts and flags are unknown."""
    col, kind, many = walk(schema, path)
    if not isinstance(kind, T.NumericType):
        return F.lit(None).cast("double")
    if many:
        found = F.filter(F.coalesce(col, F.array().cast(T.ArrayType(kind))), lambda x: x.isNotNull())
        col = F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))
    x = col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def loose_number(schema: T.StructType, path: str) -> Column:
    """As number(), and a text that reads as one: for thresholds of ages."""
    col, kind, many = walk(schema, path)
    return F.expr("cast(null as double)") if many else col.try_cast("double") if isinstance(kind, T.StringType) else number(schema, path)


def to_instant(x: Column, kind: T.DataType) -> Column:
    """A timestamp; texts must be whole ISO-8601 dates, without a zone they are UTC."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return x.cast("timestamp")
    if isinstance(kind, T.StringType):
        return F.when(x.rlike(ISO), F.regexp_replace(x, ",", ".").try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def instant(schema: T.StructType, path: str) -> Column:
    """The first readable instant at a path."""
    col, kind, many = walk(schema, path)
    if many:
        return F.try_element_at(F.filter(F.transform(col, lambda x: to_instant(x, kind)), lambda x: x.isNotNull()), F.lit(1))
    return to_instant(col, kind)


def earliest(schema: T.StructType, path: str) -> Column:
    """The earliest readable instant at a path."""
    col, kind, many = walk(schema, path)
    return F.array_min(F.transform(col, lambda x: to_instant(x, kind))) if many else to_instant(col, kind)


def is_set(schema: T.StructType, path: str) -> Column:
    """Is anything said: any flag, a number but 0, a text but the empty one."""
    col, kind, many = walk(schema, path)

    def said(x: Column) -> Column:
        if isinstance(kind, T.NumericType):
            return F.coalesce(x.cast("double") != 0, F.lit(False))
        if isinstance(kind, T.StringType):
            return F.coalesce(x != "", F.lit(False))
        return x.isNotNull()

    return F.coalesce(F.exists(col, said), F.lit(False)) if many else said(col)


def millis(x: Column) -> Column:
    """Epoch milliseconds with fractions."""
    return F.unix_micros(x).cast("double") / 1000.0
