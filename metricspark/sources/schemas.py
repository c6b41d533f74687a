"""Kinds as Spark schemas, and the gate that written records pass."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang import nodes as N

_TYPES = {"text": T.StringType(), "number": T.DoubleType(), "flag": T.BooleanType(), "moment": T.StringType()}
_KIND = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def tree(fact: N.Fact) -> dict:
    """The fields of a kind, nested as its records are; a list is ("many", fields)."""
    out: dict = {}
    for path, kind in fact.fields:
        here, steps = out, path.split(".")
        for i, step in enumerate(steps[:-1]):
            many = ".".join(steps[: i + 1]) in fact.many
            here = here.setdefault(step, ("many" if many else "one", {}))[1]
        here[steps[-1]] = kind
    return out


def struct(fields: dict) -> T.StructType:
    """All fields nullable; instants stay texts until they are read."""
    made = []
    for name, kind in fields.items():
        if isinstance(kind, tuple):
            inner = struct(kind[1])
            made.append(T.StructField(name, T.ArrayType(inner) if kind[0] == "many" else inner))
        else:
            made.append(T.StructField(name, _TYPES[kind]))
    return T.StructType(made)


def schema_of(fact: N.Fact) -> T.StructType:
    """key, source_stamp and the declared fields."""
    return T.StructType([T.StructField("key", T.StringType()), T.StructField("source_stamp", T.TimestampType()), *struct(tree(fact)).fields])


class Refused(ValueError):
    """A batch that is refused whole."""


def _check(kind: str, key: str, body: object, fields: dict, at: str = "") -> None:
    if not isinstance(body, dict):
        raise Refused(f"{kind} {key!r}: {at or 'the record'} is no object")
    for name, value in body.items():
        if value is None or value == "":
            continue
        where = f"{at}.{name}" if at else name
        want = fields.get(name)
        if want is None:
            raise Refused(f"{kind} {key!r}: {where} isn't declared")
        if isinstance(want, tuple):
            if want[0] == "many":
                if not isinstance(value, list):
                    raise Refused(f"{kind} {key!r}: {where} is no list")
                for x in value:
                    if x is not None:
                        _check(kind, key, x, want[1], where)
            else:
                _check(kind, key, value, want[1], where)
            continue
        ok = {
            "text": isinstance(value, str) and "\0" not in value,
            "number": isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value),
            "flag": isinstance(value, bool),
            "moment": isinstance(value, str) and _instant(value),
        }[want]
        if not ok:
            raise Refused(f"{kind} {key!r}: {where} is no {want}")


def _instant(text: str) -> bool:
    import datetime as dt

    try:
        dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


def verify(library: N.Library, writes: dict[str, dict[str, dict]]) -> None:
    """Refuse a batch with an unknown kind, an undeclared field or a value of another type, naming the first."""
    for kind, records in writes.items():
        if not _KIND.fullmatch(kind) or kind not in library.facts:
            raise Refused(f"no kind {kind!r} is declared")
        fields = tree(library.facts[kind])
        for key, body in records.items():
            _check(kind, key, body, fields)


def _cast(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_cast(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_cast(x, kind.elementType) for x in value if x is not None]
    return float(value) if isinstance(kind, T.DoubleType) else value


def frame(spark: SparkSession, fact: N.Fact, records: dict[str, dict], stamps: dict[str, object] | None = None) -> DataFrame:
    """Verified records as a frame of their kind."""
    schema = schema_of(fact)
    inner = T.StructType(schema.fields[2:])
    rows = [(k, (stamps or {}).get(k), *_cast(b, inner)) for k, b in records.items()]
    return spark.createDataFrame(rows, schema)


def shaped(kind: str, df: DataFrame, schema: T.StructType) -> DataFrame:
    """A frame of records as its kind's columns; refused if a column isn't declared, has another type, or the key is missing. Columns that aren't there are unsaid."""
    known = {f.name: f.dataType for f in schema.fields}
    if "key" not in df.columns:
        raise Refused(f"{kind}: the frame has no key")
    for f in df.schema.fields:
        want = known.get(f.name)
        if want is None:
            raise Refused(f"{kind}: {f.name} isn't declared")
        if not _fits(f.dataType, want):
            raise Refused(f"{kind}: {f.name} is no {want.simpleString()}")
    return df.select(*[F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in known.items()])


def _fits(have: T.DataType, want: T.DataType) -> bool:
    """Can a column's type be written as a field's: numbers as numbers, instants as their texts, the rest as itself."""
    if isinstance(want, T.StructType):
        return isinstance(have, T.StructType) and all(f.name in want.names and _fits(f.dataType, want[f.name].dataType) for f in have.fields)
    if isinstance(want, T.ArrayType):
        return isinstance(have, T.ArrayType) and _fits(have.elementType, want.elementType)
    if isinstance(want, T.DoubleType):
        return isinstance(have, T.NumericType)
    if isinstance(want, T.StringType):
        return isinstance(have, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType))
    return isinstance(have, (type(want), T.NullType))


def refusals(df: DataFrame, kind: str, fact: N.Fact, body: str = "body") -> DataFrame:
    """(reason) for each record of a landing table (key, body as JSON text) that the gate refuses."""
    fields = tree(fact)

    def run(batches):
        for b in batches:
            found = []
            for key, text in zip(b["key"], b[body]):
                try:
                    _check(kind, key, json.loads(text), fields)
                except Refused as e:
                    found.append(str(e))
                except ValueError:
                    found.append(f"{kind} {key!r}: the body is no JSON")
            yield pd.DataFrame({"reason": found}, dtype="object")

    return df.select("key", body).where(F.col(body).isNotNull()).mapInPandas(run, "reason string")


def from_json(df: DataFrame, fact: N.Fact, body: str = "body") -> DataFrame:
    """A landing table (key, source_stamp, body as JSON text) as a frame of a kind."""
    parsed = df.select("key", "source_stamp", F.from_json(body, struct(tree(fact))).alias("_b"))
    return parsed.select("key", "source_stamp", "_b.*")
