"""Arithmetic and ladders where unknown stays unknown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang import nodes as N


def _is_text(e: object, text_of: Callable[[str], bool]) -> bool:
    if isinstance(e, N.Text):
        return True
    if isinstance(e, (N.Ref, N.Coord)):
        return text_of(e.name)
    if isinstance(e, N.Ladder):
        return any(_is_text(v, text_of) for _, v in e.rungs) or _is_text(e.otherwise, text_of)
    return False


class Lowering:
    """Turns calculations over bound columns into one column.

    leaf gives the column of a Ref, Coord or aggregate; text_of says which names are words.
    """

    def __init__(self, leaf: Callable[[object], Column], text_of: Callable[[str], bool] = lambda name: False, days: Callable[[str, str], Column] | None = None):
        self.leaf, self.text_of, self.days = leaf, text_of, days

    def value(self, e: object) -> Column:
        if isinstance(e, N.Num):
            return F.lit(float(e.value) * N.SCALES.get(e.scale, 1.0))
        if isinstance(e, N.Text):
            return F.lit(e.value)
        if isinstance(e, N.Arith):
            a, b = self.value(e.left), self.value(e.right)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[e.op]()
        if isinstance(e, N.Pick):
            a, b = self.value(e.left), self.value(e.right)
            return F.when(a.isNotNull() & b.isNotNull(), (F.greatest if e.fn == "max" else F.least)(a, b))
        if isinstance(e, N.Days):
            return self.days(e.start, e.end)
        if isinstance(e, N.Ladder):
            return self.ladder(e)
        return self.leaf(e)

    def cond(self, c: object) -> Column:
        """True, false or unknown. A word and a number are never equal, and not in any order."""
        if isinstance(c, N.Known):
            v = self.value(c.value)
            nothing = v.isNull() | (v == "") if _is_text(c.value, self.text_of) else v.isNull()
            return ~nothing if c.wanted else nothing
        words = [_is_text(s, self.text_of) for s in (c.left, c.right)]
        a, b = self.value(c.left), self.value(c.right)
        if words[0] != words[1]:
            both = a.isNotNull() & b.isNotNull()
            return F.when(both, F.lit(c.op == "!=")) if c.op in ("==", "!=") else F.lit(None).cast("boolean")
        if words[0] and c.op not in ("==", "!="):
            return F.lit(None).cast("boolean")
        return {"==": lambda: a == b, "!=": lambda: a != b, ">=": lambda: a >= b, "<=": lambda: a <= b, ">": lambda: a > b, "<": lambda: a < b}[c.op]()

    def ladder(self, e: N.Ladder) -> Column:
        """The first rung that holds; an unknown rung makes the whole ladder unknown, whatever comes after it."""
        out: Column | None = None
        for c, v in e.rungs:
            test = self.cond(c)
            if not isinstance(c, N.Known):
                out = F.when(test.isNull(), F.lit(None)) if out is None else out.when(test.isNull(), F.lit(None))
            out = F.when(test, self.value(v)) if out is None else out.when(test, self.value(v))
        return out.otherwise(self.value(e.otherwise))

    def is_text(self, e: object) -> bool:
        return _is_text(e, self.text_of)


def percentile(values: Column, rank: int) -> Column:
    """Nearest rank: the value at position ceil(rank x n / 100) of the sorted array, by whole numbers."""
    n = F.size(values)
    return F.when(n > 0, F.try_element_at(F.array_sort(values), F.greatest(F.lit(1), F.expr("cast(0 as int)") + F.floor((n * rank + 99) / 100).cast("int"))))


def median(values: Column) -> Column:
    """The middle of a sorted array, or the mean of the middle two."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.try_element_at(s, F.greatest(F.lit(1), i).cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)
