"""What definitions say, as immutable values. The parser makes them; Python callers may make them directly."""

from __future__ import annotations

from dataclasses import dataclass, field

GRAINS = ("minute", "15 minutes", "hour", "day", "week", "month", "quarter")
SUBDAY = ("minute", "15 minutes", "hour")
#: Seconds of each scale that a literal may carry.
SCALES = {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0, "weeks": 604800.0}
ORDINALS = ("first", "second", "third", "fourth", "fifth")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


class DefinitionError(ValueError):
    """A definition that is refused, with its line."""

    def __init__(self, message: str, line: int = 0):
        super().__init__(f"line {line}: {message}" if line else message)
        self.line = line


# --- facts ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fact:
    """A record kind: scalar fields by dotted name to type, and which of them are lists' insides."""

    name: str
    fields: tuple[tuple[str, str], ...]  # dotted path -> text | number | flag | moment
    many: tuple[str, ...] = ()  # dotted paths of lists
    label: str | None = None
    url: str | None = None
    doc: str = ""
    line: int = 0

    def type_of(self, path: str) -> str | None:
        return dict(self.fields).get(path)

    def crosses_list(self, path: str) -> bool:
        return any(path.startswith(m + ".") for m in self.many)


# --- indexes -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """One part of a group's key."""

    path: str
    through: tuple[str, str] | None = None  # kind, path
    grain: str | None = None
    ordinal: tuple[int, int] | None = None  # 1..5, weekday 0..6
    zone: str | None = None
    zone_field: tuple[str, str] | None = None  # kind, field
    until: str | None = None
    gone: bool = False
    overdue: bool = False

    @property
    def timed(self) -> bool:
        return self.grain is not None or self.ordinal is not None


@dataclass(frozen=True)
class Group:
    name: str
    kind: str
    parts: tuple[Part, ...]
    label: str = ""
    line: int = 0

    @property
    def tail(self) -> Part | None:
        return self.parts[1] if len(self.parts) > 1 else None


@dataclass(frozen=True)
class Compare:
    path: str
    equal: bool
    value: str | float | bool


@dataclass(frozen=True)
class IsSet:
    path: str
    wanted: bool = True


@dataclass(frozen=True)
class Age:
    path: str
    older: bool
    days: float | None = None
    field: str | None = None
    owner: tuple[str, str, str] | None = None  # local path, kind, kind's path


@dataclass(frozen=True)
class Filter:
    name: str
    kind: str
    test: Compare | IsSet | Age
    keyed_as: str | None = None
    label: str = ""
    line: int = 0


@dataclass(frozen=True)
class Measure:
    """duration: later - earlier; clock: now - earlier; moment: later; field: later in unit."""

    name: str
    kind: str
    shape: str
    later: str | None = None
    earlier: str | None = None
    unit: str | None = None
    line: int = 0


# --- sets ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bucket:
    index: str
    scope: str | None = None


@dataclass(frozen=True)
class Named:
    name: str


@dataclass(frozen=True)
class SetOp:
    op: str  # & | -
    left: object
    right: object


# --- calculations --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Agg:
    """fn over a set: count, sum, list, latest, earliest, mean, median, worst, spread; what: a measure, field or figure."""

    fn: str
    what: str | None
    over: object


@dataclass(frozen=True)
class Rollup:
    figure: str


@dataclass(frozen=True)
class Ref:
    """A figure of the same subject, a field of the subject's record, or a bound name."""

    name: str


@dataclass(frozen=True)
class Coord:
    """A figure at the same bucket."""

    name: str


@dataclass(frozen=True)
class Num:
    value: float
    scale: str | None = None


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Arith:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Pick:
    """max or min, unknown if a side is unknown."""

    fn: str
    left: object
    right: object


@dataclass(frozen=True)
class Days:
    """Signed fractional days between two dates of a row; `now` is the pass's instant."""

    start: str
    end: str


@dataclass(frozen=True)
class Cond:
    op: str  # >= > <= < == !=
    left: object
    right: object


@dataclass(frozen=True)
class Known:
    value: object
    wanted: bool  # is something / is nothing


@dataclass(frozen=True)
class Ladder:
    rungs: tuple[tuple[object, object], ...]
    otherwise: object


# --- declarations --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Figure:
    name: str
    scope: str
    calc: object
    depends: tuple[tuple[str, object], ...] = ()
    bucketed: bool = False
    across: str | None = None
    unit: str | None = None
    carried: bool = False
    band: Ladder | None = None
    display: str = ""
    doc: str = ""
    line: int = 0


@dataclass(frozen=True)
class Reading:
    name: str
    scope: str
    stats: tuple[tuple[str, int | None], ...]  # name, rank
    source: str | None = None  # a figure, windowed
    live: tuple[str, object] | None = None  # measure, set
    floor: int = 0
    band: Ladder | None = None
    band_on: str = "mean"
    display: str = ""
    doc: str = ""
    line: int = 0


@dataclass(frozen=True)
class Field:
    path: str
    type: str
    owner: tuple[str, str, str] | None = None  # local path, kind, kind's path


@dataclass(frozen=True)
class Flag:
    name: str
    when: object
    label: str = ""
    detail: str = ""
    action: str = ""
    severity: str = ""


@dataclass(frozen=True)
class Projection:
    name: str
    kind: str
    fields: tuple[tuple[str, Field], ...] = ()
    reads: tuple[tuple[str, str, bool], ...] = ()  # name, figure, band of it
    values: tuple[tuple[str, str | None, object], ...] = ()  # name, unit, calc
    flags: tuple[Flag, ...] = ()
    population: object | None = None
    scoped_by: str | None = None
    omit: object | None = None
    sort: tuple[str, bool] | None = None  # name, descending
    limit: int | None = None
    doc: str = ""
    line: int = 0


@dataclass(frozen=True)
class Summary:
    name: str
    over: str
    counts: tuple[tuple[str, object | None], ...] = ()
    totals: tuple[tuple[str, str | None, str, object | None], ...] = ()  # name, unit, column, where
    values: tuple[tuple[str, str | None, object], ...] = ()
    flags: tuple[Flag, ...] = ()
    doc: str = ""
    line: int = 0


@dataclass(frozen=True)
class Bundle:
    name: str
    slots: tuple[tuple[str, str, str, tuple[str, ...]], ...]  # slot, kind of answer, name, windows
    doc: str = ""
    line: int = 0


@dataclass(frozen=True)
class Library:
    """All declarations by name, in order."""

    facts: dict[str, Fact] = field(default_factory=dict)
    groups: dict[str, Group] = field(default_factory=dict)
    filters: dict[str, Filter] = field(default_factory=dict)
    measures: dict[str, Measure] = field(default_factory=dict)
    figures: dict[str, Figure] = field(default_factory=dict)
    readings: dict[str, Reading] = field(default_factory=dict)
    projections: dict[str, Projection] = field(default_factory=dict)
    summaries: dict[str, Summary] = field(default_factory=dict)
    bundles: dict[str, Bundle] = field(default_factory=dict)

    def index(self, name: str) -> Group | Filter:
        return self.groups[name] if name in self.groups else self.filters[name]
