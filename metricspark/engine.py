"""The engine: batches of records in, maintained values and answers out."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import calendar
from .functions.formatting import format_value, render
from .lang import nodes as N
from .lang.versions import Versions
from .operators import facts as ops
from .operators.changes import diff, ranked
from .plans.figures import Planner, buckets, walk
from .plans.projections import Projections, named
from .plans.readings import Readings
from .sources import schemas
from .sources.lineage import cut
from .sources.store import FolderStore, MemoryStore


#: Changes that a run tells, and runs that the log keeps.
TOLD, RUNS = 40, 1000
#: Touched subjects up to so many are broadcast.
TOUCHED = 100_000
RUN = "number long, at timestamp, full boolean, kinds array<string>, told array<string>"


@dataclass
class Batch:
    """Records to write and keys to delete by kind. `full` recomputes all; `defer` lands records without a pass."""

    writes: dict[str, dict[str, dict] | DataFrame] = field(default_factory=dict)
    stamps: dict[str, dict[str, dt.datetime]] = field(default_factory=dict)
    deletes: dict[str, list[str] | DataFrame] = field(default_factory=dict)
    full: bool = False
    defer: bool = False


@dataclass
class Outcome:
    """What a pass did: frames of changes by figure, and the names that may answer differently now."""

    changes: dict[str, DataFrame] = field(default_factory=dict)
    full: bool = False
    impacted: list[str] = field(default_factory=list)


@dataclass
class Result:
    """An answer: state ok, never-computed, behind-deploy or nothing-collected; rows are a lazy frame."""

    name: str
    version: str
    state: str
    rows: DataFrame | None = None
    unit: str | None = None
    display: str = ""


class Engine:
    """One tenant's records and values under one library."""

    def __init__(self, spark: SparkSession, library: N.Library, store: MemoryStore | FolderStore | None = None, kinds: dict[str, tuple[T.StructType, str | None]] | None = None):
        """`kinds` teaches a world without typed facts: for each kind its schema (with key and source_stamp) and name field."""
        self.spark, self.library = spark, library
        self.kinds = {k: (schemas.schema_of(f), f.label) for k, f in library.facts.items()} | (kinds or {})
        self.store = store or MemoryStore(spark)
        self.versions = Versions(library)
        self.listeners: list[tuple[Callable[[Outcome], None], frozenset[str] | None]] = []

    # reading state

    def records(self) -> dict[str, DataFrame]:
        """All kinds; a kind without records is an empty frame."""
        out = {}
        for kind, (schema, _) in self.kinds.items():
            df = self.store.get("facts", kind)
            out[kind] = df if df is not None else self.spark.createDataFrame([], schema)
        return out

    def planner(self, at: dt.datetime, stored: bool = False) -> Planner:
        p = Planner(self.library, self.records(), at)
        if stored:
            stale = self.stale()
            for name in self.library.figures:
                df = self.store.get("values", name)
                if df is not None and name not in stale:
                    p.frames[name] = df
            for name in [*self.library.groups, *self.library.filters]:
                df = self.store.get("members", name)
                if df is not None and name not in stale:
                    p.indexes[name] = df
        return p

    def stale(self) -> set[str]:
        """Figures, groups and filters that were never built, or from other definitions."""
        return {n for n in [*self.library.figures, *self.library.groups, *self.library.filters] if self.store.pointers.get(n) != self.versions.of(n)}

    @property
    def debt(self) -> bool:
        """Were records landed without a pass since? Kept with the state, so that another engine on the same store knows."""
        return "#debt" in self.store.pointers

    # writing

    def escalates(self, batch: Batch, at: dt.datetime) -> bool:
        """Must the pass look at everything: the first one, after deletes, deferred loads, writes to kinds that others go
        through or take calendars or ages from, or a new day under clipped spans. New definitions heal by themselves."""
        if batch.full or self.debt or any(isinstance(k, DataFrame) or k for k in batch.deletes.values()) or "#day" not in self.store.pointers:
            return True
        through = set()
        clipped = False
        for g in self.library.groups.values():
            for p in g.parts:
                through |= {p.through[0]} if p.through else set()
                through |= {p.zone_field[0]} if p.zone_field else set()
                clipped = clipped or p.gone or p.overdue
        for f in self.library.filters.values():
            if isinstance(f.test, N.Age) and f.test.owner:
                through.add(f.test.owner[1])
        for f in self.library.figures.values():
            through |= {f.across} if f.across else set()
        return bool(through & set(batch.writes)) or (clipped and self.store.pointers.get("#day") != at.date().isoformat())

    def apply(self, batch: Batch, at: dt.datetime | None = None) -> Outcome:
        """Verify, land and, unless deferred, run a pass. The state after a warm pass is that after a full one."""
        at = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        if batch.defer and batch.full:
            raise ValueError("a deferred batch runs no pass, so no full one")
        bodies = {k: w for k, w in batch.writes.items() if not isinstance(w, DataFrame)}
        schemas.verify(self.library, bodies)
        full = self.escalates(batch, at)
        moved: dict[str, DataFrame] = {}
        for kind, keys in batch.deletes.items():
            df = self.store.get("facts", kind)
            if df is not None and (isinstance(keys, DataFrame) or keys):
                gone = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], "key string")
                self.store.change("facts", kind, df.limit(0), gone, "key")
        for kind, w in batch.writes.items():
            if kind not in self.kinds:
                raise schemas.Refused(f"no kind {kind!r} is declared")
            new = w if isinstance(w, DataFrame) else schemas.frame(self.spark, self.library.facts[kind], w, batch.stamps.get(kind))
            old = self.store.get("facts", kind)
            lands = ops.landing(old, new if isinstance(w, dict) else schemas.shaped(kind, new, self.kinds[kind][0]))
            if old is None:
                moved[kind] = self.store.put("facts", kind, lands).select("key")
                continue
            lands = self.store.put("moved", kind, lands)
            moved[kind] = lands.select("key")
            if not lands.isEmpty():
                self.store.change("facts", kind, lands, moved[kind], "key")
        if batch.defer:
            self.store.pointers["#debt"] = "1"
            self.store.commit()
            return Outcome()
        out = self.full_pass(at) if full else self.warm_pass(at, moved)
        self.store.pointers.pop("#debt", None)
        self.retire()
        served = self.serve_stamps()
        out.impacted = self.ordered({*out.impacted, *[n for n, s in served.items() if self.store.pointers.get(f"@{n}", s) != s]})
        self.store.pointers.update({f"@{n}": s for n, s in served.items()})
        self.store.pointers["#day"] = at.date().isoformat()
        self.log(batch, out, at)
        self.store.commit()
        for call, names in self.listeners:
            if names is None or names & set(out.impacted):
                call(out)
        return out

    def serve_stamps(self) -> dict[str, str]:
        """For each name that answers, a hash of its whole declaration, prose included: an edit of prose alone moves no value, but what is served."""
        lib = self.library
        return {n: hashlib.sha256(repr(x).encode()).hexdigest()[:12] for shelf in (lib.figures, lib.readings, lib.projections, lib.summaries, lib.bundles) for n, x in shelf.items()}

    def retire(self) -> None:
        """Forget the indexes, values and pointers of names that the library no longer has."""
        lib = self.library
        for area, known in (("members", {*lib.groups, *lib.filters}), ("values", {*lib.figures})):
            for name in self.store.names(area):
                if name not in known:
                    self.store.drop(area, name)
                    self.store.pointers.pop(name, None)
        answering = {*lib.figures, *lib.readings, *lib.projections, *lib.summaries, *lib.bundles}
        for name in [n for n in self.store.pointers if n.startswith("@") and n[1:] not in answering]:
            self.store.pointers.pop(name)

    def log(self, batch: Batch, out: Outcome, at: dt.datetime) -> None:
        """Append the pass to the log of runs: when, full or warm, kinds written, and the changes to tell first."""
        told = []
        for name, c in out.changes.items():
            told += [f"{name} {r['subject']}: {format_value(r['before'])} -> {format_value(r['after'])}" for r in ranked(c, TOLD).select("subject", "before", "after").collect()]
        number = int(self.store.pointers.get("#run", "0")) + 1
        self.store.pointers["#run"] = str(number)
        row = [(number, at, out.full, sorted({*batch.writes, *batch.deletes}), told[:TOLD])]
        new = self.spark.createDataFrame(row, RUN)
        old = self.store.get("runs", "log")
        kept = new if old is None else old.where(F.col("number") > number - RUNS).unionByName(new)
        self.store.put("runs", "log", kept)

    def runs(self, n: int = 20) -> DataFrame:
        """The last passes, newest first."""
        df = self.store.get("runs", "log")
        return (df if df is not None else self.spark.createDataFrame([], RUN)).orderBy(F.desc("number")).limit(n)

    def member_of(self, kind: str, key: str) -> DataFrame:
        """(index, subject, tail) of every bucket that a record is in."""
        found = []
        for name in [*self.library.groups, *self.library.filters]:
            index = self.library.index(name)
            df = self.store.get("members", name)
            if df is None or ((index.keyed_as or index.kind) if isinstance(index, N.Filter) else index.kind) != kind:
                continue
            cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("subject", "tail")]
            found.append(df.where(F.col("member") == key).select(F.lit(name).alias("index"), *cols))
        empty = self.spark.createDataFrame([], "index string, subject string, tail string")
        return reduce(DataFrame.unionByName, found, empty)

    def _settle(self, name: str, new: DataFrame, out: Outcome, p: Planner) -> None:
        """Store a figure's values, all of them, and what moved against those before."""
        before = self.store.get("values", name)
        stored = self.store.put("values", name, new)
        p.frames[name] = stored
        if before is not None:
            out.changes[name] = diff(before, stored, p.keys(name))
        self.store.pointers[name] = self.versions.of(name)

    def full_pass(self, at: dt.datetime) -> Outcome:
        """Rebuild every index and figure, figures after those they read."""
        p, out = self.planner(at), Outcome(full=True)
        for name in [*self.library.groups, *self.library.filters]:
            p.indexes[name] = self.store.put("members", name, p.index(name))
            self.store.pointers[name] = self.versions.of(name)
        for name in self.library.figures:
            self._settle(name, p.build(name), out, p)
        out.impacted = self.impacted(list(self.library.figures))
        return out

    def warm_pass(self, at: dt.datetime, moved: dict[str, DataFrame]) -> Outcome:
        """Recompute the subjects that moved records reach, before or after, and what has new definitions.

        Indexes of written kinds are evaluated anew for written keys only. A subject is touched if it holds a
        written member in the figure's dealing index, is itself written, or reads a value that moved. Only touched
        rows are written. Carried figures are rebuilt, as the present moves under them; an index or a figure that was
        never built, or from another definition, is built whole, and nothing else for its sake but what reads it. The
        number of jobs depends on the library alone.
        """
        p, out, stale = self.planner(at, stored=True), Outcome(), self.stale()
        before: dict[str, DataFrame] = dict(p.indexes)
        for name in [*self.library.groups, *self.library.filters]:
            kind = self.library.index(name).kind
            if name in stale:
                p.indexes[name] = self.store.put("members", name, p.membership.of(self.library.index(name)))
                self.store.pointers[name] = self.versions.of(name)
            elif kind in moved:
                keys = moved[kind].select(F.col("key").alias("member"))
                p.indexes[name] = self.store.change("members", name, p.membership.of(self.library.index(name), keys), keys, "member")
        for name, f in self.library.figures.items():
            if name in stale or f.carried:
                self._settle(name, p.build(name), out, p)
                continue
            touched = self.touched(name, f, p, before, moved, out)
            if touched is not None:
                subjects = self.store.put("touched", name, touched.distinct())
                old = self.store.get("values", name).join(F.broadcast(subjects) if subjects.limit(TOUCHED + 1).count() <= TOUCHED else subjects, "subject", "left_semi")
                made = self.store.put("made", name, p.build(name, only=subjects))
                out.changes[name] = self.store.put("changes", name, diff(old, made, p.keys(name)))
                p.frames[name] = self.store.change("values", name, made, subjects, "subject")
        out.impacted = self.impacted(list(out.changes))
        return out

    def touched(self, name: str, f: N.Figure, p: Planner, before: dict[str, DataFrame], moved: dict[str, DataFrame], out: Outcome) -> DataFrame | None:
        """Subjects (column subject) whose value may move; None if none can."""
        found: list[DataFrame] = []
        if f.scope in moved:
            found.append(moved[f.scope].select(F.col("key").alias("subject")))
        depends = dict(f.depends)
        group = p.scope_group(f)
        members: list[DataFrame] = []
        for a in p.population(f):
            kinds = {self.library.index(b.index).kind for b in buckets(a.over, depends)}
            if a.what is not None and a.what not in self.library.figures:
                kinds.add(self.library.measures[a.what].kind if a.what in self.library.measures else a.what.partition(".")[0])
            members += [moved[k].select(F.col("key").alias("member")) for k in kinds if k in moved]
            if a.what in out.changes:
                changed = out.changes[a.what].select("subject")
                if a.fn == "spread":
                    found.append(changed)
                else:
                    members.append(changed.select(F.col("subject").alias("member")))
        if members and group is not None:
            keys = reduce(DataFrame.unionByName, members).distinct()
            for held in (before.get(group.name), p.index(group.name)):
                if held is not None:
                    found.append(held.join(keys, "member", "left_semi").select("subject"))
        unscoped = any(isinstance(e, N.SetOp) for _, e in f.depends) and any(b.scope is None for _, e in f.depends for b in buckets(e, depends))
        if members and unscoped and any(isinstance(e, N.SetOp) and e.op == "|" for _, s in f.depends for e in walk(s)):
            found.append(p.roster(f.scope))  # a member of everybody's moves everybody
        for s in p.sources(f):
            if s in out.changes and not any(a.what == s for a in p.population(f)):
                found.append(out.changes[s].select("subject"))
        return reduce(DataFrame.unionByName, found) if found else None

    # impact and listeners

    def impacted(self, moved: list[str]) -> list[str]:
        """Names that may answer differently once these figures moved, in order of declaration."""
        lib, hit = self.library, set(moved)
        for name, f in lib.figures.items():
            if f.band is not None and any(isinstance(e, N.Ref) and e.name in hit for e in walk(f.band)):
                hit.add(name)
        for name, r in lib.readings.items():
            if r.source in hit or (r.band is not None and any(isinstance(e, N.Ref) and e.name in hit for e in walk(r.band))):
                hit.add(name)
        kinds = {lib.figures[m].scope for m in moved if m in lib.figures}
        for name, p in lib.projections.items():
            if any(figure in hit for _, figure, _ in p.reads) or p.kind in kinds:
                hit.add(name)
        hit |= {n for n, s in lib.summaries.items() if s.over in hit}
        hit |= {n for n, b in lib.bundles.items() if any(target in hit for _, _, target, _ in b.slots)}
        for name, r in lib.readings.items():
            if r.live is not None and r.scope in kinds:
                hit.add(name)
        return self.ordered(hit)

    def ordered(self, names: set[str]) -> list[str]:
        """Names that answer, in order of declaration."""
        lib = self.library
        return [n for n in [*lib.figures, *lib.readings, *lib.projections, *lib.summaries, *lib.bundles] if n in names]

    def subscribe(self, call: Callable[[Outcome], None], names: list[str] | None = None) -> Callable[[], None]:
        """Call after each pass that touches the names (or any); the returned function ends it."""
        entry = (call, None if names is None else frozenset(names))
        self.listeners.append(entry)
        return lambda: self.listeners.remove(entry)

    # answers

    def state(self, figure: str) -> str:
        """Can a figure be told: never-computed, behind-deploy, nothing-collected (in no index it reads) or ok."""
        if figure not in self.store.pointers:
            return "never-computed"
        if self.store.pointers[figure] != self.versions.of(figure):
            return "behind-deploy"
        p = self.planner(dt.datetime(1970, 1, 1), stored=True)
        todo, reads = [figure], set()
        while todo:
            f = self.library.figures[todo.pop()]
            depends = dict(f.depends)
            reads |= {b.index for a in p.population(f) for b in buckets(a.over, depends)}
            todo += p.sources(f)
        return "ok" if not reads or any(ops.any_of(p.index(i)) for i in reads) else "nothing-collected"

    def page_state(self, name: str) -> str:
        """Can a projection or the summary over it be told: nothing-collected where its kind has no record; never-computed
        or behind-deploy where an index of its population, or a figure that it reads, is that; else ok."""
        p = self.library.projections[name]
        if not ops.any_of(self.records()[p.kind]):
            return "nothing-collected"
        indexes = {b.index for b in buckets(p.population, {})} if p.population is not None else set()
        indexes |= {p.scoped_by} if p.scoped_by else set()
        if any(self.store.pointers.get(i) != self.versions.of(i) for i in indexes):
            built = {*self.library.groups, *self.library.filters} & self.store.pointers.keys()
            return "behind-deploy" if built else "never-computed"
        states = {self.state(figure) for _, figure, _ in p.reads} - {"ok", "nothing-collected"}
        return "never-computed" if "never-computed" in states else "behind-deploy" if states else "ok"

    def labels(self, kind: str) -> DataFrame:
        """(subject, label): the name of each record of a kind, else its id."""
        df = self.records()[kind]
        label = self.kinds[kind][1]
        return df.select(F.col("key").alias("subject"), F.coalesce(F.col(label), F.col("key")).alias("label") if label else F.col("key").alias("label"))

    def answer(self, name: str, windows: list[str] | None = None, at: dt.datetime | None = None, subjects: list[str] | None = None, pool: bool = False, scope: tuple[str, str] | None = None) -> Result | dict[str, Result]:
        """Any declaration by name: figures, readings, projections, summaries and, by slot, bundles."""
        at = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        lib, version = self.library, self.versions.of(name)
        p = self.planner(at, stored=True)
        for carried in [n for n, f in lib.figures.items() if f.carried and n != name]:
            p.frames.pop(carried, None)  # readings look from their own instant, to which the value is carried anew
        if name in lib.figures:
            f = lib.figures[name]
            state = self.state(name)
            if state != "ok":
                return Result(name, version, state, None, f.unit, f.display)
            df = p.banded(name)
            if subjects is not None:
                df = df.where(F.col("subject").isin(*subjects))
            df = df.join(self.labels(f.scope), "subject", "left").orderBy(F.lower("label"), *p.keys(name))
            return Result(name, version, "ok", df, f.unit, f.display)
        if name in lib.readings:
            r = lib.readings[name]
            state = self.state(r.source) if r.source else "ok"
            rows = Readings(p).reading(name, windows, at, subjects, pool).orderBy("subject", "window") if state == "ok" else None
            return Result(name, version, state, rows, None, r.display)
        if name in lib.projections:
            state = self.page_state(name)
            return Result(name, version, state, named(Projections(p).projection(name, scope)) if state == "ok" else None)
        if name in lib.summaries:
            over = lib.summaries[name].over
            if lib.projections[over].scoped_by:
                raise ValueError(f"{name} is over rows that need a subject and a bucket")
            state = self.page_state(over)
            return Result(name, version, state, Projections(p).summary(name) if state == "ok" else None)
        out: dict[str, Result] = {}
        shared: dict[str, tuple[str, DataFrame | None]] = {}
        projections = Projections(p)
        for slot, kind, target, specs in lib.bundles[name].slots:
            over = target if kind == "projection" else lib.summaries[target].over if kind == "summarise" else None
            if over is None:
                out[slot] = self.answer(target, list(specs) or None, at)
                continue
            if over not in shared:
                state = self.page_state(over)
                shared[over] = state, cut(projections.rows(over)) if state == "ok" else None  # made once for all slots, and gone with the answer
            state, rows = shared[over]
            if rows is not None:
                rows = named(projections.projection(target, rows=rows)) if kind == "projection" else projections.summary(target, rows)
            out[slot] = Result(target, self.versions.of(target), state, rows)
        return out

    def flags(self, name: str, rows: DataFrame, most: int = 1000) -> list[dict]:
        """The sentences of the flags that fire on served rows, the first `most` rows of the answer."""
        plan = self.library.projections.get(name) or self.library.summaries[name]
        units = {n: u for n, u, _ in plan.values}
        by_name = {f.name: f for f in plan.flags}
        return [
            {"flag": f, "row": r.asDict().get("id"), "severity": by_name[f].severity, **{k: render(getattr(by_name[f], k), r.asDict(), units) for k in ("label", "detail", "action")}}
            for r in rows.limit(most).collect() for f in r["flags"]
        ]

    def evidence(self, name: str, subject: str, tail: str | None = None, at: dt.datetime | None = None) -> DataFrame:
        """The records behind one value: member, held (is it still there) and the record's columns."""
        p = self.planner(at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), stored=True)
        f = self.library.figures[name]
        cited = p.citations(name).where(F.col("subject") == subject)
        if tail is not None:
            cited = cited.where(F.col("tail") == tail)
        aggs = p.population(f)
        if not aggs:
            return cited.select("member").distinct().withColumn("held", F.lit(True))
        depends = dict(f.depends)
        index = self.library.index(next(b.index for b in buckets(aggs[0].over, depends)))
        kind = (index.keyed_as or index.kind) if isinstance(index, N.Filter) else index.kind
        body = self.records()[kind]
        return cited.select("member").distinct().join(body.withColumnRenamed("key", "member"), "member", "left").join(body.select(F.col("key").alias("member"), F.lit(True).alias("held")), "member", "left").withColumn("held", F.coalesce("held", F.lit(False)))

    def working(self, name: str, subject: str, at: dt.datetime) -> dict:
        """One subject's value computed anew from its records, step by step, beside the stored one."""
        p = self.planner(at)
        only = self.spark.createDataFrame([(subject,)], "subject string")
        f = self.library.figures[name]
        fresh = {tuple(r[k] for k in p.keys(name)): r["value"] for r in p.build(name, only=only).where(F.col("subject") == subject).collect()}
        held = self.store.get("values", name)
        stored = {tuple(r[k] for k in p.keys(name)): r["value"] for r in held.where(F.col("subject") == subject).collect()} if held is not None else {}
        steps = []
        for n, e in f.depends:
            s = p.set(e, f)
            mine = s.df.where(F.col("subject") == subject) if s.keys else s.df
            steps.append({"set": n, "members": mine.select("member").distinct().count()})
        for s in p.sources(f):
            steps.append({"figure": s, "values": [r.asDict() for r in p.figure(s).where(F.col("subject") == subject).limit(60).collect()]})
        near = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-6 * max(1, abs(a)))
        return {"steps": steps, "value": fresh, "stored": stored, "agrees": fresh.keys() == stored.keys() and all(near(v, stored[k]) for k, v in fresh.items())}

    def anchor(self, day: dt.date, zone: str | None = None) -> dt.datetime:
        """The instant that a day's readings look back from: its end in a zone."""
        return calendar.end_of_day(day, zone)
