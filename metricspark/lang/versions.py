"""A declaration's version: a hash of all that decides its values, and of nothing else."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from . import nodes as N

#: Prose and places, which no version covers.
_PROSE = {"line", "doc", "display", "label", "url"}


def _plain(x: object, prose: bool = False) -> object:
    if dataclasses.is_dataclass(x):
        got = {f.name: _plain(getattr(x, f.name), prose) for f in dataclasses.fields(x) if prose or f.name not in _PROSE}
        return {"is": type(x).__name__} | {k: v for k, v in got.items() if v is not None}
    if isinstance(x, (tuple, list)):
        return [_plain(i, prose) for i in x]
    return x


def _digest(x: object) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


class Versions:
    """Versions of a library's declarations, each once."""

    def __init__(self, library: N.Library):
        self.library, self.known = library, {}

    def of(self, name: str) -> str:
        if name not in self.known:
            self.known[name] = _digest(self.covered(name))
        return self.known[name]

    def _index(self, name: str) -> object:
        plain = _plain(self.library.index(name))
        plain.pop("keyed_as", None)
        return plain

    def covered(self, name: str) -> object:
        """What the version of a name covers."""
        from ..plans.figures import buckets, walk

        lib = self.library
        if name in lib.facts:
            f = lib.facts[name]
            return ["fact", name, sorted(map(list, f.fields)), sorted(f.many)]
        if name in lib.figures:
            f = lib.figures[name]
            plain = _plain(f)
            plain.pop("bucketed", None)
            depends = dict(f.depends)
            reads = sorted({b.index for e in depends.values() for b in buckets(e, depends)} | {b.index for a in walk(f.calc) if isinstance(a, N.Agg) for b in buckets(a.over, depends)})
            names = {e.figure if isinstance(e, N.Rollup) else e.what if isinstance(e, N.Agg) else e.name for e in walk(f.calc) if isinstance(e, (N.Rollup, N.Agg, N.Ref, N.Coord))}
            return ["figure", plain, [self._index(i) for i in reads], [_plain(lib.measures[n]) for n in sorted(filter(None, names)) if n in lib.measures], [[n, self.of(n)] for n in sorted(filter(None, names)) if n in lib.figures and n != name]]
        if name in lib.readings:
            r = lib.readings[name]
            plain = _plain(r)
            if r.live:
                depends: dict[str, object] = {}
                plain["reads"] = [_plain(lib.measures[r.live[0]]), *[self._index(b.index) for b in buckets(r.live[1], depends)]]
            return ["reading", plain]
        if name in lib.projections:
            p = lib.projections[name]
            names = [b.index for b in buckets(p.population, {})] if p.population is not None else []
            return ["projection", _plain(p) | {"flags": _plain(p.flags, True)}, [self._index(n) for n in [*names, *([p.scoped_by] if p.scoped_by else [])]]]
        if name in lib.summaries:
            s = lib.summaries[name]
            return ["summary", _plain(s) | {"flags": _plain(s.flags, True)}, self.of(s.over)]
        if name in lib.bundles:
            return ["bundle", _plain(lib.bundles[name])]
        if name in lib.measures:
            return _plain(lib.measures[name])
        return self._index(name)


def render(library: N.Library) -> str:
    """The compiled library as JSON, the same for the same declarations."""
    v = Versions(library)
    shelves = {f.name: {n: {"version": v.of(n), "plan": _plain(x, True)} for n, x in getattr(library, f.name).items()} for f in dataclasses.fields(library)}
    return json.dumps(shelves, sort_keys=True, indent=1, default=str)
