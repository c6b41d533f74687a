"""Where a declaration stands in its text, and what it says of itself."""

from __future__ import annotations

from . import nodes as N
from .grammar import nest


def source_of(text: str, name: str) -> str:
    """The declaration's own lines, with the comments right above it."""
    lines = text.split("\n")
    tops = [(t.number, [x.value for x in t.tokens]) for t in nest(text)]
    for i, (number, words) in enumerate(tops):
        if name not in words[1:2]:
            continue
        first = number - 1
        while first and lines[first - 1].lstrip().startswith("#"):
            first -= 1
        end = tops[i + 1][0] - 1 if i + 1 < len(tops) else len(lines)
        body = lines[first:end]
        while body and (not body[-1].strip() or (len(body) > number - first and body[-1].startswith("#"))):
            body.pop()
        return "\n".join(body)
    raise KeyError(name)


def about(library: N.Library, name: str) -> dict:
    """Kind of declaration, prose, display, unit and line of a name."""
    for shelf in ("facts", "groups", "filters", "measures", "figures", "readings", "projections", "summaries", "bundles"):
        x = getattr(library, shelf).get(name)
        if x is not None:
            return {"is": type(x).__name__.lower(), "name": name, "prose": getattr(x, "doc", ""), "display": getattr(x, "display", ""), "label": getattr(x, "label", "") or "", "unit": getattr(x, "unit", None), "line": x.line}
    raise KeyError(name)
