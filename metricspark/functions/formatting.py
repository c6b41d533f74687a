"""How served values read. For rows on the driver only."""

from __future__ import annotations

import datetime as dt
import re


def _scaled(x: float, steps: tuple[tuple[float, str], ...]) -> str:
    """The value in the largest step that it reaches after rounding."""
    for i, (size, suffix) in enumerate(steps):
        shown = f"{x / size:.1f}"
        if abs(float(shown)) >= 1 or i == len(steps) - 1:
            return f"{shown.removesuffix('.0')}{suffix}"
    return str(x)


def format_value(value: object, unit: str | None = None) -> str:
    """A value in its unit; a dash where it is unknown."""
    if value is None:
        return "—"
    if isinstance(value, (list, tuple)):
        return ", ".join(format_value(v, unit) for v in value)
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    if isinstance(value, str):
        return value
    if unit == "share":
        return f"{value * 100:.1f}%"
    if unit == "days":
        return f"{value:.0f}d"
    if unit == "duration":
        size = abs(value)
        return f"{value:.0f}s" if size < 60 else f"{value / 60:.0f}m" if size < 3600 else f"{value / 3600:.1f}h" if size < 86400 else f"{value / 86400:.1f}d"
    if unit == "effort":
        return f"{value / 3600:.1f}h"
    if unit == "amount":
        return _scaled(value, ((1e9, "B"), (1e6, "M"), (1e3, "k"), (1.0, ""))) if abs(value) >= 999.95 else f"{value:g}"
    if unit == "moment":
        return dt.datetime.fromtimestamp(value / 1000, dt.timezone.utc).date().isoformat()
    return f"{value:.0f}" if float(value).is_integer() else f"{value:g}"


_SLOT = re.compile(r"\{(\w+(?:\.\w+)?)(?:\|([^:}]*):([^}]*))?\}")


def render(template: str, row: dict, units: dict[str, str | None] | None = None) -> str:
    """A template's sentence: {x} is the value of x, {x|one:many} a word that goes with its number."""

    def fill(m: re.Match) -> str:
        v = row.get(m[1])
        if m[2] is not None:
            return m[2] if isinstance(v, (int, float)) and abs(v - 1) < 1e-9 else m[3]
        return format_value(v, (units or {}).get(m[1]))

    return _SLOT.sub(fill, template)
