"""Region codes to zones and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattsift.fixed_values import (
    ACORN_LAYOUT, ACORN_ZONES, DEFAULT_ACORN_ZONE, STATE_NAMES, STATE_ZONES, UNKNOWN,
)
from wattsift.functions.parsing import literal_map, strip


def _zone_matching(text: Column, patterns: dict[str, str]) -> Column:
    """The first zone whose pattern is found in the text, else NULL."""
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(zone)) for zone, pattern in patterns.items()])


def acorn_zone(group: Column) -> Column:
    """Zone of an ACORN group: first zone with a member inside the text, any case."""
    inside = {zone: "|".join(m.lower() for m in members) for zone, members in ACORN_ZONES.items()}
    return F.coalesce(_zone_matching(F.lower(strip(group)), inside), F.lit(DEFAULT_ACORN_ZONE))


def _pieces(codes: list[str]) -> list[str]:
    """Every text that lies inside one of the codes, the empty text included."""
    return sorted({code[i:j] for code in codes for i in range(len(code) + 1) for j in range(i, len(code) + 1)})


def state_zone(code: Column) -> Column:
    """Zone of a state code.

    Exact codes come first. Then a code inside the text, or the text inside a code, decides,
    zone by zone; full state names therefore land where their letters lead, which is kept.
    """
    text = F.upper(strip(code))
    exact = literal_map({c: zone for zone, codes in STATE_ZONES.items() for c in codes})
    partial = {
        zone: f"{'|'.join(codes)}|^(?:{'|'.join(_pieces(codes))})$" for zone, codes in STATE_ZONES.items()
    }
    return F.coalesce(F.try_element_at(exact, text), _zone_matching(text, partial), F.lit(UNKNOWN))


def state_name(code: Column) -> Column:
    """Full name of a state code; the upper-cased text itself when the code is not known."""
    text = F.upper(strip(code))
    return F.coalesce(F.try_element_at(literal_map(STATE_NAMES), text), text, F.lit(UNKNOWN))


def region_source(columns: list[str], layout: str) -> str | None:
    """The standard column that a layout takes its region from, if the frame has one."""
    wanted = ["acorn_group"] if layout == ACORN_LAYOUT else ["state", "discom"]
    return next((name for name in wanted if name in columns), None)


def region_of(source: str | None, layout: str, code: Column | None = None) -> Column:
    """Region expression for a source column found by :func:`region_source`.

    ``code`` stands in for the source column when its values sit under another name.
    """
    if source is None:
        return F.lit(DEFAULT_ACORN_ZONE if layout == ACORN_LAYOUT else UNKNOWN)
    code = F.col(source) if code is None else code
    return {"state": state_zone, "acorn_group": acorn_zone}.get(source, lambda c: c)(code)
