"""Guards of declared parameters, places and optional fields. Declarations are bounded in number and become expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def declared(name: Column, value: Column, table: dict[str, tuple[float, float]]) -> Column:
    """A parameter against its declared range, both ends allowed: ok, below, above, missing or undeclared."""
    out = F.lit("undeclared")
    for known, (lo, hi) in table.items():
        out = F.when(name == known, F.when(value.isNull() | F.isnan(value.cast("double")), "missing").when(value < lo, "below").when(value > hi, "above").otherwise("ok")).otherwise(out)
    return out


def under(path: Column, root: str) -> Column:
    """Whether a path is a root or lies in it; whole segments, trailing slashes ignored. A path that steps up with
    ``..`` may leave its root and is outside."""
    root = root.rstrip("/")
    bare = F.regexp_replace(path, "/+$", "")
    return ((bare == root) | bare.startswith(root + "/")) & ~bare.rlike(r"(^|/)\.\.(/|$)")


def table_use(stand_in: Column, exact: Column, gated: Column, flagged: Column, root: Column, pilot_root: str | None) -> Column:
    """How a parameter table may be used for outputs below ``root``: a stand-in must be exactly the known one and stay
    in the declared pilot folder; another must be the gate's output without flags."""
    inside = under(root, pilot_root) if pilot_root else F.lit(False)
    pilot = F.when(~exact, "refused: not the stand-in").when(~F.coalesce(inside, F.lit(False)), "refused: outside the pilot folder").otherwise("stand_in")
    return F.when(stand_in, pilot).when(gated & ~flagged, "production").otherwise("refused: not the gate's output")


def optional(document: Column, field: str, kind: str) -> tuple[Column, Column]:
    """(value, state) of a field of a JSON text: absent is null, and what cannot be read, the text or the field, is
    null and ``malformed``."""
    raw = F.get_json_object(document, f"$.{field}")
    value = raw.try_cast(kind)
    broken = document.isNotNull() & F.get_json_object(document, "$").isNull()
    return value, F.when(broken, "malformed").when(raw.isNull(), "absent").when(value.isNull(), "malformed").otherwise("read")


def lookup(keys: list[Column], table: dict[tuple[str, ...], str]) -> Column:
    """The entry of a table with a composite key; null without one."""
    out = F.lit(None).cast("string")
    for entry, text in table.items():
        same = F.lit(True)
        for column, part in zip(keys, entry, strict=True):
            same = same & (column == part)
        out = F.when(same, text).otherwise(out)
    return out
