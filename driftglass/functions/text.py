"""String functions of keys, paths and stamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def safe_component(name: Column) -> Column:
    """A portable path segment."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def to_token(name: Column) -> Column:
    """A reversible token: ``_`` is doubled and ``#`` becomes ``_h``."""
    return F.replace(F.replace(name, F.lit("_"), F.lit("__")), F.lit("#"), F.lit("_h"))


def from_token(token: Column) -> Column:
    mark = F.lit("\x01")
    return F.replace(F.replace(F.replace(token, F.lit("__"), mark), F.lit("_h"), F.lit("#")), mark, F.lit("_"))


def under_any(path: Column, roots: list[str]) -> Column:
    """Whether a path lies under one of the roots; nothing lies under none."""
    return reduce(lambda a, b: a | b, (path.startswith(r) for r in roots), F.lit(False))
