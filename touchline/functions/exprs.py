"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: str | Column) -> Column:
    """Text or number as double; what doesn't parse, and NaN, is null."""
    d = F.col(c).try_cast("double") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(d), d)


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return F.sqrt(dx * dx + dy * dy)


def flag(cond: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(cond, F.lit(False))


def truthy(c: str) -> Column:
    return flag(F.lower(F.trim(F.col(c).cast("string"))).isin("1", "true", "yes"))


def half_even(c: Column) -> Column:
    return F.bround(c).cast(T.LongType())


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The texts whose condition holds, joined by '; '; 'ok' if none does."""
    text = F.concat_ws("; ", *(F.when(c, F.lit(t)) for c, t in pairs))
    return F.when(text == "", "ok").otherwise(text)


def tokens(*pairs: tuple[Column, str | Column]) -> Column:
    """The tokens whose condition holds, joined by ';'."""
    return F.concat_ws(";", *(F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in pairs))


def clip():
    """The window of a clip."""
    return Window.partitionBy("clip_id")


def track():
    """The window of a clip's track, by frame."""
    return Window.partitionBy("clip_id", "track_id").orderBy("frame")
