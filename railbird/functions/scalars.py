"""Column helpers: cast-or-null, first-truthy, half-even rounding, small categories."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: ColumnOrName) -> Column:
    return F.nanvl(as_column(c), F.lit(None).cast("double"))


def number(c: ColumnOrName) -> Column:
    """The value as a double; NULL where it cannot be one, and for NaN."""
    return null_if_nan(as_column(c).try_cast("double"))


def whole(c: ColumnOrName) -> Column:
    """The value truncated to an integer; NULL where it cannot be one."""
    return as_column(c).try_cast("double").try_cast("int")


def truthy(c: ColumnOrName, falsy=0) -> Column:
    """The value, or NULL where it equals ``falsy``."""
    return F.nullif(as_column(c), F.lit(falsy))


def first_truthy(*cols: ColumnOrName, falsy=0) -> Column:
    return F.coalesce(*[truthy(c, falsy) for c in cols])


def is_true(c: ColumnOrName) -> Column:
    return F.coalesce(as_column(c), F.lit(False))


def half_even(c: ColumnOrName, digits: int) -> Column:
    """Round to ``digits`` places as Python's ``round`` does: half to even on the exact binary value.

    ``rint`` rounds the scaled value, but that product may itself have been rounded onto a tie. With
    the value split into a float and the rest, both products and the distance from one half are
    exact, and tell where ``rint`` took the wrong side.
    """
    if isinstance(c, str) and re.fullmatch(r"[A-Za-z_]\w*", c):
        return F.expr(half_even_sql(c, digits))
    x = as_column(c).cast("double")
    scale = F.lit(float(10**digits))
    nearest = F.rint(x * scale)
    high = x.cast("float").cast("double")
    coarse, fine = high * scale - nearest, (x - high) * scale
    step = F.when((coarse - 0.5) + fine > 0, 1.0).when((coarse + 0.5) + fine < 0, -1.0).otherwise(0.0)
    # adding zero turns -0.0 into 0.0
    return (nearest + step) / scale + F.lit(0.0)


def half_even_sql(value: str, digits: int) -> str:
    """``half_even`` as an expression over a short value, such as a column or a field; built by Spark in one go."""
    x, scale = f"CAST({value} AS DOUBLE)", f"{10**digits}.0D"
    high = f"CAST(CAST({value} AS FLOAT) AS DOUBLE)"
    coarse, fine = f"({high} * {scale} - rint({x} * {scale}))", f"({x} - {high}) * {scale}"
    step = f"CASE WHEN ({coarse} - 0.5D) + {fine} > 0 THEN 1.0D WHEN ({coarse} + 0.5D) + {fine} < 0 THEN -1.0D ELSE 0.0D END"
    return f"(rint({x} * {scale}) + {step}) / {scale} + 0.0D"


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


# The surface categories and the prefixes that name them.
GOING_CATEGORIES = ("firm", "good", "soft", "heavy", "synth")


def going_category(c: ColumnOrName) -> Column:
    lowered = F.lower(as_column(c))
    out = F.lit(None).cast("string")
    for name in reversed(GOING_CATEGORIES):
        out = F.when(lowered.startswith(name), F.lit(name)).otherwise(out)
    return out


def start_instant(c: ColumnOrName, day: ColumnOrName | None = None) -> Column:
    """A start time as a UTC timestamp.

    Full timestamps are read as they are, without a zone as UTC. A bare ``HH:MM`` needs the race's
    day; without one it is NULL.
    """
    text = F.trim(as_column(c))
    # "2024-5-1" and the like are dates; only a clock time has a colon in its first three places.
    clock = text.rlike(r"^\d{1,2}:\d{2}")
    full = F.when(~clock, F.try_to_timestamp(text))
    if day is None:
        return full
    at = F.concat_ws(" ", as_column(day).cast("date").cast("string"), F.regexp_extract(text, r"^(\d{1,2}:\d{2})", 1))
    return F.coalesce(full, F.when(clock & as_column(day).isNotNull(), F.try_to_timestamp(at)))
