"""Scalar functions over columns; all of them stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"seconds": 1_000_000, "hours": 3_600_000_000, "days": 86_400_000_000, "weeks": 604_800_000_000, "months": 2_592_000_000_000}


def span(value: float, unit: str) -> int:
    """A time span in microseconds; a month has 30 days."""
    if unit not in MICROS or unit == "seconds":
        raise ValueError(f"unknown time unit {unit!r}: use hours, days, weeks or months")
    return int(value * MICROS[unit])


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    second = F.extract(F.lit("SECOND"), ts)
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return day * MICROS["days"] + F.hour(ts) * F.lit(MICROS["hours"]) + F.minute(ts).cast("long") * F.lit(60 * MICROS["seconds"]) + (second * F.lit(MICROS["seconds"])).cast("long")


def decay(lag_micros: Column, days_echo: float) -> Column:
    """1 at no lag, 0.01 after ``days_echo`` days; the lag counts in whole seconds."""
    gamma = -math.log(0.01) / days_echo
    return F.exp(F.floor(lag_micros / F.lit(1_000_000)) / F.lit(86400.0) * F.lit(-gamma))


def label(col: Column | str) -> Column:
    """A clean boolean: numbers other than 0 and the word true are true, all else is false."""
    text = F.lower(F.trim((F.col(col) if isinstance(col, str) else col).cast("string")))
    return F.when(text.isin("true", "t", "yes"), True).otherwise(F.coalesce(text.try_cast("double"), F.lit(0.0)) != 0)


def number(col: Column | str) -> Column:
    """A double, or null where the text is not one."""
    return (F.col(col) if isinstance(col, str) else col).try_cast("double")


def scrub(col: Column) -> Column:
    """0 in place of null, NaN and infinities."""
    return F.when(col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(0).cast("float")).otherwise(col)


def run_tag(step: float, unit: str, echo_days: float | None = None, width: float | None = None) -> str:
    """The short name of a timing: first letter of the unit, step, then echo or width."""
    return f"{unit[0]}{step:g}_" + (f"echo{echo_days:g}" if echo_days is not None else f"w{width:g}")


def picture(features: list[Column]) -> Column:
    """Ten 3 x 3 blocks of the 90 features, channel by channel, rows first."""
    flat = F.array(*features)
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.slice(flat, c * 9 + r * 3 + 1, 3)))


def log_loss(logit: Column, y: Column, pos_weight: float = 1.0) -> Column:
    """Weighted binary cross entropy of a logit, stable for large values."""
    softplus = F.greatest(-logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))
    return (1 - y) * logit + (1 + (pos_weight - 1) * y) * softplus


def focal_loss(logit: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss; ``alpha`` stands in for a positive weight."""
    p = 1 / (1 + F.exp(-logit))
    hit = p * y + (1 - p) * (1 - y)
    return (alpha * y + (1 - alpha) * (1 - y)) * F.pow(1 - hit, F.lit(gamma)) * log_loss(logit, y)
