"""Scalar expressions: text, time, ratios, gains and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from slatewise.functions.lists import _c


def join_text(columns: Sequence[str], sep: str = " ") -> Column:
    """Columns glued with blanks; null if any part is null."""
    parts = [_c(columns[0]).cast("string")]
    for name in columns[1:]:
        parts += [F.lit(sep), _c(name).cast("string")]
    return F.concat(*parts)


def joined_name(columns: Sequence[str]) -> str:
    return "-".join(columns)


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(_c(text)), "[^\\p{L}\\p{N}]+"), lambda w: F.length(w) > 0)


def hashed_token_ids(text: Column | str, vocabulary: int, max_length: int | None = None) -> Column:
    """Token ids 1..vocabulary by hash; with ``max_length`` cut and right-padded with 0 to that length."""
    ids = F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % vocabulary + 1)
    if max_length is None:
        return ids
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), max_length)), 1, max_length)


def hour(ts: Column | str) -> Column:
    return F.hour(_c(ts))


def weekday(ts: Column | str) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(_c(ts)) + 1


def age_hours(now: Column | str, then: Column | str) -> Column:
    """Whole seconds between two timestamps, in hours."""
    return F.timestamp_diff("SECOND", _c(then), _c(now)).cast("double") / F.lit(3600.0)


def interval_text(seconds: Column) -> Column:
    """Seconds as ``D days H:M:S`` without zero padding."""
    return F.format_string(
        "%d days %d:%d:%d",
        F.floor(seconds / 86400).cast("long"),
        F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("long"),
        F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("long"),
        F.pmod(seconds, F.lit(60)).cast("long"),
    )


def smoothed_ratio(part: Column, whole: Column, prior: Column, strength: float) -> Column:
    """``part / whole`` pulled toward ``prior`` as if ``strength`` more trials had been seen."""
    return (part + F.lit(float(strength)) * prior) / (whole + F.lit(float(strength)))


def self_information(p: Column | str) -> Column:
    return -F.log2(_c(p))


def clip(p: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(p, F.lit(low)), F.lit(high))


def log_loss(label: Column, p: Column, eps: float = 1e-11) -> Column:
    q = clip(p.cast("double"), eps, 1 - eps)
    return -F.ln(F.when(label > 0, q).otherwise(1 - q))


def gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label.cast("double")) - 1


def combinations(n: Column, r: int) -> Column:
    """n choose r as a double, by the product form."""
    if r == 0:
        return F.lit(1.0)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(r)), F.lit(1.0),
        lambda acc, i: acc * (n - r + i).cast("double") / i.cast("double"),
    )


def rescale(x: Column, low: Column, high: Column, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """Linear map of [low, high] onto [to_low, to_high]; null when the source range is empty."""
    return F.try_divide(x - low, high - low) * F.lit(to_high - to_low) + F.lit(to_low)
