"""PostgreSQL function semantics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c\u0085                 　"


def concat(*parts: Column) -> Column:
    """Skips nulls and renders any type; '' if all are null."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def trim(text: Column, characters: str = WHITE, side: str = "both") -> Column:
    return {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side](text, F.lit(characters))


def substr(text: Column, start: Column, length: Column | None = None) -> Column:
    """1-based; a start below 1 is 1 and does not shorten the length."""
    first = F.greatest(start, F.lit(1))
    return F.substr(text, first) if length is None else F.substr(text, first, length)


def to_integer(value: Column, kind: str = "bigint") -> Column:
    """float to integer, half to even; null where it does not fit."""
    return F.bround(value).try_cast(kind)


def to_boolean(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("t", "true", "y", "yes", "on", "1"), True).when(low.isin("f", "false", "n", "no", "off", "0"), False)


def date_trunc(unit: str, moment: Column) -> Column:
    """The start of the unit as a timestamp without time zone; an unknown unit is an error."""
    if unit.lower() not in ("year", "month", "day", "hour", "minute", "second"):
        raise ValueError(f"unknown unit {unit!r}")
    return F.date_trunc(unit, moment).cast("timestamp_ntz")


def generate_series(start: Column, stop: Column, step: Column | None = None) -> Column:
    """The array of a series; empty for a step of 0 or of the wrong direction."""
    step = F.lit(1).cast("bigint") if step is None else step
    runs = ((step > 0) & (start <= stop)) | ((step < 0) & (start >= stop))
    safe = F.when(runs, step).otherwise(F.when(start <= stop, F.lit(1).cast("bigint")).otherwise(F.lit(-1).cast("bigint")))
    return F.filter(F.sequence(start, stop, safe), lambda _: runs)


def interval_parts(later: Column, earlier: Column) -> tuple[Column, Column]:
    """Whole months and left-over days of later - earlier, days borrowed from the month of the earlier date."""
    a, b = later.cast("date"), earlier.cast("date")
    back = a < b
    hi, lo = F.greatest(a, b), F.least(a, b)
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
    short = F.day(hi) < F.day(lo)
    whole = months - short.cast("int")
    borrowed = F.day(F.last_day(lo))
    days = F.day(hi) - F.day(lo) + F.when(short, borrowed).otherwise(0)
    return F.when(back, -whole).otherwise(whole), F.when(back, -days).otherwise(days)


def interval_text(months: Column, days: Column) -> Column:
    """'1 year 2 mons 3 days'; '00:00:00' for nothing."""
    years, rest = F.floor(F.abs(months) / 12), F.abs(months) % 12
    sign = F.when(months < 0, F.lit("-")).otherwise(F.lit(""))
    day_sign = F.when(days < 0, F.lit("-")).otherwise(F.lit(""))

    def part(n: Column, s: Column, unit: str) -> Column:
        return F.when(n != 0, F.concat(s, n.cast("string"), F.lit(f" {unit}"), F.when((n == 1) & (s == ""), F.lit("")).otherwise(F.lit("s"))))

    text = F.concat_ws(" ", part(years, sign, "year"), part(rest, sign, "mon"), part(F.abs(days), day_sign, "day"))
    return F.when(months.isNull() | days.isNull(), F.lit(None)).when(text == "", F.lit("00:00:00")).otherwise(text)


def age(later: Column, earlier: Column) -> Column:
    return interval_text(*interval_parts(later, earlier))


def interval_weight(months: Column, days: Column, seconds: Column) -> Column:
    """The magnitude intervals are compared by: a month counts 30 days."""
    return ((months * 30 + days) * 86400 + seconds).cast("double")


def array_contains_all(outer: Column, inner: Column) -> Column:
    """outer @> inner."""
    return F.size(F.array_except(inner, outer)) == 0
