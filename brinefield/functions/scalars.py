"""Scalar expressions: missing values, calendars, tolerances, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve overlapping three-month seasons, centre month 1 to 12.
SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")
# Seconds per unit of a numeric "<unit> since <epoch>" time.
TIME_UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}

ZONED_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)(Z|[+-]\d{2}:?\d{2})$"


def finite(value: Column) -> Column:
    """NaN and infinities become null: missing is never a number."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    """Signed hours ``later - earlier`` from whole microseconds."""
    return (micros(later) - micros(earlier)).cast("double") / 3.6e9


def leap_day_index(day: Column) -> Column:
    """0-365 position in a leap calendar, so 29 February always has its own slot."""
    return F.datediff(F.make_date(F.lit(2000), F.month(day), F.dayofmonth(day)), F.lit("2000-01-01").cast("date"))


def parse_zoned_time(text: Column) -> Column:
    """ISO time with a mandatory zone, whole seconds in UTC; null when invalid."""
    return F.when(text.rlike(ZONED_TIME), F.date_trunc("second", text.try_cast("timestamp")))


def decode_numeric_time(value: Column, units: Column) -> Column:
    """Numeric time under "<unit> since <epoch>", rounded to the second."""
    unit = F.split(F.lower(F.trim(units)), " since ").getItem(0)
    epoch = F.regexp_replace(F.split(F.trim(units), "(?i) since ").getItem(1), "Z$", "")
    factor = F.coalesce(*[F.when(unit.isin(name, name[:-1]), F.lit(seconds)) for name, seconds in TIME_UNIT_SECONDS.items()])
    start = F.unix_timestamp(epoch.try_cast("timestamp"))
    return F.timestamp_seconds(F.rint(finite(value) * factor + start).cast("long"))


def month_interval(ts: Column) -> tuple[Column, Column]:
    """Half-open calendar month [start, next month)."""
    start = F.trunc(ts, "MM")
    return start, F.add_months(start, 1)


def season_name(month: Column) -> Column:
    """Season centred on a month number 1-12."""
    return F.element_at(F.array(*[F.lit(s) for s in SEASONS]), month.cast("int"))


def season_centre(season: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEASONS]), season).cast("int")


def float32_step(value: Column) -> Column:
    """Distance from a float32 value to the next one up."""
    v = F.abs(value.cast("float").cast("double"))
    guess = F.floor(F.log2(F.when(v > 0, v)))
    exponent = (guess + F.when(F.pow(F.lit(2.0), guess + 1) <= v, 1).otherwise(0)
                - F.when(F.pow(F.lit(2.0), guess) > v, 1).otherwise(0))
    return F.when(v == 0, F.lit(2.0 ** -149)).otherwise(F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-126)) - 23))


def within_one_ulp(a: Column, b: Column) -> Column:
    """Equal to one float32 step and in the same hundredth; null only agrees with null."""
    close = (F.abs(a - b) <= F.greatest(float32_step(a), float32_step(b))) & (F.rint(a * 100) == F.rint(b * 100))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(close)


def guard_text(text: Column) -> Column:
    """Prefix text a spreadsheet would read as a formula, leading blanks ignored."""
    return F.when(text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
