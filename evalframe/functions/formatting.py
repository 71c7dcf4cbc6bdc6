"""Display arithmetic of the dashboard as column expressions (en-US texts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.functions.fixed_values import MISSING
from evalframe.functions.times import seconds_between


def number_text(value: Column) -> Column:
    absent = value.isNull() | F.isnan(value.cast("double"))
    return F.when(absent, MISSING).otherwise(F.format_number(value, 0))


def date_text(ts: Column) -> Column:
    shown = F.date_format(ts.cast("timestamp"), "MMM d, yyyy")
    return F.coalesce(shown, F.lit(MISSING))


def shortened(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 1)), F.lit("…"))).otherwise(text)


def utilisation(used: Column, limit: Column) -> Column:
    """Share of a limit in percent, within 0..100; no usable limit gives 0."""
    usable = limit.isNotNull() & ~F.isnan(limit) & (limit > 0)
    share = F.when(usable, used / F.when(usable, limit)) * 100
    return (
        F.when(~usable | used.isNull(), 0.0)
        .when(share > 100, 100.0)
        .when(share < 0, 0.0)
        .otherwise(share)
    )


_STEPS = (("s", 1, 60), ("m", 60, 3_600), ("h", 3_600, 86_400), ("d", 86_400, 30 * 86_400),
          ("mo", 30 * 86_400, 360 * 86_400))


def age_unit(ts: Column, asof: Column) -> Column:
    """(unit, n) of an age: months of 30 days, years of 12 such months."""
    age = seconds_between(ts, asof)
    unit = F.when(age.isNull(), "never").when(age < 0, "future")
    count = F.when(age < 0, F.lit(None).cast("bigint"))
    for name, size, below in _STEPS:
        unit = unit.when(age < below, name)
        count = count.when(age < below, F.floor(age / size))
    years = F.floor(F.floor(age / (30 * 86_400)) / 12)
    return F.struct(unit.otherwise("y").alias("unit"), count.otherwise(years).cast("bigint").alias("n"))


def age_text(aged: Column) -> Column:
    """Label of an ``age_unit`` struct."""
    unit = aged["unit"]
    return (
        F.when(unit == "never", "never")
        .when(unit == "future", "in the future")
        .otherwise(F.concat(aged["n"].cast("string"), unit, F.lit(" ago")))
    )


def duration_band(ms: Column) -> Column:
    bad = ms.isNull() | F.isnan(ms.cast("double")) | (ms < 0)
    return (
        F.when(bad, "invalid").when(ms < 1, "sub_ms").when(ms < 1_000, "ms")
        .when(ms < 60_000, "s").otherwise("min")
    )


def duration_text(ms: Column) -> Column:
    """Adaptive duration label, rounded half up in decimal arithmetic."""
    bad = ms.isNull() | F.isnan(ms.cast("double"))
    exact = F.when(~bad, ms).cast("decimal(24,6)")
    whole_ms = F.floor(exact + F.lit("0.5").cast("decimal(2,1)")).cast("bigint")
    hundredths = F.floor((exact + 5) / 10).cast("bigint")
    minutes = F.floor((exact + 30_000) / 60_000).cast("bigint")
    seconds = F.concat(
        F.floor(hundredths / 100).cast("string"), F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("s"),
    )
    band = duration_band(ms)
    return (
        F.when(band == "invalid", MISSING)
        .when(band == "sub_ms", "<1ms")
        .when(band == "ms", F.concat(whole_ms.cast("string"), F.lit("ms")))
        .when(band == "s", seconds)
        .otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    )
