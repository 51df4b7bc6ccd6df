"""Calendar and epoch expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Plausible epoch ranges and annualisation bases.
MS_RANGE = (10**12, 10**14)
US_RANGE = (10**15, 10**17)
HOURS_PER_YEAR = 8760.0
CRYPTO_DAYS = 365.0
EQUITY_DAYS = 252.0
REGIME_DATE = "2024-01-11"


def week_end(d: Column | str) -> Column:
    """The Sunday that closes the ISO week of a date."""
    return F.date_sub(F.next_day(d, "MON"), 1)


def month_start(d: Column | str) -> Column:
    return F.trunc(d, "month")


def _guarded(value: Column, bounds: tuple[int, int], convert, unit: str) -> Column:
    value = value.cast("bigint")
    ok = (value >= bounds[0]) & (value < bounds[1])
    message = F.concat(F.lit(f"not an epoch in {unit}: "), value.cast("string"))
    return F.when(value.isNull(), F.lit(None)).when(ok, convert(value)).otherwise(F.raise_error(message))


def ms_to_ts(value: Column) -> Column:
    """Epoch milliseconds to a timestamp; anything outside the millisecond range raises."""
    return _guarded(value, MS_RANGE, F.timestamp_millis, "milliseconds")


def us_to_ts(value: Column) -> Column:
    """Epoch microseconds to a timestamp; anything outside the microsecond range raises."""
    return _guarded(value, US_RANGE, F.timestamp_micros, "microseconds")


def mixed_epoch_ms(value: Column) -> Column:
    """Milliseconds from a column whose history mixes millisecond and microsecond stamps."""
    v = value.cast("bigint")
    return (
        F.when(v.between(MS_RANGE[0], MS_RANGE[1] - 1), v)
        .when(v.between(US_RANGE[0], US_RANGE[1] - 1), F.expr("0L") + F.floor(v / 1000))
        .when(v.isNull(), F.lit(None).cast("bigint"))
        .otherwise(F.raise_error(F.concat(F.lit("not an epoch: "), v.cast("string"))))
    )


def regime(d: Column, boundary: str = REGIME_DATE) -> Column:
    """`post_etf` from the boundary day on, `pre_etf` before it."""
    return F.when(d >= F.lit(boundary).cast("date"), "post_etf").otherwise("pre_etf")


def annualize_rate(rate: Column, interval_hours: Column) -> Column:
    """A per-event rate on a yearly basis through its own settlement interval."""
    return F.when(interval_hours > 0, rate * HOURS_PER_YEAR / interval_hours).otherwise(
        F.raise_error(F.lit("settlement interval must be positive"))
    )
