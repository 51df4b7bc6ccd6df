"""Daily and weekly panels, point-in-time liquidity universe, symbol screening.

A panel has one row per (symbol, date). It is built from raw rows by aggregation with map-side
combine, so one busy symbol is spread over all mappers; every later per-symbol window then sees at
most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.calendar import week_end
from ..functions.symbols import (
    DIRECTION_SUFFIXES, LEVERAGED_SUFFIXES, STABLE_OR_FIAT, base_of, canonical,
)
from ..functions.windows import any_of, over, running, trailing


_FIXED = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one greatest in `order`: an aggregation, so hot keys combine map-side.

    Where the order and all other columns are of fixed width, each column is picked by itself in a hash table, and raw
    rows are not sorted before they combine; the picks see the same rows in the same order, so they agree on the row.
    """
    rest = [c for c in df.columns if c not in keys]
    if all(isinstance(f.dataType, _FIXED) for f in df.select(*rest, order.alias("_order")).schema):
        return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*keys, *rest)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def daily_panel(records: DataFrame, ingest: str = "ingest") -> DataFrame:
    """Deduplicated daily bars; of several rows for a (date, symbol) the last ingested one stays."""
    numeric = ("close", "high", "low", "dollar_volume")
    typed = records.select(
        F.col("date").cast("date").alias("date"), "symbol",
        *[F.col(c).cast("double").alias(c) for c in numeric], ingest,
    )
    return keep_latest(typed, ["date", "symbol"], F.col(ingest)).drop(ingest)


def settled_events(events: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One event per instrument and instant: a settled row beats an estimate, then the earliest ingest."""
    order = F.struct(F.col("realized").cast("int"), -F.col("ingest"))
    return keep_latest(events, [*keys, "ts"], order)


def price_frame(prices: DataFrame, keys: Sequence[str] = ("symbol",), ingest: str = "ingest") -> DataFrame:
    """Price closes with one row per close stamp, the last ingested."""
    return keep_latest(prices, [*keys, "ts"], F.col(ingest)).drop(ingest)


def weekly_panel(daily: DataFrame, with_canonical: bool = False) -> DataFrame:
    """Weeks ending on Sunday: last close, summed volume, day count and gap-aware returns.

    A return that would span a missing week is NULL; `forward_return` is the next week's return.
    """
    w = over(["symbol"], "week_end")
    gap = F.datediff("week_end", F.lag("week_end").over(w))
    weekly = (
        daily.groupBy("symbol", week_end("date").alias("week_end"))
        .agg(
            F.max_by("close", "date").alias("weekly_close"),
            F.sum("dollar_volume").alias("weekly_dollar_volume"),
            F.count(F.lit(1)).alias("n_days"),
        )
        .withColumn("_gap", gap)
        .withColumn(
            "weekly_return",
            F.when(F.col("_gap") == 7, F.col("weekly_close") / F.lag("weekly_close").over(w) - 1.0),
        )
        .withColumn("forward_return", F.lead("weekly_return").over(w))
        .withColumn("gap_before", F.coalesce(F.col("_gap") != 7, F.lit(False)))
        .drop("_gap")
    )
    return weekly.withColumn("canonical", canonical(F.col("symbol"))) if with_canonical else weekly


def liquid_universe(
    weekly: DataFrame, top_n: int = 100, lookback_weeks: int = 4, min_history_weeks: int = 8
) -> DataFrame:
    """Flag each week's most traded symbols using only data up to that week."""
    if min(top_n, lookback_weeks, min_history_weeks) < 1:
        raise ValueError("top_n, lookback_weeks and min_history_weeks must be positive")
    ranked = Window.partitionBy("week_end", "rankable").orderBy(
        F.desc("trailing_dollar_volume"), F.asc("symbol")
    )
    return (
        weekly.withColumn("n_weekly_bars", F.count("week_end").over(running(["symbol"], "week_end")))
        .withColumn(
            "trailing_dollar_volume",
            F.avg("weekly_dollar_volume").over(trailing(["symbol"], "week_end", lookback_weeks)),
        )
        .withColumn("rankable", F.col("n_weekly_bars") >= min_history_weeks)
        .withColumn(
            "liquidity_rank",
            F.when(F.col("rankable"), F.row_number().over(ranked).cast("bigint") - 1),
        )
        .withColumn("eligible", F.coalesce(F.col("liquidity_rank") < top_n, F.lit(False)))
    )


def eligible_pairs(flagged: DataFrame) -> DataFrame:
    return flagged.filter("eligible").select("week_end", "symbol").distinct()


def ever_eligible(flagged: DataFrame) -> DataFrame:
    return flagged.filter("eligible").select("symbol").distinct()


def eligible_count(flagged: DataFrame) -> DataFrame:
    return flagged.filter("eligible").groupBy("week_end").agg(F.count(F.lit(1)).alias("n_eligible"))


def trim_to(daily: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of the panel whose symbol is in the given set."""
    return daily.join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def presence_report(weekly: DataFrame, flagged: DataFrame, probes: DataFrame) -> DataFrame:
    """First and last week, week count and eligibility of every probed symbol, present or not."""
    seen = weekly.groupBy("symbol").agg(
        F.min("week_end").alias("first_week"), F.max("week_end").alias("last_week"),
        F.count(F.lit(1)).alias("n_weeks"),
    )
    weeks = flagged.groupBy("symbol").agg(F.count_if("eligible").alias("eligible_weeks"))
    return (
        probes.select("symbol").distinct()
        .join(seen, "symbol", "left").join(weeks, "symbol", "left")
        .select(
            "symbol", "first_week", "last_week", F.coalesce("n_weeks", F.lit(0)).alias("n_weeks"),
            F.coalesce("eligible_weeks", F.lit(0)).alias("eligible_weeks"),
            F.col("n_weeks").isNotNull().alias("present"),
        )
    )


def screen_symbols(symbols: DataFrame, quote: str = "USDT") -> DataFrame:
    """Every distinct symbol with its base and the first matching exclusion reason (NULL = tradeable).

    A base ending in a direction suffix counts as leveraged only if the rest is itself listed.
    """
    bases = symbols.select("symbol").distinct().withColumn("base", base_of(F.col("symbol"), quote))
    stem = F.regexp_extract("base", f"^(.+)({'|'.join(DIRECTION_SUFFIXES)})$", 1)
    listed = bases.select(F.col("base").alias("stem")).distinct().withColumn("stem_listed", F.lit(True))
    fixed_suffix = any_of([
        F.col("base").endswith(s) & (F.col("base") != s) for s in LEVERAGED_SUFFIXES
    ])
    reason = (
        F.when(~F.col("base").rlike("^[A-Z0-9]+$"), "non_standard_ticker")
        .when(F.col("base").isin(*STABLE_OR_FIAT), "stablecoin_or_fiat")
        .when(fixed_suffix | F.coalesce("stem_listed", F.lit(False)), "leveraged_token")
    )
    return (
        bases.withColumn("stem", stem).join(listed, "stem", "left")
        .select("symbol", "base", reason.alias("reason"))
    )


def tradeable_symbols(symbols: DataFrame, quote: str = "USDT") -> DataFrame:
    return screen_symbols(symbols, quote).filter("reason IS NULL").select("symbol")


def universe_counts(screened: DataFrame, flagged: DataFrame) -> DataFrame:
    """Totals of enumerated, excluded and ever eligible symbols, one row per measure."""
    total = screened.agg(
        F.count(F.lit(1)).alias("enumerated"), F.count("reason").alias("excluded")
    ).unpivot([], ["enumerated", "excluded"], "measure", "n")
    ever = ever_eligible(flagged).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("ever_eligible").alias("measure"), "n"
    )
    return total.unionByName(ever)
