"""Calendar, screening, panel, eligibility and table-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.symbols import base_of, canonical
from ..functions.windows import over, with_grid
from ..operators import panel as P
from ..operators import validate as V
from .inputs import (
    all_quotes, bars, bars_strict, chain, funding, macro_panel, numbered, asset_ret, obs, round_to, settled, table, asset_series,
)
from .registry import cte, query

cte("names", """
SELECT DISTINCT CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE upper(split_part(p_name, ' ', 2))
  || CASE p_partkey % 6 WHEN 1 THEN 'UP' WHEN 2 THEN 'DOWN' WHEN 3 THEN 'BULL' WHEN 4 THEN '3L' ELSE '' END END
  || 'USDT' AS symbol FROM part
UNION SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'DAI' WHEN 1 THEN 'EUR' ELSE 'USDT' END || 'USDT' FROM part""")


def names(spark, sf):
    """Ticker-like symbols built from part names, with direction, leverage and pegged variants."""
    part = table(spark, sf, "part")
    suffixes = F.array(*[F.lit(s) for s in ("", "UP", "DOWN", "BULL", "3L", "")])
    base = F.concat(F.upper(F.split("p_name", " ")[1]), F.get(suffixes, (F.col("p_partkey") % 6).cast("int")))
    base = F.when(F.col("p_partkey") % 13 == 0, F.col("p_name")).otherwise(base)
    pegged = F.get(F.array(F.lit("DAI"), F.lit("EUR"), F.lit("USDT")), (F.col("p_partkey") % 3).cast("int"))
    both = part.select(F.explode(F.array(base, pegged)).alias("base"))
    return both.select(F.concat("base", F.lit("USDT")).alias("symbol")).distinct()


cte("daily", """
SELECT symbol, date, close, high, low, dollar_volume FROM bars""")
cte("weekly_base", """
SELECT symbol, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, arg_max(close, date) AS weekly_close,
       sum(dollar_volume) AS weekly_dollar_volume, count(*) AS n_days
FROM bars GROUP BY 1, 2""")
cte("weekly_ret", """
SELECT *, CASE WHEN gap = 7 THEN weekly_close / lag(weekly_close) OVER (PARTITION BY symbol ORDER BY week_end) - 1 END AS weekly_return,
       coalesce(gap <> 7, false) AS gap_before
FROM (SELECT *, week_end - lag(week_end) OVER (PARTITION BY symbol ORDER BY week_end) AS gap FROM weekly_base)""")
cte("weekly", """
SELECT *, lead(weekly_return) OVER (PARTITION BY symbol ORDER BY week_end) AS forward_return FROM weekly_ret""")
cte("universe", """
SELECT *, CASE WHEN rankable THEN rn - 1 END AS liquidity_rank, coalesce(rankable AND rn - 1 < 10, false) AS eligible
FROM (SELECT *, row_number() OVER (PARTITION BY week_end, rankable ORDER BY trailing_dollar_volume DESC, symbol) AS rn
  FROM (SELECT *, n_weekly_bars >= 8 AS rankable FROM (
    SELECT week_end, symbol, forward_return, weekly_return, weekly_dollar_volume,
           count(*) OVER (PARTITION BY symbol ORDER BY week_end) AS n_weekly_bars,
           avg(weekly_dollar_volume) OVER (PARTITION BY symbol ORDER BY week_end ROWS 3 PRECEDING) AS trailing_dollar_volume
    FROM weekly)))""")


def weekly(spark, sf):
    return P.weekly_panel(bars(spark, sf))


def universe(spark, sf):
    return P.liquid_universe(weekly(spark, sf), top_n=10)


@query("prj01_canonical_key", """
SELECT CASE WHEN contains(s, '-') THEN split_part(s, '-', 1)
            WHEN regexp_matches(s, '^.+(USDT|USDC|BUSD|USD)$') THEN regexp_extract(s, '^(.+?)(USDT|USDC|BUSD|USD)$', 1)
            ELSE s END AS canonical, count(*) AS n
FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || '-USDT-SWAP' WHEN 1 THEN c_mktsegment || 'BUSD'
        WHEN 2 THEN c_mktsegment || 'USD' WHEN 3 THEN c_mktsegment ELSE 'USDT' END AS s FROM customer) GROUP BY 1""")
def prj01(spark, sf):
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 5
    s = (
        F.when(k == 0, F.concat(seg, F.lit("-USDT-SWAP"))).when(k == 1, F.concat(seg, F.lit("BUSD")))
        .when(k == 2, F.concat(seg, F.lit("USD"))).when(k == 3, seg).otherwise("USDT")
    )
    return table(spark, sf, "customer").groupBy(canonical(s).alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@query("prj02_symbol_base", """
SELECT symbol, CASE WHEN ends_with(symbol, 'USDT') AND length(symbol) > 4 THEN left(symbol, length(symbol) - 4)
               ELSE symbol END AS base FROM names""")
def prj02(spark, sf):
    return names(spark, sf).withColumn("base", base_of(F.col("symbol")))


@query("prj03_symbol_screen", """
SELECT symbol, base, CASE
  WHEN NOT regexp_full_match(base, '[A-Z0-9]+') THEN 'non_standard_ticker'
  WHEN base IN ('DAI', 'EUR', 'USDC', 'BUSD') THEN 'stablecoin_or_fiat'
  WHEN (ends_with(base, 'BULL') OR ends_with(base, '3L')) THEN 'leveraged_token'
  WHEN ends_with(base, 'UP') AND left(base, length(base) - 2) IN (SELECT base FROM named) THEN 'leveraged_token'
  WHEN ends_with(base, 'DOWN') AND left(base, length(base) - 4) IN (SELECT base FROM named) THEN 'leveraged_token'
  END AS reason FROM named""".replace("named", "(SELECT symbol, left(symbol, length(symbol) - 4) AS base FROM names)"))
def prj03(spark, sf):
    return P.screen_symbols(names(spark, sf))


@query("prj03_tradeable_symbols", """
SELECT symbol FROM (SELECT symbol, left(symbol, length(symbol) - 4) AS base FROM names)
WHERE regexp_full_match(base, '[A-Z0-9]+') AND base NOT IN ('DAI', 'EUR')
  AND NOT regexp_matches(base, '(BULL|3L)$')
  AND NOT (regexp_matches(base, '.(UP|DOWN)$') AND regexp_replace(base, '(UP|DOWN)$', '') || 'USDT' IN (SELECT symbol FROM names))""")
def prj03_tradeable(spark, sf):
    return P.tradeable_symbols(names(spark, sf))


@query("prj04_epoch_guards", """
SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS from_ms, ts AS from_us FROM events""")
def prj04(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(
        "event_id", cal.ms_to_ts(F.floor(us / 1000)).cast("timestamp_ntz").alias("from_ms"),
        cal.us_to_ts(us).cast("timestamp_ntz").alias("from_us"),
    )


@query("prj05_calendar_labels", """
SELECT *, lead(month) OVER (PARTITION BY asset ORDER BY date) IS DISTINCT FROM month AS month_last_row FROM (
  SELECT asset, date, CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, CAST(date_trunc('month', date) AS DATE) AS month,
         dense_rank() OVER (PARTITION BY asset ORDER BY date_trunc('month', date)) - 1 AS month_no FROM asset_ret)""")
def prj05(spark, sf):
    w = over(["asset"], "date")
    return (
        asset_ret(spark, sf).drop("ret")
        .withColumn("week_end", cal.week_end("date")).withColumn("month", cal.month_start("date"))
        .withColumn("month_no", F.dense_rank().over(over(["asset"], "month")).cast("bigint") - 1)
        .withColumn("month_last_row", ~F.lead("month").over(w).eqNullSafe(F.col("month")))
    )


@query("prj06_annualized_rate", """
SELECT ingest, round(rate * 8760.0 / interval_hours, 11) AS annualized FROM funding""")
def prj06(spark, sf):
    rate = cal.annualize_rate(F.col("rate"), F.col("interval_hours"))
    return funding(spark, sf).select("ingest", F.round(rate, 11).alias("annualized"))


@query("prj07_regime_label", """
SELECT CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-11' THEN 'post_etf' ELSE 'pre_etf' END AS regime, count(*) AS n,
       min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1""")
def prj07(spark, sf):
    day = F.col("ts").cast("date")
    return table(spark, sf, "events").groupBy(cal.regime(day).alias("regime")).agg(
        F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day")
    )


@query("prj08_trim_panel", """
SELECT symbol, date, round(close, 6) AS close FROM bars WHERE symbol IN (SELECT symbol FROM universe WHERE eligible)""")
def prj08(spark, sf):
    out = P.trim_to(bars(spark, sf), P.ever_eligible(universe(spark, sf)))
    return round_to(out.select("symbol", "date", "close"), 6, "close")


# Names and first days of the recency slices used on the derived tables.
SLICES = [{"slice": "from_1998", "start": "1998-01-01"}, {"slice": "from_2001", "start": "2001-01-01"},
          {"slice": "from_late_2001", "start": "2001-10-01"}]


@query("prj09_recency_slices", """
SELECT asset, slice, count(*) AS n, round(avg(ret), 8) AS mean_ret
FROM asset_ret, (VALUES ('from_1998', DATE '1998-01-01'), ('from_2001', DATE '2001-01-01'), ('from_late_2001', DATE '2001-10-01')) s(slice, start)
WHERE date >= start GROUP BY 1, 2 HAVING count(*) >= 126""")
def prj09(spark, sf):
    sliced = with_grid(asset_ret(spark, sf), SLICES).filter(F.col("date") >= F.col("start").cast("date"))
    out = sliced.groupBy("asset", "slice").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ret"), 8).alias("mean_ret"))
    return out.filter("n >= 126")


@query("agg01_daily_panel", """
SELECT symbol, date, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, round(dollar_volume, 2) AS dollar_volume
FROM (SELECT p_brand AS symbol, date, px AS close, px AS high, px AS low, l_extendedprice AS dollar_volume,
        row_number() OVER (PARTITION BY p_brand, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
      FROM ticks) WHERE rn = 1""")
def agg01(spark, sf):
    from .inputs import ticks

    ingest = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    records = ticks(spark, sf).select(
        "date", F.col("p_brand").alias("symbol"), F.col("px").alias("close"), F.col("px").alias("high"),
        F.col("px").alias("low"), F.col("l_extendedprice").alias("dollar_volume"), ingest.alias("ingest"),
    )
    return round_to(round_to(P.daily_panel(records), 6, "close", "high", "low"), 2, "dollar_volume")


_WEEKLY = """SELECT symbol, week_end, round(weekly_close, 6) AS weekly_close, round(weekly_dollar_volume, 2) AS weekly_dollar_volume,
  n_days, round(weekly_return, 8) AS weekly_return, round(forward_return, 8) AS forward_return, gap_before FROM weekly"""


@query("agg02_weekly_panel", _WEEKLY)
def agg02(spark, sf):
    out = round_to(weekly(spark, sf), 8, "weekly_return", "forward_return")
    return round_to(round_to(out, 6, "weekly_close"), 2, "weekly_dollar_volume")


@query("agg03_settled_events", "SELECT symbol, venue, ts, round(rate, 10) AS rate, interval_hours, realized, ingest FROM settled")
def agg03(spark, sf):
    return round_to(settled(spark, sf), 10, "rate")


@query("agg04_price_frame", """
SELECT key, kind, hour, close FROM (SELECT key, kind, date_trunc('hour', ts) AS hour, close,
  row_number() OVER (PARTITION BY key, kind, date_trunc('hour', ts) ORDER BY ingest DESC) AS rn FROM quotes) WHERE rn = 1""")
def agg04(spark, sf):
    prices = all_quotes(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return P.price_frame(prices, ["key", "kind"]).withColumnRenamed("ts", "hour")


@query("agg06_eligible_pairs", "SELECT DISTINCT week_end, symbol FROM universe WHERE eligible")
def agg06(spark, sf):
    return P.eligible_pairs(universe(spark, sf))


@query("agg06_eligible_count", "SELECT week_end, count(*) AS n_eligible FROM universe WHERE eligible GROUP BY 1")
def agg06_count(spark, sf):
    return P.eligible_count(universe(spark, sf))


@query("agg06_ever_eligible", "SELECT DISTINCT symbol FROM universe WHERE eligible")
def agg06_ever(spark, sf):
    return P.ever_eligible(universe(spark, sf))


@query("agg07_presence_report", """
SELECT p.symbol, first_week, last_week, coalesce(n_weeks, 0) AS n_weeks, coalesce(eligible_weeks, 0) AS eligible_weeks,
       n_weeks IS NOT NULL AS present
FROM (SELECT DISTINCT replace(p_brand, 'Brand#2', 'Gone#2') AS symbol FROM part UNION SELECT DISTINCT p_brand FROM part) p
LEFT JOIN (SELECT symbol, min(week_end) AS first_week, max(week_end) AS last_week, count(*) AS n_weeks FROM weekly GROUP BY 1) w USING (symbol)
LEFT JOIN (SELECT symbol, count(*) FILTER (eligible) AS eligible_weeks FROM universe GROUP BY 1) u USING (symbol)""")
def agg07(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("symbol"))
    probes = brands.union(brands.select(F.replace(F.col("symbol"), F.lit("Brand#2"), F.lit("Gone#2"))))
    return P.presence_report(weekly(spark, sf), universe(spark, sf), probes)


@query("agg07_universe_counts", """
SELECT 'enumerated' AS measure, count(*) AS n FROM names UNION ALL
SELECT 'excluded', count(*) FROM names WHERE symbol NOT IN (
  SELECT symbol FROM (SELECT symbol, left(symbol, length(symbol) - 4) AS base FROM names)
  WHERE regexp_full_match(base, '[A-Z0-9]+') AND base NOT IN ('DAI', 'EUR') AND NOT regexp_matches(base, '(BULL|3L)$')
    AND NOT (regexp_matches(base, '.(UP|DOWN)$') AND regexp_replace(base, '(UP|DOWN)$', '') || 'USDT' IN (SELECT symbol FROM names)))
UNION ALL SELECT 'ever_eligible', count(DISTINCT symbol) FROM universe WHERE eligible""")
def agg07_counts(spark, sf):
    return P.universe_counts(P.screen_symbols(names(spark, sf)), universe(spark, sf))


@query("win09_liquid_universe", """
SELECT week_end, symbol, n_weekly_bars, round(trailing_dollar_volume, 4) AS trailing_dollar_volume, rankable, liquidity_rank,
       eligible, round(forward_return, 8) AS forward_return FROM universe""")
def win09(spark, sf):
    out = universe(spark, sf).select(
        "week_end", "symbol", "n_weekly_bars", "trailing_dollar_volume", "rankable", "liquidity_rank", "eligible",
        "forward_return",
    )
    return round_to(round_to(out, 8, "forward_return"), 4, "trailing_dollar_volume")


@query("val01_bar_rules", """
SELECT rule, count(*) AS n FROM (
  SELECT CASE WHEN low <= 0 THEN 'non_positive_low' WHEN close <= 0 THEN 'non_positive_close' WHEN volume < 0 THEN 'negative_volume'
              WHEN high < low OR close NOT BETWEEN low AND high THEN 'inconsistent_bar' END AS rule
  FROM (SELECT l_extendedprice AS close, l_quantity * 1000 AS high, l_quantity * 900 - 5000 AS low, (0.09::DOUBLE - l_discount) AS volume FROM lineitem))
WHERE rule IS NOT NULL GROUP BY 1""")
def val01(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("close"), (F.col("l_quantity") * 1000).alias("high"),
        (F.col("l_quantity") * 900 - 5000).alias("low"), (0.09 - F.col("l_discount")).alias("dollar_volume"),
    )
    return V.ohlc_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("val01_index_bar_rules", """
SELECT rule, count(*) AS n FROM (
  SELECT CASE WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price' WHEN greatest(open, low, close) > high THEN 'above_high'
              WHEN least(open, close) < low THEN 'below_low' END AS rule
  FROM (SELECT o_totalprice AS open, o_totalprice * 1.2 + (o_custkey % 7) * -20000 AS high, o_totalprice * 0.9 AS low,
               o_totalprice + (o_custkey % 3 - 1) * 25000 AS close FROM orders)) WHERE rule IS NOT NULL GROUP BY 1""")
def val01_index(spark, sf):
    p, k = F.col("o_totalprice"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        p.alias("open"), (p * 1.2 + (k % 7) * -20000).alias("high"), (p * 0.9).alias("low"),
        (p + (k % 3 - 1) * 25000).alias("close"),
    )
    return V.index_bar_violations(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("val02_settled_conflicts", """
SELECT symbol, ts, round(min(rate), 10) AS min_rate, round(max(rate), 10) AS max_rate, count(*) AS n_rows
FROM funding WHERE realized GROUP BY 1, 2 HAVING min(rate) <> max(rate)""")
def val02(spark, sf):
    return round_to(V.settled_conflicts(funding(spark, sf)), 10, "min_rate", "max_rate")


cte("interval_gaps", """
SELECT symbol, interval_hours, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 3.6e9 AS gap FROM settled""")
cte("interval_report", """
SELECT symbol, CAST(stamped AS DOUBLE) AS stamped_hours, median(gap) AS median_gap_hours, count(*) AS n_events,
       coalesce(avg(CASE WHEN gap IS NOT NULL THEN CAST(abs(gap - stamped) > 0.25 * stamped AS INTEGER) END), 0) AS mismatch_fraction
FROM interval_gaps JOIN (SELECT symbol, arg_max(interval_hours, row(n, -interval_hours)) AS stamped FROM (
  SELECT symbol, interval_hours, count(*) AS n FROM settled GROUP BY 1, 2) GROUP BY 1) USING (symbol) GROUP BY 1, 2""")


@query("val03_interval_mislabels", """
SELECT symbol, stamped_hours, round(median_gap_hours, 6) AS median_gap_hours, n_events, round(mismatch_fraction, 6) AS mismatch_fraction,
       round(median_gap_hours / stamped_hours, 6) AS gap_ratio
FROM interval_report WHERE n_events >= 3 AND median_gap_hours / stamped_hours NOT BETWEEN 0.5 AND 2.0""")
def val03(spark, sf):
    out = V.interval_mislabels(V.interval_diagnostics(settled(spark, sf)))
    return round_to(out, 6, "median_gap_hours", "mismatch_fraction", "gap_ratio")


@query("val04_interval_diagnostics", """
SELECT symbol, stamped_hours, round(median_gap_hours, 6) AS median_gap_hours, n_events, round(mismatch_fraction, 6) AS mismatch_fraction FROM interval_report""")
def val04(spark, sf):
    return round_to(V.interval_diagnostics(settled(spark, sf)), 6, "median_gap_hours", "mismatch_fraction")


@query("val05_calendar_gaps", """
SELECT symbol, date, gap_days FROM (SELECT symbol, date, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap_days FROM bars_strict)
WHERE gap_days <> 1""")
def val05(spark, sf):
    return V.calendar_gaps(bars_strict(spark, sf)).select("symbol", "date", F.col("gap_days").cast("bigint").alias("gap_days"))


@query("val06_panel_report", """
SELECT 'too_few_rows' AS rule, greatest(756 - count(*), 0) AS n FROM macro_panel UNION ALL
SELECT 'repeated_key', count(*) FROM (SELECT date FROM macro_panel GROUP BY 1 HAVING count(*) > 1) UNION ALL
SELECT 'missing_value', count(*) FROM macro_panel WHERE equity_ret IS NULL OR cash_ret IS NULL OR bond_yield IS NULL UNION ALL
SELECT 'non_positive', count(*) FROM macro_panel WHERE bond_yield <= 0""")
def val06(spark, sf):
    return V.panel_report(macro_panel(spark, sf), "date", ["bond_yield"], 756)


@query("val06_repeated_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def val06_keys(spark, sf):
    return V.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("val07_option_rules", """
SELECT rule, count(*) AS n FROM (SELECT CASE
   WHEN NOT starts_with(instrument, 'I1') THEN 'foreign_symbol' WHEN type NOT IN ('call', 'put') THEN 'unknown_type'
   WHEN strike - 900 <= 0 THEN 'non_positive_strike' WHEN (strike - 900) / underlying NOT BETWEEN 0.01 AND 100 THEN 'absurd_moneyness' END AS rule FROM chain)
WHERE rule IS NOT NULL GROUP BY 1""")
def val07(spark, sf):
    rows = chain(spark, sf).withColumn("strike", F.col("strike") - 900)
    return V.option_violations(rows, "I1").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("val08_label_contract", """
SELECT series_id, count(*) AS n, count(*) FILTER (dt < prev) AS n_unsorted, count(*) FILTER (horizon IS NULL) AS n_null,
       count(*) FILTER (horizon < dt) AS n_backward, true AS same_type
FROM (SELECT series_id, dt, lag(dt) OVER w AS prev, lead(dt, 21) OVER w AS horizon FROM asset_series WINDOW w AS (PARTITION BY series_id ORDER BY idx)) GROUP BY 1""")
def val08(spark, sf):
    labels = asset_series(spark, sf).withColumn("horizon", F.lead("dt", 21).over(over(["series_id"], "idx")))
    return V.label_contract(labels)


@query("val09_trim_lossless", """
SELECT 'left' AS side, week_end, symbol FROM universe WHERE eligible AND liquidity_rank >= 5""")
def val09(spark, sf):
    """What a too small trim ceiling would lose; the same check is empty at the right ceiling (tests)."""
    flagged = universe(spark, sf)
    return V.symmetric_difference(P.eligible_pairs(flagged), P.eligible_pairs(flagged.filter("liquidity_rank < 5")))


@query("val10_entry_range_gaps", """
SELECT symbol, idx FROM (
  SELECT symbol, idx, lead(idx, 5) OVER w AS ex, spot IS NULL OR lead(spot, 5) OVER w IS NULL
    OR count(rate) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) < 5 AS missing
  FROM (SELECT symbol, idx, CASE WHEN idx % 50 <> 49 THEN spot_close END AS spot, CASE WHEN idx % 70 <> 69 THEN funding_rate END AS rate FROM obs)
  WINDOW w AS (PARTITION BY symbol ORDER BY idx)) WHERE ex IS NOT NULL AND missing""")
def val10(spark, sf):
    holes = obs(spark, sf).withColumn("spot_close", F.when(F.col("idx") % 50 != 49, F.col("spot_close"))).withColumn(
        "funding_rate", F.when(F.col("idx") % 70 != 69, F.col("funding_rate"))
    )
    return V.entry_range_gaps(holes, 5)
