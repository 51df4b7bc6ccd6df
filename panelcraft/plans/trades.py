"""Carry, option and variance-premium queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import with_grid
from ..operators import carry as C
from ..operators import costs
from ..operators import options as O
from ..operators import scoring as S
from ..operators import variance as VP
from .inputs import bars_strict, chain, index_level, numbered, obs, round_to, table
from .registry import cte, query
from .sqltext import score_ctes
from .stage import stage

HORIZONS = (1, 3, 9, 21, 63, 189)
AS_OF = ("2024-01-06 00:00:00", "2024-01-14 00:00:00", "2024-01-22 00:00:00", "2024-01-30 00:00:00")

# ---- carry ----------------------------------------------------------------------------------------

cte("venues", """
SELECT *, (spot_t + 2.0 + perp_t + 1.5) / 1e4 AS taker, (spot_m + 2.0 + perp_m + 1.5) / 1e4 AS maker FROM (VALUES
 ('kraken', true, 26.0, 16.0, 5.0, 2.0), ('hyperliquid', true, 26.0, 16.0, 4.5, 1.5),
 ('binance_reference', false, 10.0, 10.0, 5.0, 2.0), ('okx_reference', false, 10.0, 8.0, 5.0, 2.0)) v(venue, tradeable, spot_t, spot_m, perp_t, perp_m)""")
cte("obs_prefix", "SELECT *, sum(funding_rate) OVER (PARTITION BY symbol ORDER BY idx) AS cum FROM obs")
cte("carry_gross", f"""
SELECT a.symbol, h AS horizon, a.idx AS entry_idx, b.idx AS exit_idx, a.dt AS entry_dt, b.dt AS exit_dt, b.cum - a.cum AS funding_collected,
       (b.spot_close - a.spot_close) / a.spot_close AS spot_leg_pnl, -(b.perp_close - a.perp_close) / a.perp_close AS perp_leg_pnl,
       (epoch_us(b.dt) - epoch_us(a.dt)) / 3.6e9 AS hold_hours
FROM obs_prefix a, (VALUES {', '.join(f'({h})' for h in HORIZONS)}) v(h) JOIN obs_prefix b ON b.symbol = a.symbol AND b.idx = a.idx + h""")
cte("carry_net", """
SELECT *, gross - round_trip_cost - financing_cost AS net FROM (
  SELECT c.*, venue, tradeable, m AS capital_multiple, taker AS entry_cost, taker AS exit_cost, 2 * taker AS round_trip_cost,
         spot_leg_pnl + perp_leg_pnl AS price_pnl, funding_collected + spot_leg_pnl + perp_leg_pnl AS gross,
         0.04 * m * hold_hours / 8760.0 AS financing_cost
  FROM carry_gross c, venues, (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) k(m))""")


def priced(spark, sf):
    return C.with_costs(C.trades(obs(spark, sf), HORIZONS))


@query("pnl01_venue_costs", """
SELECT symbol, venue, tradeable, style, round(n * CASE style WHEN 'taker' THEN 2 * taker WHEN 'maker' THEN 2 * maker ELSE maker + taker END, 6) AS total_cost
FROM (SELECT symbol, count(*) AS n FROM obs GROUP BY 1), venues, (VALUES ('taker'), ('maker'), ('maker_taker')) s(style)""")
def pnl01(spark, sf):
    """Round-trip cost of one trade per observation, by venue and execution style."""
    styles = {"taker": (True, True), "maker": (False, False), "maker_taker": (False, True)}
    grid = [{"style": s, **row} for s, (i, o) in styles.items() for row in costs.venue_rows(i, o)]
    per = obs(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return with_grid(per, grid).select(
        "symbol", "venue", "tradeable", "style", F.round(F.col("n") * F.col("round_trip_cost"), 6).alias("total_cost")
    )


@query("pnl02_financing_cost", """
SELECT symbol, horizon, entry_idx, m AS capital_multiple, round(0.04 * m * hold_hours / 8760.0, 9) AS financing_cost
FROM carry_gross, (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) k(m)""")
def pnl02(spark, sf):
    rows = with_grid(C.trades(obs(spark, sf), HORIZONS), [{"capital_multiple": m} for m in costs.CAPITAL_MULTIPLES])
    cost = costs.financing_cost(F.col("hold_hours"), F.col("capital_multiple"))
    return rows.select("symbol", "horizon", "entry_idx", "capital_multiple", F.round(cost, 9).alias("financing_cost"))


_TRADE = ("funding_collected", "spot_leg_pnl", "perp_leg_pnl", "price_pnl", "round_trip_cost", "financing_cost", "gross", "net")


@query("pnl03_carry_trades", f"""
SELECT symbol, venue, horizon, entry_idx, exit_idx, entry_dt, exit_dt, hold_hours, capital_multiple, round(funding_collected, 12) AS funding_collected, {', '.join(f'round({c}, 9) AS {c}' for c in _TRADE[1:])} FROM carry_net""")
def pnl03(spark, sf):
    out = priced(spark, sf).select(
        "symbol", "venue", "horizon", "entry_idx", "exit_idx", "entry_dt", "exit_dt", "hold_hours", "capital_multiple", *_TRADE
    )
    return round_to(round_to(out, 9, *_TRADE[1:]), 12, "funding_collected")


cte("carry_steps", """
SELECT t.symbol, venue, capital_multiple, t.horizon, o.idx - 1 AS idx, funding_rate - financing_cost / t.horizon
         - CASE WHEN o.idx = entry_idx + 1 THEN entry_cost ELSE 0 END + CASE WHEN o.idx = exit_idx THEN price_pnl - exit_cost ELSE 0 END AS lumpy,
       funding_rate - (financing_cost + round_trip_cost) / t.horizon + CASE WHEN o.idx = exit_idx THEN price_pnl ELSE 0 END AS amortised
FROM carry_net t JOIN obs o ON o.symbol = t.symbol AND o.idx BETWEEN entry_idx + 1 AND exit_idx WHERE entry_idx % t.horizon = 0""")


@query("pnl04_interval_series", "SELECT symbol, venue, capital_multiple, horizon, idx, round(lumpy, 9) AS lumpy, round(amortised, 9) AS amortised FROM carry_steps")
def pnl04(spark, sf):
    o, p = obs(spark, sf), priced(spark, sf)
    lumpy = C.interval_series(o, p, HORIZONS, False).withColumnRenamed("ret", "lumpy")
    even = C.interval_series(o, p, HORIZONS, True).withColumnRenamed("ret", "amortised")
    return round_to(lumpy.join(even, [*C.CELL, "idx"]), 9, "lumpy", "amortised")


@query("top04_entry_schedules", """
SELECT symbol, horizon, entry_idx % horizon AS phase, count(*) AS n_entries, min(entry_idx) AS first_entry, max(entry_idx) AS last_entry
FROM carry_gross GROUP BY 1, 2, 3""")
def top04(spark, sf):
    rows = C.strided(C.trades(obs(spark, sf), HORIZONS))
    return rows.groupBy("symbol", "horizon", "phase").agg(
        F.count(F.lit(1)).alias("n_entries"), F.min("entry_idx").alias("first_entry"), F.max("entry_idx").alias("last_entry")
    )


@query("top04_random_entries", """
SELECT symbol, horizon, entry_idx FROM (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY u, entry_idx) AS rn FROM (
  SELECT symbol, horizon, entry_idx, cast(concat('0x', substr(md5(concat('11|', symbol, '|', horizon, '|', entry_idx)), 1, 8)) AS BIGINT) AS u FROM carry_gross)) WHERE rn <= 25""")
def top04_random(spark, sf):
    """Long horizons of short series have fewer than 25 entries; then all are taken, and `top04_short_schedules` lists them."""
    return C.random_entries(C.trades(obs(spark, sf), HORIZONS), 25, 11, strict=False).select("symbol", "horizon", "entry_idx")


@query("top04_short_schedules", "SELECT symbol, horizon, count(*) AS n_entries, 25 - count(*) AS n_missing FROM carry_gross GROUP BY 1, 2 HAVING count(*) < 25")
def top04_short(spark, sf):
    """Long horizons of short series, which a strict schedule refuses."""
    return C.short_schedules(C.trades(obs(spark, sf), HORIZONS), 25)


_GATE = ("median_funding", "median_financing", "round_trip_cost", "realized_cost", "headroom", "funding_annualized", "financing_annualized")
cte("early_gate", """
SELECT *, mf - rt - mfin AS headroom, CASE WHEN mh > 0 THEN 8760.0 / mh ELSE 0 END AS ann FROM (
  SELECT symbol, venue, capital_multiple, horizon, tradeable, count(*) AS n_trades, median(funding_collected) AS mf, median(financing_cost) AS mfin,
         median(hold_hours) AS mh, max(round_trip_cost) AS rt FROM carry_net GROUP BY ALL)""")


@query("agg16_early_gate", """
SELECT symbol, venue, capital_multiple, horizon, tradeable, n_trades, round(mh, 6) AS median_hold, round(mf, 11) AS median_funding, round(mfin, 9) AS median_financing,
       round(rt, 9) AS round_trip_cost, round(rt + mfin, 9) AS realized_cost, round(headroom, 9) AS headroom,
       round(mf * ann, 7) AS funding_annualized, round(mfin * ann, 7) AS financing_annualized FROM early_gate""")
def agg16(spark, sf):
    out = round_to(C.early_gate(priced(spark, sf)), 9, "median_financing", "round_trip_cost", "realized_cost", "headroom")
    out = round_to(round_to(out, 11, "median_funding"), 6, "median_hold")
    return round_to(out, 7, "funding_annualized", "financing_annualized")


@query("agg17_price_contamination", """
SELECT *, round(abs(mp) / nullif(abs(mf), 0), 7) AS contamination_ratio, coalesce(abs(mp) / nullif(abs(mf), 0) >= 0.25, true) AS contaminated FROM (
  SELECT symbol, horizon, avg(funding_collected) AS mf, median(funding_collected) AS md, avg(price_pnl) AS mp, median(abs(price_pnl)) AS mda,
         list_sort(list(abs(price_pnl)))[1 + floor(0.95::DOUBLE * (count(*) - 1) + 0.5)::BIGINT] AS p95 FROM (SELECT *, spot_leg_pnl + perp_leg_pnl AS price_pnl FROM carry_gross) GROUP BY 1, 2)
""".replace("SELECT *, round(abs", "SELECT symbol, horizon, round(mf, 9) AS mean_funding, round(md, 11) AS median_funding, round(mp, 9) AS mean_price_pnl, round(mda, 9) AS median_abs_price_pnl, round(p95, 9) AS p95_abs_price_pnl, round(abs"))
def agg17(spark, sf):
    out = C.price_contamination(C.trades(obs(spark, sf), HORIZONS))
    out = round_to(out, 9, "mean_funding", "mean_price_pnl", "median_abs_price_pnl", "p95_abs_price_pnl")
    return round_to(round_to(out, 11, "median_funding"), 7, "contamination_ratio")


@query("agg14_sign_regime", """
SELECT symbol, n_positive, n_negative, n_zero, round(mp, 9) AS mean_positive, round(mn, 9) AS mean_negative, round(nf, 9) AS negative_fraction, round(dd, 12) AS max_drawdown FROM (
  SELECT symbol, count(*) FILTER (funding_rate > 0) AS n_positive, count(*) FILTER (funding_rate < 0) AS n_negative, count(*) FILTER (funding_rate = 0) AS n_zero,
         coalesce(avg(funding_rate) FILTER (funding_rate > 0), 0) AS mp, coalesce(avg(funding_rate) FILTER (funding_rate < 0), 0) AS mn,
         count(*) FILTER (funding_rate < 0) / count(*) AS nf, max(peak - cum) AS dd
  FROM (SELECT *, greatest(0, max(cum) OVER (PARTITION BY symbol ORDER BY idx)) AS peak FROM obs_prefix) GROUP BY 1)""")
def agg14(spark, sf):
    out = round_to(C.sign_regime(obs(spark, sf)), 9, "mean_positive", "mean_negative", "negative_fraction")
    return round_to(out, 12, "max_drawdown")


@query("agg15_after_tax", """
SELECT symbol, venue, capital_multiple, horizon, round(sum(y), 8) AS pre_tax, round(sum(CASE WHEN y > 0 THEN y * 0.65 ELSE y END), 8) AS after_tax,
       count(*) AS n_years, round(sum(y) - sum(CASE WHEN y > 0 THEN y * 0.65 ELSE y END), 8) AS tax_drag
FROM (SELECT symbol, venue, capital_multiple, horizon, year(entry_dt) AS yr, sum(net) AS y FROM carry_net GROUP BY ALL) GROUP BY ALL""".replace("GROUP BY ALL) GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4"))
def agg15(spark, sf):
    return round_to(C.after_tax(priced(spark, sf), 0.35), 8, "pre_tax", "after_tax", "tax_drag")


cte("cell_series", """
SELECT concat_ws('|', symbol, venue, capital_multiple::INTEGER, horizon, entry_idx % horizon) AS series_id, entry_idx // horizon AS idx, net AS ret FROM carry_net
UNION ALL SELECT concat_ws('|', symbol, venue, capital_multiple::INTEGER, horizon, 'lumpy'), idx, lumpy FROM carry_steps
UNION ALL SELECT concat_ws('|', symbol, venue, capital_multiple::INTEGER, horizon, 'amortised'), idx, amortised FROM carry_steps""")
score_ctes("cell", "cell_series")
cte("cell_split", """
SELECT *, split_part(series_id, '|', 1) AS symbol, split_part(series_id, '|', 2) AS venue, split_part(series_id, '|', 3)::DOUBLE AS capital_multiple,
       split_part(series_id, '|', 4)::INTEGER AS horizon, split_part(series_id, '|', 5) AS kind FROM cell_score""")
cte("headlines", """
SELECT *, CASE WHEN median IS NOT NULL AND lumpy IS NOT NULL THEN least(median, lumpy) END AS kill FROM (
  SELECT symbol, venue, capital_multiple, horizon, median(psr0) FILTER (n >= 2 AND kind NOT IN ('lumpy', 'amortised')) AS median,
         min(psr0) FILTER (n >= 2 AND kind NOT IN ('lumpy', 'amortised')) AS min, max(psr0) FILTER (n >= 2 AND kind NOT IN ('lumpy', 'amortised')) AS max,
         max(psr0) FILTER (kind = 'lumpy') AS lumpy, max(psr0) FILTER (kind = 'amortised') AS amortised, max(n) FILTER (kind = '0') AS n_trades,
         max(effective_t) FILTER (kind = '0') AS effective_t FROM cell_split GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"))
_HEAD = ("median", "min", "max", "lumpy", "amortised", "kill")


@query("scr12_headline_score", f"""
SELECT symbol, venue, capital_multiple, horizon, n_trades, effective_t, {', '.join(f'round({c}, 5) AS {c}' for c in _HEAD)}, coalesce(kill >= 0.95, false) AS passes FROM headlines""")
def scr12(spark, sf):
    o = stage(obs(spark, sf), "observations")
    out = C.headline(stage(C.headline_series(o, C.with_financing(C.trades(o, HORIZONS)), HORIZONS), "series"))
    return round_to(out.select(*C.CELL, "n_trades", "effective_t", *_HEAD, "passes"), 5, *_HEAD)


@query("scr13_cost_surface", """
SELECT h.symbol, bool_and(NOT coalesce(kill >= 0.95 AND e.tradeable AND h.capital_multiple = 2, false)) AS killed, count(*) AS n_cells,
       round(max(headroom), 9) AS best_headroom, round(max(kill), 5) AS best_kill
FROM headlines h JOIN early_gate e ON e.symbol = h.symbol AND e.venue = h.venue AND e.capital_multiple = h.capital_multiple AND e.horizon = h.horizon
JOIN (SELECT symbol, count(*) AS n FROM obs GROUP BY 1) s ON s.symbol = h.symbol AND n > 2 * h.horizon GROUP BY 1""")
def scr13(spark, sf):
    o = stage(obs(spark, sf), "observations")
    gate = C.with_financing(C.long_enough(o, C.trades(o, HORIZONS)))
    surface = stage(C.cost_surface(gate, stage(C.headline_series(o, gate, HORIZONS), "series")), "surface")
    best = surface.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_cells"), F.round(F.max("headroom"), 9).alias("best_headroom"), F.round(F.max("kill"), 5).alias("best_kill")
    )
    return C.killed(surface).join(best, "symbol")


# ---- options --------------------------------------------------------------------------------------

cte("as_ofs", "SELECT unnest([" + ", ".join(f"TIMESTAMP '{t}'" for t in AS_OF) + "]) AS as_of")
cte("snaps", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY as_of, instrument ORDER BY ts DESC, ingest DESC) AS rn
  FROM chain, as_ofs WHERE ts <= as_of AND CAST(expiry AS TIMESTAMP) > as_of) WHERE rn = 1""")


def snaps(spark, sf):
    return O.chain_snapshots(chain(spark, sf), AS_OF)


@query("str01_chain_snapshot", "SELECT as_of, instrument, ts, type, strike, expiry, round(bid, 9) AS bid, round(mark, 9) AS mark, round(delta, 9) AS delta FROM snaps")
def str01(spark, sf):
    out = snaps(spark, sf).select("as_of", "instrument", "ts", "type", "strike", "expiry", "bid", "mark", "delta")
    return round_to(out, 9, "bid", "mark", "delta")


@query("str01_snapshot_checks", """
SELECT as_of, count(*) AS n_instruments, round(median(underlying), 6) AS median_underlying, (SELECT max(ts) FROM chain) >= as_of AS reached,
       count(*) >= 20 AS enough, median(underlying) BETWEEN min(strike) AND max(strike) AS brackets FROM snaps GROUP BY 1""")
def str01_checks(spark, sf):
    rows = chain(spark, sf)
    return round_to(O.snapshot_checks(rows, O.chain_snapshots(rows, AS_OF)), 6, "median_underlying")


cte("expiry_price", """
SELECT date + 9132 AS date, 950.0 * power(close / (SELECT avg(close) FROM bars_strict), 3) AS close FROM (SELECT date, avg(close) AS close FROM bars_strict GROUP BY 1)""")


def expiry_price(spark, sf):
    """Settlement prices: the daily mean close of all symbols, moved to the chain's years and level."""
    bars = bars_strict(spark, sf)
    closes, mean = bars.groupBy("date").agg(F.avg("close").alias("close")), bars.agg(F.avg("close")).scalar()
    return closes.select(F.date_add("date", 9132).alias("date"), (950.0 * F.pow(F.col("close") / mean, F.lit(3.0))).alias("close"))


cte("live", "SELECT * FROM snaps WHERE bid IS NOT NULL AND mark IS NOT NULL AND delta IS NOT NULL AND abs(delta) <= 1")
cte("sale", """
SELECT *, least(0.0003, 0.125 * bid) AS option_fee, greatest(0.0005, mark - bid) AS option_spread, mark - bid <= 0.0005 AS spread_is_floored,
       abs(delta) * 6.5 / 1e4 AS hedge FROM live""")


@query("pnl05_option_sale_costs", """
SELECT as_of, instrument, round(option_fee, 9) AS option_fee, round(option_spread, 9) AS option_spread, spread_is_floored, round(hedge, 9) AS hedge_entry_cost,
       round(option_fee + option_spread + hedge, 9) AS entry_cost, round(0.00015 + hedge, 9) AS exit_cost,
       round(option_fee + option_spread + hedge + 0.00015 + hedge, 9) AS round_trip_ceiling FROM sale""")
def pnl05(spark, sf):
    cols = ("option_fee", "option_spread", "hedge_entry_cost", "entry_cost", "exit_cost", "round_trip_ceiling")
    return round_to(O.sale_costs(snaps(spark, sf)).select("as_of", "instrument", "spread_is_floored", *cols), 9, *cols)


@query("jn08_settlement_price", """
SELECT as_of, instrument, s.expiry, round(p.close, 6) AS terminal FROM snaps s LEFT JOIN expiry_price p ON p.date = s.expiry""")
def jn08(spark, sf):
    out = O.with_terminal(snaps(spark, sf), expiry_price(spark, sf)).select("as_of", "instrument", "expiry", "terminal")
    return round_to(out, 6, "terminal")


cte("option_trade", """
SELECT *, bid - payoff + hedge_pnl AS gross, option_fee + option_spread + hedge + delivery + hedge AS round_trip_cost,
       bid - payoff + hedge_pnl - (option_fee + option_spread + hedge + delivery + hedge) - financing AS net
FROM (SELECT *, least(0.00015, 0.125 * payoff) AS delivery, 0.04 * 0.15 * hold_hours / 8760.0 AS financing, delta * (1 - underlying / terminal) AS hedge_pnl
  FROM (SELECT s.*, p.close AS terminal, CAST(as_of AS DATE) AS entry_date, (epoch_us(CAST(s.expiry AS TIMESTAMP)) - epoch_us(as_of)) / 3.6e9 AS hold_hours,
    greatest(CASE WHEN type = 'call' THEN p.close - strike ELSE strike - p.close END, 0) / p.close AS payoff
    FROM sale s JOIN expiry_price p ON p.date = s.expiry))""")


def held(spark, sf, quotes):
    hours = (F.unix_micros(F.col("expiry").cast("timestamp")) - F.unix_micros(F.col("as_of").cast("timestamp"))) / 3.6e9
    rows = quotes.withColumn("hold_hours", hours).withColumn("entry_date", F.col("as_of").cast("date"))
    return O.with_terminal(rows, expiry_price(spark, sf))


_OPT = ("payoff", "hedge_pnl", "delivery_fee", "financing_cost", "gross", "round_trip_cost", "net")


@query("pnl06_option_trades", """
SELECT as_of, instrument, round(payoff, 8) AS payoff, round(hedge_pnl, 8) AS hedge_pnl, round(delivery, 8) AS delivery_fee, round(financing, 8) AS financing_cost,
       round(gross, 8) AS gross, round(round_trip_cost, 8) AS round_trip_cost, round(net, 8) AS net FROM option_trade""")
def pnl06(spark, sf):
    return round_to(O.short_trades(held(spark, sf, snaps(spark, sf))).select("as_of", "instrument", *_OPT), 8, *_OPT)


@query("pnl07_rehedge_bound", """
SELECT as_of, instrument, k AS n_rehedges, round(k * abs(delta) * 6.5 / 1e4, 9) AS rehedge_cost FROM snaps, (VALUES (1), (7), (30)) v(k)""")
def pnl07(spark, sf):
    out = O.rehedge_bound(snaps(spark, sf), (1, 7, 30)).select("as_of", "instrument", "n_rehedges", "rehedge_cost")
    return round_to(out, 9, "rehedge_cost")


cte("straddle", """
SELECT c.as_of, c.entry_date, c.expiry, c.strike, c.instrument AS call_instrument, p.instrument AS put_instrument, c.underlying, c.net + p.net AS net, c.bid + p.bid AS premium,
       c.delta + p.delta AS combined_delta, p.delta AS put_delta, c.strike / c.underlying - 1 AS moneyness,
       CASE WHEN c.entry_date >= DATE '2024-01-11' THEN 'post_etf' ELSE 'pre_etf' END AS regime
FROM option_trade c JOIN option_trade p ON c.entry_date = p.entry_date AND c.expiry = p.expiry AND c.strike = p.strike AND c.type = 'call' AND p.type = 'put'""")


def straddle(spark, sf):
    return O.straddles(stage(O.short_trades(held(spark, sf, snaps(spark, sf))), "legs"))


_STR = ("net", "premium", "combined_delta", "moneyness")


@query("pnl08_straddles", f"""
SELECT entry_date, expiry, strike, call_instrument, put_instrument, regime, {', '.join(f'round({c}, 8) AS {c}' for c in _STR)} FROM straddle""")
def pnl08(spark, sf):
    out = straddle(spark, sf).select("entry_date", "expiry", "strike", "call_instrument", "put_instrument", "regime", *_STR)
    return round_to(out, 8, *_STR)


@query("agg13_regime_tails", """
SELECT name, count(net) AS n, round(coalesce(avg(net), 0), 8) AS mean_net, round(coalesce(avg((net < 0)::INT), 0), 8) AS frac_losing, round(coalesce(greatest(0, -min(net)), 0), 8) AS worst_loss,
       round(coalesce(max(peak - cum), 0), 8) AS max_drawdown, round(coalesce(greatest(0, -min(net)) / 0.15, 0), 8) AS margin_multiple
FROM (VALUES ('all'), ('pre_etf'), ('post_etf')) v(name) LEFT JOIN (
  SELECT *, greatest(0, max(cum) OVER (PARTITION BY nm ORDER BY entry_date, expiry, strike, call_instrument, put_instrument)) AS peak FROM (
    SELECT *, sum(net) OVER (PARTITION BY nm ORDER BY entry_date, expiry, strike, call_instrument, put_instrument) AS cum FROM (
      SELECT s.*, unnest(['all', regime]) AS nm FROM straddle s))) ON nm = name GROUP BY 1""")
def agg13(spark, sf):
    out = O.regime_tails(stage(straddle(spark, sf), "straddles"), ["entry_date", "expiry", "strike", "call_instrument", "put_instrument"])
    return round_to(out, 8, "mean_net", "frac_losing", "worst_loss", "max_drawdown", "margin_multiple")


cte("chosen_expiry", """
SELECT as_of, arg_min(expiry, row(abs(epoch_us(CAST(expiry AS TIMESTAMP)) - epoch_us(as_of + INTERVAL 30 DAY)), expiry)) AS expiry FROM snaps GROUP BY 1""")
cte("chosen_strike", """
SELECT as_of, expiry, arg_min(strike, row(abs(strike - level), strike)) AS strike FROM (
  SELECT l.as_of, l.expiry, strike, count(DISTINCT type) AS sides FROM live l JOIN chosen_expiry USING (as_of, expiry) GROUP BY 1, 2, 3)
JOIN (SELECT as_of, median(underlying) AS level FROM snaps JOIN chosen_expiry USING (as_of, expiry) GROUP BY 1) USING (as_of) WHERE sides = 2 GROUP BY 1, 2""")
cte("chosen", """
SELECT * EXCLUDE (rn) FROM (SELECT l.*, row_number() OVER (PARTITION BY as_of, type ORDER BY ts DESC, ingest DESC) AS rn FROM live l JOIN chosen_strike USING (as_of, expiry, strike)) WHERE rn = 1""")


@query("top02_straddle_selection", "SELECT as_of, expiry, strike, type, instrument FROM chosen")
def top02(spark, sf):
    return O.select_straddle(stage(snaps(spark, sf), "snapshots")).select("as_of", "expiry", "strike", "type", "instrument")


@query("top03_representative_entry", """
SELECT entry_date, strike, call_instrument, put_instrument, round(put_delta, 9) AS put_delta FROM straddle
ORDER BY regime <> 'post_etf', abs(straddle.put_delta + 0.5), entry_date, straddle.strike, call_instrument, put_instrument LIMIT 1""")
def top03(spark, sf):
    out = O.representative(straddle(spark, sf)).select("entry_date", "strike", "call_instrument", "put_instrument", "put_delta")
    return round_to(out, 9, "put_delta")


@query("pnl09_shock_losses", """
SELECT CAST(c.as_of AS DATE) AS entry_date, c.shock, c.strike, round(greatest(0, -(c.net + p.net)), 8) AS loss, round(greatest(0, -(c.net + p.net)) / 0.15, 8) AS margin_multiple
FROM shocked c JOIN shocked p ON c.as_of = p.as_of AND c.shock = p.shock AND c.type = 'call' AND p.type = 'put'""".replace("shocked", "(SELECT *, bid - payoff + delta * (1 - underlying / terminal) - (least(0.0003, 0.125 * bid) + greatest(0.0005, mark - bid) + 2 * abs(delta) * 6.5 / 1e4 + least(0.00015, 0.125 * payoff)) - 0.04 * 0.15 * hold_hours / 8760.0 AS net FROM (SELECT *, greatest(CASE WHEN type = 'call' THEN terminal - strike ELSE strike - terminal END, 0) / terminal AS payoff FROM (SELECT c.*, shock, underlying * (1 - shock) AS terminal, (epoch_us(CAST(expiry AS TIMESTAMP)) - epoch_us(as_of)) / 3.6e9 AS hold_hours FROM chosen c, (VALUES (0.37::DOUBLE), (0.5::DOUBLE)) v(shock))))"))
def pnl09(spark, sf):
    """Crash losses of the straddle selected at each snapshot."""
    legs = held(spark, sf, O.select_straddle(stage(snaps(spark, sf), "snapshots"))).drop("terminal")
    return round_to(O.shock_losses(legs), 8, "loss", "margin_multiple")


# ---- variance premium -----------------------------------------------------------------------------

WINDOW = 30
cte("realized", f"""
SELECT symbol, date, rv AS rv_trailing, lead(rv, {WINDOW}) OVER (PARTITION BY symbol ORDER BY date) AS rv_forward FROM (
  SELECT symbol, date, CASE WHEN count(sq) OVER w = {WINDOW} THEN sum(sq) OVER w * 365.0 / {WINDOW} END AS rv FROM (
    SELECT symbol, date, power(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)), 2) AS sq FROM bars_strict)
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS {WINDOW - 1} PRECEDING))""")


@query("win07_realized_variance", "SELECT symbol, date, round(rv_trailing, 9) AS rv_trailing, round(rv_forward, 9) AS rv_forward FROM realized")
def win07(spark, sf):
    out = VP.realized_variance(bars_strict(spark, sf), WINDOW).select("symbol", "date", "rv_trailing", "rv_forward")
    return round_to(out, 9, "rv_trailing", "rv_forward")


cte("rate_index", "SELECT date, 50.0 + 1000.0 * (bond_yield - 0.07) AS dvol_close FROM rate_curve")
cte("premium", """
SELECT i.date, symbol, dvol_close, power(dvol_close / 100.0, 2) AS implied_var, rv_trailing, rv_forward, power(dvol_close / 100.0, 2) - rv_forward AS vrp_forward,
       power(dvol_close / 100.0, 2) - rv_trailing AS vrp_trailing, dvol_close / 100.0 - sqrt(rv_forward) AS vol_spread_forward,
       CASE WHEN i.date >= DATE '1999-01-01' THEN 'post_etf' ELSE 'pre_etf' END AS regime
FROM rate_index i JOIN realized r ON i.date = r.date""")


def rate_index(spark, sf):
    from .inputs import rate_curve

    return rate_curve(spark, sf).select("date", (50.0 + 1000.0 * (F.col("bond_yield") - 0.07)).alias("dvol_close"))


def premium(spark, sf):
    realized = VP.realized_variance(bars_strict(spark, sf), WINDOW).select("symbol", "date", "rv_trailing", "rv_forward")
    return VP.variance_premium(rate_index(spark, sf), realized, "1999-01-01")


_VRP = ("implied_var", "rv_trailing", "rv_forward", "vrp_forward", "vrp_trailing", "vol_spread_forward")


@query("scr27_variance_premium", f"SELECT date, symbol, regime, {', '.join(f'round({c}, 8) AS {c}' for c in _VRP)} FROM premium")
def scr27(spark, sf):
    return round_to(premium(spark, sf).select("date", "symbol", "regime", *_VRP), 8, *_VRP)


@query("jn04_implied_realized", """
SELECT symbol, date, round(dvol_close, 8) AS dvol_close, round(close, 8) AS close FROM (
  SELECT CAST(ts AS DATE) - 9132 AS date, 50.0 + 10.0 * avg(value) / 250.0 AS dvol_close FROM events GROUP BY 1) JOIN bars_strict USING (date)""")
def jn04(spark, sf):
    implied = index_level(spark, sf).withColumn("date", F.date_sub("date", 9132))
    closes = bars_strict(spark, sf).select("symbol", "date", "close")
    return round_to(implied.join(closes, "date").select("symbol", "date", "dvol_close", "close"), 8, "dvol_close", "close")


@query("agg19_regime_stats", """
SELECT symbol, regime, count(*) AS n, round(avg(vrp_forward), 8) AS mean_vrp, round(avg((vrp_forward > 0)::INT), 8) AS frac_positive,
       round(avg(dvol_close), 7) AS mean_implied_vol_pct, round(avg(100 * sqrt(rv_forward)), 7) AS mean_realized_vol_pct
FROM premium WHERE vrp_forward IS NOT NULL GROUP BY 1, 2""")
def agg19(spark, sf):
    out = VP.regime_stats(premium(spark, sf), ["symbol"])
    return round_to(round_to(out, 8, "mean_vrp", "frac_positive"), 7, "mean_implied_vol_pct", "mean_realized_vol_pct")


@query("agg20_alignment_funnel", """
SELECT 'implied_days' AS measure, count(DISTINCT date) AS n FROM rate_index UNION ALL SELECT 'price_days', count(DISTINCT date) FROM bars_strict
UNION ALL SELECT 'aligned_rows', count(*) FROM premium UNION ALL SELECT 'forward_rows', count(vrp_forward) FROM premium""")
def agg20(spark, sf):
    return VP.alignment_funnel(rate_index(spark, sf), bars_strict(spark, sf), premium(spark, sf))


cte("vrp_series", """
SELECT symbol AS series_id, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx, date AS dt, vrp_forward AS ret FROM premium WHERE vrp_forward IS NOT NULL""")


def vrp_series(spark, sf):
    return numbered(premium(spark, sf).filter("vrp_forward IS NOT NULL"), "symbol", "vrp_forward")


@query("scr11_strided_phases", f"""
SELECT series_id, round(median(m), 8) AS phase_median, round(min(m), 8) AS phase_min, round(max(m), 8) AS phase_max, max(n) FILTER (phase = 0) AS n_strided FROM (
  SELECT series_id, idx % {WINDOW} AS phase, avg(ret) AS m, count(*) AS n FROM vrp_series GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1""")
def scr11(spark, sf):
    return round_to(VP.strided_means(vrp_series(spark, sf), WINDOW), 8, "phase_median", "phase_min", "phase_max")


cte("straddle_series", """
SELECT 'straddle' AS series_id, row_number() OVER (ORDER BY entry_date, expiry, strike, call_instrument, put_instrument) - 1 AS idx, net / 0.3 AS ret FROM straddle""")
score_ctes("strad", "straddle_series")


@query("scr26_variance_verdict", """
SELECT n, effective_t, round(psr0, 5) AS psr0, round(m, 7) AS worst_margin_multiple, psr0 >= 0.95 AS dsr_passes, m <= 1 AS tail_survivable, NOT (psr0 >= 0.95 AND m <= 1) AS non_viable,
       effective_t < 30 AS dsr_underpowered FROM strad_score, (SELECT greatest(0, -min(net)) / 0.15 AS m FROM straddle)""")
def scr26_variance(spark, sf):
    """Significance of the straddle returns on doubled margin, and whether the worst loss stays within margin."""
    from pyspark.sql import Window

    rows = stage(straddle(spark, sf), "straddles").withColumn("series_id", F.lit("straddle"))
    order = Window.partitionBy("series_id").orderBy("entry_date", "expiry", "strike", "call_instrument", "put_instrument")
    series = rows.select("series_id", (F.row_number().over(order) - 1).alias("idx"), (F.col("net") / (2 * costs.OPTION_MARGIN)).alias("ret"))
    worst = rows.groupBy("series_id").agg((F.greatest(F.lit(0.0), -F.min("net")) / costs.OPTION_MARGIN).alias("m"))
    out = S.score_series(series).join(worst, "series_id")
    passes, survives = F.col("psr0") >= 0.95, F.col("m") <= 1.0
    return out.select(
        "n", "effective_t", F.round("psr0", 5).alias("psr0"), F.round("m", 7).alias("worst_margin_multiple"),
        passes.alias("dsr_passes"), survives.alias("tail_survivable"), (~(passes & survives)).alias("non_viable"),
        (F.col("effective_t") < 30).alias("dsr_underpowered"),
    )
