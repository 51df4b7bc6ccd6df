"""Delta-neutral carry: trades of all horizons, entry schedules, interval series, gates and cost surfaces.

Observations are (symbol, idx, dt, funding_rate, perp_close, spot_close), one row per settlement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import HOURS_PER_YEAR
from ..functions.windows import over, uniform, with_grid
from . import costs
from .returns import additive_drawdown
from .scoring import moved_scores, score_series

CELL = ("symbol", "venue", "capital_multiple", "horizon")
PASS_LEVEL = 0.95
CONTAMINATION_LIMIT = 0.25
IID_BLOCK_CEILING = 1.0


def trades(obs: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per valid entry and horizon, before costs.

    All horizons come from one window pass: funding of the next H settlements, prices H rows ahead.
    Tail rows without a full window are no entries.
    """
    w = over(keys, "idx")
    ahead = F.array(*[
        F.struct(
            F.lit(h).alias("horizon"), F.lead("idx", h).over(w).alias("exit_idx"), F.lead("dt", h).over(w).alias("exit_dt"),
            F.sum("funding_rate").over(w.rowsBetween(1, h)).alias("funding"),
            F.lead("spot_close", h).over(w).alias("spot_exit"), F.lead("perp_close", h).over(w).alias("perp_exit"),
        )
        for h in horizons
    ])
    spot = (F.col("_a.spot_exit") - F.col("spot_close")) / F.col("spot_close")
    perp = -(F.col("_a.perp_exit") - F.col("perp_close")) / F.col("perp_close")
    hours = (F.unix_micros(F.col("exit_dt").cast("timestamp")) - F.unix_micros(F.col("entry_dt").cast("timestamp"))) / 3.6e9
    return (
        obs.withColumn("_ahead", ahead).withColumn("_a", F.explode("_ahead")).filter("_a.exit_idx IS NOT NULL")
        .select(
            *keys, "_a.horizon", F.col("idx").alias("entry_idx"), "_a.exit_idx", F.col("dt").alias("entry_dt"), "_a.exit_dt",
            F.col("_a.funding").alias("funding_collected"), spot.alias("spot_leg_pnl"), perp.alias("perp_leg_pnl"),
        )
        .withColumn("hold_hours", hours)
        .withColumn("price_pnl", F.col("spot_leg_pnl") + F.col("perp_leg_pnl"))
        .withColumn("gross", F.col("funding_collected") + F.col("price_pnl"))
    )


def with_costs(
    gross_trades: DataFrame, capital_multiples: Sequence[float] = costs.CAPITAL_MULTIPLES,
    entry_taker: bool = True, exit_taker: bool = True,
) -> DataFrame:
    """Trades for every venue and capital multiple, with round-trip and financing cost and the net result."""
    grid = [
        {**venue, "capital_multiple": m} for venue in costs.venue_rows(entry_taker, exit_taker) for m in capital_multiples
    ]
    financing = costs.financing_cost(F.col("hold_hours"), F.col("capital_multiple"))
    return with_grid(gross_trades, grid).withColumn("financing_cost", financing).withColumn(
        "net", F.col("gross") - F.col("round_trip_cost") - F.col("financing_cost")
    )


def strided(priced: DataFrame, phase: int | None = None) -> DataFrame:
    """Non-overlapping entries: every H-th from each phase (or one), renumbered within the phase."""
    out = priced.withColumn("phase", F.pmod("entry_idx", "horizon").cast("int")).withColumn(
        "idx", F.floor(F.col("entry_idx") / F.col("horizon"))
    )
    return out if phase is None else out.filter(F.col("phase") == phase)


def random_entries(priced: DataFrame, count: Column | int, seed: int, keys: Sequence[str] = ("symbol", "horizon"), strict: bool = True) -> DataFrame:
    """A seeded random subset of entries without replacement: the `count` smallest hash draws per key.

    A key with fewer entries than asked for raises, or gives all it has if not `strict`.
    """
    draw = uniform(seed, *[F.col(k) for k in keys], F.col("entry_idx"))
    ranked = priced.withColumn("_draw", draw)
    order = over(keys, "_draw", "entry_idx")
    count = F.lit(count) if isinstance(count, int) else count
    if strict:
        short = F.count(F.lit(1)).over(Window.partitionBy(*keys)) < count
        ranked = ranked.withColumn("_draw", F.when(short, F.raise_error(F.lit("fewer entries than asked for")).cast("double")).otherwise(F.col("_draw")))
    return ranked.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count).drop("_draw", "_n")


def short_schedules(priced: DataFrame, count: int, keys: Sequence[str] = ("symbol", "horizon")) -> DataFrame:
    """Keys that have fewer entries than a schedule of `count` asks for, and how many are missing."""
    sizes = priced.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_entries")).filter(F.col("n_entries") < count)
    return sizes.withColumn("n_missing", F.lit(count) - F.col("n_entries"))


def interval_series(obs: DataFrame, priced: DataFrame, horizons: Sequence[int], amortise: bool) -> DataFrame:
    """Per-settlement results of the phase-0 trades laid end to end, as (cell keys, idx, ret).

    Costs are booked on the first and last settlement, or spread evenly; the price result always falls
    on the last. The settlements of a trade sum to its net result. Rows meet their trade by equi-join.
    """
    entries = strided(priced, 0).select(
        *CELL, F.col("idx").alias("_trade"), "entry_cost", "exit_cost", "round_trip_cost", "financing_cost", "price_pnl"
    )
    rows = obs.filter("idx >= 1").select("symbol", F.col("idx").alias("_row"), "funding_rate")
    steps = (
        with_grid(rows, [{"horizon": h} for h in horizons])
        .withColumn("_trade", F.floor((F.col("_row") - 1) / F.col("horizon")))
        .withColumn("_step", F.pmod(F.col("_row") - 1, F.col("horizon")))
    )
    first, last = F.col("_step") == 0, F.col("_step") == F.col("horizon") - 1
    even = (F.col("round_trip_cost") + F.col("financing_cost")) / F.col("horizon")
    lumpy = (
        F.col("financing_cost") / F.col("horizon") + F.when(first, F.col("entry_cost")).otherwise(0.0)
        + F.when(last, F.col("exit_cost")).otherwise(0.0)
    )
    ret = F.col("funding_rate") - (even if amortise else lumpy) + F.when(last, F.col("price_pnl")).otherwise(0.0)
    joined = steps.join(entries, ["symbol", "horizon", "_trade"])
    return joined.select(*CELL, (F.col("_row") - 1).alias("idx"), ret.alias("ret"))


def _medians(priced: DataFrame, keys: Sequence[str]) -> DataFrame:
    return priced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"), F.median("funding_collected").alias("median_funding"),
        F.median("financing_cost").alias("median_financing"), F.median("hold_hours").alias("median_hold"),
        F.max("round_trip_cost").alias("round_trip_cost"),
    )


def _gated(medians: DataFrame) -> DataFrame:
    yearly = F.when(F.col("median_hold") > 0, HOURS_PER_YEAR / F.col("median_hold")).otherwise(0.0)
    realized = F.col("round_trip_cost") + F.col("median_financing")
    return (
        medians.withColumn("realized_cost", realized).withColumn("headroom", F.col("median_funding") - realized)
        .withColumn("funding_annualized", F.col("median_funding") * yearly)
        .withColumn("financing_annualized", F.col("median_financing") * yearly)
    )


def early_gate(priced: DataFrame, keys: Sequence[str] = (*CELL, "tradeable")) -> DataFrame:
    """Median funding against median cost per cell, and both on a yearly basis."""
    return _gated(_medians(priced, keys))


def price_contamination(gross_trades: DataFrame, keys: Sequence[str] = ("symbol", "horizon")) -> DataFrame:
    """How much of the result is price movement: mean ratio, medians, nearest-rank 95 % size, and a flag."""
    size = F.abs("price_pnl")
    ranked = gross_trades.withColumn("_size", size).withColumn(
        "_rank", F.row_number().over(over(keys, "_size")) - 1
    ).withColumn("_n", F.count(F.lit(1)).over(over(keys)))
    nearest = F.floor(0.95 * (F.col("_n") - 1) + 0.5)
    agg = ranked.groupBy(*keys).agg(
        F.avg("funding_collected").alias("mean_funding"), F.median("funding_collected").alias("median_funding"),
        F.avg("price_pnl").alias("mean_price_pnl"), F.median("_size").alias("median_abs_price_pnl"),
        F.max(F.when(F.col("_rank") == nearest, F.col("_size"))).alias("p95_abs_price_pnl"),
    )
    ratio = F.abs("mean_price_pnl") / F.nullif(F.abs("mean_funding"), F.lit(0.0))
    flag = F.coalesce(ratio >= CONTAMINATION_LIMIT, F.lit(True))
    return agg.withColumn("contamination_ratio", ratio).withColumn("contaminated", flag)


def sign_regime(obs: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Counts and means of collected funding by sign, share negative, and drawdown of the running sum."""
    rate = F.col("funding_rate")
    known = obs.filter(rate.isNotNull())
    agg = known.groupBy(*keys).agg(
        F.count_if(rate > 0).alias("n_positive"), F.count_if(rate < 0).alias("n_negative"), F.count_if(rate == 0).alias("n_zero"),
        F.coalesce(F.avg(F.when(rate > 0, rate)), F.lit(0.0)).alias("mean_positive"),
        F.coalesce(F.avg(F.when(rate < 0, rate)), F.lit(0.0)).alias("mean_negative"),
        F.avg((rate < 0).cast("double")).alias("negative_fraction"),
    )
    return agg.join(additive_drawdown(known, "funding_rate", ["idx"], keys), list(keys))


def after_tax(priced: DataFrame, rate: float, keys: Sequence[str] = CELL) -> DataFrame:
    """Yearly sums with gains taxed at a flat rate and losses passed through."""
    if not 0.0 <= rate < 1.0:
        raise ValueError("tax rate must lie in [0, 1)")
    yearly = priced.groupBy(*keys, F.year("entry_dt").alias("_year")).agg(F.sum("net").alias("_net"))
    kept = F.when(F.col("_net") > 0, F.col("_net") * (1.0 - rate)).otherwise(F.col("_net"))
    agg = yearly.groupBy(*keys).agg(
        F.sum("_net").alias("pre_tax"), F.sum(kept).alias("after_tax"), F.count(F.lit(1)).alias("n_years")
    )
    return agg.withColumn("tax_drag", F.col("pre_tax") - F.col("after_tax"))


def with_financing(gross_trades: DataFrame, capital_multiples: Sequence[float] = costs.CAPITAL_MULTIPLES) -> DataFrame:
    """Trades for every capital multiple, with the financing cost: what no venue changes."""
    financing = costs.financing_cost(F.col("hold_hours"), F.col("capital_multiple"))
    return with_grid(gross_trades, [{"capital_multiple": m} for m in capital_multiples]).withColumn("financing_cost", financing)


#: Venue of a series that serves all venues.
ANY_VENUE = ""


def headline_series(obs: DataFrame, financed: DataFrame, horizons: Sequence[int], venues: Sequence[dict] | None = None) -> DataFrame:
    """Every series the headline needs, as (cell keys, kind, idx, ret).

    A venue takes the same amount from every result of a strided phase and of the even interval series, so these are
    formed once, before its cost, under `ANY_VENUE`. Only the lumpy interval series, where the cost falls on two
    settlements of a trade, is formed per venue.
    """
    cell = ("symbol", "capital_multiple", "horizon")
    phases = strided(financed).select(*cell, F.col("phase").cast("string").alias("kind"), "idx", (F.col("gross") - F.col("financing_cost")).alias("ret"))
    entries = strided(financed, 0).select(*cell, F.col("idx").alias("_trade"), "financing_cost", "price_pnl")
    rows = obs.filter("idx >= 1").select("symbol", F.col("idx").alias("_row"), "funding_rate")
    steps = (
        with_grid(rows, [{"horizon": h} for h in horizons])
        .withColumn("_trade", F.floor((F.col("_row") - 1) / F.col("horizon"))).withColumn("_step", F.pmod(F.col("_row") - 1, F.col("horizon")))
        .join(entries, ["symbol", "horizon", "_trade"])
    )
    first, last = F.col("_step") == 0, F.col("_step") == F.col("horizon") - 1
    base = F.col("funding_rate") - F.col("financing_cost") / F.col("horizon") + F.when(last, F.col("price_pnl")).otherwise(0.0)
    sides = F.array(F.struct(F.lit(ANY_VENUE).alias("venue"), F.lit("amortised").alias("kind"), F.lit(0.0).alias("cost")), *[
        F.struct(F.lit(v["venue"]).alias("venue"), F.lit("lumpy").alias("kind"),
                 (F.when(first, F.lit(v["entry_cost"])).otherwise(0.0) + F.when(last, F.lit(v["exit_cost"])).otherwise(0.0)).alias("cost"))
        for v in venues or costs.venue_rows()
    ])
    laid = steps.select(*cell, (F.col("_row") - 1).alias("idx"), base.alias("ret"), F.explode(sides).alias("_s"))
    laid = laid.select(*cell, "_s.venue", "_s.kind", "idx", (F.col("ret") - F.col("_s.cost")).alias("ret"))
    return phases.withColumn("venue", F.lit(ANY_VENUE)).unionByName(laid)


def venue_scores(scores: DataFrame, venues: Sequence[dict] | None = None) -> DataFrame:
    """Scores of `headline_series` for every venue: a constant cost moves the mean alone, so deviation, block length,
    skewness and kurtosis are those of the shared series, and the Sharpe ratio is moved in closed form."""
    shared = with_grid(scores.filter(F.col("venue") == ANY_VENUE).drop("venue"), [{k: v[k] for k in ("venue", "round_trip_cost")} for v in venues or costs.venue_rows()])
    cost = F.when(F.col("kind") == "amortised", F.col("round_trip_cost") / F.col("horizon")).otherwise(F.col("round_trip_cost"))
    moved = moved_scores(shared, cost).drop("round_trip_cost")
    return moved.unionByName(scores.filter(F.col("venue") != ANY_VENUE))


def headline(series: DataFrame, venues: Sequence[dict] | None = None) -> DataFrame:
    """Significance per cell from `headline_series`: median over all phases, lumpy and even interval
    series, and the smaller of median and lumpy as the deciding number. All series are scored in one pass;
    store the series first, since scoring reads it twice."""
    scores = venue_scores(score_series(series, [*CELL, "kind"]), venues)
    phase = (F.col("n") >= 2) & ~F.col("kind").isin("lumpy", "amortised")

    def pick(kind: str, c: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(c)))

    out = scores.withColumn("_phase", F.when(phase, F.col("psr0"))).groupBy(*CELL).agg(
        F.median("_phase").alias("median"), F.min("_phase").alias("min"), F.max("_phase").alias("max"),
        pick("lumpy", "psr0").alias("lumpy"), pick("amortised", "psr0").alias("amortised"), pick("0", "n").alias("n_trades"),
        pick("0", "effective_t").alias("effective_t"), pick("0", "block").alias("block"), pick("0", "sr").alias("sr"),
        pick("0", "skew").alias("skew"), pick("0", "kurt").alias("kurt"),
    )
    kill = F.when(F.col("median").isNotNull() & F.col("lumpy").isNotNull(), F.least("median", "lumpy"))
    return (
        out.withColumn("kill", kill).withColumn("passes", F.coalesce(kill >= PASS_LEVEL, F.lit(False)))
        .withColumn("iid_ok", F.col("block") <= IID_BLOCK_CEILING)
    )


def long_enough(obs: DataFrame, gross_trades: DataFrame) -> DataFrame:
    """Trades of symbols that have more than two horizons of observations."""
    sizes = obs.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    return gross_trades.join(sizes, "symbol").filter("_n > 2 * horizon").drop("_n")


def cost_surface(financed: DataFrame, series: DataFrame, venues: Sequence[dict] | None = None) -> DataFrame:
    """Early gate and headline for every venue, horizon and capital multiple of every symbol.

    Medians are taken before venues come in: `financed` has each trade once per capital multiple.
    """
    venues = venues or costs.venue_rows()
    medians = _medians(financed.withColumn("round_trip_cost", F.lit(0.0)), ["symbol", "capital_multiple", "horizon"]).drop("round_trip_cost")
    gate = _gated(with_grid(medians, [{k: v[k] for k in ("venue", "tradeable", "round_trip_cost")} for v in venues]))
    return gate.join(headline(series, venues).drop("n_trades"), list(CELL))


def killed(surface: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """True unless a tradeable cell at the doubled capital charge passes."""
    alive = F.bool_or(F.col("passes") & F.col("tradeable") & (F.col("capital_multiple") == 2.0))
    return surface.groupBy(*keys).agg((~alive).alias("killed"))
