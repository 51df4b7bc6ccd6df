"""Option chains and short option trades, costs and results in coin per contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import regime
from ..functions.windows import over, with_grid
from . import costs
from .panel import keep_latest
from .returns import additive_drawdown


def chain_snapshots(chain: DataFrame, as_of: Sequence[str], ingest: str = "ingest") -> DataFrame:
    """Per as-of instant and live instrument, the freshest quote not after it; later arrival wins ties.

    Quotes are first reduced to the freshest per instrument between neighbouring instants, so only that
    small table is repeated per instant.
    """
    instants = sorted(as_of)
    stamps = [F.lit(t).cast("timestamp_ntz") for t in instants]
    slot = F.coalesce(*[F.when(F.col("ts") <= s, F.lit(i)) for i, s in enumerate(stamps)])
    order = F.struct("ts", ingest)
    recent = keep_latest(chain.withColumn("_slot", slot).filter("_slot IS NOT NULL"), ["instrument", "_slot"], order)
    spread = with_grid(recent, [{"as_of": t, "_at": i} for i, t in enumerate(instants)]).filter("_slot <= _at")
    spread = spread.withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))
    live = spread.filter(F.col("expiry").cast("timestamp_ntz") > F.col("as_of")).drop("_slot", "_at")
    return keep_latest(live, ["as_of", "instrument"], order)


def snapshot_checks(chain: DataFrame, snapshots: DataFrame, min_instruments: int = 20) -> DataFrame:
    """Per snapshot: was its instant reached, are there enough instruments, do strikes bracket the level."""
    reached = chain.agg(F.max("ts")).scalar()
    agg = snapshots.groupBy("as_of").agg(
        F.count(F.lit(1)).alias("n_instruments"), F.min("strike").alias("_low"), F.max("strike").alias("_high"),
        F.median("underlying").alias("median_underlying"),
    )
    return agg.select(
        "as_of", "n_instruments", "median_underlying", (reached >= F.col("as_of")).alias("reached"),
        (F.col("n_instruments") >= min_instruments).alias("enough"),
        F.col("median_underlying").between(F.col("_low"), F.col("_high")).alias("brackets"),
    )


def tradeable(df: DataFrame) -> DataFrame:
    """Quotes that can be sold and hedged: bid, mark and a delta of size at most one."""
    return df.filter("bid IS NOT NULL AND mark IS NOT NULL AND delta IS NOT NULL AND abs(delta) <= 1")


def sale_costs(quotes: DataFrame, entry_taker: bool = True, exit_taker: bool = True) -> DataFrame:
    """Cost of selling each quote at its bid and hedging it once; delivery at its ceiling."""
    size = F.abs("delta")
    floor = costs.OPTION_SPREAD_FLOOR_BPS / costs.BPS
    slip = F.col("mark") - F.col("bid")
    return (
        tradeable(quotes)
        .withColumn("option_fee", F.least(F.lit(costs.OPTION_FEE_BPS / costs.BPS), costs.OPTION_FEE_CAP * F.col("bid")))
        .withColumn("option_spread", F.greatest(F.lit(floor), slip))
        .withColumn("spread_is_floored", slip <= floor)
        .withColumn("routing_fee", F.lit(costs.OPTION_ROUTING_BPS / costs.BPS))
        .withColumn("delivery_ceiling", F.lit(costs.OPTION_DELIVERY_BPS / costs.BPS))
        .withColumn("hedge_entry_cost", costs.hedge_side_cost(size, entry_taker))
        .withColumn("hedge_exit_cost", costs.hedge_side_cost(size, exit_taker))
        .withColumn("entry_cost", F.col("option_fee") + F.col("option_spread") + F.col("routing_fee") + F.col("hedge_entry_cost"))
        .withColumn("exit_cost", F.col("delivery_ceiling") + F.col("hedge_exit_cost"))
        .withColumn("round_trip_ceiling", F.col("entry_cost") + F.col("exit_cost"))
    )


def with_terminal(quotes: DataFrame, prices: DataFrame) -> DataFrame:
    """The settlement price of each quote's expiry day; a day without a price raises."""
    table = prices.select(F.col("date").alias("expiry"), F.col("close").alias("terminal"))
    found = quotes.join(table, "expiry", "left")
    missing = F.raise_error(F.concat(F.lit("no settlement price for "), F.col("expiry").cast("string"))).cast("double")
    return found.withColumn("terminal", F.coalesce("terminal", missing))


def short_trades(quotes: DataFrame) -> DataFrame:
    """Each tradeable quote sold, hedged once and held to `terminal` for `hold_hours`.

    A level or terminal that is missing or not positive, and a missing or negative holding time, raise.
    """
    sound = F.coalesce((F.col("underlying") > 0) & (F.col("terminal") > 0) & (F.col("hold_hours") >= 0), F.lit(False))
    fault = F.raise_error(F.concat(F.lit("no trade from level, terminal and hold of "), F.col("instrument"))).cast("double")
    quotes = quotes.withColumn("underlying", F.when(sound, F.col("underlying")).otherwise(fault))
    s0, st = F.col("underlying"), F.col("terminal")
    intrinsic = F.greatest(F.when(F.col("type") == "call", st - F.col("strike")).otherwise(F.col("strike") - st), F.lit(0.0))
    return (
        sale_costs(quotes)
        .withColumn("payoff", intrinsic / st)
        .withColumn("hedge_pnl", F.col("delta") * (1.0 - s0 / st))
        .withColumn("delivery_fee", costs.delivery_fee(F.col("payoff")))
        .withColumn("financing_cost", costs.margin_financing(F.col("hold_hours")))
        .withColumn("gross", F.col("bid") - F.col("payoff") + F.col("hedge_pnl"))
        .withColumn("round_trip_cost", F.col("entry_cost") + F.col("delivery_fee") + F.col("hedge_exit_cost"))
        .withColumn("net", F.col("gross") - F.col("round_trip_cost") - F.col("financing_cost"))
        .drop("delivery_ceiling", "exit_cost", "round_trip_ceiling")
    )


def rehedge_bound(quotes: DataFrame, counts: Sequence[int]) -> DataFrame:
    """Upper bound of the cost of rehedging each quote a number of times."""
    rows = with_grid(quotes.filter("delta IS NOT NULL"), [{"n_rehedges": n} for n in counts])
    return rows.withColumn("rehedge_cost", F.col("n_rehedges") * costs.hedge_side_cost(F.abs("delta")))


def straddles(legs: DataFrame, keys: Sequence[str] = ("entry_date",)) -> DataFrame:
    """Call and put trades of one strike and expiry joined into short straddles."""
    join = [*keys, "expiry", "strike"]

    def side(kind: str) -> DataFrame:
        picked = legs.filter(F.col("type") == kind)
        shared = ["underlying", "terminal", "hold_hours"] if kind == "call" else []
        return picked.select(*join, *shared, *[F.col(c).alias(f"{kind}_{c}") for c in ("instrument", "net", "bid", "delta")])

    both = side("call").join(side("put"), join)
    return (
        both.withColumn("net", F.col("call_net") + F.col("put_net"))
        .withColumn("premium", F.col("call_bid") + F.col("put_bid"))
        .withColumn("combined_delta", F.col("call_delta") + F.col("put_delta"))
        .withColumn("moneyness", F.col("strike") / F.col("underlying") - 1.0)
        .withColumn("regime", regime(F.col("entry_date")))
    )


def select_straddle(snapshots: DataFrame, target_days: int = 30) -> DataFrame:
    """Per snapshot the legs nearest the money: expiry closest to as-of plus the target (earlier on ties),
    then the strike closest to the median level among strikes tradeable on both sides (lower on ties)."""
    target = F.col("as_of") + F.expr(f"INTERVAL {int(target_days)} DAYS")
    off = F.abs(F.unix_micros(F.col("expiry").cast("timestamp")) - F.unix_micros(target.cast("timestamp")))
    nearest = snapshots.groupBy("as_of").agg(F.min_by("expiry", F.struct(off, F.col("expiry"))).alias("expiry"))
    legs = snapshots.join(nearest, ["as_of", "expiry"], "left_semi")
    level = legs.groupBy("as_of").agg(F.median("underlying").alias("_level"))
    sides = tradeable(legs).groupBy("as_of", "strike").agg(F.count_distinct("type").alias("_sides"))
    distance = F.struct(F.abs(F.col("strike") - F.col("_level")), F.col("strike"))
    strike = sides.filter("_sides = 2").join(level, "as_of").groupBy("as_of").agg(F.min_by("strike", distance).alias("strike"))
    chosen = tradeable(legs).join(strike, ["as_of", "strike"], "left_semi")
    return keep_latest(chosen, ["as_of", "expiry", "strike", "type"], F.struct("ts", "ingest"))


def representative(entries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The entry whose put delta is closest to -0.5, among post-regime entries if there are any."""
    order = F.struct(F.col("regime") != "post_etf", F.abs(F.col("put_delta") + 0.5), F.col("entry_date"), F.col("strike"), F.col("call_instrument"), F.col("put_instrument"))
    rest = [c for c in entries.columns if c not in keys]
    best = entries.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_e"))
    return best.select(*keys, *[F.col(f"_e.{c}").alias(c) for c in rest])


def shock_losses(legs: DataFrame, shocks: Sequence[float] = costs.SHOCKS, keys: Sequence[str] = ("entry_date",)) -> DataFrame:
    """Loss of a straddle, given as its two quotes, if the level falls by each shock at once."""
    shocked = with_grid(legs, [{"shock": s} for s in shocks]).withColumn("terminal", F.col("underlying") * (1.0 - F.col("shock")))
    out = straddles(short_trades(shocked), [*keys, "shock"])
    loss = F.greatest(F.lit(0.0), -F.col("net"))
    return out.select(*keys, "shock", "strike", loss.alias("loss"), (loss / costs.OPTION_MARGIN).alias("margin_multiple"))


def regime_tails(trades: DataFrame, order: Sequence[str], margin: float = costs.OPTION_MARGIN) -> DataFrame:
    """Loss statistics over all trades and per regime; a regime without trades has a zero row."""
    names = [{"name": n} for n in ("all", "pre_etf", "post_etf")]
    rows = with_grid(trades, names).filter("name = 'all' OR name = regime")
    agg = rows.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean_net"), F.avg((F.col("net") < 0).cast("double")).alias("frac_losing"),
        F.greatest(F.lit(0.0), -F.min("net")).alias("worst_loss"),
    )
    found = agg.join(additive_drawdown(rows, "net", order, ["name"]), "name").withColumn(
        "margin_multiple", F.col("worst_loss") / margin
    )
    every = with_grid(trades.sparkSession.range(1), names).select("name")
    numbers = [c for c in found.columns if c != "name"]
    return every.join(found, "name", "left").select("name", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in numbers])
