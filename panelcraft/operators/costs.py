"""Cost tables and cost expressions, all as fractions of one leg's notional."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import HOURS_PER_YEAR
from ..functions.windows import with_grid

BPS = 10_000.0
# Venue fee schedules in basis points (name, tradeable, spot taker, spot maker, perpetual
# taker, perpetual maker), the assumed half-spreads, and the yearly rate on tied-up capital.
VENUES = (
    ("kraken", True, 26.0, 16.0, 5.0, 2.0),
    ("hyperliquid", True, 26.0, 16.0, 4.5, 1.5),
    ("binance_reference", False, 10.0, 10.0, 5.0, 2.0),
    ("okx_reference", False, 10.0, 8.0, 5.0, 2.0),
)
SPOT_HALF_SPREAD_BPS = 2.0
PERP_HALF_SPREAD_BPS = 1.5
CAPITAL_RATE = 0.04
CAPITAL_MULTIPLES = (1.0, 2.0)
# Option fee schedule in basis points of the underlying, the fee cap as a share of the
# premium, the margin share, the yearly rate on it, and crash scenarios.
OPTION_FEE_BPS = 3.0
OPTION_FEE_CAP = 0.125
OPTION_DELIVERY_BPS = 1.5
OPTION_SPREAD_FLOOR_BPS = 5.0
OPTION_ROUTING_BPS = 0.0
HEDGE_TAKER_BPS = 5.0
HEDGE_MAKER_BPS = 0.0
HEDGE_HALF_SPREAD_BPS = 1.5
OPTION_MARGIN = 0.15
SHOCKS = (0.37, 0.50)


def leg_cost(fee_bps: float, half_spread_bps: float) -> float:
    return (fee_bps + half_spread_bps) / BPS


def venue_rows(entry_taker: bool = True, exit_taker: bool = True, measured: Sequence[str] = ()) -> list[dict[str, object]]:
    """Per venue: spot-leg cost, entry, exit and round-trip cost, and whether its spread is only assumed."""
    rows = []
    for name, tradeable, spot_taker, spot_maker, perp_taker, perp_maker in VENUES:
        def side(taker: bool) -> float:
            spot = leg_cost(spot_taker if taker else spot_maker, SPOT_HALF_SPREAD_BPS)
            return spot + leg_cost(perp_taker if taker else perp_maker, PERP_HALF_SPREAD_BPS)

        entry, exit_ = side(entry_taker), side(exit_taker)
        rows.append({
            "venue": name, "tradeable": tradeable,
            "spot_leg_cost": leg_cost(spot_taker if entry_taker else spot_maker, SPOT_HALF_SPREAD_BPS),
            "entry_cost": entry, "exit_cost": exit_, "round_trip_cost": entry + exit_,
            "provisional": name not in measured,
        })
    return rows


def with_venues(df: DataFrame, entry_taker: bool = True, exit_taker: bool = True) -> DataFrame:
    """Every row once per venue, with the venue's costs."""
    return with_grid(df, venue_rows(entry_taker, exit_taker))


def financing_cost(hold_hours: Column, capital_multiple: Column, rate: float = CAPITAL_RATE) -> Column:
    """Cost of tied-up capital over the real holding time; a negative hold raises."""
    cost = rate * capital_multiple * (hold_hours / HOURS_PER_YEAR)
    return F.when(hold_hours >= 0, cost).when(hold_hours.isNull(), F.lit(None)).otherwise(
        F.raise_error(F.lit("negative holding time"))
    )


def hedge_side_cost(abs_delta: Column, taker: bool = True) -> Column:
    fee = HEDGE_TAKER_BPS if taker else HEDGE_MAKER_BPS
    return abs_delta * leg_cost(fee, HEDGE_HALF_SPREAD_BPS)


def delivery_fee(payoff: Column) -> Column:
    """Settlement fee on the coin payoff: the flat rate, capped at a share of the payoff."""
    return F.least(F.lit(OPTION_DELIVERY_BPS / BPS), OPTION_FEE_CAP * payoff)


def margin_financing(hold_hours: Column) -> Column:
    return CAPITAL_RATE * OPTION_MARGIN * (hold_hours / HOURS_PER_YEAR)
