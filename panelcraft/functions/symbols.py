"""Instrument-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Quote suffixes in matching order, pegged bases, leveraged-product suffixes.
QUOTES = ("USDT", "USDC", "BUSD", "USD")
STABLE_OR_FIAT = (
    "USDC", "BUSD", "TUSD", "FDUSD", "USDP", "DAI", "UST", "USTC", "GUSD", "USDD",
    "USD1", "PYUSD", "USDE", "SUSD", "FRAX", "LUSD", "USDS", "FDUSDT",
    "EUR", "GBP", "AUD", "TRY", "BRL", "RUB", "JPY", "AEUR", "EURI", "USTRY",
)
LEVERAGED_SUFFIXES = ("BULL", "BEAR", "3L", "3S", "4L", "4S", "5L", "5S")
DIRECTION_SUFFIXES = ("UP", "DOWN")


def canonical(symbol: Column, strict: bool = True) -> Column:
    """Base asset across the three naming conventions: `BASE-QUOTE-SWAP`, `BASEQUOTE`, `BASE`.

    A name of none of these shapes raises, or gives NULL when not strict.
    """
    s = F.upper(F.trim(symbol))
    dashed = F.split(s, "-")[0]
    suffixed = F.regexp_extract(s, f"^(.+?)({'|'.join(QUOTES)})$", 1)
    miss = F.raise_error(F.concat(F.lit("no canonical base for "), symbol)) if strict else F.lit(None)
    return (
        F.when(s.contains("-") & (dashed != ""), dashed)
        .when(~s.contains("-") & (suffixed != ""), suffixed)
        .when(s.rlike("^[A-Z]+$"), s)
        .otherwise(miss.cast("string"))
    )


def base_of(symbol: Column, quote: str = "USDT") -> Column:
    """The symbol without its quote suffix; a bare quote stays as it is."""
    stripped = symbol.substr(F.lit(1), F.length(symbol) - F.lit(len(quote)))
    return F.when(symbol.endswith(quote) & (F.length(symbol) > len(quote)), stripped).otherwise(symbol)
