"""Panel, event, chain and return tables derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.panel import settled_events
from ..functions.windows import over
from .registry import cte


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def round_to(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        "l_returnflag", F.col("l_shipdate").cast("date").alias("date"),
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "px", 100.0 * F.pow(F.col("l_extendedprice") / F.col("l_quantity") / 1000.0, F.lit(0.05))
    )


cte("ticks", """
SELECT p_brand, p_type, l_returnflag, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey,
       l_suppkey, l_extendedprice, l_quantity,
       100.0 * power(l_extendedprice / l_quantity / 1000.0, 0.05) AS px
FROM lineitem JOIN part ON l_partkey = p_partkey""")


def bars(spark: SparkSession, sf: str, symbol: str = "p_brand") -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ticks(spark, sf).groupBy(F.col(symbol).alias("symbol"), "date").agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", order).alias("close"), F.sum("l_extendedprice").alias("dollar_volume"),
    )


def bars_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of three symbols, one of which trades on every day."""
    lines = table(spark, sf, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    px = 100.0 * F.pow(F.col("l_extendedprice") / F.col("l_quantity") / 1000.0, F.lit(0.05))
    return lines.withColumn("px", px).groupBy(
        F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", order).alias("close"), F.sum("l_extendedprice").alias("dollar_volume"),
    )


_BARS = """
SELECT {symbol} AS symbol, date,
       arg_min(px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS open,
       max(px) AS high, min(px) AS low,
       arg_max(px, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS close,
       sum(l_extendedprice) AS dollar_volume
FROM ticks GROUP BY 1, 2"""
cte("bars", _BARS.format(symbol="p_brand"))
cte("bars_strict", _BARS.format(symbol="l_returnflag"))


def funding(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey") % 40).alias("symbol"),
        F.concat(F.lit("V"), F.col("o_custkey") % 2).alias("venue"),
        F.col("o_orderdate").alias("ts"),
        ((F.col("o_totalprice") - 150000.0) / 1e8).alias("rate"),
        F.when(F.col("o_orderpriority").startswith("1"), 4).otherwise(8).alias("interval_hours"),
        (F.col("o_orderstatus") != "P").alias("realized"),
        F.col("o_orderkey").alias("ingest"),
    )


cte("funding", """
SELECT 'C' || (o_custkey % 40) AS symbol, 'V' || (o_custkey % 2) AS venue, o_orderdate AS ts,
       (o_totalprice - 150000.0) / 1e8 AS rate,
       CASE WHEN starts_with(o_orderpriority, '1') THEN 4 ELSE 8 END AS interval_hours,
       o_orderstatus <> 'P' AS realized, o_orderkey AS ingest
FROM orders""")
cte("settled", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY realized DESC, ingest) AS rn FROM funding)
WHERE rn = 1""")


def settled(spark: SparkSession, sf: str) -> DataFrame:
    return settled_events(funding(spark, sf))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Settled funding observations with a perpetual and a spot price, numbered per symbol."""
    events = settled_events(funding(spark, sf).filter("realized"))
    idx = F.row_number().over(over(["symbol"], "ts")) - 1
    spot = 100.0 + 10.0 * F.sin(F.col("idx") / 7.0)
    return (
        events.withColumn("idx", idx).withColumn("spot_close", spot)
        .select(
            "symbol", "idx", F.col("ts").alias("dt"), F.col("rate").alias("funding_rate"),
            (F.col("spot_close") * (1.0 + F.col("rate"))).alias("perp_close"), "spot_close", "interval_hours",
        )
    )


cte("obs", """
SELECT symbol, idx, dt, funding_rate, spot_close * (1.0 + funding_rate) AS perp_close, spot_close, interval_hours
FROM (SELECT *, 100.0 + 10.0 * sin(idx / 7.0) AS spot_close FROM (
  SELECT symbol, ts AS dt, rate AS funding_rate, interval_hours,
         row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx
  FROM settled WHERE realized))""")


def all_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of every kind."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("key"), "ts", F.col("value").alias("close"), F.col("event_id").alias("ingest"), F.col("event_type").alias("kind")
    )


def quotes(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return all_quotes(spark, sf).filter(F.col("kind") == kind).drop("kind")


cte("quotes", "SELECT user_id AS key, ts, value AS close, event_id AS ingest, event_type AS kind FROM events")


def asset_ret(spark: SparkSession, sf: str) -> DataFrame:
    daily = ticks(spark, sf).groupBy(F.col("p_type").alias("asset"), "date").agg(
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("a")
    )
    ret = 0.02 * F.ln(F.col("a") / F.lag("a").over(over(["asset"], "date")))
    return daily.withColumn("ret", ret).filter("ret IS NOT NULL").select("asset", "date", "ret")


cte("asset_ret", """
SELECT asset, date, ret FROM (
  SELECT asset, date, 0.02 * ln(a / lag(a) OVER (PARTITION BY asset ORDER BY date)) AS ret FROM (
    SELECT p_type AS asset, date, avg(l_extendedprice / l_quantity) AS a FROM ticks GROUP BY 1, 2))
WHERE ret IS NOT NULL""")


def rate_curve(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        (0.02 + F.avg("l_discount")).alias("bond_yield")
    )


cte("rate_curve", "SELECT CAST(l_shipdate AS DATE) AS date, 0.02 + avg(l_discount) AS bond_yield FROM lineitem GROUP BY 1")


def macro_panel(spark: SparkSession, sf: str) -> DataFrame:
    equity = asset_ret(spark, sf).groupBy("date").agg(F.avg("ret").alias("equity_ret"))
    return equity.join(rate_curve(spark, sf), "date").select(
        "date", "equity_ret", F.lit(0.0001).alias("cash_ret"), "bond_yield"
    )


cte("macro_panel", """
SELECT date, equity_ret, 0.0001::DOUBLE AS cash_ret, bond_yield
FROM (SELECT date, avg(ret) AS equity_ret FROM asset_ret GROUP BY 1) JOIN rate_curve USING (date)""")

# Which asset stands in for which factor.
FACTOR_OF_ASSET = {"ECONOMY": "smb", "LARGE": "hml", "MEDIUM": "rmw", "PROMO": "cma", "SMALL": "wml"}


def factors(spark: SparkSession, sf: str) -> DataFrame:
    """Long factor returns (factor, date, ret): each asset minus the mean of all assets that day."""
    mean = F.avg("ret").over(Window.partitionBy("date"))
    name = F.create_map(*[F.lit(x) for kv in FACTOR_OF_ASSET.items() for x in kv])
    return (
        asset_ret(spark, sf).withColumn("ret", F.col("ret") - mean)
        .withColumn("factor", F.element_at(name, F.col("asset"))).filter("factor IS NOT NULL")
        .select("factor", "date", "ret")
    )


cte("factors", """
SELECT CASE asset WHEN 'ECONOMY' THEN 'smb' WHEN 'LARGE' THEN 'hml' WHEN 'MEDIUM' THEN 'rmw'
                  WHEN 'PROMO' THEN 'cma' ELSE 'wml' END AS factor, date, ret
FROM (SELECT asset, date, ret - avg(ret) OVER (PARTITION BY date) AS ret FROM asset_ret)
WHERE asset IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL')""")


def tilt_base(spark: SparkSession, sf: str) -> DataFrame:
    """Market and factor columns by date, on the days that have all of them."""
    wide = factors(spark, sf).groupBy("date").pivot("factor", ["smb", "hml", "rmw", "cma"]).agg(F.first("ret"))
    market = macro_panel(spark, sf).select(
        "date", (F.col("equity_ret") - F.col("cash_ret")).alias("mkt_rf"), F.col("cash_ret").alias("rf")
    )
    return wide.join(market, "date").dropna()


def tilt_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Long portfolio panel with market and factor columns, one portfolio per asset.

    Each loads 0.3 on `rmw`, and has its asset's return of the day before as noise: that of the same day would
    be a combination of the factors, which are made of the assets, and leave nothing to estimate an error from.
    """
    noise = asset_ret(spark, sf).withColumn("ret", F.lag("ret").over(over(["asset"], "date"))).filter("ret IS NOT NULL")
    ret = F.col("rf") + F.col("mkt_rf") + 0.3 * F.col("rmw") + 0.05 * F.col("ret")
    return noise.join(tilt_base(spark, sf), "date").select(
        F.lower("asset").alias("portfolio"), "date", ret.alias("ret"), "mkt_rf", "smb", "hml", "rmw", "cma", "rf"
    )


cte("tilt_base", """
SELECT f.date, mkt_rf, smb, hml, rmw, cma, rf FROM (
  SELECT date, max(ret) FILTER (factor = 'smb') AS smb, max(ret) FILTER (factor = 'hml') AS hml,
         max(ret) FILTER (factor = 'rmw') AS rmw, max(ret) FILTER (factor = 'cma') AS cma
  FROM factors GROUP BY 1) f
JOIN (SELECT date, equity_ret - cash_ret AS mkt_rf, cash_ret AS rf FROM macro_panel) m USING (date)
WHERE smb IS NOT NULL AND hml IS NOT NULL AND rmw IS NOT NULL AND cma IS NOT NULL""")
cte("tilt_panel", """
SELECT lower(asset) AS portfolio, date, rf + mkt_rf + 0.3 * rmw + 0.05 * ret AS ret, mkt_rf, smb, hml, rmw, cma, rf
FROM (SELECT asset, date, lag(ret) OVER (PARTITION BY asset ORDER BY date) AS ret FROM asset_ret) JOIN tilt_base USING (date) WHERE ret IS NOT NULL""")


def numbered(df: DataFrame, key: str, ret: str = "ret", dt: str = "date") -> DataFrame:
    """A return table as (series_id, idx, dt, ret)."""
    idx = F.row_number().over(over([key], dt)) - 1
    return df.select(
        F.col(key).cast("string").alias("series_id"), idx.alias("idx"), F.col(dt).alias("dt"), F.col(ret).alias("ret")
    )


def bar_series(spark: SparkSession, sf: str) -> DataFrame:
    """Daily log returns per symbol."""
    ret = F.ln(F.col("close") / F.lag("close").over(over(["symbol"], "date")))
    return numbered(bars(spark, sf).withColumn("ret", ret).filter("ret IS NOT NULL"), "symbol")


cte("bar_series", """
SELECT symbol AS series_id, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx, date AS dt, ret
FROM (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS ret FROM bars)
WHERE ret IS NOT NULL""")


def asset_series(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(asset_ret(spark, sf), "asset")


cte("asset_series", """
SELECT asset AS series_id, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS idx, date AS dt, ret
FROM asset_ret""")


def chain(spark: SparkSession, sf: str, events: DataFrame | None = None) -> DataFrame:
    """Option quotes: one instrument per part, around one underlying level, some without a bid.

    However many parts there are, a strike and expiry has one call and one put.

    Another table of events, such as a stream, can stand in for the stored one.
    """
    events = table(spark, sf, "events") if events is None else events
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    level = parts.agg(F.avg("p_retailprice")).scalar()
    half = F.floor(F.col("p_partkey") / 2)
    premium = 0.01 + F.col("value") / 1e5
    sign = F.when(F.col("p_partkey") % 2 == 0, 1.0).otherwise(-1.0)
    joined = events.join(parts, F.col("user_id") == F.col("p_partkey"))
    return joined.withColumn("underlying", level).select(
        F.concat(F.lit("I"), "p_partkey").alias("instrument"), "ts",
        F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("type"),
        (F.round(F.col("underlying") * (0.8 + 0.02 * (half % 21)), 0) + 0.01 * F.floor(half / 63)).alias("strike"),
        F.date_add(F.lit("2024-02-15").cast("date"), (30 * (F.floor(F.col("p_partkey") / 42) % 3)).cast("int")).alias("expiry"),
        "underlying", F.when(F.col("event_id") % 17 != 0, premium).alias("bid"), (premium * 1.02).alias("mark"),
        (sign * F.least(F.lit(0.95), (1.0 + F.col("p_size")) / 60.0)).alias("delta"),
        F.col("event_id").alias("ingest"),
    )


cte("chain", """
SELECT 'I' || p_partkey AS instrument, ts, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS type,
       round(underlying * (0.8::DOUBLE + 0.02::DOUBLE * ((p_partkey // 2) % 21)), 0) + 0.01::DOUBLE * (p_partkey // 126) AS strike,
       DATE '2024-02-15' + CAST(30 * ((p_partkey // 42) % 3) AS INTEGER) AS expiry, underlying,
       CASE WHEN event_id % 17 <> 0 THEN 0.01::DOUBLE + value / 1e5 END AS bid,
       (0.01::DOUBLE + value / 1e5) * 1.02::DOUBLE AS mark,
       CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END * least(0.95::DOUBLE, (1.0::DOUBLE + p_size) / 60.0::DOUBLE) AS delta,
       event_id AS ingest
FROM events JOIN part ON user_id = p_partkey, (SELECT avg(p_retailprice) AS underlying FROM part)""")


def index_level(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(
        (50.0 + 10.0 * F.avg("value") / 250.0).alias("dvol_close")
    )


cte("index_level", "SELECT CAST(ts AS DATE) AS date, 50.0::DOUBLE + 10.0::DOUBLE * avg(value) / 250.0::DOUBLE AS dvol_close FROM events GROUP BY 1")
