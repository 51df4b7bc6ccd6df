"""Source and streaming queries. Raw files are written from the driver's tables into the shared folder,
then read back through the sources, so the work grows with the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.calendar import mixed_epoch_ms
from ..sources import landed as L
from ..sources.archives import write_zipped_lines
from ..sources.sizing import n_tasks, sized, sized_tasks
from ..streaming import jobs as J
from .inputs import bars, chain, factors, funding, rate_curve, round_to, table
from .registry import cte, query
from .stage import scratch_path, stage
from .trades import AS_OF

# ---- files ----------------------------------------------------------------------------------------
# The driver's days lie before the epoch range the readers accept, so dumps carry them moved on by this much.
SHIFT_DAYS = 9132
SHIFT_MS = SHIFT_DAYS * 86_400_000


def _unshifted(ts: Column) -> Column:
    return ts.cast("timestamp_ntz") - F.expr(f"INTERVAL {SHIFT_DAYS} DAYS")


def _epoch_ms(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000)


#: Landed rows per write task and archive: a dump of a busy symbol and month comes in several pieces.
PIECE_ROWS = 50_000
_FUNDING_SQL = """
SELECT 'C' || (o_custkey % 2) AS symbol, strftime(o_orderdate, '%Y-%m') AS month, o_orderdate AS ts, round((o_totalprice - 150000.0) / 1e8, 10) AS rate, 8 AS interval_hours, true AS realized FROM orders"""
_KLINE_SQL = """
SELECT symbol, date::TIMESTAMP AS ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(dollar_volume, 2) AS quote_volume
FROM (SELECT replace(symbol, '#', '') AS symbol, * EXCLUDE (symbol) FROM bars)"""


def funding_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of funding dumps per symbol and month."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey") % 2, F.lit("-fundingRate-"), F.date_format("o_orderdate", "yyyy-MM")).alias("file"),
        (_epoch_ms(F.col("o_orderdate")) + SHIFT_MS).alias("calc_time"), F.lit(8).alias("funding_interval_hours"),
        ((F.col("o_totalprice") - 150000.0) / 1e8).cast("decimal(20,10)").alias("last_funding_rate"),
    )


def kline_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of kline dumps, half of them with a header row, on a clock that turns from milliseconds to microseconds."""
    rows = bars(spark, sf).withColumn("symbol", F.replace("symbol", F.lit("#"), F.lit("")))
    ms = _epoch_ms(F.col("date").cast("timestamp")) + SHIFT_MS
    stamp = F.when(F.col("date") < F.lit("1999-01-01").cast("date"), ms).otherwise(ms * 1000)
    values = [F.format_string("%.12f", F.col(c)) for c in ("open", "high", "low", "close")]
    line = F.concat_ws(",", stamp, *values, F.lit("1"), stamp, F.format_string("%.2f", "dollar_volume"), F.lit("9"))
    data = rows.select(F.concat("symbol", F.lit("-klines-1d")).alias("file"), line.alias("value"))
    heads = table(spark, sf, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("-klines-1d")).alias("file")).distinct().filter("length(file) % 2 = 0")
    return data.unionByName(heads.withColumn("value", F.lit("open_time,open,high,low,close,volume,close_time,quote_volume,count")))


def land_archives(spark: SparkSession, lines: DataFrame, name: str, header: str | None = None) -> str:
    """Lines (file, value) as zip archives named after their file and piece, every member under the header if there is one."""
    path = scratch_path(spark, name)
    rows, plan = sized_tasks(lines, "file", PIECE_ROWS)
    rows = rows.select("file", "_piece", "_task", F.lit(1).alias("_k"), "value")
    if header:
        heads = [(key, piece, first + piece, 0, header) for key, first, pieces in plan for piece in range(pieces)]
        rows = rows.unionByName(spark.createDataFrame(heads, "file string, _piece int, _task int, _k int, value string"))
    rows = rows.withColumn("name", F.concat_ws("-", "file", "_piece")).repartitionById(n_tasks(plan), F.col("_task")).sortWithinPartitions("name", "_k", "value")
    write_zipped_lines(rows.select(F.concat("name", F.lit(".zip")).alias("archive"), F.concat("name", F.lit(".csv")).alias("member"), "value"), path)
    return path


FUNDING_HEAD = ",".join(part.split()[0] for part in L.FUNDING_HEADER.split(", "))


def land_funding_archives(spark: SparkSession, sf: str) -> str:
    lines = funding_dumps(spark, sf).select("file", F.concat_ws(",", "calc_time", "funding_interval_hours", "last_funding_rate").alias("value"))
    return land_archives(spark, lines, "funding_zip", FUNDING_HEAD)


@query("src01_funding_files", _FUNDING_SQL)
def src01(spark, sf):
    path = scratch_path(spark, "funding")
    sized(funding_dumps(spark, sf), "file", PIECE_ROWS).write.partitionBy("file").option("header", True).csv(path)
    return round_to(L.read_funding(spark, path).withColumn("ts", _unshifted(F.col("ts"))), 10, "rate")


@query("src01_funding_archives", _FUNDING_SQL)
def src01_archives(spark, sf):
    rows = L.read_funding_archives(spark, land_funding_archives(spark, sf))
    return round_to(rows.withColumn("ts", _unshifted(F.col("ts"))), 10, "rate")


@query("src02_kline_files", _KLINE_SQL)
def src02(spark, sf):
    path = scratch_path(spark, "klines")
    sized(kline_dumps(spark, sf), "file", PIECE_ROWS).write.partitionBy("file").text(path)
    out = L.read_klines(spark, path).withColumn("ts", _unshifted(F.col("ts")))
    return round_to(round_to(out, 6, "open", "high", "low", "close"), 2, "quote_volume")


@query("src02_kline_archives", _KLINE_SQL)
def src02_archives(spark, sf):
    out = L.read_kline_archives(spark, land_archives(spark, kline_dumps(spark, sf), "klines_zip"))
    out = out.withColumn("ts", _unshifted(F.col("ts")))
    return round_to(round_to(out, 6, "open", "high", "low", "close"), 2, "quote_volume")


@query("src03_mixed_epochs", """
SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events""")
def src03(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 2 == 0, us).otherwise(F.floor(us / 1000)).cast("string")
    return table(spark, sf, "events").select("event_id", mixed_epoch_ms(raw).alias("ms"))


@query("src04_month_window", """
SELECT symbol, ts, round(rate, 10) AS rate, ingest FROM funding WHERE ts >= TIMESTAMP '1996-02-10' AND ts < TIMESTAMP '1999-05-20'""")
def src04(spark, sf):
    path = scratch_path(spark, "months")
    rows = funding(spark, sf).select("symbol", "ts", "rate", "ingest").withColumn("month", F.date_format("ts", "yyyy-MM"))
    sized(rows, "month", PIECE_ROWS).write.partitionBy("month").parquet(path)
    out = L.read_months(spark, path, rows.schema, "1996-02-10", "1999-05-20")
    return round_to(out.select("symbol", "ts", "rate", "ingest"), 10, "rate")


@query("src05_option_files", """
SELECT instrument, ts, type, strike, expiry::TIMESTAMP AS expiry, round(underlying, 6) AS underlying, round(bid, 8) AS bid, round(mark, 8) AS mark, round(delta, 8) AS delta FROM chain""")
def src05(spark, sf):
    """A chain dump with empty bid and greek cells, read back typed."""
    path = scratch_path(spark, "chain")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    filled = {
        "exchange": F.lit("x"), "symbol": F.col("instrument"), "timestamp": us, "local_timestamp": us, "type": F.col("type"), "strike_price": F.col("strike"),
        "expiration": F.unix_micros(F.col("expiry").cast("timestamp")), "bid_price": F.col("bid"), "mark_price": F.col("mark"),
        "underlying_index": F.lit("SYN.A"), "underlying_price": F.col("underlying"), "delta": F.col("delta"),
    }
    names = [part.split()[0] for part in L.OPTION_HEADER.split(", ")]
    rows = chain(spark, sf).select(*[filled.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    rows.write.option("header", True).csv(path)
    out = L.read_option_chain(spark, path).select("instrument", "ts", "type", "strike", "expiry", "underlying", "bid", "mark", "delta")
    out = out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "expiry")})
    return round_to(round_to(out, 8, "bid", "mark", "delta"), 6, "underlying")


FACTORS = ("smb", "hml", "rmw", "cma", "wml")


def factor_wide(spark, sf):
    return factors(spark, sf).groupBy("date").pivot("factor", list(FACTORS)).agg(F.first("ret")).dropna()


def factor_line(scale: float) -> Column:
    return F.concat_ws(",", F.date_format("date", "yyyyMMdd"), *[F.format_string("%16.12f", scale * F.col(c)) for c in FACTORS])


cte("factor_wide", """
SELECT date, smb, hml, rmw, cma, wml FROM (
  SELECT date, max(ret) FILTER (factor = 'smb') AS smb, max(ret) FILTER (factor = 'hml') AS hml, max(ret) FILTER (factor = 'rmw') AS rmw,
         max(ret) FILTER (factor = 'cma') AS cma, max(ret) FILTER (factor = 'wml') AS wml FROM factors GROUP BY 1)
WHERE smb IS NOT NULL AND hml IS NOT NULL AND rmw IS NOT NULL AND cma IS NOT NULL AND wml IS NOT NULL""")
_FACTOR_SQL = "SELECT date, " + ", ".join(f"round({c}, 8) AS {c}" for c in FACTORS) + " FROM factor_wide"


@query("src06_factor_text", _FACTOR_SQL)
def src06(spark, sf):
    path = scratch_path(spark, "factors")
    lines = factor_wide(spark, sf).select(factor_line(100.0).alias("value"))
    preamble = lines.limit(1).select(F.explode(F.array(F.lit("This file holds daily factors."), F.lit(""), F.lit(",SMB,HML,RMW,CMA,WML"))).alias("value"))
    lines.unionByName(preamble).write.text(path)
    return round_to(L.read_factors(spark, path, FACTORS), 8, *FACTORS)


def land_sections(spark, sf) -> str:
    """One file per year with two titled blocks; the second block holds doubled values. The year bounds a file."""
    path = scratch_path(spark, "sections")
    blocks = F.array(*[F.struct(F.lit(i).alias("block"), factor_line(i * 100.0).alias("value")) for i in (1, 2)])
    rows = factor_wide(spark, sf).select(F.year("date").alias("year"), F.explode(blocks).alias("b")).select("year", "b.block", F.lit(1).alias("k"), "b.value")
    heads = rows.select("year", "block").distinct().select("year", "block", F.lit(0).alias("k"), F.concat(F.lit("  Average Returns -- Daily "), "block").alias("value"))
    files = rows.unionByName(heads).repartition("year").sortWithinPartitions("year", "block", "k", "value")
    files.select("year", "value").write.partitionBy("year").text(path)
    return path


@query("src07_first_section", _FACTOR_SQL)
def src07(spark, sf):
    return round_to(L.read_first_section(spark, land_sections(spark, sf), "Average Returns", FACTORS), 8, *FACTORS)


@query("src07_two_sections", "SELECT date, " + ", ".join(f"round({c}, 7) AS {c}, round(2 * {c}, 7) AS {c}_2" for c in FACTORS) + " FROM factor_wide")
def src07_two(spark, sf):
    out = L.read_two_sections(spark, land_sections(spark, sf), "Average Returns", FACTORS, FACTORS, FACTORS)
    return round_to(out, 7, *FACTORS, *[f"{c}_2" for c in FACTORS])


@query("src08_rate_years", "SELECT date, round(bond_yield, 8) AS rate FROM rate_curve")
def src08(spark, sf):
    """Yearly files whose columns come in different orders and numbers, written and read as one job each."""
    path = scratch_path(spark, "rates")
    odd = F.col("year") % 2 == 1
    ten = F.format_string("%.10f", 100.0 * F.col("bond_yield"))
    day = F.date_format("date", "MM/dd/yyyy")
    curve = rate_curve(spark, sf).withColumn("year", F.year("date"))
    rows = curve.select("year", F.lit(1).alias("k"), F.when(odd, F.concat_ws(",", day, F.lit("1.0"), ten)).otherwise(F.concat_ws(",", day, ten, F.lit("2.0"), F.lit(""))).alias("value"))
    heads = curve.select("year").distinct().select("year", F.lit(0).alias("k"), F.when(odd, 'Date,1 Mo,"10 Yr"').otherwise("Date,10 Yr,20 Yr,30 Yr").alias("value"))
    files = rows.unionByName(heads).repartition("year").sortWithinPartitions("year", "k", "value")
    files.select("year", "value").write.partitionBy("year").text(path)
    return round_to(L.read_rate_years(spark, path), 8, "rate")


@query("src09_index_pages", """
SELECT ms, round(arg_max(value, event_id), 4) AS close FROM (SELECT *, CAST(epoch_us(date_trunc('hour', ts)) // 1000 AS BIGINT) AS ms FROM events)
WHERE ms >= 1704412800000 AND ms < 1705968000000 GROUP BY 1""")
def src09(spark, sf):
    """JSON pages of candles in which stamps repeat; the last one counts."""
    path = scratch_path(spark, "pages")
    ms = _epoch_ms(F.date_trunc("hour", F.col("ts").cast("timestamp"))).cast("double")
    row = F.array(ms, F.col("value"), F.col("value") + 1, F.col("value") - 1, F.col("value"))
    rows = table(spark, sf, "events").select(F.floor(F.col("event_id") / 500).alias("page"), "event_id", row.alias("row"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "row"))), lambda s: s["row"])
    rows.groupBy("page").agg(data.alias("data")).write.json(path)
    return L.read_index_pages(spark, path, 1704412800000, 1705968000000).select("ms", F.round("close", 4).alias("close"))


@query("src10_settled_pages", """
SELECT symbol, ts, round(rate, 10) AS rate FROM funding WHERE realized AND interval_hours = 8 AND ts < TIMESTAMP '2000-01-01'""")
def src10(spark, sf):
    """JSON pages that mix settled, estimated, foreign-method and future rows."""
    path = scratch_path(spark, "settled")
    r = F.struct(
        F.col("symbol").alias("instId"), F.when(F.col("realized"), F.format_string("%.10f", "rate")).otherwise("").alias("realizedRate"),
        F.when(F.col("interval_hours") == 8, "current_period").otherwise("next_period").alias("method"),
        (_epoch_ms(F.col("ts")) + SHIFT_MS).cast("string").alias("fundingTime"), F.lit("x").alias("extra"),
    )
    funding(spark, sf).groupBy(F.floor(F.col("ingest") / 400).alias("page")).agg(F.collect_list(r).alias("data")).write.json(path)
    out = L.read_settled_pages(spark, path, 946684800000 + SHIFT_MS).withColumn("ts", _unshifted(F.col("ts")))
    return round_to(out, 10, "rate")


@query("src11_panel_round_trip", """
SELECT symbol, date, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, round(dollar_volume, 2) AS dollar_volume FROM bars""")
def src11(spark, sf):
    path, panel = scratch_path(spark, "panel"), bars(spark, sf).drop("open")
    L.write_panel(panel, path, "symbol", ["date"])
    return round_to(round_to(L.read_panel(spark, path, panel.schema), 6, "close", "high", "low"), 2, "dollar_volume")


@query("src13_file_audit", r"""
SELECT file_name, CASE m WHEN '02' THEN 'missing' WHEN '03' THEN 'unlisted' WHEN '05' THEN 'size_differs' WHEN '07' THEN 'hash_differs'
                         WHEN '08' THEN 'vendor_differs' WHEN '11' THEN 'vendor_unlisted' ELSE 'ok' END AS status
FROM (SELECT *, regexp_extract(file_name, '-fundingRate-\d{4}-(\d{2})', 1) AS m FROM (
  SELECT DISTINCT 'C' || (o_custkey % 2) || '-fundingRate-' || strftime(o_orderdate, '%Y-%m') || '-0.zip' AS file_name FROM orders))""")
def src13(spark, sf):
    """Landed archives against a manifest and the vendor's checksum list, with something wrong in half of the months."""
    known = stage(L.file_digests(spark, land_funding_archives(spark, sf), "*.zip"), "digests").withColumn("m", F.regexp_extract("file_name", r"-fundingRate-\d{4}-(\d{2})", 1))
    landed = known.filter("m <> '02'")
    manifest = known.filter("m <> '03'").select(
        "file_name", F.when(F.col("m") == "07", F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"), (F.col("size_bytes") + (F.col("m") == "05").cast("int")).alias("size_bytes"))
    path = scratch_path(spark, "checksums")
    given = F.when(F.col("m") == "08", F.reverse("sha256")).otherwise(F.upper("sha256"))
    known.filter("m NOT IN ('03', '11')").select(F.concat(given, F.lit("  "), "file_name").alias("value")).write.text(path)
    return L.audit_files(landed, manifest, L.checksum_lines(spark.read.text(path))).select("file_name", "status")


# ---- streams --------------------------------------------------------------------------------------


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def out_of_order(spark: SparkSession, rows: DataFrame, name: str, key: str, triggers: int = 6) -> DataFrame:
    """A stream of the rows in files that each hold some of every day, a few files to a trigger."""
    path, files = scratch_path(spark, name), 2 * max(triggers, rows.sparkSession.sparkContext.defaultParallelism)
    rows.repartition(files, F.xxhash64(key)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // triggers)).parquet(path)


def streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The table a stream leaves behind after everything available has been processed."""
    root = scratch_path(spark, name)
    J.run_to_table(stream, f"{root}/out", f"{root}/log")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def kept_up(spark: SparkSession, stream: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """The rows a stream has arrived at, open windows included."""
    root = scratch_path(spark, name)
    J.run_to_updates(stream, f"{root}/out", f"{root}/log")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return J.current_rows(spark.read.schema(schema).parquet(f"{root}/out"), keys)


def _naive(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("str01_freshest_quotes_stream", """
SELECT instrument, w + INTERVAL 1 HOUR AS window_end, max(ts) AS ts, arg_max(ingest, row(ts, ingest)) AS ingest, round(arg_max(mark, row(ts, ingest)), 9) AS mark
FROM (SELECT *, date_trunc('hour', ts) AS w FROM chain) GROUP BY 1, 2""")
def str01(spark, sf):
    quotes = chain(spark, sf, stream_of(spark, sf, "events")).select("instrument", F.col("ts").cast("timestamp").alias("ts"), "mark", "ingest")
    out = _naive(kept_up(spark, J.freshest_quotes(quotes), "quotes", ["instrument", "window_end"]), "window_end", "ts")
    return round_to(out.select("instrument", "window_end", "ts", "ingest", "mark"), 9, "mark")


INSIDE = AS_OF[2][:14] + "25:00"


@query("str01_snapshot_from_stream", f"""
SELECT instrument, max(ts) AS ts, arg_max(ingest, row(ts, ingest)) AS ingest FROM chain WHERE ts <= TIMESTAMP '{INSIDE}' GROUP BY 1""")
def str01_snapshot(spark, sf):
    """As of an instant inside an hour."""
    def quotes(events=None):
        return chain(spark, sf, events).select("instrument", F.col("ts").cast("timestamp").alias("ts"), "ingest")

    windows = kept_up(spark, J.freshest_quotes(quotes(stream_of(spark, sf, "events"))), "quotes", ["instrument", "window_end"])
    return _naive(J.latest_as_of(windows, quotes(), INSIDE).select("instrument", "ts", "ingest"), "ts")


@query("str02_settled_stream", """
SELECT symbol, ts, round(arg_max(rate, row(realized::INT, -ingest)), 10) AS rate, bool_or(realized) AS realized,
       coalesce(min(rate) FILTER (realized) <> max(rate) FILTER (realized), false) AS conflict, count(*) AS n_rows
FROM funding GROUP BY 1, 2""")
def str02(spark, sf):
    """Events dealt to several triggers without regard to time, merged into a table."""
    events = table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey") % 40).alias("symbol"), F.col("o_orderdate").alias("ts"), ((F.col("o_totalprice") - 150000.0) / 1e8).alias("rate"),
        (F.col("o_orderstatus") != "P").alias("realized"), F.col("o_orderkey").alias("ingest"),
    )
    root = scratch_path(spark, "settled")
    kept = J.settled_table(f"{root}/table", buckets=16)
    kept.follow(J.settled_parts(out_of_order(spark, events, "events", "ingest")), f"{root}/log")
    return round_to(J.settled_rows(kept.read(spark)), 10, "rate")


cte("price_no", """
SELECT o_custkey AS symbol, o_orderdate AS ts, o_totalprice AS close,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice) AS rn FROM orders""")
cte("price_step", """
SELECT symbol, ts, close, rn, close AS ema, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn FROM price_no WHERE rn = 1 UNION ALL
SELECT n.symbol, n.ts, n.close, n.rn, 11.0::DOUBLE / 13 * s.ema + 2.0::DOUBLE / 13 * n.close,
       CASE WHEN s.rn = 1 THEN greatest(n.close - s.close, 0) ELSE 13.0::DOUBLE / 14 * s.up + greatest(n.close - s.close, 0) / 14 END,
       CASE WHEN s.rn = 1 THEN greatest(s.close - n.close, 0) ELSE 13.0::DOUBLE / 14 * s.dn + greatest(s.close - n.close, 0) / 14 END
FROM price_step s JOIN price_no n ON n.symbol = s.symbol AND n.rn = s.rn + 1""", recursive=True)


@query("str03_running_averages_stream", """
SELECT symbol, ts, CASE WHEN rn >= 12 THEN round(ema, 5) END AS ema, CASE WHEN rn > 14 THEN CASE WHEN dn = 0 THEN 100.0 ELSE round(100 - 100 / (1 + up / dn), 7) END END AS rsi
FROM price_step""")
def str03(spark, sf):
    """The later half of the orders as a stream that goes on from the state which the earlier half left."""
    prices = table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("close"))
    middle = prices.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).scalar()
    late = F.unix_micros(F.col("ts").cast("timestamp")) > middle
    path = scratch_path(spark, "prices")
    prices.withColumn("late", late).write.partitionBy("late").parquet(path)
    schema = prices.schema
    with J.keyed_state(spark):
        early = streamed(spark, J.running_averages(spark.readStream.schema(schema).parquet(f"{path}/late=false"), 12), "early")
        initial = J.averages_state(spark.read.schema(schema).parquet(f"{path}/late=false"), 12)
        rest = streamed(spark, J.running_averages(spark.readStream.schema(schema).parquet(f"{path}/late=true"), 12, initial=initial), "rest")
    out = early.unionByName(rest).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ema", "rsi")})
    return round_to(round_to(out, 5, "ema"), 7, "rsi")
