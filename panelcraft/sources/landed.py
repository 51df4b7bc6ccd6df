"""Readers of landed vendor files as typed DataFrames. Nothing is inferred; bad rows fail the read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.calendar import mixed_epoch_ms, ms_to_ts, us_to_ts
from ..operators.panel import keep_latest
from .archives import list_files, opened, read_zipped_lines
from .sizing import ROWS_PER_TASK, sized

# File layouts.
FUNDING_HEADER = "calc_time BIGINT, funding_interval_hours INT, last_funding_rate DECIMAL(38, 18)"
KLINE_FIELDS = {"close_time": 6, "open": 1, "high": 2, "low": 3, "close": 4, "quote_volume": 7}
OPTION_HEADER = (
    "exchange STRING, symbol STRING, timestamp BIGINT, local_timestamp BIGINT, type STRING, strike_price DOUBLE, expiration BIGINT, "
    "open_interest DOUBLE, last_price DOUBLE, bid_price DOUBLE, bid_amount DOUBLE, bid_iv DOUBLE, ask_price DOUBLE, ask_amount DOUBLE, "
    "ask_iv DOUBLE, mark_price DOUBLE, mark_iv DOUBLE, underlying_index STRING, underlying_price DOUBLE, delta DOUBLE, gamma DOUBLE, "
    "vega DOUBLE, theta DOUBLE, rho DOUBLE"
)
FACTOR_MISSING = -99.0


def _strict_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV whose header must equal the schema and whose every field must parse."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.csv(path if isinstance(path, str) else list(path))


def read_funding(spark: SparkSession, path: str) -> DataFrame:
    """Funding dumps whose file or folder is named `<symbol>-fundingRate-<month>`; every row is settled."""
    name = F.col("_metadata.file_path")
    return _strict_csv(spark, path, FUNDING_HEADER).select(
        F.regexp_extract(name, r"([^/=]+?)-fundingRate-", 1).alias("symbol"), F.regexp_extract(name, r"-fundingRate-(\d{4}-\d{2})", 1).alias("month"),
        ms_to_ts(F.col("calc_time")).alias("ts"), F.col("last_funding_rate").cast("double").alias("rate"),
        F.col("funding_interval_hours").alias("interval_hours"), F.lit(True).alias("realized"),
    )


def funding_of(rows: DataFrame, name: str) -> DataFrame:
    """Funding lines of text under a header row, with symbol and month from the column `name`."""
    fields = F.split("value", ",")
    header = ",".join(part.split()[0] for part in FUNDING_HEADER.split(", "))
    number = r"^-?[0-9]+(\.[0-9]+)?$"
    ok = (F.size(fields) == 3) & fields[0].rlike(number) & fields[1].rlike(number) & fields[2].rlike(number)
    bad = F.raise_error(F.lit("not a funding row")).cast("bigint")
    return rows.filter(F.col("value") != header).select(
        F.regexp_extract(name, r"([^/=]+?)-fundingRate-", 1).alias("symbol"), F.regexp_extract(name, r"-fundingRate-(\d{4}-\d{2})", 1).alias("month"),
        ms_to_ts(F.when(ok, fields[0].cast("bigint")).otherwise(bad)).alias("ts"), fields[2].cast("double").alias("rate"),
        fields[1].cast("int").alias("interval_hours"), F.lit(True).alias("realized"),
    )


def read_funding_archives(spark: SparkSession, path: str) -> DataFrame:
    """Funding dumps in zip archives whose members are named `<symbol>-fundingRate-<month>…`."""
    return funding_of(read_zipped_lines(spark, path, "*-fundingRate-*.zip"), "member")


def read_kline_archives(spark: SparkSession, path: str) -> DataFrame:
    """Kline dumps in zip archives whose members are named `<symbol>-klines…`."""
    lines = read_zipped_lines(spark, path, "*-klines-*.zip")
    return klines_of(lines.select(F.regexp_extract("member", r"([^/=]+?)-klines", 1).alias("symbol"), "value"))


def klines_of(lines: DataFrame) -> DataFrame:
    """Klines from lines of text with or without a header row, on mixed millisecond or microsecond clocks."""
    fields = F.split("value", ",")
    rows = lines.filter(fields[0].rlike("^-?[0-9]+$"))
    numbers = [fields[i].cast("double").alias(c) for c, i in KLINE_FIELDS.items() if c != "close_time"]
    stamp = F.timestamp_millis(mixed_epoch_ms(fields[KLINE_FIELDS["close_time"]])).alias("ts")
    return rows.select(*[c for c in lines.columns if c != "value"], stamp, *numbers)


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Kline dumps whose file or folder is named `<symbol>-klines…`."""
    lines = spark.read.text(path).withColumn("symbol", F.regexp_extract("_metadata.file_path", r"([^/=]+?)-klines", 1))
    return klines_of(lines.select("symbol", "value"))


def read_months(spark: SparkSession, path: str, schema: T.StructType, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows in [start, end) of a table partitioned by `month`; other partitions are never listed or read."""
    rows = spark.read.schema(schema).parquet(path)
    first, last = F.lit(start[:7]), F.lit(end[:7])
    return rows.filter((F.col("month") >= first) & (F.col("month") <= last)).filter(
        (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    )


def read_option_chain(spark: SparkSession, path: str) -> DataFrame:
    """Option-chain quotes; empty quote and greek cells are NULL, the others must be there."""
    raw = _strict_csv(spark, path, OPTION_HEADER)
    needed = ("symbol", "timestamp", "local_timestamp", "type", "strike_price", "expiration", "underlying_price")
    missing = F.raise_error(F.lit("option row lacks a required cell"))
    ok = F.lit(True)
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    return raw.select(
        F.when(ok, F.col("symbol")).otherwise(missing).alias("instrument"), us_to_ts(F.col("timestamp")).alias("ts"), us_to_ts(F.col("local_timestamp")).alias("arrival"),
        "type", F.col("strike_price").alias("strike"), us_to_ts(F.col("expiration")).alias("expiry"), F.col("underlying_price").alias("underlying"),
        "underlying_index", F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"), F.col("mark_price").alias("mark"), "delta", "gamma", "vega", "theta", "rho",
    )


def _percent(text: Column) -> Column:
    value = F.trim(text).cast("double")
    return F.when(value > FACTOR_MISSING, value / 100.0).otherwise(F.raise_error(F.lit("missing-value marker in factor file")))


def factor_rows(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Daily factor rows: lines that start with an eight-digit date, percent to decimal. Preambles fall away."""
    fields = F.split("value", ",")
    rows = lines.filter(F.trim(fields[0]).rlike("^[0-9]{8}$"))
    values = [_percent(fields[i + 1]).alias(c) for i, c in enumerate(columns)]
    return rows.select(*[c for c in lines.columns if c != "value"], F.to_date(F.trim(fields[0]), "yyyyMMdd").alias("date"), *values)


def read_factors(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A factor text file; a repeated date fails."""
    rows = factor_rows(spark.read.text(path), columns)
    grouped = rows.groupBy("date").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    repeated = F.raise_error(F.lit("repeated date in factor file")).cast("double")
    return grouped.select("date", *[F.when(F.col("_n") == 1, F.col(c)).otherwise(repeated).alias(c) for c in columns])


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file (`path`), the part of it a task reads (`block`) and their order inside (`at`)."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def read_sections(spark: SparkSession, path: str, title: str) -> DataFrame:
    """Lines of multi-section files with the number of the section they stand in (0 before the first title).

    Titles are counted per part of a file, the parts' counts are added up along the file, and lines are counted inside
    their own part. So a file is read in as many tasks as it has parts, and only one count per part crosses them.
    """
    lines = placed_lines(spark, path).withColumn("_title", F.col("value").rlike(title).cast("long"))
    along = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = lines.groupBy("path", "block").agg(F.sum("_title").alias("_n"))
    earlier = parts.select("path", "block", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = lines.withColumn("_here", F.sum("_title").over(inside)).join(earlier, ["path", "block"])
    return counted.select("path", "value", (F.col("_before") + F.col("_here")).alias("section"))


def read_first_section(spark: SparkSession, path: str, title: str, columns: Sequence[str]) -> DataFrame:
    """Only the first block of a multi-section factor file."""
    lines = read_sections(spark, path, title).filter("section = 1").select("value")
    return factor_rows(lines, columns)


def read_two_sections(spark: SparkSession, path: str, title: str, columns: Sequence[str], first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """Chosen columns of the first two blocks, joined by date; second-block columns get the suffix `_2`."""
    rows = factor_rows(read_sections(spark, path, title).select("section", "value"), columns)
    a = rows.filter("section = 1").select("date", *first)
    b = rows.filter("section = 2").select("date", *[F.col(c).alias(f"{c}_2") for c in second])
    return a.join(b, "date")


def cells(line: Column) -> Column:
    """Fields of a plain CSV line without surrounding blanks or quotes."""
    return F.transform(F.split(line, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))


def read_rate_years(spark: SparkSession, path: str, rate: str = "10 Yr", year: str = r"(\d{4})[^/]*(?:/[^/]*)?$") -> DataFrame:
    """Yearly rate files whose columns drift: `Date` and the rate are found by name in each file's first line, blanks are
    dropped, percent becomes decimal. All files are one job; what is looked up is two places per file.

    `year` takes a file's year from its path. A date outside it, a rate not above zero, a repeated date or a file without
    the columns fails.
    """
    lines = placed_lines(spark, path)
    heads = lines.groupBy("path").agg(F.min_by("value", F.struct("block", "at")).alias("_head"))
    place = {c: F.array_position(cells(F.col("_head")), name).cast("int") for c, name in (("_day", "Date"), ("_rate", rate))}
    bad = F.raise_error(F.lit("file lacks a needed column")).cast("int")
    known = heads.select("path", "_head", *[F.when(p > 0, p).otherwise(bad).alias(c) for c, p in place.items()])
    body = lines.join(known, "path").filter((F.col("value") != F.col("_head")) & (F.trim("value") != ""))
    found = body.select("path", F.get(cells(F.col("value")), F.col("_day") - 1).alias("d"), F.get(cells(F.col("value")), F.col("_rate") - 1).alias("v"))
    day, own = F.to_date("d", "MM/dd/yyyy"), F.regexp_extract("path", year, 1).cast("int")
    rows = found.filter(F.col("v") != "").select(
        F.when(F.year(day) == own, day).otherwise(F.raise_error(F.concat(F.lit("date outside "), own.cast("string"))).cast("date")).alias("date"),
        F.when(F.col("v").cast("double") > 0, F.col("v").cast("double") / 100.0).otherwise(F.raise_error(F.lit("rate not above zero")).cast("double")).alias("rate"),
    )
    once = rows.groupBy("date").agg(F.count(F.lit(1)).alias("_n"), F.first("rate").alias("rate"))
    return once.select("date", F.when(F.col("_n") == 1, F.col("rate")).otherwise(F.raise_error(F.lit("repeated date")).cast("double")).alias("rate"))


def read_index_pages(spark: SparkSession, path: str, start_ms: int, end_ms: int) -> DataFrame:
    """Index candles `[ts, open, high, low, close]` from landed JSON pages, in [start, end).

    Of repeated stamps the one from the later page, then the later place on it, stays.
    """
    pages = spark.read.schema("page BIGINT, data ARRAY<ARRAY<DOUBLE>>").option("mode", "FAILFAST").json(path)
    rows = pages.select("page", F.posexplode("data").alias("place", "row"))
    candles = rows.select(
        F.element_at("row", 1).cast("bigint").alias("ms"), F.element_at("row", 2).alias("open"), F.element_at("row", 3).alias("high"),
        F.element_at("row", 4).alias("low"), F.element_at("row", 5).alias("close"), F.struct("page", "place").alias("_at"),
    ).filter(F.col("ms").between(start_ms, end_ms - 1))
    return keep_latest(candles, ["ms"], F.col("_at")).drop("_at").withColumn("ts", ms_to_ts(F.col("ms")))


def read_settled_pages(spark: SparkSession, path: str, now_ms: int) -> DataFrame:
    """Funding rows from landed JSON pages that are settled: realised rate present, method
    `current_period`, settlement strictly before `now_ms`. Unknown fields are ignored."""
    schema = "data ARRAY<STRUCT<instId: STRING, realizedRate: STRING, method: STRING, fundingTime: STRING>>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(F.explode("data").alias("r")).select("r.*")
    settled = F.col("realizedRate").isNotNull() & (F.col("realizedRate") != "") & (F.col("method") == "current_period")
    return rows.filter(settled & (F.col("fundingTime").cast("bigint") < F.lit(now_ms))).select(
        F.col("instId").alias("symbol"), ms_to_ts(F.col("fundingTime")).alias("ts"), F.col("realizedRate").cast("double").alias("rate"),
    )


def write_panel(df: DataFrame, path: str, partition: str, order: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> None:
    """A keyed panel as a table partitioned by one column, sorted inside its files; a large key is several files."""
    sized(df, partition, rows_per_task, order).write.partitionBy(partition).parquet(path)


def read_panel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A panel read back with its fixed schema."""
    return spark.read.schema(schema).parquet(path)


def file_name(depth: int = 1) -> Column:
    """The last `depth` parts of `path`; more than one where files in several folders share a name."""
    return F.array_join(F.slice(F.split("path", "/"), -depth, depth), "/")


def _digests(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    store, _ = opened(root)
    for batch in batches:
        found = []
        for name in batch["path"]:
            with store.open_input_stream(name) as handle:
                digest = hashlib.sha256()
                for chunk in iter(lambda: handle.read(1 << 20), b""):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield batch.assign(sha256=found)


def file_digests(spark: SparkSession, path: str, pattern: str = "*", depth: int = 1) -> DataFrame:
    """Name, size and SHA-256 of every file below a path. Tasks hash a megabyte at a time; no file becomes a cell."""
    files = spark.createDataFrame(list_files(path, pattern), "path STRING, length BIGINT")  # Spark's own listing leaves out empty files
    hashed = files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(partial(_digests, root=path), "path STRING, length BIGINT, sha256 STRING")
    return hashed.select(file_name(depth).alias("file_name"), "sha256", F.col("length").alias("size_bytes"))


def audit_files(landed: DataFrame, manifest: DataFrame, vendor: DataFrame | None = None) -> DataFrame:
    """Every file of a manifest (file_name, sha256, size_bytes), of the vendor's checksums (file_name, sha256) and of what has
    landed (`file_digests`), with the first thing that is wrong with it."""
    found = landed.select("file_name", F.col("sha256").alias("found_sha256"), F.col("size_bytes").alias("found_size"))
    both = manifest.select("file_name", F.lower("sha256").alias("sha256"), "size_bytes").join(found, "file_name", "full")
    if vendor is None:
        both = both.withColumn("vendor_sha256", F.lit(None).cast("string"))
    else:
        both = both.join(vendor.select("file_name", F.lower("sha256").alias("vendor_sha256")), "file_name", "full")
    status = (
        F.when(F.col("found_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted")
        .when(F.col("found_size") != F.col("size_bytes"), "size_differs").when(F.col("found_sha256") != F.col("sha256"), "hash_differs")
        .when(F.col("found_sha256") != F.col("vendor_sha256"), "vendor_differs")
    )
    unknown = F.when(F.col("vendor_sha256").isNull(), "vendor_unlisted") if vendor is not None else F.lit(None)
    return both.withColumn("status", F.coalesce(status, unknown, F.lit("ok")))


def checksum_lines(lines: DataFrame) -> DataFrame:
    """`sha256  name` lines as (file_name, sha256); a line of another shape fails."""
    shape = r"^([0-9a-fA-F]{64}) [ *](.+)$"
    ok = F.col("value").rlike(shape)
    bad = F.raise_error(F.lit("not a checksum line"))
    return lines.filter(F.trim("value") != "").select(
        F.when(ok, F.regexp_extract("value", shape, 2)).otherwise(bad).alias("file_name"), F.lower(F.regexp_extract("value", shape, 1)).alias("sha256")
    )
