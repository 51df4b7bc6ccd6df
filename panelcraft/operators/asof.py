"""As-of joins: backward with tolerance, onto a daily grid, and by snapping to an interval grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.windows import any_of, over
from ..staging import stage


def _micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zone-free or zoned timestamp column."""
    return F.unix_micros(ts.cast("timestamp"))


#: Time quantiles sketched per key: no key is cut into more buckets.
MOST_BUCKETS = 1024
#: Rows that a key may have before it is cut, and about that many per bucket.
ROWS_PER_BUCKET = 1_000_000


def bucket_edges(rows: DataFrame, keys: Sequence[str], at: Column, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame | None:
    """For keys with more than `rows_per_bucket` rows, the instants (`_edges`) at which buckets of equal row count begin.

    Rows are counted per key with map-side combine; only keys that exceed the bound get a mergeable quantile sketch of
    their instants, so the written result has at most one edge per `rows_per_bucket` rows. None if no key exceeds it.
    """
    large = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_bucket), "large_keys")
    if large.isEmpty():
        return None
    shares = [i / MOST_BUCKETS for i in range(1, MOST_BUCKETS)]
    sketch = rows.join(F.broadcast(large.select(*keys)), list(keys), "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(at, shares, 10 * MOST_BUCKETS).alias("_q"))
    wanted = F.least(F.lit(MOST_BUCKETS), F.ceil(F.col("_n") / rows_per_bucket)).cast("int")
    places = F.transform(F.sequence(F.lit(1), F.col("_wanted") - 1), lambda i: F.get("_q", F.floor(i * MOST_BUCKETS / F.col("_wanted")).cast("int") - 1))
    return stage(sketch.withColumn("_wanted", wanted).select(*keys, F.array_distinct(places).alias("_edges")), "edges")


def edge_bucket(edges: Column, at: Column) -> Column:
    """Number of edges at or before an instant, by binary search; 0 without edges."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_BUCKETS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when(F.get(edges, found + step - 1) <= at, found + step).otherwise(found))


def asof_sources(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    left: Column,
    sources: Mapping[str, tuple[Column, Column]],
    keep: Sequence[str] = (),
    tolerance_hours: float | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Give each left row the last value of every source at or before it, unless that is too old: one table, one pass.

    `rows` holds the left rows (`left`) and the rows of all sources (`sources[name] = (is one, its value)`); a row may
    be several of them. Work is split by key, and keys with many rows by time quantiles as well, so the rows of a key
    that is most of the table spread over as many tasks as it fills buckets. One sort then serves all sources. What
    crosses the edges of a cut key is one carried row per bucket, for all sources together. Source rows must be
    unique per key and instant; a null value of a source hides the ones before it.
    """
    at = _micros(F.col(ts))
    edges = bucket_edges(rows.filter(any_of([left, *[is_one for is_one, _ in sources.values()]])), keys, at, rows_per_bucket)
    values = {n: F.when(is_one, F.struct(at.alias("at"), v.alias("v"))).alias(f"_{n}") for n, (is_one, v) in sources.items()}
    kept = F.when(left, F.struct(F.lit(True).alias("_is"), *[F.col(c) for c in keep])).alias("_left")
    tagged = rows.select(*keys, ts, at.alias("_at"), kept, *values.values()).filter(
        any_of([F.col("_left").isNotNull(), *[F.col(f"_{n}").isNotNull() for n in sources]]))

    if edges is None:
        groups = list(keys)
    else:  # at most one key and one edge per `rows_per_bucket` rows
        tagged = tagged.join(F.broadcast(edges), list(keys), "left").withColumn("_bucket", edge_bucket(F.col("_edges"), F.col("_at"))).drop("_edges")
        groups = [*keys, "_bucket"]
    inside = over(groups, "_at", F.col("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = tagged.withColumns({f"_{n}": F.last(f"_{n}", ignorenulls=True).over(inside) for n in sources}).filter("_left IS NOT NULL")
    if edges is not None:
        ends = tagged.join(F.broadcast(edges.select(*keys)), list(keys), "left_semi").groupBy(*groups).agg(
            *[F.max_by(f"_{n}", F.col(f"_{n}.at")).alias(f"_{n}") for n in sources])
        before = over(keys, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*groups, *[F.last(f"_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in sources])
        found = found.join(carried, groups, "left").withColumns({f"_{n}": F.coalesce(f"_{n}", f"_c_{n}") for n in sources})
    hit = {n: F.col(f"_{n}.v") for n in sources}
    if tolerance_hours is not None:
        limit = int(tolerance_hours * 3600 * 1_000_000)
        hit = {n: F.when(F.col("_at") - F.col(f"_{n}.at") <= limit, v) for n, v in hit.items()}
    return found.select(*keys, ts, *[F.col(f"_left.{c}").alias(c) for c in keep], *[v.alias(n) for n, v in hit.items()])


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    tolerance_hours: float | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Give every left row the last right row of its key at or before it, unless that is too old.

    Two tables are tagged and united; the rest is `asof_sources`.
    """
    rest = [c for c in left.columns if c not in keys and c != ts]
    rows = left.select(*keys, ts, F.struct(F.lit(True).alias("_is"), *rest).alias("_l")).unionByName(
        right.select(*keys, ts, F.struct(*values).alias("_r")), allowMissingColumns=True)
    found = asof_sources(rows, keys, ts, F.col("_l").isNotNull(), {"_r": (F.col("_r").isNotNull(), F.col("_r"))}, ["_l"], tolerance_hours, rows_per_bucket)
    return found.select(*keys, ts, *[F.col(f"_l.{c}").alias(c) for c in rest], *[F.col(f"_r.{v}").alias(v) for v in values])


def observations(
    rows: DataFrame, keys: Sequence[str] = ("symbol",), source: str = "source", keep: Sequence[str] = (),
    tolerance_hours: float | None = None, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Events with the last mark and the last spot price before them, and the basis between the two.

    `rows` is one table of events, marks and spots, told apart by `source`; prices are in `close`.
    """
    kind, close = F.col(source), F.col("close")
    prices = {"perp_close": (kind == "mark", close), "spot_close": (kind == "spot", close)}
    out = asof_sources(rows, keys, "ts", kind == "event", prices, keep, tolerance_hours, rows_per_bucket)
    basis = (F.col("perp_close") - F.col("spot_close")) / F.nullif(F.col("spot_close"), F.lit(0.0))
    return out.withColumn("basis", basis)


def carried_days(
    events: DataFrame, value: str, max_gap_days: int, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Each key's last value at every midnight, carried at most `max_gap_days`, from first to last event day.

    Sparse form: days without a recent enough event have no row. An event is first visible on the
    midnight at or after it. Every event is stretched over the days it rules, so no day-by-symbol
    product is formed; `<value>_next` is the next day's value.
    """
    last_day = events.agg(F.max(F.col("ts").cast("date"))).scalar()
    visible = F.to_date(F.col("ts") + F.expr("INTERVAL 1 DAY - INTERVAL 1 MICROSECOND"))
    daily = (
        events.groupBy(*keys, visible.alias("date"))
        .agg(F.max_by(F.struct(value, "ts"), F.col("ts")).alias("_e"))
        .filter(F.col("date") <= last_day)
    )
    w = over(keys, "date")
    until = F.least(
        F.to_date(F.col("_e.ts") + F.expr(f"INTERVAL {int(max_gap_days)} DAYS")),
        F.coalesce(F.date_sub(F.lead("date").over(w), 1), last_day),
        last_day,
    )
    spans = daily.withColumn("_until", until).filter(F.col("_until") >= F.col("date"))
    dense = spans.select(
        *keys, F.explode(F.sequence("date", "_until")).alias("date"), F.col(f"_e.{value}").alias(value)
    )
    following = F.lead("date").over(w) == F.date_add("date", 1)
    return dense.withColumn(f"{value}_next", F.when(following, F.lead(value).over(w)))


def carried_grid(
    events: DataFrame, value: str, max_gap_days: int, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """`carried_days` on the full grid of keys and days, NULL where nothing recent enough is known."""
    day = F.col("ts").cast("date")
    first, last = events.agg(F.min(day)).scalar(), events.agg(F.max(day)).scalar()
    grid = events.select(*keys).distinct().withColumn("date", F.explode(F.sequence(first, last)))
    return grid.join(carried_days(events, value, max_gap_days, keys), [*keys, "date"], "left")


def snap(ts: Column, interval_hours: int) -> Column:
    """The nearest grid instant as microseconds, halves rounding up."""
    step = interval_hours * 3_600_000_000
    return F.floor((_micros(ts) + step // 2) / F.lit(step)) * step


def snap_collisions(events: DataFrame, keys: Sequence[str], interval_hours: int) -> DataFrame:
    """Grid points on which snapping would merge several events."""
    return (
        events.groupBy(*keys, snap(F.col("ts"), interval_hours).alias("grid_us"))
        .agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )


def clean_events(events: DataFrame, keys: Sequence[str], interval_hours: int) -> DataFrame:
    """The events that have a grid point to themselves; `snap_collisions` shows the others."""
    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys, snap(F.col("ts"), interval_hours))) == 1
    return events.withColumn("_alone", alone).filter("_alone").drop("_alone")


def venue_delta(
    left: DataFrame, right: DataFrame, keys: Sequence[str], interval_hours: int = 8, strict: bool = True
) -> DataFrame:
    """Rates of two venues matched on the interval grid, and left minus right.

    Strict mode raises if snapping merges events; otherwise the earliest event of a grid point that has a rate stays.
    """
    def leg(df: DataFrame, name: str) -> DataFrame:
        grouped = df.groupBy(*keys, snap(F.col("ts"), interval_hours).alias("grid_us"))
        out = grouped.agg(F.min_by("rate", F.when(F.col("rate").isNotNull(), F.col("ts"))).alias(name), F.count(F.lit(1)).alias("_n"))
        if strict:
            bad = F.raise_error(F.lit("events are not on a clean interval grid")).cast("double")
            out = out.withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(bad))
        return out.drop("_n")

    joined = leg(left, "rate_left").join(leg(right, "rate_right"), [*keys, "grid_us"])
    return joined.withColumn("rate_delta", F.col("rate_left") - F.col("rate_right"))
