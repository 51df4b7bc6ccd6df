"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest bytes moved."""

from __future__ import annotations

import heapq
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import remove
from .registry import columns, query, table
from .scratch import Scratch

#: Bytes that every document has besides its text.
OVERHEAD = 16
#: A block of an old shard holds about this many bytes; the blocks of a shard are ordered, and so are its documents.
BLOCK_BYTES = 32 << 20
#: Least number of blocks of an old shard, so that a hot one is spread over tasks.
LEAST_BLOCKS = 64
#: Most old shards; the flow network of old times new shards is solved on the driver and must stay small.
MOST_OLD = 4096


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard so that all supply is placed at least cost.

    Successive shortest paths with node potentials over the bipartite network. ``cost(old, new)`` is the price of
    one byte and must not be negative. The capacities must add up to the supply or more.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards cannot hold all bytes")
    old, new = sorted(supply), sorted(capacity)
    price = {(i, j): cost(i, j) for i in old for j in new}
    left, room = dict(supply), dict(capacity)
    flow: dict[tuple[int, int], int] = {}
    into: dict[int, set[int]] = {j: set() for j in new}
    high_old, high_new = dict.fromkeys(old, 0), dict.fromkeys(new, 0)
    while any(left.values()):
        # Dijkstra from all old shards with supply left, over reduced costs
        dist: dict[tuple[str, int], float] = {("old", i): 0 for i in old if left[i]}
        back: dict[tuple[str, int], tuple[str, int]] = {}
        queue = [(0, "old", i) for i in old if left[i]]
        # reduced costs from several sources: their potentials count
        queue = [(d - high_old[i], k, i) for d, k, i in queue]
        dist = {(k, i): d for d, k, i in queue}
        heapq.heapify(queue)
        done: set[tuple[str, int]] = set()
        while queue:
            d, kind, i = heapq.heappop(queue)
            if (kind, i) in done:
                continue
            done.add((kind, i))
            if kind == "old":
                steps = (("new", j, price[i, j] + high_old[i] - high_new[j]) for j in new)
            else:
                steps = (("old", k, high_new[i] - high_old[k] - price[k, i]) for k in into[i])
            for other, j, w in steps:
                if d + w < dist.get((other, j), float("inf")):
                    dist[other, j] = d + w
                    back[other, j] = (kind, i)
                    heapq.heappush(queue, (d + w, other, j))
        end = min((j for j in new if room[j] and ("new", j) in dist), key=lambda j: (dist["new", j] + high_new[j], j))
        for (kind, i), d in dist.items():
            (high_old if kind == "old" else high_new)[i] += d
        path, at = [], ("new", end)
        while at in back:
            path.append((back[at], at))
            at = back[at]
        amount = min(left[at[1]], room[end], *(flow[b[1], a[1]] for a, b in path if a[0] == "new"))
        for a, b in path:
            if a[0] == "old":
                flow[a[1], b[1]] = flow.get((a[1], b[1]), 0) + amount
                into[b[1]].add(a[1])
            else:
                flow[b[1], a[1]] -= amount
                if not flow[b[1], a[1]]:
                    del flow[b[1], a[1]]
                    into[a[1]].discard(b[1])
        left[at[1]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def stay_home(old: int, new: int) -> int:
    """Moving a byte costs 1; leaving it in the shard of the same number costs nothing."""
    return int(old != new)


def _place(rows: DataFrame, capacity: dict[int, int], scratch: Scratch, name: str, cost) -> DataFrame:
    """``rows`` (doc_id, old, size, ...) with ``shard``: each old shard is cut at byte offsets given by the flow.

    Offsets are prefix sums: within a block by a window of bounded size, over blocks by a window over block sums.
    """
    sums = rows.groupBy("old").agg(F.sum("size").alias("bytes"))
    found = {r["old"]: r["bytes"] for r in sums.limit(MOST_OLD + 1).collect()}
    if len(found) > MOST_OLD:
        raise ValueError(f"more than {MOST_OLD} old shards")
    flow = min_cost_flow(found, capacity, cost)
    cuts, start = [], dict.fromkeys(found, 0)
    for old, new in sorted(flow):
        cuts.append((old, new, start[old], start[old] + flow[old, new]))
        start[old] += flow[old, new]
    cuts = rows.sparkSession.createDataFrame(cuts, "old int, shard int, low long, high long")
    n_blocks = {o: max(LEAST_BLOCKS, -(-b // BLOCK_BYTES)) for o, b in found.items()}
    per = rows.sparkSession.createDataFrame(list(n_blocks.items()) or [(0, 1)], "old int, blocks int")
    rows = rows.join(F.broadcast(per), "old").withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("blocks")).cast("int"))
    before = rows.groupBy("old", "block").agg(F.sum("size").alias("sum"))
    before = before.withColumn("base", F.sum("sum").over(Window.partitionBy("old").orderBy("block")) - F.col("sum")).drop("sum")
    inside = Window.partitionBy("old", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(F.broadcast(before) if len(found) * max(n_blocks.values(), default=1) <= 20_000 else before, ["old", "block"])
    rows = rows.withColumn("middle", F.col("base") + F.col("upto") - (F.col("size") / 2).cast("long"))
    on = (F.col("c.old") == F.col("r.old")) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high"))
    cut = F.broadcast(cuts.alias("c"))  # at most old shards + new shards rows
    return scratch.save(rows.alias("r").join(cut, on).select("r.*", "c.shard").drop("middle", "base", "upto", "blocks"), name)


def reshard(docs: DataFrame, n_shards: int, old_shard: Column, id_col: str = "doc_id", text_col: str = "text", cost=stay_home) -> DataFrame:
    """Place documents in shards 0 to ``n_shards - 1`` of near equal bytes, moving as few bytes as possible.

    Returns ``doc_id, size, text_crc32, old, shard, slot``, one row per input row. ``size`` is the UTF-8 length
    of the text plus 16; a null text has none. First the documents above the mean size are placed, then the rest
    fill up what is left of each capacity, so that shards differ by about one small document per cut. Slots are
    gapless from 0 in each shard. Rows that repeat an id are placed one by one; a null old shard counts as shard
    0; an empty table has no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old"))
    rows = scratch.save(rows, "sizes")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    capacity = {i: total // n_shards + (i < total % n_shards) for i in range(n_shards)}
    mean = total / n if n else 0
    large = _place(rows.where(F.col("size") > 2 * mean), capacity, scratch, "large", cost)
    used = dict(large.groupBy("shard").agg(F.sum("size")).collect())
    left = {i: max(0, c - used.get(i, 0)) for i, c in capacity.items()}
    lack = (total - sum(used.values())) - sum(left.values())
    for i in range(n_shards):  # where large documents overfill a shard, the others share what is lacking
        left[i] += max(0, lack) // n_shards + (i < max(0, lack) % n_shards)
    placed = large.union(_place(rows.where(F.col("size") <= 2 * mean), left, scratch, "small", cost))

    # gapless slots: counts per (shard, old, block) are added up before the rows inside are numbered
    piece = ["shard", "old", "block"]
    counts = placed.groupBy(*piece).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("old", "block")) - F.col("n")).drop("n")
    counts = scratch.save(counts, "counts")
    rank = F.row_number().over(Window.partitionBy(*piece).orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("rank", rank).join(counts, piece).select(
        "doc_id", "size", "text_crc32", "old", "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"))


def write_affected(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                   old_shard: Column | None = None) -> list[int]:
    """Write the shards whose content changes, one folder each, and return their numbers.

    ``plan`` is the result of ``reshard`` on the same ``docs``. A shard that gains and loses nothing keeps its
    files; one that loses all its rows loses its folder. Every other folder under ``path`` stays as it is. The
    rows of a shard are written by several tasks, each a run of slots. ``docs`` may be read from ``path`` itself;
    its own columns ``shard`` and ``slot`` are replaced.

    Rows find their place by id (null included), size, checksum and old shard; those equal in all four are
    numbered, so each row is written once. ``old_shard`` is the expression given to ``reshard``. It may be left out
    unless rows that are equal otherwise lie in several old shards, which is an error.
    """
    spark, key = docs.sparkSession, ["doc_id", "size", "text_crc32", *(["old"] if old_shard is not None else [])]
    if old_shard is None and not plan.groupBy(*key).agg(F.min("old").alias("a"), F.max("old").alias("b")).where("a <> b").isEmpty():
        raise ValueError("equal rows lie in several old shards: give old_shard")
    moved = plan.where("old <> shard")
    touched = sorted({r[0] for r in moved.select(F.explode(F.array("old", "shard"))).distinct().collect()})
    filled = {r[0] for r in plan.where(F.col("shard").isin(touched)).select("shard").distinct().collect()}
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    own = [c for c, name in zip(columns(docs), docs.columns, strict=True) if name.lower() not in ("shard", "slot")]
    old = [] if old_shard is None else [F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old")]
    plain = [c for c in own if not re.search("map<|variant", docs.select(c).schema[0].dataType.simpleString())]
    rows = docs.select(F.struct(*own).alias("row"), F.xxhash64(*plain).alias("tie"), F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), *old)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("tie")))  # a retried task numbers them alike
    place = plan.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot"))).where(F.col("shard").isin(touched))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*key, "k"]]
    rows = rows.alias("r").join(place.alias("p"), on).select("r.row.*", "p.shard", "p.slot")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for shard in touched:
        if shard not in filled:
            remove(spark, f"{path}/shard={shard}")
    return touched


@query("op6_reshard")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(32))
    placed = reshard(table(spark, sf_dir, "documents"), 40, old)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old")
