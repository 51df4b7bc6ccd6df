"""Near duplicates: MinHash candidates, exact confirmation, connected components.

1. ``sketch``: each text's set of word shingles, many universal hash minima, and band keys made of them.
   Texts with equal sets are collapsed to one representative first.
2. Bands that several sets share give candidate sets. Only their shingles are kept for confirmation.
3. A bound drops what cannot link: if ``own(x)`` shingles of x occur in no other candidate, then
   ``|x & y| <= |x| - own(x)`` and ``|x | y| >= |y| + own(x)`` for every y.
4. Each band bucket compares its members with one pivot (star, not all pairs). Signatures, then full sets,
   confirm links. Components are taken.
5. Buckets whose members are then in several components compare each member outside the pivot's component (a stray)
   with the members of other components, so no link between components is missed. Large buckets are dealt out in
   blocks of bounded size; a task compares a block of strays with a block of members and returns the links it
   finds, not the pairs. With few strays each member is dealt once.

No bucket is collected, capped or paired with itself as a whole; a near-clique costs one pair per member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .registry import columns, query, table
from .scratch import Scratch
from .words import WordHashes, binary, lists, mix, shingle_set, small

#: Number of universal hash functions.
N_HASHES = 240
#: A pair just at the threshold shares no band with less than this probability.
MISS = 1e-8
#: Standard deviations that the signature estimate may lie below the threshold before the full sets are spared.
SLACK = 6.5
#: Buckets up to this size pair their members by a join; larger ones are compared block by block.
SMALL_BUCKET = 64
#: Members of a large bucket that one block holds on average; a task sees two blocks.
BLOCK_MEMBERS = 384
#: Shingles hashed at once; bounds the memory of one block of minima.
BLOCK = 1024


def band_rows(percent: int, n_hashes: int = N_HASHES, miss: float = MISS) -> int:
    """Most rows per band for which a pair at the threshold still shares a band almost surely."""
    j = percent / 100
    fit = [r for r in range(1, 17) if n_hashes % r == 0 and (1 - j**r) ** (n_hashes // r) <= miss]
    return max(fit, default=1)


def coefficients(n_hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the multiply-add-shift family, the same in every task."""
    base = mix(np.arange(1, 2 * n_hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:n_hashes] | np.uint64(1), base[n_hashes:]


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over a set of 64-bit shingles, as 32-bit numbers."""
    keys = shingles >> np.uint64(32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(keys), BLOCK):
        block = (a[:, None] * keys[None, i : i + BLOCK] + b[:, None]) >> np.uint64(32)
        np.minimum(out, block.min(axis=1), out=out)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band, made of its minima and its number."""
    bands = signature.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return key


def _sketch(batches: Iterator[pa.RecordBatch], width: int, rows: int, n_hashes: int) -> Iterator[pa.RecordBatch]:
    hashes, (a, b) = WordHashes(), coefficients(n_hashes)
    for batch in small(batches):
        sizes, first, second, bands = [], [], [], []
        for text in binary(batch.column(1)):
            found = shingle_set(text, width, hashes)
            sizes.append(len(found))
            digest = np.array([mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)]).view(np.int64)
            first.append(digest[0])
            second.append(digest[1])
            bands.append(band_keys(minima(found, a, b), rows).view(np.int64) if len(found) else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists(bands, pa.int64())],
            names=["doc_id", "n", "d1", "d2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], width: int, rows: int, n_hashes: int) -> Iterator[pa.RecordBatch]:
    """Shingles, low bytes of the signature, and band keys as bytes."""
    hashes, (a, b) = WordHashes(), coefficients(n_hashes)
    for batch in small(batches):
        sets = [shingle_set(text, width, hashes) for text in binary(batch.column(1))]
        signatures = [minima(s, a, b) for s in sets]
        marks = [(x & np.uint64(0xFF)).astype(np.uint8).tobytes() for x in signatures]
        bands = [band_keys(x, rows).tobytes() for x in signatures]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), lists([s.view(np.int64) for s in sets], pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.binary())],
            names=["id", "shingles", "marks", "bands"])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common elements of two arrays of distinct numbers."""
    both = np.sort(np.concatenate([a, b]))
    return int((both[1:] == both[:-1]).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = shared(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_agreement(percent: int, n_hashes: int) -> float:
    """Equal minima below which a pair at the threshold practically never falls."""
    j = percent / 100
    return n_hashes * (j - SLACK * np.sqrt(j * (1 - j) / n_hashes))


def _compare(group: pa.Table, percent: int, n_hashes: int) -> pa.Table:
    """Links between a block of a bucket's strays (the rows that ask) and a block of its members, where the components differ.

    A pair that shares several buckets is compared in the first of them only, two strays in one of their two groups.
    """
    least = least_agreement(percent, n_hashes)
    key, asks, stray = group["key"][0].as_py(), group["asks"].to_numpy(), group["stray"].to_numpy()
    ids, comp, n, own = (group[c].to_numpy() for c in ("id", "comp", "n", "own"))
    marks = np.frombuffer(b"".join(group["marks"].to_pylist()), np.uint8).reshape(len(ids), -1)
    bands = np.frombuffer(b"".join(group["bands"].to_pylist()), np.int64).reshape(len(ids), -1)
    sets = [x.values.to_numpy() for x in group["shingles"]]
    u, v = [], []
    for x in np.flatnonzero(asks):
        fits = ~asks & (comp != comp[x]) & ((ids < ids[x]) | ~stray)
        fits &= 100 * np.minimum(n - own, n[x] - own[x]) >= percent * np.maximum(n + own[x], n[x] + own)
        at = np.flatnonzero(fits)
        at = at[bands[at, (bands[at] == bands[x]).argmax(axis=1)] == key]
        at = at[(marks[at] == marks[x]).sum(axis=1) >= least]
        for y in at:
            if similar(sets[x], sets[y], percent):
                u.append(max(ids[x], ids[y]))
                v.append(min(ids[x], ids[y]))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _confirm(batches: Iterator[pa.RecordBatch], percent: int, n_hashes: int) -> Iterator[pa.RecordBatch]:
    """Signature check, then exact intersection and union sizes."""
    least = least_agreement(percent, n_hashes)
    for batch in small(batches):
        keep = []
        sets_u, sets_v = batch.column(2), batch.column(4)
        for i, (mu, mv) in enumerate(zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            same = np.count_nonzero(np.frombuffer(mu, np.uint8) == np.frombuffer(mv, np.uint8))
            if same < least:
                keep.append(False)
                continue
            x, y = sets_u[i].values.to_numpy(), sets_v[i].values.to_numpy()
            keep.append(similar(x, y, percent))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, percent: int, n_hashes: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"), F.col("marks").alias("mu"))
    two = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"), F.col("marks").alias("mv"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "su", "mu", "sv", "mv").mapInArrow(
        partial(_confirm, percent=percent, n_hashes=n_hashes), "u long, v long")


def _possible(percent: int, n1: str, own1: str, n2: str, own2: str):
    """What two sets can share at most, against what they must unite at least."""
    most = F.least(F.col(n1) - F.col(own1), F.col(n2) - F.col(own2))
    least = F.greatest(F.col(n1) + F.col(own2), F.col(n2) + F.col(own1))
    return 100 * most >= percent * least


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
               n_hashes: int = N_HASHES) -> DataFrame:
    """Group texts whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row: the size of the set, the smallest
    id reachable over links, and whether that is the row's own. Words are lower-cased in A-Z. A text with fewer
    than ``width`` words is one shingle. A null or empty text, or one of white space only, has no shingle and
    links with nothing: it is its own component. Equal sets link. Texts of any length are hashed in blocks. An empty
    table gives no rows. Where ids repeat or are null, each row is a document of its own: the rows are numbered in a
    written copy, and the smallest id of a component is looked up at the end (null where all its ids are). Other
    columns are not looked at.
    """
    if _tells_rows_apart(docs, id_col):
        return _of_unique(docs, id_col, text_col, width, percent, n_hashes)
    scratch = Scratch(docs.sparkSession, "near_rows")
    rows = scratch.save(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "rows")
    found = _of_unique(rows, "row", "text", width, percent, n_hashes).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("group"))
    found = scratch.save(found.join(rows.select("row", "id"), "row"), "found")
    least = found.groupBy("group").agg(F.min("id").alias("component_id"))
    return found.join(least, "group").select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _tells_rows_apart(docs: DataFrame, id_col: str) -> bool:
    """Whether no id is null and none repeats."""
    most, none = docs.groupBy(F.col(id_col).cast("long").alias("i")).count().agg(F.max("count"), F.count_if(F.col("i").isNull())).first()
    return (most or 0) <= 1 and not none


def _of_unique(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, n_hashes: int) -> DataFrame:
    """``near_dedup`` where no id is null and none repeats."""
    spark, rows = docs.sparkSession, band_rows(percent, n_hashes)
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.save(texts.mapInArrow(
        partial(_sketch, width=width, rows=rows, n_hashes=n_hashes), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "sketch")

    # equal sets: one representative each
    classes = scratch.save(sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id")), "classes")
    linked = _components_of_sets(texts, sketch, classes, scratch, width, percent, n_hashes)

    final = scratch.save(classes.join(linked, classes["id"] == linked["node"], "left").select(
        "n", "d1", "d2", F.coalesce("component", "id").alias("component")), "final")
    own = sketch.drop("bands").join(final, ["n", "d1", "d2"], "left")
    own = own.withColumn("component_id", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    own = own.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return own.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components_of_sets(texts: DataFrame, sketch: DataFrame, classes: DataFrame, scratch: Scratch, width: int, percent: int,
                        n_hashes: int) -> DataFrame:
    banded = sketch.where("n > 0").select("doc_id", F.posexplode("bands").alias("band", "key"))
    banded = banded.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("key", F.col("doc_id").alias("id"))
    banded = scratch.save(banded, "bands")
    buckets = scratch.save(banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "buckets")
    members = scratch.save(banded.join(buckets, "key"), "members")
    scratch.drop(banded, buckets)

    ids = scratch.save(members.select("id").distinct(), "ids")
    sets = texts.join(ids, texts["doc_id"] == ids["id"], "left_semi")
    sets = scratch.save(sets.mapInArrow(partial(_sets, width=width, rows=band_rows(percent, n_hashes), n_hashes=n_hashes),
        "id long, shingles array<long>, marks binary, bands binary"), "sets")
    single = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
    own = scratch.save(single.groupBy("id").agg(F.count(F.lit(1)).alias("own")), "own")
    size = sets.select("id", F.size("shingles").cast("long").alias("n")).join(own, "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own"))
    size = scratch.save(size.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "size")
    members = scratch.save(members.join(size, "id"), "sized")

    pivots = members.groupBy("key").agg(
        F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "id", "n", "own")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pivots = scratch.save(pivots.select("key", F.col("p.id").alias("pid"), F.col("p.n").alias("pn"), F.col("p.own").alias("pown")), "pivots")
    star = members.join(pivots, "key").where((F.col("id") != F.col("pid")) & _possible(percent, "n", "own", "pn", "pown"))
    star = star.select(F.greatest("id", "pid").alias("u"), F.least("id", "pid").alias("v")).distinct()
    first = scratch.save(_links(star, sets, percent, n_hashes), "star")

    node = scratch.save(components(first, scratch), "nodes")
    member = members.join(node, members["id"] == node["node"], "left").select("key", "id", "n", "own", F.coalesce("component", "id").alias("comp"))
    member = scratch.save(member, "placed")
    main = pivots.join(node, pivots["pid"] == node["node"], "left").select("key", "pid", F.coalesce("component", "pid").alias("main"))
    main = scratch.save(main, "main")
    member = scratch.save(member.join(main, "key").withColumn("stray", F.col("comp") != F.col("main")), "told")
    open_ = member.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.count_if("stray").alias("strays")).where("strays > 0")
    open_ = scratch.save(open_, "open")

    small = scratch.save(member.join(open_.where(F.col("c") <= SMALL_BUCKET).select("key"), "key"), "small")
    stray = small.where("stray").select(
        "key", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("own").alias("xown"), F.col("comp").alias("xcomp"))
    cross = stray.join(small, "key").where(
        (F.col("comp") != F.col("xcomp")) & (F.col("id") != F.col("pid")) & (~F.col("stray") | (F.col("x") < F.col("id")))
        & _possible(percent, "n", "own", "xn", "xown"))
    cross = cross.select(F.greatest("id", "x").alias("u"), F.least("id", "x").alias("v")).distinct()
    second = scratch.save(_links(cross, sets, percent, n_hashes), "cross")

    # blocks of members against blocks of strays: a stray goes to every member block, a member only to as many as strays fill
    large = member.join(open_.where(F.col("c") > SMALL_BUCKET), "key")
    large = large.withColumns({"_m": F.ceil(F.col("c") / BLOCK_MEMBERS).cast("int"), "_s": F.ceil(F.col("strays") / BLOCK_MEMBERS).cast("int")})
    own = {"a": F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"), "b": F.pmod(F.xxhash64("id", F.lit(1)), F.col("_s")).cast("int")}
    every = {"a": F.explode(F.sequence(F.lit(0), F.col("_m") - 1)), "b": F.explode(F.sequence(F.lit(0), F.col("_s") - 1))}
    fields = ["key", "id", "n", "own", "comp", "stray"]
    met = large.select(*fields, own["a"].alias("a"), every["b"].alias("b"), F.lit(False).alias("asks"))
    dealt = met.union(large.where("stray").select(*fields, every["a"].alias("a"), own["b"].alias("b"), F.lit(True).alias("asks")))
    third = dealt.join(sets, "id").groupBy("key", "a", "b").applyInArrow(
        lambda group: _compare(group, percent, n_hashes), "u long, v long")
    second = second.union(scratch.save(third, "blocks"))
    return scratch.save(components(first.union(second), scratch), "components")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each near-duplicate group, columns unchanged.

    Of each group the row with the smallest id stays, null ids last, the earlier row of equal ids. Where ids are null or
    repeat, the rows are numbered in a written copy, so that they are told apart.
    """
    if _tells_rows_apart(docs, "doc_id"):
        gone = _of_unique(docs, "doc_id", "text", 5, 80, N_HASHES).where(~F.col("kept")).select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))
    scratch = Scratch(spark, "near_stage")
    rows = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns(docs)).alias("doc")), "rows")
    texts = rows.select("row", F.col("doc")["text"].alias("text"))
    found = scratch.save(_of_unique(texts, "row", "text", 5, 80, N_HASHES).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "found")
    groups = found.where("row <> group").select("group").distinct()
    members = scratch.save(found.join(groups, "group", "left_semi").join(rows.select("row", F.col("doc")["doc_id"].cast("long").alias("id")), "row"), "members")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select("first.row")
    gone = members.select("row").join(first, "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select("doc.*")


@query("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)
