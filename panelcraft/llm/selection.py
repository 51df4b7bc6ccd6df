"""The k-th smallest key of a distributed table by weighted median-of-medians selection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Keys that a task looks at together; each such chunk has a median of its own.
CHUNK = 1 << 20
#: The rest is written anew once it is this small a part of the table that is read.
SHRINK = 8

Key = tuple[int, ...]


def precedes(columns: list[str], key: Key) -> Column:
    """Whether a row's key comes before ``key``, column by column."""
    out = F.lit(False)
    for name, value in reversed(list(zip(columns, key, strict=True))):
        out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def same(columns: list[str], key: Key) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in zip(columns, key, strict=True)))


def median(keys: list[np.ndarray]) -> list[int] | None:
    """The lower median of the keys in their order."""
    if not len(keys[0]):
        return None
    order = np.lexsort(keys[::-1])
    at = order[(len(order) - 1) // 2]
    return [int(k[at]) for k in keys]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    held, rows = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows >= CHUNK:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _parted(batches: Iterator[pa.RecordBatch], pivot: Key | None) -> Iterator[pa.RecordBatch]:
    """Per chunk, the number of keys before the pivot, at it and after it, and the medians of both sides."""
    for keys in _chunks(batches):
        before, equal = np.zeros(len(keys[0]), bool), np.full(len(keys[0]), pivot is not None)
        for k, p in zip(keys, pivot or [0] * len(keys), strict=True):
            before |= equal & (k < p)
            equal &= k == p
        after = ~before & ~equal
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(before.sum())], pa.int64()), pa.array([int(equal.sum())], pa.int64()), pa.array([int(after.sum())], pa.int64()),
             pa.array([median([k[before] for k in keys])], pa.list_(pa.int64())), pa.array([median([k[after] for k in keys])], pa.list_(pa.int64()))],
            names=["before", "equal", "after", "before_median", "after_median"])


def weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The median of the chunk medians, each counted as often as its chunk has keys left."""
    medians, total = sorted(medians), sum(n for _, n in medians)
    seen = 0
    for key, n in medians:
        seen += n
        if 2 * seen >= total:
            return key
    raise ValueError("no key is left")


def kth_key(keys: DataFrame, k: int, scratch: Scratch) -> Key:
    """The key at place ``k`` (from 1) of a table of non-null long columns, ordered by them from left to right.

    Each round is one pass. The pivot is the median of the chunks' medians weighted by their remaining sizes, so at
    least a quarter of the remaining keys comes before it or is it, and at least a quarter comes after it or is it:
    the side without place ``k`` goes. Equal keys count as often as they occur. The medians, one for each chunk of up
    to a million keys, are all that reaches the driver. Raises if the table has fewer than ``k`` rows.
    """
    names, rest, low, high, pivot, stored, ours = keys.columns, keys, None, None, None, None, None
    while True:
        found = rest.mapInArrow(partial(_parted, pivot=pivot), "before long, equal long, after long, before_median array<long>, after_median array<long>").collect()
        before, equal, after = (sum(r[c] for r in found) for c in ("before", "equal", "after"))
        if before < k <= before + equal:
            return pivot
        side, size = ("before", before) if k <= before else ("after", after)
        if side == "before":
            high = pivot
        else:
            low, k = pivot, k - before - equal
        if k > size:
            raise ValueError("the table has fewer keys than the place asked for")
        pivot = weighted_median([(tuple(r[f"{side}_median"]), r[side]) for r in found if r[side]])
        stored = stored or before + equal + after
        if low is not None:
            rest = rest.where(~precedes(names, low) & ~same(names, low))
        if high is not None:
            rest = rest.where(precedes(names, high))
        if size * SHRINK <= stored:
            old, ours, stored = ours, scratch.save(rest, "rest"), size
            if old is not None:
                scratch.drop(old)
            rest, low, high = ours, None, None
