"""Recursions over rows that arrive in order, many keys at a time, carried from one Arrow batch to the next."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa


@dataclass
class Column:
    """Values of a batch and which of them are present; those that are not hold 0."""

    value: np.ndarray
    here: np.ndarray

    @staticmethod
    def of(array: pa.Array) -> Column:
        return Column(array.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), array.is_valid().to_numpy(zero_copy_only=False))

    def arrow(self) -> pa.Array:
        return pa.array(self.value, pa.float64(), mask=~self.here)

    def __sub__(self, other: Column) -> Column:
        return Column(self.value - other.value, self.here & other.here)

    def over(self, other: Column) -> Column:
        """The ratio, absent where the divisor is 0."""
        here = self.here & other.here & (other.value != 0.0)
        return Column(np.divide(self.value, other.value, out=np.zeros(len(here)), where=here), here)


@dataclass
class Keys:
    """Where keys begin. Rows of one key are adjacent, in the batch and across batches."""

    last: object = None
    started: bool = False
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def advance(self, keys: pa.Array) -> np.ndarray:
        """The first rows of keys that begin in this batch."""
        codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh = np.append(not self.started or keys[0].as_py() != self.last, codes[1:] != codes[:-1])
        self.last, self.started = keys[len(keys) - 1].as_py(), True
        self.starts = np.flatnonzero(fresh)
        return self.starts


@dataclass
class Previous:
    """The value of the row before, absent on the first row of a key."""

    value: float = 0.0
    here: bool = False

    def of(self, x: Column, starts: np.ndarray) -> Column:
        out = Column(np.append(self.value, x.value[:-1]), np.append(self.here, x.here[:-1]))
        out.here[starts] = False
        self.value, self.here = float(x.value[-1]), bool(x.here[-1])
        return out


@dataclass
class Average:
    """y[t] = (1 - a) * y[t-1] + a * x[t], y[0] = x[0]; absent inputs are skipped, and `min_obs` must have been seen.

    Each row is an affine map of the average before it: the identity where the input is absent, a constant where a
    key begins. Maps are composed over spans of 1, 2, 4, ... rows, so no row is looped over, no weight grows and
    nothing of one key reaches the next. Two numbers go on to the next batch.
    """

    alpha: float
    min_obs: int = 1
    value: float = 0.0
    seen: int = 0

    def of(self, x: Column, starts: np.ndarray) -> Column:
        counted = self.seen + np.cumsum(x.here)
        if len(starts):
            before = np.append(np.append(self.seen, counted)[starts], 0)
            which = np.searchsorted(starts, np.arange(len(x.here)), side="right") - 1
            counted = counted - np.where(which >= 0, before[which], 0)
        keep = np.where(x.here, 1.0 - self.alpha, 1.0)
        add = np.where(x.here, self.alpha * x.value, 0.0)
        first = x.here & (counted == 1)
        keep[first], add[first] = 0.0, x.value[first]
        keep[starts] = 0.0
        span = 1
        while span < len(keep):
            live = keep[span:] != 0.0
            add[span:] += np.multiply(keep[span:], add[:-span], out=np.zeros(len(live)), where=live)
            keep[span:] = keep[span:] * keep[:-span]
            span *= 2
        y = add + np.multiply(keep, self.value, out=np.zeros(len(keep)), where=keep != 0.0)
        self.value, self.seen = float(y[-1]), int(counted[-1])
        return Column(y, x.here & (counted >= self.min_obs))


@dataclass
class Place:
    """The place of a value between the least and the largest of its last `n` rows, all of which must be present.

    A key's first row must be absent; a window that reaches into the key before is then never full.
    """

    n: int
    tail: np.ndarray | None = None

    def of(self, x: Column) -> Column:
        tail = np.full(self.n - 1, np.nan) if self.tail is None else self.tail
        rows = np.append(tail, np.where(x.here, x.value, np.nan))
        self.tail = rows[len(rows) - self.n + 1 :]
        frames = np.lib.stride_tricks.sliding_window_view(rows, self.n)
        low, high = frames.min(axis=1), frames.max(axis=1)
        here = high > low  # false where a value is absent
        return Column(np.divide(x.value - low, high - low, out=np.zeros(len(here)), where=here), here)
