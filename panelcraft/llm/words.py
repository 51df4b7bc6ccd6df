"""Words of a text as 64-bit numbers, and word shingles made of them. Used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Hashes kept per worker before the cache starts anew, so its memory is bounded.
CACHE_WORDS = 400_000
MASK = 0xFFFFFFFFFFFFFFFF


class WordHashes(dict):
    """Remembers the 64-bit hash of each word it has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out + hashes[i : i + n] + np.uint64(i + 1))
    return out


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingles of the text with A-Z lower-cased; a shorter text is one shingle, no word is none."""
    words = hashes.of(split_words(text.lower() if text else text))
    if len(words) < width:
        return windows(words, len(words)) if len(words) else np.empty(0, np.uint64)
    return np.unique(windows(words, width))


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made of one batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def binary(column: pa.Array) -> list:
    """A text column as bytes objects, without decoding."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))
