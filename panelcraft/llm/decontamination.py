"""Benchmark decontamination: suffix arrays over shards of the training words, searched for every suffix of the test items.

The alphabet of a shard is the words of the test items; every other word and every gap between documents is 0, which
ends a match. Only suffixes that begin with a word of the items are sorted, since no other can match, and only as deep as
the longest test suffix, since no search looks further. A test suffix's place in that order gives its longest verbatim
match in the shard and, from there, all places that share its first window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plain_words import word_pieces
from .registry import columns, query, table
from .scratch import Scratch
from .words import binary, lists, small

#: Words of a window: a run of that many is contamination.
WINDOW = 10
#: Words of a shard, about; a longer document is cut into overlapping parts.
SHARD_WORDS = 1 << 20
#: Words of test items that tasks hold at once; a larger benchmark takes one pass over the documents per block.
BLOCK_WORDS = 1 << 21
#: Suffixes searched at once, and words compared at a time.
SEARCHED, STEP = 1 << 15, 8


@dataclass
class Block:
    """A bounded part of the test items: their words as numbers from 1, one item after the other."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    words: list[int] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    made: dict[int, Suffixes] = field(default_factory=dict)

    def suffixes(self, window: int) -> Suffixes:
        """Made once in each worker."""
        if window not in self.made:
            self.made[window] = Suffixes(self, window)
        return self.made[window]

    def add(self, item_id: str, words: list[bytes]) -> None:
        self.ids.append(item_id)
        self.starts.append(len(self.words))
        self.words += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]


class Suffixes:
    """The suffixes of a block's items, equal windows found once.

    ``at`` and ``size`` are each suffix's first word and length, ``window`` is the length of the window it begins with
    (0 if it begins none), ``item`` the item it lies in.
    """

    def __init__(self, block: Block, window: int) -> None:
        starts = np.array([*block.starts, len(block.words)], np.int64)
        lengths = np.diff(starts)
        self.ids, self.n_items = block.ids, len(block.ids)
        self.item = np.repeat(np.arange(self.n_items), lengths)
        self.at = np.arange(len(block.words))
        self.offset = self.at - starts[self.item]
        self.size = lengths[self.item] - self.offset
        whole = np.minimum(lengths, window)[self.item]
        self.window = np.where((self.size >= whole) & ((lengths[self.item] >= window) | (self.offset == 0)), whole, 0)
        self.depth = int(lengths.max(initial=0))
        self.bits = max(1, len(block.vocabulary).bit_length())
        self.words = np.concatenate([np.array(block.words, np.int64), np.zeros(self.depth + STEP, np.int64)])
        # windows with the same words are one class, so a place in a document belongs to one class per length
        keys = {}
        self.classes = np.full(len(self.at), -1)
        self.items_of: list[set[str]] = []
        for i in np.flatnonzero(self.window):
            key = self.words[i : i + self.window[i]].tobytes()
            k = keys.setdefault(key, len(keys))
            if k == len(self.items_of):
                self.items_of.append(set())
            self.items_of[k].add(self.ids[self.item[i]])
            self.classes[i] = k


def suffix_order(text: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Places of ``text`` that do not hold 0, sorted by the words from there on, up to the first 0 or ``depth`` words.

    Several words are packed into one key; only places that tie go on to the next key. ``text`` must end in zeros.
    """
    per_key = 62 // bits
    places = np.flatnonzero(text)

    def packed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(per_key):
            word = text[np.minimum(at + k, len(text) - 1)]
            alive &= word > 0
            key = (key << bits) | np.where(alive, word, 0)
        return key, alive

    key, alive = packed(places)
    order = np.argsort(key, kind="stable")
    places, key, alive = places[order], key[order], alive[order]
    tied = np.arange(len(places))
    group, done = key, per_key
    while done < depth and len(tied):
        # neighbours with equal keys that did not end form groups; each is ordered by its next key
        new = np.append(True, group[1:] != group[:-1])
        number = np.cumsum(new) - 1
        many = (np.bincount(number)[number] > 1) & alive
        tied, number = tied[many], number[many]
        if not len(tied):
            break
        key, alive = packed(places[tied] + done)
        order = np.lexsort((key, number))
        places[tied] = places[tied][order]
        key, alive = key[order], alive[order]
        changed = np.append(True, (number[1:] != number[:-1]) | (key[1:] != key[:-1]))
        group, done = np.cumsum(changed), done + per_key
    return places


def common(text: np.ndarray, at: np.ndarray, items: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words that each place of the text shares with the beginning of a test suffix of ``size`` words."""
    out = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    reach = np.arange(STEP)
    while len(live):
        done = out[live]
        left = text[np.minimum(at[live, None] + done[:, None] + reach, len(text) - 1)]
        right = items[start[live, None] + done[:, None] + reach]
        equal = (left == right) & (done[:, None] + reach < size[live, None])
        run = np.where(equal.all(axis=1), STEP, np.argmin(equal, axis=1))
        out[live] += run
        live = live[run == STEP]
    return out


def lower_bound(text: np.ndarray, order: np.ndarray, items: np.ndarray, start: np.ndarray, size: np.ndarray, past: bool = False) -> np.ndarray:
    """First place in ``order`` not before each test suffix cut to ``size`` words; with ``past``, first one after all that begin with it."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        at = order[mid]
        n = common(text, at, items, start[open_], size[open_])
        whole = n == size[open_]
        word = text[np.minimum(at + n, len(text) - 1)]
        before = np.where(whole, past, word < items[start[open_] + n])
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)


class Shard:
    """Words of some documents, or parts of them, one after the other with zeros between."""

    def __init__(self) -> None:
        self.docs: list[Document] = []
        self.parts: list[np.ndarray] = []
        self.begins: list[int] = []
        self.size = 0

    def add(self, doc: Document, begin: int, words: np.ndarray) -> None:
        self.docs.append(doc)
        self.parts.append(words)
        self.begins.append(begin)
        self.size += len(words) + 64  # a document without words takes memory too

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts that places of the shard lie in, and words before them in the part's document."""
        part = np.searchsorted(self.first, at, side="right") - 1
        return part, at - self.first[part] + np.array(self.begins, np.int64)[part]

    def search(self, s: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per run of test suffixes: their numbers, longest matches, a place of each, and range of places of its window."""
        gap = np.zeros(1, np.int64)
        self.first = np.cumsum([0, *(len(p) + 1 for p in self.parts)])
        text = np.concatenate([x for part in self.parts for x in (part, gap)] + [gap])
        self.order = order = suffix_order(text, s.depth, s.bits)
        if not len(order):
            return
        for begin in range(0, len(s.at), SEARCHED):
            at, size = s.at[begin : begin + SEARCHED], s.size[begin : begin + SEARCHED]
            found = lower_bound(text, order, s.words, at, size)
            longest, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for k in (found, found - 1):  # the longest match is with a neighbour
                ok = np.flatnonzero((k >= 0) & (k < len(order)))
                n = np.zeros(len(at), np.int64)
                n[ok] = common(text, order[k[ok]], s.words, at[ok], size[ok])
                better = n > longest
                longest[better], place[better] = n[better], order[k[better]]
            window = s.window[begin : begin + SEARCHED]
            low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            hit = np.flatnonzero((window > 0) & (longest >= window))
            _, first = np.unique(s.classes[begin + hit], return_index=True)  # equal windows have equal ranges
            hit = hit[first]
            low[hit] = lower_bound(text, order, s.words, at[hit], window[hit])
            high[hit] = lower_bound(text, order, s.words, at[hit], window[hit], past=True)
            yield np.arange(begin, begin + len(at)), longest, place, low, high


@dataclass
class Document:
    """A document on its way through the shards of a task."""

    doc_id: int | None
    n_words: int = 0
    spans: list[np.ndarray] = field(default_factory=list)
    classes: set[int] = field(default_factory=set)


def merged(spans: list[np.ndarray]) -> np.ndarray:
    """Union of (begin, end) rows as disjoint rows in order."""
    if not spans:
        return np.empty((0, 2), np.int64)
    rows = np.concatenate(spans)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    end = np.maximum.accumulate(rows[:, 1])
    new = np.flatnonzero(rows[1:, 0] > end[:-1]) + 1
    return np.stack([rows[np.append(0, new), 0], end[np.append(new - 1, len(end) - 1)]], axis=1)


def _shards(batches: Iterator[pa.RecordBatch], block: Block, suffixes: Suffixes) -> Iterator[tuple[Shard, list[Document]]]:
    """Shards of a task in turn, each with the documents that end in it."""
    step = max(SHARD_WORDS, suffixes.depth)
    shard, ended = Shard(), []
    for batch in small(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)), strict=True):
            doc, held, size = Document(doc_id), [], 0
            for words in word_pieces(text):
                held.append(np.fromiter(map(block.vocabulary.get, words, repeat(0)), np.int64, len(words)))
                doc.n_words, size = doc.n_words + len(words), size + len(words)
                while size >= step + suffixes.depth:  # a long document: a part, with the words that a match may need beyond it
                    part = np.concatenate(held)
                    shard.add(doc, doc.n_words - size, part[: step + suffixes.depth])
                    yield shard, ended
                    shard, ended = Shard(), []
                    held, size = [part[step:]], size - step
            shard.add(doc, doc.n_words - size, np.concatenate([*held, np.zeros(0, np.int64)]))
            ended.append(doc)
            if shard.size >= SHARD_WORDS:
                yield shard, ended
                shard, ended = Shard(), []
    yield shard, ended


def _scan(batches: Iterator[pa.RecordBatch], block, window: int) -> Iterator[pa.RecordBatch]:
    """Each document's words, hit spans and items."""
    block, known = block.value, {}
    suffixes = block.suffixes(window)
    for shard, ended in _shards(batches, block, suffixes):
        for number, _, _, low, high in shard.search(suffixes):
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            at = np.concatenate([shard.order[low[k] : high[k]] for k in hit])
            which = number[np.repeat(hit, (high - low)[hit])]
            part, at = shard.places(at)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for own in np.split(order, cuts):
                doc = shard.docs[part[own[0]]]
                doc.spans = [merged([*doc.spans, np.stack([at[own], at[own] + suffixes.window[which[own]]], axis=1)])]
                doc.classes.update(np.unique(suffixes.classes[which[own]]).tolist())
        items = []
        for doc in ended:
            key = frozenset(doc.classes)
            if key not in known:
                if len(known) >= 10_000:
                    known.clear()
                known[key] = sorted(set().union(*(suffixes.items_of[k] for k in key)))
            items.append(known[key])
        yield pa.RecordBatch.from_arrays(
            [pa.array([d.doc_id for d in ended], pa.int64()), pa.array([d.n_words for d in ended], pa.int64()),
             lists([merged(d.spans).ravel() for d in ended], pa.int64()), pa.array(items, pa.list_(pa.string()))],
            names=["doc_id", "n_words", "spans", "items"])


def _longest(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    """Per shard and item, its longest match and where it is."""
    block = block.value
    suffixes = block.suffixes(WINDOW)
    for shard, _ in _shards(batches, block, suffixes):
        for number, longest, place, _, _ in shard.search(suffixes):
            item, offset = suffixes.item[number], suffixes.offset[number]
            order = np.lexsort((offset, -longest, item))
            best = order[np.append(True, np.diff(item[order]) > 0)]
            best = best[longest[best] > 0]
            part, at = shard.places(place[best])
            yield pa.RecordBatch.from_arrays(
                [pa.array([suffixes.ids[i] for i in item[best]], pa.string()), pa.array(longest[best]), pa.array(offset[best]),
                 pa.array([shard.docs[p].doc_id for p in part], pa.int64()), pa.array(at)],
                names=["item_id", "n_words", "item_begin", "doc_id", "doc_begin"])


def blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Block]:
    """The test items in blocks of bounded size, one at a time in the driver.

    An item with more words than a block is cut into parts that overlap by a window less one word, so no window is lost.
    """
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    block, before = Block(), False
    for item_id, text in rows.toLocalIterator():
        held: list[bytes] = []
        for words in word_pieces(text.encode() if text else None):
            held += words
            while len(held) > BLOCK_WORDS:
                if block.words:
                    yield block
                    block, before = Block(), True
                block.add(item_id, held[:BLOCK_WORDS])
                held = held[BLOCK_WORDS - window + 1 :]
        if len(block.words) + len(held) > BLOCK_WORDS and block.words:
            yield block
            block, before = Block(), True
        if held:
            block.add(item_id, held)
    if block.words or not before:
        yield block


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Where windows of the test items occur in the documents.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole. Words are lower-cased in A-Z; all
    but letters, digits and non-ASCII characters separates. Returns ``doc_id, n_words, spans, items``, one row per input
    row: ``spans`` holds begin, end, begin, end, ... of the words inside occurrences, disjoint and in order; ``items`` the
    ids of the items with an occurring window, each once, sorted as strings.

    Null and empty texts have no words and no span; items without words match nothing; an item without an id counts
    under the empty string, items that share an id as one. Documents of any length are searched in parts that overlap
    by the longest item. Rows that repeat an id are judged one by one. Empty tables give no rows or no spans. Other
    columns are not read. A benchmark beyond ``BLOCK_WORDS`` words is searched in blocks, one pass each over a written
    copy of the texts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, spans array<long>, items array<string>"
    found, scratch, last = [], None, None
    for block in blocks(items, item_col, item_text_col, window):
        if last is not None:
            if scratch is None:  # several blocks: rows need a number that every pass agrees on
                scratch = Scratch(spark, "contamination")
                texts = scratch.save(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
            found.append(scratch.save(_pass(texts.select("row", "text"), last, window, schema), "found"))
        last = block
    if scratch is None:
        return _pass(texts, last, window, schema)
    found.append(scratch.save(_pass(texts.select("row", "text"), last, window, schema), "found"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", 2 * i).alias("b"), F.get("spans", 2 * i + 1).alias("e")))
    hits = hits.select(F.col("doc_id").alias("row"), "n_words", F.when(F.size("spans") > 0, pairs).otherwise(F.array()).alias("spans"), "items")
    hits = hits.groupBy("row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return texts.select("row", "doc_id").join(hits, "row").select("doc_id", "n_words", _union("spans").alias("spans"), "items")


def _union(spans: str) -> F.Column:
    """Flat disjoint begins and ends of sorted (b, e) structs that may overlap."""
    def step(acc, x):
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["e"])))
        return F.when((F.size(acc) > 0) & (x["b"] <= F.get(acc, F.size(acc) - 1)), joined).otherwise(F.concat(acc, F.array(x["b"], x["e"])))
    return F.aggregate(spans, F.array().cast("array<long>"), step)


def _pass(texts: DataFrame, block: Block, window: int, schema: str) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_WORDS
    return texts.mapInArrow(partial(_scan, block=shipped, window=window), schema)


def longest_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text") -> DataFrame:
    """Each item's longest verbatim match: ``item_id, n_words, item_begin, doc_id, doc_begin``, places counted in words.

    Ties go to the earlier place in the item, then to the smaller id and place of the document. Items that share no word
    with any document have no row. An item longer than a block is matched in parts of that length. Each shard sends one
    row per item at most.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block in blocks(items, item_col, item_text_col, WINDOW):
        shipped = docs.sparkSession.sparkContext.broadcast(block)
        one = texts.mapInArrow(partial(_longest, block=shipped), "item_id string, n_words long, item_begin long, doc_id long, doc_begin long")
        found = one if found is None else found.union(one)
    best = F.max_by(F.struct("n_words", "item_begin", "doc_id", "doc_begin"), F.struct(
        "n_words", -F.col("item_begin"), F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("doc_begin")))
    return found.groupBy("item_id").agg(best.alias("m")).select("item_id", "m.*")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without those that a window occurs in, columns unchanged.

    Rows without an id are judged like all others: each row is found by a number of its own, in a written copy.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    kept = scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns(docs)).alias("doc")), "rows")
    found = find_contamination(kept.select("row", F.col("doc")[text_col].alias("text")), items, "row", "text", window=window)
    clean = found.where(F.size("spans") == 0).select(F.col("doc_id").alias("row"))
    return kept.join(clean, "row", "left_semi").select("doc.*")



@query("op12_benchmark_decontamination", sql=r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
    SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS w
    FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0)),
places AS (
    SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS w
    FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k)),
hits AS (SELECT r, i, k, item_id FROM places JOIN windows USING (k, w)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ends = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", ends.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
