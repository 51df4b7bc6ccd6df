"""Resampling, decontamination and whitening against brute-force versions on small odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import DATA, compare_rows, database
from pyspark.sql import functions as F

from panelcraft.llm import decontamination, importance, plain_words, selection, whitening
from panelcraft.llm.catalog import ORACLE, QUERIES
from panelcraft.llm.scratch import Scratch

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_words string, score int, rank string, spans int, items string, row int"


def words(text: str | None) -> list[bytes]:
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())


def texts() -> list:
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéß0") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    made += [None, "", " \n", "...", "ÀB-cd\x00Ef_gh", "x" * 200 + " y " + "z" * 63 + " " + "w" * 62, "one two three four", made[0], made[0] + " " + made[1]]
    made += [" ".join(rng.choice(vocabulary) for _ in range(40_000)), "a " * 30]
    return made


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "r", 2, "i", 3) for i, t in enumerate(texts())]
    rows += [rows[3], (5, "another text under an id that is taken", "x", 1, "r", 2, "i", 3), (None, texts()[2], "x", 1, "r", 2, "i", 3), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    made, rng = texts(), random.Random(3)
    rows = [(1, " ".join(made[4].split()[:14])), (2, " ".join(made[7].split()[-12:]) + " other tail of it"), (11, "One, two THREE four"), (12, None), (13, " . "),
            (3, " ".join(made[9].split()[:11])), (3, " ".join(made[69].split()[500:560])), (None, " ".join(made[69].split()[39_980:])),
            (5, "words that are nowhere else " * 3), (6, " ".join(made[4].split()[2:14])), (7, "a a a"), (8, " ".join(rng.choice(made[69].split()) for _ in range(30)))]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def test_word_pieces(monkeypatch):
    monkeypatch.setattr(plain_words, "PIECE", 7)
    for t in texts():
        assert [w for piece in plain_words.word_pieces(t.encode() if t else None) for w in piece] == words(t)


def brute_features(text: str | None) -> list[int]:
    w = words(text)
    return [zlib.crc32(x) % 10_000 for x in w] + [zlib.crc32(a + b" " + b) % 10_000 for a, b in zip(w, w[1:])]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_features(monkeypatch, piece):
    monkeypatch.setattr(plain_words, "PIECE", piece)
    monkeypatch.setattr(importance, "CACHE_WORDS", 50)
    features = importance.Features()
    for t in texts():
        found = list(features.of(t.encode() if t else None))
        assert sorted(b for _, piece in found for b in piece.tolist()) == sorted(brute_features(t))
        assert sum(n for n, _ in found) == len(words(t))


def brute_resample(docs: list, target: list, percent: int, least: int, seed: int) -> dict:
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(brute_features(text))
    for text in target:
        t.update(brute_features(text))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)}
    rows = []
    for i, text in docs:
        f = brute_features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = fit[: percent * len(fit) // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)]) + Counter([(*r[:4], None) for r in rows]) - Counter([(*r[:4], None) for r in drawn])


@pytest.mark.parametrize("percent, least", [(25, 20), (50, 1), (100, 0), (0, 5)])
def test_resample(docs, none, items, monkeypatch, percent, least):
    monkeypatch.setattr(selection, "CHUNK", 8)
    got = importance.resample(docs, items, percent=percent, least_words=least)
    want = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()], percent, least, 7)
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r)[:5] for r in got.collect()) == want
    assert importance.resample(none, items).count() == 0
    assert importance.resample(docs, none).count() == docs.count()


def test_resample_query(spark):
    sf = f"{DATA}/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_resample(rows, [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 25, 20, 7)
    assert Counter(tuple(r)[:5] for r in QUERIES["op11_importance_resampling"](spark, sf).collect()) == want


@pytest.mark.parametrize("chunk, ties", [(3, 2), (64, 1000), (1 << 20, 10**9), (5, 1)])
def test_kth_key(spark, monkeypatch, chunk, ties):
    monkeypatch.setattr(selection, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(rng.randrange(ties), rng.randrange(3)) for _ in range(500)]
    keys = spark.createDataFrame(rows, "a long, b long").repartition(5)
    keys = Scratch(spark, "test").save(keys, "keys")
    for k in (1, 250, 500):
        assert selection.kth_key(keys, k, Scratch(spark, "test")) == sorted(rows)[k - 1]
    with pytest.raises(ValueError):
        selection.kth_key(keys, 501, Scratch(spark, "test"))


def brute_hits(doc: str | None, items: list, window: int) -> tuple[int, set, list[str]]:
    d, hit, ids = words(doc), set(), set()
    for item_id, text in items:
        w = words(text)
        size = min(window, len(w))
        if not size:
            continue
        runs = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(d) - size + 1):
            if tuple(d[i : i + size]) in runs:
                hit |= set(range(i, i + size))
                ids.add("" if item_id is None else str(item_id))
    return len(d), hit, sorted(ids)


def spread(spans: list[int]) -> set:
    assert all(a < b for a, b in zip(spans, spans[1:]))
    return {p for b, e in zip(spans[::2], spans[1::2]) for p in range(b, e)}


@pytest.mark.parametrize("shard, block, searched, window", [(1 << 20, 1 << 21, 1 << 15, 10), (100, 1 << 21, 7, 10), (50, 40, 16, 10), (1000, 70, 64, 4)])
def test_contamination(docs, none, items, monkeypatch, shard, block, searched, window):
    for name, value in (("SHARD_WORDS", shard), ("BLOCK_WORDS", block), ("SEARCHED", searched)):
        monkeypatch.setattr(decontamination, name, value)
    given = [(r["item_id"], r["text"]) for r in items.collect()]
    got = decontamination.find_contamination(docs, items, window=window).collect()
    want = Counter()
    for r in docs.collect():
        n, hit, ids = brute_hits(r["text"], given, window)
        want[r["doc_id"], n, tuple(sorted(hit)), tuple(ids)] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple(sorted(spread(r["spans"]))), tuple(r["items"])) for r in got) == want
    clean = decontamination.decontaminate(docs, items, window=window)
    assert clean.columns == docs.columns
    assert Counter(r["text"] for r in clean.collect()) == Counter(r["text"] for r in docs.collect() if not brute_hits(r["text"], given, window)[1])
    assert decontamination.find_contamination(none, items).count() == 0
    empty = decontamination.find_contamination(docs, items.limit(0)).collect()
    assert len(empty) == docs.count() and not any(r["spans"] or r["items"] for r in empty)


def test_longest_matches(docs, none, items, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", 200)
    some = docs.where("length(text) < 10000")
    got = {r["item_id"]: tuple(r)[1:] for r in decontamination.longest_matches(some, items.where("item_id <> 3")).collect()}
    rows = [(r["doc_id"], words(r["text"])) for r in some.collect()]
    for item in items.where("item_id <> 3").collect():
        w, best = words(item["text"]), 0
        for _, d in rows:
            for i in range(len(w)):
                for j in range(len(d)):
                    n = 0
                    while i + n < len(w) and j + n < len(d) and w[i + n] == d[j + n]:
                        n += 1
                    best = max(best, n)
        key = str(item["item_id"])
        assert got.get(key, (0,))[0] == best
        if best:
            n, begin, doc_id, at = got[key]
            assert any(i == doc_id and d[at : at + n] == w[begin : begin + n] for i, d in rows)
    assert decontamination.longest_matches(none, items).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(2)
    for bits, depth in ((2, 40), (3, 5), (30, 50)):
        text = np.append(rng.integers(0, 4, 400), [0, 0])
        text[100:140] = text[200:240]
        places = decontamination.suffix_order(text, depth, bits)
        assert sorted(places) == list(np.flatnonzero(text))

        def cut(i):
            w = text[i : i + depth].tolist()
            return w[: w.index(0) if 0 in w else depth]
        assert [cut(i) for i in places] == sorted(cut(i) for i in places)


def test_decontamination_sql(spark):
    sf = f"{DATA}/sf0.001"
    assert not compare_rows(QUERIES["op12_benchmark_decontamination"](spark, sf), database(sf), ORACLE["op12_benchmark_decontamination"])


def vectors(seed: int, n: int, d: int) -> list:
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d)).tolist()


def brute_whiten(rows: list) -> tuple[dict, np.ndarray, float, int]:
    good = [(i, [int(math.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), object)
    n = len(fit)
    mean = fit.sum(axis=0)
    v = np.array(((n * fit - mean).T @ (n * fit - mean)) / n**3, float)
    values, components = np.linalg.eigh(v)
    values, components = values[::-1], components[:, ::-1]
    deviation = {i: int(((n * np.array(x, object) - mean) ** 2).sum()) for i, x in good}
    z = {i: (np.array(n * np.array(x, object) - mean, float) / n) @ components / np.sqrt(np.maximum(values, 1e-300)) for i, x in good}
    return {i: (deviation[i], z[i]) for i in z}, values, float(values.sum()), n


@pytest.mark.parametrize("d, repeats", [(5, 0), (20, 3), (33, 0)])
def test_whiten(spark, d, repeats):
    rows = list(enumerate(vectors(d, 150, d)))
    if repeats:  # a constant and two equal dimensions: the rank is smaller
        for _, v in rows:
            v[1], v[2] = 0.25, v[0]
    rows += [(1000 + i, rows[7][1]) for i in range(repeats * 20)]
    odd = [(500, None), (501, [None] * d), (502, [math.nan] * d), (503, [math.inf] + [0.0] * (d - 1)), (504, []), (505, [1.0]), (506, [1e30] + [0.0] * (d - 1))]
    table = spark.createDataFrame([(i, v, 3, 0.5) for i, v in rows + odd], "vec_id long, embedding array<double>, component int, n double").repartition(5)
    got = whitening.whiten(table).collect()
    want, values, trace, n = brute_whiten(rows)
    width = min(16, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(rows) * width
    signs = {}
    for r in sorted(got, key=lambda r: (r["component"], -abs(r["whitened"]))):
        deviation, z = want[r["vec_id"]]
        k = r["component"] - 1
        sign = signs.setdefault(k, math.copysign(1, r["whitened"] * z[k]))
        assert r["deviation"] == deviation and r["n"] == n
        assert abs(r["whitened"] - sign * z[k]) < 1e-7
        assert abs(r["explained"] / (values[k] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whiten_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (None, [0.5, 1.0])], schema)).count() == 0
    # far entries: whole numbers of any size, deviations beyond a long are null
    far = spark.createDataFrame([(i, [float(10**15 + i * 2**20), float(i % 3)]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(far).collect()
    assert len(got) == 18 and max(r["identity_error"] for r in got) < 1e-9
    assert whitening.exact_products(np.array([[2**40, 3]])).tolist() == [[2**80, 3 * 2**40], [3 * 2**40, 9]]
    for n in (0, 5, -5, 2**150, -(2**150), -1):
        assert sum(x << whitening.DIGIT * k for k, x in enumerate(whitening._digits(n))) == n


def test_whiten_query(spark):
    sf = f"{DATA}/sf0.001"
    got = QUERIES["op13_embedding_whitening"](spark, sf)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, values, trace, _ = brute_whiten(rows)
    for r in got.where(F.col("component").isin(1, 16)).collect():
        deviation, z = want[r["vec_id"]]
        assert r["deviation"] == deviation and abs(abs(r["whitened"]) - abs(z[r["component"] - 1])) < 1e-6
        assert abs(r["explained"] / (values[r["component"] - 1] / trace) - 1) < 1e-4
