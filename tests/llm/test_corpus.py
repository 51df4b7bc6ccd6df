"""Corpus operators against brute-force versions on small tables with nulls, empty and long texts, copies and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from oracle import DATA, compare_rows, database
from pyspark.sql import functions as F

import corpus_pipeline
from panelcraft.llm import bpe, exact_dedup, language_id, mixing, near_dedup, quality_classifier, quality_rules, sharding, url_filters, warc
from panelcraft.llm.catalog import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, keep_id int, row int, size int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sample_texts() -> list:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [None, "", "  \n\t", "Uno", "uno", "a b", "A  b", "Ünï ß", "one two three four five", " ".join(base)]
    for edits in (0, 1, 2, 4, 6, 8, 10, 20, 40):
        for _ in range(3):
            words = list(base)
            for at in rng.sample(range(len(words)), edits):
                words[at] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    texts += [" ".join(base[:20]) + " tail " + " ".join(base[:20]), "x " * 40, " ".join(rng.choice(vocabulary) for _ in range(30_000))]
    return texts + texts[:14]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 7 == 0 else f"src{i % 3}", 0, "h", 1, 2, 3) for i, t in enumerate(sample_texts())]
    rows += [rows[9], (None, "no id", "en", "src1", 0, "h", 1, 2, 3)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("content_hash", [exact_dedup.md5_bytes, lambda text: F.md5(F.substring(text, 1, 1))])
def test_exact_dedup(docs, none, content_hash):
    got = exact_dedup.exact_dedup(docs, content_hash=content_hash).collect()
    assert len(got) == docs.count()
    norm = {r["doc_id"]: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()}
    size = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect())
    for r in got:
        text = norm[r["doc_id"]]
        first = min((i for i, t in norm.items() if t == text and i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (first, size[text], r["doc_id"] == first)
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def brute_components(texts: dict, width: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(i for i in sets if sets[i] and i is not None), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width, percent, small", [(3, 85, 64), (5, 80, 64), (3, 85, 2)])
def test_near_dedup(docs, none, monkeypatch, width, percent, small):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)  # 2: nearly all buckets are compared in blocks
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 64 if small > 2 else 3)
    got = near_dedup.near_dedup(docs, width=width, percent=percent).collect()
    want = brute_components({r["doc_id"]: r["text"] for r in docs.collect()}, width, percent)
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dedup.near_dedup(none).count() == 0


def test_language(docs, none, spark):
    made = [(i, t, lang, "s", 0, "h", 1, 2, 3) for i, (t, lang) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de")] * 20)]
    model = language_id.fit(spark.createDataFrame(made, SCHEMA))
    assert model.languages == ["de", "en"]
    got = by_id(language_id.identify(docs, model))
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[2]["lang_pred"] == "und" and got[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert model.scores("der baum")[0] > 0.5 > model.scores("the tree")[0]
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(none)).collect()} == {"und"}
    # pieces do not change the counts
    long = "".join(random.Random(1).choice("ab c1é") for _ in range(3000))
    whole = np.sort(np.concatenate(list(language_id.document_buckets(long))))
    old, language_id.PIECE = language_id.PIECE, 97
    try:
        assert (np.sort(np.concatenate(list(language_id.document_buckets(long)))) == whole).all()
    finally:
        language_id.PIECE = old


def test_language_held_out(spark):
    sf = f"{DATA}/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op4_language_id"](spark, sf).where("held_out").join(truth, "doc_id")
    assert held.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_quality_held_out(spark, docs, none):
    sf = f"{DATA}/sf0.1"
    truth = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    held = QUERIES["op3_quality_classifier"](spark, sf).where("held_out").join(truth, "doc_id")
    assert held.select(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.97
    weights = quality_classifier.fit(docs, none.select("doc_id", F.lit(1).alias("quality")))
    assert {r["score"] for r in quality_classifier.score(docs, weights).collect()} == {0.5}


def test_quality_rules(docs, none):
    got = quality_rules.repetition(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == docs.count() and quality_rules.repetition(none).count() == 0
    for r in got:
        t = texts[r["doc_id"]]
        w = WORDS.findall(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        spans = [k for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True) for k in range(a, b)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered)) and spans == sorted(covered)
        if 0 < len(w) < 200:
            longest = max((n for n in range(8, len(w)) if len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) < len(w) - n + 1), default=0)
            assert r["longest_repeat"] == longest


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        supply = {i: rng.randint(0, 6) for i in range(3)}
        total = sum(supply.values())
        capacity = {j: total // 3 + (j < total % 3) for j in range(3)}
        price = {(i, j): rng.randint(0, 4) for i in range(3) for j in range(3)}
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: price[i, j])
        assert all(sum(v for (i, _), v in flow.items() if i == k) == supply[k] for k in supply)
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacity[k] for k in capacity)
        best = {tuple(capacity.values()): 0}  # room left -> least cost, one unit at a time
        for i, n in supply.items():
            for _ in range(n):
                new: dict = {}
                for room, cost in best.items():
                    for j in range(3):
                        if room[j]:
                            key = tuple(r - (k == j) for k, r in enumerate(room))
                            new[key] = min(new.get(key, 10**9), cost + price[i, j])
                best = new
        assert sum(price[k] * v for k, v in flow.items()) == min(best.values())
    with pytest.raises(ValueError):
        sharding.min_cost_flow({0: 5}, {0: 4}, sharding.stay_home)


def test_reshard(docs, none, tmp_path, spark):
    plan = sharding.reshard(docs, 4, F.pmod(F.col("doc_id"), F.lit(3)))
    got = plan.collect()
    assert len(got) == docs.count()
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.reshard(none, 4, F.lit(0)).count() == 0
    plain = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    plan = sharding.reshard(plain, 4, F.pmod(F.col("doc_id"), F.lit(3)))
    touched = sharding.write_affected(plain, plan, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == plan.where(F.col("shard").isin(touched)).count() and set(plain.columns) <= set(back.columns)


def test_mixing(docs, none):
    got = mixing.mix_documents(docs, mixing.production_mix()).collect()
    assert len(got) == docs.count() and all(0 <= r["p"] <= 1 and r["kept"] == (r["u"] < r["p"]) for r in got)
    assert {r["source"] for r in got} <= {*mixing.SOURCES, "other"} and mixing.mix_documents(none, mixing.production_mix()).count() == 0
    tokens = np.random.default_rng(3).integers(50, 100, (3, 2, 2)).astype(float)
    targets = [np.array([0.3, 0.3, 0.4]), np.array([0.55, 0.45]), np.array([0.5, 0.5])]
    p, met, settled = mixing.rake(tokens, targets, 0.3)
    assert met and settled
    kept = tokens * p
    for axis, target in enumerate(targets):
        assert np.allclose(kept.sum(axis=tuple(i for i in range(3) if i != axis)) / kept.sum(), target, atol=1e-6)
    assert np.isclose(kept.sum(), 0.3 * tokens.sum())


def slow_rake(tokens: dict, targets: list[dict], keep: float, most: float) -> dict:
    """Plain loops over cells, one margin after the other, many times."""
    total, p = sum(tokens.values()), {c: keep for c in tokens}
    for _ in range(3000):
        for axis, target in enumerate(targets):
            got: Counter = Counter()
            for c in tokens:
                got[c[axis]] += tokens[c] * p[c]
            there = {k: v for k, v in target.items() if got[k] > 0}
            for c in tokens:
                want = there.get(c[axis], 0) / sum(there.values()) * keep * total
                p[c] = min(most, p[c] * want / got[c[axis]]) if got[c[axis]] else 0.0
    return p


@pytest.mark.parametrize("keep, least, met", [(0.2, None, True), (0.9, None, False), (0.9, 0.05, True)])
def test_mixing_margins(spark, keep, least, met):
    rng, rows = random.Random(7), []
    for i in range(600):
        rows.append((i, " ".join(["w"] * rng.randint(1, 30)), rng.choice("aaaaab"), rng.choice("xy")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    mix = mixing.Mix({"source": {"a": 0.6, "b": 0.4}, "lang": {"x": 3, "y": 1}}, keep, least)
    got = mixing.mix_documents(docs, mix).collect()
    tokens: Counter = Counter()
    for r in got:
        tokens[r["source"], r["lang"]] += r["tokens"]
    assert all(r["met"] == met and r["settled"] for r in got)
    p = {(r["source"], r["lang"]): r["p"] for r in got}
    total = sum(tokens[c] * p[c] for c in p) / sum(tokens.values())
    want = slow_rake(tokens, [{"a": 0.6, "b": 0.4}, {"x": 0.75, "y": 0.25}], total if met else keep, 1.0)
    assert all(abs(p[c] - want[c]) < 1e-6 for c in p)
    told = {(r["margin"], r["category"]): r for r in mixing.shares(docs, mix).collect()}
    assert len(told) == 4 and all(abs(r["expected"] - r["target"]) < 1e-9 for r in told.values()) == met
    assert abs(told["source", "b"]["drawn"] - sum(r["tokens"] for r in got if r["kept"] and r["source"] == "b") / sum(r["tokens"] for r in got if r["kept"])) < 1e-12
    if met and least:
        assert max(p.values()) == pytest.approx(1.0) and total < keep


def test_mixing_without_ids(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "a", "x") for i in range(400)], "doc_id long, text string, source string, lang string")
    kept = mixing.mix_documents(docs, mixing.Mix({"source": {"a": 1.0}}, 0.5)).where("kept").count()
    assert 120 < kept < 280


def test_quality_method_decides(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    paragraph = " ".join(word() for _ in range(40))
    long = " ".join([paragraph] + [word() for _ in range(400)] + [paragraph])
    short = " ".join([" ".join(paragraph.split()[:12])] + [word() for _ in range(400)] + [" ".join(paragraph.split()[:12])])
    docs = spark.createDataFrame([(1, long), (2, short), (3, " ".join(word() for _ in range(90_000)))], "doc_id long, text string")
    got = by_id(quality_rules.judged(quality_rules.repetition(docs)))
    assert [(got[i]["base_failed"], got[i]["kept"]) for i in (1, 2, 3)] == [(False, False), (False, True), (False, True)]


def test_bpe_equals_library(docs, none):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(4)
    signs = "aabcdeinorst'sd. 019ÀéÉßİΣσﬁ①½中ไ😀 \x1c\x85!?*ͅ​"
    texts = ["", "<|startoftext|>x<|endoftext|> <|ENDOFTEXT|>", "it's I'LL", "é Á", "a" * 5000]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    own = bpe.tokenizer(path)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids, decimal = own.encode(text)
        assert ids.tolist() == want.ids and decimal == " ".join(map(str, want.ids))
        assert own.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)
    got = bpe.encode(docs, path).collect()
    digest = by_id(bpe.encode_digests(docs, path))
    assert len(got) == docs.count() and bpe.encode(none, path).count() == 0
    for r in got:
        assert digest[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
    assert digest[0]["n_tokens"] == 0


def test_urls(spark):
    rows = [(0, "http://A.example.com/en/x", None, 1), (1, "https://www.example.com/en/", '<a href="//bad.net/">', 1), (2, None, "", 1), (3, "no scheme", "x", 1),
            (4, "http://bad.net/fr/?q", "", 1), (5, "http://linker.org/", "<a HREF='http://bad.net/fr/'>" * 3, 1), (6, "http://far.org#x", "", 1), (6, "http://far.org#x", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages).orderBy("page_id").collect()]
    assert got[0] == (0, "a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == (1, "www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[2] == (2, "", "", None, "allow") and got[3] == (3, "", "", None, "allow")
    assert got[4][3:] == ("net/fr/", "block") and got[5][3:] == (None, "block") and got[6] == got[7] == (6, "far.org", "", None, "allow")
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_urls_large_graph(spark):
    seeds = spark.range(1_000_000).select(F.col("id").alias("page_id"), F.lit("http://big.net/fr/").alias("url"), F.lit("").alias("html"))
    near = "".join(f"<a href='//n{i}.org/'>" for i in range(20))
    rows = [(-1, "http://weak.net/fr/", ""), *((-2 - i, f"http://n{i}.org/", "<a href='//weak.net/'>") for i in range(20)), (-30, "http://far.org/", near)]
    rows += [(-40 - i, f"http://f{i}.org/", "<a href='//n0.org/'>") for i in range(20)] + [(-90, "http://alone.org/", "")]
    pages = seeds.union(spark.createDataFrame(rows, seeds.schema))
    got = {r["host"]: r for r in url_filters.judge_urls(pages).where("page_id < 0").collect()}
    assert got["f3.org"]["distrust"] == got["f3.org"]["trust"] == 0  # below nine digits, still reached
    assert {h for h, r in got.items() if r["verdict"] == "allow"} == {"alone.org"}


def test_urls_far_from_seeds(spark):
    """Distrust reaches a host 40 links away, and scores on a ring miss the limit by no more than the stated share."""
    rows = [(0, "http://a0.net/fr/", ""), *((i, f"http://a{i}.org/", f"<a href='//a{i - 1}.{'org' if i > 1 else 'net'}/'>") for i in range(1, 41))]
    pages = spark.createDataFrame([*rows, (99, "http://alone.org/", "")], "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(pages).collect()}
    assert all(verdicts[i] == "block" for i in range(41)) and verdicts[99] == "allow"
    assert url_filters.DAMPING**url_filters.STEPS <= url_filters.UNMOVED
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 7}", 1) for i in range(7)], "src string, dst string, w long")
    seeds = spark.createDataFrame([("allow", "r0", 3), ("block", "r3", 1)], "kind string, host string, mass long")
    got = {r["host"]: r for r in url_filters.propagate(ring, seeds, url_filters.Scratch(spark, "ring")).collect()}
    exact = {i: (1 - 0.85) * 0.85**i / (1 - 0.85**7) for i in range(7)}
    for i in range(7):
        assert abs(got[f"r{i}"]["trust"] - exact[i]) < url_filters.UNMOVED and abs(got[f"r{(3 - i) % 7}"]["distrust"] - exact[i]) < url_filters.UNMOVED


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T  t</title><p>x &amp;lt; y<script>q</script><a href='/l'>l</a>", 5), (2, None, None, 6)],
                                  "page_id long, url string, html string, block int")
    made = warc.derivatives(warc.responses(pages))
    got = {(r["page_id"], r["record_type"]): r for r in made.collect()}
    assert len(got) == 4 and got[1, "conversion"]["block"] == "T t\nx &lt; yl"
    assert got[1, "metadata"]["block"].startswith("title: T t\r\noutlink: /l\r\nconversion: <urn:uuid:") and got[1, "conversion"]["record_id"] in got[1, "metadata"]["block"]
    assert got[1, "metadata"]["refers_to"] == got[1, "conversion"]["refers_to"] and got[2, "conversion"]["block"] == ""
    for r in warc.warc_bytes(made).collect():
        head, _, rest = bytes(r["warc"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert len(rest) == int(fields["Content-Length"]) + 4 and fields["WARC-Record-ID"] == r["record_id"]
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(rest[:-4]).hexdigest()
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    sf = f"{DATA}/sf0.01"
    assert compare_rows(QUERIES[name](spark, sf), database(sf), ORACLE[name]) == ""


def test_pipeline_stages(spark, docs, none):
    plain = docs.where("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source", "n_chars")
    texts = {r["doc_id"]: r["text"] for r in plain.collect()}
    told = corpus_pipeline.STAGES[0][1](spark, plain, "")
    assert told.columns == plain.columns
    letters = {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in told.collect()} == letters
    once = corpus_pipeline.STAGES[1][1](spark, told, "")
    norm: dict = {}
    for i in sorted(letters):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert {r["doc_id"] for r in once.collect()} == set(norm.values())
    near = corpus_pipeline.STAGES[2][1](spark, once, "")
    want = brute_components({i: texts[i] for i in norm.values()}, 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, c) in want.items() if i == c}
    mixed = corpus_pipeline.STAGES[3][1](spark, near, "")
    assert mixed.columns == plain.columns and mixed.count() <= near.count()
    ids = corpus_pipeline.STAGES[4][1](spark, mixed, "")
    assert ids.count() == mixed.count() and ids.where("n_tokens <> size(ids)").count() == 0
    odd = plain.select("*", *(F.lit("x").alias(c) for c in ("told", "TOLD_", "row", "p", "u", "tokens", "kept", "hash", "_lang", "a.b")))
    for _, stage in corpus_pipeline.STAGES[:-1]:  # further columns stay, whatever their names
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.where("told <> 'x' OR tokens <> 'x' OR hash <> 'x'").count() == 0 and out.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*plain.columns), "").count() == 0


def test_near_rows_with_shared_and_missing_ids(spark):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    base, lone, other, third = words(120), words(90), words(80), words(70)
    rows = [(3, base), (7, base + " tail"), (7, lone), (None, other), (None, other + " x"), (8, third + " y"), (None, third), (9, None), (9, ""), (None, None), (None, "  ")]
    made = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = Counter((r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(spark, made, "").collect())
    must = Counter([(3, base), (7, lone), (8, third + " y"), (9, None), (9, ""), (None, None), (None, "  ")])
    assert got - must in (Counter([(None, other)]), Counter([(None, other + " x")])) and not must - got
    told = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(made).collect())
    assert told == Counter([(3, 3, True), (7, 3, False), (7, 7, True), (None, None, True), (None, None, True), (8, 8, True), (None, 8, False), (9, 9, True), (9, 9, True),
                            (None, None, True), (None, None, True)])


def test_pipeline_rows(spark, docs):
    """All stages over rows with null and repeated ids, compared as rows."""
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    words = [f"w{i}" for i in range(90)]
    extra = [(5, " ".join(words)), (5, " ".join(words[:-1])), (5, "a text of its own under a taken id"), (None, " ".join(words[::-1])), (None, " ".join(words[::-1]) + " z")]
    rows = rows.union(spark.createDataFrame([(*r, "en", "src1", 0) for r in extra], rows.schema))
    told = corpus_pipeline.STAGES[0][1](spark, rows, "")
    letters = [(r["doc_id"], r["text"]) for r in rows.collect() if any(c.isalpha() for c in r["text"] or "")]
    assert Counter((r["doc_id"], r["text"]) for r in told.collect()) == Counter(letters)
    once = exact_dedup.drop_copies(spark, told, "")
    left = [(r["doc_id"], r["text"]) for r in once.collect()]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    assert Counter(norm(t) for _, t in left) == Counter({norm(t) for _, t in letters})
    near = [(r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(spark, once, "").collect()]
    groups = {c for _, c in brute_components({i: t for i, (_, t) in enumerate(left)}, 5, 80).values()}
    place = {pair: i for i, pair in enumerate(left)}
    parts = brute_components({i: t for i, (_, t) in enumerate(left)}, 5, 80)
    assert not Counter(near) - Counter(left) and Counter(parts[place[x]][1] for x in near) == Counter(groups)
    least = {}
    for i, (doc_id, _) in enumerate(left):
        key = (doc_id is None, doc_id or 0)
        least[parts[i][1]] = min(least.get(parts[i][1], key), key)
    assert all(least[parts[place[x]][1]] == (x[0] is None, x[0] or 0) for x in near)


def test_pipeline_exact_rows(spark):
    rows = [(1, "a b c"), (1, "a  b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, "only null"), (None, "only  null"), (None, "only null"),
            (3, "first text"), (4, "first text"), (4, "own text"), (5, None), (6, ""), (7, "x"), (7, "y")]
    made = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = Counter((r["doc_id"], re.sub(" +", " ", r["text"] or "")) for r in exact_dedup.drop_copies(spark, made, "").collect())
    want: dict = {}
    for i, t in rows:
        t = re.sub(" +", " ", t or "")
        want[t] = min(want.get(t, (True, 0)), (i is None, i or 0))
    assert got == Counter((None if null else i, t) for t, (null, i) in want.items())


def test_language_stage_keeps_letters(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rare = chr(0x30000) + chr(0x323AF)
    bare = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(["a b", rare, "1 2", None, "", "é"])], kind)
    got = language_id.drop_unknown_language(spark, bare, "")
    assert got.columns == bare.columns and {r["doc_id"]: r["lang"] for r in got.collect()} == {0: "und", 1: "und", 5: "und"}
    und = bare.withColumn("lang", F.lit("und"))  # a label like any other
    assert {r["doc_id"] for r in language_id.drop_unknown_language(spark, und, "").collect()} == {0, 1, 5}


def test_language_blocks(spark, monkeypatch):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(2)
    words = [["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3)] for _ in range(7)]
    rows = [(i, None if i == 5 else " ".join(rng.choices(words[i % 7], k=8)), f"l{i % 7}", "s", 0) for i in range(60)]
    made = spark.createDataFrame(rows, kind)
    whole = language_id.fit(made)
    want = by_id(language_id.identify(made, whole))
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 3)
    blocks = language_id.fit(made)
    assert [b.languages for b in blocks] == [["l0", "l1", "l2"], ["l3", "l4", "l5"], ["l6"]]
    got = by_id(language_id.identify(made, blocks))
    assert {i: r["lang_pred"] for i, r in got.items()} == {i: r["lang_pred"] for i, r in want.items()} and got[5]["lang_pred"] == "und"
    assert all(np.isclose(got[i]["score"], want[i]["score"]) for i in want)
    assert language_id.drop_unknown_language(spark, made, "").count() == 59
