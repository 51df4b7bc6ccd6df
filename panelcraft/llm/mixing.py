"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import columns, query, table

#: Category of every value without a target of its own, null included.
OTHER = "other"
#: Passes over the margins, the change of a weight from pass to pass at which they end, and the error of a margin that counts as met.
PASSES, TOLERANCE, MET = 1000, 1e-10, 1e-6

#: Production targets: shares of tokens per margin. They are scaled to sum to one.
SOURCES = {"src0": 0.2} | {f"src{i}": 0.8 / 19 for i in range(1, 20)}
LANGUAGES = {"en": 0.52, "de": 0.18, "fr": 0.17, "es": 0.13}
TOPICS = {"prose": 0.8, "table": 0.08, "contact": 0.07, "licence": 0.05}
#: Share of all tokens that the sample should have.
KEEP = 0.7


def topic(text: Column) -> Column:
    """A plain rule for the kind of text: tables, licence lines, contact data, else prose."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(F.lower(text), F.lit("licen")), "licence")
            .when(F.contains(text, F.lit("@")), "contact").otherwise("prose"))


def token_count(text: Column) -> Column:
    """Words of the text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends on the id only, or on the text where there is no id, so a repeated task draws the same sample."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.md5(text.cast("string").cast("binary")), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


@dataclass
class Mix:
    """Target shares per margin; ``columns`` maps a margin to the expression that gives a row's category.

    ``keep`` of all tokens are kept; fewer, but not less than ``least_keep``, where the targets can only be met so.
    """

    targets: dict[str, dict[str, float]]
    keep: float
    least_keep: float | None = None
    columns: dict[str, Column] = field(default_factory=dict)

    def category(self, margin: str, row: Column) -> Column:
        own = self.columns.get(margin, row[margin].cast("string"))
        return F.when(own.isin(*self.targets[margin]), own).otherwise(OTHER)


def raked(tokens: np.ndarray, targets: list[np.ndarray], start: float, most: float) -> tuple[np.ndarray, bool]:
    """Weights per cell of an n-way table, scaled margin after margin until the weighted tokens meet every target.

    ``start`` is the share of all tokens that the weighted ones should be, ``most`` the largest weight allowed. Returns
    the weights and whether they settled within the passes.
    """
    total, p = tokens.sum(), np.where(tokens > 0, min(start, most), 0.0)
    for _ in range(PASSES):
        before = p
        for axis, target in enumerate(targets):
            others = tuple(i for i in range(tokens.ndim) if i != axis)
            got = (tokens * p).sum(axis=others)
            want = np.where(tokens.sum(axis=others) > 0, target, 0.0)
            want = want / want.sum() * start * total if want.sum() > 0 else got
            factor = np.divide(want, got, out=np.zeros_like(got), where=got > 0)
            p = np.minimum(most, p * factor.reshape([-1 if i == axis else 1 for i in range(tokens.ndim)]))
        if np.abs(p - before).max() < TOLERANCE * max(1.0, float(p.max())):
            return p, True
    return p, False


def missed(kept: np.ndarray, targets: list[np.ndarray]) -> float:
    """Largest difference between a category's share of the kept tokens and its target, among categories that have tokens."""
    worst = 0.0
    for axis, target in enumerate(targets):
        got = kept.sum(axis=tuple(i for i in range(kept.ndim) if i != axis))
        want = np.where(got > 0, target, 0.0)
        worst = max(worst, float(np.abs(got / got.sum() - want / want.sum()).max()) if got.sum() and want.sum() else 1.0)
    return worst


def rake(tokens: np.ndarray, targets: list[np.ndarray], keep: float, least_keep: float | None = None) -> tuple[np.ndarray, bool, bool]:
    """Keeping probability per cell so that the kept tokens meet every margin's target; whether all are met, and settled.

    Weights without a bound meet the targets whatever the total is. If, scaled to the total ``keep``, or to one not below
    ``least_keep``, none exceeds 1, they are the probabilities. Otherwise the table lacks tokens for its targets: weights
    are raked anew at ``least_keep`` (without it, at ``keep``) with 1 as their bound, so scarce categories are taken whole
    and fall short. Cells of categories without any token, or with target 0, get 0.
    """
    if tokens.sum() <= 0:
        return np.zeros(tokens.shape), True, True
    least = keep if least_keep is None else least_keep
    free, settled = raked(tokens, targets, 1.0, np.inf)
    total = min(keep, 1.0 / free.max())
    if settled and missed(tokens * free, targets) <= MET and total >= least:
        return free * total, True, True
    p, settled = raked(tokens, targets, least, 1.0)
    return p, False, settled


def calibrate(rows: DataFrame, mix: Mix) -> DataFrame:
    """Cells of the table ``rows`` (one column per margin, and ``tokens``) with ``p``, the keeping probability, and
    whether all margins are met (``met``) and the search for ``p`` has settled (``settled``).

    The number of cells is bounded by the targets, not by the data: values without a target share ``other``, whose
    target is its own share of the tokens. Only these cell sums come to the driver.
    """
    margins = list(mix.targets)
    names = [[*mix.targets[m], OTHER] for m in margins]
    found = rows.groupBy(*margins).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).collect()
    shape = [len(n) for n in names]
    tokens, count = np.zeros(shape), np.zeros(shape, np.int64)
    at = [{c: i for i, c in enumerate(n)} for n in names]
    for r in found:
        cell = tuple(at[i][r[m]] for i, m in enumerate(margins))
        tokens[cell], count[cell] = r["tokens"] or 0, r["rows"]
    targets = []
    for axis, m in enumerate(margins):
        own = tokens.sum(axis=tuple(i for i in range(len(margins)) if i != axis))
        rest = own[-1] / own.sum() if own.sum() else 0.0
        given = np.array(list(mix.targets[m].values()), float)
        targets.append(np.append(given / given.sum() * (1 - rest), rest))
    p, met, settled = rake(tokens, targets, mix.keep, mix.least_keep)
    p = np.where((tokens == 0) & (count > 0), mix.keep, p)  # rows without a token weigh nothing: plain sampling
    cells = [(*(names[i][k] for i, k in enumerate(c)), float(tokens[c]), float(p[c]), met, settled) for c in product(*map(range, shape)) if count[c]]
    schema = ", ".join(f"{m} string" for m in margins) + ", cell_tokens double, p double, met boolean, settled boolean"
    return rows.sparkSession.createDataFrame(cells, schema)


def decide(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows as ``row`` with their margins, ``tokens``, probability ``p``, draw ``u`` and ``kept``."""
    row = F.col("row")
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", *(mix.category(m, row).alias(m) for m in mix.targets), token_count(row[text_col].cast("string")).alias("tokens"),
        uniform(row[id_col], row[text_col]).alias("u"))
    margins = list(mix.targets)
    cells = calibrate(rows.select(*margins, "tokens"), mix)
    joined = rows.join(F.broadcast(cells), margins)  # bounded by the number of targets
    return joined.withColumn("kept", F.col("u") < F.col("p"))


def production_mix() -> Mix:
    return Mix({"source": SOURCES, "lang": LANGUAGES, "topic": TOPICS}, KEEP, columns={"topic": topic(F.col("row")["text"])})


def mix_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, its category per margin, ``tokens``, ``p``, ``u``, ``kept``, ``met`` and ``settled``.

    ``met`` says whether the probabilities meet all margins; where they cannot, ``shares`` tells by how much. A null
    category counts as ``other``; a null or empty text has no token and is kept with probability ``keep``. The draw
    depends on the id alone, so rows that repeat an id share their fate as long as their cells agree; rows without an id
    are drawn by their text. Texts of any length are counted in place; an empty table gives no rows.
    """
    return decide(docs, mix, id_col, text_col).select(F.col("row")[id_col].alias("doc_id"), *mix.targets, "tokens", "p", "u", "kept", "met", "settled")


def shares(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per margin and category, its share of all tokens (``given``), of the tokens expected to be kept (``expected``) and of those
    kept (``drawn``), and the ``target`` where there is one. One row per category: what a mix can and cannot reach."""
    rows = decide(docs, mix, id_col, text_col)
    pairs = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in mix.targets])
    sums = rows.select(F.explode(pairs).alias("c"), "tokens", "p", "kept").groupBy("c.margin", "c.category").agg(
        F.sum("tokens").alias("given"), F.sum(F.col("tokens") * F.col("p")).alias("expected"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("drawn"))
    whole = Window.partitionBy("margin")  # one row per category
    given = [(m, c, float(v / sum(t.values()))) for m, t in mix.targets.items() for c, v in t.items()]
    targets = docs.sparkSession.createDataFrame(given, "margin string, category string, target double")
    part = {c: F.try_divide(F.col(c), F.sum(c).over(whole)).alias(c) for c in ("given", "expected", "drawn")}
    return sums.select("margin", "category", *part.values()).join(F.broadcast(targets), ["margin", "category"], "full")


def sample_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the calibrated draw keeps, columns unchanged."""
    kept = decide(docs, production_mix()).where("kept")
    return kept.select("row.*").select(*columns(docs))


@query("op9_mix_to_targets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), production_mix())
