"""URL filters: allow and block rules, and verdicts by link-graph propagation where no rule fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query, table
from .scratch import Scratch

#: Rules of the contract: kind, host, path prefix.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Share of a host's score that goes on along its edges, and the share of all score that may be left unmoved.
DAMPING, UNMOVED = 0.85, 1e-3
#: After so many steps at most ``UNMOVED`` of the score has not come to rest, whatever the graph: each step moves on
#: ``DAMPING`` of what the one before moved.
STEPS = math.ceil(math.log(UNMOVED) / math.log(DAMPING))
#: A host is blocked if its distrust exceeds its trust by more than this share of it. Scores shrink as the graph
#: grows, so the limit has no unit of mass; sums that are equal but for rounding count as equal.
SHARE = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts of absolute links; a link without a host stays on its own.
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its kind; null where none fits."""
    text, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        text, kind = F.when(fits, rule_host + prefix).otherwise(text), F.when(fits, what).otherwise(kind)
    return text, kind


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, w``: links between different hosts, and the tie of a host to the name above it, both ways.

    Links are counted per pair of hosts before anything is joined, so a host with a third of all pages is one row
    per task and neighbour.
    """
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    names = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    chain = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                                               lambda i: F.array_join(F.slice(labels, i, 255), "."))).alias("src")).distinct()
    parts = F.split("src", r"\.")
    up = chain.where(F.size(parts) > 2).select("src", F.array_join(F.slice(parts, 2, 255), ".").alias("dst"))
    tied = up.union(up.select("dst", "src"))
    both = links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).union(tied.select("src", "dst", F.lit(1).cast("long").alias("w")))
    return both.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """``host, trust, distrust``: personalised PageRank from ``seeds(host, kind, mass)``.

    Trust follows links forwards, distrust backwards; both run in one table, as ``kind``. A step is one join and
    one aggregation with map-side sums; its result is written and read again, which cuts lineage. The score that has
    not come to rest after the last step is at most ``damping ** steps`` of the whole. Hosts that no score reaches
    have no row.
    """
    forward = edges.select(F.lit("allow").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w")
    backward = edges.select(F.lit("block").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "w")
    moves = forward.union(backward)
    total = scratch.save(moves.groupBy("kind", "host").agg(F.sum("w").alias("total")), "degrees")
    moves = scratch.save(moves.join(total, ["kind", "host"]).select("kind", "host", "to", (F.col("w") / F.col("total")).alias("p")), "moves")
    whole = seeds.groupBy("kind").agg(F.sum("mass").alias("whole"))
    start = scratch.save(seeds.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("mass") / F.col("whole")).alias("score")), "seeds")
    score = start
    for _ in range(steps):
        moved = moves.join(score, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("p") * F.col("score")).alias("score"))
        back = start.select("kind", "host", ((1 - damping) * F.col("score")).alias("score"))
        after = scratch.save(moved.union(back).groupBy("kind", "host").agg(F.sum("score").alias("score")), "score")
        if score is not start:
            scratch.drop(score)
        score = after
    return score.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "allow", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "block", F.col("score"))), F.lit(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page.

    A rule decides where one fits. Elsewhere the host's scores do: seeds are the hosts of ruled pages, weighted
    by their number of pages; scores travel ``STEPS`` links far; a host is blocked if its distrust exceeds its trust, however small both are (the
    output rounds them to nine digits, so both may show as 0). A host that no score reaches, an empty host and a
    null url are allowed. A null html has no link. Rows that repeat an id are judged one by
    one, and count as pages of their host each; an empty table has no rows. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = url_parts(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    edges = scratch.save(host_edges(rows.where("host <> ''")), "edges")
    rule, kind = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = rows.drop("html").select("page_id", "host", "path", rule.alias("rule"), kind.alias("kind"))
    seeds = ruled.where("kind IS NOT NULL").groupBy("kind", "host").agg(F.count(F.lit(1)).alias("mass"))
    scores = scratch.save(propagate(edges, scratch.save(seeds, "mass"), scratch), "scores")
    judged = ruled.join(scores, "host", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > F.col("trust") * (1 + SHARE), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("kind", own).alias("verdict"),
                         F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def _oracle() -> str:
    up, low = UPPER, LOWER
    case_rule, case_kind = "", ""
    for what, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN"
        case_rule += f" {fits} '{h}{p}'"
        case_kind += f" {fits} '{what}'"
    link = LINK.replace("'", "''")
    steps = ""
    for i in range(STEPS):
        before = f"score{i}" if i else "start"
        steps += f""", score{i + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (
            SELECT m.kind, m.dest AS host, {DAMPING} * m.p * s.score AS score FROM moves m JOIN {before} s ON m.kind = s.kind AND m.host = s.host
            UNION ALL SELECT kind, host, {1 - DAMPING} * score FROM start) GROUP BY kind, host)"""
    return rf"""
WITH parts AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{up}', '{low}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
ruled AS MATERIALIZED (SELECT page_id, host, path, CASE{case_rule} END AS rule, CASE{case_kind} END AS kind FROM parts),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{up}', '{low}') AS dst FROM parts WHERE host <> ''),
names AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM parts WHERE host <> ''),
chain AS (SELECT DISTINCT array_to_string(labels[i:], '.') AS src FROM (SELECT labels, unnest(range(1, greatest(len(labels), 2))) AS i FROM names)),
up AS (SELECT src, array_to_string(string_split(src, '.')[2:], '.') AS dst FROM chain WHERE len(string_split(src, '.')) > 2),
edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, 1 AS w FROM links UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up)
    WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
pairs AS (SELECT 'allow' AS kind, src AS host, dst AS dest, w FROM edges UNION ALL SELECT 'block', dst, src, w FROM edges),
moves AS MATERIALIZED (SELECT kind, host, dest, w / sum(w) OVER (PARTITION BY kind, host) AS p FROM pairs),
start AS MATERIALIZED (SELECT kind, host, count(*) / sum(count(*)) OVER (PARTITION BY kind) AS score FROM ruled WHERE kind IS NOT NULL GROUP BY kind, host){steps},
scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'block'), 0) AS distrust
    FROM score{STEPS} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(kind, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * (1 + {SHARE}::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict,
    round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM ruled r LEFT JOIN scores s ON r.host = s.host"""


@query("op7_url_filters", sql=_oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
