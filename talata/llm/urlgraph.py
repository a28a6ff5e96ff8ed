"""URL filters: host and path rules, and for the other pages trust and distrust over host links.

Trust is personalised PageRank from the hosts of allowed pages along links; distrust is the same
from the hosts of blocked pages against the links' direction, so hosts that link to blocked ones
gain distrust. A page without a rule is blocked where its host's trust is below BLOCK_BELOW times
its distrust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, read

#: (rule, verdict). Fixed values of the contract.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DAMPING = 0.85
#: Rounds end when the ranks change by less than this in all; each shrinks the change by DAMPING, so they do end.
TOLERANCE = 1e-5
#: Links of one host that a task joins at once: a host with more is dealt to several.
HUB = 100_000
BLOCK_BELOW = 0.25
#: Host scores up to so many rows are broadcast to the pages; beyond it they are joined by shuffle.
MOST_BROADCAST = 300_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\b(?:href|src|action)\s{0,4}=\s{0,4}["']?\s{0,4}(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. Of equal lengths, the first wins."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in reversed(ordered):
        at, slash, below = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``pages`` (host, html) -> (src, dst, n): absolute links between different hosts, counted."""
    links = pages.where(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("to"))
    dst = F.translate(F.regexp_replace("to", r"^.*@|:\d*$", ""), _UPPER, _LOWER)
    return links.select("src", dst.alias("dst")).where("dst <> '' AND src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE, hub: int = HUB) -> DataFrame:
    """Personalised PageRank: ``edges`` (src, dst, n), ``seeds`` (host, weight >= 0) -> (host, rank).

    Mass at hosts without outgoing links returns to the seeds. Ranks sum to 1, or are all 0 when no
    seed has weight. Without edges the ranks are the seeds' shares. Rounds go on until the ranks
    differ from the last ones by ``tolerance`` in all. Each round is one join, in which hosts of more
    than ``hub`` links are split, and one aggregation; its tables are written, and deleted after use.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    share = F.col("weight") / total if total else F.lit(0.0)
    linked = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    start = seeds.where("weight > 0").select("host", share.alias("seed")).unionByName(linked.select("host", F.lit(0.0).alias("seed")))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / hub).cast("int").alias("parts"))
    start = start.groupBy("host").agg(F.sum("seed").alias("seed")).join(out.select(F.col("src").alias("host"), "parts"), "host", "left")
    start = materialize(start.select("host", "seed", F.coalesce("parts", F.lit(1)).alias("parts")), "seeds")
    ranks = start.select("host", F.col("seed").alias("rank"), "parts")
    if not total or edges.isEmpty():
        return ranks.select("host", "rank")
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    shares = materialize(edges.join(out, "src").select("src", part.alias("part"), "dst", (F.col("n") / F.col("all")).alias("share")), "edge-shares")
    changed, last = tolerance + 1, None
    while changed > tolerance:
        dealt = ranks.select(F.col("host").alias("src"), "rank", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        given = shares.join(dealt, ["src", "part"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        given = materialize(given.withColumnRenamed("dst", "host"), "given")
        kept = 1.0 - (given.agg(F.sum("got")).first()[0] or 0.0)  # one number
        got = F.coalesce("got", F.lit(0.0))
        fresh = start.join(given, "host", "left").select("host", "parts", ((1 - damping + damping * kept) * F.col("seed") + damping * got).alias("rank"))
        fresh = fresh.join(ranks.select("host", F.col("rank").alias("before")), "host")
        fresh = materialize(fresh.select("host", "rank", "parts", F.abs(F.col("rank") - F.col("before")).alias("change")), "ranks")
        changed = fresh.agg(F.sum("change")).first()[0]  # one number
        drop_table(given)
        drop_table(last)
        ranks = last = fresh
    return ranks.select("host", "rank")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, *, block_below: float = BLOCK_BELOW) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): host, path, rule, verdict, trust, distrust.

    Null urls and urls without ``://`` have an empty host and path, fit no rule, and are allowed, as
    no link leads to or from them. Null html has no links; very long html is read whole. Repeated
    rows and null ids stay and each counts as a page of its host; an empty table gives no rows.
    Other columns may have any name.
    """
    rules = RULES if rules is None else rules
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "html", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    edges = materialize(host_edges(judged), "host-edges")
    seeds = materialize(
        judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").cast("double").alias("allowed"), F.count_if(F.col("ruled") == "block").cast("double").alias("blocked")), "host-seeds"
    )
    trust = pagerank(edges, seeds.select("host", F.col("allowed").alias("weight")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = pagerank(back, seeds.select("host", F.col("blocked").alias("weight")))
    both = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
    scores = materialize(both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host-scores")
    if scores.count() <= MOST_BROADCAST:
        scores = F.broadcast(scores)
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(t < block_below * d, "block").otherwise("allow")
    return judged.drop("html").join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), t.alias("trust"), d.alias("distrust"))


def op6_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))
