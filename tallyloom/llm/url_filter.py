"""URL filters: host and path rules, and trust that spreads over the host graph.

Only DataFrame operations. Pages with a rule are judged by it. For the others the host counts:
personalised PageRank spreads trust along links from hosts with allowed pages, and distrust
against the links from hosts with blocked pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom import session

# (verdict, host, path): fixed values of the contract.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
DAMPING = 0.85
# PageRank stops when no host's share of trust or of distrust changed by more in a round. All shares of a
# kind add up to at most 1, and changes shrink by DAMPING a round: at most 128 rounds.
TOLERANCE = 1e-9
# A host is blocked if its distrust exceeds this many times its trust.
DISTRUST_RATIO = 1.0

# Parts that the pages of one host are dealt into for the joins with tables of hosts.
PARTS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Links of a page to a host: an href or src with an absolute or scheme-relative address.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, rule_host, rule_path), made on the JVM side."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"),
                              F.lit(p).alias("rule_path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case, and the path; empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_host_columns(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``pages`` with the columns of ``hosts``, null where a host is not in it.

    The pages of a host go to PARTS places by their ``part``, and each row of ``hosts`` to all of
    these, so a host with a third of the pages is not one task's work. Joins that follow each other
    use the same places.
    """
    parts = hosts.withColumnRenamed("host", "_host").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return pages.join(parts, (F.col("host") == F.col("_host")) & (F.col("part") == F.col("_part")), "left") \
        .drop("_host", "_part")


def by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, part, …) rows with rule and rule_verdict of the longest rule that fits.

    Rules are looked up once per distinct host, for the host and all its parent domains. Of rules
    of equal length the blocking one wins, then the first in text order.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rule = F.concat("rule_host", "rule_path")
    fitting = (
        pages.select("host").distinct().select("host", F.explode(parents).alias("rule_host"))
        .join(rules, "rule_host")
        .groupBy("host").agg(F.sort_array(F.collect_set(F.struct(
            (-F.length(rule)).alias("shorter"), (F.col("verdict") != "block").alias("softer"),
            rule.alias("rule"), "rule_path", "verdict"))).alias("_rules")))
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return (with_host_columns(pages, fitting)
            .withColumn("_first", first)
            .withColumn("rule", F.col("_first.rule"))
            .withColumn("rule_verdict", F.col("_first.verdict"))
            .drop("_rules", "_first"))


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts of (host, html) rows."""
    found = F.regexp_extract_all(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.lit(LINK), F.lit(1))
    return (pages.filter("host != ''")
            .select(F.col("host").alias("src"), F.explode(found).alias("dst"))
            .withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("src != dst")
            .groupBy("src", "dst").agg(F.count("*").alias("links")))


def spread(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank from (host, allowed, blocked) page counts.

    Trust moves along the links, distrust against them; a host hands on what it has in proportion
    to its links, and one without links hands on nothing. Rounds go on until no score changes by more
    than ``tolerance``. Each is one join and one aggregation over the edges, and is written so that lineage
    stays short. Hosts are one row each; a null count is none, a seed need not have links, and without
    seeds all scores are 0. Without edges a host has its own share, without hosts there are no rows.
    """
    total = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct() \
        .join(seeds, "host", "full").select(
            "host",
            (F.coalesce("allowed", F.lit(0)) / F.lit(float(total[0] or 1) or 1.0)).alias("trusted"),
            (F.coalesce("blocked", F.lit(0)) / F.lit(float(total[1] or 1) or 1.0)).alias("blamed"))
    hosts = session.settle(hosts, "hosts")
    out = edges.groupBy("src").agg(F.sum("links").alias("n"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("n"))
    forth = edges.join(out, "src").select(
        F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("links") / F.col("n")).alias("t"),
        F.lit(0.0).alias("d"))
    back = edges.join(into, "dst").select(
        F.col("dst").alias("from"), F.col("src").alias("to"), F.lit(0.0).alias("t"),
        (F.col("links") / F.col("n")).alias("d"))
    arcs = session.settle(forth.union(back), "arcs")
    scores = hosts.select("host", F.col("trusted").alias("trust"), F.col("blamed").alias("distrust"))
    change = None
    while change is None or change > tolerance:
        sent = (arcs.join(scores, F.col("from") == F.col("host"))
                .groupBy(F.col("to").alias("host"))
                .agg(F.sum(F.col("t") * F.col("trust")).alias("t"),
                     F.sum(F.col("d") * F.col("distrust")).alias("d")))
        trust = F.lit(1 - damping) * F.col("trusted") + F.lit(damping) * F.coalesce("t", F.lit(0.0))
        distrust = F.lit(1 - damping) * F.col("blamed") + F.lit(damping) * F.coalesce("d", F.lit(0.0))
        moved = F.greatest(F.abs(trust - F.col("trust")), F.abs(distrust - F.col("distrust")))
        following = session.settle(
            hosts.join(scores, "host").join(sent, "host", "left").select(
                "host", trust.alias("_trust"), distrust.alias("_distrust"), moved.alias("moved")), "scores")
        change = following.agg(F.max("moved")).first()[0] or 0.0
        scores = following.select("host", F.col("_trust").alias("trust"), F.col("_distrust").alias("distrust"))
    return scores


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", tolerance: float = TOLERANCE,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page.

    The verdict is the rule's; without a fitting rule a page is blocked if its host's distrust
    exceeds DISTRUST_RATIO times its trust, else allowed. Null urls and urls without ``://`` have
    empty host and path, fit no rule and are allowed. Null html has no links. Repeated rows are
    kept, one row out per row in; an empty table gives none. Further columns are not read; an id column may
    have any name but those of the output columns (ValueError).
    """
    if id_col in ("host", "path", "rule", "verdict", "trust", "distrust"):
        raise ValueError(f"the id column may not be called {id_col}")
    host, path = host_and_path(F.col(f"`{url_col}`"))
    split = pages.select(F.col(f"`{id_col}`").alias("_id"), host.alias("host"), path.alias("path"))
    judged = by_rules(split.withColumn("part", F.pmod(F.xxhash64("_id", "path"), F.lit(PARTS)).cast("int")), rules)
    seeds = (judged.filter("host != ''").groupBy("host").agg(
        F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("blocked")))
    edges = session.settle(host_edges(
        pages.select(host.alias("host"), F.col(f"`{html_col}`").alias("html"))), "edges")
    scores = spread(session.settle(seeds, "seeds"), edges, tolerance=tolerance)
    by_host = F.when(F.col("distrust") > DISTRUST_RATIO * F.col("trust"), "block").otherwise("allow")
    return with_host_columns(judged, scores).select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
