"""URL filters by rules and by link-graph propagation, in DataFrame functions only.

Rules decide the urls they fit, the longest rule first. Hosts carry two seeds, the shares of their urls that rules
allow and block, times their links. Trust flows from allowed hosts along links (personalised PageRank); distrust flows
from blocked hosts against them, to the hosts that link there. Both are compared with the rank that a host would get
were every host a full seed, so a figure says which part of what its links bring is trust or distrust, however many
other hosts share a neighbour. A host is blocked where its distrust reaches the threshold and exceeds its trust; this
decides the urls without a rule.

Defined cases: a null url, or one without ``://``, has the empty host and path and fits no rule; links to a host
without pages are followed through it; links inside a host, relative links and null html give no edge; hosts without
any evidence are allowed; repeated rows are judged alike and count in the shares; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rule -> verdict; a rule is a host and a path prefix.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
DAMPING = 0.85
ROUNDS = 12
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1)
    return F.coalesce(F.when(at > 0, F.translate(host, UPPER, LOWER)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))

    ordered = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(*(F.when(fits(r), F.lit(r)) for r in ordered), F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: dict[str, str] = RULES) -> Column:
    return reduce(lambda out, item: out.when(rule == item[0], F.lit(item[1])), rules.items(), F.when(F.lit(False), F.lit("")))


def parsed(pages: DataFrame, id_col: str, url_col: str, rules: dict[str, str]) -> DataFrame:
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return rows.withColumn("ruled", verdict_of(F.col("rule"), rules))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts; each task adds up its own before the shuffle."""
    found = F.regexp_extract_all(F.col(html_col).cast("string"), F.lit(LINK), F.lit(1))
    rows = pages.select(host_of(F.col(url_col).cast("string")).alias("src"), F.explode(found).alias("dst"))
    rows = rows.select("src", F.regexp_replace(F.translate("dst", UPPER, LOWER), r"^.*@", "").alias("dst"))
    return rows.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, score, ..): personalised PageRank from ``seeds`` (host, seed, ..) along ``edges`` (src, dst, n), in
    units in which a host that nothing reaches has its own seed. Further columns of ``seeds`` are seeds that spread
    in the same rounds. Both inputs are best checkpointed."""
    kinds = [c for c in seeds.columns if c not in ("host", "seed")]
    seeds = seeds.select("host", *(F.col(c).alias(f"__{c}") for c in ["seed", *kinds]))
    pairs = [("__seed", "score"), *((f"__{c}", c) for c in kinds)]
    totals = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = checkpointed(edges.join(totals, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    ranks = seeds.select("host", *(F.col(a).alias(b) for a, b in pairs))
    if shares.isEmpty():
        return ranks
    for done in range(1, rounds + 1):
        arrived = [F.sum(F.col("share") * F.col(b)).alias(f"__new_{b}") for _, b in pairs]
        moved = shares.join(ranks, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("host")).agg(*arrived)
        ranks = seeds.join(moved, "host", "full").select("host", *((F.coalesce(a, F.lit(0.0)) + damping * F.coalesce(f"__new_{b}", F.lit(0.0))).alias(b) for a, b in pairs))
        if done % 4 == 0 or done == rounds:
            ranks = checkpointed(ranks)
    return ranks


def figures(seeds: DataFrame, edges: DataFrame, seed: str, name: str, rounds: int) -> DataFrame:
    """(host, ``name``): the greater of a host's own share ``seed`` and the part of the mass its links bring that comes
    from such hosts. Every host seeds with one unit a link, so a neighbour's other links take nothing away."""
    links = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").cast("double").alias("links"))
    start = checkpointed(seeds.select("host", F.col(seed).alias("own")).join(links, "host", "full").na.fill(0.0, ["own", "links"]))
    ranks = propagated(start.select("host", (F.col("own") * F.col("links")).alias("seed"), F.col("links").alias("whole")), edges, rounds)
    brought = F.col("whole") - F.coalesce("links", F.lit(0.0))
    part = (F.col("score") - F.coalesce("own", F.lit(0.0)) * F.coalesce("links", F.lit(0.0))) / brought
    return ranks.join(start, "host", "left").select("host", F.greatest(F.coalesce("own", F.lit(0.0)), F.when(brought > 1e-9, part).otherwise(0.0)).alias(name))


def host_scores(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: dict[str, str] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust), both from 0 to 1."""
    rows = parsed(pages.withColumn("__none", F.lit(None)), "__none", url_col, rules)
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    seeds = checkpointed(rows.groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")))
    edges = checkpointed(host_links(pages, url_col, html_col))
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust, distrust = figures(seeds, edges, "allow", "trust", rounds), figures(seeds, turned, "block", "distrust", rounds)
    return trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: dict[str, str] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict): one row per row of ``pages``."""
    scores = host_scores(pages, url_col, html_col, rules)
    # sums of doubles depend on their order; figures that differ in the last places only are equal
    trust, distrust = F.round("trust", 9), F.round("distrust", 9)
    blocked = scores.where((distrust >= threshold) & (distrust > trust)).select("host", F.lit("block").alias("graph"))
    rows = parsed(pages, id_col, url_col, rules).join(blocked, "host", "left")
    verdict = F.coalesce("ruled", "graph", F.lit("allow"))
    return rows.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
