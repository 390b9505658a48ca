"""URL filter: host and path rules, and for the rest trust and distrust over the link graph.

A rule is (verdict, "host/path"): it fits its host and all subdomains if the url's path starts with
the rule's, and the longest rule that fits decides (ties: the greater text, then the later one).  Rules are a
parameter; up to MOST_RULES are tried one by one in an expression, more are a table that hosts are joined with.

Hosts of which more than half of all pages are allowed by rules are trusted seeds, those of which
more than half are blocked are blocked seeds, each weighted by its pages.  Personalised PageRank
spreads trust from the trusted seeds along links between hosts, and distrust from the blocked
seeds against them (who links to a blocked host is suspect).  A host that no rule judges is blocked
if it has distrust and that is over ``threshold`` of trust plus distrust; else allowed.  Both add up to 1
over all hosts, so no fixed floor is set on them.

Rounds go on until no host's rank changes by more than a millionth of itself, or until what still moves is under
``tolerance`` of all rank; what is left then has come over more links than tolerance allows
(log(tolerance) / log(damping), 85 at the defaults), whatever the seeds' masses are.  If neither is reached in
``rounds`` rounds, an error is raised.

Edges are absolute links between different hosts, one row a pair of hosts with its number of links,
summed before the shuffle; ranks are joined to them round by round, and every ``stride`` rounds written to
the shared folder.
What a host without outgoing links holds goes back to the seeds.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``,
``#`` or the end; both are empty without ``://`` and for a null url, which no rule fits and no edge
leaves.  A page with null html has no links.  Repeated rows are judged alike; an empty table gives
none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^/?#"'\s>]+)"""


def host_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule's text and verdict, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def ruled_by_table(slim: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """slim (host and path among its columns) with rule and by_rule.  Each distinct host meets the rules of its
    suffixes; a page then looks through its host's, longest first."""
    split = [(v, r, *r.partition("/"), len(r), i) for i, (v, r) in enumerate(rules)]
    table = slim.sparkSession.createDataFrame([(v, r, h, slash + p, n, i) for v, r, h, slash, p, n, i in split], "verdict string, rule string, suffix string, prefix string, size int, number int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = slim.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(table, "suffix")
    best = F.sort_array(F.collect_list(F.struct("size", "rule", "number", "prefix", "verdict")), asc=False)
    found = written(hosts.groupBy("host").agg(best.alias("fits")))
    chosen = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["prefix"])), F.lit(0))
    return slim.join(found, "host", "left").select(*slim.columns, chosen["rule"].alias("rule"), chosen["verdict"].alias("by_rule"))


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n) over different hosts."""
    link = F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1)).alias("link")
    found = pages.select(host_path(F.col(url))[0].alias("src"), link).select("src", host_path(F.concat(F.lit("x:"), F.regexp_replace("link", "^[^/]*", "")))[0].alias("dst"))
    return found.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 200, tolerance: float = 1e-6, settled: float = 1e-6, stride: int = 4) -> DataFrame:
    """edges: (kind, src, dst, n); seeds: (kind, host, mass).  Personalised PageRank of each kind
    apart: (kind, host, rank), each kind adding up to 1 where it has seeds."""
    total = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = written(seeds.join(F.broadcast(total), "kind").where("all > 0").select("kind", "host", (F.col("mass") / F.col("all")).alias("rank")))
    out_n = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    weighted = written(edges.join(out_n, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share")))
    ranks, spent = start, Scratch(edges.sparkSession)
    for _ in range(0, rounds, stride):
        now_on = Scratch(edges.sparkSession)
        # what returns to the seeds scales all of a kind's ranks alike, and is made up for at the end
        new = ranks
        for _ in range(stride):
            moved = weighted.join(new, (weighted["kind"] == new["kind"]) & (weighted["src"] == new["host"])).select(weighted["kind"], F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
            new = start.union(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        new = now_on.written(new)
        moved_by = F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0)))
        compared = new.join(ranks.withColumnRenamed("rank", "was"), ["kind", "host"], "left")
        change = compared.groupBy("kind").agg(F.max(moved_by / F.col("rank")).alias("own"), (F.sum(moved_by) / F.sum("rank")).alias("all")).collect()  # two rows
        spent.clear()  # the ranks before, which have been compared
        ranks, spent = new, now_on
        if all(c["own"] <= settled or c["all"] <= tolerance for c in change):
            whole = ranks.groupBy("kind").agg(F.sum("rank").alias("whole"))
            return ranks.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("rank") / F.col("whole")).alias("rank"))
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def judge(pages: DataFrame, rules: list[tuple[str, str]], id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, most_rules: int = MOST_RULES, **ranking) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    host, path = host_path(F.col(url))
    slim = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    if len(rules) <= most_rules:
        rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
        ruled = slim.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    else:
        ruled = ruled_by_table(slim, rules)
    count = lambda v: F.count(F.when(F.col("by_rule") == v, 1))
    hosts = ruled.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), count("allow").alias("allowed"), count("block").alias("blocked"))
    hosts = written(hosts)
    seeds = reduce(
        DataFrame.union,
        [hosts.where(F.col(c) * 2 > F.col("pages")).select(F.lit(kind).alias("kind"), "host", F.col(c).cast("double").alias("mass")) for kind, c in (("trust", "allowed"), ("distrust", "blocked"))],
    )
    links = written(host_edges(pages, url, html))
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    ranks = propagate(edges, seeds, **ranking)
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    scores = written(ranks.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")))
    out = ruled.join(scores, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    suspect = (F.col("distrust") > 0) & (F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))
    verdict = F.coalesce("by_rule", F.when(suspect, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


#: The rules that the query judges by.
PAGE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
