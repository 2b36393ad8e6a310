"""URL filters by link-graph propagation, in DataFrame operations only.

Every page's url gives a host and a path; explicit rules decide the urls they fit, the longest rule winning. For the rest,
hosts are scored on the graph of host-to-host links found in the pages: trust is a personalised PageRank that starts at
hosts by their share of allowed pages and follows links; distrust starts by the share of blocked pages and follows links
backwards, so it reaches hosts that link to bad ones. A host is blocked if its distrust exceeds THRESHOLD and its trust.

A host passes its distrust on in one of two ways. By 'in' (the query's, whose SQL fixes it) it deals it out among the hosts that link
to it, so the more of them there are, the less each gets. By 'out' each gets it by the share of its own links that go there:
verdicts then depend neither on how many others link to the same host nor on the size of the graph.

Links are summed to (from, to, weight) before any propagation, so a host with a third of all pages is a few rows, and
each step's sums combine before they move. A hub's edges are salted over SALTS joins keys. Every step ends in a table.

Defined results: host and path are empty for a null url or one without '://'; urls without rule and without host, or whose
host no propagation reaches, are allowed; links without a host, and links of a host to itself, carry nothing; a null html
has no links; repeated pages count as often as they occur. Without seeds or links all scores are 0. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as c

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, STEPS, THRESHOLD = 0.85, 10, 0.05
SALTS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = "(?i)href\\s*=\\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\\s>/?#]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?, # or the end."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule, its verdict), null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages(page_id, url) with host, path, rule and ruled: the rule's verdict or null."""
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", text).withColumn("ruled", verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how often pages of src link to dst, another host."""
    src, _ = host_path(F.col("url"))
    found = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1))
    links = pages.select(src.alias("src"), F.explode(found).alias("link"))
    dst, _ = host_path(F.col("link"))
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """(kind, host, score) after `steps` rounds over edges(kind, a, b, w) from seeds(kind, host, s)."""
    salted = c.stash(edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")))
    rank = seeds.select("kind", "host", F.col("s").alias("score"))
    for _ in range(steps):
        spread = rank.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        moved = salted.join(spread.withColumnRenamed("host", "a"), ["kind", "a", "salt"]).select("kind", F.col("b").alias("host"), (F.col("score") * F.col("w") * damping).alias("x"))
        start = seeds.select("kind", "host", (F.col("s") * (1 - damping)).alias("x"))
        rank = c.stash(moved.unionByName(start).groupBy("kind", "host").agg(F.sum("x").alias("score")))
    return rank


def host_scores(pages: DataFrame, rows: DataFrame, by: str = "in") -> DataFrame:
    """(host, trust, distrust) of the hosts that propagation reaches; rows is judged(pages)."""
    if by not in ("in", "out"):
        raise ValueError(f"distrust is passed on by 'in' or 'out', not {by!r}")
    links = c.stash(host_links(pages))
    out_n = links.groupBy(F.col("src").alias("a")).agg(F.sum("n").alias("all"))
    in_n = links.groupBy(F.col("dst").alias("a")).agg(F.sum("n").alias("all"))
    trust = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "n").join(out_n, "a").withColumn("kind", F.lit("trust"))
    back = links.select(F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    distrust = back.join(in_n, "a") if by == "in" else back.join(out_n.withColumnRenamed("a", "b"), "b").select("a", "b", "n", "all")
    distrust = distrust.withColumn("kind", F.lit("distrust"))
    edges = trust.unionByName(distrust).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w"))
    # a seed starts with the share of its host's pages that the rules allow, or block
    share = lambda kind: (F.count_if(F.coalesce(F.col("ruled") == kind, F.lit(False))) / F.count("*"))
    per = rows.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = c.stash(per.unpivot(["host"], ["trust", "distrust"], "kind", "s").where("s > 0"))
    rank = propagate(edges, seeds)
    return rank.groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "trust", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.max(F.when(F.col("kind") == "distrust", F.col("score"))), F.lit(0.0)).alias("distrust"),
    )


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, by: str = "in") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of pages(page_id, url, html)."""
    rows = judged(pages, rules)
    scores = host_scores(pages, rows, by).select(F.col("host").alias("h"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
    out = rows.join(scores, F.col("host") == F.col("h"), "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(c.read(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(k, h, p)}'" for k, h, p in sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r), reverse=True)) + " END"
    parts = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://(.*)$', 1)"
    host = lambda u: f"translate(regexp_extract({parts(u)}, '(?s)^[^/?#]*', 0), '{_UPPER}', '{_LOWER}')"
    link = _LINK.replace("'", "''")
    steps = [f"r0 AS (SELECT kind, host, s AS score FROM s)"]
    for k in range(1, STEPS + 1):
        steps.append(f"r{k} AS (SELECT kind, host, sum(x) AS score FROM (SELECT e.kind, e.b AS host, r.score * e.w * {DAMPING} AS x FROM e JOIN r{k - 1} r ON r.kind = e.kind AND r.host = e.a UNION ALL SELECT kind, host, s * (1 - {DAMPING}::DOUBLE) FROM s) GROUP BY 1, 2)")
    return f"""
WITH u AS (SELECT page_id, html, {host("url")} AS host, regexp_extract({parts("url")}, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, {cases(lambda k, h, p: h + p)} AS rule, {cases(lambda k, h, p: k)} AS ruled FROM u),
l0 AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM u),
l1 AS (SELECT src, {host("link")} AS dst FROM l0),
l AS (SELECT src, dst, count(*)::DOUBLE AS n FROM l1 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
e AS (SELECT 'trust' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM l UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM l),
f AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') / count(*)::DOUBLE AS trust, count(*) FILTER (WHERE ruled = 'block') / count(*)::DOUBLE AS distrust FROM j WHERE host <> '' GROUP BY 1),
s AS (SELECT 'trust' AS kind, host, trust AS s FROM f WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust FROM f WHERE distrust > 0), {", ".join(steps)},
h AS (SELECT host, round(coalesce(max(CASE WHEN kind = 'trust' THEN score END), 0), 9) AS trust, round(coalesce(max(CASE WHEN kind = 'distrust' THEN score END), 0), 9) AS distrust FROM r{STEPS} GROUP BY 1)
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > {THRESHOLD} AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0.0)::DOUBLE AS trust, coalesce(distrust, 0.0)::DOUBLE AS distrust FROM j LEFT JOIN h ON h.host = j.host
"""


SQL = _sql()
