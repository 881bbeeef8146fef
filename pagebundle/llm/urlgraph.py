"""URL filter: rules first, then trust and distrust spread over the links between hosts.

A url is judged by the longest rule that fits it (rules name a host with its subdomains
and the beginning of a path). Urls that no rule fits are judged by their host:

* hosts most of whose pages are allowed by rules are trusted seeds; personalised
  PageRank spreads trust from them along links (a trusted host's links are endorsements);
* hosts most of whose pages are blocked are blocked seeds; the same walk on reversed
  links spreads distrust (a host that links to blocked ones is suspicious).

Both walks run in one table of weighted host edges (pages that link, counted per pair of
hosts before any shuffle; links inside a host say nothing about other hosts and are left
out). A step is one equality join and one sum per host, written to the shared checkpoint
folder; mass that meets no link returns to the seeds. Steps go on until all that may still
move is ``TOLERANCE`` of the mass that decides (``threshold`` / number of hosts), so no host
is too far from a seed to be judged. A step moves at most ``damping`` times what the one before
moved: their number is bounded beforehand, and a walk that exceeds it ends as an error. A host
is blocked if its distrust exceeds its trust and is at least ``threshold`` times the average
over all hosts.

Defined cases: a null url, or one without "://", has empty host and path; no rule and no
score applies, so it is allowed. Null html has no links. Without trusted or without
blocked seeds that walk is zero everywhere. Repeated rows are judged alike. Other columns
stay, save those named like an added one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagebundle.llm.common import fresh, size_checked_broadcast, small_table, stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*+=\s*+["']?(?:https?:)?//([^/?#"'\s>]++)"""

#: (verdict, rule): host, then the beginning of the path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
MAX_RULES = 1_000
DAMPING, THRESHOLD, SEED_SHARE = 0.85, 0.5, 0.5
#: What may still move at the end of a walk, as a share of the mass that blocks a host.
TOLERANCE = 0.01


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules) -> Column:
    """struct(length, verdict, rule) of the longest rule that fits, null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        fit = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        value = F.struct(F.lit(len(rule)).alias("length"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fits.append(F.when(fit, value))
    none = F.lit(None).cast("struct<length: int, verdict: string, rule: string>")
    return F.array_max(F.array(*fits, none, none)) if fits else none


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of src that link to dst, counted; no links inside a host."""
    links = pages.select(
        F.col("host").alias("src"),
        F.explode(
            F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
        ).alias("dst"),
    )
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def most_steps(damping: float, tolerance: float) -> int:
    """By this step all later ones together move at most ``tolerance`` of a walk's mass."""
    return max(1, math.ceil(math.log(tolerance * (1 - damping)) / math.log(damping)))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, fold: int = 8) -> DataFrame:
    """(kind, host, mass) after the walk; edges (kind, src, dst, share), seeds (kind, host, seed).

    Shares of a (kind, src) and seeds of a kind sum to one; pass edges as a table. A walk whose
    mass returns to the seeds where it meets no link is the sum of what its steps carry from
    the seeds, scaled to one. The steps' tables are added up every ``fold`` steps. The walk
    ends once the later steps together can move at most ``tolerance``.
    """
    carried = stage(seeds.select("kind", "host", F.col("seed").alias("mass")), "url-step-0")
    summed = [carried]

    def added_up() -> DataFrame:
        return reduce(DataFrame.union, summed).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))

    for i in range(1, most_steps(damping, tolerance) + 1):
        on = (carried["kind"] == edges["kind"]) & (carried["host"] == edges["src"])
        carried = stage(
            carried.join(edges, on).groupBy(edges["kind"], F.col("dst").alias("host"))
            .agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass")),
            f"url-step-{i}",
        )
        # One number for each of the two walks.
        moved = max((r["moved"] for r in carried.groupBy("kind").agg(F.sum("mass").alias("moved")).collect()), default=0.0)
        summed.append(carried)
        if moved * damping / (1 - damping) <= tolerance:
            break
        if len(summed) > fold:
            summed = [stage(added_up(), f"url-sum-{i}")]
    else:
        if moved > 1.001 * damping**i:
            raise RuntimeError(f"step {i} still moves {moved}: shares of links do not sum to one")
    ranks = stage(added_up(), "url-ranks")
    totals = ranks.groupBy("kind").agg(F.sum("mass").alias("total"))  # two rows
    return ranks.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("mass"))


def host_scores(
    pages: DataFrame, threshold: float = THRESHOLD, seed_share: float = SEED_SHARE, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """(host, trust, distrust, hosts): pages has host, html and judged (allow, block or null).

    Masses are exact to ``tolerance`` * ``threshold`` / hosts.
    """
    shares = pages.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("judged") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("judged") == "block", 1.0).otherwise(0.0)).alias("distrust"),
    )
    shares = stage(shares, "url-hosts")
    links = stage(host_edges(pages), "url-links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    edges = stage(
        both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")),
        "url-edges",
    )
    seeds = shares.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "share"))
    seeds = seeds.where(F.col("share") >= seed_share)
    counts = {r["kind"]: r["count"] for r in seeds.groupBy("kind").count().collect()}
    size = F.when(F.col("kind") == "trust", F.lit(counts.get("trust", 1))).otherwise(F.lit(counts.get("distrust", 1)))
    seeds = stage(seeds.select("kind", "host", (F.lit(1.0) / size).alias("seed")), "url-seeds")
    total = shares.select("host").union(links.select("dst")).distinct().count()
    ranks = spread(edges, seeds, damping, tolerance * min(threshold / max(total, 1), 1.0))
    value = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(value("trust"), value("distrust")).withColumn("hosts", F.lit(total))


def with_url_verdict(
    pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, max_broadcast_hosts: int = 100_000
) -> DataFrame:
    """``pages`` (url, html) with host, path, rule and verdict."""
    added = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in added]
    found, bad = fresh(pages, "_found"), fresh(pages, "_bad_host")
    judged = (
        pages.select(*[F.col(f"`{c}`") for c in kept])
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .withColumn(found, best_rule(F.col("host"), F.col("path"), rules))
    )
    scores = host_scores(judged.select("host", "html", F.col(f"{found}.verdict").alias("judged")), threshold)
    blocked = stage(
        scores.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.col("hosts") >= threshold)).select(
            F.col("host").alias(bad)
        ),
        "url-blocked",
    )
    by_host = F.when(F.col(bad).isNotNull(), "block").otherwise("allow")
    return (
        judged.join(size_checked_broadcast(blocked, max_broadcast_hosts), F.col("host") == F.col(bad), "left")
        .withColumn("rule", F.col(f"{found}.rule"))
        .withColumn("verdict", F.coalesce(F.col(f"{found}.verdict"), by_host))
        .drop(found, bad)
    )


def url_digest(pages: DataFrame) -> DataFrame:
    judged = with_url_verdict(pages.select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def url_sql(rules=RULES, steps: int = 20) -> str:
    """The same in DuckDB, with ``steps`` steps of the walk written out.

    Where links between hosts lead further, ``damping ** steps`` of the mass still moves then;
    ``most_steps`` tells how many steps equal the operator's.
    """
    values = ", ".join(
        f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', {len(r)})" for v, r in rules
    )
    link = r"""(?i)\bhref\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)"""
    sql = f"""
WITH rules(verdict, rule, rule_host, rule_path, length) AS (VALUES {values}),
parts AS (
  SELECT row_number() OVER () AS row_id, page_id, html,
    translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
  FROM pages
),
fitting AS (
  SELECT row_id, arg_max(r.rule, r.length) AS rule, arg_max(r.verdict, r.length) AS judged
  FROM parts p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY row_id
),
judged AS (SELECT p.*, f.rule, f.judged FROM parts p LEFT JOIN fitting f USING (row_id)),
shares AS (
  SELECT host, avg((judged IS NOT DISTINCT FROM 'allow')::INT) AS trust, avg((judged IS NOT DISTINCT FROM 'block')::INT) AS distrust
  FROM judged WHERE host <> '' GROUP BY host
),
links AS (
  SELECT src, dst, count(*) AS weight FROM (
    SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda h: translate(h, '{_UPPER}', '{_LOWER}')))) AS dst FROM judged
  ) WHERE src <> '' AND src <> dst GROUP BY src, dst
),
directed AS (
  SELECT 'trust' AS kind, src, dst, weight FROM links UNION ALL SELECT 'distrust', dst, src, weight FROM links
),
edges AS MATERIALIZED (
  SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM directed
),
seed_hosts AS (
  SELECT 'trust' AS kind, host FROM shares WHERE trust >= {SEED_SHARE}
  UNION ALL SELECT 'distrust', host FROM shares WHERE distrust >= {SEED_SHARE}
),
seeds AS MATERIALIZED (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM seed_hosts),
r0 AS MATERIALIZED (SELECT kind, host, seed AS mass FROM seeds)"""
    for i in range(1, steps + 1):
        sql += f""",
m{i} AS MATERIALIZED (
  SELECT e.kind, e.dst AS host, {DAMPING} * sum(r.mass * e.share) AS moved
  FROM r{i - 1} r JOIN edges e ON r.kind = e.kind AND r.host = e.src GROUP BY e.kind, e.dst
),
r{i} AS MATERIALIZED (
  SELECT kind, host, sum(mass) AS mass FROM (
    SELECT s.kind, s.host, s.seed * (1 - coalesce(t.moved, 0)) AS mass
    FROM seeds s LEFT JOIN (SELECT kind, sum(moved) AS moved FROM m{i} GROUP BY kind) t USING (kind)
    UNION ALL SELECT kind, host, moved FROM m{i}
  ) GROUP BY kind, host
)"""
    return sql + f""",
scores AS (
  SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust
  FROM r{steps} GROUP BY host
),
blocked AS (
  SELECT host FROM scores
  WHERE distrust > trust AND distrust * (SELECT count(*) FROM (SELECT host FROM shares UNION SELECT dst FROM links)) >= {THRESHOLD}
)
SELECT page_id, host, path, rule, coalesce(judged, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
