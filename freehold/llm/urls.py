"""URL filters by redirect equivalence, in DataFrame operations.

A page's own rule is the longest that fits its host and path. Pages are also
nodes of a graph whose edges are canonical links and refresh redirects; URLs
that differ only in scheme, fragment, tracking parameters or a trailing slash
are one node. A block decision on any node of a connected component blocks
every alias that has no rule of its own; an explicit allow stands wherever it is.

Defined results
- Null url or none with "://": host and path empty, no rule, allowed; it is nobody's alias.
- Two rules of the same length: allow goes first. Repeated rows are judged row by row.
- Null html: no links. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, connected_components

#: Rules that one expression may hold; each is tried on each url.
MAX_RULES = 1000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = "(?is)<link\\b(?=[^>]*\\brel\\s*=\\s*[\"']?canonical\\b)[^>]*?\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
_REFRESH = "(?is)<meta\\b(?=[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b)[^>]*?\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"
_TRACKING = "(?:utm_\\w+|ref|fbclid|gclid)=[^&#]*+"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*+)", 1), F.lit("")), _AZ, _az)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    tried = [
        F.when(
            ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path),
            F.struct(F.lit(len(r.host + r.path)).alias("length"), F.lit(r.verdict == "allow").alias("first"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    best = F.array_max(F.array(*tried))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def node_of(url: Column) -> Column:
    """The name under which aliases of a url meet; null where there is no host."""
    query = F.regexp_extract(url, "^[^?#]*+\\?([^#]*+)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, f"(?:^|&){_TRACKING}", ""), "^&", "")
    bare = F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""))
    return F.when(host_of(url) != "", F.when(kept == "", bare).otherwise(F.concat(bare, F.lit("?"), kept)))


def _target(url: Column, link: Column) -> Column:
    """A link made absolute against its page's url; null where there is none."""
    root = F.regexp_extract(url, "^((?s:.*?)://[^/?#]*+)", 1)
    near = F.regexp_extract(url, "^((?s:.*?)://[^/?#]*+(?:[^?#]*/)?)", 1)
    near = F.when(near == root, F.concat(root, F.lit("/"))).otherwise(near)
    return (
        F.when(link == "", None)
        .when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, "^((?s:.*?):)//", 1), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(near, link))
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """(row, judged): each page's columns (those of keep, else all but its html) as a struct, and host, path, rule, verdict, alias_blocked.

    redirects: more edges, columns from_url and to_url (a crawl's redirect log).
    Components are found over the urls that have edges only; nodes without any
    are aliases of themselves.
    """
    spark = pages.sparkSession
    url = pages[url_col]
    rows = pages.select(F.struct(*[pages[c] for c in (keep or [c for c in pages.columns if c != html_col])]).alias("row"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    scratch = Scratch(spark)

    links = []
    if html_col:
        html = pages[html_col]
        to = F.explode(F.array(*[F.when(html.contains("<") & F.coalesce(x != "", F.lit(False)), x) for x in (F.regexp_extract(html, _LINK, 1), F.regexp_extract(html, _REFRESH, 1))]))
        links.append(pages.select(url.alias("from_url"), to.alias("link")).where("link is not null").select("from_url", _target(F.col("from_url"), F.col("link")).alias("to_url")))
    if redirects is not None:
        links.append(redirects.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")))
    nodes = rows.where("node is not null").select("node", F.col("own.verdict").alias("verdict"))
    if links:
        all_links = links[0] if len(links) == 1 else links[0].unionByName(links[1])
        all_links = scratch.save(all_links.select("to_url", node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a is not null and b is not null"), "links")
        groups = connected_components(all_links, scratch)
        ends = all_links.select(F.col("b").alias("node"), rule_of(host_of(F.col("to_url")), path_of(F.col("to_url")), rules)["verdict"].alias("verdict"))
        nodes = nodes.unionByName(ends)
        blocked = nodes.where("verdict = 'block'").select("node").distinct().join(groups, "node", "left").select(F.coalesce("label", "node").alias("label")).distinct()
        inside = groups.join(blocked, "label", "left_semi").select("node").unionByName(blocked.select(F.col("label").alias("node"))).distinct()
    else:
        inside = nodes.where("verdict = 'block'").select("node").distinct()
    out = rows.join(inside.select(F.col("node").alias("blocked")), F.col("node") == F.col("blocked"), "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked").isNotNull(), "block").otherwise("allow"))
    return out.select("row", F.struct("host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), F.col("blocked").isNotNull().alias("alias_blocked")).alias("judged"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = judge_urls(pages, keep=["page_id"])
    return out.select("row.page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


#: For tables whose html holds no canonical link or refresh (links need a transitive closure, tested against brute force).
OP1_SQL = r"""
WITH u AS (
  SELECT page_id, url, position('://' IN url) AS mark FROM pages),
p AS (
  SELECT page_id, coalesce(CASE WHEN mark > 0 THEN substr(url, mark + 3) END, '') AS rest FROM u),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(?:^|&)(?:utm_\w+|ref|fbclid|gclid)=[^&#]*', '', 'g'), '^&', '') AS kept
  FROM p),
r(rule, rhost, rpath, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
n AS (
  SELECT h.*, CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '') || CASE WHEN kept = '' THEN '' ELSE '?' || kept END END AS node,
    (SELECT {'rule': rule, 'verdict': verdict} FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rule) DESC, verdict LIMIT 1) AS own FROM h),
b AS (SELECT DISTINCT node FROM n WHERE own.verdict = 'block')
SELECT page_id, host, path, own.rule AS rule, coalesce(own.verdict, CASE WHEN b.node IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM n LEFT JOIN b ON n.node = b.node
"""
