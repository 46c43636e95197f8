"""URL filter with redirect equivalence.

Rules judge the urls they fit. Urls tied by redirects or canonical links are aliases: connected components over these
edges carry block decisions from a url with a rule to the aliases without one, and an explicit allow takes precedence.
Everything is DataFrame functions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialib.llm.components import components
from medialib.llm.steps import Steps

#: (verdict, host, path start) of the production rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. Null or no ``://``: both empty."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (at equal length the allowing one), else nulls.

    A rule fits its host and all subdomains where the path starts with the rule's. The rules are a parameter list, so
    the expression grows with it and not with the table.
    """
    name = verdict = F.lit(None).cast("string")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, action).otherwise(verdict)
    return name, verdict


def _key(url: Column) -> Column:
    """What a url is known by as an alias: no scheme, no fragment, no tracking parameters."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _target(url: Column, href: Column) -> Column:
    """``href`` made absolute against ``url``; null if there is none."""
    href = F.trim(F.regexp_replace(href, "&amp;", "&"))
    host, path = host_and_path(url)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return (F.when(href == "", None).when(F.contains(href, F.lit("://")), href)
            .when(href.startswith("//"), F.concat(F.lit("http:"), href))
            .when(href.startswith("/"), F.concat(F.lit("http://"), host, href))
            .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", "/").otherwise(folder), href)))


_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(key, target)`` of all redirects (``meta refresh``) and canonical links in ``pages(url, html)``, without loops."""
    html = F.coalesce("html", F.lit(""))
    links = F.concat(*[F.regexp_extract_all(html, F.lit(tag), F.lit(1)) for tag in (_CANONICAL, _REFRESH)])
    tied = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(
        "url", F.explode(F.filter(links, lambda h: h != "")).alias("href"))
    out = tied.select("url", _target(F.col("url"), F.col("href")).alias("to")).where(
        F.contains("url", F.lit("://")) & F.contains("to", F.lit("://")))
    return out.select(_key(F.col("url")).alias("key"), _key(F.col("to")).alias("target")).where("key <> target").distinct()


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
          more_edges: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, alias_blocked, alias_allowed)``, one row per input row.

    ``verdict`` is the fitting rule's; without one it is ``block`` if an alias is blocked by a rule and none is
    explicitly allowed, else ``allow``. ``more_edges(from_url, to_url)``: redirects known from elsewhere. Null url or
    one without ``://``: empty host and path, no alias, judged ``allow`` unless a rule fits the empty host. Null html:
    no edges; html of any length is searched whole. Repeated rows: each is judged alike. Ties of rules of one length go to ``allow``. Further columns are not
    looked at.
    """
    steps = Steps(pages.sparkSession, "aliases")
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    edges = alias_edges(named)
    if more_edges is not None:
        known = more_edges.where(F.contains("from_url", F.lit("://")) & F.contains("to_url", F.lit("://"))).select(
            _key(F.col("from_url")).alias("key"), _key(F.col("to_url")).alias("target")).where("key <> target")
        edges = edges.unionByName(known).distinct()
    edges = steps.settle(edges, "edges")
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = (named.select("page_id", "url", host.alias("host"), path.alias("path"))
              .withColumn("rule", rule).withColumn("own", verdict))
    if edges.isEmpty():
        none = F.lit(False)
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"),
                             none.alias("alias_blocked"), none.alias("alias_allowed"))
    # Every url on an edge, crawled or not, with the rule it meets itself.
    nodes = edges.select("key").unionByName(edges.select(F.col("target").alias("key"))).distinct()
    node_host, node_path = host_and_path(F.concat(F.lit("x://"), F.col("key")))
    _, node_verdict = rule_for(node_host, node_path, rules)
    nodes = nodes.select("key", F.xxhash64("key").alias("node"), node_verdict.alias("own"))
    tied = components(edges.select(F.xxhash64("key").alias("a"), F.xxhash64("target").alias("b")))
    placed = nodes.join(tied, "node")
    group = placed.groupBy("component").agg(F.coalesce(F.bool_or(F.col("own") == "block"), F.lit(False)).alias("blocked"),
                                            F.coalesce(F.bool_or(F.col("own") == "allow"), F.lit(False)).alias("allowed"))
    by_key = steps.settle(placed.join(group, "component").select("key", "blocked", "allowed"), "groups")
    joined = judged.withColumn("key", F.when(F.contains("url", F.lit("://")), _key(F.col("url")))).join(by_key, "key", "left")
    blocked, allowed = F.coalesce("blocked", F.lit(False)), F.coalesce("allowed", F.lit(False))
    return joined.select("page_id", "host", "path", "rule",
                         F.coalesce("own", F.when(blocked & ~allowed, "block").otherwise("allow")).alias("verdict"),
                         blocked.alias("alias_blocked"), allowed.alias("alias_allowed"))
