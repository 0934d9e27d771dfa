"""URL filter with redirect equivalence.

Every url is judged by the longest rule that fits its host (or a parent domain) and path.  Urls that
redirect to each other, or name each other as canonical, are one thing under several names: the edges
between their normal forms are closed into connected components, and a decision on one alias holds for
all of them.  A url with a rule of its own keeps that rule's verdict; otherwise an explicit allow
anywhere in its component comes before any block, and a component without decisions is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweft.llm.components import connected_components
from riskweft.llm.store import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?"
#: Query parameters that name the visit, not the page: fixed values.
_VISIT = "^(utm_[a-z]+|gclid|fbclid|msclkid|ref|source)="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def normal_form(url: Column) -> Column:
    """Host, path without a closing slash and sorted query without visit parameters; null without ``://``."""
    query = F.split(F.substring(F.regexp_extract(url, _URL, 3), 2, 1 << 30), "&")
    kept = F.array_sort(F.filter(query, lambda p: (F.length(p) > 0) & ~p.rlike(_VISIT)))
    whole = F.concat(
        F.regexp_replace(host_of(url), ":(80|443)$", ""),
        F.regexp_replace(path_of(url), "/+$", ""),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )
    return F.when(url.contains("://"), whole)


def _resolved(base: Column, target: Column) -> Column:
    """A link target against the page it stands on."""
    scheme = F.regexp_extract(base, "(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _URL, 1))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) of canonical links and immediate refreshes that the pages declare."""
    tags = F.regexp_extract_all(F.col(html), F.lit("(?is)<(?:link|meta)\\b[^>]*>"), F.lit(0))
    marked = F.filter(
        tags,
        lambda t: t.rlike("(?i)\\brel\\s*=\\s*[\"']?canonical\\b")
        | t.rlike("(?i)http-equiv\\s*=\\s*[\"']?refresh\\b"),
    )
    links = pages.filter(F.col(url).contains("://")).select(F.col(url).alias("source"), F.explode(marked).alias("tag"))
    target = F.trim(F.regexp_extract("tag", "(?is)(?:href|url)\\s*=\\s*[\"']?\\s*([^\"'>\\s]+)", 1))
    links = links.withColumn("target", F.replace(target, F.lit("&amp;"), F.lit("&"))).filter("target <> ''")
    return links.select("source", _resolved(F.col("source"), F.col("target")).alias("target"))


def _rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): the rules of a host and its parent domains, longest first, ties by text."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    rule = F.struct(
        (-F.length(F.concat("rule_host", "rule_path"))).alias("order"),
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_path",
        "action",
    )
    known = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "action").distinct()
    found = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(known, "rule_host")
    return found.groupBy("host").agg(F.sort_array(F.collect_set(rule)).alias("fits"))


def _decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with host and path, plus ``rule`` and ``own`` (its action), null where none fits."""
    fits = _rules_by_host(urls.select("host").distinct(), rules)
    best = F.filter("fits", lambda r: F.col("path").startswith(r["rule_path"]))
    return (
        urls.join(fits, "host", "left")
        .withColumn("best", F.get(best, F.lit(0)))
        .withColumn("rule", F.col("best.rule"))
        .withColumn("own", F.col("best.action"))
        .drop("fits", "best")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of ``pages``.

    ``rules``: host, path, action ('allow' or 'block').  A rule fits its host and all subdomains where
    the path starts with the rule's; the longest (host and path together) wins, equal lengths by text.
    ``redirects``: further (source, target) edges.  ``component`` is the smallest normal form among the
    url's aliases, null for a url without ``://``, which has no aliases, an empty host and path, and is
    allowed.  Repeated rows are judged each; an empty table gives an empty table.
    """
    own = pages.select(F.col(id).alias("page_id"), F.col(url).cast("string").alias("url"))
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = _decided(own, rules).withColumn("node", normal_form(F.col("url")))
    judged = stored(judged.select("page_id", "host", "path", "rule", "own", "node"), "urls")

    edges = alias_edges(pages, url, html) if html else None
    if redirects is not None:
        more = redirects.select(F.col("source").cast("string"), F.col("target").cast("string"))
        edges = more if edges is None else edges.unionByName(more)
    opinions = judged.filter("own IS NOT NULL AND node IS NOT NULL").select("node", "own")
    names = judged.filter("node IS NOT NULL").select("node").distinct()
    if edges is not None:
        edges = stored(edges, "aliases")
        both = edges.select(F.explode(F.array("source", "target")).alias("url"))
        both = both.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                           normal_form(F.col("url")).alias("node")).filter("node IS NOT NULL").distinct()
        opinions = opinions.unionByName(_decided(both, rules).filter("own IS NOT NULL").select("node", "own"))
        links = edges.select(normal_form(F.col("source")).alias("u"), normal_form(F.col("target")).alias("v"))
        groups = connected_components(links)
        names = names.unionByName(both.select("node")).distinct().join(groups, "node", "left")
    else:
        names = names.withColumn("component", F.lit(None).cast("string"))
    names = names.withColumn("component", F.coalesce("component", "node"))
    opinions = opinions.groupBy("node").agg(
        F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")
    )
    word = (
        names.join(opinions, "node", "left")
        .groupBy("component")
        .agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    )
    heard = names.join(word, "component").select("node", "component", "allowed", "blocked")
    verdict = (
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.coalesce("allowed", F.lit(False)), "allow")
        .when(F.coalesce("blocked", F.lit(False)), "block")
        .otherwise("allow")
    )
    return judged.join(heard, "node", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "component"
    )
