"""URL filters with redirect equivalence (operator 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.components import connected_components
from treeline.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://[^/?#]*([^?#]*)", 1)


def normal_url(url: Column) -> Column:
    """The form that names the resource: https, host in lower case, no fragment, no ``utm_`` parameters."""
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.concat(F.lit("https://"), url_host(url), url_path(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def declared_links(html: Column) -> Column:
    """Targets that a page declares for itself: ``link rel=canonical`` and ``meta http-equiv=refresh``."""
    text = F.coalesce(html, F.lit(""))
    links = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)(<link\b[^>]*>)"), 1), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b"))
    canonical = F.transform(links, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    metas = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)(<meta\b[^>]*>)"), 1), lambda t: t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"))
    refresh = F.transform(metas, lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*['\"]?([^\"'\s>]+)", 1))
    return F.transform(F.filter(F.concat(canonical, refresh), lambda u: u != ""), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def resolved(base: Column, target: Column) -> Column:
    """``target`` as seen from ``base``: absolute, ``//host``, ``/path`` or relative to the folder of ``base``."""
    root = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, "(?s)^(.*?://[^/?#]*[^?#]*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, "(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), target))
    )


def fitting_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, rule, verdict)`` of the places that a rule fits: the longest one, at equal length ``allow`` first.

    A place asks for each of its host's suffixes by an equi-join, so the work does not grow with the list of rules.
    """
    places = places.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.where("host <> ''").withColumn("_suffix", F.explode(suffixes))
    named = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    met = asked.join(named, F.col("_suffix") == F.col("_host")).where(F.col("path").startswith(F.col("_path")))
    rule = F.concat("_host", "_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("_verdict") == "allow").alias("allow"), rule.alias("rule")))
    return met.groupBy("host", "path").agg(best.alias("_b")).select(
        "host", "path", F.col("_b.rule").alias("rule"), F.when(F.col("_b.allow"), "allow").otherwise("block").alias("verdict")
    )


def filtered(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, alias_of)`` of every row of ``pages(page_id, url, html)``.

    ``rules`` are ``(verdict, host, path)``. A page that a rule fits gets the rule's verdict. Any other takes over the
    decisions on its aliases: URLs connected by redirects (``redirects(from_url, to_url)`` and refresh tags), by declared
    canonical links, and with their own normal form. An alias that a rule allows explicitly precedes; else one that a rule blocks
    blocks the page; else it is allowed. Targets that are no page themselves count as aliases too.

    Null URLs and URLs without ``://`` have empty host and path, no rule and no aliases, and are allowed. Null html
    declares nothing. Repeated rows and page ids stay rows of their own. An empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    listed = spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
    key = lambda c: F.md5(F.regexp_replace(c, "(?s)#.*$", ""))  # noqa: E731  a fragment never leaves the browser
    whole = F.col("url").contains("://")
    links = pages.where(whole).select("url", F.explode(declared_links(F.col("html"))).alias("to")).select("url", resolved(F.col("url"), F.col("to")).alias("to"))
    if redirects is not None:
        links = links.union(redirects.where(F.col("from_url").contains("://") & F.col("to_url").contains("://")).select("from_url", "to_url"))
    ends = links.union(pages.where(whole).select("url", F.col("url")))
    links = links.union(ends.select(F.explode(F.array("url", "to")).alias("url")).select("url", normal_url(F.col("url"))))
    links = cut(links.where("url <> to").distinct())
    classes = connected_components(links.select(key(F.col("url")).alias("a"), key(F.col("to")).alias("b")))
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.when(whole, key(F.col("url"))).alias("_node"))
    aliases = links.select(F.explode(F.array("url", "to")).alias("url")).distinct().select(key(F.col("url")).alias("node"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = cut(fitting_rule(rows.select("host", "path").union(aliases.select("host", "path")), listed))
    classes = cut(classes)
    told = aliases.join(judged, ["host", "path"]).join(classes, "node").groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("_allowed"))
    told = classes.join(told, "component").select(F.col("node").alias("_n"), F.col("component").alias("alias_of"), "_allowed")
    rows = rows.join(judged.withColumnsRenamed({"host": "_h", "path": "_p"}), (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    rows = rows.join(told, F.col("_node") == F.col("_n"), "left")
    verdict = F.coalesce("verdict", F.when(~F.col("_allowed"), "block"), F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_of")
