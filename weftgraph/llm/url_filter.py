"""URL filter: block and allow rules, spread over aliases by connected components of redirect and canonical links.

A rule is (host, path, verdict). It fits its host and all subdomains where the url's path starts with the rule's path;
the longest rule string wins. A url that no rule fits takes the decision of its aliases: it is blocked when a url of its
component is blocked by a rule. Explicit allow takes precedence: a url that an allow rule fits stays allowed whatever
its aliases are, and it never unblocks others. Everything else is allowed.

Links come from ``<link rel=canonical href>`` and ``<meta http-equiv=refresh content="..url=..">`` of the html and, if
given, a table of observed redirects. Only urls that occur in a link enter the component job.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits no rule and has no aliases; a null html
has no links; repeated pages are judged alike; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise
from .components import connected_components

#: The rules of the production query: fixed values (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Up to so many rules are compiled into one expression; beyond it they are joined on host suffixes.
INLINE_RULES = 200


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """Scheme and host in lower case, without the fragment; null where there is no ``://``."""
    m = r"(?s)^(.*?://[^/?#]*)([^#]*)"
    return F.when(F.instr(url, "://") > 0, F.concat(ascii_lower(F.regexp_extract(url, m, 1)), F.regexp_extract(url, m, 2)))


def _match_inline(df: DataFrame, host: str, path: str, rules) -> DataFrame:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return df.withColumns({"__rule": rule, "__verdict": verdict})


def _match_join(df: DataFrame, host: str, path: str, rules) -> DataFrame:
    """Many rules: distinct (host, path) pairs exploded to host suffixes, joined on equality, longest kept."""
    spark = df.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "__rh string, __rp string, __rs string, __rv string")
    pairs = df.select(F.col(host).alias("__h"), F.col(path).alias("__p")).distinct()
    labels = F.split("__h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = pairs.withColumn("__rh", F.explode(suffixes)).join(table, "__rh").where(F.startswith("__p", F.col("__rp")))
    best = best.groupBy("__h", "__p").agg(F.max(F.struct(F.length("__rs").alias("n"), F.col("__rs").alias("s"), F.col("__rv").alias("v"))).alias("__m"))
    return df.join(best, (df[host] == best["__h"]) & (df[path] == best["__p"]), "left").select(df["*"], F.col("__m.s").alias("__rule"), F.col("__m.v").alias("__verdict"))


def match_rules(df: DataFrame, host: str, path: str, rules) -> DataFrame:
    """Adds ``__rule`` and ``__verdict``, null where no rule fits."""
    return (_match_inline if len(rules) <= INLINE_RULES else _match_join)(df, host, path, rules)


def _absolute(base: Column, ref: Column) -> Column:
    """The link's target: absolute, scheme-relative, host-relative, or relative to the page's folder."""
    ref = F.trim(F.regexp_replace(ref, "&amp;", "&"))
    root, folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    return (
        F.when(ref == "", F.lit(None).cast("string")).when(F.instr(ref, "://") > 0, ref).when(F.startswith(ref, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?):", 1), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(root, ref)).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")) & (folder != F.concat(F.regexp_extract(base, r"(?s)^(.*?://)", 1))), folder).otherwise(F.concat(root, F.lit("/"))), ref))
    )


def html_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` url keys: all canonical links and meta refreshes of the pages."""
    found = pages.where(F.col(url).isNotNull() & F.rlike(F.col(html), F.lit(r"(?i)canonical|http-equiv")))
    tags = lambda pattern, ref: F.transform(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(0)), lambda t: F.regexp_extract(t, ref, 1))
    href = tags(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    to = tags(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    both = found.select(F.col(url).alias("__u"), F.explode(F.concat(href, to)).alias("__r"))
    return both.select(url_key(F.col("__u")).alias("src"), url_key(_absolute(F.col("__u"), F.col("__r"))).alias("dst")).where("src is not null and dst is not null and src <> dst")


def url_filter(pages: DataFrame, rules=None, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: ``__id, host, path, rule, verdict, component``; component is null for a url without aliases.

    ``redirects``: an optional table ``(src, dst)`` of urls.
    """
    rules = RULES if rules is None else rules
    links = html_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select(url_key(F.col("src")).alias("src"), url_key(F.col("dst")).alias("dst")))
    links = materialise(links, "url-links")
    u = F.col(url)
    rows = match_rules(pages.select(F.col(id_col).alias("__id"), url_key(u).alias("__key"), host_of(u).alias("host"), path_of(u).alias("path")), "host", "path", rules)
    if links.isEmpty():
        rows = rows.withColumns({"component": F.lit(None).cast("string"), "__blocked": F.lit(False)})
    else:
        parts = materialise(connected_components(links), "url-parts")
        judged = match_rules(parts.select("node", "component", host_of(F.col("node")).alias("__h"), path_of(F.col("node")).alias("__p")), "__h", "__p", rules)
        spread = judged.groupBy("component").agg(F.max(F.coalesce(F.col("__verdict") == "block", F.lit(False))).alias("__blocked"))
        nodes = parts.join(spread, "component")
        rows = rows.join(nodes, rows["__key"] == nodes["node"], "left")
    method = F.when(F.coalesce("__blocked", F.lit(False)), "block").otherwise("allow")
    return rows.select("__id", "host", "path", F.col("__rule").alias("rule"), F.coalesce("__verdict", method).alias("verdict"), "component")
