"""URL verdicts by rules and by redirect equivalence, with DataFrame functions only.

Rules (host, path, block or allow) fit a host and its subdomains where the
URL's path starts with the rule's; the longest one decides, and an explicit
allow is never overruled. URLs that no rule fits take a block over from an
alias: redirects (refresh) and canonical links of pages are edges, and so is
what differs only in scheme, default port or fragment; connected components
join them. What no block reaches is allowed.

How it scales: a few rules become one expression and no join; more are joined
by the hosts that there are and the domains above them. Edges
are made from tags cut out of the html in the scan; components come from
star contraction; verdicts are shared by a partial aggregate for each
component, so an alias group of any size is a row a task.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.checkpoints import saved
from vitrine.llm.components import components

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Rules that become one expression; more are joined.
EXPRESSED_RULES = 200

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From there up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits (host and path together, an allow before a block of that length), as a struct, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ordered
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


def with_rules(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (host, path) with ``fit``, what ``rule_of`` says, for any number of rules."""
    if len(rules) <= EXPRESSED_RULES:
        return rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    given = F.from_json(F.lit(json.dumps([{"verdict": v, "above": h, "start": p} for v, h, p in rules])), "array<struct<verdict:string,above:string,start:string>>")
    table = rows.sparkSession.range(1).select(F.inline(given))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(above).alias("above"))
    order = F.struct((-F.length(F.concat("above", "start"))).alias("n"), F.when(F.col("verdict") == "allow", 0).otherwise(1).alias("v"), "verdict", "above", "start")
    fitting = hosts.join(table, "above").groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("rules"))  # of one host no more than there are rules
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    fit = F.when(first.isNotNull(), F.struct(F.concat(first["above"], first["start"]).alias("rule"), first["verdict"].alias("verdict")))
    return rows.join(fitting, "host", "left").withColumn("fit", fit).drop("rules")


def _folded(path: Column) -> Column:
    """A path that begins with a slash, without the segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
        lambda done: F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done),
    )
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def node_of(url: Column) -> Column:
    """What a URL names, without scheme, default port, dot segments and fragment; the URL itself where it has no ``://``."""
    path, query = path_of(url), F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^?#]*([^#]*)", 1)
    whole = F.when(path == "", "/").otherwise(_folded(path))
    return F.when(url.contains("://"), F.concat(F.regexp_replace(host_of(url), r":(80|443)$", ""), whole, query)).otherwise(url)


def resolved(link: Column, url: Column) -> Column:
    """``link`` completed by the page's ``url``; null for other schemes (mailto) and for relative links of a page without ``://``."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    top = F.concat(F.lit("http://"), host_of(url))
    relative = (
        F.when(link == "", F.lit(None))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(top, link))
        .when(link.startswith("#"), url)
        .when(link.startswith("?"), F.concat(top, path, link))
        .otherwise(F.concat(top, F.regexp_extract(path, r"(?s)^(.*/)", 1), link))
    )
    schemed = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), schemed).when(link.startswith("//") | url.contains("://"), relative)


_ATTRIBUTE = r"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attribute(tag: Column, name: str) -> Column:
    pattern = _ATTRIBUTE.replace("{name}", name)
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a`` and ``b``: a page's node and the node that it redirects to or calls canonical. Relative links of any
    form are completed by the page's URL (a ``base`` element is not read); a fragment alone names the page itself, which is no link."""
    url, html = F.col(f"`{url_col}`"), F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\s[^>]*(?:canonical|refresh)[^>]*>"), F.lit(0))
    found = pages.where(url.isNotNull()).select(url.alias("url"), F.explode_outer(tags).alias("tag")).where("tag IS NOT NULL")
    canonical = F.when(F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"\s]+)", 1))
    link = F.trim(F.regexp_replace(F.coalesce(canonical, refresh, F.lit("")), "&amp;", "&"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(link, F.col("url"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judged(
    pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and ``component`` (the smallest alias), a row for each row of ``pages``.

    ``redirects`` (from_url, to_url) adds edges known from elsewhere. A null
    URL, or one without ``://``, has an empty host and path, fits no rule and is
    allowed. Repeated rows give repeated results; null html holds no links;
    other columns are neither read nor returned; an empty table gives no rows.
    """
    url = F.col(f"`{url_col}`")
    links = alias_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionAll(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).dropna())
    named = components(links)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = with_rules(rows, rules)
    rows = saved(rows.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # aliases that are no pages of the table have rules, too
    ends = named.select(F.col("node"), "component").withColumn("url", F.concat(F.lit("http://"), "node"))
    ends = with_rules(ends.select("component", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules).select("component", "fit")
    blocked = reduce(DataFrame.unionAll, [rows.select("component", "fit"), ends]).where("fit.verdict = 'block' AND component IS NOT NULL").select("component").distinct()
    out = rows.join(blocked.withColumn("blocked", F.lit(True)), "component", "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "component")
