"""URL filters with redirect equivalence.

A rule names a host, with its subdomains, and a path prefix, and blocks or allows; of the rules that
fit a url the longest decides.  Urls that a redirect or a canonical link
joins are aliases: connected components over these links carry a block from any member that a
rule blocks to all members that no rule decides.  A rule that allows a url has precedence over
what its aliases carry.  Rules are few (``MOST_RULES``), so they are looked up in a map literal by each
suffix of the host, where the url is read.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and
has no aliases; hosts are compared with A-Z lower-cased; links are read from
``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` in the html (null: none), relative ones against
the page's url; html of any length is searched whole; of rules of one length that fit a url one that allows decides; fragments play no part in what a link joins; repeated rows are each judged; an empty table
gives no rows; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.operators.components import components
from gistmill.lineage import written

MOST_RULES = 10_000


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def deciding_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest of (verdict, host, path prefix) that fits; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list] = {}
    for verdict, at, prefix in rules:
        by_host.setdefault(at, []).append(F.struct(F.lit(len(at + prefix)).alias("size"), F.lit(verdict == "allow").alias("allow"), F.lit(at + prefix).alias("rule"), F.lit(prefix).alias("prefix")))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.create_map(*[x for at, own in by_host.items() for x in (F.lit(at), F.array(*own))])
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.element_at(table, s), F.array().cast("array<struct<size:int,allow:boolean,rule:string,prefix:string>>")))), lambda r: F.startswith(path, r["prefix"]))
    best = F.array_max(fits)  # the longest; of equal ones the one that allows
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), F.when(best["allow"], "allow").otherwise("block").alias("verdict")))


def node(url: Column) -> Column:
    """What links join: the url with its host lower-cased and without its fragment; null without a host."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    at = host(plain)
    rest = F.regexp_extract(plain, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(at != "", F.concat(ascii_lower(F.regexp_extract(plain, r"(?s)^(.*?)://", 1)), F.lit("://"), at, F.when(rest == "", "/").otherwise(rest)))


def resolved(link: Column, page: Column) -> Column:
    """A link as it stands on a page."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme, root = F.regexp_extract(page, r"(?s)^(.*?://)", 1), F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_replace(scheme, "//$", ""), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(link == "", page)
        .otherwise(F.concat(F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder), link))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """a, b: pairs of nodes that a canonical link or a redirect of a page joins."""
    quoted = r"""["']?([^"'\s>]+)"""
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    canonical = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), 1)
    refresh = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), 1)
    found = F.concat(
        F.transform(canonical, lambda x: F.regexp_extract(x, r"(?is)\bhref\s*=\s*" + quoted, 1)),
        F.transform(refresh, lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*" + quoted, 1)),
    )
    each = pages.filter(F.size(found) > 0).select(url.alias("page"), F.explode(found).alias("link")).filter("link != ''")
    return each.select(node(F.col("page")).alias("a"), node(resolved(F.col("link"), F.col("page"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``redirects`` (columns source, target) adds links to those in the html.
    """
    url = F.col(url_col)
    at, to = host(url), path(url)
    rows = pages.select(F.col(id_col).alias("page_id"), at.alias("host"), to.alias("path"), node(url).alias("node"))
    rows = rows.withColumn("own", deciding_rule(F.col("host"), F.col("path"), rules))
    edges = links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
        edges = edges.unionAll(more) if edges is not None else more
    carried = F.lit("allow")
    if edges is not None:
        member = components(written(edges))
        # a link's end may lie outside the pages; rules decide it all the same
        judged = member.withColumn("own", deciding_rule(host(F.col("node")), path(F.col("node")), rules))
        blocked = judged.filter("own.verdict = 'block'").select("component").distinct()
        named = rows.filter("node IS NOT NULL").join(member.join(blocked, "component", "left_semi").select("node", F.lit("block").alias("carried")), "node", "left")
        # pages without a host have no aliases: they stay out of the join, where they would share one key
        rows = named.unionByName(rows.filter("node IS NULL").withColumn("carried", F.lit(None).cast("string")))
        carried = F.coalesce("carried", F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", carried).alias("verdict"))
