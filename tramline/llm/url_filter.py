"""URL rules, and block decisions that reach all aliases of a page.

Redirects and canonical links say that two URLs are the same page.  The
connected components over these links, found by a distributed algorithm, are
the classes of aliases.  A page without a rule of its own is judged as its
aliases are: allowed if a rule allows one of them, else blocked if a rule blocks
one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.graph import connected_components
from tramline.llm.textsql import UPPER, packed

_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """Holds for a host and all of its subdomains, for paths that begin with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.when(url.contains("://"), F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())).otherwise(F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _addressed(df: DataFrame, url: str, name: str) -> DataFrame:
    """df with the address of a URL column: host, path and query, without scheme and fragment; null without a host."""
    parts = df.withColumns({"u_h": host(F.col(url)), "u_p": path(F.col(url)), "u_q": F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)})
    return parts.withColumn(name, F.when(F.col("u_h") != "", F.concat("u_h", "u_p", "u_q"))).drop("u_h", "u_p", "u_q")


def _resolved(whole: Column) -> Column:
    """A path without its segments . and .., each .. taking the segment before with it; query and fragment stay as they are."""
    parts = F.split(F.regexp_extract(whole, r"(?s)^([^?#]*)", 1), "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts) - 1), F.lit(""),  # nothing stands before the first /
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.regexp_replace(acc, r"(?s)/[^/]*\z", "")).otherwise(F.concat(acc, F.lit("/"), x)),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(kept, folder, F.regexp_extract(whole, r"(?s)^[^?#]*(.*)", 1))


def _absolute(link: Column) -> Column:
    """A link on a page with the columns u_scheme, host and path, as a full URL.

    Null for an empty one, for one to a place on the page itself, and for
    schemes that name no host, as mailto: does.  What stands behind the first /,
    ? or # is no scheme.
    """
    site = F.concat("u_scheme", "host")
    folder = F.regexp_replace("path", r"(?s)[^/]*\z", "")
    plain = F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path"))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when((link == "") | link.startswith("#") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.regexp_replace("u_scheme", "//$", ""), link))
        .when(link.startswith("/"), F.concat(site, _resolved(link)))
        .when(link.startswith("?"), F.concat(site, plain, link))
        .otherwise(F.concat(site, _resolved(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link))))
    )


def _rule(rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits; of two as long an allowing one, then the first in order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow", r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: tuple[Rule, ...], url_col: str = "url", html_col: str | None = "html", default: str = "allow", links: DataFrame | None = None) -> DataFrame:
    """All columns, and host, path, rule (or null) and verdict of each page; columns of these names are replaced.

    Aliases come from all canonical links and refresh redirects in html_col, and
    from links, a table of redirects with the columns source and target, if
    given; what stands in a comment is no link.  Relative links are resolved against
    the page, with their segments . and ..  A null URL, or one without ://, has an empty host and path, no
    aliases and, unless a rule fits, the default verdict; null and empty HTML has
    no links, and HTML of any length is read whole.  Pages may repeat, with or
    without an id, and are judged alike.  An empty table gives an empty one.
    rules are compiled into one expression, so they are meant to be a few
    hundred at most.
    """
    names = {"url": url_col} | ({"html": html_col} if html_col else {})
    p, columns = packed(pages, ("host", "path", "rule", "verdict"), **names)
    p = p.withColumns({"host": host(F.coalesce(F.col("url"), F.lit(""))), "path": path(F.coalesce(F.col("url"), F.lit("")))})
    p = _addressed(p, "url", "u_key").withColumn("u_rule", _rule(rules))
    edges = None
    if html_col:
        linking = p.where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
        linking = linking.withColumn("html", F.when(F.col("html").contains("<!--"), F.regexp_replace("html", _COMMENT, "")).otherwise(F.col("html")))
        found = linking.select(
            "u_key", "host", "path", F.regexp_extract("url", r"(?s)^(.*?://)", 1).alias("u_scheme"),
            F.explode(F.concat(*(F.regexp_extract_all("html", F.lit(x), F.lit(1)) for x in (_CANONICAL, _REFRESH)))).alias("u_link"),
        )
        found = found.withColumn("u_link", F.replace("u_link", F.lit("&amp;"), F.lit("&")))
        edges = _addressed(found.withColumn("u_target", _absolute(F.col("u_link"))), "u_target", "v").select(F.col("u_key").alias("u"), "v")
    if links is not None:
        more = _addressed(_addressed(links.select("source", "target"), "source", "u"), "target", "v").select("u", "v")
        edges = more if edges is None else edges.unionByName(more)
    if edges is None:
        alias = F.lit(None).cast("string")
    else:
        comp = connected_components(edges)
        # A link's target may be no page of the table and still have a rule.
        known = comp.withColumns({"host": F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), "path": F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)}).withColumn("r", _rule(rules))
        verdicts = known.groupBy("component").agg(F.max(F.col("r.verdict") == "allow").alias("allowed"), F.max(F.col("r.verdict") == "block").alias("blocked"))
        said = comp.join(verdicts, "component").select(
            F.col("node").alias("u_node"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("u_alias")
        )
        p = p.join(said, F.col("u_key") == F.col("u_node"), "left").drop("u_node")
        alias = F.col("u_alias")
    return p.select(*columns, "host", "path", F.col("u_rule.rule").alias("rule"), F.coalesce(F.col("u_rule.verdict"), alias, F.lit(default)).alias("verdict"))
