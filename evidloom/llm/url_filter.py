"""URL filter with redirect equivalence, in DataFrame functions only.

A rule has a host and the start of a path, and allows or blocks; it fits its host and all
subdomains, and of the rules that fit, the longest holds (then block before allow). URLs that
redirects or canonical links join are aliases: connected components over those edges pass a
block decision on to all members, but a URL that a rule allows by itself stays allowed. Without
any decision the verdict is ``allow``.

Edges come from pages' own canonical links and refresh redirects, and from a table of redirects
where one is given. URLs are compared without scheme and fragment, host lower-cased. Only URLs
with edges take part in the component search; what it shuffles are hashes of URLs (64 bits: two
URLs fall together with probability 2**-64 a pair).

A null URL, or one without ``://``, has an empty host and path, no rule and no aliases. Repeated
rows are judged separately and alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evidloom.llm.components import connected_components
from evidloom.llm.scratch import written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruling(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and allowance of the longest rule that fits; nulls where none does."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), not r.allow)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, allow = F.when(fits, r.name).otherwise(name), F.when(fits, r.allow).otherwise(allow)
    return name, allow


def resource(url: Column) -> Column:
    """What aliases are named by: host, path and query; null where there is no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


LINK, CANONICAL, HREF = r"(?is)<link\b[^>]*>", r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
META, REFRESH, MOVED = r"(?is)<meta\b[^>]*>", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def _target(html: Column) -> Column:
    """URLs that a page says it is the same as."""

    def found(tag: str, kind: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(kind))
        return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, target, 1)), lambda u: u != "")

    canonical = F.when(html.contains("anonical") | html.contains("ANONICAL"), found(LINK, CANONICAL, HREF))
    moved = F.when(html.contains("efresh") | html.contains("EFRESH"), found(META, REFRESH, MOVED))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(canonical, none), F.coalesce(moved, none))


def absolute(url: Column, base: Column) -> Column:
    """A link's URL as seen from a page."""
    origin = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"(?s)^.*/", 0), F.lit("")), F.lit("/")))
    return F.when(url.contains("://"), url).when(url.startswith("//"), F.concat(scheme, url)).when(url.startswith("/"), F.concat(origin, url)).otherwise(F.concat(folder, url))


def judged(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url, html).

    ``redirects`` has columns from_url and to_url.
    """
    url = F.col("url").cast("string")
    edges = pages.where("url IS NOT NULL AND html IS NOT NULL").select(url.alias("a"), F.explode(_target(F.col("html"))).alias("t")).select("a", absolute(F.col("t"), F.col("a")).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")))
    edges = edges.select(resource(F.col("a")).alias("ra"), resource(F.col("b")).alias("rb"), "a", "b").where("ra IS NOT NULL AND rb IS NOT NULL AND ra <> rb")
    edges, _ = written(edges, "aliases")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(resource(url)).alias("node"), resource(url).isNotNull().alias("named"))
    name, allow = ruling(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "allowed": allow})
    if edges.isEmpty():
        blocked = F.lit(False)
    else:
        comp = connected_components(edges.select(F.xxhash64("ra").alias("a"), F.xxhash64("rb").alias("b")))
        ends = edges.select(F.explode(F.array("a", "b")).alias("u")).distinct().select(F.xxhash64(resource(F.col("u"))).alias("node"), (~F.coalesce(ruling(host_of(F.col("u")), path_of(F.col("u")), rules)[1], F.lit(True))).alias("no"))
        ends = ends.union(rows.where("named AND NOT allowed").select("node", F.lit(True)))
        bad = comp.join(ends, "node").groupBy("component").agg(F.max("no").alias("no")).where("no").select("component")
        bad = comp.join(bad, "component").select("node", F.lit(True).alias("alias_blocked"))
        rows = rows.join(bad, "node", "left")
        blocked = F.coalesce(F.col("alias_blocked") & F.col("named"), F.lit(False))
    verdict = F.when(F.coalesce(F.col("allowed"), ~blocked), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
