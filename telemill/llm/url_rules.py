"""URL rules whose block decisions follow redirects and canonical links.

Addresses that redirect to each other, or name each other as canonical, are one resource. Rules decide for the
addresses they fit; a block then holds for every other address of the same resource, unless a rule allows that
address, or any of its aliases, explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.graph import components
from telemill.llm.tables import stored

Rule = tuple[str, str, str]  # verdict ("allow" or "block"), host, path


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (verdict, host, path) that fits: its host or a subdomain of it, and a path that begins with its own.

    Longest is by the length of host and path together, then of the host; of equal ones an allow comes first.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0]))
    fits = [
        F.when(
            ((host == r[1]) | host.endswith(F.lit("." + r[1]))) & path.startswith(F.lit(r[2])),
            F.struct(F.lit(r[0]).alias("verdict"), F.lit(r[1] + r[2]).alias("rule")),
        )
        for r in ranked
    ]
    return F.coalesce(*fits, F.lit(None).cast("struct<verdict:string,rule:string>"))


def plain(url: Column) -> Column:
    """The address that a server's usual redirects lead to; null without ``://``.

    No scheme, query, fragment, trailing slash or page suffix, and no ``www.`` or ``m.`` before the host.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^(www|m)\.(?=[^.]+\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(/index)?\.html?$", ""), r"/+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path))


def resolved(base: Column, target: Column) -> Column:
    """``target`` as a whole address, a relative one seen from ``base``; null for an empty one and other kinds, such as ``mailto:``."""
    site = F.regexp_extract(base, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    own = F.when(target.rlike("^[?#]"), path_of(base)).otherwise(folder)
    place = F.when(target.startswith("/"), target).otherwise(F.concat(F.when(own == "", F.lit("/")).otherwise(own), target))
    steps = F.split(F.regexp_extract(place, r"^([^?#]*)", 1), "/")
    up = lambda done: F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
    walked = F.aggregate(
        steps, F.array().cast("array<string>"), lambda done, step: F.when(step == "..", up(done)).when(step == ".", done).otherwise(F.array_append(done, step))
    )
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(site, F.array_join(walked, "/"), F.regexp_extract(place, r"^[^?#]*(.*)$", 1)))
    )


def links(pages: DataFrame) -> DataFrame:
    """(source, target): a page's address with every canonical link and refresh target its html names.

    Relative targets are resolved against the page's address. Pages whose address has no ``://`` name none, nor do
    null ones.
    """
    tag = F.lit(r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>")
    refresh = F.lit(r"(?i)<meta\b[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>")
    canonical = F.transform(F.regexp_extract_all("html", tag, F.lit(0)), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    target = F.transform(F.regexp_extract_all("html", refresh, F.lit(0)), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    named = pages.where(F.instr("url", "://") > 0).select(F.col("url").alias("source"), F.explode(F.concat(canonical, target)).alias("target"))
    return named.select("source", resolved(F.col("source"), F.col("target")).alias("target")).where("target is not null")


def judged(urls: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, column: str = "url") -> DataFrame:
    """``urls`` (any columns, one of them the address) with host, path, rule and verdict.

    ``edges`` (source, target) are redirects and canonical links beyond the usual ones that ``plain`` undoes; both
    kinds are edges of one graph, and a resource is a component of it. Of a rule's verdict nothing is changed. Other
    addresses are blocked if an address of the same resource is blocked by a rule and none is allowed by one; else
    they are allowed. Nulls and addresses without ``://`` fit no rule, belong to no resource and are allowed; edges
    with such an end count for nothing. Columns of the input with these four names are replaced, others may have any
    name.
    """
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    address = F.col(f"`{column}`")
    blocked = _blocked(_addresses(urls.select(address.alias("url")), edges, rules))
    # addresses that are none would all meet in one task of the join
    alone = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    rows = urls.select(
        F.struct(*kept).alias("own") if kept else F.lit(0).alias("own"), F.when(F.instr(address, "://") > 0, address).otherwise(alone).alias("url"),
        host_of(address).alias("host"), path_of(address).alias("path"),
    ).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(blocked.withColumn("blocked", F.lit("block")), "url", "left")
    return rows.select(
        *(["own.*"] if kept else []), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "blocked", F.lit("allow")).alias("verdict"),
    )


def _addresses(urls: DataFrame, edges: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """(url, component, allow, block): every address of the rows and edges, the resource it lies in, what its rule says."""
    known = urls.where(F.instr("url", "://") > 0)
    graph = None
    if edges is not None:
        # read once: finding edges may mean reading whole pages
        edges = stored(edges.select("source", "target").where((F.instr("source", "://") > 0) & (F.instr("target", "://") > 0)), "edges")
        known = known.unionByName(edges.select(F.explode(F.array("source", "target")).alias("url")))
        graph = edges.select(_node("source").alias("a"), _node("target").alias("b"))
    known = known.distinct().withColumn("verdict", fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules).getField("verdict"))
    known = stored(known, "addresses")
    # a plain form is smaller than any address, so these edges alone are stars already
    usual = known.select(_node("url").alias("a"), F.concat(F.lit("-"), plain(F.col("url"))).alias("b"))
    found = components(usual if graph is None else usual.unionByName(graph))
    flags = [F.coalesce(F.col("verdict") == v, F.lit(False)).alias(v) for v in ("allow", "block")]
    return known.withColumn("node", _node("url")).join(found, "node").select("url", "component", *flags)


def _node(url: str) -> Column:
    return F.concat(F.lit("a"), F.col(url))


def _blocked(addresses: DataFrame) -> DataFrame:
    """Addresses of the resources of which a rule blocks one and none allows any."""
    addresses = stored(addresses, "resources")
    whole = addresses.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    return addresses.join(whole.where("block and not allow"), "component", "left_semi").select("url")
