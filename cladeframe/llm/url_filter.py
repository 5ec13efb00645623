"""URL filters with redirect equivalence.

Each URL is judged by the longest rule that fits its host (or a parent domain)
and path.  A URL without a rule takes the decision of its equivalence class: the
connected component over redirect and canonical links.  A class with an
explicitly allowed member is allowed, else one with a blocked member is blocked;
a URL in no such class is allowed.  A URL's own rule always comes first.  Of
rules of one length that fit a URL, one that allows comes before one that
blocks.

Rules are a table, of any size.  Each parent domain of a host that has rules is
joined with the lengths of its rules' paths, and those prefixes of the URL's
path with the rules, so the work of a URL grows with its domains and those
lengths, not with the rules.

Links come from the pages (rel=canonical, og:url, meta refresh; a narrow pass
that reads in Python only the pages that name one) and, if given, from a table
of redirects.  They are resolved against the page's URL or its base element as
RFC 3986 says, character references decoded; comments, scripts, styles,
templates and noscript elements hold no links.  Link targets that are no page of
the table are judged by the rules too.  Nodes are URLs without their fragment,
scheme and host in lower case.

Rows: a null URL, or one without ``://``, has an empty host and path and no
links; a null page has none; repeated pages and links count once for the classes
and each page is a row of the result; a link to itself is none; of equally long
rules (ties) see above; a rule with a null part is none; an unfinished tag at
the end of a page and a target that can't be resolved are no links; a very long
page is read whole; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize
from cladeframe.operators.components import connected_components

#: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HINT = r"(?i)canonical|og:url|refresh"
_NO_LINKS = frozenset(("script", "style", "template", "noscript"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """A URL without its fragment, scheme and host in lower case."""
    head = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*", 0)
    return F.concat(F.translate(head, UPPER, LOWER), F.regexp_replace(F.substring(url, F.length(head) + 1, F.length(url)), "(?s)#.*$", ""))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(verdict, rule_host, rule_path), once each, from tuples or from columns verdict, host and path."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    named = rules.select("verdict", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    return named.dropna().distinct()


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of each distinct (host, path) that a rule fits."""
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    near = urls.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("rule_host"))
    tried = near.join(lengths, "rule_host").select("host", "path", "rule_host", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    fits = tried.select("host", "path", "rule_host", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("rule_path")).join(rules, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(rule).alias("n"), (F.col("verdict") == "allow").alias("allows"), rule.alias("rule"), "verdict")
    return fits.groupBy("host", "path").agg(F.max(order).alias("best")).select("host", "path", "best.rule", "best.verdict")


class _Links(HTMLParser):
    """The targets of a page's redirect and canonical links, and its base."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.found: list[str] = []
        self.silent: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _NO_LINKS:
            self.silent.append(tag)
        if self.silent or tag not in ("link", "meta", "base"):
            return
        named: dict[str, str] = {}
        for k, v in attrs:
            named.setdefault(k, (v or "").strip())
        if tag == "base" and self.base is None and named.get("href"):
            self.base = named["href"]
        elif tag == "link" and "canonical" in named.get("rel", "").lower().split():
            self.found.append(named.get("href", ""))
        elif tag == "meta" and named.get("property", "").lower() == "og:url":
            self.found.append(named.get("content", ""))
        elif tag == "meta" and named.get("http-equiv", "").lower() == "refresh":
            wait, _, to = named.get("content", "").partition(";" if ";" in named.get("content", "") else ",")
            key, eq, to = to.partition("=")
            if eq and key.strip().lower() == "url":
                self.found.append(to.strip().strip("\"'").strip())

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _NO_LINKS:  # complete in itself
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            del self.silent[self.silent.index(tag) :]


def links_of(url: str, html: str) -> list[str]:
    """The resolved targets of one page."""
    parser = _Links()
    parser.feed(html)
    out = []
    for to in parser.found:
        try:
            full = urljoin(urljoin(url, parser.base or ""), to)
        except ValueError:  # no URL, such as an unfinished IPv6 address
            continue
        if to and "://" in full:
            out.append(full)
    return out


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): redirect and canonical links of the pages, resolved against their URLs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(u, to) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for to in links_of(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["src", "dst"])

    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    named = rows.where(F.contains("url", F.lit("://")) & F.rlike("html", F.lit(_HINT)))
    return named.mapInArrow(run, "src string, dst string").select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src <> dst")


def url_verdicts(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of each page.

    ``rules`` are tuples or a table (verdict, host, path), ``redirects`` a table
    (src, dst) of URLs of known redirects.
    """
    links = page_links(pages, url_col, html_col)
    if redirects is not None:
        given = redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
        links = links.unionByName(given.where("src <> dst"))
    table = rule_table(pages.sparkSession, rules)
    classes = materialize(connected_components(links), "url-classes").select("node", "component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        node_of(F.col(url_col)).alias("node"),
    )
    # Written, so that the planner knows its size.
    ruled = materialize(best_rules(rows.select("host", "path").unionByName(classes.select("host", "path")), table), "url-rules")
    agreed = classes.join(ruled, ["host", "path"]).groupBy("component").agg(
        F.bool_or(F.col("verdict") == "allow").alias("allows"), F.bool_or(F.col("verdict") == "block").alias("blocks")
    )
    blocked = classes.join(agreed.where("blocks AND NOT allows").select("component"), "component").select("node", F.lit(True).alias("alias_blocked"))
    return (
        rows.join(ruled, ["host", "path"], "left")
        .join(blocked, "node", "left")
        .select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("alias_blocked"), "block").otherwise("allow")).alias("verdict"))
    )


def language_redirects(pages: DataFrame) -> DataFrame:
    """(src, dst): each page under /en/ or /es/ redirects to its /de/ or /fr/ form. A stand-in for a crawler's log."""
    to = F.regexp_replace(F.regexp_replace("url", "^([^:]*://[^/]*)/en/", "$1/de/"), "^([^:]*://[^/]*)/es/", "$1/fr/")
    return pages.select(F.col("url").alias("src"), to.alias("dst")).where("src <> dst")


def duckdb_sql(rules=RULES, redirects: str = "SELECT NULL::VARCHAR AS src, NULL::VARCHAR AS dst WHERE false") -> str:
    """Verdicts of ``pages`` as SQL for DuckDB.

    It reads links of pages whose targets hold no character references and no dot
    segments, and knows no base element; the tests hold those against a parser.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quote(v)}, {quote(h)}, {quote(p)})" for v, h, p in rules)
    low = lambda u: f"translate({u}, '{UPPER}', '{LOWER}')"
    host = lambda u: low(f"regexp_extract(coalesce({u}, ''), '^(?s:.*?)://([^/?#]*)', 1)")
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
    head = lambda u: f"regexp_extract({u}, '^(?s:.*?)://[^/?#]*', 0)"
    node = lambda u: f"{low(head(u))} || regexp_replace(substr({u}, length({head(u)}) + 1), '(?s)#.*$', '')"
    folder = "regexp_extract(url, '^(?s:.*?)://[^/?#]*(?:[^?#]*/)?', 0)"
    tags = r"(?i)<(?:link|meta)\b[^>]*>"
    kind = r"""(?i)\b(?:rel\s*=\s*["']?canonical|property\s*=\s*["']?og:url|http-equiv\s*=\s*["']?refresh)\b"""
    href = r"""(?i)\b(?:href\s*=|content\s*=\s*["']?(?:\s*[0-9.]+\s*;\s*url\s*=)?)\s*["']?([^"'\s>]+)"""
    silent = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<noscript\b.*?</noscript\s*>"
    best = "2 * length(h || p) + (verdict = 'allow')::INT"
    return f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {table}) t(verdict, h, p)),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, {quote(silent)}, '', 'g'), {quote(tags)})) AS tag FROM pages WHERE contains(url, '://')),
goes AS (SELECT url, regexp_extract(tag, {quote(href)}, 1) AS dest FROM tags WHERE regexp_matches(tag, {quote(kind)})),
links AS (SELECT {node("url")} AS s, {node("full_url")} AS d FROM (
  SELECT url, CASE WHEN contains(dest, '://') THEN dest WHEN starts_with(dest, '//') THEN regexp_extract(url, '^(?s:(.*?))://', 1) || ':' || dest
    WHEN starts_with(dest, '/') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*', 0) || dest
    WHEN starts_with(dest, '?') THEN regexp_extract(url, '^(?s:.*?)://[^?#]*', 0) || dest
    ELSE CASE WHEN ends_with({folder}, '/') THEN {folder} ELSE {folder} || '/' END || dest END AS full_url
  FROM goes WHERE dest <> '')
  UNION ALL SELECT {node("src")}, {node("dst")} FROM ({redirects})),
e AS (SELECT s AS u, d AS v FROM links WHERE s <> d UNION SELECT d, s FROM links WHERE s <> d),
reach AS (SELECT u AS node, u AS r FROM e UNION SELECT e.v, r FROM reach JOIN e ON e.u = node WHERE r < e.v),
classes AS (SELECT node, min(r) AS component FROM reach GROUP BY node),
judged AS (SELECT component, arg_max(verdict, {best}) AS verdict FROM classes
  LEFT JOIN rules ON ({host("node")} = h OR ends_with({host("node")}, '.' || h)) AND starts_with({path("node")}, p) GROUP BY component, node),
agreed AS (SELECT component, bool_or(verdict = 'block') AND NOT coalesce(bool_or(verdict = 'allow'), false) AS b FROM judged GROUP BY component),
q AS (SELECT row_number() OVER () AS k, page_id, url, {host("url")} AS host, {path("url")} AS path FROM pages),
own AS (SELECT k, arg_max(h || p, {best}) AS rule, arg_max(verdict, {best}) AS verdict
  FROM q JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(own.verdict, CASE WHEN b THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN own USING (k) LEFT JOIN classes ON classes.node = {node("url")} LEFT JOIN agreed USING (component)
"""
