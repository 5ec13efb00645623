from fixtures import frame
from pyspark.sql import functions as F

from cladeframe.llm.url_filter import links_of, url_verdicts

SCHEMA = "page_id long, url string, html string"
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "bad.net", "/"), ("allow", "good.net", "/ok"))


def brute_rule(host, path, rules):
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    end = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


URLS = [
    "http://WWW.Example.org/es/1?x#y", "https://example.org", "http://example.org/en/1", "http://notexample.org/es/", "http://a.b.bad.net/x", "http://bad.net?q", "nothing", None,
    "://x.bad.net/p", "http://good.net/ok/1", "http://good.net/no", "http://İÀ.bad.net/\n/x", "http://h/a://bad.net/", "http://example.org:80/es/", "",
]


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(frame(spark, [(i, u, None) for i, u in enumerate(URLS)], SCHEMA), RULES).collect()}
    for i, u in enumerate(URLS):
        host, path = parse(u)
        rule, verdict = brute_rule(host, path, RULES)
        assert got[i] == (host, path, rule, verdict or "allow"), u


def link(kind, to):
    return {"canonical": f'<head><LINK data-x="1" href="{to}" rel=canonical></head>', "refresh": f"<meta http-equiv='refresh' content='0; url={to}'>", "og": f'<meta property="og:url" content="{to}">', "style": f'<link rel="stylesheet" href="{to}">'}[kind]


def test_blocks_pass_to_aliases(spark):
    pages = [
        (1, "http://a.com/1", link("canonical", "http://bad.net/1")),  # a target that is no page of the table
        (2, "http://b.com/1#top", link("refresh", "http://a.com/1")),
        (3, "http://c.com/1", link("og", "//b.com/1")),
        (4, "http://d.com/1", link("style", "http://bad.net/1")),
        (5, "http://e.com/1", link("canonical", "/2")),
        (6, "http://e.com/2", None),
        (7, "http://x.bad.net/3", link("canonical", "http://good.net/ok")),  # an allowed member: the class is allowed
        (8, "http://f.com/", link("canonical", "http://x.bad.net/3")),
        (9, "http://b.com/1", ""),
        (9, "http://b.com/1", ""),
        (10, None, link("canonical", "http://bad.net/1")),
        (11, "http://g.com/dir/page", link("canonical", "other")),
        (12, "http://g.com/dir/other", link("canonical", "http://bad.net/")),
    ]
    df = frame(spark, pages, SCHEMA).withColumn("node", F.lit(1)).withColumn("best", F.lit(1))
    rows = url_verdicts(df, RULES).collect()
    got = {r.page_id: r.verdict for r in rows}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "block", 10: "allow", 11: "block", 12: "block"}
    assert len(rows) == len(pages)
    redirects = spark.createDataFrame([("http://d.com/1", "http://bad.net/9"), (None, "x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_verdicts(df, RULES, redirects).collect()}[4] == "block"
    assert url_verdicts(frame(spark, [], SCHEMA), RULES).count() == 0


def test_sql_matches(spark):
    import duckdb
    import pandas as pd

    from cladeframe.llm.url_filter import duckdb_sql

    pages = [(i, u, None) for i, u in enumerate(URLS)] + [
        (50, "http://a.com/1", link("canonical", "http://bad.net/1")),
        (51, "http://b.com/1#top", link("refresh", "http://a.com/1")),
        (52, "http://c.com/1", link("og", "//b.com/1")),
        (53, "http://g.com/dir/page", link("canonical", "other")),
        (54, "http://g.com/dir/other", link("canonical", "http://good.net/ok")),
        (55, "http://h.com", link("canonical", "x")),
    ]
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    have = sorted(map(str, url_verdicts(frame(spark, pages, SCHEMA), RULES).select("page_id", "host", "path", "rule", "verdict").toPandas().itertuples(index=False, name=None)))
    assert have == sorted(map(str, c.execute(duckdb_sql(RULES)).df().itertuples(index=False, name=None)))


def test_forms_of_links():
    page = "http://A.com/x/y?q#f"
    forms = {
        '<link rel=canonical href="http://bad.net/a?b=1&amp;c=2">': ["http://bad.net/a?b=1&c=2"],
        '<LINK REL="alternate Canonical" HREF=" ../z ">': ["http://A.com/z"],
        '<link rel=canonical href="?p=2">': ["http://A.com/x/y?p=2"],
        '<link rel=canonical href="./../../w">': ["http://A.com/w"],
        "<base href='http://b.org/d/'><meta property=og:url content=e>": ["http://b.org/d/e"],
        '<meta http-equiv="Refresh" content="5;URL=&#39;//c.net/&#39;">': ["http://c.net/"],
        '<meta http-equiv="refresh" content="5">': [],
        '<!-- <link rel=canonical href="http://no/"> -->': [],
        '<script>"<link rel=canonical href=http://no/>"</script><style><link rel=canonical href=http://no/></style>': [],
        '<noscript><meta http-equiv=refresh content="0;url=http://no/"></noscript><template><link rel=canonical href=http://no/></template>': [],
        '<link rel=canonical href="http://[oops/">': [],
        '<link rel=canonical href="">': [],
        '<link rel=canonical href="mailto:a@b">': [],
        '<link rel=canonical href="http://cut/': [],
        '<link rel=stylesheet href="http://no/"><a rel=canonical href="http://no/">': [],
        "": [],
    }
    for html, want in forms.items():
        assert links_of(page, html) == want, html


def test_classes_meet_whatever_the_form(spark):
    pages = [
        (1, "http://a.com/1", '<link rel=canonical href="HTTP://BAD.net/1?x=1&amp;y=2#top">'),
        (2, "HTTPS://B.com/2", '<link rel=canonical href="../2/./c">'),
        (3, "https://b.COM/2/c#x", '<link rel=canonical href="http://a.com/1">'),
        (4, None, None),
        (5, "http://a.com/1", None),
    ]
    rows = url_verdicts(frame(spark, pages, SCHEMA), RULES).collect()
    assert sorted((r.page_id, r.verdict) for r in rows) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "block")]


def test_allow_comes_before_block_in_ties(spark):
    for rules in ([("block", "t.net", "/a"), ("allow", "t.net", "/a")], [("allow", "t.net", "/a"), ("block", "t.net", "/a"), ("block", None, "/"), (None, "t.net", "/a/b")]):
        got = url_verdicts(frame(spark, [(1, "http://t.net/a/b", None)], SCHEMA), rules).first()
        assert (got.rule, got.verdict) == ("t.net/a", "allow")


def test_many_rules(spark):
    """20,000 rules as a table, one host with a third of them."""
    rules = [("block" if i % 2 else "allow", "hot.net" if i % 3 == 0 else f"h{i}.net", f"/{i}") for i in range(20_000)]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    pages = [(i, f"http://x.{h}{p}/y", None) for i, (_, h, p) in enumerate(rules[::97])]
    got = {r.page_id: (r.rule, r.verdict) for r in url_verdicts(frame(spark, pages, SCHEMA), table).collect()}
    for i, (_, h, p) in enumerate(rules[::97]):
        assert got[i] == brute_rule("x." + h, p + "/y", rules)


def test_hostile_page():
    html = "<link rel=canonical href=http://x/>" + "<link " * 20_000 + "<!-- " * 20_000
    assert links_of("http://a/", html) == ["http://x/"]


def test_redirect_query_is_at_work(spark):
    from cladeframe.llm.queries import op7_url_filters, url_redirect_classes

    d = "/root/testdata/sf0.01"
    plain = {r.page_id: r.verdict for r in op7_url_filters(spark, d).collect()}
    classed = {r.page_id: r.verdict for r in url_redirect_classes(spark, d).collect()}
    assert plain.keys() == classed.keys() and sum(plain[k] != classed[k] for k in plain) > 20
