import itertools
import random
import re
import time

from fixtures import frame

from cladeframe.llm.html_extract import blocks, extract, label, log_odds, main_text, minimum_cut, smoothness, weighed

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p><article>";</script></head><body class="home has-sidebar">
<header><div class=logo>Site</div></header><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></ul></nav>
<div class="cookie-notice">We use cookies &amp; more.</div><!-- ad --><div class="ad">Buy now. It is cheap.</div>
<main><article><header><h1>The   Title</h1></header><p>First &eacute; &lt;b&gt; <b>bold</b>, <a href=z>link</a>.<br>More
text.</p><p><b>Unclosed paragraph one.<p>Of.<ul><li>Item 1<li>Item 2</ul>
<aside>Related: <a href=q>foo</a></aside><form><label>Name</label><input><button>Go</button></form><noscript>no</noscript>
<table><tr><td>cell</td></tr></table>
<section id="comments"><p>I disagree with this very long and well written comment, strongly.</p></section></article></main>
<div id="sidebar"><p>Popular posts that are long enough to look like an article's text, in a way.</p></div>
<footer>&copy; Site. All rights.</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "The Title\nFirst é <b> bold, link. More text.\nUnclosed paragraph one.\nOf.\nItem 1\nItem 2\ncell"


def test_page_without_article_marks():
    text = "This is a long paragraph of the story that goes on, and on, with commas and some more words until it ends."
    page = f'<body><div class=menu><a href=a>One</a> <a href=b>Two</a></div><div id=wrap><p>{text}</p><p>{text} Twice.</p><p>{text}</p></div><div><a href=x>Next</a> | <a href=y>Prev</a></div></body>'
    assert main_text(page).split("\n") == [text, text + " Twice.", text]


def test_broken_and_empty():
    assert main_text(None) == "" == main_text("") == main_text("<nav>a</nav>") == main_text("<script>x")
    assert main_text("<article><p>Cut off in the mid") == "Cut off in the mid"
    assert main_text("<article><p>Done.</p><p class='x") == "Done."
    assert main_text("<article><p>a &amp b &am</p><!-- open") == "a & b &am"


def test_rows(spark):
    df = frame(spark, [(1, "u", PAGE), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(df.selectExpr("*", "1 AS text")).collect()}
    assert got[1] == ("u", main_text(PAGE), len(main_text(PAGE))) and got[2] == (None, "", 0) and got[3] == ("v", "", 0)
    assert extract(df.limit(0)).count() == 0


def test_minimum_cut_against_all_labellings():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randrange(1, 8)
        source = [rng.choice([0, rng.random() * 5]) for _ in range(n)]
        sink = [rng.choice([0, rng.random() * 5]) for _ in range(n)]
        edges = [(i, j, rng.random() * 3) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda on: sum(s for s, x in zip(source, on) if not x) + sum(t for t, x in zip(sink, on) if x) + sum(c for i, j, c in edges if on[i] != on[j])  # noqa: E731,B023
        best = min(cost(on) for on in itertools.product([False, True], repeat=n))
        assert abs(cost(minimum_cut(source, sink, edges)) - best) < 1e-9


LONG = "This is a long paragraph of the story that goes on, and on, with commas and some more words until it ends."


def test_pages_against_all_labellings():
    """Whole pages: of all labellings of their blocks the one of least cost, written out here."""
    rng = random.Random(5)
    say = lambda: rng.choice(["Be.", "Of", LONG, "<a href=x>a line of links</a>", "A short one, here.", "<a href=x>x</a> | <a href=y>y</a>"])
    for _ in range(150):
        page = ""
        while page.count("<p>") + page.count("<li>") < rng.randrange(3, 10):
            page += rng.choice([f"<p>{say()}</p>", f"<div><p>{say()}<p>{say()}</div>", f"<ul><li>{say()}<li>{say()}</ul>", f"<nav><p>{say()}</nav>", f'<div class="x ad"><p>{say()}</div>', f"<article><p>{say()}<p>{say()}</article>"])
        found = blocks(page)
        has_main = "<article>" in page
        score = [log_odds(b, has_main) for b in found]
        edges = weighed(smoothness(found), score)

        def cost(on):
            return sum(max(x, 0) if not o else max(-x, 0) for x, o in zip(score, on)) + sum(c if on[i] else d for i, j, c, d in edges if on[i] != on[j])  # noqa: B023

        best = min(cost(on) for on in itertools.product([False, True], repeat=min(len(found), 12))) if len(found) <= 12 else None
        if best is not None:
            assert abs(cost([on for _, _, on in label(page)]) - best) < 1e-9
        assert [u for _, u, _ in label(page)] == [x > 0 for x in score]


def test_the_cut_mends_what_the_classifier_gets_wrong():
    two = LONG + " " + LONG
    page = f"<body><div id=wrap><p>{two}</p><p>So.</p><p>{two}</p><p><a href=x>A line that is a link alone</a></p><p>{two}</p></div><div><a href=x>Next</a></div></body>"
    got = label(page)
    assert [u for _, u, _ in got] == [True, False, True, False, True, False] and [on for _, _, on in got] == [True] * 5 + [False]


def test_unmarked_pages_of_the_driver():
    """The driver's pages with their marks taken away: most blocks that the classifier gets wrong the cut mends."""
    import pyarrow.parquet as pq

    right, alone, n = 0, 0, 0
    for h in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        marked = label(h)
        plain = label(re.sub(r"</?(nav|article|footer)>", lambda m: m[0].replace(m[1], "div"), h or "").replace(' class="ad"', ""))
        n += len(marked)
        alone += sum(u == on for (_, u, _), (_, _, on) in zip(plain, marked))
        right += sum(c == on for (_, _, c), (_, _, on) in zip(plain, marked))
    assert right > 0.88 * n and n - right < 0.5 * (n - alone)


PARAGRAPH = "A paragraph of some two hundred characters, which an ordinary page without any marks holds, as so many do, so that it has to be taken for the article of the page, whatever short lines stand beside or between it."


def test_short_lines_join_an_article_and_never_drag_it_out():
    page = f"<div><a>Home</a> <a>News</a></div><div><p>{PARAGRAPH}</p><p>Yes.</p><h2>Next</h2><p>{PARAGRAPH}</p></div>"
    assert main_text(page).split("\n") == [PARAGRAPH, "Yes.", "Next", PARAGRAPH]
    line = "<p>A line of twenty-nine letters</p>"
    assert main_text(f"<p>{PARAGRAPH}</p>{line * 3}").split("\n")[0] == PARAGRAPH
    for n in (0, 1, 5, 40):
        for other in (line, "<p>So.</p>", "<p><a href=x>a line of links</a></p>", "<h3>x</h3>"):
            for page in (f"<div>{other * n}<p>{PARAGRAPH}</p>{other * n}</div>", f"<div><p>{PARAGRAPH}</p>{other * n}<p>{PARAGRAPH}</p></div>"):
                assert PARAGRAPH in main_text(page)


def test_pages_made_with_and_without_marks():
    """Independent truth: pages of known paragraphs, headings and lists between menus, notices and footers; nine in ten characters both ways."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(2, 10))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize()
    links = lambda n: " ".join(f"<a href=/{i}>{say(rng.randrange(1, 3))}</a>" for i in range(n))
    kept, said, got = 0, 0, 0
    for i in range(300):
        body, truth = [], []
        for _ in range(rng.randrange(2, 9)):
            kind = rng.choice("ppppphl")
            texts = [", ".join(say(rng.randrange(8, 25)) for _ in range(rng.randrange(2, 5))) + "."] if kind == "p" else [say(3)] if kind == "h" else [say(6) for _ in range(3)]
            body.append(f"<p>{texts[0]}</p>" if kind == "p" else f"<h2>{texts[0]}</h2>" if kind == "h" else "<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>")
            truth += texts
        marked = i % 2
        wrap = ("nav", "article", "footer") if marked else ("div", "div", "div")
        page = f"<html><body><{wrap[0]}>{links(6)}</{wrap[0]}><div><{wrap[1]}>{''.join(body)}</{wrap[1]}></div><{wrap[2]}>{links(4)} {say(2)}</{wrap[2]}></body></html>"
        out = main_text(page).split("\n")
        right = sum(len(t) for t in out if t in truth)
        kept, said, got = kept + right, said + sum(map(len, truth)), got + sum(map(len, out))
    assert kept > 0.9 * said and kept > 0.9 * got


def test_ends_of_nothing_cost_nothing():
    start = time.perf_counter()
    assert main_text("<div>" * 8000 + f"<p>{PARAGRAPH}</p>" + "</section>" * 8000) == PARAGRAPH
    assert time.perf_counter() - start < 3


def test_names_are_weak_evidence():
    page = f"""<nav><a href=x>Home</a></nav><article><header class="entry-header"><h1>The headline</h1><p>A standfirst.</p></header>
<p class="related-work">{LONG}</p><div class="text-form"><p>{LONG}</p></div><section class="comment-on-law"><p>{LONG}</p></section>
<div class="post-comments"><p>{LONG}</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p></div><aside><p>{LONG}</p></aside></article><footer>Foot.</footer>"""
    assert main_text(page).split("\n") == ["The headline", "A standfirst.", LONG, LONG, LONG]


def test_markup():
    assert main_text(f'<article><p>{LONG}</p><svg width="1"/><math/><p>After.</p><svg><text>no</text></svg><p>Last.</p></article>') == f"{LONG}\nAfter.\nLast."
    assert main_text(f"<article><p title='a > b' data-x=\"it's\">{LONG}</p><p>1 < 2 <3 <b>x</b></p></article>") == f"{LONG}\n1 < 2 <3 x"
    assert main_text(f"<article><p>{LONG}</p><button>Go</button><p>After.<select><option>no</select></article>") == f"{LONG}\nAfter."
    assert main_text(f"<ARTICLE><P>{LONG}</P><SCRIPT>x</SCRIPT ><P>İ.</P><STYLE>y</style></ARTICLE>") == f"{LONG}\nİ."
    assert main_text(f"<article><p>{LONG}<dl><dt>Term<dd>Meaning<dt>Other<dd>Thing</dl><table><tr><td>a<td>b<tr><td>c</table></article>") == f"{LONG}\nTerm\nMeaning\nOther\nThing\na\nb\nc"
    assert main_text(f"<article><p>{LONG}</p><p>Of.</p><ul>" + "<li>Item</li>" * 30 + "</ul></article>") == "\n".join([LONG, "Of."] + ["Item"] * 30)


def test_time_grows_with_the_page():
    for bad in ("<script ", "<a '", "<!-- ", "<", "</", "<p x='", "<div>", "<svg>", "<script>x</script>", "<p>a", "<li>a"):
        seconds = []
        for n in (20_000, 100_000):
            start = time.perf_counter()
            main_text(f"<article><p>{LONG}</p>" + bad * n)
            seconds.append(time.perf_counter() - start)
        assert seconds[1] < 10 * seconds[0] + 1, bad


def test_repeated_rows_and_ties(spark):
    df = frame(spark, [(1, "u", PAGE)] * 20 + [(None, "u", PAGE)], "page_id long, url string, html string")
    assert {r.text for r in extract(df).collect()} == {main_text(PAGE)} and extract(df).count() == 21
