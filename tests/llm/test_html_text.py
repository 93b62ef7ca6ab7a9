"""Main text of pages, and the templates of hosts."""

import re
from html import unescape

import numpy as np

from tidemark.llm import html_text as H

SCHEMA = "page_id long, url string, html string, text string"


def page(k, body, host="a.example.com"):
    html = f"<!DOCTYPE html><html><head><title>{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><div><span>Welcome to the site</span></div><nav><ul><li><a href='/{k}'>n{k}</a></ul></nav><div class='ad'>buy {k}</div>{body}<footer>&copy; x</footer></body></html>"
    return k, f"https://{host}/p/{k}", html, "clash"


def test_parts_of_a_page():
    html = "<header>top</header><main><header><h1>A &amp; B</h1></header><p>one\n two&nbsp;<b>th</b>ree<p>four<form>f</form><section id='comments'><p>no</p></section><div hidden>h</div><ul><li>x<li>y</ul></main><aside>z</aside>"
    assert H.main_text(html) == "A & B\none two three\nfour\nx\ny"
    assert H.main_text("") == "" and H.main_text("a < b <i>c</i>") == "a < b c" and H.main_text("<!-- open") == ""
    assert H.main_text("<nav><ul><li>m<article><p>text</article>") == "text"
    assert H.main_text("<p>&lt;p&gt; &#233;&eacute;") == "<p> éé"
    assert H.main_text("<article><p>" + "long &amp; " * 100000 + "</p></article>") == " ".join(["long &"] * 100000)


def test_names_with_hidden_or_a_menu_word():
    for own in ('class="overflow-hidden"', 'title="hidden gems"', "data-hidden='0'", 'href="/the-hidden-valley"', 'hidden="false"', 'data-note="display:none"', 'aria-hidden="false"'):
        assert H.main_text(f"<div {own}><p>a <a {own}>b</a> c</div>") == "a b c", own
    for own in ("hidden", "HIDDEN", 'class="x" hidden=""', 'hidden="until-found"', "style='color:red; display: none'", "style=display:none", 'aria-hidden="true"'):
        assert H.main_text(f"<div {own}>no</div><p>yes") == "yes", own
    main = "<main><h2 id='how-to-search-a-menu'>How</h2><section id='social-navigation'><p>text</p></section><div id='comments'>no</div><div class='share-bar'>no</div><div id='comments-list'>no</div><h3 id='search'>Search</h3></main>"
    assert H.main_text(main) == "How\ntext\nSearch"
    assert H.main_text("<div id='site-menu'>no</div><p>yes") == "yes"


def test_template_and_slots(spark):
    rows = [page(k, f"<div><p>own text {k}</p><p>more {k}</p></div>") for k in range(9)]
    rows += [page(100 + k, f"<article><h1>T{k}</h1><p>copied</p></article>", "b.example.com") for k in range(6)]
    rows += [(200, None, None, None), (201, "odd", "<p>x</p>", None), (202, "https://c.example.com/", "", None), (None, "https://a.example.com/q", "<p>y</p>", None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract(df).collect())
    want = [(str(k), f"own text {k}\nmore {k}") for k in range(9)] + [("0", "own text 0\nmore 0")] * 2
    want += [(str(100 + k), f"T{k}\ncopied") for k in range(6)] + [("200", ""), ("201", "x"), ("202", ""), ("None", "y")]
    assert got == sorted((a, b, len(b)) for a, b in want)
    assert H.extract(df.limit(0)).count() == 0


def test_pages_table(spark):
    """Every page's article, found here by its tags."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in H.extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", html[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br|b)>", re.sub(r"</?b>|<br>", "", article))
        assert r.text == "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def site(k, rng, host="d.example.com"):
    """A page without article or main: menu, a boxed advert without a telling name, the text, and a line of the site."""
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9999, n))
    body = "".join(f"<p>{words(rng.integers(5, 60))}</p>" for _ in range(rng.integers(1, 6)))
    links = "".join(f"<i><a href='/{x}'>{words(1)}</a></i>" for x in range(rng.integers(2, 5)))
    html = f"<html><body><div class='top'><b>The site of all sites</b>{links}</div><div class='box{k}'><span>{words(4)}</span></div><div class='text'><h1>{words(5)}</h1>{body}<small>Printed by the site</small></div><div class='end'>Made in {words(1)}</div></body></html>"
    want = "\n".join(" ".join(x.split()) for x in re.findall(r"<(?:h1|p)>(.*?)</(?:h1|p)>", html))
    return (k, f"https://{host}/{k}", html, "clash"), want


def brute_classes(pages):
    """Tokens of valid classes by their whole occurrence vectors."""
    vectors = {}
    for k, html in enumerate(pages):
        for token, *_ in H.parse(html)[0]:
            if token:
                vectors.setdefault(token, [0] * len(pages))[k] += 1
    classes = {}
    for token, v in vectors.items():
        classes.setdefault(tuple(v), set()).add(token)
    return {frozenset(t) for v, t in classes.items() if len(t) >= H.LEAST_TOKENS and sum(x > 0 for x in v) >= H.LEAST_PAGES and 2 * sum(x > 0 for x in v) > len(pages)}


def test_templates_match_brute_force_and_names_do_not_decide(spark):
    rng = np.random.default_rng(8)
    rows, want = zip(*(site(k, rng) for k in range(40)))
    df = spark.createDataFrame(list(rows), SCHEMA).repartition(5)
    got = H.template_tokens(df.selectExpr("'h' as host", "page_id", "html")).collect()
    classes = {}
    for r in got:
        classes.setdefault(r["class"], set()).add(r.token & H._MASK)
    assert {frozenset(t) for t in classes.values()} == brute_classes([r[2] for r in rows])
    texts = {r.page_id: r.text for r in H.extract(df).collect()}
    assert [texts[k] for k in range(40)] == list(want)
    assert H.main_text(rows[0][2]) != want[0]  # without its host's template the page shows its menu


def test_classes_that_do_not_nest_are_left_out():
    one, two = [(t, H._TAG, 1, k, 1, 1, 0, 0, 9) for k, t in enumerate((11, 12, 13))], [(t, H._TAG, 2, k + 0.5, 1, 1, 0, 0, 9) for k, t in enumerate((21, 22, 23, 24))]
    template = H.Template(one + two)
    page = lambda *tokens: [(t, None, None, True) for t in tokens]
    assert template.left_out(page(11, 12, 21, 22, 23, 24, 13, 99)) == set()
    assert template.left_out(page(11, 12, 13, 11, 12, 13)) == set()
    assert template.left_out(page(11, 21, 12, 22, 23, 24, 13)) == {1}
    assert template.left_out(page(12, 11, 13, 21, 22, 23, 24)) == {1}
    assert template.left_out(page(11, 12, 13, 21, 22, 23)) == {2}


def test_cost_is_linear():
    import time

    def seconds(html):
        began = time.perf_counter()
        H.main_text(html)
        return time.perf_counter() - began

    for piece in ('<a "', "<a '", "<div>", "<div></b>", "<!--", "<b x=\"y\" '"):
        assert seconds(piece * 100_000) < 20 * seconds(piece * 20_000) + 1, piece
        assert seconds(piece * 100_000) < 30
