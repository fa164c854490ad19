"""Main text of pages, and the minimum cut by brute force."""

import random
from itertools import product

from strandql.llm import html_extract as H


def test_min_cut_by_brute_force():
    random.seed(1)
    for _ in range(150):
        n = random.randrange(1, 8)
        gains = [random.randrange(-9, 10) for _ in range(n)]
        edges = [(a, b, random.randrange(0, 6)) for a in range(n) for b in range(a + 1, n) if random.random() < 0.5]
        cost = lambda keep: sum(g for g, k in zip(gains, keep) if g > 0 and not k) - sum(g for g, k in zip(gains, keep) if g < 0 and k) + sum(c for a, b, c in edges if keep[a] != keep[b])
        assert cost(H.min_cut(gains, edges)) == min(cost(k) for k in product([False, True], repeat=n))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu">
<header><a href=/>Site name</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-notice">We use cookies, please accept them all.</div>
<!-- ad --><div class="ad">Buy this now, it is cheap and good.</div><article><h1>A title &amp; more</h1><p><b>First   para&shy;graph
with <i>in</i>line.<br>Second line.<p>Short.</p><aside>Related: something else entirely.</aside><div class="ad-box"><span class=advert>advert</span></div>
<p>Last&nbsp;one, 1 &lt; 2.</p><form><input><button>Send it</button></form></article><section id="comments"><p>A reader's comment that is long enough to look like text.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_article():
    got = H.main_text(PAGE)
    assert got.startswith("A title & more First para\xadgraph with inline. Second line. Short.") and got.endswith("Last one, 1 < 2.")
    assert not any(x in got for x in ("Site", "One", "cookies", "Buy", "Related", "Send", "reader", "2020", "var t"))


def test_without_article_and_broken():
    plain = "<div id=menu><a href=x>Home</a></div><div><p>Hello world, this is a long sentence that has content in it.</p><p>Short.</p><div class='comments'><p>Nice article, I like it very much indeed.</p></div></div><footer>c</footer>"
    assert H.main_text(plain) == "Hello world, this is a long sentence that has content in it. Short."
    for odd in (None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></div>", "<div" * 50, "a < b > c", "&#xZZ;", "<p>" * 300):
        assert isinstance(H.main_text(odd), str)
    assert H.main_text("<article><p>One sentence that goes on and then stops in the mid") == "One sentence that goes on and then stops in the mid"


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y"), (3, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert len(got) == 4 and sorted(len(r["text"]) > 0 for r in got) == [False, False, True, True]
    assert H.extract(df.limit(0)).count() == 0


ARTICLE = "<p>A long first sentence that says what this page is about, and why.</p><p>A second sentence follows, long enough to be text as well.</p>"
TEXT = "A long first sentence that says what this page is about, and why. A second sentence follows, long enough to be text as well."


def test_attributes_are_read_by_name():
    for attrs in (
        'title="The hidden valley"', 'aria-label="Hidden gems"', 'data-state="hidden"', 'data-id="comments"', 'data-class="ad"', "alt='class=ad'", 'title="id=sidebar role=navigation"', "data-x=hidden",
        'class="has-sidebar no-nav"', 'class="row with-comments"', 'style="color:red" title="display:none"',
    ):
        assert H.main_text(f"<nav><a href=/>Home</a></nav><div {attrs}>{ARTICLE}</div>") == TEXT, attrs
        assert H.main_text(f"<article {attrs}>{ARTICLE}</article><footer>The end of all.</footer>") == TEXT, attrs
    for attrs in ("hidden", 'class="x ad y"', "id=comments", 'role = "navigation"', "aria-hidden=true", 'style="DISPLAY: none"', "title='x' class='cookie-notice'"):
        assert H.main_text(f"<div {attrs}>Some other sentence that is not the article's own text.</div><div>{ARTICLE}</div>") == TEXT, attrs


def test_neighbours_decide_weak_blocks():
    weak = "Fig. 3 above"
    gain = H.evidence(H.blocks(f"<div>{weak}</div>")[0], False)
    assert gain < 0  # alone it is boilerplate, between paragraphs of the article it is content
    assert H.main_text(f"<div>{weak}</div>") == ""
    assert H.main_text(f"<div>{ARTICLE}<p>{weak}</p>{ARTICLE}</div>") == f"{TEXT} {weak} {TEXT}"
    # a name that articles use too is outvoted by the text and its neighbours; a plain mark of boilerplate is not
    assert H.main_text(f"<div>{ARTICLE}<p class=legal>The law says so in its third part.</p>{ARTICLE}</div>") == f"{TEXT} The law says so in its third part. {TEXT}"
    assert H.main_text(f"<div>{ARTICLE}<p class=advert>The law says so in its third part.</p>{ARTICLE}</div>") == f"{TEXT} {TEXT}"
    assert H.main_text(f"<div>{ARTICLE}</div><div class=legal>Terms apply</div>") == TEXT


def test_long_and_deep_pages():
    import time

    begun = time.time()
    assert H.main_text("<div>" * 30_000 + ARTICLE) == TEXT
    assert H.main_text("<li><div>" + "<x>" * 10_000 + "<li></li>" * 10_000 + ARTICLE) == TEXT
    many = "".join(f"<p>Sentence number {i} of a very long article, which goes on.</p>" for i in range(20_000))
    assert H.main_text(f"<article>{many}</article>").count("Sentence") == 20_000
    assert H.main_text("<article><p>" + "word " * 400_000 + ".</article>").count("word") == 400_000
    assert time.time() - begun < 30


def test_blocks_by_brute_force():
    """Blocks of plain pages against a reading with the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now = [], []

        def cut(self):
            text = " ".join("".join(self.now).split())
            self.out += [text] if text else []
            self.now = []

        def handle_starttag(self, tag, attrs):
            self.now.append(" ") if tag == "br" else None if tag in H.INLINE else self.cut()

        def handle_endtag(self, tag):
            None if tag in H.INLINE else self.cut()

        def handle_data(self, data):
            self.now.append(data)

    random.seed(5)
    for _ in range(200):
        page = ""
        for _ in range(random.randrange(1, 12)):
            tag = random.choice(["p", "div", "section", "h2", "blockquote", "ul"])
            inner = "".join(random.choice(["a b ", "&amp;", "<b>x</b>", "<br>", " c\n d", "<i class='q>r'>y</i>", "&lt;p&gt; "]) for _ in range(random.randrange(5)))
            page += f"<{tag} title='a > b'>{inner}</{tag}>" if tag != "ul" else f"<ul><li>{inner}</li><li>z</li></ul>"
        want = Plain()
        want.feed(page)
        want.close()
        want.cut()
        assert [b.text for b in H.blocks(page)] == want.out, page


LONG = ARTICLE + "<p>A third one, longer than the others, tells at some length what the first two have only touched upon, so that it is prose.</p>"
LONG_TEXT = TEXT + " A third one, longer than the others, tells at some length what the first two have only touched upon, so that it is prose."


def test_no_name_of_an_ancestor_empties_an_article():
    for open_ in (
        '<div class="page-with-menu">', '<div class="nav-closed content">', '<div class="share-price-report">', '<div class="reply-to-critics">', '<div class="post-comment-count-0">', '<div id="menu-cooking">', '<article class="ad">',
        '<form id="aspnetForm"><article>', "<form>", '<div class="menu">', '<div class="modal"><div>', "<fieldset>", '<section class="sidebar"><div class=x>',
    ):
        for around in ("", "<nav><a href=/>Home</a> <a href=/b>Away</a></nav>"):
            assert H.main_text(f"{around}{open_}{LONG}") == LONG_TEXT, open_


def test_headings_and_lists_stay_in_plain_containers():
    assert H.main_text(f"<div><h1>Head</h1>{ARTICLE}</div>") == f"Head {TEXT}"
    assert H.main_text(f"<div><ul><li>Flour</li><li>Water</li></ul>{ARTICLE}</div>") == f"Flour Water {TEXT}"
    assert H.main_text(f"<div>{ARTICLE}<h2>More</h2><ol><li>One</li><li>Two</li><li>Three</li></ol>{ARTICLE}</div>") == f"{TEXT} More One Two Three {TEXT}"
    assert H.main_text(f"<ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul><div><h1>Head</h1>{ARTICLE}</div>") == f"Head {TEXT}"


def test_notices_and_comments_without_names_go():
    notice = "<div>We use cookies to make this site better. By going on you accept our policy.</div>"
    assert H.main_text(f"{notice}<div>{LONG}</div>") == LONG_TEXT
    comments = "<div><h3>3 Comments</h3><p>I have read this with great interest, and I agree with all of it.</p><div><p>So have I, but I do not agree with any of it at all.</p></div></div>"
    assert H.main_text(f"<div>{LONG}</div>{comments}") == LONG_TEXT
    assert H.main_text(f"<article>{LONG}{comments}</article>") == LONG_TEXT
    assert H.main_text(f"<article>{LONG}<section class='comments'>{3 * LONG}</section></article>") == LONG_TEXT
    # An article about cookies is no notice, and one word of a text no heading of comments.
    about = "<p>Most cookies are baked with butter, and we use sugar, flour and a policy of patience.</p>"
    assert "butter" in H.main_text(f"<article>{LONG}{about}{LONG}</article>")


def test_weights_are_learned_from_certain_blocks(spark):
    rng = random.Random(3)
    counts = {(c, y): rng.randrange(1, 50) for c in rng.sample(range(H.COMBINATIONS), 60) for y in (False, True)}
    got = H.fit(counts)
    # At the optimum the slope in every direction is nought: a plain sum over blocks.
    sides = {y: sum(n for (_, s), n in counts.items() if s == y) for y in (False, True)}
    import numpy as np

    w, slope = np.array(got) / 100, H.RIDGE * (np.array(got) - np.array(H.WEIGHTS)) / 100
    for (c, y), n in counts.items():
        p = 1 / (1 + np.exp(-sum(w[k] for k in H._parts(c))))
        for k in H._parts(c):
            slope[k] += n * sum(sides.values()) / 2 / sides[y] * (p - y)
    assert np.abs(slope).max() < 0.01 * sum(sides.values())
    assert H.fit({}) == H.WEIGHTS == H.fit({(3, True): 9})
    pages = [f"<nav><a href=/>Home</a></nav><article><h1>T</h1>{ARTICLE}</article><div class=ad>Buy a thing of great value today.</div>"] * 40
    df = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)] + [(99, None, None)], "page_id long, url string, html string")
    seen = H.learn(df)
    one = {}
    for h in pages:
        for key in H.certain(h):
            one[key] = one.get(key, 0) + 1
    assert seen == H.fit(one) != H.WEIGHTS
    assert {r["text"] for r in H.extract(df).collect()} == {f"T {TEXT}", ""}


def test_page_text_of_the_tables_is_the_article(spark):
    """Pages of the tables have one article each: its blocks, read with a pattern, are the main text."""
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        if inner:
            text = re.sub(r"</?(?:p|h1|div|ul|li)\b[^>]*>|<br>", " ", inner[1])
            assert got[r["page_id"]] == " ".join(unescape(re.sub(r"</?b>", "", text)).split()), r["page_id"]
