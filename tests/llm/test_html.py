import random

import pytest
from pyspark.sql import functions as F

from weirflow.llm import html

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a>One</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><!-- <p>hidden</p> --><article><header><h1>Head &amp; line</h1></header><p>First   part
of <b>bold</b> text.<br><p>Second &#233;&eacute;&nbsp;end<aside>By the way</aside></p><ul><li>a<li>b</ul>
<table><tr><td>1<td>2</table><form><input value=x>Send</form><p>  </p></article>
<section id="comments"><p>First!</p></section><div class=sidebar>side</div><footer>&copy; x</footer></body></html>"""


def test_article():
    assert html.extract(PAGE) == "Head & line\nFirst part of bold text.\nSecond éé end\na\nb\n1\n2"


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain words only", "plain words only"),
        ("<main><p>a<p>b</main><footer>c</footer>", "a\nb"),
        ("<body><div class=nav>x</div><div><div class=post><h2>T</h2><p>long enough text to be the main part</p></div></div><div class='comment'>no</div>", "T\nlong enough text to be the main part"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>a < b and c</p><p>&lt;tag&gt; &bogus; &amp;amp;</p></article>", "a < b and c\n<tag> &bogus; &amp;"),
        ("<ARTICLE><P CLASS='x'>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>x<script>if(a<b){'</p>'}</script>y</p></article>", "xy"),
        ("<article><div hidden>no</div><p role='alert'>no</p><p>yes</p></article>", "yes"),
        ("<article class='post tag-x'><p>a</p><div class='ad-slot'>no</div><div class=cookiebar>no</div></article><article class='comment'><p>a much longer reader comment</p></article>", "a"),
        ("<div id=page><div class=site-header>no</div><div id=main><div class=content><h1>T</h1><p>the text of the page</p></div><div class=user-comments><p>no</p></div></div></div>", "T\nthe text of the page"),
        ("<article><p>one</p></article><div>between</div><article><p>the longer of two</p></article>", "one\nthe longer of two"),
        ("<main><h1>T</h1><p>lead</p><article><p>a</p></article><article class=teaser>no</article><div class=comment>no</div><p>tail</p></main><p>out", "T\nlead\na\ntail"),
        ("<body><h1>Heading outside</h1><p>lead</p><div id=content><p>a long text of the page that is by far most of it, and goes on</p></div><div id=more><p>second</p></div>", "Heading outside\nlead\na long text of the page that is by far most of it, and goes on\nsecond"),
        ("<div class='post tag-linux hentry'><article><p>all of it</p></article></div>", "all of it"),
        ("<div class='post tag-linux hentry'><p>all of it</p></div>", "all of it"),
        ("<body class='has-sidebar'><div class='with-sidebar'><main><p>a</p></main><div class=sidebar>no</div></div>", "a"),
        ("<article><p>Results.</p><div class='discussion'><h2>Discussion</h2><p>It holds.</p></div></article><div class=discussion><p>First!</p></div>", "Results.\nDiscussion\nIt holds."),
        ("<article><p>One.</p><p><a href=foo\"bar>Two</a>.</p><p>Three \"quoted\".</p></article>", "One.\nTwo.\nThree \"quoted\"."),
        ("<article><p title='a > b' data-x = \"c>d\" checked>Shown</p></article>", "Shown"),
    ],
)
def test_cases(page, text):
    assert html.extract(page) == text


def brute_match(a, b):
    """Size of the largest match by trying every order-preserving choice of children."""
    if a.tag != b.tag:
        return 0

    def best(i, j):
        if i == len(a.elements) or j == len(b.elements):
            return 0
        one = brute_match(a.elements[i], b.elements[j])
        return max(best(i + 1, j), best(i, j + 1), one and one + best(i + 1, j + 1))

    return 1 + best(0, 0)


def test_simple_tree_matching():
    a, b = (html.Page(f"<body>{x}</body>") for x in ("<ul><li>1<li>2<li>3</ul><p>x</p>", "<ul><li>9<li>2</ul><div>q</div><p>x</p>"))
    pairs = html.Match(a, b).pairs()
    assert sorted(p.tag for p, _ in pairs) == ["body", "li", "li", "p", "ul"]
    assert [q.key for p, q in pairs if p.key == q.key and p.tag == "li"]  # of equally large matches the one with the equal text
    assert html.Match(a, b).pairs(a.body.elements[0], a.body.elements[1]) == []
    rng = random.Random(4)

    def tree(depth):
        return "".join(f"<{t} class=c{rng.randrange(2)}>{rng.randrange(3)}{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randrange(4)))

    for _ in range(60):
        x, y = html.Page(f"<body>{tree(2)}</body>"), html.Page(f"<body>{tree(2)}</body>")
        pairs = html.Match(x, y).pairs()
        assert len(pairs) == brute_match(x.body, y.body)
        number = {id(p): id(q) for p, q in pairs}
        assert len(number) == len(set(number.values())) == len(pairs)
        assert all(p.parent is x.body or p is x.body or number[id(p.parent)] == id(q.parent) for p, q in pairs)


def test_long_lists_are_aligned_in_blocks(monkeypatch):
    items = lambda n, tail: html.Page("<body>" + "".join(f"<p>own {n} {i}</p>" for i in range(n)) + f"<p>{tail}</p></body>")
    a, b = items(300, "the end of all"), items(280, "the end of all")
    monkeypatch.setattr(html, "CELLS", 1000)
    pairs = html.Match(a, b).pairs()
    assert len(pairs) > 270 and any(p.key == q.key for p, q in pairs if p.tag == "p")


def test_pairs_do_not_depend_on_the_length_of_lists(monkeypatch):
    """Lists that are not held as a whole table give the pairs of one that is, below them as well."""
    rng = random.Random(6)

    def tree(depth, most):
        return "".join(f"<{t} class=c{rng.randrange(2)}>{rng.randrange(3)}{tree(depth - 1, 4) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "ul"], k=rng.randrange(most)))

    for k in range(80):
        x, y = html.Page(f"<body>{tree(2, 6 + k)}</body>"), html.Page(f"<body>{tree(2, 6 + k)}</body>")
        found = []
        for cells in (10**9, 300, 6, 0):
            monkeypatch.setattr(html, "CELLS", cells)
            m = html.Match(x, y)
            pairs = [(p.number, q.number) for p, q in m.pairs()]
            found.append((pairs, m._score(x.body, y.body)))
        assert found == found[:1] * 4


def test_template_of_long_lists(spark):
    """What pages share is found wherever it stands among hundreds of paragraphs of their own."""
    rows, want = [], []
    for i in range(6):
        before, after = 150 + 60 * i, 20 + 250 * i
        own = [f"own {i} {k}" for k in range(before + after)]
        shared = ["<p>Call our office on weekdays at noon</p>", "<p>Made with care in the cold north</p>"]
        head, tail = own[:before], own[before:]
        rows.append((i, f"http://h.org/{i}", f"<body>{''.join(f'<p>{x}</p>' for x in head)}{shared[0]}{''.join(f'<p>{x}</p>' for x in tail)}{shared[1]}</body>"))
        want.append("\n".join(own))
    got = {r["page_id"]: r["text"] for r in html.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def pages_of(n, host="h.org"):
    for i in range(n):
        yield f"http://{host}/{i}", f"<body><article><h1>Title {i}</h1><p>Own text number {i} of the page</p><p>Subscribe to our letter</p></article><p>tail</p></body>"


def test_wrapper_drops_what_pages_share(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate([*pages_of(12), *pages_of(2, "few.org")])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.query(df).collect()}
    assert got[3] == "Title 3\nOwn text number 3 of the page"
    assert got[12] == "Title 0\nOwn text number 0 of the page\nSubscribe to our letter"  # too few pages to tell


def site(i, rng):
    """A page with unnamed boxes, of one of three layouts: half the pages have a notice; menus have other links on every page."""
    word = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(999)) for _ in range(n))
    body = [f"<p>{word(rng.randint(8, 30))}</p>" for _ in range(rng.randint(2, 9))]
    title = word(4)
    notice = "<p>We have changed our terms of use, please read them.</p>" if i % 2 else ""
    menu = "<ul>" + "".join(f"<li><a href=/{k}>{word(1)}</a></li>" for k in range(6)) + "</ul>"
    boxes = [
        f"{menu}<div class=post-{i}><h1>{title}</h1>{''.join(body)}</div>{notice}<p>Call our office on weekdays</p>",
        f"<div id=top><p>The daily paper of the coast</p></div><div id=text><h1>{title}</h1>{''.join(body)}{notice}</div>{menu}",
        f"<section class=s><h1>{title}</h1>{''.join(body)}</section><section class=t><p>Made with care in the north</p></section>{notice}",
    ]
    want = [title, *[x[3:-4] for x in body]]
    return f"<html><body>{boxes[i % 3]}</body></html>", "\n".join(want)


def test_wrapper_changes_pages_of_shared_layouts(spark):
    rng = random.Random(8)
    pages = [site(i, rng) for i in range(90)]
    df = spark.createDataFrame([(i, f"http://h{i % 2}.org/{i}", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.query(df).collect()}
    changed = sum(got[i] != html.extract(h) for i, (h, _) in enumerate(pages))
    right = sum(got[i] == want for i, (_, want) in enumerate(pages))
    assert changed == 90 and right == 90
    # the distributed votes are those of one list
    for host in range(2):
        for kind in range(3):
            own = [h for i, (h, _) in enumerate(pages) if i % 2 == host and i % 3 == kind]
            refs = html.induce(own)
            assert all(html.extract(h, refs) == got[i] for i, (h, _) in enumerate(pages) if h in own)


def test_copies_of_an_article_are_not_template(spark):
    one = next(iter(pages_of(1)))[1]
    df = spark.createDataFrame([(i, f"http://h.org/{i}", one.replace("tail", f"tail {i}")) for i in range(10)], "page_id long, url string, html string")
    assert {r["text"] for r in html.query(df).collect()} == {"Title 0\nOwn text number 0 of the page\nSubscribe to our letter"}


def test_joined_where_not_broadcast(spark, small, monkeypatch):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages_of(12))], "page_id long, url string, html string").union(spark.read.parquet(f"{small}/pages.parquet"))
    rows = lambda: sorted(map(repr, html.query(df).collect()))
    first = rows()
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(html, "KEY_ROWS", -1)
    assert rows() == first


def test_messy(spark):
    rows = [(1, None, PAGE), (1, None, PAGE), (None, "no scheme", None), (2, "http://a/", ""), (3, "http://a/", "<" * 3000), (4, "http://a/", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "http://a/", "<article>" + "<p>w &amp; " * 20000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("own") for c in ("text", "host", "template", "n_chars")})
    got = {r["page_id"]: r for r in html.query(df).collect()}
    assert html.query(df).count() == len(rows) and got[None]["text"] == "" and got[4]["text"] == "deep" and got[5]["text"].count("\n") == 19_999
    assert got[1]["n_chars"] == len(got[1]["text"]) and html.query(df.limit(0)).count() == 0


PROSE_PART = "<p>Whole article with quite some words in it, so that it counts as text. It has a second sentence.</p>"
PLAIN_PART = "Whole article with quite some words in it, so that it counts as text. It has a second sentence."


def framed(x):
    return f"<html><body><nav><a href='/'>Home</a></nav><div id='wrap'>{x}</div><footer>Copyright</footer></body></html>"


def test_forms_that_hold_the_page():
    assert html.extract(framed(f"<form action='/x'><article>{PROSE_PART}</article><input name='q'><button>Go</button></form>")) == PLAIN_PART
    assert html.extract(framed(f"<form><div id='content'>{PROSE_PART * 3}</div><select><option>a</option></select></form>")) == "\n".join([PLAIN_PART] * 3)
    assert html.extract(framed(f"<div class='nav-wrapper'><div>{PROSE_PART * 3}</div></div>")) == "\n".join([PLAIN_PART] * 3)
    # a form beside the text, and readers' comments of any length, still go
    assert html.extract(framed(f"<div>{PROSE_PART * 2}</div><form>{PROSE_PART}</form>")) == "\n".join([PLAIN_PART] * 2)
    assert html.extract(framed(f"<div>{PROSE_PART}</div><div class='comments'>{PROSE_PART * 9}</div>")) == PLAIN_PART


@pytest.mark.parametrize("part", ["div class='cookie-recipe'", "div class='ad-hoc-queries'", "div class='menu-list'", "section id='related'", "section id='navigation'", "div class='notice'", "div class='share'"])
def test_parts_of_an_article_with_doubtful_names(part):
    tag = part.split()[0]
    assert html.extract(framed(f"<article><h1>Title</h1>{PROSE_PART}<{part}>{PROSE_PART}</{tag}></article>")) == f"Title\n{PLAIN_PART}\n{PLAIN_PART}"
    # the same names with links, or with what is no sentence, go
    assert html.extract(framed(f"<article><h1>Title</h1>{PROSE_PART}<{part}><a href='/a'>One other text.</a> <a href='/b'>And yet another text to read here.</a></{tag}></article>")) == f"Title\n{PLAIN_PART}"


def test_sure_names_go_inside_articles_too():
    for name in ("ad", "ad-slot", "cookie-banner", "newsletter-box", "comments", "sponsored", "sidebar"):
        assert html.extract(framed(f"<article>{PROSE_PART}<div class='{name}'>{PROSE_PART}</div></article>")) == PLAIN_PART


def test_deep_pages_with_classes_take_memory_in_proportion():
    import tracemalloc

    used = []
    for depth in (5_000, 50_000):
        page = html.Page("<body>" + '<div class="a">' * depth + "deep text here.")
        tracemalloc.start()
        html.layout(page)
        used.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert used[1] < 20 * used[0] and used[1] < 50_000_000
    assert html.extract('<div class="a">' * 50_000 + "deep text here.") == "deep text here."
