"""Main text: whole templates with known text, broken markup, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from cyclestat.llm import htmltext

FURNITURE = [
    '<nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News about things</a></li></ul></nav>',
    "<header><p>The site of all sites, every day, for everyone</p></header>",
    '<div class="ad">Buy this now, it is very cheap and very good, and you need it today</div>',
    "<!-- a comment <p>not text</p> -->",
    "<aside><p>About the author, who writes a lot of text in many places</p></aside>",
    '<div id="cookie-notice"><p>We use cookies to make this page worse for you</p></div>',
    '<form action="/s"><label>Search</label><input name="q"><button>Go</button></form>',
    "<script>var t = '</p><p>not text';</script><style>p { margin: 0 }</style>",
    '<section class="comments"><div class="comment"><p>First! I agree with all of this.</p></div></section>',
    "<footer>&copy; someone, all rights reserved in all the lands</footer>",
]


def page(draw, i, mark="article"):
    blocks = [" ".join(f"word{draw.randrange(500)}" for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(1, 8))]
    tags = ["h1", *[draw.choice(["p", "p", "p", "h2", "blockquote"]) for _ in blocks[1:]]]
    body = "\n".join(f"<{t}>{b.replace(' ', draw.choice([' ', '  ', chr(10)]), 1)}</{t}>" for t, b in zip(tags, blocks))
    body = body.replace("word7 ", "<b>word7</b> ").replace("word9 ", "word9<br>").replace("word11", "R&amp;D &lt;11&gt;")
    inner = draw.choice(["", FURNITURE[2], FURNITURE[4]])
    before, after = draw.sample(FURNITURE[:8], 4), [FURNITURE[8], FURNITURE[9]]
    html = f"<!DOCTYPE html><html><head><title>Title {i}</title></head><body>{''.join(before)}<{mark}>{body}{inner}</{mark}>{''.join(after)}</body></html>"
    want = "\n\n".join(b.replace("word11", "R&D <11>") for b in blocks)
    return html, want


def test_known_pages(spark):
    draw = random.Random(6)
    pages = [page(draw, i) for i in range(120)]
    table = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = htmltext.extract(table, htmltext.fit(table), ["page_id", "url"]).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == pages[r.page_id][1]


def test_pages_without_marks_by_the_scan(spark):
    draw = random.Random(7)
    labelled = [page(draw, i) for i in range(60)]
    plain = [page(draw, i, "div") for i in range(40)]
    table = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(labelled)], "page_id long, html string")
    kinds = htmltext.Extractor(*htmltext.fit(table).value[1:])
    for html, want in plain:
        assert kinds.text(html) == want


def test_scan_takes_the_best_region():
    costs = {"li": (0, 0, 50), "a": (0, 0, 50), "p": (50, 0, 0)}
    kinds = htmltext.Extractor(costs, least=1_000)
    links = "<ul>" + "<li><a>one two</a></li>" * 9 + "</ul>"
    text = " ".join(f"w{i}" for i in range(30))
    assert kinds.text(f"<div>{links}<p>{text}</p><p>end</p>{links}</div>") == f"{text}\n\nend"


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("   ", ""), ("plain words only", "plain words only"), ("<", ""), ("</", ""), ("a < b", "a < b"),
        ("<p>one<p>two", "one\n\ntwo"), ("<p>cut off in a ta<b", "cut off in a ta"), ("<p>never <!-- closed", "never"), ("<p>x</b></div>y", "xy"),
        ('<p title="a>b">quoted</p>', "quoted"), ('<p title="open>text</p>', "text"), ("<script>var a = 1;", ""), ("<p>R&amp;D &#233; &eacute &am</p>", "R&D é é &am"),
        ("<P>Upper<BR>Case</P>", "Upper Case"), ("<p><b>a</b>b</p>", "ab"), ("<ul><li>x<li>y</ul>", "x\n\ny"), ("<p>" + "w " * 100_000 + "</p>", ("w " * 100_000).strip()),
    ],
)
def test_markup(html, want):
    assert htmltext.Extractor({"p": (9, 0, 0), "li": (9, 0, 0), "ul": (9, 0, 0), "b": (9, 0, 0), "br": (9, 0, 0), "div": (9, 0, 0)}, 5).text(html) == want


@pytest.mark.parametrize("name", ['class="page has-sidebar"', 'class="no-comments"', 'class="hidden-xs"', 'id="share-page"', 'class="layout right-sidebar"', 'class="widget"'])
@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_names_around_the_content(name, mark):
    html = f'<body><nav>menu</nav><div {name}><{mark}><p>one two three</p><div class="ad">buy</div><p>four five</p></{mark}></div></body>'
    kinds = htmltext.Extractor({"p": (9, 0, 0), "div": (9, 9, 0)}, 5)
    want = "one two three\n\nfour five"
    # Nothing but the name says what a bare div is: a page wholly within one is taken without names.
    whole = mark == "div" and name in ('class="layout right-sidebar"', 'class="widget"')
    assert kinds.text(html).startswith("one two three") if whole else kinds.text(html) == want
    if mark != "div":
        assert htmltext.tag_counts(html) is not None


def test_named_elements_beside_the_content():
    article = "<article><p>one two three</p></article>"
    kinds = htmltext.Extractor({"p": (9, 0, 0), "article": (0, 9, 0), "div": (9, 9, 0)}, 5)
    for name in ("related", "site-footer", "cookie-notice"):
        assert kinds.text(f'{article}<div class="{name}"><p>{"more words here " * 9}</p><article class="comment-body">x</article></div>') == "one two three"
    assert kinds.text(f'{article}<div class="related"><article><p>{"teaser " * 30}</p></article></div>') == "one two three"
    learned = htmltext.Extractor({"p": (9, 0, 0), "div.widget": (0, 9, 1)}, 5)
    assert learned.text('<div class="widget"><p>one two three</p></div><p>x</p>').startswith("one two three")


KINDS = {"p": (9, 0, 0), "article": (0, 9, 0), "li": (1, 0, 50), "a": (1, 0, 50), "ul": (1, 0, 50), "div": (9, 9, 3), "h1": (9, 0, 0)}


@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_a_page_within_a_form(mark):
    kinds = htmltext.Extractor(KINDS, 5)
    body = f'<nav>menu</nav><{mark}><p>one two three four</p><p>five six seven eight</p></{mark}>'
    controls = '<input name="__VIEWSTATE"><label>Search</label><button>Go</button>'
    want = "one two three four\n\nfive six seven eight"
    assert kinds.text(f'<body><form id="aspnetForm">{controls}{body}</form></body>') == want
    assert kinds.text(f'<body><form id="f">{controls}{body}</form><footer>all rights</footer><div><p>x</p></div></body>').startswith(want)
    # A form beside the content, or within it, is furniture.
    assert kinds.text(f"<body><form><p>Sign up here</p>{controls}</form>{body}</body>") == want
    assert kinds.text(f"<body>{body.replace('</p><p>', '</p><form><p>Sign up</p></form><p>')}</body>") == want


@pytest.mark.parametrize("tag", ['p class="market-share"', 'div class="story-notice"', 'section data-id="comments"', 'p data-role="menu"', 'p class="no-ads"'])
def test_names_that_say_something_else_drop_nothing(tag):
    kinds = htmltext.Extractor(KINDS, 5)
    html = f"<article><p>one two three</p><{tag}>four five six</{tag.split()[0]}><p>seven eight</p></article>"
    assert kinds.text(html) == "one two three\n\nfour five six\n\nseven eight"


@pytest.mark.parametrize("mark", ["article", "main"])
def test_an_article_is_taken_whole(mark):
    kinds = htmltext.Extractor({**KINDS, "span": (0, 0, 90)}, 5)
    text = " ".join(f"w{i}" for i in range(40))
    links = "<ul>" + "".join(f"<li><a>l{i}</a></li>" for i in range(30)) + "</ul>"
    blocks = "\n\n".join(f"l{i}" for i in range(30))
    menu = "<ul>" + "<li><a>menu</a></li>" * 9 + "</ul>"
    assert kinds.text(f"{menu}<{mark}><p>{text}</p>{links}</{mark}>{menu}") == f"{text}\n\n{blocks}"
    assert kinds.text(f"{menu}<{mark}><h1>title</h1><p>{text}</p>{links}<p>the tail</p></{mark}>{menu}") == f"title\n\n{text}\n\n{blocks}\n\nthe tail"
    # Of several, the one that holds the best stretch.
    assert kinds.text(f"<article><p>teaser one</p></article>{menu * 3}<article><p>{text}</p>{links}</article>") == f"{text}\n\n{blocks}"


def test_every_labelled_page_is_counted(spark):
    """A sidebar seen a hundred times is furniture however many pages there are."""
    plain = "<article><p>one two three</p></article>"
    rows = [(i, plain + ('<div class="box x9">here is more to read on this page today</div>' if i % 60 == 0 else "")) for i in range(6_000)]
    table = spark.createDataFrame(rows, "page_id long, html string").repartition(8)
    kinds = htmltext.Extractor(*htmltext.fit(table).value[1:])
    assert "div.box" in kinds.furniture


def test_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x</p>"), (2, "u", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    got = htmltext.extract(table, htmltext.fit(table), ["page_id", "url", "kind"]).collect()
    assert sorted((r.page_id or 0, r.text, r.kind) for r in got) == [(0, "x", "clash"), (1, "", "clash"), (1, "", "clash"), (2, "", "clash")]
    empty = table.limit(0)
    assert htmltext.extract(empty, htmltext.fit(empty), ["page_id"]).collect() == []
    with pytest.raises(ValueError):
        htmltext.extract(table, htmltext.fit(table), ["text"])
