import html
import re

from weft.llm.html import extract, host_of, main_text, site_templates
from weft.session import table

SF = "/root/testdata/sf0.01"


def test_whole_articles(spark):
    pages = table(spark, SF, "pages")
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for r in pages.collect():
        h = r["html"]
        inner = h[h.index("<article>") + 9 : h.index("</article>")]
        parts = re.split(r"</?(?:h1|p)>", inner)
        want = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        assert got[r["page_id"]] == "\n\n".join(x for x in want if x)


def test_chrome_goes():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav>menu</nav>
    <div id="cookieNotice">cookies</div><main><article><header><h1>Title</h1><span>by me</span></header><p>One <b>bo</b>ld&nbsp;&amp;<br>two
    <p>Three<script>var x = "<p>no</p>";</script></p><aside>aside</aside><div class="share-buttons">share</div><form>f<input></form><ul><li>a<li>b</ul>
    <table><tr><td>c1<td>c2</table></article></main><div class="comments">bad <p>words</p></div><footer>&copy;</footer></body>"""
    assert extract(page) == "Title\n\nOne bold & two\n\nThree\n\na\n\nb\n\nc1\n\nc2"


def test_odd_pages():
    assert extract(None) == extract("") == extract("<nav>x") == ""
    assert extract("just text &lt;3") == "just text <3"
    assert extract("a < b <p>c") == "a < b\n\nc"
    assert extract("<p>x<!-- y --> z<script>never closed") == "x z"
    assert extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert extract("<p title='a>b'>q</p><p title=\"x>q</p>") == "q\n\nq"
    assert host_of(None) == host_of("nohost") == "" and host_of("http://A.b/c") == "a.b"


def test_templates_recur_and_go(spark):
    page = lambda i: f"<body><div>Welcome to our site</div><div><p>Story {i} is its own.</p></div><div>All the same below</div></body>"
    rows = [(i, "http://big.example/%d" % i, page(i)) for i in range(40)] + [(100, "http://small.example/1", page(100)), (101, None, None), (102, "http://big.example/x", None)]
    rows += [(200 + i, "http://copy.example/", "<body><div>copied whole page</div></body>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert got[7] == "Story 7 is its own."
    assert "Welcome" in got[100] and got[101] == got[102] == ""
    assert got[200] == "copied whole page"
    joined = {r["page_id"]: r["text"] for r in main_text(df, broadcast_templates=0).collect()}
    assert joined == got
    assert site_templates(df.limit(0)).count() == main_text(df.limit(0)).count() == 0


def test_articles_keep_their_own():
    page = '<article><div class="legal analysis"><p>Legal text</p></div><p class="notice">n</p><section id="related-work"><p>Related work</p></section><p>Fine</p></article>'
    assert extract(page) == "Legal text\n\nn\n\nRelated work\n\nFine"
    assert extract("<article></article><p>Body text here</p>") == "Body text here"
    assert extract("<main><p>Main</p></main><article class=teaser><p>Other story</p></article>") == "Main"
    assert extract("<main><nav>x</nav></main><article><p>Story</p></article><p>rest</p>") == "Story"
    assert extract('<body><div class="notice">n</div><p>Fine</p></body>') == "Fine"
    assert extract('<article><p>A<div class="share-bar">s</div><div id="disqus_thread">d</div><p>B</article>') == "A\n\nB"


def test_broken_markup_is_linear():
    import time

    for bad in ("<a ", '<a b="', "<a b='", "<b>", "</i>", "<p><div><b>", "<li>", "<td><b>", '<a b=">" ', "<!", "<hr>", "&#"):
        page = "<p>start</p><i>" + "<b>" * 20000 + bad * ((1 << 20) // len(bad) // 4)
        began = time.process_time()
        extract(page + "</i>" * 20000, "h", frozenset([1]))
        assert time.process_time() - began < 8, bad
    began = time.process_time()
    extract("<a " * 350_000)
    assert time.process_time() - began < 2


def test_tags_that_do_not_close():
    assert extract("<p>a</p><p title='x>y'>b<p title=\"z>c</p>") == "a\n\nb\n\nc"
    assert extract("<p>a <b class='x'>b</b> <a href") == "a b"
    assert extract("a <3 b & c <! d> e <?pi x?> f") == "a <3 b & c e f"


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a.b/1", "<p>x</p>"), (1, "http://a.b/1", "<p>x</p>"), (None, None, None), (2, "nohost", "<article>" + "<p>long words here</p>" * 20000 + "</article>"), (3, "http://a.b/2", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("text", "host", "key", "keys", "page", "n", "pages", "hit", "n_chars")])
    for args in ({}, {"broadcast_templates": -1}):
        got = main_text(df, **args)
        assert got.columns == ["page_id", "url", "text"]
        found = sorted(((r["page_id"], r["text"]) for r in got.collect()), key=str)
        assert found == sorted([(1, "x"), (1, "x"), (None, ""), (2, "\n\n".join(["long words here"] * 20000)), (3, "")], key=str)


def test_templates_of_a_large_host(spark):
    """A block on 60 of 4,000 pages is a template; the same block on 4 of 60 pages isn't."""
    page = lambda i, extra: f"<body><div>Story {i} is its own.</div><section><p>{extra}</p></section></body>"
    rows = [(i, "http://big.example/%d" % i, page(i, "House rules" if i < 60 else f"Other {i}")) for i in range(4000)]
    rows += [(5000 + i, "http://small.example/%d" % i, page(5000 + i, "House rules" if i < 4 else f"Other {i}")) for i in range(60)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[7] == "Story 7 is its own." and "House rules" in got[5001] and got[100] == "Story 100 is its own.\n\nOther 100"


def test_keys_against_brute_force(spark):
    """Templates of random sites equal those counted by comparing whole subtrees as text."""
    import random

    r = random.Random(7)
    words = "alpha beta gamma delta".split()
    pages = {}
    for i in range(120):
        host = r.choice(("one.example", "two.example"))
        parts = [f"<{t} class={c}>{w}</{t}>" for t, c, w in ((r.choice(("div", "ul")), r.choice("xy"), r.choice(words)) for _ in range(3))]
        pages[i] = (host, parts + [f"<p>own {i}</p>"])
    df = spark.createDataFrame([(i, f"http://{h}/{i}", "<body>" + "".join(p) + "</body>") for i, (h, p) in pages.items()], "page_id bigint, url string, html string")
    got = {x["page_id"]: x["text"] for x in main_text(df, min_pages=10, min_share=0.18).collect()}
    count = {}
    for h, parts in pages.values():
        for part in set(parts):
            count[h, part] = count.get((h, part), 0) + 1
    size = {h: sum(x == h for x, _ in pages.values()) for h in ("one.example", "two.example")}
    for i, (h, parts) in pages.items():
        kept = [re.sub("<[^>]*>", "", p) for p in parts if not (count[h, p] >= 10 and count[h, p] >= 0.18 * size[h])]
        assert got[i] == "\n\n".join(kept)
    assert any(len(t.split("\n\n")) < 4 for t in got.values())
