import html as entities
import re
import time

from factloom.llm import htmlmain


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in htmlmain.main_texts(pages, per_block=4).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for p in rows:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page"><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><main><article class='post'><h2>Head &amp; tail</h2><p>One <b>bold</b>
 line<br>broken&nbsp;here<p>Two &lt;tags&gt; &#233;<ul><li>first<li>second</ul><form><p>Name</p></form><script>var t = "</p>";</script><aside>Side</aside></article>
<section id="comments"><p>Great post!</p></section></main><div class="ad">Buy</div><footer>&copy; me</footer></body>"""


def test_structure():
    want = "Head & tail\nOne bold line broken here\nTwo <tags> é\nfirst\nsecond"
    assert htmlmain.texts_of([PAGE]) == [want]
    assert htmlmain.texts_of([PAGE] * 5) == [want] * 5


def test_without_article_what_is_marked_goes():
    page = '<body><div id="menu">M</div><div class="content"><p>Text one</p><p>Text two</p></div><div class="sidebar">S</div></body>'
    assert htmlmain.texts_of([page, page.replace("one", "uno")]) == ["Text one\nText two", "Text uno\nText two"]


def test_classes_share_vectors():
    paths = htmlmain.Paths()
    pages = [htmlmain.read(p, paths) for p in ("<body><article><p>a</p><p>b</p></article></body>", "<body><article><p>c</p></article></body>")]
    body, article, p = paths.node("body"), paths.node("body", "article"), paths.node("body", "article", "p")
    assert htmlmain.classes_of(pages)[(0, 2), (1, 1)] == [p]
    t = htmlmain.deduce(pages, paths)
    assert t.spine == [body, article]
    assert t.nested == {p: 1}


def test_slots_decide_without_article_or_telling_names():
    """The container that holds what varies is the main slot; a short varying note, a list of links and a varying footer beside it go."""
    page = "<body><div class=q1><p>{0}</p></div><div class=q2><h1>Title {1}</h1></div><div class=q3><p>{2}</p><p>{3}</p></div><div class=q4><ul><li><a href=/{1}>Read story {1} too</a></ul></div><div class=q5>Seen {1} times</div></body>"
    say = lambda i, k: f"Story {i} part {k} is told here at some length, as a story is, with more than a few words in it."
    pages = [page.format(f"Offer {i}", i, say(i, 1), say(i, 2)) for i in range(5)]
    assert htmlmain.texts_of(pages) == [f"Title {i}\n{say(i, 1)}\n{say(i, 2)}" for i in range(5)]
    assert htmlmain.texts_of(pages[:1]) == [f"Offer 0\nTitle 0\n{say(0, 1)}\n{say(0, 2)}\nRead story 0 too\nSeen 0 times"]  # one page deduces nothing


def test_deep_and_broken_pages_take_linear_time():
    took = []
    for n in (25_000, 100_000):
        began = time.process_time()
        for page in ("<div>" * n + "deep", "<b>" * n + "<hr>" * n + "x", "<a " * n, "<![CDATA[" * n, "<!" * n, "<div class=ad>" * n + "y", "<i>" * n + "</b>" * n + "z"):
            assert len(htmlmain.texts_of([page])) == 1
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.5)


def test_broken_markup_ends():
    for page in (None, "", "<", "<p", "<!--", "<script>x", "text", "</p></div>", "<p>" * 3000, "<div class='a>b'>x</div>"):
        assert isinstance(htmlmain.texts_of([page])[0], str)
    assert htmlmain.texts_of(["just text"]) == ["just text"]


def test_odd_rows(spark):
    rows = [(1, "http://a.b/x", PAGE), (1, "http://a.b/x", PAGE), (2, None, None), (3, "", ""), (None, "nonsense", "<p>x</p>"), (4, "http://user@A.b:80/y", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS host", "1 AS n", "2 AS block", "'t' AS text")
    got = htmlmain.main_texts(df).collect()
    assert len(got) == 6
    assert {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert htmlmain.main_texts(df.limit(0)).count() == 0


def test_hot_host_is_split(spark):
    df = spark.range(300).selectExpr("id AS page_id", "'http://hot.example/' AS url", "concat('<body><article><p>text ', id, '</p></article></body>') AS html")
    got = {r.page_id: r.text for r in htmlmain.main_texts(df, per_block=20).collect()}
    assert got == {i: f"text {i}" for i in range(300)}


def test_text_on_every_page_is_the_template():
    page = "<body><div class=x1><p>Follow us everywhere</p></div><div class=x2><p>Story {0} begins.</p><p>{1}</p></div><div class=x3>All rights reserved</div></body>"
    own = ["It ends well.", "It rains.", "It ends well.", "Nobody knows."]
    pages = [page.format(i, x) for i, x in enumerate(own)]
    assert htmlmain.texts_of(pages) == [f"Story {i} begins.\n{x}" for i, x in enumerate(own)]
    odd = "<body><div class=x2><p>Story 9 begins.</p></div></body>"  # a page without the boilerplate does not bring it back
    assert htmlmain.texts_of([*pages, odd, None, ""]) == [*(f"Story {i} begins.\n{x}" for i, x in enumerate(own)), "Story 9 begins.", "", ""]
    assert htmlmain.texts_of([pages[0]] * 5) == [f"Follow us everywhere\nStory 0 begins.\n{own[0]}\nAll rights reserved"] * 5  # copies tell nothing


def test_boilerplate_in_an_article_goes_and_copied_articles_stay():
    page = "<body><nav>{0}</nav><article><p>Story {1} is a long one and is told here.</p><p>Share this!</p></article></body>"
    assert htmlmain.texts_of([page.format(i, i) for i in range(4)]) == [f"Story {i} is a long one and is told here." for i in range(4)]
    assert htmlmain.texts_of([page.format(i, 7) for i in range(4)]) == ["Story 7 is a long one and is told here.\nShare this!"] * 4


def test_wrapper_with_a_listed_word_stays():
    page = '<body><div class="page with-sidebar"><div class="content"><p>Story {0} is a long one and is told here in full.</p></div><div class="sidebar"><p>{0}</p></div></div></body>'
    assert htmlmain.texts_of([page.format(i) for i in range(4)]) == [f"Story {i} is a long one and is told here in full." for i in range(4)]
    inner = page.replace('<div class="content">', "<article>").replace('</div><div class="sidebar">', '</article><div class="sidebar">')
    assert htmlmain.texts_of([inner.format(i) for i in range(4)]) == [f"Story {i} is a long one and is told here in full." for i in range(4)]


def test_equal_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(htmlmain, "TWINS", 50)
    df = spark.range(400).selectExpr("1 AS page_id", "'http://hot.example/' AS url", "'<body><article><p>same text</p></article></body>' AS html").repartition(8)
    seen = htmlmain.main_texts(df, per_block=20)
    assert [(r.text, r["count"]) for r in seen.groupBy("text").count().collect()] == [("same text", 400)]


def test_texts_do_not_depend_on_how_rows_lay(spark, monkeypatch):
    monkeypatch.setattr(htmlmain, "TWINS", 20)
    page = lambda k: f"<html><body><div class=m>menu</div><div class=c><p>words {k} of the text {k * 7}</p><p>more {k}</p></div></body></html>"
    rows = [(1, "http://a.b/x", page(0))] * 70 + [(1, "http://a.b/x", page(k)) for k in range(1, 30)] + [(k, f"http://a.b/{k}", page(100 + k)) for k in range(2, 40)]
    seen = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        seen.append(sorted(map(tuple, htmlmain.main_texts(df, per_block=8).collect())))
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
    assert len({r for r in seen[0] if r[0] == 1}) == 30
