import html
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from portrisk.llm import templates
from portrisk.llm.queries import QUERIES
from portrisk.llm.templates import Page


def brute(source):
    """Text of the article of the generated pages, which hold no other markup."""
    m = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    if not m:
        return ""
    blocks = re.split(r"</?(?:p|h1|br)>", m[1])
    return " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)


def test_query_equals_brute_force(spark):
    got = QUERIES["op4_templates"](spark, "/root/testdata/sf0.01").toPandas().sort_values("page_id")
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").sort_values("page_id")
    assert got.text.tolist() == [brute(h) for h in pages.html] and got.url.tolist() == pages.url.tolist()
    assert got.n_chars.tolist() == got.text.str.len().tolist()


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain &amp; simple\n text", "plain & simple text"),
    ("<article><p>one<p>two <b>bo<i>ld</b> x</article><p>out", "one two bold x"),
    ("<p>a<br>b&nbsp;c<!-- <p>no --><script>if (a<b) '</p>'</script>d", "a b cd"),
    ("<main><ul><li>x<li>y<ul><li>z</ul></ul></main>", "x y z"),
    ("<article><h1>T</h1><aside>side</aside><div class='share-bar'>no</div><p>yes</p>"
     "<section id=comments><p>me too</p></section></article>", "T yes"),
    ("<body class='has-sidebar'><header><h1>Site</h1></header><article><header><h1>Head</h1></header>t</article>", "Head t"),
    ("<div class=content><article>in</article></div><article class='comment'>reader</article>", "in"),
    ("<article>cut &am", "cut &am"), ("<article>cut <a href='x", "cut"), ("<article>1 < 2 &copy</article>", "1 < 2 ©"),
    ("<article><p>a<!-- open", "a"), ("<nav><article>kept</article></nav>", "kept"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ("</p></div><article></b>x</article></article>", "x"), ("<style>p{}", ""), ("<article><form>q</form>r", "r"),
])
def test_page(source, want):
    assert Page(source).text() == want


def site(host, i, body, extra=""):
    return (i, f"https://{host}/p{i}",
            f"<div><div><span>Portal</span> of all news</div></div><div>{body}</div><div>Contact us {extra}</div>", 0)


def test_recurring_subtrees_are_deleted_by_host(spark):
    rows = [site("a.example", i, f"<p>story {i}</p><p>shared passage {i % 2}</p>") for i in range(40)]
    rows += [site("b.example", 100 + i, f"<p>story {i}</p>", f"day {i}") for i in range(3)]
    rows += [site("C.example:80", 200 + i, "<p>the same copy</p>") for i in range(30)]
    rows += [(300 + i, "https://d.example/x", f"<div>Portal</div><article><p>own {i}</p><p>quoted passage</p>"
              f"<div>Follow our page</div></article>", 0) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, template int").repartition(4)
    got = {r["id"]: r["text"] for r in templates.main_texts(pages).collect()}
    assert all(got[i] == f"story {i}" for i in range(40))  # also the passages: no article marks them as prose
    assert got[100] == "Portal of all news story 0 Contact us day 0"  # three pages are not many
    assert got[200] == "Portal of all news the same copy Contact us"  # copies are one content
    assert all(got[300 + i] == f"own {i} quoted passage" for i in range(20))


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (None, None, "<p>x</p>", 1), (2, "no scheme", "<p>y</p>", 1), (2, "no scheme", "<p>y</p>", 1),
            (3, "http://U@H.example/q", "<article>" + "<p>long " * 50000, 1), (4, "http://h.example", "<b>" * 20000 + "deep", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, of int").repartition(3)
    got = sorted((str(r["id"]), r["text"][:8]) for r in templates.main_texts(pages).collect())
    assert got == [("1", ""), ("2", "y"), ("2", "y"), ("3", "long lon"), ("4", "deep"), ("None", "x")]
    assert templates.main_texts(pages.limit(0)).count() == 0


def texts(spark, bodies, host="h.example"):
    rows = [(i, f"https://{host}/p{i}", b) for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    return {r["id"]: r["text"] for r in templates.main_texts(pages).collect()}


def test_templates_inside_articles_are_deleted(spark):
    passage = "long passage that some articles quote " * 10
    quoted = lambda i: f"<p>{passage}</p>" if i % 5 == 0 else ""
    more = lambda i: "".join(f"<p>more {i} {k}</p>" for k in range(i % 3))
    got = texts(spark, [f"<article><h1>Title {i % 7}</h1><p>own {i}</p>{more(i)}{quoted(i)}<p>end {i}</p>"
                        f"<p>Sign up for our letter</p></article>" for i in range(60)])
    assert not any("Sign up" in t for t in got.values()) and all(f"Title {i % 7} own {i}" in got[i] for i in got)
    assert all((passage.strip() in got[i]) == (i % 5 == 0) for i in got)
    got = texts(spark, [f"<main><ul><li>Home<li>News</ul><p>own {i}</p><table><tr><td>Size<td>{i}</table></main>"
                        for i in range(40)])
    assert all(got[i] == f"own {i} Size {i}" for i in got)


def test_templates_of_a_large_host(spark):
    advert = lambda i: "<div>Buy our things</div>" if i % 12 == 0 else ""
    got = texts(spark, [f"<div>{advert(i)}<p>own {i}</p></div>" for i in range(300)])
    assert all(got[i] == f"own {i}" for i in got)  # on 25 of 300 pages
    got = texts(spark, [f"<article>{advert(i)}<p>own {i}</p></article>" for i in range(300)])
    assert all(got[i] == f"own {i}" for i in got)


def test_quoted_passage_without_article_survives(spark):
    passage = "words of a long passage " * 15
    quoted = lambda i: f"<h2>Sources</h2><p>{passage}</p>" if i % 10 == 0 else ""
    table = lambda i: f"<h1>Title</h1><table><tr><td>Size<td>{i // 4}</table>" if i % 3 == 0 else ""
    got = texts(spark, [f"<div>Portal</div><div><p>own {i}</p>{table(i)}{quoted(i)}</div>" for i in range(41)])
    assert all("Portal" not in t and f"own {i}" in t for i, t in got.items())
    assert all((f"Sources {passage.strip()}" in got[i]) == (i % 10 == 0) for i in got)  # on 5 of 41 pages
    assert all((f"Title Size {i // 4}" in got[i]) == (i % 3 == 0) for i in got)


@pytest.mark.parametrize("source, want", [
    ('<article><header class="entry-header"><h1>Title</h1></header><p>x</p></article>', "Title x"),
    ('<article><section id="social-history"><h2 id="search-trees">Trees</h2><p>x</p></section></article>', "Trees x"),
    ('<article><h2 id="comments">On comments</h2><div class="notice-of-meeting">On Monday</div></article>', "On comments On Monday"),
    ("<article><p>let <math><mi>a</mi><annotation>\\a</annotation></math> be</p><svg><path d='m'/><text>axis</text></svg></article>",
     "let a be axis"),
    ("<article><p>x</p></article><section id=comments><article><p>reader comment</p></article></section>", "x"),
    ("<div><p>story</p></div><section class=comments><article><p>reader comment</p></article></section>", "story"),
    ("<div>story</div><aside><article>teaser</article></aside>", "story"),
    ("<form><article>in a page-wide form</article></form>", "in a page-wide form"),
    ("<div class='main-menu'>menu</div><div class='siteHeader'>top</div><div id=sidebar>side</div><div>x</div>", "x"),
])
def test_marks(source, want):
    assert Page(source).text() == want


SF = "/root/testdata/sf0.1"


def sf_pages(spark, divs=False):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    if divs:
        pages = pages.withColumn("html", F.regexp_replace("html", "(</?)article(?=[ >])", "$1div"))
    return pages


@pytest.fixture(scope="module")
def truth():
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    host = pages.url.str.extract(r"//([^/:]+)")[0].str.lower()
    contents = pages.html.groupby(host).nunique()
    return {i: brute(h) for i, h in zip(pages.page_id, pages.html)}, set(pages.page_id[host.map(contents) >= 20])


def right(df, want, ids):
    return sum(r["text"] == want[r["id"]] for r in df.collect() if r["id"] in ids) / len(ids)


def test_recurrence_alone_finds_the_article(spark, truth):
    want, large = truth
    assert len(large) > 2000  # neither ``article`` nor a word of a tag or class tells the templates here
    assert right(templates.main_texts(sf_pages(spark, divs=True), words=False), want, large) >= 0.95
    assert right(templates.main_texts(sf_pages(spark, divs=True)), want, set(want)) >= 0.95
    shared = {r["id"]: r["text"] for r in templates.main_texts(sf_pages(spark)).filter("id = 263").collect()}
    again = {r["id"]: r["text"] for r in templates.main_texts(sf_pages(spark, divs=True)).filter("id = 263").collect()}
    assert shared == again == {263: want[263]}  # its last paragraph is on 26 of 308 contents


def test_without_removal_templates_stay(spark, truth, monkeypatch):
    want, large = truth
    assert right(templates.main_texts(sf_pages(spark)), want, set(want)) == 1
    for name in ("site_templates", "site_shapes"):
        found = getattr(templates, name)
        monkeypatch.setattr(templates, name, lambda *a, found=found, **k: found(*a, **k).limit(0))
    assert right(templates.main_texts(sf_pages(spark)), want, large) < 0.05


def test_counts_against_brute_force(spark):
    page = lambda i: (f"<body class='p{i}'><div class='nav x{i}'><ul><li><a href=/{i}>menu {i}</a></ul></div><div><h1>T{i}</h1>"  # noqa: E731
                      f"<p>{'story ' * (30 + i)}</p>" + ("<section>See also</section>" if i % 4 == 0 else "")
                      + "</div><div class=foot>End " + "x" * i + "</div></body>")
    rows = [(i, "http://a.example/", page(i % 30)) for i in range(45)]  # 15 copies
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    contents = templates.contents_of(templates.subtrees(pages))
    sizes = contents.groupBy("host").agg(F.count(F.lit(1)).alias("contents"))
    assert [tuple(r) for r in sizes.collect()] == [("a.example", 30)]
    counts, shapes = {}, {}
    for i in range(30):
        p = Page(page(i), way=templates.TO_COUNT)
        for h, place, _ in p.places():
            counts[h, place] = counts.get((h, place), 0) + 1
        for h, (chars, links, about) in p.shapes.items():
            shapes.setdefault(h, []).append((chars / p.chars, chars, links, about))
    want = set()
    for (h, place), n in counts.items():
        placed = max([m for (g, q), m in counts.items() if g == h and q] or [0])
        limit = {0: min(3.0, 20), 1: 15, 2: 32, 3: 15}[h & 3]
        if place == 0 and n >= 4 and (n if h & 3 == 0 else placed) >= limit and (h & 3 == 0 or placed >= n / 2):
            want.add(h)
    assert {r["hash"] for r in templates.site_templates(contents, sizes).collect()} == want and len(want) == 1  # See also
    want = set()
    for h, seen in shapes.items():
        about = 0
        for s in seen:
            about |= s[3]
        linked = sum(s[2] for s in seen) / sum(s[1] for s in seen)
        small = len(seen) >= 15 and sum(s[0] for s in seen) / len(seen) < 0.15 and (not about & 6 or linked >= 0.5)
        if about & 1 and len(seen) >= 2 or small:
            want.add(h)
    assert {r["hash"] for r in templates.site_shapes(contents, sizes).collect()} == want
    got = {r["id"]: r["text"] for r in templates.main_texts(pages).collect()}
    assert all(got[i] == f"T{i % 30} " + " ".join(["story"] * (30 + i % 30)) for i in got)


def test_shapes_leave_prose_headings_and_the_main_block(spark):
    got = texts(spark, [f"<div class=top>Site {i}</div><div class=row><div class=lead><h2>Head {i}</h2></div><div class=body><p>own {i} "
                        f"{'word ' * 40}</p><blockquote>said {i}</blockquote></div></div><div class=box><h3>More</h3><ul><li>"
                        f"<a href=a>other story {i}</a><li><a href=b>one more {i + 1}</a></ul></div>" for i in range(25)])
    assert all(got[i] == f"Head {i} own {i} " + "word " * 40 + f"said {i}" for i in got)
    got = texts(spark, [f"<div>Site {i}</div><p>own {i}</p>" for i in range(19)])  # too small to count
    assert all(got[i] == f"Site {i} own {i}" for i in got)
