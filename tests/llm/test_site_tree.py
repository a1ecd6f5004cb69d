"""Page extraction on the given pages and on hand-made sites."""

import html
import re

from broadsheet.llm import site_tree
from tests.oracle import DATA


def _want(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    pages = {r.page_id: r for r in df.collect()}
    for r in site_tree.digest(df).collect():
        assert r.text == _want(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def _page(k, extra=""):
    return (
        f"<html><head><title>t{k}</title><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>"
        f"<div id=main><h2>Story {k}</h2><p>First {k} &amp; more<p>Second&nbsp;{k}\n text<div class=box>Always the same words here</div>{extra}"
        f"<ul class=comments><li>nice {k}</li></ul><form>Your name</form></div><aside>x</aside><footer>&copy; me</footer></body></html>"
    )


def test_noise_of_a_site_and_odd_rows(spark):
    rows = [(k, f"http://Site.example/{k}", _page(k), "x") for k in range(30)]
    rows += [(100, None, None, "x"), (101, "u", "", None), (102, "http://b/", "plain &lt;text&gt; &am", "x"), (102, "http://b/", "plain &lt;text&gt; &am", "x")]
    rows += [(103, "http://c/", "<article><p>One<p>Two <b>bold</article><p>after", "x"), (104, "http://c/", "<!-- <p>x</p> <p>y", "x"), (105, "http://c/", "<p>" + "w " * 300000, "x")]
    out = {r.page_id: r.text for r in site_tree.digest(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()}
    for k in range(30):
        assert out[k] == f"Story {k}\n\nFirst {k} & more\n\nSecond {k} text"
    assert out[100] == out[101] == out[104] == ""
    assert out[102] == "plain <text> &am" and out[103] == "One\n\nTwo bold" and len(out[105]) == 599999


def test_empty(spark):
    assert site_tree.digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _texts(spark, rows):
    out = site_tree.digest(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return {r.page_id: r.text for r in out}


def test_repeats_inside_one_page_and_copies_of_a_page_are_no_noise(spark):
    cells = "<tr>" + '<td class="ok">Yes</td>' * 5 + "</tr>"
    one = f"<body><h2>Table</h2><article><h1>Answers</h1><table>{cells}</table></article></body>"
    verse = "<body><h1>Song</h1>" + "<p class=v>Row, row</p>" * 6 + "</body>"
    copy = "<body><h1>One story</h1><h2>Part</h2>" + "".join(f"<p>Paragraph {k}</p>" for k in range(8)) + "</body>"
    rows = [(1, "http://one/", one), (2, "http://verse/", verse)]
    rows += [(k, f"http://copies/a?utm_source={k}", copy) for k in range(100, 400)]
    rows += [(k, f"http://copies/{k}", copy.replace("story", f"story {k}").replace("Paragraph", f"Other {k}")) for k in range(400, 403)]
    out = _texts(spark, rows)
    assert out[1] == "\n\n".join(["Answers"] + ["Yes"] * 5)
    assert out[2] == "\n\n".join(["Song"] + ["Row, row"] * 6)
    for k in range(100, 400):
        assert out[k] == "\n\n".join(["One story", "Part"] + [f"Paragraph {n}" for n in range(8)])
    for k in range(400, 403):
        assert out[k] == "\n\n".join([f"One story {k}", "Part"] + [f"Other {k} {n}" for n in range(8)])


def test_only_shared_texts_of_a_noise_node_go(spark):
    rows = [
        (k, f"http://lists/{k}", f"<h1>Title {k}</h1><div class=box>" + "".join(f"<p>Link {n}</p>" for n in range(19)) + f"<p>Own line {k}</p></div>")
        for k in range(20)
    ]
    out = _texts(spark, rows)
    assert all(out[k] == f"Title {k}\n\nOwn line {k}" for k in range(20))


def test_names_cut_no_branch(spark):
    rows = [(k, f"http://{name}/", f'<body><div class="site {name}"><article><h1>T</h1><p>Text</p></article></div></body>') for k, name in enumerate(("has-sidebar", "no-sidebar", "sidebar"))]
    inside = (
        '<article><header class="entry-header"><h1>Head {k}</h1></header><p>Text {k}</p><h2 id="search">Search</h2><p>How {k}</p>'
        '<section id="related-work"><h2>Related work</h2><p>Others {k}</p></section><div class="comments"><p>Nice {k}</p></div></article>'
    )
    rows += [(100 + k, f"http://papers/{k}", inside.replace("{k}", str(k))) for k in range(8)]
    ads = '<body><h1>Day {k}</h1><p>News {k}</p><div class="sidebar"><ul><li>Home</li><li>Shop</li><li>About</li></ul></div><h2 id="search">Search of {k}</h2></body>'
    rows += [(200 + k, f"http://plain/{k}", ads.replace("{k}", str(k))) for k in range(8)]
    rows += [(300, "http://single/", ads), (301, "http://wp/", '<p>A</p><ol class="comment-list"><li>B</li></ol><div id="disqus_thread">C</div><p class="comment">D</p>')]
    out = _texts(spark, rows)
    assert out[0] == out[1] == out[2] == "T\n\nText"
    for k in range(8):
        assert out[100 + k] == "\n\n".join([f"Head {k}", f"Text {k}", "Search", f"How {k}", "Related work", f"Others {k}"])
        assert out[200 + k] == "\n\n".join([f"Day {k}", f"News {k}", f"Search of {k}"])
    assert out[300] == "\n\n".join(["Day {k}", "News {k}", "Home", "Shop", "About", "Search of {k}"])
    assert out[301] == "A\n\nD"
