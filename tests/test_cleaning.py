"""Properties of the whole cleaning: stable on its own result, sound on odd bodies, right on very long ones."""

import re

from pyspark.sql import functions as F

from broadsheet.functions import clean
from broadsheet.operators import audit
from broadsheet.plans import tree_queries as tq
from tests.oracle import DATA

BODY = "id int, html string, url string"


def _cleaned(df):
    return clean.clean_bodies(df, "html", "url", None, None, None, "body")


def test_cleaning_twice_changes_nothing(spark):
    """Tables apart: a table kept inside a layout table loses its rows there, and is itself layout from then on."""
    markup = tq.LINKS + tq.ICONS + tq.TAGS + tq.BLOCKS + tq.GONE + tq.EMOJI + tq.NESTS
    once = _cleaned(tq.injected(spark, f"{DATA}/sf0.001", markup).select("page_id", "url", "html")).select("page_id", "url", F.col("body").alias("html")).cache()
    twice = _cleaned(once)
    rows = twice.select("html", "body").collect()
    assert len(rows) == 50 and [r.body for r in rows] == [r.html for r in rows]


def test_odd_bodies(spark):
    rows = [(0, None), (1, ""), (2, "plain < text & more"), (3, "<"), (4, "</p></div>"), (5, "<p>" * 200 + "x"), (6, "<table><tr><td>a</td><td>b</td></tr>"), (7, "<!-- only -->"), (8, "<a href='x")]
    df = spark.createDataFrame([(k, h, "https://e.org/d/p.html") for k, h in rows], BODY)
    got = {r.id: r.body for r in _cleaned(df).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "plain < text & more" and got[4] == "" and got[6].endswith("</td></tr></table>")
    assert got[5] == "<p></p>" * 199 + "<p>x</p>"
    counts = {r.rule: r.n for r in audit.violations(_cleaned(df).filter("id IN (2, 4, 5, 6)"), "body").collect()}
    assert counts.pop("empty_body") == 1 and not any(counts.values())


def test_long_page(spark):
    """A page of half a megabyte, built of one fragment many times over, gives the fragment's result as often."""
    fragment = tq.TABLES.replace("{id}", "1").replace("{m}", "2") + '<p>a <b>b</b> <font size="2">c</font> <div>d</div></p><a href="/x"><img src="/i.png" width="9"></a>'
    n = 500_000 // len(fragment) + 1
    df = spark.createDataFrame([(1, fragment, "https://e.org/"), (2, fragment * n, "https://e.org/")], BODY)
    got = {r.id: r.body for r in _cleaned(df).collect()}
    assert got[2] == got[1] * n and not re.search("<font|width=", got[1])
