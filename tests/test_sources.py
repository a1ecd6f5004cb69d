"""Readers of landed payloads, configuration and ledger cases on hand-made input."""

import json

import pytest
from pyspark.sql import functions as F

from broadsheet import fixed_values as fv
from broadsheet.functions import textops
from broadsheet.operators import ledger
from broadsheet.sources import bookmarks, config, feeds, forecast, mail, registry, trending, web  # noqa: F401

SOURCE = "source_pos int, type string, src string, priority int, title string, full_text string, `delete` string, goal string, model string, metadata map<string,string>"


def _sources(spark, *rows):
    names = ["source_pos", "type", "src", "priority", "title", "full_text", "delete", "goal", "model", "metadata"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SOURCE)


def _payloads(spark, *payloads):
    return spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(payloads)], "source_pos int, payload string")


def _write(tmp_path, document):
    path = tmp_path / "config.json"
    path.write_text(document if isinstance(document, str) else json.dumps(document))
    return str(path)


def test_config_defaults_and_validation(spark, tmp_path):
    body = [{"type": "rss", "src": "https://e.org/feed"}, {"type": "nope", "src": "x"}, {"type": "web", "src": ""}, {"type": "trending", "src": "t", "priority": 3}]
    path = _write(tmp_path, {"title": {"text": "T"}, "body": body, "limit": 4})
    ok, bad = config.validate(config.read_config(spark, path), registry.types())
    rows = {r.source_pos: r for r in ok.collect()}
    assert set(rows) == {0, 3} and (rows[0].priority, rows[0].keep_link, rows[0].full_text) == (0, "Y", "N") and rows[3].goal
    assert {r.source_pos: r.reason for r in bad.collect()} == {1: "Invalid type: nope", 2: "src is required"}
    assert config.read_limit(spark, path) == 4 and config.read_title(spark, path).first().text == "T"


@pytest.mark.parametrize("document", ["not json", {"body": []}, {"title": {"text": "x"}}, {"title": {"text": "x"}, "body": {}}])
def test_unusable_config(spark, tmp_path, document):
    with pytest.raises(config.ConfigError):
        config.read_config(spark, _write(tmp_path, document)).collect()


def test_feed(spark):
    items = "".join(f"<item><title>t{k}</title><link>https://e.org/{k}</link><description>d{k}</description></item>" for k in range(80))
    good = f'<?xml version="1.0"?><rss><channel><title>Feed</title>{items}</channel></rss>'
    payloads = spark.createDataFrame([(0, good), (1, good), (2, "<rss"), (3, "<rss><channel><title>x</title></channel></rss>")], "source_pos int, payload string")
    sources = _sources(spark, *[{"source_pos": k, "type": "rss", "src": "s", "metadata": {"limit": "3"} if k == 1 else None} for k in range(4)])
    rows, runs = feeds.parse_feed(payloads, sources)
    counts = {r.source_pos: r["count"] for r in rows.groupBy("source_pos").count().collect()}
    assert counts == {0: 15, 1: 3}
    done = {r.source_pos: r for r in runs.collect()}
    assert done[0].success and done[0].source_title == "Feed" and not done[2].success and done[3].error.endswith("No entries found")


def test_mail(spark):
    one = {"result": "success", "emails": [{"subject": None, "from": "a@b.c", "text": "hi", "timestamp": "1704067200000"}]}
    rows, runs = mail.parse(_payloads(spark, one, {"result": "fail", "message": "bad key"}))
    r = rows.first()
    assert (r.title, r.url, r.published_date) == ("No Subject", "mailto:a@b.c", "2024-01-01 08:00") and "hi" in r.content
    assert {x.source_pos: x.error for x in runs.collect()} == {0: None, 1: "API error: bad key"}
    assert mail.query_terms("ns.tag", {"limit": "500", "tag_prefix": "p"}) == {"namespace": "ns", "tag": "tag", "tag_prefix": "p", "limit": 100, "offset": 0}


def test_bookmarks(spark):
    page = "<html><body><article><p>" + "Whole text of the page. " * 20 + "</p></article></body></html>"
    pages = spark.createDataFrame([("https://e.org/1", page)], "url string, html string")
    items = [{"title": "a", "link": "https://e.org/1", "excerpt": "ex", "cover": "c.png"}, {"title": "b", "link": "https://e.org/2", "excerpt": "ey", "cover": ""}]
    sources = _sources(spark, {"source_pos": 0, "type": "raindropio", "src": "s", "full_text": "Y"}, {"source_pos": 1, "type": "raindropio", "src": "s", "full_text": "N"})
    rows, runs = bookmarks.parse(_payloads(spark, {"result": True, "items": items}, {"result": False, "message": "m"}), pages, sources)
    got = {r.item_pos: r for r in rows.collect()}
    assert "Whole text" in got[0].content and got[0].images == ["c.png"] and (got[1].content, got[1].images) == ("<p>ey</p>", [])
    assert {r.source_pos: r.error for r in runs.collect()} == {0: None, 1: "Raindropio API error: m"}


def test_forecast(spark):
    day = lambda d: {"fxDate": d, "tempMax": "9", "tempMin": "1", "textDay": "sun", "textNight": "cloud"}
    geo = {"code": "200", "location": [{"id": "7", "name": "City"}]}
    cases = [
        (geo, ["d1", "d2"], None), (geo, ["d1"], None), (geo, ["d1"], "tomorrow"), (geo, ["d1", "d2"], "2"), (geo, ["d1"], "2030-01-01"),
        ({"code": "200", "location": []}, ["d1"], None), ({"code": "404"}, ["d1"], None), (geo, [], None), (geo, ["d1", "d2"], "d1"),
    ]
    payloads = spark.createDataFrame(
        [(k, json.dumps(g), json.dumps({"code": "200", "daily": [day(d) for d in days]})) for k, (g, days, _) in enumerate(cases)], "source_pos int, geo string, daily string"
    )
    sources = _sources(spark, *[{"source_pos": k, "type": "weather", "src": "Town", "metadata": {"date": w} if w else None} for k, (_, _, w) in enumerate(cases)])
    rows, runs = forecast.parse(payloads, sources)
    assert {r.source_pos: r.published_date for r in rows.collect()} == {0: "d2", 8: "d1"}
    errors = {r.source_pos: r.error for r in runs.collect()}
    assert errors[1].startswith("Insufficient forecast data") and errors[2] == "Tomorrow's forecast is not available."
    assert errors[3] == "Day after tomorrow's forecast is not available." and errors[4] == "Could not find forecast for date or index '2030-01-01'."
    assert errors[5] == "Could not resolve city 'Town' via GeoAPI." and errors[6].startswith("Error from API (geo lookup): 404") and errors[7] == "No forecast data available."


def test_trending(spark):
    sources = _sources(spark, {"source_pos": 0, "type": "trending", "src": "topic", "goal": "g"}, {"source_pos": 1, "type": "trending", "src": "other"})
    results = spark.createDataFrame([(0, k, f"t{k}", f"c{k}") for k in range(5)], "source_pos int, rank int, title string, content string")
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    prompts = {r.source_pos: r.prompt for r in trending.build_prompts(sources, results, as_of).collect()}
    assert "[3] t2: c2" in prompts[0] and "t3" not in prompts[0] and "[1]" not in prompts[1]
    done = _payloads(spark, {"choices": [{"message": {"content": "```markdown\nOne\n\nTwo\n```"}}]}, {"choices": []})
    rows, runs = trending.parse(done, sources, as_of)
    assert [(r.source_pos, r.content, r.url) for r in rows.collect()] == [(0, "<p>One</p><p>Two</p>", "topic")]
    assert [r.success for r in runs.orderBy("source_pos").collect()] == [True, False]


def test_registry():
    assert {"rss", "web", "mail", "trending", "weather", "raindropio"} <= set(registry.types())
    with pytest.raises(ValueError):
        registry.get("nope")


def test_ledger_cap_and_runs(spark, tmp_path):
    rows = [(f"old_{k}", 0, k) for k in range(5)] + [(f"new_{k}", 1, k) for k in range(3)]
    df = spark.createDataFrame(rows, ledger.SCHEMA)
    kept = [r.content_id for r in ledger.compact(df, 5).orderBy("run_id", "ord").collect()]
    assert kept == ["old_3", "old_4", "new_0", "new_1", "new_2"]
    assert ledger.compact(df, 8).count() == 8 and ledger.compact(df, 3, width=2).count() == 3
    path = str(tmp_path / "ledger")
    for run, (ids, total) in enumerate([(["a", "b"], 2), (["c"], 3), ([], 3)]):
        ledger.append(spark, spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "content_id string, ord long"), path, run)
        assert ledger.stats(ledger.read(spark, path), run).first() == (total, len(ids))
    (tmp_path / "ids.txt").write_text(" aaa \n\nbbb\n")
    assert [r.content_id for r in ledger.read_text(spark, str(tmp_path / "ids.txt")).collect()] == ["aaa", "bbb"]


def test_damaged_feeds_give_their_complete_entries(spark):
    item = lambda k, text: f"<item><title>t{k}</title><link>https://e.org/{k}?a=1&amp;b=2</link><description>{text}</description></item>"
    whole = "<rss><channel><title>News &amp; more</title>" + item(0, "zero") + item(1, "AT&T &nbsp; x") + item(2, "<![CDATA[a < b & c]]>")
    payloads = spark.createDataFrame([(0, whole + "<item><title>cut"), (1, whole + "</channel></rss>"), (2, "<rss><channel><title>x</title><item>"), (3, "no feed")], "source_pos int, payload string")
    rows, runs = feeds.parse_feed(payloads, _sources(spark, *[{"source_pos": k, "type": "rss", "src": "s"} for k in range(4)]))
    got = {(r.source_pos, r.item_pos): (r.title, r.url, r.content) for r in rows.collect()}
    assert got == {(s, k): (f"t{k}", f"https://e.org/{k}?a=1&b=2", c) for s in (0, 1) for k, c in enumerate(["zero", "AT&T &nbsp; x", "a < b & c"])}
    done = {r.source_pos: (r.success, r.source_title) for r in runs.collect()}
    assert done == {0: (True, "News & more"), 1: (True, "News & more"), 2: (False, None), 3: (False, None)}


def test_mail_options_apply_in_a_run(spark):
    mails = [{"subject": str(k), "from": "a@b.c", "text": "x", "timestamp": str(k * 1000) if k else None, "tag": "ab"[k % 2]} for k in range(6)]
    box = {"result": "success", "emails": mails}
    landed = _payloads(spark, box, box, box, box)
    sources = spark.createDataFrame(
        [(0, "n.a", None, None), (1, "n", None, {"tag": "b", "limit": "2", "offset": "1"}), (2, "n", None, {"timestamp_from": "2000", "timestamp_to": "4000"}), (3, "n", "3, 5", {"tag_prefix": ""})],
        "source_pos int, src string, delete string, metadata map<string,string>",
    )
    ctx = registry.Context(sources, {"mail": landed}.get, 15, None)
    rows, _ = registry.get("mail")(ctx)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.source_pos, r.item_pos)):
        got.setdefault(r.source_pos, []).append(r.title)
    assert got == {0: ["4", "2", "0"], 1: ["3", "1"], 2: ["4", "3", "2"], 3: ["4", "2", "1", "0"]}


def test_completions_are_read_once(spark):
    """The filter on a completion's text does not read its payload again; rows and failed runs stay."""
    sources = _sources(spark, *({"source_pos": k, "type": "trending", "src": f"topic {k}"} for k in range(4)))
    done = _payloads(spark, {"choices": [{"message": {"content": "　One\n \nTwo "}}]}, {"choices": []}, {"choices": [{"message": {"content": ""}}]}, {})
    hits = spark.createDataFrame([(0,), (0,), (None,)], "source_pos int")
    rows, runs = trending.parse(done, sources, F.lit("2024-01-02 00:00:00").cast("timestamp"), hits)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert [(r.source_pos, r.content, r.metadata["has_search_context"]) for r in rows.collect()] == [(0, "<p>One</p><p>Two</p>", "true")]
    assert [(r.source_pos, r.success) for r in runs.orderBy("source_pos").collect()] == [(0, True), (1, False), (2, False), (3, False)]


def test_strip_takes_all_white_space(spark):
    space = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
    assert set(fv.SPACE_CHARS) == set(space)
    texts = [None, "", space, f"{space}a{space}b ​{space}", "﻿ a", "é\n", " \U0001f600 "]
    pattern = F.regexp_replace("t", rf"^{textops.SPACE}+|{textops.SPACE}+\z", "")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k")
    assert [r.s for r in df.select(pattern.alias("s")).collect()] == [t if t is None else t.strip() for t in texts]
    got = df.select(textops.strip(F.col("t")).alias("s"))
    assert [r.s for r in got.collect()] == [t if t is None else t.strip() for t in texts]
    # only the ends are looked at, not every place
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
