"""Cases that once went wrong: re-runs, empty batches, repeated pages, long tags, large sizes."""

from pyspark.sql import functions as F

from broadsheet.functions import markup, tree
from broadsheet.operators import ledger
from broadsheet.sources import feeds, sinks
from broadsheet.streaming import ingest


def test_empty_rerun_replaces_edition(spark, tmp_path):
    row = spark.createDataFrame([(1, "e")], "source_pos int, line string")
    sinks.write_edition({"error_log": row}, str(tmp_path), "2024-01-02")
    sinks.write_edition({"error_log": row}, str(tmp_path), "2024-01-03")
    sinks.write_edition({"error_log": row.limit(0)}, str(tmp_path), "2024-01-02")
    left = spark.read.schema("source_pos int, line string, edition_date date").parquet(f"{tmp_path}/error_log").collect()
    assert [str(r.edition_date) for r in left] == ["2024-01-03"]


def test_empty_rerun_replaces_ledger_run(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ids = spark.createDataFrame([("a", 1)], "content_id string, ord long")
    ledger.append(spark, ids, path, 1)
    ledger.append(spark, ids, path, 2)
    ledger.append(spark, ids.limit(0), path, 1)
    assert [(r.content_id, r.run_id) for r in ledger.read(spark, path).collect()] == [("a", 2)]


def test_stream_whose_first_batch_is_known(spark, tmp_path):
    schema = "source_pos int, item_pos int, title string, content string, url string, author string, published_date string"
    rows = spark.createDataFrame([(0, 0, "t", "c", "https://e.org/1", "", None), (0, 1, "t2", "c", "https://e.org/2", "", None)], schema)
    first, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    rows.filter("item_pos = 0").write.parquet(first)
    known = ledger.with_ids(rows.filter("item_pos = 0")).select("content_id", F.lit(0).cast("long").alias("ord"))
    ledger.append(spark, known, path, 900)
    for n in (0, 1):
        stream = spark.readStream.schema(schema).parquet(first)
        ingest.ingest(spark, stream, path, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        rows.filter("item_pos = 1").write.mode("append").parquet(first)
        assert ledger.read(spark, path).count() == 1 + n


def test_page_landed_twice(spark):
    page = "<html><body><article><p>" + "Some words of an article. " * 20 + "</p></article></body></html>"
    pages = spark.createDataFrame([("https://e.org/1", page), ("https://e.org/1", page + " ")], "url string, html string")
    assert feeds.page_bodies(pages, pages.select("url")).count() == 1


def test_tag_with_many_attributes(spark):
    tag = "<img " + " ".join(f'a{k}="{k}"' for k in range(5000)) + ' src="x.png" width="3">'
    r = spark.createDataFrame([(tag,)], "raw string").select(
        markup.attr(F.col("raw"), "src").alias("src"), markup.has_attr(F.col("raw"), "width").alias("has"),
        F.length(markup.drop_attr(F.col("raw"), "width")).alias("n"), markup.replace_attr(F.col("raw"), "src", F.lit("y")).alias("new"),
    ).first()
    assert (r.src, r.has, r.n) == ("x.png", True, len(tag) - len(' width="3"')) and r.new.endswith('src="y" width="3">')


def test_large_and_unreadable_sizes(spark):
    tags = {"1e20": "100000000000000000000", "12.7": "12", "-3.9": "-3", "nan": None, "inf": None, "wide": None}
    df = spark.createDataFrame([(f'<img width="{v}">', w) for v, w in tags.items()], "raw string, want string")
    for r in df.select(markup.int_dimensions(F.col("raw"), F.lit("img")).alias("got"), "want").collect():
        assert r.got == (f'<img width="{r.want}">' if r.want else "<img>")


def test_leading_zeros_of_small_icons(spark):
    df = spark.createDataFrame([('<img width="0000000000016">', True), ('<img width="00000000000160">', False), ('<img width="99999999999">', False)], "raw string, want boolean")
    assert all(r.got == r.want for r in df.select(tree._small_image(F.col("raw")).alias("got"), "want").collect())


def test_link_dense_runs_of_long_pages(spark):
    from broadsheet.functions import clean

    body = "".join(f"<i>w{k}</i> " for k in range(6000))
    page = f"<p>{body}</p><p><a>all of it links</a></p><p>some text <a>a</a></p>"
    got = spark.createDataFrame([(page,)], "html string").select(clean._text_share(F.col("html")).alias("x")).first().x
    assert got == f"<p>{body}</p><p></p><p>some text <a>a</a></p>"


def test_daily_run_reads_payloads_for_articles_once(spark, tmp_path):
    import datetime as dt

    from broadsheet.plans import daily

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rss = "<rss><channel><title>F</title><item><title>One</title><link>https://e.org/1</link><description>text</description></item></channel></rss>"
    payloads = spark.createDataFrame([(0, rss), (1, rss)], "source_pos int, payload string").mapInArrow(count, "source_pos int, payload string")
    config = tmp_path / "config.json"
    config.write_text('{"title": {"text": "D"}, "body": [{"type": "rss", "src": "https://e.org/a"}, {"type": "rss", "src": "https://e.org/b"}]}')
    at = dt.datetime(2024, 5, 6, 4, tzinfo=dt.timezone.utc)
    out = str(tmp_path / "out")
    assert daily.run(spark, str(config), lambda kind: payloads if kind == "rss" else None, str(tmp_path / "ledger"), out, str(tmp_path / "work"), at, 1)
    assert [r.url for r in spark.read.parquet(f"{out}/chapters").collect()] == ["https://e.org/1"]
    assert seen.value <= 6  # two payloads: for articles once, for runs and for sources without one
