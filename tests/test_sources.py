"""Feeds, JSON lines, sinks, plug-ins, streams, and the queries' names."""

import json

import pytest
from pyspark.sql import functions as F

from broadsheet import plugins, schemas
from broadsheet.operators import ingest
from broadsheet.plans import daily
from broadsheet.sources import readers, sinks

FEED = b"""<?xml version="1.0"?><rss xmlns:content="http://c" xmlns:media="http://m"><channel>
<item><title><![CDATA[First <b>story</b>]]></title><link>https://x.y/1?utm_source=q</link><description>&lt;p&gt;Text&lt;/p&gt;</description><pubDate>Thu, 28 May 2026 10:20:30 +0530</pubDate><category>A</category><category>a</category><media:content url="z"><description>inner</description></media:content></item>
<item><title>Only a guid</title><guid>https://x.y/2</guid></item>
<item><title>Blank link</title><link> </link><guid>https://x.y/3</guid></item>
<item><title>First story!</title><link>https://x.y/4</link></item>
<item><link>https://x.y/5</link></item>
<nested><item><title>Deep</title><link>https://x.y/6</link><content:encoded>Body</content:encoded></item></nested>
</channel></rss>"""


@pytest.fixture()
def feeds(spark):
    return readers.feed_registry(spark, [("one", "One", "http://one", "national", "news", 50), ("two", "Two", "http://two", "national", "news", 50)])


def test_ingestion(spark, feeds, tmp_path):
    for name, body in (("one", FEED), ("two", b"<rss><broken")):
        (tmp_path / "2026-05-28" / name).mkdir(parents=True)
        (tmp_path / "2026-05-28" / name / "feed.xml").write_bytes(body)
    payloads = readers.snapshot_payloads(spark, f"file://{tmp_path}", "2026-05-28")
    items, results = daily.ingest_payloads(payloads, feeds, "now")
    rows = items.orderBy("ord").collect()
    assert [(r.url, r.title, r.description) for r in rows] == [("https://x.y/1", "First story", "Text"), ("https://x.y/2", "Only a guid", "Only a guid"), ("https://x.y/6", "Deep", "Body")]
    assert rows[0].published_at == "2026-05-28T04:50:30+00:00" and rows[0].tags == ["A"] and rows[0].article_id.startswith("article-") and rows[0].source_name == "One"
    got = {r.source_id: (r.status, r.item_count, r.duplicate_count) for r in results.collect()}
    assert got == {"one": ("ok", 3, 1), "two": ("failed", 0, 0)}
    assert ingest.run_rollup(results).first().status == "partial"


def test_registry(spark, feeds):
    assert [r.source_id for r in readers.lookup_feed(feeds, "two").collect()] == ["two"]
    with pytest.raises(KeyError, match="one, two"):
        readers.lookup_feed(feeds, "three")


def test_json_lines(spark, tmp_path):
    good = dict(article_id="a", source_id="s", source_name="S", title="t", description="", published_at="p", url="u")
    lines = [json.dumps(good), "", "[1]", "broken", json.dumps(good | {"article_id": 5}), json.dumps(good | {"title": " "}), json.dumps(good | {"article_id": "b"}), json.dumps(good | {"article_id": "c"})]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "items.jsonl").write_text("\n".join(lines) + "\n")
    raw = readers.json_lines(spark, f"file://{tmp_path}")
    assert raw.count() == 8 and readers.json_lines(spark, f"file://{tmp_path}", skip_blank=True).count() == 7
    items, invalid = ingest.valid_items(raw)
    assert [(r.article_id, r.description) for r in items.orderBy("line").collect()] == [("a", "t"), ("b", "t"), ("c", "t")]
    assert invalid.first().invalid_count == 5
    items, invalid = ingest.valid_items(raw, max_per_source=1)
    assert items.count() == 1 and invalid.first().invalid_count == 0
    assert readers.discover_sources(spark, f"file://{tmp_path}") == ["s"]
    assert readers.discover_sources(spark, "", ["b", "a", "b"]) == ["b", "a"]


def test_documents_and_caches(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"stories": [{"story_id": "x", "article_count": 2, "articles": [{"url": "u"}]}, 5, "y"]}))
    rows = readers.story_documents(spark, f"file://{tmp_path}/s.json").collect()
    assert [(r.story_id, r.article_count, r.articles[0].url) for r in rows] == [("x", 2, "u")]
    cache = [dict(story_id="x", model="m", headline="1"), dict(story_id="x", model="m", headline="2"), dict(story_id="y", model="n")]
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, cache)) + "\nbroken\n")
    got = readers.cached_rows(spark, f"file://{tmp_path}/c.jsonl", schemas.REWRITE, "m", "story_id").collect()
    assert [(r.story_id, r.headline) for r in got] == [("x", "2")]


def test_sql(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert [r.x for r in readers.run_sql(spark, "SELECT x FROM things WHERE id = :id", {"id": 2}, things=frame).collect()] == ["b"]


def test_paths(tmp_path):
    assert sinks.relative_path("/a/b/c", "/a") == "b/c" and sinks.relative_path("/x/b", "/a") == "/x/b"
    (tmp_path / "ca.pem").write_text("")
    environ = {}
    assert readers.use_ca_bundle(str(tmp_path / "ca.pem"), environ) and not readers.use_ca_bundle(str(tmp_path / "ca.pem"), environ)


def test_settings():
    assert readers.settings({"key": "K"}, {"K": " v "}) == {"key": "v"}
    with pytest.raises(ValueError, match="K"):
        readers.settings({"key": "K"}, {})
    assert readers.recipients(" a@b.c, ,d@e.f,") == ["a@b.c", "d@e.f"]


def test_failures_are_rows(spark):
    def make():
        def call(title, description):
            if title == "bad":
                raise RuntimeError("no")
            return json.dumps({"entities": [{"text": title, "canonical_name": title, "type": "ORG", "role": "primary"}]})

        return call

    items = spark.createDataFrame([("a", "bad", "d"), ("b", "Good", "d")], "article_id string, title string, description string")
    got = {r.article_id: r for r in plugins.extractions(items, make, "m").collect()}
    assert (got["a"].status, got["a"].error, got["a"].entities) == ("failed", "RuntimeError: no", [])
    assert got["b"].entities[0].canonical_name == "Good"


class Sender:
    def __init__(self):
        self.sent = 0

    def send(self, edition, html, text):
        self.sent += 1
        return 2


def test_delivery(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    empty = spark.createDataFrame([], schemas.DELIVERY)
    edition = {"edition_date": "2024-01-05", "story_run_id": "r", "stories": [1, 2]}
    sender = Sender()
    assert sinks.deliver(empty, path, edition, "", "", sender, minimum_items=5) == "held"
    assert sinks.deliver(empty, path, edition, "", "", sender, minimum_items=1) == "sent"
    ledger = lambda: spark.read.schema(schemas.DELIVERY).parquet(path)
    assert sinks.deliver(ledger(), path, edition, "", "", None, minimum_items=1) == "preview"
    assert sinks.deliver(ledger(), path, edition, "", "", sender, minimum_items=1) == "refused"  # a preview does not erase the mark
    assert sinks.deliver(ledger(), path, edition, "", "", sender, minimum_items=1, force=True) == "sent" and sender.sent == 2


def test_editions(spark):
    rows = [(2, "World", "H & <h>", "S", "P", "2024-01-05T00:00:00+00:00", "http://u?a=1&b"), (1, "National", "N", "S", "Q", "soon", "v"), (3, "Odd", "O", "S", "Q", "soon", "w")]
    frame = spark.createDataFrame(rows, "position long, section string, headline string, summary string, source_name string, published_at string, url string")
    text = sinks.edition_text(frame, "Title", "2024-01-05", "Bye").first().text
    assert text == "TITLE\n05 January 2024\n\nNATIONAL\n========\nN\nS\nQ · soon\nv\n\nWORLD\n=====\nH & <h>\nS\nP · 05 Jan · 05:30 IST\nhttp://u?a=1&b\n\nBye\n"
    page = sinks.edition_html(frame, "Title", "2024-01-05").first().html
    assert "H &amp; &lt;h&gt;" in page and page.index("National") < page.index("World") and "Odd" not in page
    assert "No stories were selected" in sinks.edition_html(frame.limit(0), "Title", "2024-01-05").first().html


def test_json_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("r", "s", "é")], "run_id string, source_id string, title string")
    sinks.write_json_lines(frame, f"file://{tmp_path}/lines", "run_id", "source_id")
    assert spark.read.json(f"file://{tmp_path}/lines").first().title == "é"


def test_stream(spark, tmp_path):
    from broadsheet.streaming import feeds as stream

    rows = [("a", "s", "S", "n", "c", "t", "d", "2024-01-01T00:00:00Z", u, [], "now") for u in ("http://x.y/?utm_a=1", "http://x.y/", "http://x.y/z")]
    spark.createDataFrame(rows, schemas.ITEM).write.json(f"file://{tmp_path}/in")
    query = stream.fresh_items(stream.item_stream(spark, f"file://{tmp_path}/in")).writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.url for r in spark.table("fresh").collect()) == ["http://x.y/", "http://x.y/z"]


def test_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert {"greedy_dedup", "star_stories", "select_edition"} <= set(__spark_entry__.queries())


def test_library_does_not_need_the_training_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "broadsheet"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "broadsheet.llm" not in f.read_text()
