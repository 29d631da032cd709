"""Chains of any length, plug-ins, sources and sinks at their borders."""

import http.server
import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet import plugins, schemas
from broadsheet.functions import text as T
from broadsheet.operators import annotate, components, greedy, selection, stories
from broadsheet.plans import daily
from broadsheet.sources import readers, sinks

from .test_operators import ITEM, item


def two_keys(rows):
    one, two, kept = set(), set(), []
    for i, a, b in sorted(rows):
        if a not in one and b not in two:
            one.add(a)
            two.add(b)
            kept.append(i)
    return kept


def stars(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seeds = []
    for i in range(n):
        if not near[i] & set(seeds):
            seeds.append(i)
    return {i: i if i in seeds else min(near[i] & set(seeds)) for i in range(n)}


@pytest.mark.parametrize(("fold", "rounds"), [(100_000, 12), (0, 3)])
def test_long_chains_end(spark, monkeypatch, fold, rounds):
    """A chain of 5,000 rows, walked at once, and by components behind a few rounds."""
    monkeypatch.setattr(greedy, "FOLD_ROWS", fold)
    monkeypatch.setattr(greedy, "ROUNDS", rounds)
    n = 5000 if fold else 600
    rows = [(i, f"u{(i + 1) // 2}", f"t{i // 2}") for i in range(n)] + [(10_000 + i, f"x{i % 7}", f"y{i % 5}") for i in range(60)] + [(20_000, None, "t"), (20_001, "u", None)]
    frame = spark.createDataFrame(rows, "ord long, u string, t string")
    assert sorted(r.ord for r in greedy.first_by_two_keys(frame, "ord", "u", "t").collect()) == two_keys(r for r in rows if r[1] and r[2])
    edges = [(i, i + 1) for i in range(n - 1)]
    nodes = spark.createDataFrame([(f"n{i}", i) for i in range(n + 3)], "id string, rank long")
    links = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "a string, b string")
    got = {r.id: r.seed for r in greedy.star_assignment(nodes, links).collect()}
    assert got == {f"n{i}": f"n{s}" for i, s in {**{i: i - i % 2 for i in range(n)}, **{i: i for i in range(n, n + 3)}}.items()}


@pytest.mark.parametrize("seed", range(3))
def test_rounds_and_components_give_the_same(spark, monkeypatch, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(30), r.randrange(30)) for i in range(150)]
    edges = sorted({tuple(sorted(r.sample(range(70), 2))) for _ in range(100)})
    nodes = spark.createDataFrame([(i, i) for i in range(70)], "id long, rank long")
    links = spark.createDataFrame(edges, "a long, b long")
    frame = spark.createDataFrame(rows, "ord long, a int, b int").withColumn("row", F.struct(F.lit("x").alias("s"), "ord"))
    for rounds in (1, 12):
        monkeypatch.setattr(greedy, "FOLD_ROWS", 0)
        monkeypatch.setattr(greedy, "ROUNDS", rounds)
        assert sorted(x.ord.ord for x in greedy.first_by_two_keys(frame, "row", "a", "b").collect()) == two_keys(rows)
        assert {x.id: x.seed for x in greedy.star_assignment(nodes, links).collect()} == stars(70, edges)


def test_components(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3), (600, 601), (601, 602), (602, 600)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 600: 600, 601: 600, 602: 600}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_full_case_folding(spark):
    words = ["Straße", "ﬁn", "ſ", "ς", "Σας", "ı", "İ", "ẞ", "ÀB", "ŉ", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.casefold(F.col("w")).alias("c")).collect()
    assert {r.w: r.c for r in got} == {w: w.casefold() for w in words}


def test_sparse_dots():
    r = np.random.default_rng(1)
    size = np.array([0, 5, 9, 3, 9, 1])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    h = np.concatenate([np.sort(r.choice(12, k, replace=False)) for k in size])
    w = r.normal(size=len(h))
    dense = np.zeros((6, 12))
    dense[np.repeat(np.arange(6), size), h] = w
    a, b = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    for at_once in (1, 7, 10**6):
        old, stories.AT_ONCE = stories.AT_ONCE, at_once
        assert stories._sparse_dots(a, b, start, size, h, w) == pytest.approx((dense @ dense.T)[a, b])
        stories.AT_ONCE = old
    assert stories._sparse_dots(a[:1], b[:1], start[:1], size[:1], h[:0], w[:0]).tolist() == [0]


def test_frequent_entities_meet_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(stories, "ENTITY_BLOCK", 4)
    r = random.Random(2)
    sets = {i: {"everywhere"} | {f"entity{r.randrange(12)}" for _ in range(r.randint(0, 4))} for i in range(30)}
    rows = [(i, [(e, e, "ORG", "primary") for e in s]) for i, s in sets.items()] + [(99, []), (98, None)]
    got = stories.entity_pairs(spark.createDataFrame(rows, f"ord long, entities array<{schemas.ENTITY}>")).collect()
    want = {(a, b): (sorted(sets[a] & sets[b]), len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b]))) for a in sets for b in sets if a < b}
    assert {(x.a, x.b): (x.shared_entities, x.entity_score) for x in got} == want and len(got) == len(want)


class Titles:
    """Scores of 0.8 for titles of one first word, else 1.7, which is cut to 1."""

    def score_pairs(self, pairs):
        return [0.8 if a.split()[1] == b.split()[1] else 1.7 for a, b in pairs]


class Letters:
    def encode(self, text):
        return {"x": 0.5, "y": 0.5} if "Shared" in text else {}


def test_scorers_can_be_plugged_in(spark):
    rows = [item(i, f"s{i}", t, "breakthroughs everywhere today") for i, t in enumerate(["Shared one", "Shared two", "Other three"], 1)]
    frame = spark.createDataFrame(rows, ITEM)
    got = daily.stories_of(frame, scorer=Titles)["pairs"].collect()
    assert {(r.article_id_a, r.article_id_b): r.lexical_score for r in got} == {("a1", "a2"): 0.8, ("a1", "a3"): 1.0, ("a2", "a3"): 1.0}
    got = daily.stories_of(frame, encoder=Letters)["pairs"].collect()
    assert {(r.article_id_a, r.article_id_b): r.lexical_score for r in got} == {("a1", "a2"): 0.5, ("a1", "a3"): 0.0, ("a2", "a3"): 0.0}


def test_answers_that_are_wrong_fail(spark):
    answers = {"json": "{broken", "list": '{"entities": 5}', "good": '{"entities": [{"canonical_name": "gone"}, {"text": "Kept"}]}'}
    items = spark.createDataFrame([(k, k, "d") for k in answers], "article_id string, title string, description string")
    got = {r.article_id: r for r in plugins.extractions(items, lambda: lambda title, description: answers[title], "m").collect()}
    assert (got["json"].status, got["list"].status, got["good"].status) == ("failed", "failed", "ok")
    assert got["json"].error == "the answer is no JSON" and got["json"].entities == []
    assert [e.text for e in got["good"].entities] == ["Kept"]


def test_rewrites_fall_back_to_the_representative(spark):
    made = [("s1", "a2", None, " ", [("a1", "x", "X", "One", "d1", "", ""), ("a2", "x", "X", "Two", "d2", "", "")]), ("s2", None, "T", None, [])]
    frame = spark.createDataFrame(made, f"story_id string, representative_article_id string, representative_title string, representative_description string, articles array<{schemas.STORY_ARTICLE}>")
    got = {r.story_id: (r.headline, r.summary, r.status) for r in plugins.rewrites(frame).collect()}
    assert got == {"s1": ("Two", "d2", "fallback"), "s2": ("T", "No description available.", "fallback")}
    prompts = {r.story_id: r.p for r in frame.select("story_id", T.story_prompt(F.col("story_id"), F.col("articles")).alias("p")).collect()}
    assert prompts["s2"] == "Story ID: s2\n\nContributing RSS records:"
    assert prompts["s1"].split("\n\n")[2:] == ["1. Publisher: X\nTitle: One\nDescription: d1", "2. Publisher: X\nTitle: Two\nDescription: d2"]


def test_numbering_over_ranges(spark):
    r = random.Random(4)
    rows = [(f"a{i:03d}", r.choice([None, "2024-01-01", "2024-01-02", ""])) for i in range(200)]
    frame = spark.createDataFrame(rows, "article_id string, published_at string").repartition(5)
    ordered = [i for i, _ in sorted(sorted(rows), key=lambda x: x[1] or "", reverse=True)]
    ordered = [i for t in ("2024-01-02", "2024-01-01", "") for i, p in sorted(rows) if (p or "") == t]
    got = {x.article_id: (x.previous_id, x.next_id) for x in annotate.neighbours(frame, annotate.newest_first()).collect()}
    assert got == {i: (ordered[k - 1] if k else None, ordered[k + 1] if k + 1 < len(ordered) else None) for k, i in enumerate(ordered)}
    placed = annotate.numbered(frame, [F.col("article_id")], "n").collect()
    assert [x.article_id for x in sorted(placed, key=lambda x: x.n)] == sorted(i for i, _ in rows) and min(x.n for x in placed) == 1


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for s in ("one", "two"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "items.jsonl").write_text("".join(f"{s} {i}\r\n" if i % 9 else "\n" for i in range(1, 400)))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "items.jsonl").write_text("")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        got = {(r.source_id, r.line): r.value for r in readers.json_lines(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(s, i): f"{s} {i}" if i % 9 else "" for s in ("one", "two") for i in range(1, 400)}
    assert readers.discover_sources(spark, f"file://{tmp_path}") == ["one", "two"]


def test_feed_items():
    feed = b"""<rss xmlns:m="urn:m"><channel><item><title>A</title><link></link><guid>http://g</guid><m:description>first</m:description><description>second</description></item>
    <group><item><title>B &amp;amp; C</title><link> http://l </link><encoded>&lt;b&gt;bold&lt;/b&gt;</encoded><category>x</category><category>X</category><published>2024</published>
    <part><title>inner</title><item><title>In</title><link>http://in</link></item></part></item></group><item><title>no link</title></item></channel></rss>"""
    assert readers.parse_items(feed) == [
        ("http://g", "A", "first", "", []), ("http://l", "B & C", "bold", "2024", ["x", "X"]), ("http://in", "In", "In", "", []),
    ]


def test_live_feeds(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if self.path == "/good" else 500)
            self.end_headers()
            self.wfile.write(self.headers["User-Agent"].encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    got = {r.source_id: r for r in readers.live_payloads(spark, [("a", f"{at}/good"), ("b", f"{at}/bad")], delay="0", userAgent="tests").collect()}
    server.shutdown()
    assert bytes(got["a"].payload) == b"tests" and got["a"].http_status == 200 and got["a"].error is None
    assert got["b"].payload is None and "500" in got["b"].error


def test_payloads_runs_and_documents(spark, tmp_path):
    frame = spark.createDataFrame([("s", bytearray(b"\x00\xff"))], "source_id string, payload binary")
    sinks.write_payloads(frame, f"file://{tmp_path}/raw")
    assert bytes(spark.read.parquet(f"file://{tmp_path}/raw").first().payload) == b"\x00\xff"
    sinks.write_run(f"file://{tmp_path}/run", stories=frame.select("source_id"), pairs=frame)
    assert spark.read.parquet(f"file://{tmp_path}/run/stories").columns == ["source_id"]
    sinks.write_document(spark.createDataFrame([("é", None, [1, 2])], "title string, none string, list array<int>"), f"file://{tmp_path}/doc")
    text = "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/doc").collect())
    assert json.loads(text) == {"title": "é", "none": None, "list": [1, 2]} and "é" in text and "\n" in text


MARK = "id long, run_id long, article_id_a string, article_id_b string, reference_article_id string, label string, notes string, annotator_id string, created_at string, updated_at string"


def test_export(spark, tmp_path):
    marks = [(1, 1, "b", "c", "b", "related", "", "z", "t", "t1"), (2, 1, "a", "b", "a", "same_story", "n", "z", "t", "t2"), (3, 1, "a", "b", "a", "related", "", "y", "t", "t3")]
    articles = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "article_id string, title string")
    runs = spark.createDataFrame([(1, "m", "p", "1", "2", "t")], "id long, manifest_id string, manifest_path string, tool_version string, schema_version string, created_at string")
    summary = sinks.export_annotations(spark.createDataFrame(marks, MARK), articles, f"file://{tmp_path}/x", runs).first()
    assert (summary.article_count, summary.pair_count, summary.manifest_id) == (3, 3, "m")
    assert summary.label_counts == {"same_story": 1, "related": 2, "opposite": 0, "unrelated": 0, "unclear": 0}
    rows = spark.read.option("header", True).csv(f"file://{tmp_path}/x/csv")
    assert tuple(rows.columns) == sinks.EXPORT_COLUMNS
    lines = [json.loads(line) for f in sorted((tmp_path / "x" / "jsonl").glob("part-*")) for line in f.read_text().splitlines()]
    assert [(x["article_id_a"], x["annotator_id"]) for x in lines] == [("a", "y"), ("a", "z"), ("b", "z")]
    shown = "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/x/summary").collect())
    assert json.loads(shown)["label_counts"]["related"] == 2


def test_page_of_an_edition(spark):
    rows = [(1, "World", "One", "S", "ab", "Ab", "", "http://u?a=1&b", 3), (2, "World", "Two", "S", "c", None, "", "", 1), (3, "Sports", "3", "S", "d", "AB", "", "v", None)]
    frame = spark.createDataFrame(rows, "position long, section string, headline string, summary string, source_id string, source_name string, published_at string, url string, article_count long")
    page = sinks.edition_html(frame, "News <&>", "2024-01-05", logo='x"y').first().html
    assert "<title>News &lt;&amp;&gt;</title>" in page and 'src="x&quot;y"' in page and "3 stories · 3 publishers" in page
    assert "<h2>World</h2><p>2 stories</p>" in page and "<h2>Sports</h2><p>1 story</p>" in page and "3 reports" in page and page.count("1 report<") == 2
    assert '<ul><li><a href="http://u?a=1&amp;b">Ab</a></li><li>c</li></ul>' in page
    assert "A focused daily edition" in sinks.edition_html(frame.limit(0), "N", "2024-01-05").first().html


def test_mail_sender():
    sent = []

    def post(url, user, password, data):
        sent.append((url, user, password, data))
        return (200, "") if len(sent) == 1 else (401, "no")

    settings = {"url": "u", "key": "k", "secret": "s", "sender": "me@x.y", "recipients": ["a@x.y", "b@x.y"], "reply_to": "r@x.y"}
    sender = sinks.HttpMailSender(settings, b"png", post)
    assert sender.send({"edition_date": "2024-01-05"}, "<p>", "t") == 2
    message = sent[0][3]["Messages"][0]
    assert [x["Email"] for x in message["To"]] == ["a@x.y", "b@x.y"] and message["ReplyTo"] == {"Email": "r@x.y"} and message["InlinedAttachments"][0]["Base64Content"] == "cG5n"
    with pytest.raises(RuntimeError, match="401"):
        sender.send({"edition_date": "2024-01-05"}, "<p>", "t")
    with pytest.raises(ValueError, match="secret"):
        sinks.HttpMailSender(settings | {"secret": ""})


def test_small_lookups(spark):
    runs = spark.createDataFrame([(1, "a"), (3, "c"), (2, "b")], "id long, manifest string")
    assert annotate.latest_run(runs).first().manifest == "c"
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "article_id string, run_id long")
    assert annotate.article(rows, "x").count() == 2 and annotate.article(rows, "x", run=2).first().run_id == 2
    tags = spark.createDataFrame([('["a","b","c","d","e"]',), ("{}",), (None,)], "t string")
    assert [r.t for r in tags.select(annotate.display_tags(F.col("t")).alias("t")).collect()] == [["a", "b", "c", "d"], [], []]
    assert selection.fallback_count(spark.createDataFrame([("ok",), ("fallback",), ("fallback",)], "status string")).first()[0] == 2
    now = spark.range(1).select(T.default_edition_date().alias("d"), T.utc_now().alias("n"), T.run_id().alias("r")).first()
    assert now.n.endswith(("+00:00", "Z")) and len(now.r) == 16 and now.r.endswith("Z") and str(now.d)[:2] == "20"
    chosen = spark.createDataFrame([("a",), ("a",), ("b",)], "source_id string")
    got = selection.selection_diagnostics(chosen.unionByName(chosen.limit(0)), chosen, 5, 2).first()
    assert (got.candidate_count, got.available_source_count, got.selected_count, got.source_counts) == (3, 2, 3, {"a": 2, "b": 1})


@pytest.mark.parametrize("primary", [True, False])
def test_pairs_and_scores_over_cells(spark, monkeypatch, primary):
    """Many small groups and batches; one article with more meetings than a batch; entities without a name and of two spellings; plain loops as the model."""
    for name, value in (("ENTITY_BLOCK", 4), ("MEET_AT_ONCE", 9), ("AT_ONCE", 30), ("TABLE", 40)):
        monkeypatch.setattr(stories, name, value)
    r = random.Random(5)
    names = [f"Name{i}" for i in range(9)] + ["NAME1", None]
    rows = [(i * 7 % 61, [(n, n, r.choice(["ORG", "GPE"]), r.choice(["primary", "secondary"])) for n in r.sample(names, r.randint(0, 7))], " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9)))) for i in range(40)]
    frame = spark.createDataFrame([*rows, (98, None, "a"), (99, [], None)], f"ord long, entities array<{schemas.ENTITY}>, text string")
    low = lambda n: n and n.lower()
    every = {i: {low(n) for _, n, _, _ in es} for i, es, _ in rows}
    keys = {i: {low(n) for _, n, t, role in es if not primary or (t == "ORG" and role == "primary")} for i, es, _ in rows}
    encode, texts = plugins.TermEncoder().encode, {i: x for i, _, x in rows}
    weights = {i: encode(x) if x else {} for i, x in texts.items()}
    want = {}
    for a in every:
        for b in every:
            if a < b and keys[a] & keys[b]:
                both = every[a] & every[b]
                want[a, b] = (sorted(both, key=lambda n: (n is None, n or "")), len(both) / min(len(every[a]), len(every[b])), min(1.0, sum(w * weights[b].get(t, 0) for t, w in weights[a].items())))
    got = stories.scored_pairs(frame, primary).collect()
    assert len(got) == len(want) > 20
    assert {(x.a, x.b): (x.shared_entities, x.entity_score) for x in got} == {p: w[:2] for p, w in want.items()}
    assert {(x.a, x.b): x.lexical_score for x in got} == pytest.approx({p: w[2] for p, w in want.items()})
    assert stories.scored_pairs(frame.where("ord > 97"), primary).count() == 0


def test_nothing_of_a_pair_is_shuffled(spark):
    rows = [(i, [(e, e, "ORG", "primary") for e in ("common", f"own{i}")]) for i in range(600)]
    plan = stories.entity_pairs(spark.createDataFrame(rows, f"ord long, entities array<{schemas.ENTITY}>"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1
