"""Order-dependent operators against sequential models, relational operators on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import annotate, greedy, ingest, selection, stories
from broadsheet.plans import daily


@pytest.mark.parametrize("seed", range(4))
def test_two_key_rule(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(25), r.randrange(25), r.randrange(3)) for i in range(120)]
    for within in (None, ["g"]):
        seen, kept = set(), set()
        for i, a, b, g in rows:
            g = g if within else 0
            if ("a", g, a) not in seen and ("b", g, b) not in seen:
                kept.add(i)
                seen |= {("a", g, a), ("b", g, b)}
        frame = spark.createDataFrame(rows, "ord long, a int, b int, g int")
        assert {x.ord for x in greedy.first_by_two_keys(frame, "ord", "a", "b", within).collect()} == kept


def test_two_key_rule_is_not_chained_distinct(spark):
    rows = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t1"), (3, "u2", "t2"), (4, "u3", "t2")], "ord long, u string, t string")
    assert sorted(r.ord for r in greedy.first_by_two_keys(rows, "ord", "u", "t").collect()) == [1, 3]


@pytest.mark.parametrize("seed", range(4))
def test_stars(spark, seed):
    r = random.Random(seed)
    ranks = list(range(60))
    r.shuffle(ranks)
    edges = {tuple(sorted(r.sample(range(60), 2))) for _ in range(90)}
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i in range(60)}
    seed_of = {}
    for i in sorted(range(60), key=ranks.__getitem__):
        if i not in seed_of:
            seed_of |= {i: i} | {j: i for j in near[i] if j not in seed_of}
    nodes = spark.createDataFrame([(f"n{i}", ranks[i]) for i in range(60)], "id string, rank long")
    links = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "a string, b string")
    got = {x.id: x.seed for x in greedy.star_assignment(nodes, links).collect()}
    assert got == {f"n{i}": f"n{s}" for i, s in seed_of.items()}


def test_chain_depends_on_rank(spark):
    links = spark.createDataFrame([("A", "B"), ("B", "C")], "a string, b string")
    for ranks, want in ((dict(A=1, B=2, C=3), {"A": "A", "B": "A", "C": "C"}), (dict(B=1, A=2, C=3), {"A": "B", "B": "B", "C": "B"})):
        nodes = spark.createDataFrame(list(ranks.items()), "id string, rank long")
        assert {x.id: x.seed for x in greedy.star_assignment(nodes, links).collect()} == want


ITEM = "article_id string, source_id string, source_name string, scope string, category string, title string, description string, published_at string, url string, tags array<string>, ingested_at string, ord long"


def item(i, source, title, description="d"):
    return (f"a{i}", source, source.upper(), "en", "c", title, description, f"2024-01-0{i}T00:00:00+00:00", f"https://x.y/{i}", [], "", i)


def test_articles_to_stories(spark):
    rows = [
        item(1, "s1", "Shared one", "breakthroughs everywhere today"), item(2, "s2", "Shared two", "breakthroughs everywhere again"),
        item(3, "s3", "Lonely", "nothing here"), item(4, "s3", "Lonely again", "other things"),
    ]
    made = daily.stories_of(spark.createDataFrame(rows, ITEM), daily.Settings(merge_threshold=0.4))
    assert [(r.article_id_a, r.article_id_b, r.shared_entities) for r in made["pairs"].collect()] == [("a1", "a2", ["breakthroughs", "everywhere"])]
    got = made["stories"].collect()
    assert sorted(r.article_count for r in got) == [1, 1, 2]
    big = next(r for r in got if r.article_count == 2)
    assert big.source_count == 2 and big.representative_article_id == "a2" and [a.article_id for a in big.articles] == ["a2", "a1"]
    summary = ingest.normalization_summary(made["extractions"], made["pairs"], made["stories"]).first()
    assert (summary.candidate_pairs, summary.accepted_pairs, summary.stories, summary.multi_source, summary.singletons) == (1, 1, 3, 1, 2)
    debug = stories.debug_stories(made["stories"], made["items"], made["extractions"], made["accepted"])
    totals = stories.debug_totals(debug, made["accepted"]).first()
    assert tuple(totals) == (1, 2, 1, 1)


def test_shared_place_is_no_pair(spark):
    entity = "array<struct<text:string,canonical_name:string,type:string,role:string>>"
    rows = spark.createDataFrame([(1, [("x", "Delhi", "GPE", "primary")]), (2, [("x", "delhi", "GPE", "primary")])], f"ord long, entities {entity}")
    assert stories.entity_pairs(rows).count() == 0
    assert stories.entity_pairs(rows, require_primary=False).count() == 1


def _candidates(spark, rows):
    schema = "story_id string, section string, source_id string, article_count long, source_count long, published_at string, confidence double"
    return spark.createDataFrame(rows, schema)


def test_selection_prefers_publishers_and_size(spark):
    rows = [(f"s{i}", "World", f"p{min(i, 3)}", 1, 1, f"2024-01-{10 + i}", None) for i in range(6)]
    got = selection.select_stories(_candidates(spark, rows), 5, 2).collect()
    assert len(got) == 5 and len({r.source_id for r in got}) == 4
    two = _candidates(spark, [("new", "World", "a", 1, 1, "2024-02-02", None), ("big", "World", "b", 3, 1, "2024-01-01", None)])
    assert [r.story_id for r in selection.select_stories(two, 1, 3).collect()] == ["big"]


@pytest.mark.parametrize("seed", range(3))
def test_selection_after_pruning(spark, seed):
    from broadsheet import schemas

    r = random.Random(seed)
    rows = [(f"s{i:03}", r.choice([*schemas.SECTIONS[:4], "Odd"]), r.choice(["", "a", "b", "c", "d", "e"]), r.randint(0, 3), r.randint(1, 3), f"2024-01-{r.randint(10, 28)}", r.choice([None, 0.5, 0.7])) for i in range(80)]
    key = lambda x: (x[3] or 1, x[4] or 1, x[5], x[6] or 0.0, x[0])
    ranked = sorted(rows, key=key, reverse=True)
    want = selection.choose([(x[0], x[2], x[1]) for x in ranked], 9, 2)
    got = selection.select_stories(_candidates(spark, rows), 9, 2).orderBy("position").collect()
    assert [x.story_id for x in got] == want and len(want) == 9


def test_edition_gate(spark):
    rows = _candidates(spark, [("a", "World", "p", 1, 1, "2024-01-01", None), ("b", "World", "", 1, 1, "2024-01-01", None)])
    got = selection.edition_status(rows, 5).first()
    assert tuple(got) == (2, 1, "held") and selection.edition_status(rows, 2).first().status == "ready"


def _articles(spark):
    return spark.createDataFrame([(f"a{i}", 1, f"t{i}", "100%" if i == 2 else "d", None if i == 3 else f"2024-01-0{i}", "s") for i in range(1, 6)], "article_id string, run_id long, title string, description string, published_at string, source_id string")


PAIR = "id long, run_id long, article_id_a string, article_id_b string, reference_article_id string, label string, notes string, annotator_id string, created_at string, updated_at string"
NEW = "run_id long, article_id_a string, article_id_b string, reference_article_id string, label string, notes string, annotator_id string, ord long"


def test_upsert(spark):
    saved = spark.createDataFrame([(7, 1, "a1", "a2", "a1", "related", "", "local", "then", "then")], PAIR)
    batch = spark.createDataFrame([(1, "a2", "a1", "a2", "unclear", "n", "local", 0), (1, "a2", "a1", "a2", "same_story", "m", "local", 1), (1, "a5", "a3", "a3", "opposite", "", "local", 2)], NEW)
    got = {r.id: r for r in annotate.upsert_pairs(saved, batch, "now").collect()}
    assert set(got) == {7, 8}
    assert (got[7].label, got[7].notes, got[7].created_at, got[7].updated_at, got[7].reference_article_id) == ("same_story", "m", "then", "now", "a2")
    assert (got[8].article_id_a, got[8].article_id_b, got[8].created_at) == ("a3", "a5", "now")
    assert annotate.check_batch(batch, _articles(spark)) == []
    bad = spark.createDataFrame([(1, "a1", "a1", "a1", "odd", "", "local", 0), (1, "a1", "zz", "a1", "related", "", "local", 1)], NEW)
    assert annotate.check_batch(bad, _articles(spark)) == ["unknown label", "an article paired with itself", "unknown article"]


def test_lookups(spark):
    articles = _articles(spark)
    marks = spark.createDataFrame([(1, 1, "a1", "a2", "a1", "related", "", "local", "then", "2024"), (2, 1, "a1", "a3", "a1", "unclear", "", "other", "then", "2025")], PAIR)
    assert [(r.article_id, r.annotation_count) for r in annotate.references(articles, marks).collect()] == [("a5", 0), ("a4", 0), ("a2", 0), ("a1", 2), ("a3", 0)]
    assert [r.article_id for r in annotate.references(articles, marks, run=1, status="labeled").collect()] == ["a1"]
    assert annotate.references(articles, marks, status="unlabeled").count() == 4
    assert [r.article_id for r in annotate.references(articles, marks, search="0%").collect()] == ["a2"]
    got = {r.article_id: r.existing_label for r in annotate.candidates(articles, marks, "a2", since="2024-01-01", until="2024-01-04").collect()}
    assert got == {"a1": "related", "a4": None}
    assert {r.label: r.n for r in annotate.label_counts(marks).collect()} == {"same_story": 0, "related": 1, "opposite": 0, "unrelated": 0, "unclear": 1}
    assert tuple(annotate.progress(articles, marks).first()) == (5, 1, 4, 2, 20.0)
    assert [(r.title_a, r.title_b) for r in annotate.saved_annotations(marks, articles).collect()] == [("t1", "t3"), ("t1", "t2")]
    nav = {r.article_id: (r.previous_id, r.next_id) for r in annotate.neighbours(articles, annotate.newest_first()).collect()}
    assert nav["a5"] == (None, "a4") and nav["a3"] == ("a1", None)


def test_imports(spark):
    articles = _articles(spark)
    more = articles.withColumn("article_id", F.concat("article_id", F.when(F.col("article_id") > "a3", "x").otherwise("")))
    assert sorted(r.article_id for r in annotate.import_articles(articles, more).collect()) == ["a4x", "a5x"]
    assert annotate.import_articles(articles, articles).count() == 0
    with pytest.raises(ValueError):
        annotate.import_articles(articles, articles.withColumn("run_id", F.lit(2).cast("long")))
    good, bad = annotate.split_imports(spark.createDataFrame([("a", "t"), (" ", "t"), ("b", None)], "article_id string, title string"))
    assert good.count() == 1 and bad.count() == 2


def test_registration(spark):
    old = spark.createDataFrame([("A@b.c",)], "email string")
    new = spark.createDataFrame([(0, " a@B.c "), (1, "x@y.z"), (2, "X@y.z"), (3, "no"), (4, None)], "ord long, email string")
    assert [r.status for r in annotate.register(old, new).orderBy("ord").collect()] == ["duplicate", "created", "duplicate", "invalid", "invalid"]


def test_cache(spark):
    items = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "article_id string, input_fingerprint string")
    cache = spark.createDataFrame([("a", "1", "m", "failed", 0), ("b", "old", "m", "ok", 1), ("b", "2", "m", "ok", 2), ("c", "3", "other", "ok", 3)], "article_id string, input_fingerprint string, model string, status string, ord int")
    hits, misses = ingest.cache_split(items, cache, "m")
    assert sorted((r.article_id, r.status) for r in hits.collect()) == [("a", "failed"), ("b", "ok")]
    assert [r.article_id for r in misses.collect()] == ["c"]


def test_pair_quality(spark):
    marks = spark.createDataFrame([(1, 1, "a", "b", "a", "same_story", "", "l", "", ""), (2, 1, "a", "c", "a", "related", "", "l", "", ""), (3, 1, "b", "c", "a", "same_story", "", "l", "", "")], PAIR)
    pairs = spark.createDataFrame([("b", "a", True), ("a", "c", True)], "a string, b string, accepted boolean")
    assert tuple(annotate.pair_quality(marks, pairs).first()) == (0.5, 0.5)


def test_settings_are_checked():
    for wrong in ({"merge_threshold": 2}, {"target_items": 0}, {"entity_weight": 0, "lexical_weight": 0}, {"edition_date": "x"}, {"minimum_items": 99}):
        with pytest.raises(ValueError):
            daily.Settings(**wrong)


def test_choice_is_made_without_texts(spark, monkeypatch):
    plans, cut = [], selection.cut

    def spied(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(selection, "cut", spied)
    rows = _candidates(spark, [(f"s{i}", "World", f"p{i % 3}", 1, 1, f"2024-01-{10 + i}", None) for i in range(6)]).withColumn("headline", F.concat("story_id", F.lit(" says")))
    got = selection.select_stories(rows, 4, 2).collect()
    assert sorted(r.headline for r in got) == sorted(f"{r.story_id} says" for r in got) and len(got) == 4
    assert len(plans) == 2 and "headline" not in plans[0] and "Window" not in plans[1]
