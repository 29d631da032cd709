"""More named queries with their SQL: editions, totals of a run, models' answers, lookups of the workbench."""

from __future__ import annotations

from pyspark.sql import functions as F

from broadsheet import plugins
from broadsheet.functions import text as T
from broadsheet.operators import annotate, ingest, selection, stories
from broadsheet.plans import daily
from broadsheet.plans.catalog import ARTICLES, CANDIDATES, EDITION, MARKS, STORIES_SQL, _candidates, _marks, articles, table
from broadsheet.session import cut
from broadsheet.sources import sinks

# --- editions -------------------------------------------------------------------------------------------------------


def editions(spark, d):
    return selection.select_stories(_candidates(spark, d), 10, 3, "edition").select("edition", "story_id", "position")


# Four new publishers, one of each section, then the rest: as many steps as may be needed, each of which takes the best that fits.
EDITIONS_SQL = f"""
WITH RECURSIVE {CANDIDATES.strip()},
near AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edition, source_id, section ORDER BY rk) AS n FROM ranked) WHERE n <= 3),
steps AS MATERIALIZED (SELECT CAST(i AS INT) AS step, CASE WHEN i <= 4 THEN 1 WHEN i <= 11 THEN 2 ELSE 3 END AS pass,
          CASE WHEN i BETWEEN 5 AND 11 THEN ['National', 'Politics', 'Business & Economy', 'Technology & Science', 'World', 'Sports', 'Other'][i - 4] END AS want FROM range(1, 22) t(i)),
walk AS (
  SELECT DISTINCT edition, 0 AS step, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS sources FROM candidates
  UNION ALL
  SELECT w.edition, s.step, CASE WHEN p.id IS NULL THEN w.ids ELSE list_append(w.ids, p.id) END, CASE WHEN p.id IS NULL THEN w.sources ELSE list_append(w.sources, p.src) END
  FROM walk w JOIN steps s ON s.step = w.step + 1 LEFT JOIN LATERAL (
    SELECT arg_min(story_id, rk) AS id, arg_min(source_id, rk) AS src FROM near
    WHERE near.edition = w.edition AND len(w.ids) < 10 AND NOT list_contains(w.ids, story_id) AND len(list_filter(w.sources, lambda x: x = source_id)) < 3
      AND (s.pass <> 1 OR NOT list_contains(w.sources, source_id)) AND (s.want IS NULL OR section = s.want)) p ON true)
SELECT edition, unnest(ids) AS story_id, unnest(range(1, len(ids) + 1)) AS position FROM walk WHERE step = 21
"""


def edition_status(spark, d):
    return selection.edition_status(selection.select_stories(_candidates(spark, d), 12, 2), 5)


STATUS_SQL = f"""
WITH RECURSIVE {EDITION.strip()}
SELECT count(*) AS story_count, count(DISTINCT nullif(r.source_id, '')) AS publisher_count, CASE WHEN count(*) >= 5 THEN 'ready' ELSE 'held' END AS status
FROM chosen c JOIN ranked r ON r.story_id = c.story_id
"""


def selection_diagnostics(spark, d):
    candidates = _candidates(spark, d)
    rows = selection.selection_diagnostics(candidates, selection.select_stories(candidates, 12, 2), 12, 2)
    pairs = F.transform(F.map_entries("source_counts"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
    return rows.withColumn("source_counts", F.array_join(pairs, ","))


DIAGNOSTICS_SQL = f"""
WITH RECURSIVE {EDITION.strip()},
per AS (SELECT r.source_id, count(*) AS n FROM chosen c JOIN ranked r ON r.story_id = c.story_id GROUP BY r.source_id)
SELECT (SELECT count(*) FROM candidates) AS candidate_count, (SELECT count(DISTINCT nullif(source_id, '')) FROM candidates) AS available_source_count,
       CAST(sum(n) AS BIGINT) AS selected_count, count(*) AS selected_source_count, string_agg(source_id || '=' || n, ',' ORDER BY source_id) AS source_counts,
       12 AS target_items, 2 AS max_items_per_source FROM per
"""


def edition_html(spark, d):
    chosen = selection.select_stories(_candidates(spark, d), 12, 2)
    return sinks.edition_html(chosen, "The Broadsheet & Co", "2024-01-05", logo="https://news.example/logo.png?a=1&b")


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_BYLINE = "source_name || ' · ' || coalesce(strftime(CAST(substr(published_at, 1, 19) AS TIMESTAMP) + INTERVAL 330 MINUTE, '%d %b · %H:%M') || ' IST', '')"
HTML_SQL = f"""
WITH RECURSIVE {EDITION.strip()},
sections AS (SELECT unnest(['National', 'Politics', 'Business & Economy', 'Technology & Science', 'World', 'Sports', 'Other']) AS section, unnest(range(1, 8)) AS rank),
rows AS (
  SELECT s.rank, r.section, c.position, r.source_id, r.source_name, r.url,
         '<article><h3><a href="' || {_ESCAPED.format("url")} || '">' || {_ESCAPED.format("headline")} || '</a></h3><p>' || {_ESCAPED.format("summary")} || '</p><p>'
         || {_ESCAPED.format(_BYLINE)} || ' · ' || article_count || CASE WHEN article_count = 1 THEN ' report' ELSE ' reports' END || '</p></article>' AS b
  FROM chosen c JOIN ranked r ON r.story_id = c.story_id JOIN sections s ON s.section = r.section),
parts AS (
  SELECT rank, '<section><h2>' || {_ESCAPED.format("any_value(section)")} || '</h2><p>' || count(*) || CASE WHEN count(*) = 1 THEN ' story' ELSE ' stories' END || '</p>' || chr(10)
         || string_agg(b, chr(10) ORDER BY position) || chr(10) || '</section>' AS part FROM rows GROUP BY rank),
labels AS (SELECT source_name, url, position FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_name) ORDER BY position) AS n FROM rows) WHERE n = 1)
SELECT '<!doctype html><title>The Broadsheet &amp; Co</title><img alt="" src="https://news.example/logo.png?a=1&amp;b"><h1>The Broadsheet &amp; Co</h1><p>05 January 2024</p><p>'
  || (SELECT count(*) || ' stories · ' || count(DISTINCT source_id) || ' publishers' FROM rows) || '</p>' || chr(10) || (SELECT string_agg(part, chr(10) ORDER BY rank) FROM parts) || chr(10)
  || '<h2>Sources in this edition</h2><ul>' || (SELECT string_agg('<li><a href="' || {_ESCAPED.format("url")} || '">' || {_ESCAPED.format("source_name")} || '</a></li>', '' ORDER BY position) FROM labels)
  || '</ul>' || chr(10) || '<p>Reply to this email to unsubscribe.</p>' || chr(10) AS html
"""


def daily_edition(spark, d):
    """The whole run: articles to stories to an edition with fallback rewrites."""
    return daily.edition_of(daily.stories_of(articles(spark, d))["stories"]).select("position", "story_id", "section", "source_id", "article_count")


# All rewrites are in one section and the preselection keeps the cap, so new publishers come first and then the rest in order.
DAILY_SQL = f"""
WITH {ARTICLES.strip()},
made AS ({STORIES_SQL}),
rows AS (SELECT m.*, a.source_id, a.published_at FROM made m JOIN articles a ON a.article_id = m.representative_article_id),
first AS (SELECT *, row_number() OVER (ORDER BY article_count DESC, source_count DESC, coalesce(latest_published_at, '') DESC, coalesce(confidence, 0) DESC, story_id DESC) AS r FROM rows),
likely AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY r) AS n FROM first) WHERE n <= 3 ORDER BY r LIMIT 10),
again AS (SELECT *, row_number() OVER (ORDER BY article_count DESC, source_count DESC, coalesce(published_at, '') DESC, coalesce(confidence, 0) DESC, story_id DESC) AS k FROM likely),
heads AS (SELECT story_id FROM (SELECT story_id, k, row_number() OVER (PARTITION BY source_id ORDER BY k) AS n FROM again) WHERE n = 1 ORDER BY k LIMIT 4)
SELECT row_number() OVER (ORDER BY h.story_id IS NULL, a.k) AS position, a.story_id, 'Other' AS section, a.source_id, a.article_count
FROM again a LEFT JOIN heads h ON h.story_id = a.story_id
"""


# --- totals of a run ------------------------------------------------------------------------------------------------


def run_summary(spark, d):
    made = daily.stories_of(articles(spark, d))
    return ingest.normalization_summary(made["extractions"], made["scored"], cut(made["stories"]))


SUMMARY_SQL = STORIES_SQL.rpartition("SELECT story_id, representative")[0] + """
SELECT CAST(0 AS BIGINT) AS extraction_failures, (SELECT count(*) FROM pairs) AS candidate_pairs, (SELECT count(*) FROM acc) AS accepted_pairs, count(*) AS stories,
       count(*) FILTER (source_count > 1) AS multi_source, count(*) FILTER (article_count = 1) AS singletons FROM s
"""


def debug_totals(spark, d):
    made = daily.stories_of(articles(spark, d))
    debug = stories.debug_stories(cut(made["stories"]), made["items"], made["extractions"], made["accepted"])
    return stories.debug_totals(debug, made["accepted"])


DEBUG_SQL = STORIES_SQL.rpartition("SELECT story_id, representative")[0] + """
SELECT count(*) FILTER (article_count > 1) AS story_count, CAST(coalesce(sum(article_count) FILTER (article_count > 1), 0) AS BIGINT) AS article_count,
       (SELECT count(*) FROM acc JOIN assigned x ON x.rk = ra JOIN assigned y ON y.rk = rb WHERE x.seed = y.seed) AS accepted_pairs_inside, (SELECT count(*) FROM acc) AS accepted_pairs FROM s
"""


# --- answers of models ----------------------------------------------------------------------------------------------

#: Answers of an extractor, by the article's number modulo their number, and what must become of them.
ANSWERS = (
    ('{"entities": [{"text": "Acme  Corp", "canonical_name": "ACME", "type": "org", "role": "PRIMARY"}, {"text": "acme", "canonical_name": "acme", "type": "ORG"}]}', "Acme Corp|ACME|ORG|primary", None),
    ('{"entities": [{"canonical_name": "No text"}, {"text": " Straße ", "role": "hero"}, {"text": "STRASSE"}, 5, "x", null, ["y"]]}', "Straße|Straße|OTHER|secondary", None),
    ('{"entities": []}', "", None),
    ('{"entities": {"text": "x"}}', "", "the answer has no list of entities"),
    ('[{"text": "x"}]', "", "the answer has no list of entities"),
    ("{broken", "", "the answer is no JSON"),
    ('{"other": 1, "entities": [{"text": 7, "type": "law", "extra": [1]}]}', "7|7|LAW|secondary", None),
    (None, "", "ValueError: no answer"),
)


def _make_extractor():
    answers = [a for a, _, _ in ANSWERS]

    def call(title: str, description: str) -> str:
        answer = answers[int(title) % len(answers)]
        if answer is None:
            raise ValueError("no answer")
        return answer

    return call


def entity_parse(spark, d):
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.col("doc_id").cast("string").alias("title"), F.col("source").alias("description"))
    got = plugins.extractions(items, _make_extractor, "m")
    listed = F.array_join(F.transform("entities", lambda e: F.concat_ws("|", e["text"], e["canonical_name"], e["type"], e["role"])), ";")
    return got.select("article_id", "status", listed.alias("entities"), "error")


def _sql(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


PARSE_SQL = f"""
WITH a AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_sql(e)}, {_sql(x)})" for i, (_, e, x) in enumerate(ANSWERS))}) t(k, entities, error))
SELECT CAST(doc_id AS VARCHAR) AS article_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, entities, error FROM documents JOIN a ON doc_id % {len(ANSWERS)} = k
"""


def _rewritten(spark, d):
    k = F.col("ord") % 6
    whole = F.to_json(F.struct(F.concat(F.lit(" Head \n "), F.col("ord").cast("string")).alias("headline"), F.concat(F.lit("Sum\t"), "source_id").alias("summary"), F.when(k == 1, "Gossip").otherwise("World").alias("section")))
    raw = F.when(k == 2, "{no json").when(k == 3, '{"headline": "only", "section": "World"}').when(k == 4, "[1]").otherwise(whole)
    rows = articles(spark, d).select("ord", T.parse_rewrite(raw).alias("got"), T.fallback_rewrite(F.col("article_id"), F.col("source_id")).alias("plain"))
    final = F.coalesce("got", "plain")
    return rows.select("ord", final.headline.alias("headline"), final.summary.alias("summary"), final.section.alias("section"), F.when(F.col("got").isNotNull(), "ok").otherwise("fallback").alias("status"))


def rewrite_parse(spark, d):
    return _rewritten(spark, d)


REWRITTEN = ARTICLES + """,
rewritten AS (
  SELECT ord, CASE WHEN ok THEN 'Head ' || ord ELSE article_id END AS headline, CASE WHEN ok THEN 'Sum ' || source_id ELSE source_id END AS summary,
         CASE WHEN ok THEN 'World' ELSE 'Other' END AS section, CASE WHEN ok THEN 'ok' ELSE 'fallback' END AS status FROM (SELECT *, ord % 6 IN (0, 5) AS ok FROM articles))"""


def fallback_count(spark, d):
    return selection.fallback_count(_rewritten(spark, d))


def story_prompts(spark, d):
    rows = articles(spark, d)
    record = lambda *c: F.struct(*[F.col(x) for x in ("title", "source_id", *c)], F.col("url").alias("description"))
    named = F.when(F.col("ord") % 2 == 0, F.col("source_name")).alias("source_name")
    both = F.array(record("source_name"), F.struct("title", "source_id", named, F.concat("url", F.lit("  \n x")).alias("description")))
    return rows.select("ord", T.story_prompt(F.col("article_id"), both).alias("prompt"))


PROMPT_SQL = f"""
WITH {ARTICLES.strip()}
SELECT ord, concat_ws(chr(10) || chr(10), 'Story ID: ' || article_id, 'Contributing RSS records:',
  '1. Publisher: ' || source_name || chr(10) || 'Title: ' || substr(title, 1, 240) || chr(10) || 'Description: ' || url,
  '2. Publisher: ' || CASE WHEN ord % 2 = 0 THEN source_name ELSE source_id END || chr(10) || 'Title: ' || substr(title, 1, 240) || chr(10) || 'Description: ' || url || ' x') AS prompt FROM articles
"""


def escaped(spark, d):
    text = F.concat("url", F.lit("<\"'>&"), F.coalesce(F.substring("html", 1, 50), F.lit("")))
    return table(spark, d, "pages").select("page_id", T.html_escape(text).alias("escaped"), T.data_uri(F.encode("url", "UTF-8")).alias("uri"))


ESCAPED_SQL = f"""
SELECT page_id, {_ESCAPED.format("url || '<\"''>&' || coalesce(substr(html, 1, 50), '')")} AS escaped, 'data:image/png;base64,' || base64(encode(url)) AS uri FROM pages
"""


def tags_json(spark, d):
    k = F.col("event_id") % 5
    tags = F.when(k == 0, F.to_json(F.array("event_type", F.lit("é"), F.col("event_id").cast("string"), F.lit("b"), F.lit("c"), F.lit("d")))).when(k == 1, "[]").when(k == 2, '{"a": 1}').when(k == 3, "[broken")
    rows = table(spark, d, "events").select("event_id", tags.alias("tags"))
    return rows.select("event_id", F.size(T.safe_tags(F.col("tags"))).alias("n_tags"), F.array_join(annotate.display_tags(F.col("tags")), "|").alias("shown"))


TAGS_SQL = """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 6 ELSE 0 END AS n_tags, CASE WHEN event_id % 5 = 0 THEN event_type || '|é|' || event_id || '|b' ELSE '' END AS shown FROM events
"""


# --- workbench ------------------------------------------------------------------------------------------------------


def source_counts(spark, d):
    return annotate.source_counts(articles(spark, d))


def latest_run(spark, d):
    return annotate.latest_run(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("manifest")))


def article_lookup(spark, d):
    rows = articles(spark, d).withColumn("run_id", F.col("ord") % 2)
    return annotate.article(rows, "a000000010").unionByName(annotate.article(rows, "a000000011", run=1)).unionByName(annotate.article(rows, "a000000012", run=1)).select("article_id", "title", "run_id")


def reference_annotations(spark, d):
    marks = _marks(spark, d)
    return annotate.saved_annotations(marks.withColumn("reference_article_id", F.concat(F.lit("r"), (F.col("id") % 3).cast("string"))), articles(spark, d), "r1").select("id", "title_a", "title_b", "updated_at")


REFERENCE_SQL = f"""
WITH {MARKS.strip()}
SELECT m.id, x.title AS title_a, y.title AS title_b, m.updated_at FROM marks m JOIN articles x ON x.article_id = m.article_id_a JOIN articles y ON y.article_id = m.article_id_b WHERE m.id % 3 = 1
"""


def import_split(spark, d):
    rows = articles(spark, d).select(F.when(F.col("ord") % 5 != 0, F.col("article_id")).otherwise(" ").alias("article_id"), F.when(F.col("ord") % 7 != 0, F.col("title")).alias("title"), "ord")
    good, bad = annotate.split_imports(rows)
    return good.select("ord", F.lit("ok").alias("state")).unionByName(bad.select("ord", F.lit("invalid").alias("state")))


SPLIT_SQL = f"""
WITH {ARTICLES.strip()} SELECT ord, CASE WHEN ord % 5 <> 0 AND ord % 7 <> 0 AND trim(title, ' ') <> '' THEN 'ok' ELSE 'invalid' END AS state FROM articles
"""


def batch_check(spark, d):
    """What is wrong with batches of annotations: all that are saved, and the same with one thing changed at a time."""
    rows, marks = articles(spark, d).select("article_id"), _marks(spark, d).select("article_id_a", "article_id_b", "label")
    known = cut(marks.join(rows.withColumnRenamed("article_id", "article_id_a"), "article_id_a", "left_semi").join(rows.withColumnRenamed("article_id", "article_id_b"), "article_id_b", "left_semi"))
    batches = {
        "known": known,
        "label": known.withColumn("label", F.concat("label", F.lit("!"))),
        "self": known.withColumn("article_id_b", F.col("article_id_a")),
        "unknown": known.withColumn("article_id_b", F.concat("article_id_b", F.lit("x"))),
        "null label": known.withColumn("label", F.lit(None).cast("string")),
    }
    found = [(name, "; ".join(annotate.check_batch(batch, rows))) for name, batch in batches.items()]
    return spark.createDataFrame(found, "batch string, problems string")


BATCH_SQL = f"""
WITH {MARKS.strip()},
known AS (SELECT article_id_a AS a, article_id_b AS b, label FROM marks WHERE article_id_a IN (SELECT article_id FROM articles) AND article_id_b IN (SELECT article_id FROM articles)),
batches AS (
  SELECT 'known' AS batch, * FROM known UNION ALL SELECT 'label', a, b, label || '!' FROM known UNION ALL SELECT 'self', a, a, label FROM known
  UNION ALL SELECT 'unknown', a, b || 'x', label FROM known UNION ALL SELECT 'null label', a, b, NULL FROM known)
SELECT batch, concat_ws('; ', CASE WHEN bool_or(label IS NULL OR label NOT IN ('same_story', 'related', 'opposite', 'unrelated', 'unclear')) THEN 'unknown label' END,
  CASE WHEN bool_or(a = b) THEN 'an article paired with itself' END,
  CASE WHEN bool_or(a NOT IN (SELECT article_id FROM articles) OR b NOT IN (SELECT article_id FROM articles)) THEN 'unknown article' END) AS problems FROM batches GROUP BY batch
"""


def queries() -> dict:
    names = (
        editions, edition_status, selection_diagnostics, edition_html, daily_edition, run_summary, debug_totals, entity_parse, rewrite_parse, fallback_count, story_prompts, escaped, tags_json,
        source_counts, latest_run, article_lookup, reference_annotations, import_split, batch_check,
    )
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {
        "editions": EDITIONS_SQL,
        "edition_status": STATUS_SQL,
        "selection_diagnostics": DIAGNOSTICS_SQL,
        "edition_html": HTML_SQL,
        "daily_edition": DAILY_SQL,
        "run_summary": SUMMARY_SQL,
        "debug_totals": DEBUG_SQL,
        "entity_parse": PARSE_SQL,
        "rewrite_parse": f"WITH {REWRITTEN.strip()} SELECT * FROM rewritten",
        "fallback_count": f"WITH {REWRITTEN.strip()} SELECT count(*) FILTER (status = 'fallback') AS fallback_count FROM rewritten",
        "story_prompts": PROMPT_SQL,
        "escaped": ESCAPED_SQL,
        "tags_json": TAGS_SQL,
        "source_counts": "SELECT source AS source_id, count(*) AS n FROM documents GROUP BY source",
        "latest_run": "SELECT o_orderkey AS id, o_custkey AS manifest FROM orders ORDER BY o_orderkey DESC LIMIT 1",
        "article_lookup": f"WITH {ARTICLES.strip()} SELECT article_id, title, ord % 2 AS run_id FROM articles WHERE article_id IN ('a000000010', 'a000000011')",
        "reference_annotations": REFERENCE_SQL,
        "import_split": SPLIT_SQL,
        "batch_check": BATCH_SQL,
    }
