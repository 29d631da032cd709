"""Named queries over the driver's tables and the SQL that must give the same rows.

The article view: title is the first line of a document's text, description the rest (the title if that is blank), source_id
its source, ord its id, published_at the time of the event with that id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import plugins, schemas
from broadsheet.functions import text as T
from broadsheet.operators import annotate, greedy, ingest, selection, stories
from broadsheet.plans import daily
from broadsheet.session import ship
from broadsheet.sources import sinks


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _untimed(spark: SparkSession, d: str) -> DataFrame:
    """The article view without its times."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    title = F.substring_index("text", "\n", 1)
    rest = F.when(F.instr("text", "\n") > 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise("")
    return docs.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("article_id"), F.col("source").alias("source_id"),
        F.upper("source").alias("source_name"), F.col("lang").alias("scope"), title.alias("title"), F.when(F.trim(rest) == "", title).otherwise(rest).alias("description"),
        F.concat(F.lit("https://news.example/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
    )


def _timed(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Puts published_at to rows with ``ord``. What is narrower than its texts should be made before, as the rows are shuffled here."""
    times = table(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("published_at"))
    return rows.join(times, "ord", "left")


def articles(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d, _untimed(spark, d)).select("ord", "article_id", "source_id", "source_name", "scope", "title", "description", "published_at", "url")


ARTICLES = r"""
articles AS (
  SELECT doc_id AS ord, 'a' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS article_id, source AS source_id, upper(source) AS source_name, lang AS scope, title,
         CASE WHEN trim(rest, ' ') = '' THEN title ELSE rest END AS description, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_at,
         'https://news.example/' || source || '/' || doc_id AS url
  FROM (SELECT doc_id, lang, source, split_part(text, chr(10), 1) AS title, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS rest FROM documents)
  LEFT JOIN events ON event_id = doc_id)"""


# --- functions ------------------------------------------------------------------------------------------------------


def url_canonical(spark, d):
    rows = table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))
    return rows.withColumn("article_id", T.article_id(F.col("url")))


URL_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$', ['scheme', 'host', 'path', 'query']) AS u, trim(url) AS raw FROM pages),
q AS (
  SELECT page_id, raw, u, list_sort(list_filter(list_transform(list_filter(string_split(u.query, '&'), lambda s: s <> ''),
      lambda s: {'k': url_decode(replace(split_part(s, '=', 1), '+', ' ')), 'v': CASE WHEN instr(s, '=') > 0 THEN url_decode(replace(substr(s, instr(s, '=') + 1), '+', ' ')) ELSE '' END}),
      lambda x: lower(x.k) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid') AND NOT starts_with(lower(x.k), 'utm_'))) AS params FROM p),
e AS (
  SELECT page_id, raw, u, array_to_string(list_transform(params, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS query FROM q),
f AS (
  SELECT page_id, CASE WHEN u.scheme <> '' AND u.host <> '' THEN lower(u.scheme) || '://' || lower(u.host) || CASE WHEN u.path = '' THEN '/' ELSE u.path END
      || CASE WHEN query = '' THEN '' ELSE '?' || query END ELSE raw END AS url FROM e)
SELECT page_id, url, 'article-' || substr(sha256(url), 1, 24) AS article_id FROM f
"""


def title_key(spark, d):
    return articles(spark, d).select("ord", T.title_key(F.col("title"), unescaped=True).alias("title_key"))


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text_sql(F.col("html")).alias("text"))


HTML_SQL = r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS text FROM pages
"""


def html_tokens(spark, d):
    return table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def published_norm(spark, d):
    ts = table(spark, d, "events").select("event_id", F.date_format("ts", "dd MMM yyyy HH:mm:ss").alias("t"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("i"))
    mail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Mon, "), "t", F.lit(" GMT"))).when(F.col("event_id") % 3 == 1, F.concat("t", F.lit(" +0530"))).otherwise(F.concat("i", F.lit("Z")))
    rows = ts.withColumn("published_at", T.normal_datetime(mail))
    return rows.select("event_id", "published_at", T.published_text(F.col("published_at")).alias("shown"), T.pretty_date(F.col("published_at")).alias("pretty"))


PUBLISHED_SQL = r"""
WITH t AS (SELECT event_id, date_trunc('second', ts) - CASE WHEN event_id % 3 = 1 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END AS ts FROM events)
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS published_at, strftime(ts + INTERVAL 330 MINUTE, '%d %b · %H:%M') || ' IST' AS shown,
       strftime(ts, '%d %b %Y · %H:%M') AS pretty FROM t
"""


def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int").k.cast("long").alias("k"))


# --- dedup and ingestion --------------------------------------------------------------------------------------------


def _keyed(spark, d):
    return articles(spark, d).select("ord", T.title_key(F.col("title"), unescaped=True).alias("k1"), F.md5("description").alias("k2"), "source_id")


def greedy_dedup(spark, d):
    return greedy.first_by_two_keys(_keyed(spark, d), "ord", "k1", "k2").select("ord")


KEYED = ARTICLES + r""",
keyed AS (
  SELECT ord, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ') AS k1, md5(description) AS k2, source_id FROM articles),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ord) AS rn FROM keyed)"""

DEDUP_SQL = f"""
WITH RECURSIVE {KEYED.strip()},
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS s1, CAST([] AS VARCHAR[]) AS s2, CAST(NULL AS BIGINT) AS kept
  UNION ALL
  SELECT n.rn, CASE WHEN ok THEN list_append(s1, k1) ELSE s1 END, CASE WHEN ok THEN list_append(s2, k2) ELSE s2 END, CASE WHEN ok THEN ord END
  FROM (SELECT n.rn, n.ord, n.k1, n.k2, w.s1, w.s2, NOT list_contains(w.s1, n.k1) AND NOT list_contains(w.s2, n.k2) AS ok FROM walk w JOIN numbered n ON n.rn = w.rn + 1) n)
SELECT kept AS ord FROM walk WHERE kept IS NOT NULL
"""


def source_dedup(spark, d):
    return greedy.first_by_two_keys(_keyed(spark, d).withColumn("row", F.struct("source_id", "ord")), "row", "k1", "k2", ["source_id"]).select("ord.source_id", "ord.ord")


SOURCE_DEDUP_SQL = f"""
WITH RECURSIVE {KEYED.strip()},
mine AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ord) AS n FROM keyed),
walk AS (
  SELECT DISTINCT source_id, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS s1, CAST([] AS VARCHAR[]) AS s2, CAST(NULL AS BIGINT) AS kept FROM mine
  UNION ALL
  SELECT source_id, n, CASE WHEN ok THEN list_append(s1, k1) ELSE s1 END, CASE WHEN ok THEN list_append(s2, k2) ELSE s2 END, CASE WHEN ok THEN ord END
  FROM (SELECT m.*, w.s1, w.s2, NOT list_contains(w.s1, m.k1) AND NOT list_contains(w.s2, m.k2) AS ok FROM walk w JOIN mine m ON m.source_id = w.source_id AND m.n = w.n + 1))
SELECT source_id, kept AS ord FROM walk WHERE kept IS NOT NULL
"""


def first_wins_dedup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return ingest.first_wins(rows, "h", "doc_id")[0].select("doc_id")


def feed_limit(spark, d):
    return ingest.prefix_limit(table(spark, d, "documents").select("doc_id", "source"), "source", 20, "doc_id")


def run_rollup(spark, d):
    per = table(spark, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count("*").alias("item_count"), (F.count("*") - F.count_distinct("text")).alias("duplicate_count"))
    return ingest.run_rollup(per.withColumn("status", F.when(F.col("duplicate_count") > 3, "failed").otherwise("ok")))


RUN_SQL = """
WITH p AS (SELECT source, count(*) AS n, count(*) - count(DISTINCT text) AS dup FROM documents GROUP BY source),
s AS (SELECT *, CASE WHEN dup > 3 THEN 'failed' ELSE 'ok' END AS status FROM p)
SELECT count(*) FILTER (status = 'ok') AS source_count_ok, count(*) FILTER (status <> 'ok') AS source_count_failed, CAST(sum(n) AS BIGINT) AS item_count,
       CAST(sum(dup) AS BIGINT) AS duplicate_count,
       CASE WHEN count(*) FILTER (status <> 'ok') = 0 THEN 'ok' WHEN count(*) FILTER (status = 'ok') > 0 THEN 'partial' ELSE 'failed' END AS status FROM s
"""


def valid_items(spark, d):
    docs = table(spark, d, "documents")
    line = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 == 0, "[1, 2]").otherwise(
        F.to_json(
            F.struct(
                F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit("a"), "doc_id")).alias("article_id"), F.col("source").alias("source_id"), F.col("source").alias("source_name"),
                F.concat(F.lit("t"), "doc_id").alias("title"), F.lit("").alias("description"), F.lit("2024-01-01").alias("published_at"), F.lit("u").alias("url"),
            )
        )
    )
    raw = docs.select(F.col("source").alias("source_id"), F.col("doc_id").alias("line"), line.alias("value"))
    items, invalid = ingest.valid_items(raw)
    counts = items.groupBy("source_id").agg(F.count("*").alias("valid_count"), F.max("line").alias("last_line"))
    counts = invalid.join(counts, "source_id", "left")
    return counts.select("source_id", F.coalesce("valid_count", F.lit(0)).alias("valid_count"), "last_line", "invalid_count")


VALID_SQL = """
WITH v AS (SELECT source AS source_id, doc_id AS line, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 7 <> 0 AS ok FROM documents)
SELECT source_id, count(*) FILTER (ok) AS valid_count, max(line) FILTER (ok) AS last_line, count(*) FILTER (NOT ok) AS invalid_count FROM v GROUP BY source_id
"""


def cache_split(spark, d):
    items = articles(spark, d).select("article_id", T.input_fingerprint(F.col("title"), F.col("description")).alias("input_fingerprint"))
    changed = F.when(F.substring("article_id", -1, 1) == "3", F.lit("old")).otherwise(F.col("input_fingerprint"))
    cache = items.where(F.substring("article_id", -1, 1) != "7").select("article_id", changed.alias("input_fingerprint"), F.lit("m").alias("model"))
    hits, misses = ingest.cache_split(items, cache, "m")
    return hits.select("article_id", F.lit("hit").alias("state")).unionByName(misses.select("article_id", F.lit("miss").alias("state")))


def tag_dedup(spark, d):
    tags = T.distinct_tags(F.split("text", r"[ \n]+"))
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"))


TAG_SQL = r"""
WITH w AS (SELECT doc_id, string_split_regex(text, '[ \n]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS tag, unnest(range(1, len(w) + 1)) AS i FROM w),
c AS (SELECT doc_id, tag, i, row_number() OVER (PARTITION BY doc_id, lower(tag) ORDER BY i) AS n FROM t WHERE tag <> '')
SELECT w.doc_id, coalesce(string_agg(tag, '|' ORDER BY i) FILTER (n = 1), '') AS tags FROM w LEFT JOIN c ON w.doc_id = c.doc_id GROUP BY w.doc_id
"""


# --- pairs and stories ----------------------------------------------------------------------------------------------


def _entities(spark, d):
    return articles(spark, d).select("ord", plugins.offline_entities(F.concat_ws("\n", "title", "description")).alias("entities"))


def entity_pairs(spark, d):
    rows = stories.entity_pairs(_entities(spark, d))
    return rows.select("a", "b", F.array_join("shared_entities", ",").alias("shared_entities"), "entity_score")


def any_entity_pairs(spark, d):
    rows = stories.entity_pairs(_entities(spark, d), require_primary=False)
    return rows.select("a", "b", F.array_join("shared_entities", ",").alias("shared_entities"), "entity_score")


ENTITIES = ARTICLES + r""",
e AS MATERIALIZED (SELECT DISTINCT ord, unnest(regexp_extract_all(lower(title || chr(10) || description), '[a-z]{9,}')) AS e FROM articles),
n AS (SELECT ord, count(*) AS n FROM e GROUP BY ord),
blocks AS (SELECT DISTINCT x.ord AS a, y.ord AS b FROM e x JOIN e y ON x.e = y.e AND x.ord < y.ord WHERE length(x.e) >= 12 AND length(x.e) % 6 <> 5),
pairs AS MATERIALIZED (
  SELECT a, b, string_agg(x.e, ',' ORDER BY x.e) AS shared_entities, count(*) / CAST(least(any_value(na.n), any_value(nb.n)) AS DOUBLE) AS entity_score
  FROM blocks JOIN e x ON x.ord = a JOIN e y ON y.ord = b AND x.e = y.e JOIN n na ON na.ord = a JOIN n nb ON nb.ord = b GROUP BY a, b)"""

ANY_SQL = f"""
WITH {ARTICLES.strip()},
e AS MATERIALIZED (SELECT DISTINCT ord, unnest(regexp_extract_all(lower(title || chr(10) || description), '[a-z]{{9,}}')) AS e FROM articles),
n AS (SELECT ord, count(*) AS n FROM e GROUP BY ord)
SELECT x.ord AS a, y.ord AS b, string_agg(x.e, ',' ORDER BY x.e) AS shared_entities, count(*) / CAST(least(any_value(na.n), any_value(nb.n)) AS DOUBLE) AS entity_score
FROM e x JOIN e y ON x.e = y.e AND x.ord < y.ord JOIN n na ON na.ord = x.ord JOIN n nb ON nb.ord = y.ord GROUP BY x.ord, y.ord
"""


def _scored(spark, d):
    text = T.article_text(F.col("title"), F.col("description")).alias("text")
    rows = articles(spark, d).select("ord", plugins.offline_entities(F.concat_ws("\n", "title", "description")).alias("entities"), text)
    return stories.score_pairs(stories.scored_pairs(rows, listed=False))


def pair_scores(spark, d):
    rows = _scored(spark, d)
    return rows.select("a", "b", "entity_score", *[F.round(c, 6).alias(c) for c in ("lexical_score", "final_score")], "accepted", "rejection_reason")


SCORED = ENTITIES + r""",
tok AS (SELECT ord, t, 1 + ln(count(*)) AS f FROM (SELECT ord, unnest(regexp_extract_all(lower('Title: ' || title || chr(10) || 'Description: ' || description), '[a-z0-9]+')) AS t FROM articles) GROUP BY ord, t),
w AS MATERIALIZED (SELECT ord, t, f / sqrt(sum(f * f) OVER (PARTITION BY ord)) AS w FROM tok),
scored AS MATERIALIZED (
  SELECT p.a, p.b, any_value(p.entity_score) AS entity_score, greatest(0.0, least(1.0, sum(x.w * y.w))) AS lexical_score,
         CAST(0.5 AS DOUBLE) * any_value(p.entity_score) + CAST(0.5 AS DOUBLE) * greatest(0.0, least(1.0, sum(x.w * y.w))) AS final_score
  FROM pairs p JOIN w x ON x.ord = p.a JOIN w y ON y.ord = p.b AND x.t = y.t GROUP BY p.a, p.b)"""

PAIR_SQL = f"""
WITH {SCORED.strip()}
SELECT a, b, entity_score, round(lexical_score, 6) AS lexical_score, round(final_score, 6) AS final_score, final_score >= 0.5 AS accepted,
       CASE WHEN final_score >= 0.5 THEN NULL ELSE 'below_merge_threshold' END AS rejection_reason FROM scored
"""


def star_stories(spark, d):
    rows = articles(spark, d)
    accepted = _scored(spark, d).where("accepted")
    name = lambda c: F.concat(F.lit("a"), F.lpad(F.col(c).cast("string"), 9, "0")).alias(c)
    made = stories.build_stories(rows, accepted.select(name("a"), name("b"), "final_score"))
    ids = F.array_join(F.transform("articles", lambda a: a.article_id), ",").alias("articles")
    return made.select("story_id", "representative_article_id", "latest_published_at", "source_count", "article_count", F.round("confidence", 4).alias("confidence"), ids)


STORY_SQL = f"""
WITH RECURSIVE {SCORED.strip()},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY length(description) DESC, coalesce(published_at, '') DESC, ord) AS rk FROM articles),
acc AS MATERIALIZED (
  SELECT x.rk AS ra, y.rk AS rb, final_score FROM scored JOIN ranked x ON x.ord = a JOIN ranked y ON y.ord = b WHERE final_score >= 0.5),
adj AS MATERIALIZED (SELECT ra AS r, rb AS o FROM acc UNION ALL SELECT rb, ra FROM acc),
near AS MATERIALIZED (SELECT k.rk, coalesce(list(a.o) FILTER (a.o < k.rk), CAST([] AS BIGINT[])) AS better FROM ranked k LEFT JOIN adj a ON a.r = k.rk GROUP BY k.rk),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS seeds, CAST(NULL AS BIGINT) AS seed
  UNION ALL
  SELECT n.rk, CASE WHEN len(list_intersect(n.better, w.seeds)) = 0 THEN list_append(w.seeds, n.rk) ELSE w.seeds END,
         CASE WHEN len(list_intersect(n.better, w.seeds)) = 0 THEN n.rk ELSE list_min(list_intersect(n.better, w.seeds)) END
  FROM walk w JOIN near n ON n.rk = w.rk + 1),
assigned AS MATERIALIZED (SELECT r.*, w.seed FROM ranked r JOIN walk w ON w.rk = r.rk WHERE w.rk > 0),
conf AS (SELECT x.seed, round(avg(final_score), 6) AS c FROM acc JOIN assigned x ON x.rk = ra JOIN assigned y ON y.rk = rb WHERE x.seed = y.seed GROUP BY x.seed),
s AS (
  SELECT seed, 'story-' || substr(sha256(string_agg(article_id, '|' ORDER BY article_id)), 1, 24) AS story_id, arg_min(article_id, rk) AS representative_article_id,
         max(published_at) AS latest_published_at, count(DISTINCT source_id) AS source_count, count(*) AS article_count, string_agg(article_id, ',' ORDER BY rk) AS articles
  FROM assigned GROUP BY seed)
SELECT story_id, representative_article_id, latest_published_at, source_count, article_count, round(c, 4) AS confidence, articles FROM s LEFT JOIN conf ON conf.seed = s.seed
"""


# --- selection ------------------------------------------------------------------------------------------------------


def _candidates(spark, d):
    kinds = F.array(*[F.lit(s) for s in schemas.SECTIONS])
    rows = _untimed(spark, d).select(
        F.concat(F.lit("story-"), "article_id").alias("story_id"), F.element_at(kinds, (F.col("ord") % 7 + 1).cast("int")).alias("section"), F.col("title").alias("headline"),
        F.substring("description", 1, 60).alias("summary"), "source_id", "source_name", "url", (F.length("description") % 5 + 1).cast("long").alias("article_count"),
        (F.col("ord") % 3 + 1).cast("long").alias("source_count"), (F.col("ord") % 10 / 10.0).alias("confidence"), (F.col("ord") % 16).alias("edition"), "ord",
    )
    return _timed(spark, d, rows).select(
        "story_id", "section", "headline", "summary", "source_id", "source_name", "published_at", "url", "article_count", "source_count", "confidence", "edition", "ord"
    )


CANDIDATES = ARTICLES + r""",
candidates AS MATERIALIZED (
  SELECT 'story-' || article_id AS story_id, ['National', 'Politics', 'Business & Economy', 'Technology & Science', 'World', 'Sports', 'Other'][CAST(ord % 7 + 1 AS INT)] AS section,
         title AS headline, substr(description, 1, 60) AS summary, source_id, source_name, published_at, url, CAST(length(description) % 5 + 1 AS BIGINT) AS article_count,
         CAST(ord % 3 + 1 AS BIGINT) AS source_count, (ord % 10) / CAST(10 AS DOUBLE) AS confidence, ord % 16 AS edition, ord FROM articles),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY article_count DESC, source_count DESC, coalesce(published_at, '') DESC, confidence DESC, story_id DESC) AS rk FROM candidates)"""


def quota_topk(spark, d):
    rows = selection.quota_top_k(_candidates(spark, d), selection.rank_order("published_at"), "source_id", 3, 40)
    return rows.select("story_id", "source_id", "article_count")


QUOTA_SQL = f"""
WITH {CANDIDATES.strip()},
q AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rk) AS n FROM ranked)
SELECT story_id, source_id, article_count FROM q WHERE n <= 3 ORDER BY rk LIMIT 40
"""


def select_edition(spark, d):
    return selection.select_stories(_candidates(spark, d), 12, 2).select("story_id", "source_id", "section", "position")


# With more sources than the goal and a cap of two, the choice is: the best of each of four sources, then one per section, then the rest.
EDITION = CANDIDATES + r""",
near AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, section ORDER BY rk) AS n FROM ranked) WHERE n <= 2),
steps AS MATERIALIZED (SELECT CAST(i AS INT) AS step, CASE WHEN i <= 4 THEN 1 WHEN i <= 11 THEN 2 ELSE 3 END AS pass,
          CASE WHEN i BETWEEN 5 AND 11 THEN ['National', 'Politics', 'Business & Economy', 'Technology & Science', 'World', 'Sports', 'Other'][i - 4] END AS want FROM range(1, 24) t(i)),
walk AS (
  SELECT 0 AS step, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS sources
  UNION ALL
  SELECT s.step, CASE WHEN p.id IS NULL THEN w.ids ELSE list_append(w.ids, p.id) END, CASE WHEN p.id IS NULL THEN w.sources ELSE list_append(w.sources, p.src) END
  FROM walk w JOIN steps s ON s.step = w.step + 1 LEFT JOIN LATERAL (
    SELECT arg_min(story_id, rk) AS id, arg_min(source_id, rk) AS src FROM near
    WHERE len(w.ids) < 12 AND NOT list_contains(w.ids, story_id) AND len(list_filter(w.sources, lambda x: x = source_id)) < 2
      AND (s.pass <> 1 OR NOT list_contains(w.sources, source_id)) AND (s.want IS NULL OR section = s.want)) p ON true),
chosen AS (SELECT unnest(ids) AS story_id, unnest(range(1, len(ids) + 1)) AS position FROM walk WHERE step = 23)"""

EDITION_SQL = f"""
WITH RECURSIVE {EDITION.strip()}
SELECT c.story_id, r.source_id, r.section, c.position FROM chosen c JOIN ranked r ON r.story_id = c.story_id
"""


def edition_text(spark, d):
    chosen = selection.select_stories(_candidates(spark, d), 12, 2)
    return sinks.edition_text(chosen, "The Broadsheet", "2024-01-05", "Source links open the original articles.")


TEXT_SQL = f"""
WITH RECURSIVE {EDITION.strip()},
sections AS (SELECT unnest(['National', 'Politics', 'Business & Economy', 'Technology & Science', 'World', 'Sports', 'Other']) AS section, unnest(range(1, 8)) AS rank),
rows AS (
  SELECT s.rank, r.section, c.position, concat_ws(chr(10), headline, summary, source_name || ' · ' || coalesce(strftime(CAST(substr(published_at, 1, 19) AS TIMESTAMP) + INTERVAL 330 MINUTE, '%d %b · %H:%M') || ' IST', ''), url, '') AS b
  FROM chosen c JOIN ranked r ON r.story_id = c.story_id JOIN sections s ON s.section = r.section),
parts AS (SELECT rank, upper(any_value(section)) || chr(10) || repeat('=', length(any_value(section))) || chr(10) || string_agg(b, chr(10) ORDER BY position) AS part FROM rows GROUP BY rank)
SELECT concat_ws(chr(10), 'THE BROADSHEET', '05 January 2024', '', string_agg(part, chr(10) ORDER BY rank), 'Source links open the original articles.', '') AS text FROM parts
"""


def source_list(spark, d):
    rows = _candidates(spark, d).withColumn("position", F.col("article_count") * 1_000_000 + F.col("ord"))
    return selection.source_list(rows.withColumn("source_name", F.when(F.col("edition") > 1, F.initcap("source_name"))))


SOURCE_LIST_SQL = f"""
WITH {CANDIDATES.strip()},
l AS (SELECT CASE WHEN edition > 1 THEN 'S' || lower(substr(source_name, 2)) ELSE source_id END AS label, article_count * 1000000 + ord AS ord FROM candidates)
SELECT label, ord FROM (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY ord) AS n FROM l) WHERE n = 1
"""


# --- annotation -----------------------------------------------------------------------------------------------------


def _marks(spark, d):
    """Labels as annotations: each labelled document is paired with its successor by the annotator of its parity."""
    labels = table(spark, d, "labels")
    kinds = F.array(*[F.lit(x) for x in schemas.PAIR_LABELS])
    name = lambda c: F.concat(F.lit("a"), F.lpad(c.cast("string"), 9, "0"))
    other = F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1)
    a, b = annotate.canonical_pair(name(F.col("doc_id")), name(other))
    return labels.select(
        F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("run_id"), a.alias("article_id_a"), b.alias("article_id_b"), name(F.col("doc_id")).alias("reference_article_id"),
        F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("label"), F.lit("").alias("notes"), F.when(F.col("doc_id") % 2 == 0, "local").otherwise("second").alias("annotator_id"),
        F.lit("2024-01-01T00:00:00+00:00").alias("created_at"), F.concat(F.lit("2024-02-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("updated_at"),
    )


MARKS = ARTICLES + r""",
raw AS (SELECT doc_id, 'a' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS me, 'a' || lpad(CAST(doc_id + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS VARCHAR), 9, '0') AS other FROM labels),
marks AS MATERIALIZED (
  SELECT doc_id AS id, CAST(1 AS BIGINT) AS run_id, least(me, other) AS article_id_a, greatest(me, other) AS article_id_b, me AS reference_article_id,
         ['same_story', 'related', 'opposite', 'unrelated', 'unclear'][CAST(doc_id % 4 + 1 AS INT)] AS label, '' AS notes,
         CASE WHEN doc_id % 2 = 0 THEN 'local' ELSE 'second' END AS annotator_id, '2024-01-01T00:00:00+00:00' AS created_at,
         '2024-02-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS updated_at FROM raw)"""


def reference_list(spark, d):
    return annotate.references(articles(spark, d), _marks(spark, d), search="th_s").select("article_id", "published_at", "annotation_count")


REFERENCE_SQL = f"""
WITH {MARKS.strip()}
SELECT a.article_id, a.published_at, count(m.id) AS annotation_count FROM articles a LEFT JOIN marks m ON m.reference_article_id = a.article_id
WHERE a.title ILIKE '%th_s%' OR a.description ILIKE '%th_s%' GROUP BY a.article_id, a.published_at
"""


def unlabeled(spark, d):
    return annotate.unlabeled(articles(spark, d), _marks(spark, d)).select("article_id")


def labeled(spark, d):
    return annotate.labeled(articles(spark, d), _marks(spark, d)).select("article_id")


def pair_lookup(spark, d):
    rows = annotate.candidates(articles(spark, d), _marks(spark, d), "a000000010", since="2024-01-01", search="e")
    return rows.select("article_id", "existing_label", "existing_updated_at")


PAIR_LOOKUP_SQL = f"""
WITH {MARKS.strip()}
SELECT a.article_id, m.label AS existing_label, m.updated_at AS existing_updated_at FROM articles a
LEFT JOIN marks m ON m.annotator_id = 'local' AND m.article_id_a = least(a.article_id, 'a000000010') AND m.article_id_b = greatest(a.article_id, 'a000000010')
WHERE a.article_id <> 'a000000010' AND a.published_at >= '2024-01-01' AND (a.title ILIKE '%e%' OR a.description ILIKE '%e%')
"""


def pair_titles(spark, d):
    return annotate.saved_annotations(_marks(spark, d), articles(spark, d)).select("id", "title_a", "title_b", "label")


PAIR_TITLES_SQL = f"""
WITH {MARKS.strip()}
SELECT m.id, x.title AS title_a, y.title AS title_b, m.label FROM marks m JOIN articles x ON x.article_id = m.article_id_a JOIN articles y ON y.article_id = m.article_id_b
"""


def label_counts(spark, d):
    return annotate.label_counts(_marks(spark, d))


LABEL_SQL = f"""
WITH {MARKS.strip()}
SELECT l.label, count(m.id) AS n FROM (VALUES ('same_story'), ('related'), ('opposite'), ('unrelated'), ('unclear')) l(label) LEFT JOIN marks m ON m.label = l.label GROUP BY l.label
"""


def progress(spark, d):
    return annotate.progress(articles(spark, d), _marks(spark, d))


PROGRESS_SQL = f"""
WITH {MARKS.strip()}, t AS (SELECT count(*) AS total FROM articles), l AS (SELECT count(DISTINCT reference_article_id) AS labeled, count(*) AS total_labels FROM marks)
SELECT total, labeled, greatest(total - labeled, 0) AS remaining, total_labels, round(100 * labeled / CAST(total AS DOUBLE), 1) AS percent FROM t, l
"""


def facets(spark, d):
    return annotate.facets(articles(spark, d), "source_id", "scope")


def candidate_filter(spark, d):
    rows = articles(spark, d).where(annotate.conditions(scope="en", since="2024-01-02", until="2024-01-20") & annotate.matches("ing", "title", "description") & (F.col("article_id") != "a000000001"))
    return rows.select("article_id", "source_id")


FILTER_SQL = f"""
WITH {ARTICLES.strip()}
SELECT article_id, source_id FROM articles WHERE scope = 'en' AND published_at >= '2024-01-02' AND published_at <= '2024-01-20'
AND (title ILIKE '%ing%' OR description ILIKE '%ing%') AND article_id <> 'a000000001'
"""


def upsert_pairs(spark, d):
    marks = _marks(spark, d)
    saved = marks.where(F.col("id") % 3 != 0)
    batch = marks.where((F.col("id") % 3 == 0) | (F.col("id") % 5 < 2)).select(  # every mark is in one of them at least
        "run_id", F.col("article_id_b").alias("article_id_a"), F.col("article_id_a").alias("article_id_b"), "reference_article_id", F.lit("related").alias("label"), F.lit("again").alias("notes"), "annotator_id", F.col("id").alias("ord")
    )
    return annotate.upsert_pairs(saved, batch, "2024-03-01").select("id", "article_id_a", "article_id_b", "annotator_id", "label", "notes", "created_at", "updated_at")


UPSERT_SQL = f"""
WITH {MARKS.strip()},
saved AS (SELECT * FROM marks WHERE id % 3 <> 0),
batch AS (SELECT run_id, article_id_a, article_id_b, annotator_id, 'related' AS label, 'again' AS notes, id AS ord FROM marks WHERE id % 3 = 0 OR id % 5 < 2),
j AS (
  SELECT s.id, coalesce(s.run_id, b.run_id) AS run_id, coalesce(s.article_id_a, b.article_id_a) AS article_id_a, coalesce(s.article_id_b, b.article_id_b) AS article_id_b,
         coalesce(s.annotator_id, b.annotator_id) AS annotator_id, coalesce(b.label, s.label) AS label, coalesce(b.notes, s.notes) AS notes, s.created_at,
         CASE WHEN b.label IS NOT NULL THEN '2024-03-01' ELSE s.updated_at END AS updated_at, b.ord
  FROM saved s FULL JOIN batch b ON s.run_id = b.run_id AND s.article_id_a = b.article_id_a AND s.article_id_b = b.article_id_b AND s.annotator_id = b.annotator_id)
SELECT CAST(coalesce(id, (SELECT max(id) FROM saved) + row_number() OVER (PARTITION BY id IS NULL ORDER BY ord)) AS BIGINT) AS id, article_id_a, article_id_b, annotator_id, label, notes,
       coalesce(created_at, '2024-03-01') AS created_at, updated_at FROM j
"""


def import_if_absent(spark, d):
    rows = articles(spark, d).withColumn("run_id", F.lit(1).cast("long"))
    return annotate.import_articles(rows.where(F.col("ord") % 3 == 0), rows.where((F.col("ord") % 3 != 0) | (F.col("ord") % 2 == 0))).select("article_id")


def nav_prev_next(spark, d):
    return annotate.neighbours(articles(spark, d), annotate.newest_first())


NAV_SQL = f"""
WITH {ARTICLES.strip()}
SELECT article_id, lag(article_id) OVER w AS previous_id, lead(article_id) OVER w AS next_id FROM articles WINDOW w AS (ORDER BY coalesce(published_at, '') DESC, article_id)
"""


def email_register(spark, d):
    c = table(spark, d, "customer")
    mail = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("")), F.when(F.col("c_custkey") % 9 == 0, " ").otherwise("@"), F.lit("Mail"), (F.col("c_nationkey") % 3).cast("string"), F.lit(".example "))
    requests = c.select(F.when(F.col("c_custkey") % 10 == 1, F.lit("same@mail.example")).otherwise(mail).alias("email"), F.col("c_custkey").alias("ord"))
    old = requests.where(F.col("ord") % 7 == 0).select("email")
    return annotate.register(old, requests)


EMAIL_SQL = r"""
WITH r AS (
  SELECT c_custkey AS ord, lower(trim(CASE WHEN c_custkey % 10 = 1 THEN 'same@mail.example' ELSE '  ' || replace(c_name, '#', '') || CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE '@' END || 'Mail' || (c_nationkey % 3) || '.example ' END)) AS email FROM customer),
o AS (SELECT DISTINCT email FROM r WHERE ord % 7 = 0),
f AS (SELECT r.*, o.email IS NOT NULL AS taken, row_number() OVER (PARTITION BY r.email ORDER BY ord) AS n FROM r LEFT JOIN o ON o.email = r.email)
SELECT ord, email, CASE WHEN NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$') OR length(email) > 254 THEN 'invalid' WHEN taken OR n > 1 THEN 'duplicate' ELSE 'created' END AS status FROM f
"""


# --- flagship -------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Articles to stories: dedup, entities, pairs, scores, clusters."""
    made = daily.stories_of(articles(spark, d))["stories"]
    return made.select("story_id", "representative_article_id", "latest_published_at", "source_count", "article_count", "confidence")


# Urls are all different here, so the two-key rule keeps the first of each title key.
STORIES_SQL = (
    STORY_SQL.replace("articles AS (\n  SELECT doc_id AS ord", "every AS (\n  SELECT doc_id AS ord", 1)
    .replace("e AS MATERIALIZED", "articles AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ') ORDER BY ord) AS k FROM every) WHERE k = 1),\ne AS MATERIALIZED", 1)
    .replace("round(c, 4) AS confidence, articles FROM s", "c AS confidence FROM s")
)


def queries() -> dict:
    names = (
        url_canonical, title_key, html_text, html_tokens, published_norm, props_json, greedy_dedup, source_dedup, first_wins_dedup, feed_limit, run_rollup, valid_items, cache_split, tag_dedup,
        entity_pairs, any_entity_pairs, pair_scores, star_stories, quota_topk, select_edition, edition_text, source_list, reference_list, unlabeled, labeled, pair_lookup,
        pair_titles, label_counts, progress, facets, candidate_filter, upsert_pairs, import_if_absent, nav_prev_next, email_register,
    )
    return {f.__name__: f for f in names} | {"stories": flagship}


def oracle_sql() -> dict[str, str]:
    return {
        "url_canonical": URL_SQL,
        "title_key": f"WITH {ARTICLES.strip()} SELECT ord, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' ') AS title_key FROM articles",
        "html_text": HTML_SQL,
        "published_norm": PUBLISHED_SQL,
        "props_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "greedy_dedup": DEDUP_SQL,
        "source_dedup": SOURCE_DEDUP_SQL,
        "first_wins_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
        "feed_limit": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20",
        "run_rollup": RUN_SQL,
        "valid_items": VALID_SQL,
        "cache_split": f"WITH {ARTICLES.strip()} SELECT article_id, CASE WHEN right(article_id, 1) IN ('3', '7') THEN 'miss' ELSE 'hit' END AS state FROM articles",
        "tag_dedup": TAG_SQL,
        "entity_pairs": f"WITH {ENTITIES.strip()} SELECT a, b, shared_entities, entity_score FROM pairs",
        "any_entity_pairs": ANY_SQL,
        "pair_scores": PAIR_SQL,
        "star_stories": STORY_SQL,
        "quota_topk": QUOTA_SQL,
        "select_edition": EDITION_SQL,
        "edition_text": TEXT_SQL,
        "source_list": SOURCE_LIST_SQL,
        "stories": STORIES_SQL,
        "reference_list": REFERENCE_SQL,
        "unlabeled": f"WITH {MARKS.strip()} SELECT article_id FROM articles WHERE NOT EXISTS (SELECT 1 FROM marks WHERE reference_article_id = article_id)",
        "labeled": f"WITH {MARKS.strip()} SELECT article_id FROM articles WHERE EXISTS (SELECT 1 FROM marks WHERE reference_article_id = article_id)",
        "pair_lookup": PAIR_LOOKUP_SQL,
        "pair_titles": PAIR_TITLES_SQL,
        "label_counts": LABEL_SQL,
        "progress": PROGRESS_SQL,
        "facets": f"WITH {ARTICLES.strip()} SELECT DISTINCT source_id, scope FROM articles",
        "candidate_filter": FILTER_SQL,
        "upsert_pairs": UPSERT_SQL,
        "import_if_absent": f"WITH {ARTICLES.strip()} SELECT article_id FROM articles WHERE ord % 3 <> 0",
        "nav_prev_next": NAV_SQL,
        "email_register": EMAIL_SQL,
    }
