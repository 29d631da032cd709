"""The data model: fixed schemas in DDL notation."""

from __future__ import annotations

FEED = "rank INT, source_id STRING, name STRING, url STRING, scope STRING, category STRING, item_limit INT"
ITEM = (
    "article_id STRING, source_id STRING, source_name STRING, scope STRING, category STRING, title STRING, description STRING, "
    "published_at STRING, url STRING, tags ARRAY<STRING>, ingested_at STRING"
)
ENTITY = "STRUCT<text: STRING, canonical_name: STRING, type: STRING, role: STRING>"
STORY_ARTICLE = "STRUCT<article_id: STRING, source_id: STRING, source_name: STRING, title: STRING, description: STRING, published_at: STRING, url: STRING>"
STORY = (
    "story_id STRING, representative_article_id STRING, representative_title STRING, representative_description STRING, "
    f"latest_published_at STRING, source_count BIGINT, article_count BIGINT, confidence DOUBLE, articles ARRAY<{STORY_ARTICLE}>"
)
REWRITE = "story_id STRING, headline STRING, summary STRING, section STRING, status STRING, model STRING, input_fingerprint STRING, error STRING"
MANIFEST = (
    "captured_at_utc STRING, category STRING, user_agent STRING, feeds ARRAY<STRUCT<id: STRING, name: STRING, url: STRING, feed_path: STRING, "
    "headers_path: STRING, http_status: INT, content_type: STRING, bytes: BIGINT, item_count: BIGINT>>, "
    "failures ARRAY<STRUCT<id: STRING, url: STRING, reason: STRING>>"
)
DELIVERY = "edition_date STRING, story_run_id STRING, status STRING, recipients BIGINT, at STRING"

#: Sections in the order of the edition.
SECTIONS = ("National", "Politics", "Business & Economy", "Technology & Science", "World", "Sports", "Other")
#: Labels of article pairs.
PAIR_LABELS = ("same_story", "related", "opposite", "unrelated", "unclear")
#: Entity types that can tell stories apart.
DISTINCTIVE_TYPES = ("PERSON", "ORG", "EVENT", "PRODUCT", "LAW")
#: Query keys that only track readers (besides those that begin with utm_).
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
