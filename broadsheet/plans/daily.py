"""The daily run as DataFrames: payloads to items, items to stories, stories to an edition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet import plugins
from broadsheet.functions import text as T
from broadsheet.operators import ingest, selection, stories
from broadsheet.session import cut
from broadsheet.sources import readers


@dataclass(frozen=True)
class Settings:
    """Limits and weights of a run; wrong ones raise. [FLT-13]"""

    entity_weight: float = 0.5
    lexical_weight: float = 0.5
    merge_threshold: float = 0.5
    require_primary: bool = True
    target_items: int = 10
    minimum_items: int = 5
    max_items_per_source: int = 3
    edition_date: str | None = None

    def __post_init__(self):
        if min(self.target_items, self.minimum_items, self.max_items_per_source) < 1:
            raise ValueError("limits must be at least 1")
        if self.minimum_items > self.target_items:
            raise ValueError("minimum_items is above target_items")
        if min(self.entity_weight, self.lexical_weight) < 0 or self.entity_weight + self.lexical_weight <= 0:
            raise ValueError("weights must not be negative or all zero")
        if not 0 <= self.merge_threshold <= 1:
            raise ValueError("merge_threshold must be within 0 and 1")
        if self.edition_date is not None:
            datetime.strptime(self.edition_date, "%Y-%m-%d")


def ingest_payloads(payloads: DataFrame, feeds: DataFrame, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """Items and the run's rollup of (source_id, payload) rows. [SRC-03 to SRC-05, ORD-01, AGG-01]"""
    parsed = cut(readers.entries(payloads))
    items, duplicates = ingest.normalize_entries(parsed.where("error IS NULL"), feeds, ingested_at)
    counts = items.groupBy("source_id").agg(F.count("*").alias("item_count"))
    asked = payloads.select("source_id").distinct()
    results = (
        asked.join(readers.failures(parsed), "source_id", "left").join(counts, "source_id", "left").join(duplicates, "source_id", "left")
        .select("source_id", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), F.coalesce("item_count", F.lit(0)).alias("item_count"), F.coalesce("duplicate_count", F.lit(0)).alias("duplicate_count"), "error")
    )
    return items, results


def stories_of(
    items: DataFrame, settings: Settings = Settings(), extractor: Callable | None = None, encoder: Callable | None = None, scorer: Callable | None = None
) -> dict[str, DataFrame]:
    """Items (with a unique ``ord``) to extractions, pairs and stories. scored: the pairs by ``ord``, without their articles' ids.

    Plug-ins, each made in the task: extractor (UDF-01); encoder: weights of a text (plugins.PairEncoder), or scorer: scores of
    pairs of texts (plugins.PairScorer), in place of the offline weights (UDF-02).
    """
    kept = cut(ingest.deduplicate_items(items))
    found = cut(plugins.extractions(kept, extractor))
    text = T.article_text(F.col("title"), F.col("description")).alias("text")
    texts = kept.select("article_id", "ord", text).join(found.select("article_id", "entities"), "article_id")
    if scorer:
        pairs = cut(stories.entity_pairs(texts, require_primary=settings.require_primary))
        pairs = pairs.join(stories.plugged_scores(pairs, texts, scorer), ["a", "b"])
    else:
        pairs = stories.scored_pairs(texts, settings.require_primary, encoder)
    scored = cut(stories.score_pairs(pairs, settings.entity_weight, settings.lexical_weight, settings.merge_threshold))
    ordered = kept.select("article_id", "ord", "source_id")
    left = ordered.select(F.col("ord").alias("a"), F.col("article_id").alias("article_id_a"), F.col("source_id").alias("source_id_a"))
    right = ordered.select(F.col("ord").alias("b"), F.col("article_id").alias("article_id_b"), F.col("source_id").alias("source_id_b"))
    named = lambda rows: rows.join(left, "a").join(right, "b").drop("a", "b")
    accepted = named(scored.where("accepted").select("a", "b", "final_score"))  # [FLT-10]
    accepted = cut(accepted.select(F.col("article_id_a").alias("a"), F.col("article_id_b").alias("b"), "final_score"))
    return {"items": kept, "extractions": found, "scored": scored, "pairs": named(scored), "accepted": accepted, "stories": stories.build_stories(kept, accepted)}


def edition_of(made: DataFrame, settings: Settings = Settings(), rewriter: Callable | None = None) -> DataFrame:
    """Stories to the chosen candidates of an edition; only preselected stories are rewritten."""
    likely = cut(selection.preselect(made, settings.target_items, settings.max_items_per_source))
    rewritten = cut(plugins.rewrites(likely, rewriter))
    candidates = selection.prepare_candidates(likely, rewritten)
    return selection.select_stories(candidates, settings.target_items, settings.max_items_per_source)
