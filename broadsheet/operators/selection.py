"""Ranked, quota-bound choice of stories for an edition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.functions import text as T
from broadsheet.session import cut

SOURCE_GOAL = 4


def _count(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit(0)), F.lit(1)).cast("long")


def rank_order(time_col: str) -> list[Column]:
    """Most articles, most sources, newest, most confident, largest id. [SRT-01 with latest_published_at, SRT-02 with published_at]"""
    return [
        _count("article_count").desc(), _count("source_count").desc(), T.order_time(F.coalesce(F.col(time_col), F.lit(""))).desc(),
        F.coalesce("confidence", F.lit(0.0)).desc(), F.coalesce("story_id", F.lit("")).desc(),
    ]


def representative(articles: Column, article_id: Column) -> Column:
    """The article with that id, else the first one. [JOIN-11]"""
    return F.coalesce(F.try_element_at(F.filter(articles, lambda a: a.article_id == article_id), F.lit(1)), F.try_element_at(articles, F.lit(1)))


def quota_top_k(df: DataFrame, order: list[Column], group: str, cap: int, k: int) -> DataFrame:
    """The k first rows in order, of which at most ``cap`` of a group. [ORD-05, LIM-03, WIN-01]"""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
    return ranked.orderBy(*order).limit(k)


def preselect(stories: DataFrame, target_items: int = 10, max_items_per_source: int = 3) -> DataFrame:
    """Stories worth rewriting. [ORD-05, SRT-01]"""
    rep = representative(F.col("articles"), F.col("representative_article_id"))
    rows = stories.withColumn("_rep", rep).withColumn("_source", F.coalesce("_rep.source_id", F.lit(""))).where(F.trim(F.coalesce("_rep.url", F.lit(""))) != "")
    return quota_top_k(rows, rank_order("latest_published_at"), "_source", max_items_per_source, target_items).drop("_rep", "_source")


def prepare_candidates(stories: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Stories with a rewrite as selection candidates. [JOIN-10, JOIN-11, PRJ-04]"""
    rep = representative(F.col("articles"), F.col("representative_article_id"))
    rows = stories.where(F.coalesce("story_id", F.lit("")) != "").join(rewrites.withColumnRenamed("error", "rewrite_error").withColumnRenamed("status", "rewrite_status"), "story_id")
    rows = rows.withColumn("rep", rep).withColumn("url", F.trim(F.coalesce("rep.url", F.lit("")))).where("url <> ''")

    def link(a: Column) -> Column:
        name = F.coalesce(F.nullif(a.source_name, F.lit("")), a.source_id, F.lit(""))
        return F.struct(
            name.alias("source_name"), F.coalesce(a.title, F.lit("")).alias("title"), F.coalesce(a.published_at, F.lit("")).alias("published_at"), F.trim(a.url).alias("url")
        )

    links = F.transform(F.filter("articles", lambda a: F.trim(F.coalesce(a.url, F.lit(""))) != ""), link)
    return rows.select(
        "story_id", "section", "headline", "summary", "rewrite_status", "rewrite_error", F.coalesce("rep.source_id", F.lit("")).alias("source_id"),
        F.coalesce("rep.source_name", F.lit("")).alias("source_name"), F.coalesce("rep.published_at", F.lit("")).alias("published_at"), "url",
        F.when(F.size(links) > 0, links).otherwise(F.array(link(F.col("rep")))).alias("articles"),
        _count("article_count").alias("article_count"), _count("source_count").alias("source_count"), "confidence",
    )


def choose(rows: list[tuple[str, str, str]], target: int, cap: int) -> list[str]:
    """Ids in the order of choice from ranked (story_id, source_id, section): new publishers, then sections, then the rest."""
    chosen: dict[str, str] = {}
    per_source: dict[str, int] = {}

    def take(story: str, source: str) -> bool:
        if len(chosen) >= target or story in chosen or per_source.get(source, 0) >= cap:
            return False
        chosen[story] = source
        per_source[source] = per_source.get(source, 0) + 1
        return True

    goal = min(SOURCE_GOAL, len({source for _, source, _ in rows if source}))
    for story, source, _ in rows:
        if len(per_source) >= goal:
            break
        if source not in per_source:
            take(story, source)
    for section in schemas.SECTIONS:
        any(take(story, source) for story, source, s in rows if s == section)
    for story, source, _ in rows:
        take(story, source)
    return list(chosen)


def select_stories(candidates: DataFrame, target_items: int = 10, max_items_per_source: int = 3, edition: str | None = None) -> DataFrame:
    """Chosen candidates with their place ``position``, per edition if a column is named. [ORD-06, AGG-14]

    Rows beyond the cap within (source, section) can never be chosen, so they go first, in parallel; at most sources x sections x cap
    rows are left for the sequential choice. The windows see no texts; those are joined to what is chosen, which is written once.
    """
    group = F.col(edition).cast("string") if edition else F.lit("")
    rows = candidates.withColumn("_edition", group).withColumn("_source", F.coalesce("source_id", F.lit(""))).withColumn("_section", F.coalesce("section", F.lit("")))
    order = rank_order("published_at")
    within = Window.partitionBy("_edition", "_source", "_section").orderBy(*order)
    ranking = rows.select("_edition", "_source", "_section", "story_id", "article_count", "source_count", "published_at", "confidence")
    pruned = ranking.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= max_items_per_source)
    ranked = pruned.withColumn("_rank", F.row_number().over(Window.partitionBy("_edition").orderBy(*order))).select("_edition", "_rank", "story_id", "_source", "_section")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        ids = choose(list(zip(pdf["story_id"], pdf["_source"], pdf["_section"], strict=True)), target_items, max_items_per_source)
        return pd.DataFrame({"_e": pdf["_edition"].iloc[0], "_id": ids, "position": range(1, len(ids) + 1)})

    picks = cut(ranked.groupBy("_edition").applyInPandas(fold, "_e string, _id string, position long"))
    joined = rows.join(picks, (F.col("_edition") == F.col("_e")) & (F.col("story_id") == F.col("_id")))
    return cut(joined.drop("_edition", "_source", "_section", "_e", "_id"))


def selection_diagnostics(candidates: DataFrame, selected: DataFrame, target_items: int = 10, max_items_per_source: int = 3) -> DataFrame:
    """One row, with a map of the number per source. [AGG-18]"""
    a = candidates.agg(F.count("*").alias("candidate_count"), F.count_distinct(F.nullif("source_id", F.lit(""))).alias("available_source_count"))
    per = selected.groupBy("source_id").agg(F.count("*").alias("n"))
    b = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("selected_count"), F.count("*").alias("selected_source_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "n")))).alias("source_counts"),
    )
    return a.crossJoin(b).withColumns({"target_items": F.lit(target_items), "max_items_per_source": F.lit(max_items_per_source)})  # one row each


def edition_status(selected: DataFrame, minimum_items: int = 5) -> DataFrame:
    """One row: stories, publishers (blank ids do not count), ready or held. [FLT-12, AGG-15]"""
    n = F.count("*")
    return selected.agg(n.alias("story_count"), F.count_distinct(F.nullif("source_id", F.lit(""))).alias("publisher_count"), F.when(n >= minimum_items, "ready").otherwise("held").alias("status"))


def fallback_count(rewrites: DataFrame) -> DataFrame:
    """[AGG-16]"""
    return rewrites.agg(F.count_if(F.col("status") == "fallback").alias("fallback_count"))


def by_section(selected: DataFrame) -> DataFrame:
    """Selected stories in the order of sections; those of unknown sections are left out. [FLT-18]"""
    rank = selected.sparkSession.createDataFrame(list(enumerate(schemas.SECTIONS, 1)), "section_rank int, section string")
    return selected.join(F.broadcast(rank), "section").orderBy("section_rank", "position")


def source_list(stories: DataFrame, ord_col: str = "position", with_url: bool = False) -> DataFrame:
    """Publishers of an edition: first of each label in either case, in order, unlabelled ones skipped. [AGG-19]"""
    label = F.trim(F.coalesce(F.nullif(F.trim("source_name"), F.lit("")), "source_id", F.lit("")))
    more = [F.trim(F.coalesce("url", F.lit(""))).alias("url")] if with_url else []
    rows = stories.select(label.alias("label"), F.col(ord_col).alias("ord"), *more).where("label <> ''")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(T.casefold(F.col("label"))).orderBy("ord"))).where("n = 1")
    return first.drop("n")
