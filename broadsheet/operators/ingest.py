"""Entries to items, validity rules, limits, run rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.functions import text as T
from broadsheet.operators.greedy import first_by_two_keys

#: The fields of an item that must be non-blank JSON strings.
REQUIRED = ("article_id", "source_id", "source_name", "title", "description", "published_at", "url")


def normalize_entries(entries: DataFrame, feeds: DataFrame, ingested_at: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of entries, and duplicates per source. [PRJ-01, FLT-01, FLT-02, LIM-01, ORD-01]

    entries: source_id, ord (position in its feed), url, title, description, published_at, tags. The limit is applied first,
    then entries with no URL or title key go, then the two-key rule per source.
    """
    most = F.lit(limit) if limit is not None else F.col("item_limit")
    known = F.broadcast(feeds.select("source_id", F.col("name").alias("source_name"), "scope", "category", "item_limit"))
    rows = entries.join(known, "source_id").where(F.col("ord") < most)
    rows = rows.withColumn("url", T.canonical_url(F.col("url"))).withColumn("title_key", T.title_key(F.col("title")))
    rows = rows.where((F.col("url") != "") & (F.col("title_key") != ""))
    rows = rows.withColumn("row", F.struct("source_id", "ord"))
    kept = first_by_two_keys(rows, "row", "url", "title_key", ["source_id"]).withColumnRenamed("ord", "row")
    items = rows.join(kept, "row", "left_semi")
    duplicates = rows.groupBy("source_id").agg(F.count("*").alias("n")).join(items.groupBy("source_id").agg(F.count("*").alias("k")), "source_id", "left")
    duplicates = duplicates.select("source_id", (F.col("n") - F.coalesce("k", F.lit(0))).alias("duplicate_count"))
    described = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.col("title"))
    items = items.select(
        T.article_id(F.col("url")).alias("article_id"), "source_id", "source_name", "scope", "category", "title", described.alias("description"),
        "published_at", "url", "tags", F.lit(ingested_at).alias("ingested_at"), "ord",
    )
    return items, duplicates


def valid_items(raw: DataFrame, value_col: str = "value", max_per_source: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON to items and to invalid counts per source. [SRC-06, FLT-03, LIM-02]

    raw: source_id, line, value. A field counts only if it is a JSON string; blank lines and other JSON are invalid. With a limit, lines
    behind the last valid one that is taken are not looked at.
    """
    v = F.try_parse_json(value_col)
    rows = raw.withColumn("v", v).withColumn("is_object", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT<")), F.lit(False)))

    def field(name: str) -> Column:
        part = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.col("is_object") & (F.schema_of_variant(part) == "STRING"), F.try_variant_get("v", f"$.{name}", "string"))

    for name in ("article_id", "source_id", "source_name", "scope", "category", "title", "description", "published_at", "url", "ingested_at"):
        rows = rows.withColumn(f"f_{name}", field(name))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rows = rows.withColumn("f_description", F.when(blank(F.col("f_description")), F.col("f_title")).otherwise(F.col("f_description")))
    ok = ~blank(F.col("f_article_id"))
    for name in REQUIRED[1:]:
        ok &= ~blank(F.col(f"f_{name}"))
    rows = rows.withColumn("valid", ok)
    order = Window.partitionBy("source_id").orderBy("line")
    if max_per_source is not None:
        before = F.coalesce(F.sum(F.col("valid").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("before", before).where(F.col("before") < max_per_source)
    invalid = rows.groupBy("source_id").agg(F.count_if(~F.col("valid")).alias("invalid_count"))
    tags = F.coalesce(F.try_variant_get("v", "$.tags", "array<string>"), F.array().cast("array<string>"))
    names = ("article_id", "source_id", "source_name", "scope", "category", "title", "description", "published_at", "url")
    items = rows.where("valid").select(*[F.col(f"f_{n}").alias(n) for n in names], tags.alias("tags"), F.col("f_ingested_at").alias("ingested_at"), "line")
    return items, invalid


def deduplicate_items(items: DataFrame, ord_col: str = "ord") -> DataFrame:
    """The two-key rule over all sources; an empty title key is a key like others. [ORD-02]"""
    rows = items.withColumn("_url", T.canonical_url(F.col("url"))).withColumn("_title", T.title_key(F.col("title")))
    kept = first_by_two_keys(rows, ord_col, "_url", "_title").withColumnRenamed("ord", "_kept")
    return rows.join(kept, F.col(ord_col) == F.col("_kept"), "left_semi").drop("_url", "_title")


def first_wins(df: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """First row of each key in order, and the others. [ORD-03]"""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def prefix_limit(df: DataFrame, group: str, limit: int, *order: str) -> DataFrame:
    """The first rows of each group. [LIM-01]"""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= limit).drop("_n")


def run_rollup(results: DataFrame) -> DataFrame:
    """One row: ok and failed sources, items, duplicates, three-state status. results: source_id, status, item_count, duplicate_count. [AGG-01]"""
    ok, failed = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") != "ok")
    status = F.when(failed == 0, "ok").when(ok > 0, "partial").otherwise("failed")
    return results.agg(
        ok.alias("source_count_ok"), failed.alias("source_count_failed"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("item_count"),
        F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("duplicate_count"), status.alias("status"),
    )


def normalization_summary(extractions: DataFrame, pairs: DataFrame, stories: DataFrame) -> DataFrame:
    """One row of totals of a story run. [AGG-02]"""
    e = extractions.agg(F.count_if(F.col("status") != "ok").alias("extraction_failures"))
    p = pairs.agg(F.count("*").alias("candidate_pairs"), F.count_if("accepted").alias("accepted_pairs"))
    s = stories.agg(F.count("*").alias("stories"), F.count_if(F.col("source_count") > 1).alias("multi_source"), F.count_if(F.col("article_count") == 1).alias("singletons"))
    return e.crossJoin(p).crossJoin(s)  # one row each


def cache_split(items: DataFrame, cache: DataFrame, model: str, key: str = "article_id", fingerprint: str = "input_fingerprint") -> tuple[DataFrame, DataFrame]:
    """Cached rows that still hold (failures too), and items that must be computed. Of several cached rows of a key the last counts. [JOIN-09, SRC-11]"""
    mine = cache.where(F.col("model") == model)
    if "ord" in mine.columns:
        last = mine.groupBy(key).agg(F.max_by(F.struct("*"), "ord").alias("r"))
        mine = last.select("r.*")
    on = [key, fingerprint]
    hits = mine.join(items.select(*on).distinct(), on, "left_semi")
    return hits, items.join(mine.select(*on), on, "left_anti")
