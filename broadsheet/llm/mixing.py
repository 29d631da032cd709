"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every source has a weight. The mix has as many words as all sources together; each source's target is its share by
weight, stopped at ``max_epochs`` times its own size, and what is above is shared again by weight (water filling).
A source is taken ``floor(target / size)`` times as a whole; for the rest, documents whose hash lies below a threshold
are taken once more. The threshold comes from nested histograms: words are summed by source and leading hash bits, the
bucket in which the budget ends is found, and only that bucket is refined by the next bits. Nothing is sorted, and each
level reads back at most ``2**BITS`` sums a source.

Defined results: null text has size 0; null is a source of its own, ordered last; a source without words has target 0;
rows with equal ids share a hash and are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm import common

BITS = 12
LEVELS = 4
#: Up to so many sources the per-source table is broadcast; beyond it Spark chooses the join.
BROADCAST_SOURCES = 10_000


def hash48(col: str):
    """48 bits of md5 of the id as text, as long; the same in any engine that has md5."""
    text = F.coalesce(F.col(col).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, size) rows -> one row per source: source_size, weight, target.

    ``weights`` repeat over the sources in code point order, null last.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rank", rank)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("most", F.lit(float(max_epochs)) * F.col("source_size"))
    # Sources fill up in the order of most / weight: the first level that the next source can hold is the water level.
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("rank"))
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left_weight"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    )
    level = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    per = per.withColumn("water", level)
    target = F.least(F.col("most"), F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    columns = (
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        common.n_words(text_col).alias("size"),
        hash48(id_col).alias("h"),
    )
    return common.scratch(df.select(*columns), "mix-rows")


def source_thresholds(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, size, h) rows -> one row per source: s_source, source_size, target, base, threshold.

    A row is taken ``base`` times, and once more if its hash h is below ``threshold``.
    """
    per = source_targets(rows, weights, max_epochs)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("base", base).withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    # prefix: the hash bits fixed so far; below: words of the hashes under that prefix's start.
    state = common.scratch(
        per.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")).withColumn("open", F.col("budget") > 0),
        "mix-sources",
    )
    few = state.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda x: x)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        last = level == LEVELS - 1
        known = hint(state.select(F.col("source").alias("s_source"), "prefix", "below", "budget").where("open"))
        inside = rows.join(
            known,
            rows.source.eqNullSafe(F.col("s_source")) & (F.shiftright("h", shift + BITS) == F.col("prefix")),
        )
        sums = inside.groupBy("s_source", F.shiftright("h", shift).alias("bucket"), "below", "budget").agg(F.sum("size").alias("words"))
        by_hash = Window.partitionBy("s_source").orderBy("bucket")
        upto = F.sum("words").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
        # The first bucket that does not fit as a whole; if all fit, the budget ends behind the last.
        cut = sums.withColumn("upto", upto).where(F.col("upto") > F.col("budget")).groupBy("s_source").agg(
            F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "words"), "bucket").alias("cut")
        )
        joined = state.join(hint(cut), state.source.eqNullSafe(cut.s_source), "left").drop("s_source")
        prefix = F.when(F.col("open") & F.col("cut").isNotNull(), F.col("cut.bucket"))
        if last:  # one hash value is left: it is in if at least half of it fits
            prefix = prefix + F.when(F.col("budget") - F.col("cut.before") >= F.col("cut.words") / 2, 1).otherwise(0)
        whole = F.lit(1 << BITS * (level + 1)).cast("long")
        state = common.scratch(
            joined.withColumn("prefix", F.when(~F.col("open"), F.col("prefix") * (1 << BITS)).otherwise(F.coalesce(prefix, whole)))
            .withColumn("below", F.coalesce(F.col("cut.before"), F.col("below")))
            .withColumn("open", F.col("open") & F.col("cut").isNotNull())
            .drop("cut"),
            "mix-sources",
        )
    return hint(state.select(F.col("source").alias("s_source"), "source_size", "target", "base", F.col("prefix").alias("threshold")))


def _copies() -> F.Column:
    return F.col("base") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, copies, taken (= copies * size)."""
    rows = _rows(df, id_col, text_col, source_col)
    ends = source_thresholds(rows, weights, max_epochs)
    return rows.join(ends, rows.source.eqNullSafe(F.col("s_source"))).select(
        F.col("id").alias(id_col),
        "size",
        F.col("source").alias("source"),
        "source_size",
        "target",
        _copies().alias("copies"),
        (_copies() * F.col("size")).alias("taken"),
    )


def mixed_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
) -> DataFrame:
    """The rows of the mix: every input row as often as it is taken, with the columns of the input."""
    ends = source_thresholds(_rows(df, id_col, text_col, source_col), weights, max_epochs)
    whole = df.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), hash48(id_col).alias("h"))
    joined = whole.join(ends, F.col("source").eqNullSafe(F.col("s_source"))).select("row", _copies().alias("copies"))
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
