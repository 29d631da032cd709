"""Relational layer of the pair-annotation workbench: lookups, progress, upserts, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet import schemas
from broadsheet.functions import text as T
from broadsheet.session import cut


def latest_run(runs: DataFrame) -> DataFrame:
    """[LIM-04]"""
    return runs.orderBy(F.col("id").desc()).limit(1)


def matches(term: str | None, *columns: str) -> Column:
    """Case-insensitive substring of any column; % and _ in the term are wildcards; no term matches all. [FLT-06]"""
    if not (term or "").strip():
        return F.lit(True)
    cond = F.lit(False)
    for c in columns:
        cond |= F.coalesce(F.col(c).ilike(f"%{term.strip()}%"), F.lit(False))
    return cond


def conditions(source: str | None = None, category: str | None = None, scope: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Conjunction of what is not blank; times compare as text, ends included. [FLT-05]"""
    cond = F.lit(True)
    for column, value in (("source_id", source), ("category", category), ("scope", scope)):
        if value and value.strip():
            cond &= F.col(column) == value.strip()
    if since and since.strip():
        cond &= F.col("published_at") >= since.strip()
    if until and until.strip():
        cond &= F.col("published_at") <= until.strip()
    return cond


def newest_first(id_col: str = "article_id") -> list[Column]:
    """[SRT-05]"""
    return [F.coalesce("published_at", F.lit("")).desc(), F.col(id_col).asc()]


def references(articles: DataFrame, annotations: DataFrame, run: int | None = None, search: str | None = None, status: str | None = None) -> DataFrame:
    """Articles with their number of annotations as reference. [JOIN-04, JOIN-05, JOIN-06, AGG-03, FLT-07, SRT-05]"""
    if run is not None:
        articles, annotations = articles.where(F.col("run_id") == run), annotations.where(F.col("run_id") == run)
    rows = articles.where(matches(search, "title", "description"))
    marks = annotations.select(F.col("reference_article_id").alias("article_id"), "id")
    if status == "unlabeled":
        rows = rows.join(marks, "article_id", "left_anti")
    elif status == "labeled":
        rows = rows.join(marks, "article_id", "left_semi")
    # Counts are made before the join, so that articles are not multiplied.
    counts = marks.groupBy("article_id").agg(F.count("id").alias("annotation_count"))
    rows = rows.join(counts, "article_id", "left").withColumn("annotation_count", F.coalesce("annotation_count", F.lit(0)).cast("long"))
    return rows.orderBy(*newest_first())


def unlabeled(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """[JOIN-05]"""
    return articles.join(annotations.select(F.col("reference_article_id").alias("article_id")), "article_id", "left_anti")


def labeled(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """[JOIN-06]"""
    return articles.join(annotations.select(F.col("reference_article_id").alias("article_id")), "article_id", "left_semi")


def article(articles: DataFrame, article_id: str, run: int | None = None) -> DataFrame:
    """Point lookup. [FLT-16]"""
    rows = articles.where(F.col("article_id") == article_id)
    return rows if run is None else rows.where(F.col("run_id") == run)


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """[SET-04]"""
    return F.least(a, b), F.greatest(a, b)


def candidates(articles: DataFrame, annotations: DataFrame, reference_id: str, annotator: str = "local", run: int | None = None, search: str | None = None, **filters: str | None) -> DataFrame:
    """Other articles with the label they already have against the reference. [FLT-08, FLT-05, FLT-06, JOIN-07, PRJ-06]"""
    if run is not None:
        articles, annotations = articles.where(F.col("run_id") == run), annotations.where(F.col("run_id") == run)
    rows = articles.where((F.col("article_id") != reference_id) & conditions(**filters) & matches(search, "title", "description"))
    a, b = canonical_pair(F.col("article_id"), F.lit(reference_id))
    mine = annotations.where(F.col("annotator_id") == annotator).select(
        F.col("article_id_a").alias("_a"), F.col("article_id_b").alias("_b"), F.col("label").alias("existing_label"), F.col("notes").alias("existing_notes"),
        F.col("updated_at").alias("existing_updated_at"),
    )
    joined = rows.withColumn("_x", a).withColumn("_y", b).join(mine, (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b")), "left")
    return joined.drop("_x", "_y", "_a", "_b").orderBy(*newest_first())


def saved_annotations(annotations: DataFrame, articles: DataFrame, reference_id: str | None = None) -> DataFrame:
    """Annotations with both titles, newest change first. [JOIN-08, FLT-17, SRT-06]"""
    rows = annotations if reference_id is None else annotations.where(F.col("reference_article_id") == reference_id)
    a = articles.select(F.col("article_id").alias("article_id_a"), F.col("title").alias("title_a"))
    b = articles.select(F.col("article_id").alias("article_id_b"), F.col("title").alias("title_b"))
    return rows.join(a, "article_id_a").join(b, "article_id_b").orderBy(F.col("updated_at").desc(), "id")


def label_counts(annotations: DataFrame, labels: tuple = schemas.PAIR_LABELS) -> DataFrame:
    """Number per label of the domain, 0 where there is none. [AGG-07]"""
    kind = "string" if all(isinstance(x, str) for x in labels) else "int"
    domain = annotations.sparkSession.createDataFrame([(x,) for x in labels], f"label {kind}")
    counts = annotations.groupBy("label").agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def progress(articles: DataFrame, annotations: DataFrame) -> DataFrame:
    """Articles, labelled references, those left, percent. [AGG-04, AGG-05, AGG-06, AGG-08]"""
    t = articles.agg(F.count("*").alias("total"))
    done = annotations.agg(F.count_distinct("reference_article_id").alias("labeled"), F.count("*").alias("total_labels"))
    rows = t.crossJoin(done)  # one row each
    percent = F.when(F.col("total") > 0, F.round(100 * F.col("labeled") / F.col("total"), 1)).otherwise(0.0)
    return rows.select("total", "labeled", F.greatest(F.col("total") - F.col("labeled"), F.lit(0)).alias("remaining"), "total_labels", percent.alias("percent"))


def facets(articles: DataFrame, *columns: str) -> DataFrame:
    """Distinct values, none of them blank, in order. [AGG-09, FLT-14]"""
    cond = F.lit(True)
    for c in columns:
        cond &= F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return articles.where(cond).select(*columns).distinct().orderBy(*columns)


def neighbours(rows: DataFrame, order: list[Column], id_col: str = "article_id") -> DataFrame:
    """Previous and next id in a list. [ORD-09]

    Ranges of the order are looked at apart; their first and last ids are joined to the neighbouring ranges.
    """
    placed = cut(numbered(rows, order, "_place").select(id_col, "_place"))
    at = lambda step, name: placed.select((F.col("_place") + step).alias("_place"), F.col(id_col).alias(name))
    joined = placed.join(at(1, "previous_id"), "_place", "left").join(at(-1, "next_id"), "_place", "left")
    return joined.select(id_col, "previous_id", "next_id")


def display_tags(tags_json: Column, n: int = 4) -> Column:
    """[LIM-05, PRJ-05]"""
    return F.slice(T.safe_tags(tags_json), 1, n)


def check_batch(batch: DataFrame, articles: DataFrame) -> list[str]:
    """What is wrong with new annotations (article_id_a, article_id_b, label); empty if nothing is. [MUT-03, JOIN-14]"""
    wrong = []
    if batch.where(~F.col("label").isin(*schemas.PAIR_LABELS) | F.col("label").isNull()).limit(1).count():
        wrong.append("unknown label")
    if batch.where(F.col("article_id_a").eqNullSafe(F.col("article_id_b"))).limit(1).count():
        wrong.append("an article paired with itself")
    ids = batch.select(F.col("article_id_a").alias("article_id")).unionByName(batch.select(F.col("article_id_b").alias("article_id")))
    if ids.join(articles.select("article_id"), "article_id", "left_anti").limit(1).count():
        wrong.append("unknown article")
    return wrong


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place (from 1) in an order. Ranges of the order are numbered apart; only their sizes meet in one place."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_k"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # a row a partition
    before = sizes.select("_range", (F.sum("_k").over(upto) - F.col("_k")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, inside).join(before, "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_range", "_before")


def upsert_pairs(saved: DataFrame, batch: DataFrame, now: str, ord_col: str = "ord") -> DataFrame:
    """Saved annotations after a batch: keyed by (run, a, b, annotator), the last of the batch wins, id and created_at stay. [MUT-01, SET-04]

    batch: run_id, article_id_a, article_id_b (in any order), reference_article_id, label, notes, annotator_id, ord.
    """
    key = ["run_id", "article_id_a", "article_id_b", "annotator_id"]
    a, b = canonical_pair(F.col("article_id_a"), F.col("article_id_b"))
    rows = batch.withColumn("_a", a).withColumn("_b", b).drop("article_id_a", "article_id_b").withColumnsRenamed({"_a": "article_id_a", "_b": "article_id_b"})
    last = rows.groupBy(*key).agg(
        F.max_by(F.struct("reference_article_id", "label", "notes"), ord_col).alias("new"), F.min(ord_col).alias("first_ord")
    )
    top = saved.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    joined = cut(saved.join(last, key, "full_outer"))
    fresh = numbered(joined.where("id IS NULL"), [F.col("first_ord"), *map(F.col, key)], "number")
    number = F.lit(top) + F.col("number")
    joined = joined.where("id IS NOT NULL").withColumn("number", F.lit(None).cast("long")).unionByName(fresh)
    changed = F.col("new").isNotNull()
    return joined.select(
        F.coalesce("id", number).cast("long").alias("id"), "run_id", "article_id_a", "article_id_b",
        *[F.when(changed, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("reference_article_id", "label", "notes")],
        "annotator_id", F.coalesce("created_at", F.lit(now)).alias("created_at"), F.when(changed, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def import_articles(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: ids that are not there. An id that another run owns raises. [MUT-02, JOIN-13]"""
    owned = existing.select("article_id", F.col("run_id").alias("owner"))
    clash = new.join(owned, "article_id").where("owner <> run_id").limit(1).count()
    if clash:
        raise ValueError("an article belongs to another run")
    return new.join(existing.select("article_id"), "article_id", "left_anti")


def split_imports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an id and a title, and the others with file and line. [FLT-04]"""
    ok = (F.trim(F.coalesce("article_id", F.lit(""))) != "") & (F.trim(F.coalesce("title", F.lit(""))) != "")
    return raw.where(ok), raw.where(~ok)


def source_counts(items: DataFrame) -> DataFrame:
    """[AGG-13]"""
    return items.groupBy("source_id").agg(F.count("*").alias("n"))


def register(registered: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (email, ord) with their outcome: created, duplicate or invalid. [SNK-11, JOIN-15, FLT-15, FN-27]"""
    rows = requests.withColumn("email", T.normal_email(F.col("email"))).withColumn("ok", F.coalesce(T.valid_email(F.col("email")), F.lit(False)))
    taken = registered.select(T.normal_email(F.col("email")).alias("email"), F.lit(True).alias("taken")).distinct()
    first = F.row_number().over(Window.partitionBy("email").orderBy("ord")) == 1
    rows = rows.withColumn("first", first).join(taken, "email", "left")
    status = F.when(~F.col("ok"), "invalid").when(F.col("taken").isNotNull() | ~F.col("first"), "duplicate").otherwise("created")
    return rows.select("ord", "email", status.alias("status"))


def pair_quality(annotations: DataFrame, pairs: DataFrame) -> DataFrame:
    """Precision and recall of accepted pairs, same_story being positive; unclear ones do not count. [2.11, beyond parity]"""
    judged = annotations.where(F.col("label") != "unclear").select(F.col("article_id_a").alias("a"), F.col("article_id_b").alias("b"), (F.col("label") == "same_story").alias("positive"))
    x, y = canonical_pair(F.col("a"), F.col("b"))
    found = pairs.where("accepted").select(x.alias("a"), y.alias("b")).distinct().withColumn("found", F.lit(True))
    rows = judged.join(found, ["a", "b"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    tp, fp, fn = F.count_if(F.expr("found AND positive")), F.count_if(F.expr("found AND NOT positive")), F.count_if(F.expr("NOT found AND positive"))
    return rows.agg(F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"))
