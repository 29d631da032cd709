"""The corpus pipeline: documents to packed training sequences, in five stages.

1. ``toxicity``: a classifier fitted on labelled rows scores every document; those it calls toxic go.
2. ``near_duplicates``: of each group of documents with similar word shingles the one with the smallest id stays.
3. ``passages``: passages that already occur in an earlier document are cut out of the text.
4. ``mix``: documents are left out or repeated until each source has its target share of words.
5. ``pack``: texts are encoded and packed into sequences.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but the last
return the columns of ``docs``.

Defined results: a null text is an empty one; it is scored, linked with nothing, keeps its place in the mix (taken as often as its
source, with size 0) and packs to the end id alone. Rows with null ids are scored but never learnt from; those with near copies go
if any of the group has an id, else one of them stays. Of rows with equal id and text one stays; rows with one id and different texts are all kept
if the id is kept. Ties are decided by ids, then texts. Columns of any other name are handed on. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm import common, jaccard
from broadsheet.llm.mixing import mixed_rows
from broadsheet.llm.packing import pack_documents
from broadsheet.llm.substring import dedup_passages
from broadsheet.llm.toxicity import score, sample_labels, train

#: Documents with at least this score are toxic.
TOXIC = 0.5
TOKENIZER = "byte_bpe_50k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC. Labels of a fifth of the ids are held out, as in the operator's query."""
    labels = common.tables(spark, sf_dir, "labels")
    usable = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = train(docs, sample_labels(labels, usable, "doc_id", "toxic"), "doc_id", "text")
    columns = docs.columns
    free = "_" * (1 + max(map(len, columns)))  # a name that no column has
    return score(docs, model, keep=[c for c in columns if c != "doc_id"], score_col=free).where(F.col(free) < TOXIC).select(*[F.col(f"`{c}`") for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id (if all are null, one of them); of equal rows one.

    Rows with null id and no words are all kept.
    """
    common.ship(spark)
    found = common.scratch(jaccard.document_components(docs), "pipeline-components")
    # A row is a column of its own, so that no name in it can clash with those of the joins.
    rows = docs.select(jaccard.document_key("doc_id", "text").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    small = lambda t: F.broadcast(t) if t.count() <= jaccard.BROADCAST_IDS else t
    left = rows.join(small(found.where("key <> root").select("key").distinct()), "key", "left_anti")
    again = found.where("named OR n_shingles > 0").groupBy("key").count().where("count > 1").select("key")
    if again.limit(1).count():
        again = small(again)
        repeated = left.join(again, "key", "left_semi").withColumn("text", F.col("row.text")).dropDuplicates(["key", "text"]).drop("text")
        left = left.join(again, "key", "left_anti").unionByName(repeated)
    return left.select("row.*")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that occur earlier; n_chars is that of the text left."""
    common.ship(spark)
    columns = docs.columns
    done = dedup_passages(docs, keep=[c for c in columns if c not in ("doc_id", "text")], with_text=True)
    text, changed = F.col("kept_text").alias("text"), F.col("n_removed") > 0
    n_chars = F.when(changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    return done.select(*[text if c == "text" else n_chars if c == "n_chars" else F.col(c) for c in columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    common.ship(spark)
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("pack", pack)]

#: Scores, tokens and hashes are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = common.tables(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.scratch(docs, f"stage-{name}")
    return docs
