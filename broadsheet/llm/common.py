"""What the operators share: words, sizes, tables; scratch tables come from the library's session module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import drop, drop_scratch, scratch, scratch_path, shared_root, ship

__all__ = ["WORD", "drop", "drop_scratch", "n_words", "scratch", "scratch_path", "shared_root", "ship", "tables", "text_or_empty"]

#: The words of a text: runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def n_words(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
