"""Connected components of links between integer ids: the library's, with ids as 64-bit integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.operators import components as library


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node is linked with; nodes without links are not in it."""
    return library.components(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")))
