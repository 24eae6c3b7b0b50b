"""Lines that match no pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outliers(reduced: DataFrame, clusters: DataFrame) -> DataFrame:
    """line_id, value of lines whose sequence of frequent words isn't a cluster.

    ``reduced`` should come from original words, as derived forms aren't
    considered by default.  Lines without frequent words are always outliers.
    """
    keys = clusters.select(F.col("words").alias("c_words"))
    return reduced.join(keys, (F.col("k") > 0) & (F.col("words") == F.col("c_words")), "left_anti").select("line_id", "value")
