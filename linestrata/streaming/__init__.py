"""Matching of a stream of lines against patterns found earlier.

Mining itself needs several passes over finite input; what a stream can be asked
is which of the known patterns a new line has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestrata.operators.candidates import is_one_of, reduce_lines
from linestrata.operators.vocabulary import with_derived
from linestrata.operators.tokenize import tokenize
from linestrata.plans.config import MinerConfig


def label_stream(lines: DataFrame, words: list[str], clusters: DataFrame, config: MinerConfig) -> DataFrame:
    """line_id, value, words (of the matched pattern; null for an outlier) of a streaming or static frame.

    Stateless: frequent words are part of the expression and patterns the static
    side of a join, so it runs in any output mode that allows appends.
    """
    tokenized = with_derived(tokenize(lines, config), config)
    keys = clusters.select(F.col("words").alias("pattern_words")).distinct()
    reduced = reduce_lines(tokenized, None, is_one_of(words), config.derives)
    return reduced.join(keys, (F.col("k") > 0) & (F.col("words") == F.col("pattern_words")), "left").select("line_id", "value", F.col("pattern_words").alias("words"))
