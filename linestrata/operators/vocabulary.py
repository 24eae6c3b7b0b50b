"""Words and how many lines have them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestrata.functions.words import derive_global, eligible, replace_repeatedly
from linestrata.plans.config import MinerConfig

#: Keys (slots, digests, words of clusters) that every task may have; more of them meet rows by a shuffle.
MAX_KEYS = 4_000_000


def with_derived(tokenized: DataFrame, config: MinerConfig) -> DataFrame:
    """Adds ``derived``: for each token its derived form, or null.

    The exact, repeated replacement isn't a built-in function; it runs in Arrow
    batches on the distinct tokens of a batch, next to the rows, so that no
    line has to be put together again by a shuffle.
    """
    if not config.derives:
        return tokenized.withColumn("derived", F.lit(None).cast("array<string>"))
    usable = lambda t: (t != "") & eligible(t, config.wfilter, config.wsearch)
    if config.replace_mode == "global":
        return tokenized.withColumn("derived", F.transform("tokens", lambda t: F.when(usable(t), derive_global(t, config.wsearch, config.wreplace))))
    candidates = F.transform("tokens", lambda t: F.when(usable(t), t))
    return tokenized.withColumn("derived", _derive_arrays(config.wsearch, config.wreplace)(candidates))


def _derive_arrays(wsearch: str, wreplace: str):
    import re

    from linestrata.functions.regex import to_python

    pattern = to_python(wsearch)

    @F.arrow_udf("array<string>")
    def run(arrays: pa.Array) -> pa.Array:
        search = re.compile(pattern)
        words = arrays.flatten().dictionary_encode()
        known = pa.array([None if w is None else replace_repeatedly(w, search, wreplace) for w in words.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(_zero_based(arrays), known.take(words.indices))

    return run


def _zero_based(arrays: pa.ListArray) -> pa.Array:
    lengths = arrays.value_lengths().fill_null(0)
    import pyarrow.compute as pc

    return pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])


def words_of_line(config: MinerConfig) -> Column:
    """The set of words of a line: non-empty tokens and, if asked for, derived forms."""
    words = F.array_distinct(F.filter("tokens", lambda t: t != ""))
    if config.derives:
        words = F.array_union(words, F.filter("derived", lambda d: d.isNotNull()))
    return words


def occurrences(tokenized: DataFrame, config: MinerConfig) -> DataFrame:
    """word: once for every occurrence, derived forms included."""
    rows = tokenized.select(F.explode(F.filter("tokens", lambda t: t != "")).alias("word"))
    if config.derives:
        rows = rows.unionByName(tokenized.select(F.explode(F.filter("derived", lambda d: d.isNotNull())).alias("word")))
    return rows


def sketch_slot(value: Column, size: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), value), F.lit(size))


def word_sketch(tokenized: DataFrame, config: MinerConfig) -> DataFrame:
    """slot, n: occurrences of all words that fall into a slot."""
    return (
        occurrences(tokenized, config)
        .groupBy(sketch_slot(F.col("word"), config.word_sketch_size, config.initseed).alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary(tokenized: DataFrame, config: MinerConfig, support: int) -> DataFrame:
    """word, df: lines that have the word.

    With a word sketch, words in slots under the support are left out; none of
    them can be frequent.
    """
    words = tokenized.select(F.explode(words_of_line(config)).alias("word"))
    count = lambda rows: rows.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    if not config.word_sketch_size:
        return count(words)
    slot = sketch_slot(F.col("word"), config.word_sketch_size, config.initseed)
    return in_heavy_slots(words, slot, word_sketch(tokenized, config), support, config.word_sketch_size, count)


def in_heavy_slots(rows: DataFrame, slot: Column, sketch: DataFrame, support: int, size: int, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``count(rows)`` of the rows whose slot has the support.

    Rows don't move to meet the slots: a slot has as many as its most frequent
    word.  Slots that are too many for every task to have meet counted rows.
    """
    heavy = sketch.where(F.col("n") >= support).select(F.col("slot").alias("heavy_slot"))
    if size <= MAX_KEYS:
        return count(rows.join(F.broadcast(heavy), slot == F.col("heavy_slot"), "left_semi"))
    return count(rows).join(heavy, slot == F.col("heavy_slot"), "left_semi")


def frequent_words(vocab: DataFrame, support: int) -> DataFrame:
    return vocab.where(F.col("df") >= support)


def relative_support(n_lines: int, percentage: float) -> int:
    """Truncated; may be 0, and then everything is frequent."""
    return int(n_lines * percentage / 100)


#: The document frequencies up to which words are counted.
HISTOGRAM = (1, 2, 5, 10, 20)


def frequency_histogram(vocab: DataFrame, support: int) -> DataFrame:
    """One row: words, words with df up to each bound, words under the support, and percentages.

    The percentages of the bounds are cut to whole numbers, that of the support
    is rounded to two places.
    """
    words = F.count(F.lit(1))
    counts = vocab.agg(
        words.alias("words"),
        *[F.count_if(F.col("df") <= b).alias(f"df_upto_{b}") for b in HISTOGRAM],
        F.count_if(F.col("df") < support).alias("infrequent"),
    )
    return counts.select(
        "*",
        *[F.when(F.col("words") > 0, F.floor(F.col(f"df_upto_{b}") * 100 / F.col("words"))).cast("bigint").alias(f"pct_upto_{b}") for b in HISTOGRAM],
        F.when(F.col("words") > 0, F.round(F.col("infrequent") * 100 / F.col("words"), 2)).alias("pct_infrequent"),
    )
