"""Roll-up of support: a pattern takes over the lines of more specific patterns.

A pattern is read as a list of nodes: before each word a gap node if that gap can
be more than zero, then the word, and a gap node for the tail likewise.  A
pattern C with a gap absorbs another pattern D if a greedy left-to-right reading
of D's nodes fits C (no backtracking).  D then has all words of C and more, its
first nodes are C's words up to C's first gap, and its least and greatest length
lie inside C's; these facts block the self-join, which would otherwise compare
all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gap_node(g: Column) -> Column:
    return F.struct(F.lit(1).alias("kind"), F.lit("").alias("w"), g["lo"].cast("int").alias("lo"), g["hi"].cast("int").alias("hi"))


def _word_node(w: Column) -> Column:
    return F.struct(F.lit(0).alias("kind"), w.alias("w"), F.lit(1).alias("lo"), F.lit(1).alias("hi"))


def nodes() -> Column:
    """kind 0: a word, kind 1: a gap; gaps that are always zero have no node."""
    inner = F.flatten(F.zip_with("gaps", "words", lambda g, w: F.array(_gap_node(g), _word_node(w))))
    return F.filter(F.concat(inner, F.array(_gap_node(F.col("tail")))), lambda n: (n["kind"] == 0) | (n["hi"] > 0))


def fixed_prefix() -> Column:
    """Constants before the first gap; k if there is none but the tail."""
    first = F.array_position(F.transform("gaps", lambda g: g["hi"] > 0), True)
    return F.when(first > 0, first - 1).otherwise(F.size("words")).cast("int")


def accepts(words: Column, gaps: Column, tail: Column, prefix: Column, d_nodes: Column) -> Column:
    """Whether the pattern (words, gaps, tail) absorbs one with these nodes; the common prefix is given."""
    k = F.size(words)

    def state(j: Column, lo: Column, hi: Column, alive: Column, ok: Column) -> Column:
        return F.struct(j.cast("int").alias("j"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), alive.alias("alive"), ok.alias("ok"))

    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)

    def read(s: Column, n: Column) -> Column:
        lo, hi, j = s["lo"] + n["lo"], s["hi"] + n["hi"], s["j"]
        gap = F.get(gaps, j - 1)
        on = state(j, lo, hi, yes, no)
        dead = state(j, lo, hi, no, no)
        hit = state(j + 1, zero, zero, yes, (j == k) & ((tail["hi"] == 0) | (tail["lo"] == 0)))
        inside = (
            F.when(lo - 1 < gap["lo"], on)
            .when(hi - 1 > gap["hi"], dead)
            .when((n["kind"] == 0) & (n["w"] == F.get(words, j - 1)), hit)
            .otherwise(on)
        )
        behind = F.when(tail["hi"] == 0, dead).when(lo < tail["lo"], on).when(hi > tail["hi"], dead).otherwise(state(j, lo, hi, yes, yes))
        return F.when(~s["alive"], s).when(j <= k, inside).otherwise(behind)

    rest = F.slice(d_nodes, prefix + 1, F.greatest(F.size(d_nodes), F.lit(1)))
    return F.aggregate(rest, state(prefix + 1, zero, zero, yes, no), read, lambda s: s["alive"] & s["ok"])


def reach() -> Column:
    """The least and the most tokens that a line of the pattern has."""
    bounds = F.concat("gaps", F.array(F.col("tail")))
    total = lambda end: F.size("words") + F.aggregate(bounds, F.lit(0), lambda s, g: s + g[end].cast("int"))
    return F.struct(total("lo").alias("lo"), total("hi").alias("hi"))


def compared(candidates: DataFrame) -> DataFrame:
    """Pairs of a pattern with a gap and a longer one that may be more specific.

    They meet by the pattern's rarest word, which the other must have.  The other
    has more constants, begins with the same words up to the first gap, and its
    lines are no shorter and no longer than the pattern allows; all of this is
    part of the join.
    """
    listed = candidates.select("words", "k", "gaps", "tail", "own_support", nodes().alias("nodes"), fixed_prefix().alias("p"), reach().alias("reach"))
    general = listed.where((F.col("tail.hi") > 0) | F.exists("gaps", lambda g: g["hi"] > 0)).drop("own_support", "nodes")
    members = listed.select(
        F.col("words").alias("d_words"),
        F.col("k").alias("d_k"),
        F.col("p").alias("d_p"),
        F.col("reach").alias("d_reach"),
        F.col("nodes").alias("d_nodes"),
        F.col("own_support").alias("d_support"),
        F.explode(F.array_distinct("words")).alias("d_word"),
    )
    rarity = members.groupBy(F.col("d_word").alias("r_word")).agg(F.count(F.lit(1)).alias("r"))
    rarest = (
        general.select("words", F.explode(F.array_distinct("words")).alias("word"))
        .join(rarity, F.col("word") == F.col("r_word"))
        .groupBy(F.col("words").alias("c_words"))
        .agg(F.min(F.struct("r", "word")).alias("best"))
        .select("c_words", F.col("best.word").alias("word"))
    )
    fits = (
        (F.col("d_k") > F.col("k"))
        & (F.col("d_p") >= F.col("p"))
        & (F.col("d_reach.lo") >= F.col("reach.lo"))
        & (F.col("d_reach.hi") <= F.col("reach.hi"))
        & (F.slice("d_words", 1, F.col("p")) == F.slice("words", 1, F.col("p")))
    )
    return general.join(rarest, F.col("words") == F.col("c_words")).join(members, (F.col("word") == F.col("d_word")) & fits)


def absorbed(candidates: DataFrame) -> DataFrame:
    """words, d_words, d_support: every accepted pair of a pattern and a more specific one."""
    taken = accepts(F.col("words"), F.col("gaps"), F.col("tail"), F.col("p"), F.col("d_nodes"))
    return compared(candidates).where(taken).select("words", "d_words", "d_support")


def roll_up(candidates: DataFrame) -> DataFrame:
    """``candidates`` with support: their own lines and those of the patterns they absorb."""
    more = absorbed(candidates).groupBy(F.col("words").alias("c_words")).agg(F.sum("d_support").alias("more"))
    return (
        candidates.join(more, F.col("words") == F.col("c_words"), "left")
        .withColumn("support", F.col("own_support") + F.coalesce("more", F.lit(0)))
        .drop("c_words", "more")
    )


def without_roll_up(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("support", F.col("own_support"))
