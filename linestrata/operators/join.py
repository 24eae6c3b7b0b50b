"""Joining of similar patterns by how strongly their words depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def co_occurrence(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """a, b, n: lines that have both words, for pairs of words that share a cluster.

    What a line adds depends on its candidate alone, so candidates stand for
    lines.  A candidate is cut down to the words of clusters before its words are
    paired.
    """
    words = clusters.select(F.array_distinct("words").alias("ws"))
    wanted = words.select(F.explode("ws").alias("wa"), "ws").select("wa", F.explode("ws").alias("wb")).distinct()
    known = words.select(F.explode("ws").alias("known")).distinct()
    members = (
        candidates.select(F.monotonically_increasing_id().alias("id"), "own_support", F.array_distinct("words").alias("ws"))
        .select("id", "own_support", F.explode("ws").alias("a"))
        .join(known, F.col("a") == F.col("known"), "left_semi")
        .groupBy("id", "own_support")
        .agg(F.collect_list("a").alias("ws"))  # at most the words of a line
    )
    pairs = members.select("own_support", F.explode("ws").alias("a"), "ws").select("own_support", "a", F.explode("ws").alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.sum("own_support").alias("n"))
    return counted.join(wanted, (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")), "left_semi")


def dependency(n: DataFrame) -> DataFrame:
    """a, b, dep: the share of the lines with a that have b too; ``n`` is what ``co_occurrence`` gives."""
    alone = n.where("a = b").select(F.col("a").alias("aa"), F.col("n").alias("na"))
    return n.join(alone, F.col("a") == F.col("aa")).select("a", "b", (F.col("n") / F.col("na")).alias("dep"))


def word_weights(clusters: DataFrame, deps: DataFrame, weightf: int) -> DataFrame:
    """words, pos, word, weight for every constant of every cluster.

    Function 1 averages the dependencies from all constants, repeats counted;
    function 2 those from the other distinct words (1 if there is none).
    """
    givers = F.col("words") if weightf == 1 else F.array_distinct("words")
    places = clusters.select("words", F.posexplode("words").alias("pos", "word"), givers.alias("givers"))
    pairs = places.select("words", "pos", "word", F.size("givers").alias("m"), F.posexplode("givers").alias("j", "giver"))
    # summed in the order of the constants, as floating point sums depend on it
    summed = (
        pairs.join(deps, (F.col("giver") == F.col("a")) & (F.col("word") == F.col("b")))
        .groupBy("words", "pos", "word", "m")
        .agg(F.array_sort(F.collect_list(F.struct("j", "dep"))).alias("d"))
        .withColumn("total", F.aggregate("d", F.lit(0.0), lambda s, x: s + x["dep"]))
    )
    weight = F.col("total") / F.col("m") if weightf == 1 else F.when(F.col("m") == 1, 1.0).otherwise((F.col("total") - 1) / (F.col("m") - 1))
    return summed.select("words", "pos", "word", weight.alias("weight"))


def join_clusters(clusters: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """Clusters without weak words as they are, the others merged where the rest is equal.

    Adds key, alts (per place the alternatives, or null for a plain constant),
    n_inputs, is_joined, latest_seen.
    """
    mask = (
        weights.groupBy(F.col("words").alias("m_words"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("weight") < threshold).alias("weak")))).alias("m"))
        .select("m_words", F.col("m.weak").alias("weak"))
    )
    marked = clusters.join(mask, F.col("words") == F.col("m_words")).drop("m_words").withColumn(
        "key", F.zip_with("words", "weak", lambda w, weak: F.when(~weak, w))
    )
    plain = marked.where(~F.exists("weak", lambda x: x)).select(
        "words",
        "k",
        "gaps",
        "tail",
        "support",
        "first_seen",
        F.transform("words", lambda w: F.lit(None).cast("array<string>")).alias("alts"),
        F.lit(1).cast("bigint").alias("n_inputs"),
        F.lit(False).alias("is_joined"),
        F.col("first_seen").alias("latest_seen"),
    )
    weak = marked.where(F.exists("weak", lambda x: x))
    whole = weak.groupBy("key").agg(
        F.sum("support").alias("support"),
        F.count(F.lit(1)).alias("n_inputs"),
        F.min("first_seen").alias("first_seen"),
        F.max("first_seen").alias("latest_seen"),
    )
    bounds = (
        weak.select("key", F.posexplode(F.concat("gaps", F.array("tail"))).alias("pos", "g"))
        .groupBy("key", "pos")
        .agg(F.min("g.lo").alias("lo"), F.max("g.hi").alias("hi"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("b"))
    )
    alternatives = (
        weak.select("key", "first_seen", F.posexplode(F.arrays_zip("words", "weak")).alias("pos", "x"))
        .groupBy("key", "pos", F.col("x.words").alias("word"), F.col("x.weak").alias("is_weak"))
        .agg(F.max("first_seen").alias("last"))
        .groupBy("key", "pos", "is_weak")
        .agg(F.array_sort(F.collect_list(F.struct("last", "word"))).alias("s"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("is_weak"), F.col("s.word")).alias("alts")))).alias("a"))
    )
    same = lambda n: _null_safe("key", n)
    k = F.size("key")
    merged = (
        whole.join(bounds.withColumnRenamed("key", "b_key"), same("b_key"))
        .join(alternatives.withColumnRenamed("key", "a_key"), same("a_key"))
        .select(
            F.col("key").alias("words"),
            k.alias("k"),
            F.transform(F.slice("b", 1, k), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("gaps"),
            F.struct(F.element_at("b", -1)["lo"].alias("lo"), F.element_at("b", -1)["hi"].alias("hi")).alias("tail"),
            "support",
            "first_seen",
            F.col("a.alts").alias("alts"),
            "n_inputs",
            F.lit(True).alias("is_joined"),
            "latest_seen",
        )
    )
    return plain.unionByName(merged)


def _null_safe(a: str, b: str):
    """Arrays with null elements compared: nulls are told apart from every word by a flag."""
    mark = lambda c: F.transform(c, lambda w: F.struct(w.isNull().alias("weak"), F.coalesce(w, F.lit("")).alias("w")))
    return mark(a) == mark(b)
