"""Lines to their sequences of frequent words, and those to candidates.

A candidate is identified by its words in order (its constants).  ``gaps[i]`` has
the least and the most tokens found before constant i, ``tail`` those after the
last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as JvmColumn

from linestrata.operators.vocabulary import in_heavy_slots, sketch_slot
from linestrata.plans.config import MinerConfig

def is_one_of(words: list[str]) -> Callable[[Column], Column]:
    """A test for membership of ``words``, which reach the JVM in one call and not one by one."""
    if not words:
        return lambda w: F.lit(False)
    end = "\n"
    while any(end in w for w in words):
        end += "\1"
    jvm = SparkSession.active().sparkContext._jvm
    cut = jvm.org.apache.commons.lang3.StringUtils.splitByWholeSeparatorPreserveAllTokens(end.join(words), end)
    listed = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(cut)
    return lambda w: JvmColumn(w._jc.isin(listed))


def _from_constants(df: DataFrame, constants: Column, n_tokens: Column) -> DataFrame:
    """Adds words, gaps, tail, k from an ordered array of (pos, word)."""
    return (
        df.withColumn("_c", constants)
        .withColumn("words", F.col("_c.word"))
        .withColumn("gaps", F.transform("_c", lambda c, i: c["pos"] - F.coalesce(F.get("_c", i - 1)["pos"], F.lit(-1)) - 1))
        .withColumn("tail", n_tokens - 1 - F.coalesce(F.try_element_at("_c.pos", F.lit(-1)), F.lit(-1)))
        .withColumn("k", F.size("_c"))
        .drop("_c")
    )


#: Words that share a slot of a table of words, on average.
WORDS_A_SLOT = 8


def is_in_table(frequent: DataFrame, n_words: int) -> Callable[[Column], Column]:
    """A test for membership of ``frequent`` by a hash table: an array that has the words of each slot at the slot's place.

    The table is made and stays in the JVM; a stage's tasks get it with their code.
    """
    slots = max(1, n_words // WORDS_A_SLOT)
    slot = lambda w: sketch_slot(w, slots, 0)
    every_slot = frequent.sparkSession.range(slots).select(F.col("id").alias("slot"), F.lit(None).cast("string").alias("word"))
    filled = frequent.select(slot(F.col("word")).alias("slot"), "word").unionByName(every_slot).groupBy("slot").agg(F.collect_list("word").alias("words"))
    table = filled.agg(F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("slots")).select(F.transform("slots", lambda s: s["words"]).alias("table"))
    jvm = frequent.sparkSession.sparkContext._jvm
    value = table._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, table._jdf.schema().apply(0).dataType())
    listed = JvmColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))
    return lambda w: F.array_contains(F.get(listed, slot(w).cast("int")), w)


def reduce_lines(tokenized: DataFrame, frequent: DataFrame, known: Callable[[Column], Column] | None, use_derived: bool) -> DataFrame:
    """line_id, value, words, gaps, tail, k of every line (k = 0: no frequent word).

    An original word that is frequent wins; else the derived form counts if that
    is.  ``known`` tests for frequent words inside the expression (no join, no
    shuffle), by a hash set or a table; without it ``frequent`` is joined, and its
    size decides how.  Both give the same rows.
    """
    return _reduced_by_join(tokenized, frequent, use_derived) if known is None else _reduced_inline(tokenized, known, use_derived)


def _reduced_inline(tokenized: DataFrame, known: Callable[[Column], Column], use_derived: bool) -> DataFrame:
    if use_derived:
        pairs = F.zip_with("tokens", "derived", lambda t, d: F.struct(t.alias("t"), d.alias("d")))
        constant = lambda x: F.when(x["t"] != "", F.when(known(x["t"]), x["t"]).when(known(x["d"]), x["d"]))
    else:
        pairs = F.col("tokens")
        constant = lambda t: F.when((t != "") & known(t), t)
    placed = F.filter(F.transform(pairs, lambda x, i: F.struct(i.alias("pos"), constant(x).alias("word"))), lambda c: c["word"].isNotNull())
    return _from_constants(tokenized, placed, F.size("tokens")).drop("tokens", "derived")


def _reduced_by_join(tokenized: DataFrame, frequent: DataFrame, use_derived: bool) -> DataFrame:
    """Tokens meet the frequent words by a join; what isn't frequent goes before lines are put together.

    A line is told from others by a number made for the run, so equal lines of
    one id stay apart.  Its text and id travel once, with its first token.
    """
    row = F.monotonically_increasing_id()
    lines = tokenized.select(row.alias("row"), "line_id", "value", F.size("tokens").alias("n"), "tokens", *(["derived"] if use_derived else []))
    pairs = F.arrays_zip(F.col("tokens").alias("t"), F.col("derived").alias("d")) if use_derived else F.transform("tokens", lambda t: F.struct(t.alias("t")))
    rows = lines.select("row", "line_id", "value", "n", F.posexplode_outer(pairs).alias("pos", "x"))
    head = F.coalesce(F.col("pos"), F.lit(0)) == 0
    rows = rows.select(
        "row", "pos", head.alias("head"), F.when(head, F.struct("line_id", "value", "n")).alias("line"), F.nullif("x.t", F.lit("")).alias("t"), *(["x.d"] if use_derived else [])
    ).where("head or t is not null")
    rows = rows.join(frequent.select(F.col("word").alias("w1")), F.col("t") == F.col("w1"), "left")
    word = F.col("w1")
    if use_derived:
        other = F.when(F.col("w1").isNull() & F.col("t").isNotNull(), F.col("d"))
        rows = rows.join(frequent.select(F.col("word").alias("w2")), other == F.col("w2"), "left")
        word = F.coalesce("w1", "w2")
    rows = rows.select("row", "head", "line", F.when(word.isNotNull(), F.struct("pos", word.alias("word"))).alias("found")).where("head or found is not null")
    # at most as many as a line has tokens
    whole = rows.groupBy("row").agg(F.first("line", ignorenulls=True).alias("line"), F.array_sort(F.collect_list("found")).alias("found"))
    return _from_constants(whole.select("line.*", "found"), F.col("found"), F.col("n")).drop("found", "n")


def candidate_sketch(reduced: DataFrame, config: MinerConfig) -> DataFrame:
    """slot, n: lines whose candidates fall into a slot."""
    return (
        reduced.where("k > 0")
        .groupBy(sketch_slot(F.col("words"), config.cluster_sketch_size, config.initseed).alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def digest() -> Column:
    return F.xxhash64("words")


def shared_digests(reduced: DataFrame) -> DataFrame:
    """digest, n: digests of sequences that several lines have, and how many; a few sequences may share one by chance."""
    return reduced.where("k > 0").groupBy(digest().alias("digest")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_digest_in(rows: DataFrame, digests: DataFrame, how: str = "left_semi") -> DataFrame:
    """Lines whose sequence has (left_anti: hasn't) one of these digests, which every task gets."""
    return rows.join(F.broadcast(digests.select(F.col("digest").alias("listed"))), digest() == F.col("listed"), how)


def single_candidates(rows: DataFrame) -> DataFrame:
    """The candidates of lines (k > 0) of which no two have the same sequence."""
    both = lambda g: F.struct(g.alias("lo"), g.alias("hi"))
    return rows.select("words", "k", F.transform("gaps", both).alias("gaps"), both(F.col("tail")).alias("tail"), F.lit(1).cast("long").alias("own_support"), F.col("line_id").alias("first_seen"))


def shapes(reduced: DataFrame, config: MinerConfig, support: int) -> DataFrame:
    """words, bounds (gaps and tail), n, first_seen: lines counted by their sequence and its gaps."""
    rows = reduced.where("k > 0")
    count = lambda rows: rows.groupBy("words", F.concat("gaps", F.array("tail")).alias("bounds")).agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_seen"))
    if not config.cluster_sketch_size:
        return count(rows)
    slot = sketch_slot(F.col("words"), config.cluster_sketch_size, config.initseed)
    return in_heavy_slots(rows, slot, candidate_sketch(reduced, config), support, config.cluster_sketch_size, count)


def candidates(shapes: DataFrame) -> DataFrame:
    """words, k, gaps, tail, own_support, first_seen of every sequence.

    Most sequences have one shape, which is both bounds.  Only the others are
    taken apart place by place, with partial minima and maxima, so a sequence
    with any number of gap combinations is never collected.
    """
    k = F.size("words")
    whole = shapes.groupBy("words").agg(
        F.sum("n").alias("own_support"), F.min("first_seen").alias("first_seen"), F.min("bounds").alias("least"), F.max("bounds").alias("most")
    )
    several = whole.where("least <> most").select(F.col("words").alias("s_words"))
    bounds = (
        shapes.join(several, F.col("words") == F.col("s_words"), "left_semi")
        .select("words", F.posexplode("bounds").alias("pos", "gap"))
        .groupBy("words", "pos")
        .agg(F.min("gap").alias("lo"), F.max("gap").alias("hi"))
        .groupBy(F.col("words").alias("b_words"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("b"))
    )
    one = F.transform("least", lambda g: F.struct(g.alias("lo"), g.alias("hi")))
    many = F.transform("b", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))
    listed = whole.join(bounds, F.col("words") == F.col("b_words"), "left").withColumn("all", F.coalesce(many, one))
    return listed.select("words", k.alias("k"), F.slice("all", 1, k).alias("gaps"), F.element_at("all", -1).alias("tail"), "own_support", "first_seen")


def clusters(rolled: DataFrame, support: int) -> DataFrame:
    """Candidates whose (possibly rolled-up) support reaches the threshold."""
    return rolled.where(F.col("support") >= support)
