"""Patterns as text, in the order of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestrata.functions.words import grouped_number


def _gap(g: Column) -> Column:
    return F.concat(F.lit("*{"), g["lo"].cast("string"), F.lit(","), g["hi"].cast("string"), F.lit("}"))


def pattern_text(alts: Column | None = None, detailtoken: bool = False) -> Column:
    """``*{lo,hi} word ... *{lo,hi}``: a space behind every word, none behind the tail."""

    def shown(word: Column, several: Column) -> Column:
        options = F.array_join(several, "|")
        bracketed = F.concat(F.lit("("), options, F.lit(")"))
        single = bracketed if detailtoken else options
        return F.when(several.isNull(), word).when(F.size(several) > 1, bracketed).otherwise(single)

    places = F.arrays_zip(
        F.col("gaps").alias("g"), F.col("words").alias("w"), *([alts.alias("a")] if alts is not None else [])
    )
    if alts is not None:
        body = F.transform(places, lambda x: F.concat(F.when(x["g"]["hi"] != 0, F.concat(_gap(x["g"]), F.lit(" "))).otherwise(""), shown(x["w"], x["a"]), F.lit(" ")))
    else:
        body = F.transform(places, lambda x: F.concat(F.when(x["g"]["hi"] != 0, F.concat(_gap(x["g"]), F.lit(" "))).otherwise(""), x["w"], F.lit(" ")))
    return F.concat(F.array_join(body, ""), F.when(F.col("tail.hi") != 0, _gap(F.col("tail"))).otherwise(""))


def report(final: DataFrame, outputmode: int = 0, detailtoken: bool = False) -> DataFrame:
    """pattern, support, support_fmt, k in report order.

    Mode 0 goes by falling support; mode 1 by the number of constants, and there
    first plain patterns, the newest first, then joined ones, the oldest of
    their latest inputs first.
    """
    alts = F.col("alts") if "alts" in final.columns else None
    if alts is None:
        final = final.withColumn("is_joined", F.lit(False)).withColumn("latest_seen", F.col("first_seen"))
    text = pattern_text(alts, detailtoken)
    if outputmode == 1:
        order = ["k", "is_joined", F.when(F.col("is_joined"), F.col("latest_seen")).asc(), F.desc("first_seen"), "pattern"]
    else:
        order = [F.desc("support"), "k", F.desc("first_seen"), "pattern"]
    return final.withColumn("pattern", text).orderBy(*order).select("pattern", "support", grouped_number(F.col("support")).alias("support_fmt"), "k")


def report_lines(rows: DataFrame) -> DataFrame:
    """value: each pattern, its support and an empty line."""
    return rows.select(F.explode(F.array(F.col("pattern"), F.concat(F.lit("Support : "), "support_fmt"), F.lit(""))).alias("value"))


def words_listed(frequent: DataFrame) -> DataFrame:
    """value: the frequent words and their lines, the most frequent first."""
    return frequent.orderBy(F.desc("df"), "word").select(F.concat_ws(" -- ", "word", F.col("df").cast("string")).alias("value"))


def candidates_listed(candidates: DataFrame) -> DataFrame:
    """value: the candidates and their own lines, the most frequent first."""
    shown = candidates.withColumn("pattern", pattern_text())
    return shown.orderBy(F.desc("own_support"), "pattern").select(F.concat_ws("-- ", "pattern", F.col("own_support").cast("string")).alias("value"))
