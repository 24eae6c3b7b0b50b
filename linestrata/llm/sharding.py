"""Weighted rendezvous hashing of record keys, in DataFrame functions only.

Every record scores every shard with an exponential variate of rate ``weight``
derived from a hash of (key, shard) and goes to the shard with the smallest
score.  A shard gets a share of the keys proportional to its weight, the choice
depends on the key and the shard list alone, and a shard that is added can only
win records from the others: no record moves between two old shards.

Defined results
    * a null key is a key like any other (all null keys share one shard);
    * a null text has size 16 (the fixed overhead) and CRC 0, like an empty one;
    * repeated rows go to one shard and get consecutive slots;
    * an empty table gives an empty result;
    * only the key and text columns are read, so other columns can't clash.

Slots are gapless from 0 within a shard.  They are numbered without bringing a
shard to one task: records are cut into fine buckets by a prefix of the key's
digest, buckets are counted (at most shards x 16**prefix counts, whatever the
input), a running sum over those counts gives each bucket's first slot, and only
rows of one bucket are ranked together.  A bucket that holds more than one in
``HOT_KEYS`` of all rows (a null key, or one that is repeated very often) is cut
again by the whole digest and the part of the input that a row came from, whose
counts are summed in the same way; so rows of one key are numbered by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linestrata.llm.common import HOT_KEYS, stored, table

SHARDS = 40
OVERHEAD = 16
#: Hex digits of the key's digest that name a bucket.
BUCKET_DIGITS = 3
#: Parts of the input by which a crowded bucket is cut.
PARTS = 4096


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digest = F.md5(F.concat_ws(":", key, shard.cast("string")))
    unit = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))
    return -F.ln(unit) / weight


def rendezvous_choice(key: Column, weights: Sequence[float]) -> Column:
    """Array of one (score, shard) struct per shard with a positive weight; its minimum wins."""
    if not weights or any(w < 0 for w in weights) or not any(w > 0 for w in weights):
        raise ValueError("weights: at least one positive number, none negative")
    shards = F.array(
        *[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights) if w > 0]
    )
    return F.transform(shards, lambda s: F.struct(_score(key, s["shard"], s["weight"]).alias("score"), s["shard"].alias("shard")))


def assign_shards(
    df: DataFrame,
    weights: Sequence[float],
    grown_weight: float = 1.0,
    hot_rows: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``df``.

    A bucket of up to ``hot_rows`` rows is never cut again.
    """
    n = len(weights)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = (
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
        .select(
            "doc_id",
            (F.coalesce(F.octet_length("body"), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("body").cast("binary"), F.lit(b""))).cast("long").alias("text_crc32"),
            F.array_min(rendezvous_choice(key, weights)).alias("best"),
            F.array_min(rendezvous_choice(key, [0.0] * n + [grown_weight])).alias("added"),
            F.md5(key).alias("digest"),
        )
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("best.shard").alias("shard"),
            F.when(F.col("added.score") < F.col("best.score"), F.lit(n)).otherwise(F.col("best.shard")).alias("grown_shard"),
            "digest",
            F.substring("digest", 1, BUCKET_DIGITS).alias("bucket"),
        )
    )
    firsts = stored(
        rows.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("shard").alias("in_shard"), F.col("bucket").alias("in_bucket"), "n", (_running(["shard"], ["bucket"]) - F.col("n")).alias("first"))
    )
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = firsts.where(F.col("n") > max(total // HOT_KEYS, hot_rows)).select("in_shard", "in_bucket")  # HOT_KEYS rows at most
    here = (F.col("shard") == F.col("in_shard")) & (F.col("bucket") == F.col("in_bucket"))
    order = ["digest", "doc_id", "size", "text_crc32"]
    if hot.isEmpty():
        return _numbered(rows, firsts, here, ["shard", "bucket"], order)
    cold = _numbered(rows.join(F.broadcast(hot), here, "left_anti"), firsts, here, ["shard", "bucket"], order)
    # stored, as the part of the input must not change
    crowded = stored(rows.join(F.broadcast(hot), here, "left_semi").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))))
    finer = (
        crowded.groupBy("shard", "bucket", "digest", "part")
        .agg(F.count(F.lit(1)).alias("m"))
        .withColumn("before", _running(["shard", "bucket"], ["digest", "part"], "m") - F.col("m"))
        .join(firsts, here)
        .select("in_shard", "in_bucket", F.col("digest").alias("in_digest"), F.col("part").alias("in_part"), (F.col("first") + F.col("before")).alias("first"))
    )
    there = here & (F.col("digest") == F.col("in_digest")) & (F.col("part") == F.col("in_part"))
    return cold.unionByName(_numbered(crowded, finer, there, ["shard", "bucket", "digest", "part"], ["doc_id", "size", "text_crc32"]))


def _running(by: list[str], order: list[str], n: str = "n") -> Column:
    return F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def _numbered(rows: DataFrame, firsts: DataFrame, on: Column, by: list[str], order: list[str]) -> DataFrame:
    """The result, with slots counted from each group's first one."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.join(firsts, on).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"),
        F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


ORACLE = f"""
WITH crc_table AS (
  SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), scored AS (
  SELECT doc_id, text, s,
    -ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || s::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / 1.0 AS score
  FROM documents, (SELECT unnest(range({SHARDS + 1})) AS s)
), chosen AS (
  SELECT doc_id, any_value(text) AS text,
    arg_min(s, score) FILTER (WHERE s < {SHARDS}) AS shard,
    arg_min(s, score) AS grown_shard
  FROM scored GROUP BY doc_id
)
SELECT doc_id,
  coalesce(strlen(text), 0) + {OVERHEAD} AS size,
  xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(text), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
  'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM chosen, crc_table
"""
