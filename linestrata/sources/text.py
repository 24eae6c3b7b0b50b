"""Log lines from files or from any DataFrame with a string column."""

from __future__ import annotations

import glob
import logging
import os
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linestrata.functions.bytes import part_of_bytes

log = logging.getLogger("linestrata")

LINES = T.StructType([T.StructField("line_id", T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("block", T.LongType()), T.StructField("seq", T.LongType())])), T.StructField("value", T.StringType())])


def expand(pattern: str) -> list[str]:
    """Local patterns are expanded, one that matches nothing is kept; URLs are left to Spark."""
    if "://" in pattern:
        return [pattern]
    return sorted(glob.glob(pattern)) or [pattern]


def _readable(spark: SparkSession, path: str) -> bool:
    if "://" not in path:
        return os.access(path, os.R_OK)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, inputs: list[str] | tuple[str, ...]) -> DataFrame:
    """line_id, value of all files in order; a path given twice is read twice.

    Only a line feed ends a line.  Unreadable files are reported and skipped.  All
    local files are one scan, whatever their number, and so is each URL.
    """
    paths = []
    for pattern in inputs:
        for path in expand(pattern):
            if _readable(spark, path):
                paths.append(path)
            else:
                log.warning("can't open %s, skipped", path)
    scans = [_scan(spark, [path], number) for number, path in enumerate(paths) if "://" in path]
    local = {number: os.path.abspath(path) for number, path in enumerate(paths) if "://" not in path}
    if local:
        lines = _scan(spark, ["file://" + path for path in dict.fromkeys(local.values())], None)
        files = {urlparse(f).path: unquote(urlparse(f).path) for f in lines.inputFiles()}
        # as many rows as the command line has files
        order = [(f, n) for f, path in files.items() for n, given in local.items() if path == given or path.startswith(given.rstrip("/") + "/")]
        named = F.broadcast(spark.createDataFrame(order, "file string, number int"))
        lines = lines.join(named, F.regexp_replace("line_id.path", "^file:/+", "/") == F.col("file"))
        scans.append(lines.select(F.col("line_id").withField("ord", F.col("number")).alias("line_id"), "value"))
    return reduce(DataFrame.unionByName, scans) if scans else spark.createDataFrame([], LINES)


def _scan(spark: SparkSession, paths: list[str], number: int | None) -> DataFrame:
    # a splittable file gets ids that rise with the position inside a block
    return spark.read.text(paths, lineSep="\n").select(
        F.struct(
            F.lit(number).cast("int").alias("ord"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("line_id"),
        F.col("value"),
    )


def from_dataframe(df: DataFrame, value: str, *ids: str) -> DataFrame:
    """line_id, value from a string column; ``ids`` give the order of lines."""
    line_id = F.col(ids[0]) if len(ids) == 1 else F.struct(*ids) if ids else F.monotonically_increasing_id()
    return df.select(line_id.alias("line_id"), F.coalesce(F.col(value), F.lit("")).alias("value"))


def chunk_lines(lines: DataFrame, max_bytes: int) -> DataFrame:
    """Lines of more than ``max_bytes`` bytes as several rows, as a reader with a fixed buffer has them.

    A line whose length is a multiple of the buffer gives an empty row at its end;
    characters that are cut through become U+FFFD on both sides.
    """
    parts = F.transform(
        F.sequence(F.lit(0), F.floor(F.octet_length("value") / max_bytes).cast("int")),
        lambda i: part_of_bytes(F.col("value"), i * max_bytes + 1, max_bytes),
    )
    return lines.select("line_id", F.posexplode(parts).alias("part", "value")).select(F.struct("line_id", "part").alias("line_id"), "value")
