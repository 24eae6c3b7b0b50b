"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linestrata.sources.shared import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the UTF-8 bytes of the text; other columns never travel.

    Whatever else ``df`` carries, under whatever names, is pruned here, so it
    can't clash with an operator's own columns.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1024):
    """Wrap a batch -> batch function for ``mapInArrow``; it gets ``rows`` rows at most at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield fn(batch.slice(i, rows))

    return run


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Cuts the lineage: what is lost with an executor is read again, not computed
    again.  The tables are deleted by ``drop_folders``, or when the program ends.
    """
    path = new_folder(df.sparkSession)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


#: No more keys than this can have over one in this many of all rows.
HOT_KEYS = 10_000


def met(left: DataFrame, right: DataFrame, on: Column, n: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, in which ``n`` says how many rows of ``left`` a key has.

    Keys with more than one in ``HOT_KEYS`` of all ``total`` rows, of which there
    are at most ``HOT_KEYS``, are broadcast; the rows of ``left`` that have one
    stay where they are.  Only the others are shuffled, so no task gets much
    more than its share, whatever a key holds.  ``left`` is read twice.
    """
    bound = max(total // HOT_KEYS, 100)
    hot, cold = F.broadcast(right.where(F.col(n) > bound)), right.where(F.col(n) <= bound)
    here = left.join(hot, on, how)
    rest = left.join(hot, on, "left_anti").join(cold, on, how)
    return here.unionByName(rest)
