"""From raw documents to packed sequences: quality, line dedup, near dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and is written as Parquet and read again before the next one.  All but the
last return the columns of ``documents``.

Defined results
    * null texts are rejected by the first stage, like all texts of under 20 words;
    * null ids are ids like any other, save that near dedup keeps another row of a
      component if there is one;
    * equal rows are one document for line dedup and leave one row behind near dedup;
    * long texts are taken whole by every stage; an empty table gives an empty result;
    * other columns stay as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linestrata.llm import decontaminate, linededup, packing, quality, similar
from linestrata.llm.common import table
from linestrata.sources.shared import drop_folders, made_folders, new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; documents that lose all their lines go."""
    return linededup.without_repeated_runs(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return similar.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of benchmark items; documents that are mostly such passages go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, packing.ranks_file())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Compression, tokenizers and XXH64 have no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages before it wrote is deleted once it is read."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        others = set(made_folders())
        path = new_folder(spark, f"pipeline-{name}-")
        stage(spark, docs, sf_dir).write.parquet(path)
        used = [f for f in made_folders() if f not in others and f != path]
        drop = [*used, *([before] if before else [])]
        if drop:
            drop_folders(spark, *drop)
        before = path
        docs = spark.read.parquet(path)
    return docs
