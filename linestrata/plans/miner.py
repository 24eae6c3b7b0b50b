"""One mining run as a set of lazy DataFrames."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linestrata.operators import candidates as c
from linestrata.operators import join as j
from linestrata.operators import report as r
from linestrata.operators import rollup as u
from linestrata.operators import vocabulary as v
from linestrata.operators.outliers import outliers
from linestrata.operators.tokenize import tokenize
from linestrata.plans.config import MinerConfig
from linestrata.sources.text import chunk_lines, read_lines

log = logging.getLogger("linestrata")

#: Frequent words up to which lines are taken to have few different sequences of them.
FEW_WORDS = 1_000


class MiningResult:
    """Everything a run can be asked for; nothing is computed before it is.

    Two small things are: the support, where it is a percentage (one count), and
    the frequent words, as long as there are few.  Frames that are used again are
    the size of the vocabulary or of the candidates and are kept in memory (and
    on disk) by ``persist``; ``close``, or leaving a ``with`` block, lets them go.
    Lines are never kept: every pass reads them again.
    """

    def __init__(self, lines: DataFrame, config: MinerConfig):
        self.config = config
        lines = spread(lines)
        self.lines = chunk_lines(lines, config.max_line_bytes) if config.max_line_bytes else lines
        self._kept: list[DataFrame] = []

    def __enter__(self) -> MiningResult:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    def close(self) -> None:
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    @cached_property
    def line_count(self) -> int:
        return self.lines.count()

    @cached_property
    def support(self) -> int:
        """The absolute threshold; a given one wins over a percentage."""
        return self.config.support or v.relative_support(self.line_count, self.config.rsupport)

    @cached_property
    def tokenized(self) -> DataFrame:
        return v.with_derived(tokenize(self.lines, self.config), self.config)

    @cached_property
    def vocabulary(self) -> DataFrame:
        return v.vocabulary(self.tokenized, self.config, self.support)

    @cached_property
    def frequent_words(self) -> DataFrame:
        return self._keep(v.frequent_words(self.vocabulary, self.support))

    @cached_property
    def _few_words(self) -> list[str] | None:
        """The frequent words if they are few enough to be part of an expression."""
        most = self.config.inline_words
        rows = self.frequent_words.select("word").limit(most + 1).collect()
        return None if len(rows) > most else [x[0] for x in rows]

    @cached_property
    def _known(self) -> Callable[[Column], Column] | None:
        """A test for frequent words, if they aren't too many for every task to have."""
        if self._few_words is not None:
            return c.is_one_of(self._few_words)
        n, size = self.frequent_words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
        # beside its bytes a word has an offset, is filled up to eight bytes, and has a part of its slot
        return c.is_in_table(self.frequent_words, n) if 24 * n + size <= self.config.table_bytes else None

    def _reduce(self, tokenized: DataFrame, use_derived: bool) -> DataFrame:
        return c.reduce_lines(tokenized, self.frequent_words, self._known, use_derived)

    @cached_property
    def nothing_frequent(self) -> bool:
        return self.frequent_words.isEmpty()

    @cached_property
    def word_histogram(self) -> DataFrame:
        return v.frequency_histogram(self.vocabulary, self.support)

    @cached_property
    def reduced(self) -> DataFrame:
        return self._reduce(self.tokenized, self.config.derives)

    @cached_property
    def _shared(self) -> DataFrame | None:
        """Digests of sequences that several lines have, if words are many and these digests aren't.

        With many words most sequences occur once.  Only the others have to meet by
        a shuffle, and only those of enough lines can be clusters.  With few words
        partial counts are small, and another pass isn't worth it.
        """
        if self._few_words is not None and len(self._few_words) <= FEW_WORDS:
            return None
        shared = self._keep(c.shared_digests(self.reduced))
        return shared if shared.count() <= v.MAX_KEYS else None

    def _counted(self, reduced: DataFrame) -> DataFrame:
        return c.candidates(self._keep(c.shapes(reduced, self.config, self.support)))

    @cached_property
    def candidates(self) -> DataFrame:
        if self._shared is None or self.config.cluster_sketch_size:
            return self._keep(self._counted(self.reduced))
        single = c.single_candidates(c.with_digest_in(self.reduced.where("k > 0"), self._shared, "left_anti"))
        whole = single.unionByName(self._counted(c.with_digest_in(self.reduced, self._shared)))
        # as large as the lines: kept only for those who read it again and again
        return self._keep(whole) if self.config.aggrsup or self.config.wweight > 0 else whole

    @cached_property
    def rolled(self) -> DataFrame:
        return self._keep(u.roll_up(self.candidates)) if self.config.aggrsup else u.without_roll_up(self.candidates)

    @cached_property
    def clusters(self) -> DataFrame:
        if self.config.aggrsup or self.config.wweight > 0 or self.config.cluster_sketch_size or self.support < 2 or self._shared is None:
            return c.clusters(self.rolled, self.support)
        # candidates that no line makes a cluster aren't needed
        enough = c.with_digest_in(self.reduced, self._shared.where(F.col("n") >= self.support))
        return c.clusters(u.without_roll_up(self._keep(self._counted(enough))), self.support)

    @cached_property
    def dependencies(self) -> DataFrame:
        return j.dependency(self._keep(j.co_occurrence(self.candidates, self.clusters)))

    @cached_property
    def word_weights(self) -> DataFrame:
        return self._keep(j.word_weights(self.clusters, self.dependencies, self.config.weightf))

    @cached_property
    def final(self) -> DataFrame:
        """Clusters, joined if a weight threshold is set."""
        if self.config.wweight <= 0:
            return self.clusters
        return j.join_clusters(self.clusters, self.word_weights, self.config.wweight)

    @cached_property
    def report(self) -> DataFrame:
        return r.report(self.final, self.config.outputmode, self.config.detailtoken)

    @cached_property
    def outliers(self) -> DataFrame:
        """Lines that match no cluster; none at all if no word is frequent."""
        if self.nothing_frequent:
            return self.lines.limit(0)
        if self.config.derives and not self.config.outliers_use_derived:
            keys = self._reduce(self.tokenized.drop("derived"), False)
        else:
            keys = self.reduced
        listed = self._keep(self.clusters.select("words"))
        few = listed.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0] <= v.MAX_KEYS
        return outliers(keys, F.broadcast(listed) if few else listed)

    def stats(self) -> dict[str, int]:
        """Counters of the run; computes what it counts."""
        found = {"lines": self.line_count, "support": self.support, "words": self.vocabulary.count(), "frequent_words": self.frequent_words.count()}
        if self.config.word_sketch_size:
            found["word_slots"] = v.word_sketch(self.tokenized, self.config).where(F.col("n") >= self.support).count()
        if self.config.cluster_sketch_size:
            found["cluster_slots"] = c.candidate_sketch(self.reduced, self.config).where(F.col("n") >= self.support).count()
        found |= {"candidates": self.candidates.count(), "clusters": self.clusters.count()}
        if self.config.wweight > 0:
            row = self.final.where("is_joined").agg(F.coalesce(F.sum("n_inputs"), F.lit(0)), F.count(F.lit(1))).first()
            found |= {"joined_inputs": row[0], "joined_outputs": row[1]}
        if self.config.outliers:
            found["outliers"] = self.outliers.count()
        return found


def spread(lines: DataFrame) -> DataFrame:
    """Lines of a scan with fewer splits than there are cores, dealt out to all cores.

    A file that can't be split (one row group, say) would leave the rest of the
    cluster without work in every pass.  Large input has more splits and stays as
    it is, as does whatever has been shuffled before.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    plan = lines._jdf.queryExecution().executedPlan()
    if lines.isStreaming or plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or lines.rdd.getNumPartitions() >= cores:
        return lines
    return lines.repartition(cores)


def mine(source: DataFrame | SparkSession, config: MinerConfig) -> MiningResult:
    """Mine a DataFrame with columns line_id and value, or the files that ``config`` names."""
    if isinstance(source, SparkSession):
        source = read_lines(source, config.inputs)
    kind = source.schema["value"].dataType
    if not isinstance(kind, T.StringType):
        raise TypeError("value must be a string column")
    return MiningResult(source.select("line_id", "value"), config)
