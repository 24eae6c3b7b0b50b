"""Registered queries of the line-pattern miner, each over a whole table of the test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linestrata.functions.facilities import FACILITIES, facility_number
from linestrata.functions.words import derive_global, eligible
from linestrata.operators.candidates import candidate_sketch
from linestrata.operators.report import candidates_listed, pattern_text, report_lines, words_listed
from linestrata.operators.tokenize import tokenize
from linestrata.operators.vocabulary import occurrences, sketch_slot, word_sketch
from linestrata.plans import oracle as o
from linestrata.plans.config import MinerConfig
from linestrata.plans.miner import MiningResult, mine
from linestrata.sources.shared import new_folder
from linestrata.sources.text import from_dataframe, read_lines

# ---------------------------------------------------------------- logs


def events_log(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    extra = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string")))
    line = F.concat_ws(" ", F.lit("event"), "event_type", F.lit("user"), F.col("user_id").cast("string"), extra, F.lit("props"), "props")
    return from_dataframe(e.select("event_id", line.alias("line")), "line", "event_id")


def orders_log(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet")
    line = F.concat_ws(
        " ", F.lit("order"), F.col("o_orderkey").cast("string"), F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("status"), "o_orderstatus", "o_orderpriority"
    )
    return from_dataframe(t.select("o_orderkey", line.alias("line")), "line", "o_orderkey")


def _by_line(df: DataFrame, line_id: Column, prefix: Column | None = None) -> DataFrame:
    rows = df.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("p", "line"))
    value = F.col("line") if prefix is None else F.concat_ws(" ", prefix, "line")
    return rows.select((line_id + F.col("p")).alias("line_id"), F.coalesce(value, F.lit("")).alias("value"))


def documents_log(spark: SparkSession, d: str) -> DataFrame:
    return _by_line(spark.read.parquet(f"{d}/documents.parquet"), F.col("doc_id") * 1000000)


def conversations_log(spark: SparkSession, d: str) -> DataFrame:
    return _by_line(spark.read.parquet(f"{d}/conversations.parquet"), F.col("conv_id") * 1000000 + F.col("turn") * 1000, F.col("role"))


def pages_log(spark: SparkSession, d: str) -> DataFrame:
    return from_dataframe(spark.read.parquet(f"{d}/pages.parquet"), "url", "page_id")


def shifts_log(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet")
    key = F.col("o_orderkey")
    start = F.when(key % 7 > 4, "recheck").otherwise(F.concat(F.lit("line "), (key % 7).cast("string")))
    extra = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("x"), F.col("o_custkey").cast("string")))
    line = F.concat_ws(" ", start, F.lit("flag"), "o_orderstatus", F.lit("order"), F.concat(F.lit("n"), key.cast("string")), extra, F.lit("team"), (F.floor(key / 7) % 2).cast("string"))
    return t.select(key.alias("line_id"), line.alias("value"))


def one_id_a_document_log(spark: SparkSession, d: str) -> DataFrame:
    return documents_log(spark, d).withColumn("line_id", F.floor(F.col("line_id") / 1000000).cast("bigint"))


def padded_log(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark, d).withColumn("value", F.concat(F.lit(" "), F.replace("value", F.lit(" user "), F.lit("  user ")), F.lit(" ")))


def mixed_log(spark: SparkSession, d: str) -> DataFrame:
    return events_log(spark, d).unionByName(conversations_log(spark, d).withColumn("line_id", F.col("line_id") + 1000000000))


# ---------------------------------------------------------------- shapes of results

PLAIN, ROLLED = 1.1, 1.0  # percent of all lines
RULE = ("^[0-9]+$", "[0-9]+", "N")
DERIVE = {"wfilter": RULE[0], "wsearch": RULE[1], "wreplace": RULE[2]}
FILTER = "event ([a-z]+) user ([0-9]+)"


def _tokens(df: DataFrame) -> DataFrame:
    return df.select("line_id", F.array_join("tokens", "|").alias("tokens"), F.size("tokens").cast("bigint").alias("n_tokens"))


def _candidates(df: DataFrame, support: str = "own_support") -> DataFrame:
    bounds = F.transform(F.concat("gaps", F.array("tail")), lambda g: F.concat_ws("-", g["lo"].cast("string"), g["hi"].cast("string")))
    return df.select(F.array_join("words", " ").alias("words"), F.array_join(bounds, " ").alias("gaps"), F.col("k").cast("bigint").alias("k"), F.col(support).alias("support"))


def _reduced(df: DataFrame) -> DataFrame:
    return df.where("k > 0").select(
        "line_id",
        F.array_join("words", " ").alias("words"),
        F.array_join(F.transform("gaps", lambda g: g.cast("string")), " ").alias("gaps"),
        F.col("tail").cast("bigint").alias("tail"),
    )


def _report(m: MiningResult, detail: bool = False) -> DataFrame:
    alts = F.col("alts") if "alts" in m.final.columns else None
    return m.final.select(pattern_text(alts, detail).alias("pattern"), "support", F.col("k").cast("bigint").alias("k"))


def _weights(m: MiningResult) -> DataFrame:
    return m.word_weights.select(F.array_join("words", " ").alias("words"), F.col("pos").cast("bigint").alias("pos"), "word", F.round("weight", 6).alias("weight"))


def _in_order(df: DataFrame) -> DataFrame:
    """``df`` (a report) with the place of every row."""
    return df.coalesce(1).select(F.monotonically_increasing_id().alias("place"), "*")


def _ordered_report(m: MiningResult) -> DataFrame:
    return _in_order(m.report.select("pattern", "support", F.col("k").cast("bigint").alias("k")))


def _derived_words(m: MiningResult) -> DataFrame:
    pairs = m.tokenized.select(F.explode(F.arrays_zip(F.col("tokens").alias("word"), F.col("derived").alias("derived"))).alias("x"))
    return pairs.select("x.*").where("derived is not null").distinct()


def _sketched(m: MiningResult) -> DataFrame:
    """Occurrences of every word, and whether its slot has at least as many."""
    counted = occurrences(m.tokenized, m.config).groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))
    slots = word_sketch(m.tokenized, m.config)
    return counted.join(slots, sketch_slot(F.col("word"), m.config.word_sketch_size, m.config.initseed) == F.col("slot")).select("word", "occurrences", (F.col("n") >= F.col("occurrences")).alias("bounded"))


def _counters(m: MiningResult) -> DataFrame:
    return m.lines.sparkSession.createDataFrame(list(m.stats().items()), "counter string, n long")


def _written(df: DataFrame, name: str) -> DataFrame:
    """The lines of a text file that ``df`` was written to."""
    spark = df.sparkSession
    path = new_folder(spark, f"{name}-")
    df.write.text(path)
    return spark.read.text(path, lineSep="\n")


def _histogram(m: MiningResult) -> DataFrame:
    return m.word_histogram.select([F.col(c) for c in m.word_histogram.columns])


def flagship(spark: SparkSession, d: str, support: int) -> DataFrame:
    """Patterns of the events log in report order."""
    return mine(events_log(spark, d), MinerConfig(support=support)).report


# ---------------------------------------------------------------- registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: The run of the query asked for last; its frames are let go when the next one is asked for.
_runs: list[MiningResult] = []


def register(name: str, sql: str, log: Callable, shape: Callable[[MiningResult], DataFrame], **options) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        while _runs:
            _runs.pop().close()
        _runs.append(mine(log(spark, d), MinerConfig(**({"rsupport": PLAIN} | options))))
        return shape(_runs[-1])

    QUERIES[name] = query
    ORACLES[name] = sql


TOKENS = "SELECT line_id, array_to_string(tokens, '|') AS tokens, len(tokens)::BIGINT AS n_tokens FROM tok"
by_percent = o.support(PLAIN)
rolled = o.support(ROLLED)

register("tokenize_default", o.with_(o.tokens(o.EVENTS)) + TOKENS, events_log, lambda m: _tokens(m.tokenized))
register("tokenize_separator", o.with_(o.tokens(o.PAGES, "[/?&=.]+")) + TOKENS, pages_log, lambda m: _tokens(m.tokenized), separator="[/?&=.]+")
register("tokenize_leading_sep", o.with_(o.tokens(o.PADDED, " ")) + TOKENS, padded_log, lambda m: _tokens(m.tokenized), separator=" ")
register("tokenize_cap512", o.with_(o.tokens(o.DOCUMENTS)) + TOKENS, documents_log, lambda m: _tokens(m.tokenized))
register(
    "line_filter",
    o.with_(o.tokens(o.EVENTS, usable="value <> '' AND regexp_matches(value, 'purchase|signup')")) + TOKENS,
    events_log,
    lambda m: _tokens(m.tokenized),
    lfilter="purchase|signup",
)
register(
    "line_template",
    o.with_(
        o.tokens(
            o.EVENTS,
            text=f"regexp_extract(value, '{FILTER}', 1) || ' by ' || regexp_extract(value, '{FILTER}', 2) || ' ' || '' || ' of ' || value",
            usable=f"regexp_matches(value, '{FILTER}')",
        )
    )
    + TOKENS,
    events_log,
    lambda m: _tokens(m.tokenized),
    lfilter=FILTER,
    template="$1 by $2 $9 of $0",
)
register(
    "byte_offset", o.with_(o.tokens(o.EVENTS, text="substr(value, 7)", usable="length(value) > 6")) + TOKENS, events_log, lambda m: _tokens(m.tokenized), byteoffset=6
)
register(
    "line_count_rsupport",
    o.with_(f"lines AS ({o.EVENTS})", by_percent) + "SELECT count(*) AS lines, any_value(s) AS support FROM lines, s",
    events_log,
    lambda m: m.lines.agg(F.count(F.lit(1)).alias("lines")).withColumn("support", F.lit(m.support).cast("bigint")),
)
register("vocabulary_df", o.with_(o.tokens(o.EVENTS), o.VOCABULARY) + "SELECT word, df FROM vocab", events_log, lambda m: m.vocabulary)
register(
    "vocabulary_derived",
    o.with_(o.tokens(o.ORDERS), o.derived(*RULE), o.VOCABULARY_DERIVED) + "SELECT word, df FROM vocab",
    orders_log,
    lambda m: m.vocabulary,
    **DERIVE,
)
register(
    "frequent_words",
    o.with_(o.tokens(o.DOCUMENTS), o.VOCABULARY, o.support(absolute=20), o.FREQUENT) + "SELECT word, df FROM freq",
    documents_log,
    lambda m: m.frequent_words,
    support=20,
)
register(
    "word_freq_histogram",
    o.with_(o.tokens(o.EVENTS), by_percent, o.VOCABULARY)
    + "SELECT count(*) AS words, "
    + ", ".join(f"count(*) FILTER (WHERE df <= {b}) AS df_upto_{b}, floor(count(*) FILTER (WHERE df <= {b}) * 100 / count(*))::BIGINT AS pct_upto_{b}" for b in (1, 2, 5, 10, 20))
    + ", count(*) FILTER (WHERE df < s) AS infrequent, round(count(*) FILTER (WHERE df < s) * 100 / count(*), 2) AS pct_infrequent FROM vocab, s",
    events_log,
    _histogram,
)
QUERIES["word_derive"] = lambda spark, d: (
    tokenize(orders_log(spark, d), MinerConfig(support=1))
    .select(F.explode("tokens").alias("word"))
    .distinct()
    .where(eligible(F.col("word"), "[0-9]-|^[0-9]+$", "[0-9]+"))
    .select("word", derive_global(F.col("word"), "[0-9]+", "N").alias("derived"))
)
ORACLES["word_derive"] = (
    o.with_(o.tokens(o.ORDERS))
    + "SELECT DISTINCT word, regexp_replace(word, '[0-9]+', 'N', 'g') AS derived FROM (SELECT unnest(tokens) AS word FROM tok) WHERE regexp_matches(word, '[0-9]-|^[0-9]+$')"
)
register(
    "word_derive_iterative",
    o.with_(o.tokens(o.ORDERS), o.derived(*RULE)) + "SELECT line_id, array_to_string(list_transform(derived, lambda d: coalesce(d, '-')), '|') AS derived FROM der",
    orders_log,
    lambda m: m.tokenized.select("line_id", F.array_join(F.transform("derived", lambda x: F.coalesce(x, F.lit("-"))), "|").alias("derived")),
    **DERIVE,
)
register(
    "word_sketch",
    o.with_(o.tokens(o.EVENTS)) + "SELECT count(*) AS occurrences FROM (SELECT unnest(tokens) AS w FROM tok) WHERE w <> ''",
    events_log,
    lambda m: word_sketch(m.tokenized, m.config).agg(F.sum("n").alias("occurrences")),
    word_sketch_size=1000,
)
register(
    "word_sketch_prefilter",
    o.with_(o.tokens(o.EVENTS), by_percent, o.VOCABULARY, o.FREQUENT) + "SELECT word, df FROM freq",
    events_log,
    lambda m: m.frequent_words,
    word_sketch_size=250_000,
)
register(
    "cluster_sketch_prefilter",
    o.with_(*o.mining(o.EVENTS, by_percent), o.PLAIN, o.CLUSTERS) + o.CANDIDATE_ROWS.format("support", "clus"),
    events_log,
    lambda m: _candidates(m.clusters, "support"),
    cluster_sketch_size=100_000,
)
REDUCED_ROWS = "SELECT line_id, array_to_string(words, ' ') AS words, array_to_string(gaps, ' ') AS gaps, tail::BIGINT AS tail FROM red"
register("line_reduction", o.with_(*o.mining(o.EVENTS, by_percent)) + REDUCED_ROWS, events_log, lambda m: _reduced(m.reduced))
register(
    "line_reduction_derived", o.with_(*o.mining_derived(o.ORDERS, by_percent, RULE)) + REDUCED_ROWS, orders_log, lambda m: _reduced(m.reduced), **DERIVE
)
register(
    "cluster_candidates", o.with_(*o.mining(o.EVENTS, by_percent)) + o.CANDIDATE_ROWS.format("own_support", "cand"), events_log, lambda m: _candidates(m.candidates)
)
register(
    "cluster_candidates_documents",
    o.with_(*o.mining(o.DOCUMENTS, o.support(absolute=200))) + o.CANDIDATE_ROWS.format("own_support", "cand"),
    documents_log,
    lambda m: _candidates(m.candidates),
    support=200,
)
register(
    "cluster_candidates_derived",
    o.with_(*o.mining_derived(o.ORDERS, by_percent, RULE)) + o.CANDIDATE_ROWS.format("own_support", "cand"),
    orders_log,
    lambda m: _candidates(m.candidates),
    **DERIVE,
)
register("clusters", o.with_(*o.mining(o.EVENTS, by_percent), o.PLAIN, o.CLUSTERS, o.NOT_JOINED, o.rendered()) + o.REPORT, events_log, _report)
register(
    "clusters_documents",
    o.with_(*o.mining(o.DOCUMENTS, o.support(absolute=20)), o.PLAIN, o.CLUSTERS, o.NOT_JOINED, o.rendered()) + o.REPORT,
    documents_log,
    _report,
    support=20,
)
register(
    "clusters_rsupport", o.with_(*o.mining_derived(o.ORDERS, o.support(5.0), RULE), o.PLAIN, o.CLUSTERS, o.NOT_JOINED, o.rendered()) + o.REPORT, orders_log, _report, rsupport=5.0, **DERIVE
)
register("clusters_multi_input", o.with_(*o.mining(o.MIXED, o.support(ROLLED)), o.PLAIN, o.CLUSTERS, o.NOT_JOINED, o.rendered()) + o.REPORT, mixed_log, _report, rsupport=ROLLED)
register(
    "aggregate_supports",
    o.with_(*o.mining(o.EVENTS, rolled), o.ROLLUP) + o.CANDIDATE_ROWS.format("support", "rolled"),
    events_log,
    lambda m: _candidates(m.rolled, "support"),
    rsupport=ROLLED,
    aggrsup=True,
)
register(
    "clusters_aggrsup", o.with_(*o.mining(o.EVENTS, rolled), o.ROLLUP, o.CLUSTERS, o.NOT_JOINED, o.rendered()) + o.REPORT, events_log, _report, rsupport=ROLLED, aggrsup=True
)
JOIN_STEPS = [*o.mining(o.EVENTS, by_percent), o.PLAIN, o.CLUSTERS, o.DEPENDENCY]
register(
    "word_dependency",
    o.with_(*JOIN_STEPS) + "SELECT a, b, round(dep, 6) AS dep FROM dep",
    events_log,
    lambda m: m.dependencies.select("a", "b", F.round("dep", 6).alias("dep")),
)
register("word_weight_f1", o.with_(*JOIN_STEPS, o.weights(1)) + o.WEIGHT_ROWS, events_log, _weights)
register("word_weight_f2", o.with_(*JOIN_STEPS, o.weights(2)) + o.WEIGHT_ROWS, events_log, _weights, weightf=2)
register("join_clusters", o.with_(*JOIN_STEPS, o.weights(1), o.joined(0.5), o.rendered()) + o.REPORT, events_log, _report, wweight=0.5)
register("join_clusters_f2", o.with_(*JOIN_STEPS, o.weights(2), o.joined(0.4), o.rendered()) + o.REPORT, events_log, _report, wweight=0.4, weightf=2)
register(
    "join_with_aggrsup",
    o.with_(*o.mining(o.EVENTS, rolled), o.ROLLUP, o.CLUSTERS, o.DEPENDENCY, o.weights(1), o.joined(0.5), o.rendered()) + o.REPORT,
    events_log,
    _report,
    rsupport=ROLLED,
    aggrsup=True,
    wweight=0.5,
)
GROUPED = "SELECT pattern, support::BIGINT AS support, format('{:,}', support) AS support_fmt, k::INTEGER AS k FROM shown"
register("report_by_support", o.with_(*o.mining(o.EVENTS, by_percent), o.PLAIN, o.CLUSTERS, o.NOT_JOINED, o.rendered()) + GROUPED, events_log, lambda m: m.report)
register(
    "report_by_constants", o.with_(*JOIN_STEPS, o.weights(1), o.joined(0.5), o.rendered()) + GROUPED, events_log, lambda m: m.report, outputmode=1, wweight=0.5
)
register(
    "report_detailtoken", o.with_(*JOIN_STEPS, o.weights(1), o.joined(0.99), o.rendered(True)) + GROUPED, events_log, lambda m: m.report, wweight=0.99, detailtoken=True
)
OUTLIERS = "SELECT line_id, value FROM lines WHERE line_id NOT IN (SELECT line_id FROM red JOIN clus USING (words))"
register("outliers", o.with_(*o.mining(o.EVENTS, by_percent), o.PLAIN, o.CLUSTERS) + OUTLIERS, events_log, lambda m: m.outliers)
register("outliers_documents", o.with_(*o.mining(o.DOCUMENTS, o.support(absolute=20)), o.PLAIN, o.CLUSTERS) + OUTLIERS, documents_log, lambda m: m.outliers, support=20)
register("outliers_aggrsup", o.with_(*o.mining(o.EVENTS, rolled), o.ROLLUP, o.CLUSTERS) + OUTLIERS, events_log, lambda m: m.outliers, rsupport=ROLLED, aggrsup=True)
# derived forms make the patterns, but a line is held against them by its original words
register(
    "outliers_wfilter",
    o.with_(*o.mining_derived(o.ORDERS, by_percent, RULE), o.PLAIN, o.CLUSTERS)
    + "SELECT line_id, value FROM lines WHERE line_id NOT IN (SELECT l.line_id FROM (SELECT line_id, list(t ORDER BY p) AS words FROM placed JOIN freq ON t = word WHERE t <> '' GROUP BY line_id) l JOIN clus ON l.words = clus.words)",
    orders_log,
    lambda m: m.outliers,
    **DERIVE,
)
register(
    "outliers_use_derived",
    o.with_(*o.mining_derived(o.ORDERS, o.support(6.7), RULE), o.PLAIN, o.CLUSTERS) + OUTLIERS,
    orders_log,
    lambda m: m.outliers,
    rsupport=6.7,
    outliers_use_derived=True,
    **DERIVE,
)

# ---------------------------------------------------------------- bytes, repeated ids, words that are joined

register(
    "byte_offset_utf8",
    o.with_(o.tokens(o.DOCUMENTS, text=o.cut_bytes("value", "7"), usable="strlen(value) > 7")) + TOKENS,
    documents_log,
    lambda m: _tokens(m.tokenized),
    byteoffset=7,
)
register(
    "line_chunks",
    f"SELECT line_id, part, {o.cut_bytes('value', 'part * 101', '101')} AS value FROM (SELECT line_id, value, unnest(range(strlen(value) // 101 + 1)) AS part FROM ({o.DOCUMENTS}))",
    documents_log,
    lambda m: m.lines.select("line_id.line_id", F.col("line_id.part").cast("bigint").alias("part"), "value"),
    max_line_bytes=101,
)
documents_20 = o.mining(o.DOCUMENTS, o.support(absolute=20))
register("line_reduction_joined", o.with_(*documents_20) + REDUCED_ROWS, documents_log, lambda m: _reduced(m.reduced), support=20, inline_words=0)
register(
    "line_reduction_joined_derived", o.with_(*o.mining_derived(o.ORDERS, by_percent, RULE)) + REDUCED_ROWS, orders_log, lambda m: _reduced(m.reduced), inline_words=0, **DERIVE
)
ONE_ID = REDUCED_ROWS.replace("SELECT line_id", "SELECT line_id // 1000000 AS line_id")
register("line_reduction_repeated_ids", o.with_(*documents_20) + ONE_ID, one_id_a_document_log, lambda m: _reduced(m.reduced), support=20)
register("line_reduction_joined_repeated_ids", o.with_(*documents_20) + ONE_ID, one_id_a_document_log, lambda m: _reduced(m.reduced), support=20, inline_words=0)

# ---------------------------------------------------------------- replacement again and again

DISTINCT_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(tokens) AS w FROM tok)"
register(
    "word_replace_repeated",
    o.with_(o.tokens(o.ORDERS)).replace("WITH", "WITH RECURSIVE", 1)
    + f""", steps AS (SELECT w AS word, w AS d, 0 AS n FROM ({DISTINCT_WORDS}) WHERE regexp_matches(w, '[0-9]{{2}}')
  UNION ALL SELECT word, regexp_replace(d, '[0-9]{{2}}', '1'), n + 1 FROM steps WHERE regexp_matches(d, '[0-9]{{2}}'))
SELECT word, arg_max(d, n) AS derived FROM steps GROUP BY word""",
    orders_log,
    _derived_words,
    wfilter="[0-9]",
    wsearch="[0-9]{2}",
    wreplace="1",
)
# the second match is the replacement itself, where it ends
register(
    "word_replace_guard",
    o.with_(o.tokens(o.PAGES)) + f"SELECT w AS word, regexp_replace(w, '[A-Za-z0-9]+', 'N') AS derived FROM ({DISTINCT_WORDS}) WHERE regexp_matches(w, '[a-z]')",
    pages_log,
    _derived_words,
    wfilter="[a-z]",
    wsearch="[A-Za-z0-9]+",
    wreplace="N",
)

# ---------------------------------------------------------------- sketches

register(
    "word_sketch_bounds",
    o.with_(o.tokens(o.EVENTS)) + "SELECT w AS word, count(*) AS occurrences, true AS bounded FROM (SELECT unnest(tokens) AS w FROM tok) WHERE w <> '' GROUP BY w",
    events_log,
    _sketched,
    word_sketch_size=50,
)
register(
    "word_sketch_derived_occurrences",
    o.with_(o.tokens(o.ORDERS), o.derived(*RULE)) + "SELECT count(*) AS occurrences FROM (SELECT unnest(list_concat(list_filter(tokens, lambda t: t <> ''), list_filter(derived, lambda t: t IS NOT NULL))) AS w FROM der)",
    orders_log,
    lambda m: word_sketch(m.tokenized, m.config).agg(F.sum("n").alias("occurrences")),
    word_sketch_size=1000,
    **DERIVE,
)
register(
    "word_sketch_derived",
    o.with_(o.tokens(o.ORDERS), o.derived(*RULE), by_percent, o.VOCABULARY_DERIVED, o.FREQUENT) + "SELECT word, df FROM freq",
    orders_log,
    lambda m: m.frequent_words,
    word_sketch_size=250_000,
    **DERIVE,
)
register(
    "cluster_sketch_lines",
    o.with_(*o.mining_derived(o.ORDERS, by_percent, RULE)) + "SELECT count(*) AS lines FROM red",
    orders_log,
    lambda m: candidate_sketch(m.reduced, m.config).agg(F.sum("n").alias("lines")),
    cluster_sketch_size=1000,
    **DERIVE,
)
register(
    "cluster_sketch_derived",
    o.with_(*o.mining_derived(o.ORDERS, by_percent, RULE), o.PLAIN, o.CLUSTERS) + o.CANDIDATE_ROWS.format("support", "clus"),
    orders_log,
    lambda m: _candidates(m.clusters, "support"),
    cluster_sketch_size=100_000,
    **DERIVE,
)

# ---------------------------------------------------------------- dozens of clusters

SHIPPED = [*o.mining(o.SHIFTS, by_percent), o.PLAIN, o.CLUSTERS]
LINKED = [*SHIPPED, o.DEPENDENCY]
register("clusters_shifts", o.with_(*SHIPPED, o.NOT_JOINED, o.rendered()) + o.REPORT, shifts_log, _report)
register("word_weight_shifts", o.with_(*LINKED, o.weights(1)) + o.WEIGHT_ROWS, shifts_log, _weights)
# recheck lines have no weak word and stay as they are, the others meet by flag and status
register("join_clusters_shifts", o.with_(*LINKED, o.weights(1), o.joined(0.33), o.rendered()) + o.REPORT, shifts_log, _report, wweight=0.33)
register("join_clusters_f2_shifts", o.with_(*LINKED, o.weights(2), o.joined(0.2), o.rendered()) + o.REPORT, shifts_log, _report, wweight=0.2, weightf=2)
register(
    "report_order_by_support", o.with_(*SHIPPED, o.NOT_JOINED, o.rendered()) + o.COUNTED_ROWS.format(o.BY_SUPPORT), shifts_log, _ordered_report
)
register(
    "report_order_by_constants",
    o.with_(*LINKED, o.weights(1), o.joined(0.33), o.rendered()) + o.COUNTED_ROWS.format(o.BY_CONSTANTS),
    shifts_log,
    _ordered_report,
    outputmode=1,
    wweight=0.33,
)
register(
    "report_detailtoken_shifts",
    o.with_(*LINKED, o.weights(1), o.joined(0.45), o.rendered(True)) + o.COUNTED_ROWS.format(o.BY_SUPPORT),
    shifts_log,
    _ordered_report,
    wweight=0.45,
    detailtoken=True,
)
register("outliers_shifts", o.with_(*o.mining(o.SHIFTS, o.support(2.4)), o.PLAIN, o.CLUSTERS) + OUTLIERS, shifts_log, lambda m: m.outliers, rsupport=2.4)
COUNTERS = """SELECT 'lines' AS counter, count(*) AS n FROM lines UNION ALL SELECT 'support', s FROM s UNION ALL SELECT 'words', count(*) FROM vocab UNION ALL SELECT 'frequent_words', count(*) FROM freq
UNION ALL SELECT 'candidates', count(*) FROM cand UNION ALL SELECT 'clusters', count(*) FROM clus
UNION ALL SELECT 'outliers', count(*) FROM lines WHERE line_id NOT IN (SELECT line_id FROM red JOIN clus USING (words))"""
EVENT_STEPS = [*o.mining(o.EVENTS, by_percent), o.PLAIN, o.CLUSTERS]
JOINED_COUNTERS = " UNION ALL SELECT 'joined_inputs', coalesce(sum(n_inputs), 0)::BIGINT FROM fin WHERE is_joined UNION ALL SELECT 'joined_outputs', count(*) FROM fin WHERE is_joined"
register(
    "run_counters", o.with_(*EVENT_STEPS, o.DEPENDENCY, o.weights(1), o.joined(0.5)) + COUNTERS + JOINED_COUNTERS, events_log, _counters, wweight=0.5, outliers="-"
)
# with one slot for all words, and one for all candidates, the numbers of slots are known
register(
    "run_counters_sketches",
    o.with_(*EVENT_STEPS) + COUNTERS + " UNION ALL SELECT 'word_slots', 1 UNION ALL SELECT 'cluster_slots', 1",
    events_log,
    _counters,
    word_sketch_size=1,
    cluster_sketch_size=1,
    outliers="-",
)

# ---------------------------------------------------------------- files and lists

register(
    "listed_words",
    o.with_(o.tokens(o.SHIFTS), by_percent, o.VOCABULARY, o.FREQUENT) + "SELECT row_number() OVER (ORDER BY df DESC, word) - 1 AS place, word || ' -- ' || df AS value FROM freq",
    shifts_log,
    lambda m: _in_order(words_listed(m.frequent_words)),
)
register(
    "listed_candidates",
    o.with_(*o.mining(o.EVENTS, by_percent), o.PLAIN, "clus AS (SELECT * FROM rolled)", o.NOT_JOINED, o.rendered())
    + "SELECT row_number() OVER (ORDER BY own_support DESC, pattern) - 1 AS place, pattern || '-- ' || own_support AS value FROM shown",
    events_log,
    lambda m: _in_order(candidates_listed(m.candidates)),
)
register(
    "report_file",
    o.with_(*SHIPPED, o.NOT_JOINED, o.rendered())
    + f"SELECT 3 * place + i AS place, [pattern, 'Support : ' || format('{{:,}}', support), ''][i + 1] AS value FROM ({o.COUNTED_ROWS.format(o.BY_SUPPORT)}), (SELECT unnest(range(3)) AS i)",
    shifts_log,
    lambda m: _in_order(_written(report_lines(m.report.coalesce(1)), "report")),
)
register(
    "outlier_file",
    o.with_(*o.mining(o.EVENTS, by_percent), o.PLAIN, o.CLUSTERS) + OUTLIERS.replace("SELECT line_id, value", "SELECT value", 1),
    events_log,
    lambda m: _written(m.outliers.select("value"), "outliers"),
)


def files_in_order(spark: SparkSession, d: str) -> DataFrame:
    """ord, value of urls written to three folders and read by a glob, by name (a second time), and from a file that isn't there."""
    folder = new_folder(spark, "files-")
    pages_log(spark, d).select((F.col("line_id") % 3).alias("part"), "value").write.partitionBy("part").text(folder)
    parts = [f"{folder}/part={k}" for k in range(3)]
    lines = read_lines(spark, [parts[1], f"{folder}/none-*", parts[0], parts[2], parts[1]])
    return lines.select(F.col("line_id.ord").cast("bigint").alias("ord"), "value")


QUERIES["files_in_order"] = files_in_order
ORACLES["files_in_order"] = f"SELECT n - 1 AS ord, value FROM ({o.PAGES}), (SELECT unnest([1, 0, 2, 1]) AS part, unnest(range(1, 5)) AS n) WHERE line_id % 3 = part"

#: The numbers of the facilities, as the system's header has them.
FACILITY_NUMBERS = [*range(12), 18, 18, 18, *range(16, 24)]
QUERIES["syslog_facilities"] = lambda spark, d: spark.createDataFrame([(name.title(), facility_number(name.title())) for name in FACILITIES], "name string, number long")
ORACLES["syslog_facilities"] = "SELECT * FROM (VALUES " + ", ".join(f"('{name.title()}', {n}::BIGINT)" for name, n in zip(FACILITIES, FACILITY_NUMBERS)) + ") AS t(name, number)"
