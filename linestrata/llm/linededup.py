"""Removal of repeated runs of lines, by winnowing over line hashes.

The lines of a document that aren't blank form its sequence.  A window is
``run`` consecutive lines of it.  Winnowing selects from every window the line
with the smallest hash (the rightmost on a tie) as its fingerprint; neighbouring
windows mostly select the same line, so a document has about one fingerprint for
two lines, and equal windows select equal fingerprints: whatever repeats over
``run`` lines or more is guaranteed to be found.

1.  A fingerprint is one row: the hash, its place, and what surrounds it: the
    digests of the windows that selected it, which reach ``run - 1`` lines up and
    down.  Nothing else of a text is stored.
2.  Fingerprints that occur once in the collection are dropped.  In a collection
    of mostly unlike lines these are nearly all, and none of their windows is
    ever looked at.
3.  From the others a match is extended both ways: their windows are compared
    with the earliest equal one.  A digest has 128 bits, of two hashes of every
    line, so a window that matches has the same lines.  Longer matches go on in
    the fingerprints next to it.
4.  The lines of matched windows are deleted.  So a line is deleted exactly if it
    lies in ``run`` consecutive lines that also start earlier, in a document
    with a smaller id or further up in the same one.

Only DataFrame functions are used.  Counts and earliest places are partial
aggregates; a fingerprint or window with a large share of all rows is joined by
broadcast, and there are few of those (``common.met``), so no task gets all rows
of one line.  Text is shuffled once, to meet the lines to delete.

Defined results
    * null text stays null and has no lines; blank lines are never deleted and
      don't interrupt a run; lines are compared as they are, without their
      line break;
    * very long documents are handled like others, as arrays of line hashes;
    * equal (id, text) rows are one document: none deletes lines of the other;
      equal ids with different texts are ordered by a hash of the text; null ids
      come first;
    * an empty table gives an empty result;
    * other columns are kept by ``without_repeated_runs``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linestrata.llm.common import met, stored, table

#: Consecutive lines that make a run.
RUN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _numbers(text: Column) -> Column:
    """Numbers (from 0) of the lines that aren't blank."""
    return F.filter(F.transform(_lines(text), lambda x, i: F.when(_filled(x), i)), lambda i: i.isNotNull())


def _fingerprints(docs: DataFrame, run: int) -> DataFrame:
    """id, salt, pick (hash of the selected line), start (place of the first window that
    selected it), windows (digests of all that did, one after the other)."""
    other = F.lit(0x9E3779B97F4A7C15 - (1 << 64))
    filled = F.filter(_lines(F.col("body")), _filled)
    sequences = docs.select("id", "salt", F.transform(filled, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(other, x).alias("g"))).alias("s")).where(F.size("s") >= run)

    def window(at: Column) -> Column:
        part = F.slice("s.h", at + 1, run)
        least = F.array_min(part)
        return F.struct(
            (at + run - F.array_position(F.reverse(part), least)).cast("int").alias("at"),
            least.alias("pick"),
            F.struct(F.xxhash64(part).alias("a"), F.xxhash64(other, F.slice("s.g", at + 1, run)).alias("b")).alias("digest"),
        )

    windows = sequences.select("id", "salt", F.transform(F.sequence(F.lit(0), F.size("s") - run), window).alias("w"))
    # places at which another line is selected than in the window before
    fresh = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w.at", i) != F.get("w.at", i - 1)))
    marked = windows.select("id", "salt", "w", fresh.alias("fresh"))

    def one(start: Column, i: Column) -> Column:
        n = F.coalesce(F.get("fresh", i + 1), F.size("w")) - start
        return F.struct(F.get("w.pick", start).alias("pick"), start.alias("start"), F.slice("w.digest", start + 1, n).alias("windows"))

    return marked.select("id", "salt", F.inline(F.transform("fresh", one)))


def repeated_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """id, salt, gone: places in the sequence (from 0) of the lines to delete, in order.

    ``docs`` has columns id, salt (a hash of the text) and body.
    """
    found = stored(_fingerprints(docs, run))
    total = found.count()
    often = found.groupBy(F.col("pick").alias("often")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seeds = stored(
        met(found, often, F.col("pick") == F.col("often"), "n", total, "left_semi")
        .select("id", "salt", "start", F.posexplode("windows").alias("k", "digest"))
        .select(F.struct("id", "salt", (F.col("start") + F.col("k")).alias("start")).alias("at"), "digest.a", "digest.b")
    )
    earliest = (
        seeds.groupBy(F.col("a").alias("e_a"), F.col("b").alias("e_b"))
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    matched = met(seeds, earliest, (F.col("a") == F.col("e_a")) & (F.col("b") == F.col("e_b")), "n", seeds.count()).where(~F.col("at").eqNullSafe(F.col("first")))
    # at most ``run`` numbers for each line of a document
    starts = matched.groupBy("at.id", "at.salt").agg(F.collect_set("at.start").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + run - 1))))
    return starts.select("id", "salt", F.array_sort(covered).alias("gone"))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines between deleted ones, joined again: linear in both."""

    def before(number: Column, i: Column) -> Column:
        begin = F.coalesce(F.get(gone, i - 1), F.lit(-1)) + 1
        return F.slice(lines, begin + 1, number - begin)

    last = F.coalesce(F.element_at(gone, -1), F.lit(-1)) + 1
    return F.array_join(F.flatten(F.concat(F.transform(gone, before), F.array(F.slice(lines, last + 1, F.size(lines))))), "\n")


def _with_kept(docs: DataFrame, run: int) -> DataFrame:
    """``docs`` (id, body and any others) with kept (text), n_lines, n_removed, n_runs."""
    salted = docs.withColumn("salt", F.xxhash64("body"))
    gone = repeated_lines(salted.select("id", "salt", "body"), run).withColumnsRenamed({"id": "g_id", "salt": "g_salt"})
    none = F.array().cast("array<int>")
    joined = salted.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("salt") == F.col("g_salt")), "left")
    joined = joined.withColumn("filled", _numbers(F.col("body"))).withColumn("gone", F.transform("gone", lambda g: F.get("filled", g)))
    starts = F.filter("gone", lambda x, i: (i == 0) | (x != F.get("gone", i - 1) + 1))
    return (
        joined.withColumn("n_lines", F.coalesce(F.size("filled"), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.size(F.coalesce("gone", none)).cast("long"))
        .withColumn("n_runs", F.when(F.col("gone").isNull(), 0).otherwise(F.size(starts)).cast("long"))
        .withColumn("kept", F.when(F.col("gone").isNull(), F.col("body")).otherwise(_kept(_lines(F.col("body")), F.col("gone"))))
        .drop("g_id", "g_salt", "salt", "gone", "filled")
    )


def line_dedup(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is kept), n_lines (not blank), n_removed, n_runs of every row."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    return _with_kept(docs, run).select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "n_lines", "n_removed", "n_runs")


def without_repeated_runs(df: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the repeated runs cut out of its text; rows that lost all their lines go."""
    names = df.columns
    plain = [f"c{i}" for i in range(len(names))]
    key, text = plain[names.index(id_col)], plain[names.index(text_col)]
    source = df.toDF(*plain).withColumnRenamed(text, "body").withColumn("id", F.col(key))
    kept = _with_kept(source, run).where("n_removed = 0 or n_removed < n_lines")
    return kept.select(*[F.col("kept" if c == text else c).alias(n) for c, n in zip(plain, names)])


def op1_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), w AS (
  SELECT doc_id, i, list(line) OVER c AS g, list(p) OVER c AS ps FROM f
  WINDOW c AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING)
), first AS (SELECT g, min((doc_id, i)) AS earliest FROM w WHERE len(g) = {RUN} GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(ps) AS p FROM w JOIN first ON w.g = first.g WHERE (doc_id, i) > earliest
), counted AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p <> q + 1 OR q IS NULL) AS n_runs
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS k FROM l ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), lines AS (SELECT doc_id, count(*) AS n_lines FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(k, '')) END AS kept_sha256
FROM documents d LEFT JOIN counted USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN lines USING (doc_id)
"""
