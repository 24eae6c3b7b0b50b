"""SimHash near-duplicates with BK-trees over shards of fingerprints.

1.  A document's fingerprint has bit i set if more than half of its shingles'
    XXH64 hashes have it.  Equal fingerprints become one node, so copies cost
    nothing from here on.
2.  Two fingerprints within ``radius`` bits agree on two of ``radius + 2`` blocks
    of bits.  Each node joins one shard per pair of blocks, named by those bits.
    A shard with more than ``shard_limit`` nodes is cut again: among its free
    bits, split into ``radius + 1`` blocks, two near nodes agree on one block.
    Every cut fixes more bits, so it ends by itself with shards of bounded size,
    and no link is lost on the way.
3.  A shard becomes a BK-tree in the task that its nodes meet in: children are
    keyed by their integer Hamming distance to the parent, and a search follows
    the edges within the radius.  Nodes met within the radius while the tree
    grows are linked at once; only nodes outside the largest linked set then
    search the whole tree, which finds every link that could still join two
    sets.  A shard gives one edge per linked node, never all pairs.
4.  Components of the edges are found by star contraction.

Trees aren't sent to all tasks: that would take all fingerprints through the
driver.  Nodes of a shard and the searches in it meet by a shuffle instead.

Defined results
    * null text and text without words have fingerprint zero and are linked like
      any other; fewer words than a shingle make one shingle;
    * whole texts are hashed, in slices of bounded memory;
    * repeated rows share a component, one row per input row; null ids take part
      and get the smallest id that isn't null of their component, if any;
    * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linestrata.llm.common import id_and_bytes, per_batch, stored, table
from linestrata.llm.components import components

WORDS, RADIUS, SEED = 3, 3, 42
SHARD_LIMIT = 512
SLICE = 1 << 15


def fingerprint(body: bytes | None, words_per_shingle: int = WORDS) -> int:
    words = (body or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    if n < words_per_shingle:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle))))
        n -= words_per_shingle - 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.dtype("<u8"), n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(0, dtype=np.int32)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words_per_shingle: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, salt (a hash of the text) and the fingerprint as a signed 64-bit number; no shuffle."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [fingerprint(b, words_per_shingle) for b in batch.column(1).to_pylist()]
        found = pa.array(np.array(values, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), found], ["doc_id", "salt", "fp"])

    source = id_and_bytes(df, id_col, text_col).withColumn("salt", F.xxhash64("body"))
    return source.mapInArrow(per_batch(one), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, salt long, fp long")


# ---------------------------------------------------------------- shards


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(free: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` blocks of the free bits."""
    return [sum(1 << b for b in free[k * len(free) // parts : (k + 1) * len(free) // parts]) for k in range(parts)]


def first_masks(radius: int) -> list[int]:
    return [a | b for a, b in combinations(_split(list(range(64)), radius + 2), 2)]


def finer_masks(mask: int, radius: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return sorted({mask | m for m in _split(free, radius + 1) if m})


def shards(nodes: DataFrame, radius: int, limit: int) -> DataFrame:
    """(mask, part, fp): shards of 2 to ``limit`` nodes that together hold every pair within ``radius``."""
    spark = nodes.sparkSession
    masks = first_masks(radius)
    rows = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    done = None
    while True:
        rows = rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy(F.col("mask").alias("m"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = stored(rows.join(sizes, (F.col("mask") == F.col("m")) & (F.col("part") == F.col("p"))).select("fp", "mask", "part", "n"))
        fits = met.where(F.col("n") <= limit).select("mask", "part", "fp")
        done = fits if done is None else done.unionByName(fits)
        large = met.where(F.col("n") > limit)
        if large.isEmpty():
            return done
        # the masks of a level are known beforehand: at most 10 * 4**level, level 6 at most
        finer = {m: finer_masks(m, radius) for m in masks}
        steps = spark.createDataFrame([(_signed(m), [_signed(x) for x in xs]) for m, xs in finer.items()], "coarse long, fine array<long>")
        masks = sorted({x for xs in finer.values() for x in xs})
        rows = (
            large.join(F.broadcast(steps), F.col("mask") == F.col("coarse")).select("fp", F.explode("fine").alias("mask")).distinct()
        )


# ---------------------------------------------------------------- trees


class BKTree:
    """Fingerprints; ``children[i]`` maps a distance to the child of node i at it."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> list[int]:
        """Insert; the nodes on the way down that are within the radius."""
        new = len(self.values)
        near = []
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                if d <= self.radius:
                    near.append(at)
                to = self.children[at].get(d)
                if to is None:
                    self.children[at][d] = new
                    break
                at = to
        self.values.append(value)
        self.children.append({})
        return near

    def search(self, value: int) -> list[int]:
        """All nodes within the radius."""
        radius, values, children = self.radius, self.values, self.children
        found, todo = [], [0] if values else []
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                for edge in range(d - radius, d + radius + 1):
                    to = below.get(edge)
                    if to is not None:
                        todo.append(to)
        return found


def linked(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, representative) for the values of a shard that are linked to others."""
    tree = BKTree(radius)
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.add(v):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = [root(i) for i in range(len(values))]
    largest = max(set(roots), key=roots.count) if len(values) < 64 else int(np.bincount(roots).argmax())
    for i, r in enumerate(roots):
        if r != largest:
            for j in tree.search(values[i]):
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def _edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; a shard may go on in the next batch."""
        held: list[int] = []
        key = None

        def close(out: list) -> None:
            if len(held) == 2:
                if (held[0] ^ held[1]).bit_count() <= radius:
                    out.append((held[1], held[0]))
            elif len(held) > 2:
                out += linked(held, radius)
            held.clear()

        def batch_of(out: list) -> pa.RecordBatch:
            a = np.array([x for x, _ in out], np.uint64).view(np.int64)
            b = np.array([x for _, x in out], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            masks, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values = np.asarray(batch.column(2)).view(np.uint64).tolist()
            for mask, part, value in zip(masks, parts, values):
                if key != (mask, part):
                    close(out)
                    key = (mask, part)
                held.append(value)
            if out:
                yield batch_of(out)
        out = []
        close(out)
        if out:
            yield batch_of(out)

    return run


def links(nodes: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span every component."""
    return (
        shards(nodes, radius, shard_limit)
        .repartition("mask", "part")
        .sortWithinPartitions("mask", "part")
        .mapInArrow(_edges(radius), "a long, b long")
        .distinct()
    )


def _rooted(found: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """fp, root: the component of every fingerprint of ``found``."""
    nodes = stored(found.select("fp").distinct())
    roots = components(links(nodes, radius, shard_limit))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(
    df: DataFrame,
    words_per_shingle: int = WORDS,
    radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id reachable) of every row."""
    _check(radius)
    found = stored(fingerprints(df, words_per_shingle, id_col, text_col))
    least = found.groupBy(F.col("fp").alias("f")).agg(F.min("doc_id").alias("first"))
    rooted = _rooted(found, radius, shard_limit).join(least, F.col("fp") == F.col("f"))
    smallest = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, F.col("root") == F.col("of")).select(F.col("fp").alias("node"), "component_id")
    return found.join(named, F.col("fp") == F.col("node")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    df: DataFrame,
    words_per_shingle: int = WORDS,
    radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``df`` with one row of every component: that of the smallest id (null ids come last)."""
    _check(radius)
    names = df.columns
    plain = [f"c{i}" for i in range(len(names))]
    source = df.toDF(*plain)
    key, text = plain[names.index(id_col)], plain[names.index(text_col)]
    found = stored(fingerprints(source, words_per_shingle, key, text))
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "salt")
    least = found.groupBy(F.col("fp").alias("f")).agg(F.min(rank).alias("first"))
    chosen = (
        _rooted(found, radius, shard_limit)
        .join(least, F.col("fp") == F.col("f"))
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("kept_id"), F.col("first.salt").alias("kept_salt"))
    )
    salted = source.withColumn("salt", F.xxhash64(F.col(text).cast("binary")))
    kept = salted.join(chosen, F.col(key).eqNullSafe(F.col("kept_id")) & (F.col("salt") == F.col("kept_salt")), "left_semi")
    return kept.dropDuplicates([key, "salt"]).drop("salt").toDF(*names)


def _check(radius: int) -> None:
    if not 0 <= radius <= 16:
        raise ValueError("radius: 0 to 16")


def op2_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
