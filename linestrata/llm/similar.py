"""Near-duplicates by similarity: SimHash BK-trees over shards of shared content.

The fingerprints of ``simhash`` link documents within three bits, which is a
similarity of about 0.95 and more.  Here documents are linked if the sets of
their ``WORDS``-word shingles have a Jaccard similarity of ``SIMILARITY`` or more.
At that similarity fingerprints differ in up to ``RADIUS`` bits, too many for
blocks of bits, so shards are made of content:

1.  Every document has ``BANDS`` keys, each from the minima of its shingle hashes
    under two hash functions.  Documents of the least similarity share one with
    a probability of 0.999995.  Equal shingle sets are one node.
2.  The nodes of a key form a shard with a BK-tree over their fingerprints.  The
    nodes within the radius are candidates.  Sketches (512 slots, standard error
    0.018) skip those that are ``MARGIN`` and more below the threshold; all others
    are linked by the exact similarity of their shingle sets, which are made again
    from the texts of those nodes that share a key.  Nodes met while the tree grows are linked at once; only
    nodes outside the largest linked set search the tree.
3.  A shard over ``shard_limit`` nodes becomes several trees.  When components are
    known, a shard that turns out to be one component is done: links inside it
    join nothing.  Others, in which unlike texts meet, are cut by ``FINER`` further
    minima, of which documents of the least similarity share one with a
    probability of 0.999997; so unlike texts part, instead of each searching all
    trees of the shard.  Only what is still too large (texts that agree in three
    minima) is searched whole, by the nodes outside its largest component.
4.  Components are found by star contraction, and the row of the smallest id of
    each stays.

At this radius the edges of a BK-tree exclude hardly any node, so a tree costs about
as much as comparing with each of its 512 nodes; its size bounds the work, not its
edges.

Defined results
    * texts without words (null, empty, blank) are one node; a text with fewer
      words than a shingle is one shingle;
    * whole texts are hashed, in slices of bounded memory;
    * equal rows leave one row; null ids come last; an empty table stays empty;
    * all columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linestrata.llm.common import id_and_bytes, met, per_batch, stored
from linestrata.llm.components import components
from linestrata.llm.simhash import SEED, SLICE, BKTree

WORDS, SIMILARITY = 5, 0.8
BANDS, SLOTS = 12, 512
#: Further minima, by which large shards are cut.
FINER = 8
#: Bits: nearly all pairs of the least similarity are within it, unrelated ones are at 32 +- 4.
RADIUS = 24
#: By how much an estimate must be below the threshold to decide: over five standard errors.
MARGIN = 0.1
SHARD_LIMIT = 512

_rng = np.random.default_rng(52)
_FACTORS = _rng.integers(0, 1 << 63, 2 * BANDS + FINER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(body: bytes | None, words_per_shingle: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes."""
    words = (body or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle))))
    n = max(1, len(words) - words_per_shingle + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


def fingerprint(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].view(np.uint8), bitorder="little").reshape(-1, 64)
        total += bits.sum(0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def band_keys(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """Keys of the bands, and the further minima."""
    if not len(hashes):
        return [], []
    least = np.full(2 * BANDS + FINER, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), SLICE):
        least = np.minimum(least, (hashes[at : at + SLICE, None] * _FACTORS).min(0))
    pairs = least[: 2 * BANDS].reshape(BANDS, 2)
    return [xxhash.xxh3_64_intdigest(pairs[j].tobytes(), j) - (1 << 63) for j in range(BANDS)], least[2 * BANDS :].view(np.int64).tolist()


def sketch(hashes: np.ndarray) -> bytes:
    """Per slot of the hash's low bits a byte of the smallest hash there; 0 for an empty slot."""
    out = np.zeros(SLOTS, np.uint8)
    if len(hashes):
        slots, first = np.unique(hashes & np.uint64(SLOTS - 1), return_index=True)  # sorted hashes: the first is the smallest
        out[slots.astype(np.int64)] = (hashes[first] >> np.uint64(8)) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of a sketch to each row of ``others``, corrected for bytes that agree by chance."""
    agree = ((others == one) & (one > 0)).sum(1)
    either = np.maximum(((others > 0) | (one > 0)).sum(1), 1)
    return (agree / either - 1 / 255) / (1 - 1 / 255)


def alike(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have this Jaccard similarity or more."""
    if min(len(one), len(other)) < similarity * max(len(one), len(other)) - 1e-9:
        return False
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common >= similarity * (len(one) + len(other) - common) - 1e-9


class _Linker:
    """A BK-tree whose nodes are linked by verified similarity."""

    def __init__(self, radius: int, similarity: float):
        self.tree, self.similarity = BKTree(radius), similarity
        self.nodes: list[int] = []
        self.sketches = np.empty((4, SLOTS), np.uint8)
        self.sets: list[np.ndarray] = []
        self.parent: list[int] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _link(self, i: int, near: list[int]) -> None:
        own = self.root(i)
        apart = [j for j in near if self.root(j) != own]
        if apart:
            about = estimates(self.sketches[i], self.sketches[apart])
            order = np.argsort(-about, kind="stable")
            for j in np.array(apart)[order[about[order] > self.similarity - MARGIN]].tolist():
                a, b = self.root(i), self.root(j)
                if a != b and alike(self.sets[i], self.sets[j], self.similarity):
                    self.parent[max(a, b)] = min(a, b)

    def _put(self, node: int, sketch_: bytes, shingles: bytes) -> int:
        i = len(self.nodes)
        if i == len(self.sketches):
            self.sketches = np.concatenate([self.sketches, np.empty_like(self.sketches)])
        self.sketches[i] = np.frombuffer(sketch_, np.uint8)
        self.sets.append(np.frombuffer(shingles, np.uint64))
        self.nodes.append(node)
        self.parent.append(i)
        return i

    def add(self, node: int, fp: int, sketch_: bytes, shingles: bytes) -> None:
        i = self._put(node, sketch_, shingles)
        self._link(i, self.tree.add(fp))

    def close(self) -> None:
        """Let every node outside the largest linked set search the whole tree."""
        if len(self.nodes) > 2:
            roots = [self.root(i) for i in range(len(self.nodes))]
            largest = int(np.bincount(roots).argmax())
            for i, r in enumerate(roots):
                if r != largest:
                    self._link(i, self.tree.search(self.tree.values[i]))

    def ask(self, node: int, fp: int, sketch_: bytes, shingles: bytes) -> None:
        """Link a node that isn't in the tree."""
        i = self._put(node, sketch_, shingles)
        self._link(i, self.tree.search(fp))
        if self.root(i) == i:  # nothing found: no need to keep it
            self.nodes.pop(), self.parent.pop(), self.sets.pop()

    def edges(self) -> list[tuple[int, int]]:
        return [(self.nodes[i], self.nodes[r]) for i in range(len(self.nodes)) if (r := self.root(i)) != i]


def _link_shards(radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, in a shard first those of the tree and then those that only ask."""
        now, linker, grown = None, _Linker(radius, similarity), False
        out: list[tuple[int, int]] = []

        def batch_of() -> pa.RecordBatch:
            a, b = pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())
            out.clear()
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for batch in batches:
            for key, sub, asks, node, fp, sk, sh in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, sub) != now:
                    if not grown:
                        linker.close()
                    out += linker.edges()
                    now, linker, grown = (key, sub), _Linker(radius, similarity), False
                fp &= (1 << 64) - 1
                if asks:
                    if not grown:
                        linker.close()
                    grown = True
                    linker.ask(node, fp, sk, sh)
                else:
                    linker.add(node, fp, sk, sh)
            if out:
                yield batch_of()
        if not grown:
            linker.close()
        out += linker.edges()
        if out:
            yield batch_of()

    return run


def _documents(df: DataFrame, words_per_shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, salt, node, fp, keys, finer, sketch."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, fps, keys, finer, sketches = [], [], [], [], []
        for body in batch.column(1).to_pylist():
            h = shingle_set(body, words_per_shingle)
            nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63))
            f = fingerprint(h)
            fps.append(f - (1 << 64) if f >> 63 else f)
            bands, more = band_keys(h)
            keys.append(bands)
            finer.append(more)
            sketches.append(sketch(h))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, finer)), pa.array(sketches, pa.binary())],
            ["doc_id", "salt", "node", "fp", "keys", "finer", "sketch"],
        )

    source = id_and_bytes(df, id_col, text_col).withColumn("salt", F.xxhash64("body"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(per_batch(one), f"doc_id {kind}, salt long, node long, fp long, keys array<long>, finer array<long>, sketch binary")


def _shingles(texts: DataFrame, words_per_shingle: int) -> DataFrame:
    """node, shingles of ``texts`` (node, body)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(body, words_per_shingle).tobytes() for body in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.select("node", "body").mapInArrow(per_batch(one, 256), "node long, shingles binary")


def node_components(nodes: DataFrame, texts: DataFrame, words_per_shingle: int, radius: int, similarity: float, shard_limit: int) -> DataFrame:
    """node, root of the nodes that are linked to others.

    ``nodes`` has node, fp, keys, finer, sketch, doc_id, salt; ``texts`` has t_id, t_salt, body.
    """
    link = lambda rows: (
        rows.repartition("key", "sub")
        .sortWithinPartitions("key", "sub", "asks", "node")
        .select("key", "sub", "asks", "node", "fp", "sketch", "shingles")
        .mapInArrow(_link_shards(radius, similarity), "a long, b long")
        .distinct()
    )
    rows = nodes.select("node", F.explode("keys").alias("key"))
    sizes = rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(rows.join(sizes, F.col("key") == F.col("k")).select("key", "n", F.col("node").alias("s_node")))
    wanted = nodes.join(shared.select("s_node").distinct(), F.col("node") == F.col("s_node"), "left_semi").select("node", "doc_id", "salt")
    bodies = texts.join(wanted, F.col("t_id").eqNullSafe(F.col("doc_id")) & (F.col("t_salt") == F.col("salt")))
    sets = _shingles(bodies, words_per_shingle).dropDuplicates(["node"]).withColumnRenamed("node", "h_node")
    whole = stored(nodes.select("node", "fp", "sketch").join(sets, F.col("node") == F.col("h_node")).drop("h_node"))
    trees = F.ceil(F.col("n") / shard_limit)

    def dealt(rows: DataFrame) -> DataFrame:
        """The nodes of ``rows`` (key, n, s_node) with all that their trees need."""
        return rows.join(whole, F.col("s_node") == F.col("node")).select(
            "key", "n", F.pmod(F.xxhash64("key", "node"), trees).alias("sub"), F.lit(False).alias("asks"), "node", "fp", "sketch", "shingles"
        )

    edges = stored(link(dealt(shared)))
    large = shared.where(F.col("n") > shard_limit).select("key", "n", "s_node")
    found = components(edges)
    if large.isEmpty():
        return found
    found = stored(found.select(F.col("node").alias("f_node"), "root"))
    placed = stored(large.join(found, F.col("s_node") == F.col("f_node"), "left").select("key", "n", "s_node", F.coalesce("root", "s_node").alias("root")))
    several = F.min("root") < F.max("root")
    mixed = placed.groupBy(F.col("key").alias("m_key")).agg(F.count(F.lit(1)).alias("m"), several.alias("mixed")).where("mixed")
    parts = (
        met(placed, mixed, F.col("key") == F.col("m_key"), "m", placed.count(), "left_semi")
        .join(nodes.select("node", "finer"), F.col("s_node") == F.col("node"))
        .select("key", "s_node", "root", F.posexplode("finer").alias("j", "least"))
        .select(F.xxhash64("key", "j", "least").alias("key"), "s_node", "root")
    )
    parts = stored(parts)
    kept = parts.groupBy(F.col("key").alias("m_key")).agg(F.count(F.lit(1)).alias("n"), several.alias("mixed")).where("mixed").drop("mixed")
    again = stored(met(parts, kept, F.col("key") == F.col("m_key"), "n", parts.count()).select("key", "n", "s_node", "root"))
    whole_again = again.where(F.col("n") > shard_limit)
    top = (
        whole_again.groupBy("key", "root")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(F.col("key").alias("t_key"))
        .agg(F.max(F.struct("c", "root")).alias("t"), F.sum("c").alias("m"))
        .select("t_key", F.col("t.root").alias("top"), "m")
    )
    outside = met(whole_again, top, F.col("key") == F.col("t_key"), "m", again.count()).where(F.col("root") != F.col("top")).select("key", "n", "s_node")
    asking = (
        dealt(outside)
        .select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), trees - 1)).alias("sub"), F.lit(True).alias("asks"), "node", "fp", "sketch", "shingles", F.col("sub").alias("own"))
        .where("sub <> own")
        .drop("own")
    )
    more = link(dealt(again.select("key", "n", "s_node")).unionByName(asking))
    return components(edges.unionByName(more))


def one_of_each(
    df: DataFrame,
    words_per_shingle: int = WORDS,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``df`` with one row of every component of similar documents."""
    names = df.columns
    plain = [f"c{i}" for i in range(len(names))]
    source = df.toDF(*plain)
    key, text = plain[names.index(id_col)], plain[names.index(text_col)]
    found, roots = _rooted(source, words_per_shingle, similarity, radius, shard_limit, key, text)
    chosen = (
        _firsts(found, roots)
        .groupBy("of")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("kept_id"), F.col("first.salt").alias("kept_salt"))
    )
    salted = source.withColumn("salt", F.xxhash64(F.col(text).cast("binary")))
    kept = salted.join(chosen, F.col(key).eqNullSafe(F.col("kept_id")) & (F.col("salt") == F.col("kept_salt")), "left_semi")
    return kept.dropDuplicates([key, "salt"]).drop("salt").toDF(*names)


def classes(
    df: DataFrame,
    words_per_shingle: int = WORDS,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    shard_limit: int = SHARD_LIMIT,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its component that isn't null) of every row."""
    found, roots = _rooted(df, words_per_shingle, similarity, radius, shard_limit, id_col, text_col)
    firsts = _firsts(found, roots)
    least = firsts.groupBy(F.col("of").alias("l_of")).agg(F.min("first.doc_id").alias("class_id"))
    named = firsts.join(least, F.col("of") == F.col("l_of")).select("l_node", "class_id")
    return found.join(named, F.col("node") == F.col("l_node")).select("doc_id", "class_id")


def _rooted(source: DataFrame, words_per_shingle: int, similarity: float, radius: int, shard_limit: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their nodes, and the roots of nodes that are linked to others."""
    if not 0 < similarity <= 1 or not 0 <= radius <= 64:
        raise ValueError("similarity: over 0, up to 1; radius: 0 to 64")
    found = stored(_documents(source, words_per_shingle, key, text))
    nodes = found.select("node", "fp", "keys", "finer", "sketch", "doc_id", "salt").dropDuplicates(["node"])
    texts = source.select(F.col(key).alias("t_id"), F.col(text).cast("binary").alias("body")).withColumn("t_salt", F.xxhash64("body"))
    return found, node_components(nodes, texts, words_per_shingle, radius, similarity, shard_limit)


def _firsts(found: DataFrame, roots: DataFrame) -> DataFrame:
    """l_node, first (its row of the smallest id, nulls last), of (its component)."""
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "salt")
    least = found.groupBy(F.col("node").alias("l_node")).agg(F.min(rank).alias("first"))
    return least.join(roots, F.col("l_node") == F.col("node"), "left").select("l_node", "first", F.coalesce("root", "l_node").alias("of"))
