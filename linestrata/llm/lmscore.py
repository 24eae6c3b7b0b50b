"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts a word from ``SIDE`` words on either side: their embeddings,
scaled by place, are added and squashed; the word's class (64 of them) and its
place in the class (64) are two softmaxes.  A document's score is the sum of the
log-probabilities of all its words, each given both sides.  A word that isn't a
number of its own is predicted as its hash bucket, times its share of the bucket.

Training sees the whole collection:

1.  Words are counted over all documents.  The most frequent ones are the
    vocabulary, a model parameter; other words fall into hash buckets.  The counts
    of all words stay a stored table.
2.  The model starts as the unigram model of those counts.
3.  In each round every task runs minibatch steps (Adagrad, in numpy) over its
    part of the documents and sends back its parameters.  Every position is a
    target once: a word isn't in its own window, so each is masked for itself.
    They are averaged, weighted by words, with a partial aggregate per parameter,
    so that no task and not the driver sees more than one model at a time.  Every
    document belongs to exactly one round.

A word's share of its bucket is its part of the bucket's count.  For rare words
(``RARE`` occurrences or fewer) it also depends on what the collection has
elsewhere in the same place, between the same ``SIDE`` words on either side: of n
other words of the bucket there, the word itself being c, the share is
(count / bucket + c) / (1 + n), a mixture of both that sums to one over the words
of a bucket.  A word never counts for itself.  This memory grows with the collection.

Only the model (about 75,000 numbers, whatever the input), the sizes of the
buckets and the counts of at most ``CACHED`` frequent words are collected and
broadcast; the others meet their counts and places by a shuffle.  No word and no
place can be common there: words are rare, and a place is cut by 1,024 buckets.
A lost task is trained again from the same model and rows.

Defined results
    * null, empty and blank text has no words: score 0 and no mean;
    * whole texts are trained on and scored, in slices of bounded memory;
    * a bucket keeps the mass of half an occurrence for words that were never counted;
    * repeated rows get the same score up to the rounding of single precision, one
      row per input row; ids may be null;
    * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linestrata.llm.common import id_and_bytes, stored, table

CLASSES = PLACES = 64
SIZE = CLASSES * PLACES
KNOWN = 3072
DIM = 16
SIDE = 2
PAD = SIZE
#: Documents are dealt to rounds by a hash of the text; the first, smaller round finds the direction.
ROUNDS = 2
SLICE = 1 << 12
SHAPES = {
    "embed": (SIZE + 1, DIM),
    "scale": (2 * SIDE, DIM),
    "shift": (DIM,),
    "to_class": (DIM, CLASSES),
    "class_bias": (CLASSES,),
    "class_embed": (CLASSES, DIM),
    "to_place": (DIM, PLACES),
    "place_bias": (CLASSES, PLACES),
}
STEP = 0.05
#: Occurrences that a bucket has for words that weren't counted; the unigram model adds as many to each number.
UNSEEN = 0.5
ONES = np.ones(64, np.float32)
#: Words of up to so many occurrences are held against other places like theirs.
RARE = 64
#: Words with more occurrences whose counts are sent to all tasks, the most frequent first.
CACHED = 1 << 18
#: A vocabulary entry is the number and, above these bits, the place of the word's count among those sent.
NUMBER = (1 << 13) - 1


class Model:
    """Named float32 arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.__dict__.update(arrays)

    @classmethod
    def unigram(cls, counts: np.ndarray, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        a = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        a["embed"] = rng.normal(0, 0.3, SHAPES["embed"]).astype(np.float32)
        a["embed"][PAD] = 0
        a["scale"] += 1
        a["to_class"] = rng.normal(0, 0.1, SHAPES["to_class"]).astype(np.float32)
        a["to_place"] = rng.normal(0, 0.1, SHAPES["to_place"]).astype(np.float32)
        mass = counts.reshape(CLASSES, PLACES).astype(np.float64) + UNSEEN
        a["class_bias"] = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
        a["place_bias"] = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
        return cls(a)

    @classmethod
    def unflatten(cls, flat: np.ndarray) -> Model:
        a, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            a[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n
        return cls(a)

    def flatten(self) -> np.ndarray:
        return np.concatenate([self.arrays[k].ravel() for k in SHAPES])

    def copy(self) -> Model:
        return Model({k: v.copy() for k, v in self.arrays.items()})

    def _forward(self, around: np.ndarray, target: np.ndarray):
        e = [self.embed[around[:, k]] for k in range(2 * SIDE)]
        h = e[0] * self.scale[0]
        for k in range(1, 2 * SIDE):
            h += e[k] * self.scale[k]
        h += self.shift
        np.tanh(h, out=h)
        group, place = target >> 6, target & 63
        g = h + self.class_embed[group]
        p1, p2 = h @ self.to_class, g @ self.to_place
        p1 += self.class_bias
        p2 += self.place_bias[group]
        rows = np.arange(len(target))
        logp = p1[rows, group] + p2[rows, place]
        for p in (p1, p2):
            top = p.max()
            if top > 60:  # never seen; keeps the exponentials finite
                np.minimum(p, 60, out=p)
            np.exp(p, out=p)
        s1, s2 = p1 @ ONES, p2 @ ONES
        logp -= np.log(s1) + np.log(s2)
        return logp, (e, h, g, group, place, rows, p1, p2, s1, s2)

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        return self._forward(around, target)[0]

    def step(self, around: np.ndarray, target: np.ndarray, memory: dict[str, np.ndarray], rate: float = STEP) -> float:
        """One Adagrad step on the mean loss; the mean log-probability before it."""
        logp, (e, h, g, group, place, rows, p1, p2, s1, s2) = self._forward(around, target)
        n = np.float32(len(target))
        p1 /= s1[:, None] * n
        p2 /= s2[:, None] * n
        p1[rows, group] -= 1 / n
        p2[rows, place] -= 1 / n
        dg = p2 @ self.to_place.T
        dh = (p1 @ self.to_class.T + dg) * (1 - h * h)
        every = np.ones(len(target), np.float32)
        of_class = np.zeros((len(target), CLASSES), np.float32)
        of_class[rows, group] = 1
        grads = {
            "to_class": h.T @ p1,
            "class_bias": every @ p1,
            "to_place": g.T @ p2,
            "scale": np.stack([every @ (x * dh) for x in e]),
            "shift": every @ dh,
            "class_embed": of_class.T @ dg,
            "place_bias": of_class.T @ p2,
        }
        ids = around.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")  # of 16 bits: a radix sort
        ids = ids[order]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        part = np.add.reduceat((dh[:, None, :] * self.scale).reshape(-1, DIM)[order], heads, axis=0)
        at = ids[heads]
        part, at = part[at != PAD], at[at != PAD]
        memory["embed"][at] += part * part
        self.embed[at] -= rate * part / np.sqrt(memory["embed"][at] + 1e-8)
        for name, grad in grads.items():
            memory[name] += grad * grad
            self.arrays[name] -= rate * grad / np.sqrt(memory[name] + 1e-8)
        return float(logp.mean())


class Vocabulary(dict):
    """word -> number; words that aren't known get the number of a hash bucket.

    A word whose count is among those sent has the place of the count above the
    number.  ``counted`` (word, n) has all words; ``logs`` are the logarithms of
    the counts sent, the first being 0, for known words; ``buckets`` are the sizes
    of the buckets.
    """

    counted: DataFrame
    logs: np.ndarray
    buckets: np.ndarray

    def __missing__(self, word: bytes) -> int:
        return KNOWN + zlib.crc32(word) % (SIZE - KNOWN)


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").lower().split()


def windows(bodies: list[bytes | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One padded sequence of all texts' entries; the positions of words; the words per text."""
    number = vocabulary.__getitem__
    gap = [PAD] * SIDE
    parts, sizes = [gap], []
    for body in bodies:
        words = words_of(body)
        sizes.append(len(words))
        if words:
            parts.append(np.fromiter(map(number, words), np.int64, len(words)))
            parts.append(gap)
    sequence = np.concatenate(parts).astype(np.int64)
    return sequence, np.flatnonzero(sequence != PAD), np.array(sizes, np.int64)


def numbers(sequence: np.ndarray) -> np.ndarray:
    return sequence & NUMBER


def slices(sequence: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    steps = np.array([k for k in range(-SIDE, SIDE + 1) if k])
    for i in range(0, len(at), SLICE):
        part = at[i : i + SLICE]
        yield sequence[part[:, None] + steps], sequence[part]


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for body in batch.column(0).to_pylist():
                seen.update(words_of(body))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    return docs.select("body").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Model]:
    """Vocabulary and model of all ``docs`` (body)."""
    counted = stored(count_words(docs))
    bucket = F.pmod(F.crc32("word"), F.lit(SIZE - KNOWN))
    top = counted.orderBy(F.desc("n"), "word").limit(KNOWN).collect()  # the vocabulary: a size of the model
    vocabulary = Vocabulary({bytes(r["word"]): i for i, r in enumerate(top)})
    counts = np.zeros(SIZE, np.int64)
    for i, r in enumerate(top):
        counts[i] = r["n"]
    for r in counted.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():  # SIZE - KNOWN rows
        counts[KNOWN + r["b"]] = r["n"]
    for r in top:
        counts[KNOWN + zlib.crc32(bytes(r["word"])) % (SIZE - KNOWN)] -= r["n"]
    often = counted.where(F.col("n") > RARE).orderBy(F.desc("n"), "word").limit(CACHED).toArrow()  # CACHED rows at most
    logs = [0.0]
    for word, n in zip(often.column("word").to_pylist(), often.column("n").to_pylist()):
        if word not in vocabulary:
            vocabulary[word] = vocabulary[word] | len(logs) << 13
            logs.append(math.log(n))
    vocabulary.counted, vocabulary.logs, vocabulary.buckets = counted, np.array(logs), counts[KNOWN:] + UNSEEN
    model = Model.unigram(counts)
    sc = docs.sparkSession.sparkContext
    for k in range(rounds):
        # 1 of 4 texts in the first round, the others shared out by the later ones
        turn = F.pmod(F.xxhash64("body"), F.lit(4 * max(1, rounds - 1)))
        mine = docs if rounds == 1 else docs.where(turn % 4 == 0) if k == 0 else docs.where((turn % 4 > 0) & (F.floor(turn / 4) == k - 1))
        sent = sc.broadcast((dict(vocabulary), model.flatten()))
        rows = mine.select("body").mapInArrow(_train(sent), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        if rows:  # one per parameter, and the weight
            got = np.zeros(len(model.flatten()) + 1)
            for i, v in rows:
                got[i] = v
            if got[-1] > 0:
                model = Model.unflatten(got[:-1] / got[-1])
        sent.unpersist()
    return vocabulary, model


def _train(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = sent.value
        vocabulary, model = Vocabulary(known), Model.unflatten(flat)
        memory = {k: np.zeros(s, np.float32) + np.float32(1e-6) for k, s in SHAPES.items()}
        seen = 0
        for batch in batches:
            bodies = batch.column(0).to_pylist()
            for i in range(0, len(bodies), 512):
                sequence, at, _ = windows(bodies[i : i + 512], vocabulary)
                seen += len(at)
                for around, target in slices(numbers(sequence), at):
                    model.step(around, target, memory)
        if seen:
            out = np.append(model.flatten().astype(np.float64) * seen, float(seen))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["i", "v"])

    return run


def places(sequence: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For words of a bucket at positions ``at`` one number of the words around and the bucket; -1 at an edge of the text."""
    steps = [k for k in range(-SIDE, SIDE + 1) if k]
    found, edge = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for k in steps:
        near = sequence[at + k]
        edge |= near == PAD
        found = found << 12 | near
    found = found << 10 | (sequence[at] - KNOWN)
    found[edge] = -1
    return found


def score(df: DataFrame, vocabulary: Vocabulary, model: Model, id_col: str = "doc_id", text_col: str = "text", trained: bool = False) -> DataFrame:
    """doc_id, n_tokens, log_prob (sum over all words), mean_log_prob of every row.

    The network scores texts where they are; rare words are then shuffled, to meet
    their counts and, if ``df`` is the collection that the model was ``trained`` on,
    the places like theirs.
    """
    source = id_and_bytes(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast((dict(vocabulary), vocabulary.logs, vocabulary.buckets, model.flatten()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, buckets, flat = sent.value
        words, net = Vocabulary(known), Model.unflatten(flat)
        spread = np.concatenate([np.zeros(KNOWN), np.log(buckets)])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                bodies = part.column(1).to_pylist()
                entries, at, n = windows(bodies, words)
                sequence = numbers(entries)
                parts = [net.log_probs(a, t) - spread[t] for a, t in slices(sequence, at)]
                own = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
                held = entries[at]
                own += logs[held >> 13]
                rare = np.flatnonzero((held >= KNOWN) & (held < SIZE))
                ends = np.cumsum(n)
                begins = ends - n
                total = np.zeros(len(n))
                total[n > 0] = np.add.reduceat(own, begins[n > 0]) if len(own) else 0
                # the rare words of each text, in order
                bounds = np.searchsorted(rare, np.append(begins, ends[-1:]))
                hashes: list[int] = []
                for k, body in enumerate(bodies):
                    if bounds[k] < bounds[k + 1]:
                        listed = words_of(body)
                        hashes += map(xxhash.xxh64_intdigest, map(listed.__getitem__, (rare[bounds[k] : bounds[k + 1]] - begins[k]).tolist()), repeat(42))
                lists = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(places(sequence, at[rare]))], ["w", "place"]),
                )
                rows = pa.array(np.arange(row, row + len(n)))
                row += len(n)
                yield pa.RecordBatch.from_arrays([rows, part.column(0), pa.array(n), pa.array(total), lists], ["row", "doc_id", "n_tokens", "net", "rare"])

    kind = source.schema["doc_id"].dataType.simpleString()
    # stored, as the numbers of rows hold for one run only
    scored = stored(source.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, net double, rare array<struct<w: long, place: long>>"))
    counted = vocabulary.counted.select(F.xxhash64("word").alias("word"), "n")  # XXH64 with seed 42
    rare = scored.select(F.col("row").alias("of"), F.inline("rare")).join(counted, F.col("w") == F.col("word"), "left").withColumn("n", F.coalesce("n", F.lit(UNSEEN)))
    share = F.log("n")
    if trained:
        size = F.get(F.lit(vocabulary.buckets.tolist()), F.col("place").bitwiseAND(F.lit(SIZE - KNOWN - 1)).cast("int"))
        # at an edge a place of its own; one exchange and one sort serve both counts
        alone = F.when(F.col("place") < 0, -1 - F.monotonically_increasing_id()).otherwise(F.col("place"))
        rare = (
            rare.select("of", "n", "w", alone.alias("place"), size.alias("size"))
            .repartition("place")
            .withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("place", "w")) - 1)
            .withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("place")) - 1)
        )
        share = F.log((F.col("n") + F.col("same") * F.coalesce("size", F.lit(0.0))) / (1 + F.col("others")))
    shares = rare.select("of", share.alias("share"))
    summed = shares.groupBy("of").agg(F.sum("share").alias("share"))
    total = F.col("net") + F.coalesce("share", F.lit(0.0))
    return (
        scored.select("row", "doc_id", "n_tokens", "net")
        .join(summed, F.col("row") == F.col("of"), "left")
        .select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))
    )


def pseudo_likelihood(df: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all of ``df`` and score all of it."""
    vocabulary, model = fit(id_and_bytes(df, id_col, text_col), rounds)
    return score(df, vocabulary, model, id_col, text_col, trained=True)


def op6_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
