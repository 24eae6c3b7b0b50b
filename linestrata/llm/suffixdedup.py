"""Removal of repeated byte strings by blockwise suffix sorting.

Every byte covered by a ``length``-byte string that also starts earlier in the
collection is removed.  Sorting all suffixes of a large collection at once is
out of reach, so suffixes are sorted one bucket at a time:

1.  Each ``length``-byte window belongs to the bucket of its minimizer, the
    k-byte string of smallest hash inside it (leftmost on a tie).  Equal windows
    have equal minimizers at equal places, so equal windows share a bucket.
    Consecutive windows with one minimizer form a context; a context is one row
    of five numbers, about one per 40 bytes of text.
2.  Contexts that are equal byte for byte (64-bit digest of the bytes) to an
    earlier one are covered altogether: inside one batch at once (which keeps
    thousands of copies from travelling), then by a window function per bucket.
3.  Buckets that still hold two or more different contexts need the bytes of
    one of each.  Their suffixes are sorted bucket by bucket in blocks of bounded
    size: by the bytes up to the next position of a difference cover sample, then
    by the rank of the sample suffix there, which has been computed beforehand
    and settles ties of any length.  Neighbours that agree in ``length`` bytes
    are equal windows; all but the earliest are covered.
4.  Covered stretches are merged per document and cut out.

The layout puts the minimizers of all contexts into one column, so two suffixes
that are compared have the same residue and one cover position serves both.
Buckets with very many contexts are split by the window's own digest first, so
no bucket has to fit into memory.

Defined results
    * null text is empty text; texts shorter than ``length`` are untouched;
    * equal (doc_id, text) rows are one document: none removes bytes of the
      other, and each gets the same result; equal ids with different texts are
      different documents, in the order of a hash of the text;
    * a null doc_id comes before all others; an empty table gives an empty
      result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linestrata.llm.common import per_batch, stored, table

LENGTH = 100
GRAM = 24
BLOCK = 1 << 18
SEGMENT = 1 << 22
LOW = np.uint64((1 << 24) - 1)
#: Contexts of one bucket beyond which its windows are dealt out by their own digests.
LARGE_BUCKET = 1024
#: Contexts sorted at once.
SORT_ROWS = 6000
#: A difference cover modulo 31: every residue is a difference of two of these.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position, by doubling."""
    parts = {}
    h, size, k = _BYTE[data], 1, 0
    while True:
        if gram & size:
            parts[size] = h
        if size * 2 > gram:
            break
        n = len(h) - size
        h = h[:n] * _STEP[k] + h[size:]
        h ^= h >> np.uint64(29)
        size, k = size * 2, k + 1
    out, at = None, 0
    for size in sorted(parts, reverse=True):
        n = len(data) - gram + 1
        piece = parts[size][at : at + n]
        out = piece if out is None else (out * _STEP[k + 1] + piece) ^ (out >> np.uint64(31))
        at += size
    return out


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[: len(a) - size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def contexts(buffer: bytes, lengths: list[int], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: bucket, digest, text number, first window, minimizer offset, windows - 1."""
    data = np.frombuffer(buffer, np.uint8)
    sizes = np.asarray(lengths, np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    empty = tuple(np.empty(0, np.int64) for _ in range(6))
    if len(data) < length:
        return empty
    hashes = gram_hashes(data, gram)
    best = sliding_min((hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    edge = np.zeros(len(data) + 1, np.int64)
    whole = sizes >= length
    np.add.at(edge, begins[whole], 1)
    np.add.at(edge, ends[whole] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[: len(best)])
    if not len(starts):
        return empty
    at = (best[starts] & LOW).astype(np.int64)
    text = np.searchsorted(ends, starts, side="right")
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    tail = np.append(head[1:], len(starts)) - 1
    first, last, at, text = starts[head], starts[tail], at[head], text[head]
    view, digest = memoryview(buffer), xxhash.xxh3_64_intdigest
    digests = np.fromiter(
        (digest(view[a : b + length], o) for a, b, o in zip(first.tolist(), last.tolist(), (at - first).tolist())), np.uint64, len(first)
    )
    return hashes[at].view(np.int64), digests.view(np.int64), text, first - begins[text], at - first, last - first


def _blocks(bodies: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Blocks of whole texts, long ones in overlapping segments: [(row, offset)], [bytes]."""
    rows, held, n = [], [], 0
    for row, body in enumerate(bodies):
        if len(body) < length:
            continue
        for at in range(0, max(1, len(body) - length + 1), SEGMENT):
            part = body if len(body) <= SEGMENT else body[at : at + SEGMENT + length - 1]
            rows.append((row, at))
            held.append(part)
            n += len(part)
            if n >= BLOCK:
                yield rows, held
                rows, held, n = [], [], 0
    if held:
        yield rows, held


def _find_contexts(length: int, gram: int):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, salt = batch.column(0), np.asarray(batch.column(2))
        bodies = [b or b"" for b in batch.column(1).to_pylist()]
        found = [[] for _ in range(6)]
        for rows, held in _blocks(bodies, length):
            got = contexts(b"".join(held), [len(x) for x in held], length, gram)
            where = np.array(rows, np.int64)
            got = (*got[:2], where[got[2], 0], got[3] + where[got[2], 1], *got[4:])
            for k, column in enumerate(got):
                found[k].append(column)
        bucket, digest, row, first, offset, more = (np.concatenate(x) if x else np.empty(0, np.int64) for x in found)
        order = np.lexsort([salt, *_sortable(ids)])
        rank = np.empty(len(order), np.int64)
        same = _same_as_before(ids, salt, order)
        rank[order] = np.cumsum(~same) if len(order) else 0
        sort = np.lexsort((first, rank[row], digest, bucket))
        bucket, digest, row, first, offset, more = (x[sort] for x in (bucket, digest, row, first, offset, more))
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (digest[1:] != digest[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.empty(0, np.int64)
        sure = ~new & ((rank[row] != rank[row[lead]]) | (first != first[lead]))
        keep = new | sure  # the same place of an equal row says nothing new
        # covered stretches of one row that touch are joined
        a, b, r = first[sure], first[sure] + more[sure] + length, row[sure]
        by = np.lexsort((a, r))
        a, b, r = a[by], b[by], r[by]
        a, b, r = _joined(a, b, r)
        keep &= ~sure
        n, m = int(keep.sum()), len(a)
        take = np.concatenate([row[keep], r])
        spread = (a * 1_000_003 + r * 7_919) * np.int64(2654435761)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([bucket[keep], spread])),
                pa.array(np.concatenate([digest[keep], b])),
                ids.take(pa.array(take)),
                pa.array(salt[take].astype(np.int32)),
                pa.array(np.concatenate([(first[keep] << 16) | (offset[keep] << 8) | more[keep], a])),
                pa.array(np.concatenate([np.zeros(n, bool), np.ones(m, bool)])),
            ],
            ["bucket", "digest", "doc_id", "salt", "place", "sure"],
        )

    return per_batch(one, rows=1 << 16)  # copies inside a batch don't travel


def _sortable(ids: pa.Array) -> list[np.ndarray]:
    """Keys for lexsort (least significant first) that put nulls first."""
    missing = np.asarray(ids.is_null())
    if pa.types.is_integer(ids.type):
        return [np.asarray(ids.fill_null(0)), ~missing]
    values, where = np.unique(np.array(["" if x is None else str(x) for x in ids.to_pylist()]), return_inverse=True)
    return [where, ~missing]


def _same_as_before(ids: pa.Array, salt: np.ndarray, order: np.ndarray) -> np.ndarray:
    keys = _sortable(ids)
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = True
        for k in [salt, *keys]:
            k = np.asarray(k)[order]
            same[1:] &= k[1:] == k[:-1]
    return same


def _joined(a: np.ndarray, b: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches sorted by (row, start), joined where they touch."""
    if not len(a):
        return a, b, r
    top = int(b.max()) + 2
    reach = np.maximum.accumulate(b + r * top) - r * top
    new = np.ones(len(a), bool)
    new[1:] = (r[1:] != r[:-1]) | (a[1:] > reach[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(a)) - 1
    return a[head], reach[tail], r[head]


# ---------------------------------------------------------------- suffix sorting


def cover_steps(width: int, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """For each column the nearest sample column at or behind it (``width`` if there is none)."""
    step = np.full(width + 1, width)
    for c in range(width - 1, -1, -1):
        step[c] = c if c % period in cover else step[c + 1]
    return step


def _key_words(rows: np.ndarray, begin: int, end: int) -> list[np.ndarray]:
    """Columns [begin, end) as big-endian numbers, first word first."""
    return [_word(rows, a, min(8, end - a)) for a in range(begin, end, 8)]


def _word(rows: np.ndarray, at: int, n: int) -> np.ndarray:
    padded = np.zeros((len(rows), 8), np.uint8)
    padded[:, :n] = rows[:, at : at + n]
    return padded.view(">u8").ravel().astype(np.uint64)


def _dense_rank(keys: list[np.ndarray]) -> np.ndarray:
    """Rank of each row by ``keys``, most significant first; equal keys get equal ranks."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        step[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def sample_ranks(rows: np.ndarray, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> dict[int, np.ndarray]:
    """Rank of the suffix of each row from each sample column, from the last column to the first."""
    width = rows.shape[1]
    step = cover_steps(width, period, cover)
    ranks = {width: np.zeros(len(rows), np.int64)}
    for c in range(width - 1, -1, -1):
        if step[c] == c:
            to = int(step[c + 1])
            ranks[c] = _dense_rank([*_key_words(rows, c, to), ranks[to]])
    return ranks


def equal_windows(rows: np.ndarray, bucket: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Windows equal to one of an earlier row of the bucket: (column, rows, the earliest equal rows).

    Row i has windows from columns ``low[i]`` to ``high[i]``.  Suffixes of one
    column are sorted by their bytes up to the sample and the rank there.
    """
    ranks, step = sample_ranks(rows), cover_steps(rows.shape[1])
    number = np.arange(len(rows))
    for c in range(int(low.min()), int(high.max()) + 1):
        has = np.flatnonzero((low <= c) & (c <= high))
        if len(has) < 2:
            continue
        part, to = rows[has], int(step[c])
        order = np.lexsort([number[has], ranks[to][has], *_key_words(part, c, to)[::-1], bucket[has]])
        has = has[order]
        same = (bucket[has[1:]] == bucket[has[:-1]]) & (rows[has[1:], c : c + length] == rows[has[:-1], c : c + length]).all(1)
        if same.any():
            new = np.concatenate([[True], ~same])
            run = np.cumsum(new) - 1
            first = np.minimum.reduceat(has, np.flatnonzero(new))[run]
            later = np.flatnonzero(has != first)
            yield c, has[later], first[later]


def _twins(batch: pa.RecordBatch, last: pa.RecordBatch | None) -> np.ndarray:
    """Rows of a place that the row before (``last`` before the first) is of too."""
    key = ["bucket", "doc_id", "salt", "place"]
    t = pa.Table.from_batches([*([last] if last is not None else []), batch]).select(key).combine_chunks()
    twin = np.zeros(t.num_rows, bool)
    twin[1:] = True
    for column in ([t.column(c).to_numpy()] if c != "doc_id" else _sortable(t.column(c).chunk(0)) for c in key):
        for values in column:
            twin[1:] &= values[1:] == values[:-1]
    return twin if last is None else twin[1:]


def _sort_buckets(length: int, gram: int, block: int):
    lead = length - gram  # column of the minimizer
    width = -(-(lead + length) // 8) * 8

    def solve(t: pa.Table) -> pa.RecordBatch:
        place, bucket, salt = (t.column(c).to_numpy() for c in ("place", "bucket", "salt"))
        ids = pa.concat_arrays(t.column("doc_id").chunks)
        start, offset, more = place >> 16, (place >> 8) & 255, place & 255
        rows = np.zeros((len(place), width), np.uint8)
        low = lead - offset
        for i, (c, body) in enumerate(zip(low.tolist(), t.column("body").to_pylist())):
            rows[i, c : c + len(body)] = np.frombuffer(body, np.uint8)
        a, r = [], []
        for c, later, _ in equal_windows(rows, bucket, low, low + more, length):
            a.append(start[later] + c - low[later])
            r.append(later)
        if a:
            a, r = np.concatenate(a), np.concatenate(r)
            by = np.lexsort((a, r))
            a, b, r = _joined(a[by], a[by] + length, r[by])
        else:
            a = b = r = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(r)), pa.array(salt[r].astype(np.int32)), pa.array(a), pa.array(b)], ["doc_id", "salt", "begin", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket and place; a block ends where a bucket ends.

        Only a bucket of equal windows (a split one) can be longer than a block;
        its first row is carried along.
        """
        held: list[pa.RecordBatch] = []
        n = 0
        last: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.filter(pa.array(~_twins(batch, last)))  # equal rows are one document, each place once
            last, batch = batch.slice(batch.num_rows - 1), own
            held.append(batch)
            n += batch.num_rows
            if n < block:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            bucket = t.column("bucket").to_numpy()
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            at = 0
            while at < len(bucket) - block:
                inside = cuts[(cuts > at) & (cuts <= at + block)]
                later = cuts[cuts > at + block]
                to = int(inside[-1]) if len(inside) else int(later[0]) if len(later) else -1
                if to < 0:
                    break
                yield solve(t.slice(at, to - at))
                at = to
            rest = t.slice(at)
            if rest.num_rows > 4 * block:  # one bucket of equal windows
                yield solve(rest)
                rest = rest.slice(0, 1)
            held = rest.to_batches()
            n = rest.num_rows
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _fetch(length: int):
    """The bytes of the listed contexts; those of large buckets window by window."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, salts, bodies, wanted = batch.columns
        at, bucket, place, body = [], [], [], []
        bounds = wanted.offsets.to_pylist()
        flat = wanted.values  # of the whole batch; the offsets of a slice point into it
        buckets, places, large = (flat.field(k).to_pylist() for k in range(3))
        for i, text in enumerate(bodies.to_pylist()):
            for k in range(bounds[i], bounds[i + 1]):
                p = places[k]
                start, more = p >> 16, p & 255
                if not large[k]:
                    at.append(i)
                    bucket.append(buckets[k])
                    place.append(p)
                    body.append(text[start : start + more + length])
                    continue
                offset = (p >> 8) & 255
                for w in range(more + 1):
                    piece = text[start + w : start + w + length]
                    at.append(i)
                    bucket.append(xxhash.xxh3_64_intdigest(piece, offset - w) - (1 << 63))
                    place.append((start + w) << 16 | (offset - w) << 8)
                    body.append(piece)
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), ids.take(take), salts.take(take), pa.array(place, pa.int64()), pa.array(body, pa.binary())],
            ["bucket", "doc_id", "salt", "place", "body"],
        )

    return per_batch(one)


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, bodies, spans = batch.columns
    out = []
    for body, found in zip(bodies.to_pylist(), spans.to_pylist()):
        body = body or b""
        left, runs, kept = 0, 0, []
        for s in sorted(found or (), key=lambda s: (s["begin"], s["end"])):
            if s["begin"] > left or not runs:
                kept.append(body[left : s["begin"]])
                runs += 1
                left = s["end"]
            else:
                left = max(left, s["end"])
        kept.append(body[left:])
        rest = b"".join(kept)
        out.append((len(body), len(body) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def covered_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large_bucket: int = LARGE_BUCKET, sort_rows: int = SORT_ROWS) -> DataFrame:
    """doc_id, salt, begin, end of stretches covered by earlier text (they may overlap)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(_find_contexts(length, gram), f"bucket long, digest long, doc_id {kind}, salt int, place long, sure boolean")
    in_class = Window.partitionBy("bucket", "digest").orderBy("doc_id", "salt", "place")
    in_bucket = Window.partitionBy("bucket")
    ranked = (
        found.repartition("bucket")
        .withColumn("nth", F.rank().over(in_class))
        .withColumn("row", F.row_number().over(in_class))
        .withColumn("class", F.dense_rank().over(in_bucket.orderBy("digest")))
        .withColumn("classes", F.max("class").over(in_bucket))
        .where("sure or nth > 1 or (row = 1 and classes > 1)")
        .select("bucket", "digest", "doc_id", "salt", "place", "classes", "sure", (F.col("nth") > 1).alias("covered"))
    )
    ranked = stored(ranked)
    certain = ranked.where("sure or covered").select(
        "doc_id",
        "salt",
        F.when(F.col("sure"), F.col("place")).otherwise(F.shiftright("place", 16)).alias("begin"),
        F.when(F.col("sure"), F.col("digest"))
        .otherwise(F.shiftright("place", 16) + F.col("place").bitwiseAND(F.lit(255)) + F.lit(length))
        .alias("end"),
    )
    wanted = (
        ranked.where("not sure and not covered")
        .groupBy("doc_id", "salt")
        .agg(F.collect_list(F.struct("bucket", "place", (F.col("classes") > large_bucket).alias("large"))).alias("wanted"))
        .withColumnsRenamed({"doc_id": "w_id", "salt": "w_salt"})
    )
    bytes_of = (
        docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("salt") == F.col("w_salt")))
        .select("doc_id", "salt", "body", "wanted")
        .mapInArrow(_fetch(length), f"bucket long, doc_id {kind}, salt int, place long, body binary")
    )
    sorted_out = (
        bytes_of.repartition("bucket")
        .sortWithinPartitions("bucket", "doc_id", "salt", "place")
        .mapInArrow(_sort_buckets(length, gram, sort_rows), f"doc_id {kind}, salt int, begin long, end long")
    )
    return certain.unionByName(sorted_out)


def repeated_bytes(
    df: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    large_bucket: int = LARGE_BUCKET,
    sort_rows: int = SORT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    if not 0 < gram <= length or length - gram > 127 or length > 128:
        raise ValueError("length up to 128, gram up to length")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body")).select("doc_id", "body", F.hash("body").alias("salt"))
    spans = (
        covered_spans(docs, length, gram, large_bucket, sort_rows)
        .groupBy("doc_id", "salt")
        .agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
        .withColumnsRenamed({"doc_id": "s_id", "salt": "s_salt"})
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("salt") == F.col("s_salt")), "left")
        .select("doc_id", "body", "spans")
        .mapInArrow(per_batch(_cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
