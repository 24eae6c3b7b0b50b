"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items are put into one suffix automaton.  The words of each
document run through it once; the state and the length of the longest suffix of
the text read so far that occurs in some item are known after every word.  Where
that length reaches the window (eight words, or the whole of a shorter item) the
words of the window are hit, and the state tells which items have it.

The items are the only data sent to every task, and their size is checked: an
automaton has at most ``max_shard_words`` words (0.6 KB of memory each; 0.13 GB at
the default).  A benchmark of that size is scanned for in one pass without a
shuffle.  A larger one takes a pass for each automaton, which driver and tasks
hold one at a time, and the spans and items that the passes found in a document
meet by a shuffle; so a benchmark of any size works, only slower.

Defined results
    * null or wordless text has no words, no hits, and isn't contaminated;
    * items without words match nothing, equal items are each reported;
    * repeated rows get the same result, one row per input row; ids may be null;
    * an empty table of documents or items gives an empty result or no hits;
    * other columns are not read (or, in ``remove_leaks``, kept as they are).
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linestrata.llm.common import id_and_bytes, per_batch, stored, table

WINDOW = 8
#: Words of one automaton.
SHARD_WORDS = 200_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and turns every other byte outside words into a space, byte for byte.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(FOLD).split()


class SuffixAutomaton:
    """Of several word sequences; states know the items of the windows they stand for."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        #: state -> items with the window-long string of that state
        self.items: dict[int, set[str]] = {}
        #: state -> [(length, item)] of short items that are suffixes of its strings
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        known = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items if words]
        for _, sequence in known:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        ends: dict[int, list[tuple[int, str]]] = {}
        for name, sequence in known:
            self.least = min(self.least, len(sequence))
            state = matched = 0
            for symbol in sequence:
                state, matched = self.next[state][symbol], matched + 1
                if matched >= window:
                    self.items.setdefault(self._holding(state, window), set()).add(name)
            if len(sequence) < window:
                ends.setdefault(state, []).append((len(sequence), name))
        if ends:
            for state in sorted(range(len(self.link)), key=self.length.__getitem__):
                found = ends.get(state, []) + (self.short.get(self.link[state], []) if state else [])
                if found:
                    self.short[state] = found
        #: the state of the window-long suffix, for states with longer strings
        self.at_window = [self._holding(s, window) if self.length[s] >= window else -1 for s in range(len(self.link))]

    def _holding(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, state: int, symbol: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(symbol) == old:
            self.next[state][symbol] = new
            state = self.link[state]

    def _split(self, parent: int, symbol: int) -> int:
        """The state of parent's longest string plus ``symbol``, made its own if shared."""
        child = self.next[parent][symbol]
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._copy(child, self.length[parent] + 1)
        self.link[child] = clone
        self._redirect(parent, symbol, child, clone)
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new = len(self.next) - 1
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, symbol)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [from, to) in words, sorted by their end, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        step, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        state = matched = 0
        for at, symbol in enumerate(map(self.ids.get, words)):
            if symbol is None:
                state = matched = 0
                continue
            to = step[state].get(symbol)
            if to is None:
                while state and to is None:
                    state = link[state]
                    matched = length[state]
                    to = step[state].get(symbol)
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= least:
                if matched >= window:
                    spans.append((at + 1 - window, at + 1))
                    items |= self.items[self.at_window[state]]
                for n, name in self.short.get(state, ()):
                    if matched >= n:
                        spans.append((at + 1 - n, at + 1))
                        items.add(name)
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(items: DataFrame, max_shard_words: int, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in groups of about ``max_shard_words`` words; the driver holds one at a time."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    held, n = [], 0
    for row in rows.toLocalIterator():
        words = words_of(bytes(row["t"]))
        if words:
            held.append((row["i"] if row["i"] is not None else "", words))
            n += len(words)
        if n >= max_shard_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def _scanner(sent):
    """bodies -> per body (words, merged hit spans, items) for one automaton; it is unpickled once a task."""
    loaded: list[SuffixAutomaton] = []

    def scan(bodies: list[bytes | None]) -> list[tuple[list[bytes], list[tuple[int, int]], set[str]]]:
        if not loaded:
            loaded.append(pickle.loads(sent.value))
        out = []
        for body in bodies:
            words = words_of(body)
            spans, items = loaded[0].scan(words)
            out.append((words, merged(spans), items))
        return out

    return scan


def _found(spans: list | None, items: list | None, body: bytes | None) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    """The same from what several passes have found."""
    return words_of(body), merged((s["a"], s["b"]) for s in spans or ()), set(items or ())


def _scanned(source: DataFrame, key: str, text: str, items: DataFrame, window: int, max_shard_words: int, item_id_col: str, item_text_col: str):
    """``source``, and a function from a batch of it to (words, spans, items) for each row.

    For a benchmark of several automata ``source`` has got columns with what was found.
    """
    sc = source.sparkSession.sparkContext
    groups = shards(items, max_shard_words, item_id_col, item_text_col)
    first = next(groups, [])
    second = next(groups, None)
    sent = sc.broadcast(pickle.dumps(SuffixAutomaton(first, window)))
    if second is None:
        scan = _scanner(sent)
        return source, lambda batch: scan(batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist())
    keyed = source.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("body")).withColumn("salt", F.xxhash64("body"))
    kind = keyed.schema["k"].dataType.simpleString()
    passes = []
    for group in chain([None, second], groups):
        if group is not None:
            sent = sc.broadcast(pickle.dumps(SuffixAutomaton(group, window)))
        scan = _scanner(sent)

        def one(batch: pa.RecordBatch, scan=scan) -> pa.RecordBatch:
            rows = scan(batch.column(1).to_pylist())
            spans = [[{"a": a, "b": b} for a, b in s] for _, s, _ in rows]
            columns = [batch.column(0), batch.column(2), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["k", "salt", "spans", "items"]).filter(pa.array([bool(s) for s in spans], pa.bool_()))

        # equal rows find the same
        passes.append(stored(keyed.mapInArrow(per_batch(one), f"k {kind}, salt long, spans array<struct<a: int, b: int>>, items array<string>").dropDuplicates(["k", "salt"])))
        sent.unpersist()
    together = reduce(DataFrame.unionByName, passes).groupBy(F.col("k").alias("f_key"), F.col("salt").alias("f_salt")).agg(
        F.flatten(F.collect_list("spans")).alias("f_spans"), F.flatten(F.collect_list("items")).alias("f_items")
    )
    joined = source.join(together, F.col(key).eqNullSafe(F.col("f_key")) & (F.xxhash64(F.col(text).cast("binary")) == F.col("f_salt")), "left").drop("f_key", "f_salt")

    def read(batch: pa.RecordBatch):
        spans, found, bodies = (batch.column(batch.schema.get_field_index(c)) for c in ("f_spans", "f_items", text))
        return map(_found, spans.to_pylist(), found.to_pylist(), bodies.cast(pa.binary()).to_pylist())

    return joined, read


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    min_items: int = 2,
    max_shard_words: int = SHARD_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    source, read = _scanned(id_and_bytes(docs, id_col, text_col), "doc_id", "body", items, window, max_shard_words, item_id_col, item_text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(read(batch))
        digests = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in rows]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(w) for w, _, _ in rows], pa.int64()),
                pa.array([sum(b - a for a, b in s) for _, s, _ in rows], pa.int64()),
                pa.array([len(i) for _, _, i in rows], pa.int64()),
                pa.array(digests, pa.string()),
                pa.array([len(i) >= min_items for _, _, i in rows], pa.bool_()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(per_batch(one), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_leaks(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    max_shard_words: int = SHARD_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without hit spans, and without documents hit in more than ``max_coverage`` of their words."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    k = names.index(text_col)
    carried = docs.toDF(*plain).withColumn(plain[k], F.col(plain[k]).cast("string"))
    source, read = _scanned(carried, plain[names.index(id_col)], plain[k], items, window, max_shard_words, item_id_col, item_text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        bodies = batch.column(k).cast(pa.binary()).to_pylist()
        keep, texts = [], []
        for body, (words, spans, _) in zip(bodies, read(batch)):
            hit = sum(b - a for a, b in spans)
            keep.append(not hit or hit <= max_coverage * len(words))
            if hit and keep[-1]:
                at = [m.span() for m in WORD.finditer(body.translate(FOLD))]
                left = 0
                kept = []
                for a, b in spans:
                    kept.append(body[left : at[a][0]])
                    left = at[b - 1][1]
                body = b"".join([*kept, body[left:]])
            texts.append(body)
        columns = batch.columns[: len(names)]
        columns[k] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, plain).filter(pa.array(keep, pa.bool_()))

    return source.mapInArrow(per_batch(one), carried.schema).toDF(*names)


def op10_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
b8 AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b8)
),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
hits AS (SELECT doc_id, grams.n, i, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
n_hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
n_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n_hit ON d.doc_id = n_hit.doc_id LEFT JOIN n_items ON d.doc_id = n_items.doc_id
"""
