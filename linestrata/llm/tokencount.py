"""Token counts by byte-pair merging on a heap and a linked list.

A chunk of text starts as one symbol per character.  A heap holds the adjacent
pairs whose concatenation is a piece; the pair of the best piece (leftmost on a
tie) is merged until none is left.  The count is the number of initial symbols
minus the merges; characters that the model lacks count their UTF-8 bytes (byte
fallback).  No identifiers are looked up.

Text falls apart where no piece can reach across: before every run of spaces
(no piece has a space mark behind another character) and around line breaks (no
piece has one).  Both facts are read from the model and checked.  Chunks recur,
so a bounded cache keeps their counts.

Defined results
    * null text counts like empty text: no bytes, no tokens;
    * whole texts are counted, however long; a chunk of n characters takes O(n log n);
    * repeated rows get the same result, one row per input row; ids may be null;
    * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linestrata.llm.common import id_and_bytes, per_batch, table

LIMIT = 4096
MARK = "▁"
#: Entries of a worker's cache (about 150 bytes each); it is emptied when full.
CACHE = 1_000_000
LONG = 64


class MergeCounter(dict):
    """chunk -> tokens; a dict whose misses are counted by merging."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            self.rank[piece] = -model.get_score(i)
        self.adjacent = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            raise ValueError("a piece reaches across a space or a line break; this model can't be counted in chunks")

    def merges(self, chunk: str) -> int:
        """Tokens of a chunk in which spaces are marks."""
        rank = self.rank
        n = len(chunk)
        if n == 1:
            return 1 if chunk in rank else len(chunk.encode("utf-8", "replace"))
        count = n
        symbols = list(chunk)
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(chunk[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if after[i] != j or len(symbols[i]) + len(symbols[j]) != size or not symbols[i]:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            count -= 1
            k = after[i] = after[j]
            after[j] = -2
            if k >= 0:
                before[k] = i
                pair = symbols[i] + symbols[k]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(heap, (r, i, k, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(heap, (r, h, i, len(pair)))
        for c in chunk:
            if c not in rank:
                count += len(c.encode("utf-8", "replace")) - 1
        return count

    def __missing__(self, chunk: str) -> int:
        """Keys are chunks behind one space; the mark is put before them here."""
        n = self.parts(MARK + chunk)
        self._keep(chunk, n)
        return n

    def _keep(self, key: str, n: int) -> None:
        if len(key) <= LONG:
            if len(self) >= CACHE:
                self.clear()
            self[key] = n

    def parts(self, chunk: str) -> int:
        """Tokens of a chunk, cut where no merge can reach across."""
        adjacent = self.adjacent
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in adjacent]
        if not cuts:
            return self.merges(chunk)
        total = 0
        for a, b in zip([0, *cuts], [*cuts, len(chunk)]):
            key = "\n" + chunk[a:b]
            n = self.get(key)
            if n is None:
                n = self.merges(chunk[a:b])
                self._keep(key, n)
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text, with the mark that the model puts before it."""
        if not text:
            return 0
        total = 0
        text = text.replace(MARK, " ")
        for k, line in enumerate(text.split("\n")):
            if k:
                total += 1
            chunks = line.split(" ")
            if k:
                head, chunks = chunks[0], chunks[1:]
                if head:
                    total += self.bare(head)
            if "" in chunks:
                # runs of spaces: what belongs to one run and the word behind it is one chunk
                rest = " " + " ".join(chunks) if chunks else ""
                total += sum(self.parts(x.replace(" ", MARK)) for x in re.findall(r" +[^ ]*", rest))
            else:
                total += sum(map(self.__getitem__, chunks))
        return total

    def bare(self, chunk: str) -> int:
        """A chunk at the start of a later line, without a mark."""
        key = "\n" + chunk
        n = self.get(key)
        if n is None:
            n = self.parts(chunk)
            self._keep(key, n)
        return n


_loaded: dict[str, MergeCounter] = {}


def counter(model_file: str) -> MergeCounter:
    if model_file not in _loaded:
        _loaded[model_file] = MergeCounter(model_file)
    return _loaded[model_file]


def token_counts(df: DataFrame, model_file: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; no shuffle."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(model_file).count
        bodies = [b or b"" for b in batch.column(1).to_pylist()]
        tokens = [count(b.decode("utf-8", "replace")) for b in bodies]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(map(len, bodies), pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    source = id_and_bytes(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(per_batch(one), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op8_heap_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
