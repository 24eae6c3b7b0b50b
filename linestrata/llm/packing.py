"""Vector best-fit packing of tokenised documents into fixed-length sequences.

A bin (sequence) has three capacities: tokens, documents and attention cost (the
sum of squared piece lengths, what block-diagonal attention over the bin costs).
Pieces are placed in order of falling length, each into the open bin that fits
under every constraint and leaves the smallest weighted residual norm (or has
the largest weighted dot product of demand and residual).

Pieces are packed in groups of about ``group_docs`` documents dealt out by a
hash of key and row number, so a group has a bounded size whatever keys repeat,
and groups are packed independently.  A group has thousands of pieces, so what
its last bins waste is a small fraction.  Only (key, place, length, checksum) of
a piece is shuffled, never its tokens.

Defined results
    * null text is packed like empty text: one piece, the end mark alone;
    * longer documents are cut from the end into full pieces, so that the first
      one may be shorter; whole texts are encoded;
    * repeated rows are packed once each; ids may be null;
    * an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linestrata.llm.common import id_and_bytes, per_batch, table

END = 2
#: Entries of a worker's cache of encoded words (about 200 bytes each) beyond which it is emptied.
CACHE = 300_000
#: Unknown words that are encoded at once; the library takes longer for each the more there are.
TOGETHER = 100
SPECIAL = "<|endoftext|>"
#: What may stand behind letters without being part of a special string.
TRAILING = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: Byte-level BPE writes bytes as characters, those that can't be shown as the ones from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
SPACE = chr(BYTE_CHARS[32])


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    #: weights of the three (each taken relative to its capacity)
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"


class ByteLevelEncoder:
    """Ids of a byte-level BPE tokenizer as unsigned 32-bit little-endian bytes.

    The splitting pattern never lets a token reach over a single space or line
    break between two non-blanks, save that a space belongs to the word behind it.
    So texts are cut into words, each with the space or line break before it;
    the different words of a batch are found by Arrow, and the ids of words are
    kept.  Of those not known yet, letters and letters with punctuation behind them
    go to the tokenizer's model (the pattern splits them there and nowhere else),
    others are encoded in groups, one on a line.  Texts with anything else in them
    (runs of blanks, other white space, special strings) are encoded as a whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.model = self.library.model
        self.newline = self.library.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _piece(self, text: str) -> bytes:
        """The ids of a stretch that the pattern doesn't split."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(BYTE_CHARS)
        elif text[0] == " ":
            text = SPACE + text[1:]
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _tail(self, text: str) -> bytes:
        if text not in self.tails:
            if len(self.tails) > CACHE:
                self.tails.clear()
            self.tails[text] = self._piece(text)
        return self.tails[text]

    def _learn(self, words: list[str]) -> None:
        """``words`` begin with a line break, or stand for themselves behind a space."""
        new, lines, starts = [], [], []
        newline = array("I", self.newline).tobytes()
        for w in words:
            after_break = w[:1] == "\n"
            body = w[1:] if after_break else w
            letters = body.rstrip(TRAILING)
            if letters.isalpha():
                found = newline + self._piece(letters) if after_break else self._piece(" " + letters)
                self.known[w] = found + self._tail(body[len(letters) :]) if len(letters) < len(body) else found
            elif body and body.split() == [body] and SPECIAL not in body:
                new.append(w)
                lines.append(body if after_break else " " + body)
                starts.append(self.newline if after_break else [])
        for k in range(0, len(new), TOGETHER):
            ids = self.library.encode("\n".join(lines[k : k + TOGETHER]), add_special_tokens=False).ids + self.newline
            at = 0
            for word, start in zip(new[k : k + TOGETHER], starts[k : k + TOGETHER]):
                end = ids.index(self.newline[0], at)
                self.known[word] = array("I", start + ids[at:end]).tobytes()
                at = end + 1

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(["\n" + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        words = cut.flatten().dictionary_encode()
        different = words.dictionary.to_pylist()
        if len(self.known) > CACHE:
            self.known.clear()
        self._learn([w for w in different if w not in self.known])
        ids = list(map(self.known.get, different))
        odd = np.array([x is None for x in ids])
        length = np.array([len(x) if x else 0 for x in ids], np.int64)
        which = words.indices.to_numpy()
        offsets = np.concatenate([[0], np.cumsum(length)])
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join([x or b"" for x in ids]))])
        data = memoryview(every.take(words.indices).buffers()[2] or b"")
        ends = np.concatenate([[0], np.cumsum(length[which])])[bounds].tolist()
        odds = np.concatenate([[0], np.cumsum(odd[which])])[bounds]
        out = []
        for text, a, b, whole in zip(texts, ends, ends[1:], np.diff(odds).tolist()):
            if whole:
                out.append(array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(bytes(data[a + 4 : b]))  # without the line break put in front
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def forget(self) -> None:
        """Give back the memory of kept words."""
        self.known.clear()
        self.tails.clear()


_loaded: dict[str, ByteLevelEncoder] = {}


def encoder(file: str) -> ByteLevelEncoder:
    if file not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        _loaded[file] = ByteLevelEncoder(file)
    return _loaded[file]


def pack(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of each piece and its offset there."""
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    caps = np.array([capacity.tokens, capacity.documents, capacity.attention], np.float64)
    scale = np.array(capacity.weights) / caps
    left = np.empty((3, n), np.float64)  # residuals of open bins, one column each
    name = np.empty(n, np.int64)
    used = np.zeros(n, np.int64)
    n_open = made = 0
    smallest = float(lengths[order[-1]]) if n else 0.0
    for i in order:
        size = int(lengths[i])
        demand = np.array([size, 1.0, float(size) * size])
        if (demand > caps).any():
            raise ValueError(f"a piece of {size} tokens exceeds the capacities of an empty bin")
        at = -1
        if n_open:
            rest = left[:, :n_open] - demand[:, None]
            fits = np.flatnonzero((rest[0] >= 0) & (rest[1] >= 0) & (rest[2] >= 0))
            if len(fits):
                if capacity.rule == "dot":
                    score = -((left[:, fits] * (demand * scale * scale)[:, None]).sum(0))
                else:
                    score = ((rest[:, fits] * scale[:, None]) ** 2).sum(0)
                at = int(fits[np.argmin(score)])
        if at < 0:
            at, n_open = n_open, n_open + 1
            left[:, at] = caps
            name[at] = made
            made += 1
        left[:, at] -= demand
        b = name[at]
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        if left[0, at] < smallest or left[1, at] < 1:  # nothing can be added: closed
            n_open -= 1
            left[:, at], name[at] = left[:, n_open], name[n_open]
    return bins, offsets


def pieces(df: DataFrame, ranks_file: str, limit: int, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; no shuffle."""
    tail = array("I", [end]).tobytes()

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [(body or b"").decode("utf-8", "replace") for body in batch.column(1).to_pylist()]
        rows, piece, start, length, crc = [], [], [], [], []
        for k, ids in enumerate(encoder(ranks_file).encode_all(texts)):
            ids += tail
            n = len(ids) // 4
            at, number = 0, 0
            size = n if n <= limit else n % limit or limit
            while at < n:
                rows.append(k)
                piece.append(number)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                at, number, size = at + size, number + 1, limit
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from per_batch(one)(batches)
        finally:
            encoder(ranks_file).forget()  # a worker outlives its tasks

    source = id_and_bytes(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    df: DataFrame,
    ranks_file: str,
    capacity: Capacity = Capacity(),
    group_docs: int = 8000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    limit = min(capacity.tokens, math.isqrt(capacity.attention))
    groups = max(1, math.ceil(df.count() / group_docs))
    cut = pieces(df, ranks_file, limit, id_col=id_col, text_col=text_col)
    dealt = cut.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(groups)))

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack(group.column("length").to_numpy(), capacity)
        sequence = (group.column("bin_group").to_numpy() << np.int64(32)) + bins
        return group.drop_columns("bin_group").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    kind = cut.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("bin_group").applyInArrow(
        one, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def ranks_file() -> str:
    """The tokenizer of the registered query and the pipeline."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), ranks_file())
