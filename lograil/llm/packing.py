"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the documents of its partition as it reads them; nothing is shuffled and no ids are
stored twice. A sequence is filled by the dot-product heuristic: of the open examples that fit, the
one whose demand has the largest product with the room left. When none fits, the longest is cut to
fill the room. What remains when the input ends, or when a limit other than tokens is met, goes into
sequences whose lengths are powers of two, which need no padding; so nothing is padded.

Defined cases: a null text is empty and yields the closing id alone; ids, repeated rows and null ids
are kept as they are; an empty table has no pieces.
"""
import re
import struct
import unicodedata
import zlib
from dataclasses import dataclass
from functools import partial
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from lograil.llm.common import remembered, whole


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096      # a power of two
    segments: int = 64
    loss: int = 4096
    open: int = 256         # examples that a task chooses from; only memory and fit depend on it

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.open) < 1 or self.tokens & (self.tokens - 1):
            raise ValueError("limits are at least 1, and tokens is a power of two")


# The contractions that the vocabulary file splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LAST_LATIN = "\u024f"


def _latin_split() -> re.Pattern:
    """The pattern by which the vocabulary file splits text, for texts up to the last Latin letter."""
    latin = [chr(c) for c in range(ord(LAST_LATIN) + 1)]
    letters, digits = ("".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == kind) for kind in "LN")
    return re.compile("|".join([*CONTRACTIONS, f"[{letters}]+", f"[{digits}]", rf"[^\s{letters}{digits}]+"]))


class WordEncoder:
    """Ids of a word-end BPE file as little-endian 32-bit bytes, equal to the library's own encoding.

    The file lower-cases, composes characters and never joins across white space. A text of Latin letters, which
    are composed already, is split by the file's pattern, and its words' ids are remembered, so that only words not met lately go through the merge
    model; other texts go stretch by stretch between white space, each encoded by the whole library.
    """

    SPLIT = _latin_split()
    ODD = re.compile(r"<\||[\x1c-\x1f]")  # special tokens, and what str.split takes for white space alone
    OTHER = re.compile(f"[^\0-{LAST_LATIN}]")

    def __init__(self, path: str, closing: int):
        self.library, self.closing = Tokenizer.from_file(path), np.array([closing], "<u4").tobytes()
        self.model, self.bytes_as_letters = self.library.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words, self.stretches = _Remembered(self._word, 400_000), _Remembered(self._whole, 50_000)

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isprintable()):
            word = "".join(piece for piece, _ in self.bytes_as_letters.pre_tokenize_str(word))
        ids = [piece.id for piece in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self._whole(text) + self.closing
        if self.OTHER.search(text):
            return b"".join(map(self._stretch, text.split())) + self.closing
        return b"".join(map(self.words.__getitem__, self.SPLIT.findall(text.lower()))) + self.closing

    def _stretch(self, stretch: str) -> bytes:
        if self.OTHER.search(stretch):
            return self.stretches[stretch]
        return b"".join(map(self.words.__getitem__, self.SPLIT.findall(stretch.lower())))


class _Remembered(dict):
    """Values of a function for what was asked lately: at most twice `limit` of them; those still asked for stay."""

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.limit, self.before = function, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        self[key] = value = self.function(key) if value is None else value
        return value


@dataclass(eq=False)
class Example:
    doc_id: int | None
    ids: bytes                      # 4 bytes an id
    loss: np.ndarray | None = None  # running count of loss-bearing ids, from 0; None: all do but the silent ones
    silent: int = 0                 # ids at the end that bear no loss
    start: int = 0                  # ids before it are packed
    slot: int | None = None         # where the packer holds it

    @property
    def total(self) -> int:
        return len(self.ids) // 4

    def lost(self, start: int, stop: int) -> int:
        if self.loss is None:
            bearing = self.total - self.silent
            return min(stop, bearing) - min(start, bearing)
        return int(self.loss[stop] - self.loss[start])

    def reach(self, room: int, loss: int) -> int:
        """How many ids from `start` on fit both rooms."""
        most = min(room, self.total - self.start)
        if self.loss is None:
            return most if self.lost(self.start, self.start + most) <= loss else loss
        return int(np.searchsorted(self.loss[self.start:self.start + most + 1], self.loss[self.start] + loss, "right")) - 1


class Packer:
    """Packs a stream of examples; yields sequences as lists of (example, start, stop)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.held: list[Example | None] = [None] * limits.open
        self.length, self.loss = np.zeros(limits.open, np.int64), np.zeros(limits.open, np.int64)
        self.free = list(range(limits.open))

    def pack(self, examples):
        most = self.limits
        for example in examples:
            while example.reach(most.tokens, most.loss) == most.tokens:
                example.start += most.tokens
                yield [(example, example.start - most.tokens, example.start)]
            self._set(example)
            while not self.free:
                yield self._sequence()
        while len(self.free) < most.open:
            yield self._sequence()

    def _set(self, example: Example):
        """Holds what is left of an example, or lets go of it when nothing is."""
        left = example.total - example.start
        if left and example.slot is None:
            example.slot = self.free.pop()
            self.held[example.slot] = example
        if example.slot is not None:
            self.length[example.slot], self.loss[example.slot] = left, example.lost(example.start, example.total)
            if not left:
                self.held[example.slot] = None
                self.free.append(example.slot)
                example.slot = None

    def _sequence(self):
        most = self.limits
        tokens, segments, loss, pieces = most.tokens, most.segments, most.loss, []
        while tokens and segments:
            fits = (self.length > 0) & (self.length <= tokens) & (self.loss <= loss)
            if fits.any():
                # A segment's demand is the same for all, so that term only shifts the products.
                product = self.length * (tokens / most.tokens ** 2) + segments / most.segments ** 2 + self.loss * (loss / most.loss ** 2)
                slot = int(np.argmax(np.where(fits, product, -1.0)))
            else:
                slot = int(np.argmax(self.length))
            example = self.held[slot]
            n = example.reach(tokens, loss) if example else 0
            if not n:
                break
            example.start += n
            pieces.append((example, example.start - n, example.start))
            self._set(example)
            tokens, segments, loss = tokens - n, segments - 1, loss - example.lost(example.start - n, example.start)
        return self._even(pieces, most.tokens - tokens)

    def _even(self, pieces, total: int):
        """Cuts the sequence down to a power of two; what is cut off is open again.

        An example is cut at most once in a sequence, and then last, so a piece always ends where
        its example's open rest begins.
        """
        surplus = total - (1 << total.bit_length() - 1)
        while surplus:
            example, start, stop = pieces.pop()
            n = min(surplus, stop - start)
            example.start -= n
            self._set(example)
            if n < stop - start:
                pieces.append((example, start, stop - n))
            surplus -= n
        return pieces


FIELDS = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()))
SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, ids binary")


def _rows(sequences, first: int, with_ids: bool):
    for number, pieces in zip(count(first), sequences):
        offset = 0
        for example, start, stop in pieces:
            ids = example.ids[4 * start:4 * stop]
            yield example.doc_id, start, stop - start, zlib.crc32(ids), example.total, number, offset, ids if with_ids else None
            offset += stop - start


def _packed(examples, limits: Limits, with_ids: bool, batches):
    """One task's pieces; sequence numbers begin with the partition's number."""
    rows = _rows(Packer(limits).pack(examples(batches)), TaskContext.get().partitionId() << 32, with_ids)
    while block := list(islice(rows, 4096)):
        yield pa.record_batch([pa.array(values, kind) for values, (_, kind) in zip(zip(*block), FIELDS)], [name for name, _ in FIELDS])


def encoder(path: str, closing: int) -> WordEncoder:
    """One for each Python worker, so that what it remembers serves all the worker's packing tasks."""
    return remembered(WordEncoder, path, closing)


def _encoded(path: str, closing: int, batches):
    encode = encoder(path, closing)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            yield Example(doc_id, encode(text), silent=1)


def _given(batches):
    for batch in batches:
        for doc_id, ids, loss in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "ids", "loss"))):
            marks = None if loss is None else np.concatenate([[0], np.cumsum(np.array(loss, bool))])
            yield Example(doc_id, np.array(ids or [], "<u4").tobytes(), marks)


def pack_documents(docs: DataFrame, path: str, closing: int = 2, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text), encoded by the vocabulary file at `path` with `closing` behind each.

    All ids bear loss but the closing one, which no text asks for.
    A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian
    32-bit, null unless asked for).
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    return rows.mapInArrow(partial(_packed, partial(_encoded, path, closing), limits, with_ids), SCHEMA)


def pack_examples(examples: DataFrame, limits: Limits = Limits(), with_ids: bool = True) -> DataFrame:
    """The same for instruction data: doc_id, ids (array of int), loss (array of boolean, an entry for each id, or null).

    Null or empty ids have no piece.
    """
    rows = examples.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<bigint>").alias("ids"),
                           F.col("loss").cast("array<boolean>").alias("loss"))
    return rows.mapInArrow(partial(_packed, _given, limits, with_ids), SCHEMA)
