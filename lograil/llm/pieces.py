"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The vocabulary comes from a model file. A text is cut into stretches, each a run of spaces (written
as the mark U+2581) and the characters up to the next space; no piece of the vocabulary has a mark
behind another character, so the best segmentation of a text is that of its stretches. Distinct
stretches of equal length advance together: for every end position all substrings that end there
are looked up by their rolling hash among the sorted hashes of the pieces, the best total is a
maximum over their lengths, and the winning length is the backpointer.

The scores of a merge-built vocabulary are ranks, whose sums favour short pieces. By default a piece
of rank r weighs -log(r + 10), the shape of its frequency, so that the best total is a likely
segmentation; `scores="file"` takes the file's numbers. Segmentations are optimal for these scores;
they are not those of the merge procedure, and need not be: decoding gives back the text.

Characters without a piece become the pieces of their UTF-8 bytes, and so does a mark that stands in
the text itself. Defined cases: null and empty texts have no pieces; every row gets a row.
"""
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import whole

MARK = "▁"
STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)    # odd; hashes wrap at 64 bits
HIDDEN = "\ud800"                        # stands for a mark of the text itself; no valid text has it
NEVER = -1e18


class Vocabulary:
    """Pieces of a model file with hashes, weights and the pieces of single bytes."""

    def __init__(self, path: str, scores: str = "rank"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i, p in enumerate(self.pieces)
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and MARK not in p.lstrip(MARK)]
        self.longest = max(len(self.pieces[i]) for i in plain)
        weights = np.array([model.get_score(i) for i in plain]) if scores == "file" else -np.log(np.arange(len(plain)) + 10.0)
        hashes = np.array([hash_of(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.weights = hashes[order], np.array(plain)[order], weights[order]
        self.fallback = float(weights.min()) - 10.0     # of a byte
        self.plain = {self.pieces[i]: i for i in plain}
        self.known: dict[str, bytes] = {}
        self.values = [b"" if model.is_control(i) or model.is_unknown(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.bytes):
            self.values[i] = bytes([b])

    def ids_of(self, stretches: set[str]) -> None:
        """Works out the ids of stretches not seen before and remembers them."""
        by_length: dict[int, list[str]] = {}
        for s in stretches - self.known.keys():
            by_length.setdefault(len(s), []).append(s)
        for length, words in by_length.items():
            step = max(1, (1 << 20) // (length * self.longest))
            for at in range(0, len(words), step):
                part = words[at:at + step]
                for word, ids in zip(part, self._viterbi(part, length)):
                    self.known[word] = np.array(ids, "<u4").tobytes()

    def _viterbi(self, words: list[str], length: int) -> list[list[int]]:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), length).astype(np.uint64)
        rolling = np.zeros((len(words), length + 1), np.uint64)
        for i in range(length):
            rolling[:, i + 1] = rolling[:, i] * BASE + codes[:, i] + np.uint64(1)
        longest = min(self.longest, length)
        weight = np.full((longest + 1, len(words), length + 1), NEVER)
        piece = np.full((longest + 1, len(words), length + 1), -1, np.int64)
        power = np.array([BASE])    # as an array, so that it wraps in silence
        for size in range(1, longest + 1):
            keys = rolling[:, size:] - rolling[:, :-size] * power
            at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
            hit = self.hashes[at] == keys
            weight[size, :, size:] = np.where(hit, self.weights[at], NEVER)
            piece[size, :, size:] = np.where(hit, self.ids[at], -1)
            power = power * BASE
        alone = weight[1, :, 1:] == NEVER
        weight[1, :, 1:][alone] = self.fallback * _widths(codes)[alone]
        best = np.full((len(words), length + 1), NEVER)
        best[:, 0] = 0
        back = np.zeros((len(words), length + 1), np.int64)
        for end in range(1, length + 1):
            sizes = min(longest, end)
            totals = np.stack([best[:, end - size] + weight[size, :, end] for size in range(1, sizes + 1)])
            back[:, end] = np.argmax(totals, axis=0) + 1
            best[:, end] = np.max(totals, axis=0)
        return [self._trace(word, back[n], piece[:, n]) for n, word in enumerate(words)]

    def _trace(self, word: str, back: np.ndarray, piece: np.ndarray) -> list[int]:
        out, end = [], len(word)
        while end:
            size = int(back[end])
            part, found = word[end - size:end], int(piece[size, end])
            if found >= 0 and self.pieces[found] == part:
                out.append(found)
            elif found >= 0:            # two substrings with one 64-bit hash
                return self._plainly(word)
            else:
                out.extend(self.bytes[b] for b in reversed(_bytes_of(part)))
            end -= size
        return out[::-1]

    def _plainly(self, word: str) -> list[int]:
        """The same segmentation by looking pieces up in a dictionary."""
        weights = dict(zip(self.ids.tolist(), self.weights.tolist()))
        best = [(0.0, 0, [])] + [(NEVER, 0, [])] * len(word)
        for end in range(1, len(word) + 1):
            for size in range(1, min(self.longest, end) + 1):
                part = word[end - size:end]
                found = self.plain.get(part)
                if found is None and size > 1:
                    continue
                ids = [found] if found is not None else [self.bytes[b] for b in _bytes_of(part)]
                total = best[end - size][0] + (weights[found] if found is not None else self.fallback * len(ids))
                if total > best[end][0]:
                    best[end] = (total, end - size, ids)
        out, end = [], len(word)
        while end:
            out = best[end][2] + out
            end = best[end][1]
        return out

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str], together: int = 1 << 22):
        """Ids of each text, four bytes each; a mark is put before a text, as decoding takes one away.

        Texts of some million characters are worked on at a time, so that many words advance together.
        """
        held, size = [], 0
        for text in texts:
            held.append(STRETCH.findall(MARK + text.replace(MARK, HIDDEN).replace(" ", MARK)) if text else [])
            size += len(text)
            if size >= together:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, held: list[list[str]]):
        if len(self.known) > 500_000:
            self.known = {}
        self.ids_of(set().union(*held))
        for stretches in held:
            yield b"".join(map(self.known.__getitem__, stretches))

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes put together, marks as spaces, the first one left out."""
        out = b"".join(map(self.values.__getitem__, ids))
        return out[out[:1] == b" ":].decode("utf-8", "replace")


def hash_of(text: str) -> int:
    value = 0
    for c in text:
        value = (value * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return value


def _widths(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each character."""
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def _bytes_of(char: str) -> bytes:
    return (MARK if char == HIDDEN else char).encode()


@lru_cache(maxsize=2)
def vocabulary(path: str, scores: str = "rank") -> Vocabulary:
    """One for each Python worker, so that what it remembers serves all the worker's tasks."""
    return Vocabulary(path, scores)


def encoded(text: Column, path: str, scores: str = "rank") -> Column:
    """Piece ids of a text column, array<int>."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, "<i4") for x in vocabulary(path, scores).encode_all(texts.to_pylist())], pa.list_(pa.int32()))
    return F.arrow_udf(run, "array<int>")(whole(text))


def decoded(ids: Column, path: str, scores: str = "rank") -> Column:
    """The text of a column of piece ids; null ids are empty."""
    def run(lists: pa.Array) -> pa.Array:
        return pa.array([vocabulary(path, scores).decode(x or []) for x in lists.to_pylist()], pa.string())
    return F.arrow_udf(run, "string")(ids)


def round_trips(docs: DataFrame, path: str, scores: str = "rank") -> DataFrame:
    """doc_id, n_pieces, n_bytes (pieces that are single bytes), ids_crc32, exact for every row of `docs`.

    Ids are little-endian unsigned 32-bit numbers for the checksum; exact tells whether decoding them
    gives the text back.
    """
    def run(texts: pa.Array) -> pa.Array:
        words, out = vocabulary(path, scores), []
        single = np.zeros(len(words.pieces), bool)
        single[words.bytes] = True
        batch = texts.to_pylist()
        for text, data in zip(batch, words.encode_all(batch)):
            ids = np.frombuffer(data, "<u4")
            out.append((len(ids), int(single[ids].sum()), zlib.crc32(data), words.decode(ids.tolist()) == text))
        names = ("n_pieces", "n_bytes", "ids_crc32", "exact")
        columns = zip(*out) if out else [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names)
    found = F.arrow_udf(run, "struct<n_pieces:bigint,n_bytes:bigint,ids_crc32:bigint,exact:boolean>")(whole("text"))
    return docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")
