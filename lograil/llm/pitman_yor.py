"""A hierarchical Pitman-Yor language model over all training documents, and scores of all documents.

A token's context is the token before it, or the beginning of the text: as many restaurants of the
Chinese restaurant process as there are words. The parent of a context is the restaurant of its class
(last byte modulo 16, or the beginning); all classes share the unigram restaurant, whose own parent is
uniform over the vocabulary and one unknown token. Customers of a context are the corpus' counts, those
of a parent the tables of its children; the seating (how many tables serve a word in a restaurant) is
sampled by Gibbs: a sweep takes customers from their tables and seats them again, in numpy. Pairs seen
once sit alone and are never moved. What a pair needs of its context and word, and the totals of all
restaurants, are frozen inside a pass and joined by shuffle before it. Every draw comes from a hash of its
place (seed, pass, sweep, part, restaurant, word), so neither order nor partitions nor a repeated task
change a seating. The last sweeps are averaged, and predictive probabilities follow from the averages.

Counting sees every training token. Tokens go by numbers: a hash of 58 bits and their class. Pairs travel in
lists: the distinct numbers of a list once, sorted, and places among them for every pair, as differences in
byte planes under zstandard. Buckets are the cells of a grid over the numbers of both words, so a common word
is spread over a row or column of them. To score, documents are dealt into blocks of bounded size; a block asks
the buckets for its distinct words and pairs and gets their seats in the order in which it asked.

Defined cases: a null text is empty and has the closing token alone; a null id is a training row;
repeated rows count as often as they occur; without training rows every token has probability 1.
"""
import hashlib
import math
from dataclasses import dataclass, replace
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import fold, whole
from lograil.session import discard, durable, let_go

END = b""           # no word is empty; as a context it stands for the beginning
WORD = -1           # in place of a context: the row is of a word
CLASSES = 17        # sixteen classes of last bytes, and the beginning
START = CLASSES - 1


@dataclass(frozen=True)
class Sampling:
    strength: float = 1.0       # of every restaurant
    rounds: int = 2             # passes over all words before the averaged one
    sweeps: int = 3             # in each pass
    samples: int = 3            # sweeps that are averaged
    moves: int = 16             # parts into which a sweep divides a dish's customers
    exact: int = 64             # up to so many customers the odds of sitting alone come from exact numbers
    pairs: int = 2_000_000      # pairs of the model that a task gathers before it passes them on
    block: int = 16 << 20       # bytes of text in a scoring block
    seed: int = 11


@dataclass(frozen=True)
class Totals:
    """Of the restaurants: sums over words. Everything the driver holds."""
    tokens: int
    types: int
    customers: tuple[int, ...]      # of each context
    tables: tuple[float, ...]
    parents: float                  # customers of the unigram restaurant
    parent_tables: float
    discount: float                 # of contexts
    parent_discount: float


def number_of(token: bytes) -> int:
    """A positive number for a token; its last five bits are the class the token is as a context."""
    return int(numbers_of([token])[0])


def numbers_of(tokens: list[bytes]) -> np.ndarray:
    digests = np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in tokens]), "<u8") >> np.uint64(1)
    kinds = np.fromiter((t[-1] & 15 if t else START for t in tokens), np.int64, len(tokens))
    return digests.astype(np.int64) & ~31 | kinds


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Of texts (binary): every token's pair (place of the token before << 32 | place), how many tokens a text has,
    the distinct tokens and their sorted numbers; a place is one among these. The closing token ends each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    lengths = np.diff(np.append(0, np.cumsum(full, dtype=np.int64))[ends], prepend=0) + 1
    coded = words.filter(pa.array(full)).dictionary_encode()
    tokens = [END, *coded.dictionary.view(pa.binary()).to_pylist()]
    numbers = numbers_of(tokens)
    order = np.argsort(numbers)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    inside = np.ones(lengths.sum(), bool)
    inside[np.cumsum(lengths) - 1] = False
    places = np.full(len(inside), rank[0])
    places[inside] = rank[1:][coded.indices.to_numpy(zero_copy_only=False)]
    return np.append(rank[:1], places)[:len(places)] << 32 | places, lengths, [tokens[i] for i in order], numbers[order]


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted; np.unique without counts or places hashes, which takes seven times as long here."""
    values = np.sort(values)
    return values[np.diff(values, prepend=values[:1] - 1) != 0]


def _squeezed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers in few bytes: byte planes under zstandard."""
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T) if len(values) else b""
    return len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def _loosened(data: bytes, kind: str = "<u4") -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind).astype(np.int64)


def _rising(values: np.ndarray, kind: str = "<u8") -> bytes:
    """Sorted numbers as differences."""
    return _squeezed(np.diff(values, prepend=0), kind)


def _risen(data: bytes, kind: str = "<u8") -> np.ndarray:
    return np.cumsum(_loosened(data, kind))


def _bytes_squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else bytes(8)


def _bytes_loosened(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""


def _listed(keys: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Sorted pairs of places as a list of pairs of numbers."""
    prevs, first = np.unique(keys >> 32, return_inverse=True)
    words, second = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
    return [_rising(numbers[prevs]), _rising(numbers[words]), _rising(first, "<u4"), _squeezed(second)]


def _unlisted(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Distinct numbers before, distinct numbers of words, and places among these for each pair."""
    return _risen(parts[0]), _risen(parts[1]), _risen(parts[2], "<u4"), _loosened(parts[3])


def _dealt(of: np.ndarray):
    """Bucket and the places of its members, in order."""
    order = np.argsort(of, kind="stable")
    found, starts = np.unique(of[order], return_index=True)
    return zip(found.tolist(), np.split(order, starts[1:]))


def _cells(keys: np.ndarray, numbers: np.ndarray, grid: int):
    """Bucket and members of pairs of places: a cell of the grid over the numbers before and the words'."""
    cell = (numbers >> 5) % grid
    return _dealt(cell[keys >> 32] * grid + cell[keys & 0xFFFFFFFF])


def _grid(blocks: int) -> int:
    """Side of the grid: a bucket for four blocks, nine at least."""
    return max(3, math.ceil(math.sqrt(blocks / 4)))


def _text_blocks(docs: DataFrame, sampling: Sampling) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, math.ceil(size / sampling.block))


PAIRS, WORDS, SERVED = range(3)      # what the parts of a row are about
PARTS = "bucket int, kind int, parts array<binary>"


def _parts(rows: list, names: str = PARTS) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.binary()))
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in names.split(", ")])


def _gathered(batches, limit: int):
    """Tables of batches with about so many bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _texts(rows: pa.Table) -> pa.Array:
    return pa.concat_arrays(rows["text"].chunks) if rows["text"].num_chunks else pa.array([], pa.binary())


def _count(limit: int, grid: int, batches):
    for rows in _gathered(batches, limit):
        keys, _, tokens, numbers = numbered(_texts(rows))
        known = np.bincount(keys & 0xFFFFFFFF, minlength=len(numbers))
        keys, n = np.unique(keys, return_counts=True)
        for bucket, at in _cells(keys, numbers, grid):
            yield _parts([(bucket, PAIRS, [*_listed(keys[at], numbers), _squeezed(n[at])])])
        # The closing token of a table without texts has no customers.
        for bucket, at in _dealt(np.where(known > 0, (numbers >> 5) % grid ** 2, -1)):
            if bucket >= 0:
                yield _parts([(bucket, WORDS, [_rising(numbers[at]), _squeezed(known[at], "<u8"), _bytes_squeezed(b"\n".join([tokens[i] for i in at]))])])


def _joined(arrays) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *arrays])


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[starts], np.add.reduceat(values[order], starts) if len(starts) else values


def _merged(lists: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Of lists of pairs: all distinct numbers before and of words, and a key for each pair, list after list."""
    prevs, words = (_distinct(_joined(_risen(parts[k]) for parts in lists)) for k in (0, 1))
    keys = lambda a, b, first, second: np.searchsorted(prevs, a)[first] * len(words) + np.searchsorted(words, b)[second]
    return prevs, words, _joined(keys(*_unlisted(parts)) for parts in lists)


def _sum_counts(rows: pa.Table) -> pa.Table:
    """A bucket's words and pairs, summed."""
    kinds, parts = rows["kind"].to_pylist(), rows["parts"].to_pylist()
    lists, named = [x for k, x in zip(kinds, parts) if k == PAIRS], [x for k, x in zip(kinds, parts) if k == WORDS]
    prevs, words, keys = _merged(lists)
    keys, n = _summed(keys, _joined(_loosened(x[4]) for x in lists))
    known = _joined(_loosened(x[1], "<u8") for x in named)
    numbers, first = np.unique(_joined(_risen(x[0]) for x in named), return_index=True)
    numbers, known = _summed(_joined(_risen(x[0]) for x in named), known)
    tokens = [t for x in named for t in _bytes_loosened(x[2]).split(b"\n")]
    table = pa.table([
        pa.concat_arrays([pa.nulls(len(keys), pa.binary()), pa.array([tokens[i] for i in first], pa.binary())]),
        pa.array(np.append(prevs[keys // max(len(words), 1)], np.full(len(numbers), WORD))),
        pa.array(np.append(words[keys % max(len(words), 1)], numbers)), pa.array(np.append(n, known))], ["token", "prev", "word", "n"])
    return pa.Table.from_batches(table.to_batches(1 << 16), table.schema)


# Numbers of a bucket's words repeat, and a dictionary of them is larger than what writers allow by default.
STORED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def count_pairs(docs: DataFrame, sampling: Sampling = Sampling()) -> tuple[DataFrame, DataFrame]:
    """Words (token, word, known) and pairs (prev, word, customers) of all rows of `docs` (text); stored."""
    rows = docs.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    counted = rows.mapInArrow(partial(_count, 2 * sampling.block, _grid(_text_blocks(rows, sampling))), PARTS)
    stored = durable(counted.groupBy("bucket").applyInArrow(_sum_counts, "token binary, prev bigint, word bigint, n bigint"), **STORED)
    return (stored.where(F.col("prev") == WORD).select("token", "word", F.col("n").alias("known")),
            stored.where(F.col("prev") != WORD).select("prev", "word", F.col("n").alias("customers")))


def _class_sums(pairs: DataFrame, value: str) -> DataFrame:
    """word, c0 to c16: sums of a column of the pairs over the contexts of each class."""
    kind = F.col("prev").bitwiseAND(F.lit(31))
    return pairs.groupBy("word").agg(*[F.sum(F.when(kind == k, F.col(value)).otherwise(0)).cast("bigint").alias(f"c{k}") for k in range(CLASSES)])


def _cells_of(sums: DataFrame):
    return F.array(*[F.coalesce(sums[f"c{k}"], F.lit(0)) for k in range(CLASSES)])


def by_class(words: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """token, word, known, counts: sums of a column of the pairs over the contexts of each class; stored."""
    sums = _class_sums(pairs, value)
    return durable(words.join(sums, "word").select("token", "word", "known", _cells_of(sums).alias("counts")))


def count(docs: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """token, word, known, counts (an entry for each class of contexts) over all rows of `docs` (text); stored."""
    return by_class(*count_pairs(docs, sampling), "customers")


def _discount(ones: int, twos: int) -> float:
    """The usual estimate from how many were seen once and twice, away from 0 and 1."""
    return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones + twos else 0.5


NONE = (0,) * CLASSES


def first_totals(counts: DataFrame, lone: tuple[int, ...] = NONE) -> Totals:
    """Totals before any seating; the number of tables is guessed as a power of the customers.

    `lone` are, by class, further words that have a single customer in all.
    """
    cells = [F.col("counts")[k] for k in range(CLASSES)]
    used = F.size(F.filter("counts", lambda c: c > 0))
    number = lambda n: F.aggregate("counts", F.lit(0), lambda a, c: a + (c == n).cast("int"))
    row = counts.agg(F.count("*"), *[F.sum(c) for c in cells], F.sum(number(1)), F.sum(number(2)), F.count_if(used == 1), F.count_if(used == 2),
                     *[F.sum(F.when(c > 0, F.pow(c, F.lit(0.8)))) for c in cells]).first()
    values = [x or 0 for x in row]
    customers, (a, b, c, d) = values[1:CLASSES + 1], values[CLASSES + 1:CLASSES + 5]
    customers, tables = ([x + k for x, k in zip(sums, lone)] for sums in (customers, values[CLASSES + 5:]))
    types, once = values[0] + sum(lone), sum(lone)
    return Totals(sum(customers), types, tuple(customers), tuple(map(float, tables)), float(sum(tables)), float(types),
                  _discount(a + once, b), _discount(c + once, d))


@lru_cache(maxsize=8)
def _alone_exact(discount: float, most: int) -> np.ndarray:
    """[c, t]: how likely one of c customers at t tables sits alone; from generalised Stirling numbers."""
    log = np.full((most + 1, most + 2), -np.inf)
    log[0, 0] = 0
    t = np.arange(most + 2)
    for c in range(1, most + 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = log[c - 1] + np.log(np.maximum(c - 1 - discount * t, 0))
        log[c, 1:] = np.logaddexp(log[c - 1, :-1], stay[1:])
    out = np.ones((most + 1, most + 2))
    for c in range(1, most + 1):
        out[c, 1:c + 1] = np.exp(log[c - 1, 0:c] - log[c, 1:c + 1])
    return np.clip(out, 0, 1)


@lru_cache(maxsize=8)
def _alone_curve(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Customers a table against the share of tables with one, for many customers."""
    z = 1 - np.logspace(0, -12, 4000)[1:]
    base = 1 - (1 - z) ** discount
    return z * (1 - z) ** (discount - 1) * discount / base, z * discount / base


def alone(customers: np.ndarray, tables: np.ndarray, discount: float, exact: int) -> np.ndarray:
    """How likely a customer drawn at random sits alone."""
    out = _alone_exact(discount, exact)[np.minimum(customers, exact), np.minimum(tables, exact)]
    large = np.flatnonzero(customers > exact)
    if len(large):
        c, t = customers[large], tables[large]
        many = t / c * np.interp(c / t, *_alone_curve(discount), 1.0)
        out[large] = np.clip(np.where(t >= c, 1.0, many), 0, 1)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def places(seed: int, number: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A key for each (restaurant, word) of a pass; what is drawn for it follows from the key."""
    with np.errstate(over="ignore"):
        lead = _mixed(np.array([seed * 1_000_003 + number], np.uint64))
        return _mixed(_mixed(first.astype(np.int64).view(np.uint64) + lead) + second.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """The draw-th number in [0, 1) of each key."""
    with np.errstate(over="ignore"):
        return (_mixed(keys + np.uint64(draw + 1) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)) * 2.0 ** -53


SINGLE = 24     # up to so many customers are drawn one by one, more by the normal curve


def successes(keys: np.ndarray, draw: int, trials: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """How many of `trials` succeed, each with probability `odds`; draws from `draw` on, at most SINGLE of them."""
    out, several = (uniform(keys, draw) < odds).astype(np.int64), np.flatnonzero((trials > 1) & (trials <= SINGLE))
    for k in range(1, int(trials[several].max(initial=1))):
        more = several[trials[several] > k]
        out[more] += uniform(keys[more], draw + k) < odds[more]
    many = np.flatnonzero(trials > SINGLE)
    if len(many):
        n, p = trials[many], odds[many]
        normal = np.sqrt(-2 * np.log(1 - uniform(keys[many], draw))) * np.cos(2 * np.pi * uniform(keys[many], draw + 1))
        out[many] = np.clip(np.rint(n * p + np.sqrt(n * p * (1 - p)) * normal), 0, n).astype(np.int64)
    return out


def sweep(keys: np.ndarray, number: int, customers: np.ndarray, tables: np.ndarray, odds: np.ndarray, discount: float, sampling: Sampling) -> np.ndarray:
    """Seats every dish's customers again, part by part; `odds` is the weight of a new table. Customers are at least 2.

    A part of one customer is a plain Gibbs step. Dishes with more customers than parts move several
    at once, each by the odds at the part's beginning. `number` is the sweep's, `keys` are the dishes' (`places`).
    """
    part = np.maximum(customers // sampling.moves, 1)
    for move in range(sampling.moves):
        live = np.flatnonzero(customers > move)
        if not len(live):
            break
        c, t, b, k = customers[live], tables[live], part[live], keys[live]
        draw = (number * sampling.moves + move) * 2 * SINGLE
        t = np.maximum(t - successes(k, draw, b, alone(c, t, discount, sampling.exact)), (b < c).astype(np.int64))
        left = c - b
        t = np.minimum(t, left)
        new = odds[live] / (odds[live] + np.maximum(left - discount * t, 0))
        tables[live] = np.clip(t + successes(k, draw + SINGLE, b, new), 1, c)
    return tables


def _parent(n1: np.ndarray, t1: np.ndarray, totals: Totals, strength: float) -> np.ndarray:
    uniform = (strength + totals.parent_discount * totals.parent_tables) / (totals.types + 1)
    return (n1 - totals.parent_discount * t1 + uniform) / (strength + totals.parents)


def _seat(counts: np.ndarray, tables: np.ndarray, parent: np.ndarray, words: np.ndarray, totals: Totals, sampling: Sampling, number: int, sweeps: int):
    """Sweeps over words; yields (tables, parent's tables) after each. Totals stand for all words of the corpus."""
    word, context = np.nonzero(counts > 1)
    customers, keys = counts[word, context], places(sampling.seed, number, context, words[word])
    parent_keys = places(sampling.seed, number, np.full(len(words), CLASSES), words)
    uniform_odds = sampling.strength + totals.parent_discount * totals.parent_tables
    grand = sampling.strength + totals.discount * np.array(totals.tables)
    for n in range(sweeps):
        p1 = _parent(tables.sum(axis=1), parent, totals, sampling.strength)
        tables[word, context] = sweep(keys, n, customers, tables[word, context], grand[context] * p1[word], totals.discount, sampling)
        n1 = tables.sum(axis=1)
        parent = np.clip(parent, 1, n1)
        many = np.flatnonzero(n1 > 1)
        odds = np.full(len(many), uniform_odds / (totals.types + 1))
        parent[many] = sweep(parent_keys[many], n, n1[many], parent[many], odds, totals.parent_discount, sampling)
        yield tables, parent


def _blocks(batches, size: int = 1 << 15):
    """Larger tables of rows than the transfer's batches."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _lists(values: np.ndarray, kind) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1), kind), values.shape[1]).cast(pa.list_(kind))


def _fixed(column, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _round(totals: Totals, sampling: Sampling, number: int, batches):
    """One pass: seats words and passes on their tables; the last pass passes on averages over samples."""
    last = number == sampling.rounds
    for rows in _blocks(batches):
        counts = _fixed(rows["counts"], CLASSES).astype(np.int64)
        tables, parent = _fixed(rows["tables"], CLASSES), rows["parent"].to_numpy()
        # Customers may have changed since the tables were counted.
        tables = np.clip(tables.astype(np.int64), counts > 0, counts)
        parent = np.clip(parent.astype(np.int64), 1, np.maximum(tables.sum(axis=1), 1))
        kept = []
        for t, p in _seat(counts, tables, parent, rows["word"].to_numpy(), totals, sampling, number, sampling.samples if last else sampling.sweeps):
            kept = [*kept, (t.astype(np.float64), p.astype(np.float64))] if last else [(t, p)]
        tables, parent = sum(t for t, _ in kept) / len(kept), sum(p for _, p in kept) / len(kept)
        seats = {"tables": _lists(tables, pa.float64()), "parent": pa.array(parent, pa.float64())}
        yield pa.record_batch([seats[c] if c in seats else rows[c].combine_chunks() for c in rows.column_names], rows.column_names)


def _totals(seated: DataFrame, before: Totals, lone: tuple[int, ...]) -> Totals:
    row = seated.agg(*[F.sum(F.col("tables")[k]) for k in range(CLASSES)], F.sum("parent")).first()
    tables = tuple(float(x or 0) + n for x, n in zip(row[:CLASSES], lone))
    return replace(before, tables=tables, parents=sum(tables), parent_tables=float(row[CLASSES] or 0) + sum(lone))


def _guess(customers):
    return F.when(customers > 0, F.greatest(F.floor(F.pow(customers, F.lit(0.8))), F.lit(1))).otherwise(0).cast("double")


def _begun(counts: DataFrame) -> DataFrame:
    return counts.withColumn("tables", F.transform("counts", _guess)).withColumn("parent", F.lit(1.0))


def _passed(seated: DataFrame, totals: Totals, sampling: Sampling, number: int, lone: tuple[int, ...] = NONE) -> tuple[DataFrame, Totals]:
    seated = durable(seated.mapInArrow(partial(_round, totals, sampling, number), seated.schema))
    return seated, _totals(seated, totals, lone)


def seat(counts: DataFrame, sampling: Sampling = Sampling()) -> tuple[DataFrame, Totals]:
    """token, word, known, counts, tables, parent after sampling (the averages of the last pass; stored), and the totals."""
    totals = first_totals(counts)
    seated = _begun(counts)
    for number in range(sampling.rounds + 1):
        seated, totals = _passed(seated, totals, sampling, number)
    return seated, totals


def _weights(state: DataFrame, totals: Totals, strength: float) -> DataFrame:
    """word, class_counts, class_tables, p1: class restaurants, and the probability in the unigram restaurant."""
    uniform = (strength + totals.parent_discount * totals.parent_tables) / (totals.types + 1)
    p1 = (F.aggregate("tables", F.lit(0.0), lambda a, x: a + x) - totals.parent_discount * F.col("parent") + uniform) / (strength + totals.parents)
    return state.select("word", F.col("counts").alias("class_counts"), F.col("tables").alias("class_tables"), p1.alias("p1"))


def _class_probability(totals: Totals, strength: float):
    """Of a word's weights: its probability in the class of `prev`."""
    kind = F.col("prev").bitwiseAND(F.lit(31)).cast("int")
    of = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values]), kind)
    more = of([strength + totals.discount * x for x in totals.tables])
    return (F.get("class_counts", kind) - totals.discount * F.get("class_tables", kind) + more * F.col("p1")) / of([strength + x for x in totals.customers])


def _class_customers(moved: DataFrame, lone: tuple[int, ...]) -> tuple[int, ...]:
    """Customers of the classes: tables of moved pairs, and those of lone pairs."""
    kind, tables = F.col("prev").bitwiseAND(F.lit(31)), F.round("tables")
    more = {r[0]: int(r[1]) for r in moved.groupBy(kind).agg(F.sum(tables)).collect()}
    return tuple(n + more.get(k, 0) for k, n in enumerate(lone))


def _seat_pairs(discount: float, sampling: Sampling, number: int, batches):
    """One pass over pairs with two customers or more, given the weight of a new table."""
    last = number == sampling.rounds
    for rows in _blocks(batches):
        customers, tables, odds = (rows[c].to_numpy() for c in ("customers", "tables", "odds"))
        keys = places(sampling.seed, number, rows["prev"].to_numpy(), rows["word"].to_numpy())
        tables, kept = np.clip(tables.astype(np.int64), 1, customers), []
        for n in range(sampling.samples if last else sampling.sweeps):
            tables = sweep(keys, n, customers, tables, odds, discount, sampling)
            kept = [*kept, tables.astype(np.float64)] if last else [tables.astype(np.float64)]
        yield pa.record_batch([rows["prev"].combine_chunks(), rows["word"].combine_chunks(), rows["customers"].combine_chunks(), pa.array(sum(kept) / len(kept))],
                              ["prev", "word", "customers", "tables"])


def _context_tables(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("prev").agg(F.sum("tables").alias("served"))


def seat_pairs(words: DataFrame, pairs: DataFrame, sampling: Sampling = Sampling()) -> tuple[DataFrame, DataFrame, Totals, float]:
    """Pairs (prev, word, customers, tables) and class restaurants (as of `seat`) after sampling, their totals, and the contexts' discount."""
    ones, twos = pairs.agg(F.count_if(F.col("customers") == 1), F.count_if(F.col("customers") == 2)).first()
    discount = _discount(ones, twos)
    alone_rows = pairs.where("customers = 1").withColumn("tables", F.lit(1.0))
    moved = pairs.where("customers > 1").withColumn("tables", _guess(F.col("customers")))
    # What lone pairs add to classes and contexts never changes: it is summed once.
    sums, lone_served = _class_sums(alone_rows, "tables"), durable(_context_tables(alone_rows))
    begun = durable(words.join(sums, "word", "left").select("word", "known", _cells_of(sums).alias("lone")))
    # A word seen once has one customer at one table in one class, whatever is drawn.
    once = begun.where("known = 1").select("word", "known", F.col("lone").alias("counts"), F.col("lone").cast("array<double>").alias("tables"), F.lit(1.0).alias("parent"))
    lone, every = (tuple(x or 0 for x in rows.agg(*[F.sum(F.col(c)[k]) for k in range(CLASSES)]).first()) for rows, c in ((once, "counts"), (begun, "lone")))
    state, totals = begun.where("known > 1"), None
    for number in range(sampling.rounds + 1):
        let_go(words.sparkSession)
        sums = _class_sums(moved.withColumn("tables", F.round("tables")), "tables")
        counts = F.zip_with("lone", _cells_of(sums), lambda a, b: a + b).alias("counts")
        before = state.join(sums, "word", "left").select("word", "known", "lone", counts, *(("tables", "parent") if totals else ()))
        if totals is None:
            before, totals = _begun(before), first_totals(before, lone)
        else:
            customers = _class_customers(moved, every)
            totals = replace(totals, tokens=sum(customers), customers=customers)
        before_moved, before_state = moved, state
        state, totals = _passed(before, totals, sampling, number, lone)
        weights = _weights(state, totals, sampling.strength)
        served = lone_served.unionByName(_context_tables(moved)).groupBy("prev").agg(F.sum("served").alias("served"))
        # By word last: the next pass sums what is stored by word.
        ready = moved.join(served.hint("shuffle_hash"), "prev").join(weights.hint("shuffle_hash"), "word").select(
            "prev", "word", "customers", "tables", ((sampling.strength + discount * F.col("served")) * _class_probability(totals, sampling.strength)).alias("odds"))
        moved = durable(ready.mapInArrow(partial(_seat_pairs, discount, sampling, number), "prev bigint, word bigint, customers bigint, tables double"), **STORED)
        if number:
            discard(before_moved, before_state)
    discard(lone_served)
    return alone_rows.unionByName(moved), state.select(once.columns).unionByName(once), totals, discount


def _boxed(limit: int, batches):
    """Rows of a block as one compressed stream of Arrow's."""
    for rows in _gathered(batches, limit):
        for block, at in _dealt(rows["block"].to_numpy()):
            sink, some = pa.BufferOutputStream(), rows.select(["doc_id", "held_out", "text"]).take(at)
            with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(some.combine_chunks())
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "box"])


def _unboxed(rows: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(box).read_all() for box in rows["box"].to_pylist()])


ASKED = "bucket int, block int, parts array<binary>"
ANSWERED = "block int, bucket int, parts array<binary>"


def _ask(grid, rows):
    """A block's distinct pairs and words, for the buckets that know them."""
    keys, _, _, numbers = numbered(_texts(_unboxed(rows)))
    pa.default_memory_pool().release_unused()
    keys, block = _distinct(keys), rows["block"][0].as_py()
    pairs, words = dict(_cells(keys, numbers, grid)), dict(_dealt((numbers >> 5) % grid ** 2))
    none = np.empty(0, np.int64)
    return pa.Table.from_batches([_parts([(bucket, block, [*_listed(keys[pairs.get(bucket, none)], numbers), _rising(numbers[words.get(bucket, none)])])], ASKED)
                                  for bucket in sorted({*pairs, *words})])


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


# A word's seating in few bytes: the parent's tables, then for each context with customers its
# number, customers and tables; tables are sums over samples. Wide entries hold large numbers.
_NARROW = np.dtype([("context", "u1"), ("customers", "u1"), ("tables", "u1")])
_WIDE = np.dtype([("context", "u1"), ("customers", "<u8"), ("tables", "<u8")])


def _packed(counts: np.ndarray, tables: np.ndarray, parents: np.ndarray) -> list[bytes]:
    word, context = np.nonzero(counts)
    ends = np.searchsorted(word, np.arange(len(counts) + 1))
    entries = {kind: np.empty(len(word), kind) for kind in (_NARROW, _WIDE)}
    for rows in entries.values():
        with np.errstate(over="ignore"):
            rows["context"], rows["customers"], rows["tables"] = context, counts[word, context], tables[word, context]
    wide = np.maximum(counts.max(axis=1, initial=0), tables.max(axis=1, initial=0)) > 255
    heads = parents.astype("<u8")
    return [bytes([w]) + h.tobytes() + entries[_WIDE if w else _NARROW][a:b].tobytes() for w, h, a, b in zip(wide.tolist(), heads, ends, ends[1:])]


def _unpacked(seats: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Customers, tables and the parent's tables of a list of packed words."""
    counts, tables = np.zeros((len(seats), CLASSES), np.int64), np.zeros((len(seats), CLASSES), np.int64)
    parents = np.frombuffer(b"".join([x[1:9] for x in seats]), "<u8").astype(np.int64)
    wide = np.frombuffer(b"".join([x[:1] for x in seats]), np.uint8)
    for flag, kind in ((0, _NARROW), (1, _WIDE)):
        rows = np.flatnonzero(wide == flag)
        parts = [seats[i][9:] for i in rows]
        entries = np.frombuffer(b"".join(parts), kind)
        word = np.repeat(rows, [len(x) // kind.itemsize for x in parts])
        counts[word, entries["context"]], tables[word, entries["context"]] = entries["customers"], entries["tables"]
    return counts, tables, parents


def _pack_pairs(samples: int, limit: int, grid: int, batches):
    """Pairs (prev, word, customers, tables) as lists for their buckets, and what a word serves as a context."""
    for rows in _blocks(batches, limit):
        prev, word = rows["prev"].to_numpy(), rows["word"].to_numpy()
        numbers, places = np.unique(np.append(prev, word), return_inverse=True)
        keys = places[:len(prev)] << 32 | places[len(prev):]
        order = np.argsort(keys)
        keys, customers, tables = keys[order], rows["customers"].to_numpy()[order], np.rint(rows["tables"].to_numpy() * samples).astype(np.int64)[order]
        for bucket, at in _cells(keys, numbers, grid):
            yield _parts([(bucket, PAIRS, [*_listed(keys[at], numbers), _squeezed(customers[at], "<u8"), _squeezed(tables[at], "<u8")])])
        served = np.bincount(keys >> 32, tables, len(numbers)).astype(np.int64)
        for bucket, at in _dealt(np.where(served > 0, (numbers >> 5) % grid ** 2, -1)):
            if bucket >= 0:
                yield _parts([(bucket, SERVED, [_rising(numbers[at]), _squeezed(served[at], "<u8")])])


def _pack_words(samples: int, grid: int, batches):
    """Words (word, known, counts, tables, parent) as lists for their buckets."""
    for rows in _blocks(batches, 1 << 17):
        numbers = rows["word"].to_numpy()
        order = np.argsort(numbers)
        sums = np.rint(_fixed(rows["tables"], CLASSES) * samples).astype(np.int64)
        seats = _packed(_fixed(rows["counts"], CLASSES), sums, np.rint(rows["parent"].to_numpy() * samples).astype(np.int64))
        for bucket, at in _dealt((numbers[order] >> 5) % grid ** 2):
            at = order[at]
            yield _parts([(bucket, WORDS, [_rising(numbers[at]), _squeezed(rows["known"].to_numpy()[at], "<u8"), *_pack_seats([seats[i] for i in at])])])


def _pack_seats(seats: list[bytes]) -> list[bytes]:
    """Packed words in byte planes: heads, sizes of entries, narrow entries and wide ones."""
    heads = np.frombuffer(b"".join([x[:9] for x in seats]), np.uint8).reshape(-1, 9)
    entries, wide = [x[9:] for x in seats], heads[:, 0].tolist()
    narrow = np.frombuffer(b"".join([x for x, w in zip(entries, wide) if not w]), np.uint8).reshape(-1, _NARROW.itemsize)
    return [_bytes_squeezed(heads.T.tobytes()), _squeezed(np.fromiter(map(len, entries), np.int64, len(entries))),
            _bytes_squeezed(narrow.T.tobytes()), _bytes_squeezed(b"".join([x for x, w in zip(entries, wide) if w]))]


def _unpack_seats(heads: bytes, sizes: bytes, narrow: bytes, wide: bytes) -> list[bytes]:
    rows = np.frombuffer(_bytes_loosened(heads), np.uint8).reshape(9, -1).T
    first, sizes = rows.tobytes(), _loosened(sizes)
    held = [np.frombuffer(_bytes_loosened(narrow), np.uint8).reshape(_NARROW.itemsize, -1).T.tobytes(), _bytes_loosened(wide)]
    ends = np.empty(len(sizes), np.int64)
    for flag in (0, 1):
        ends[rows[:, 0] == flag] = np.cumsum(sizes[rows[:, 0] == flag])
    return [first[9 * i:9 * i + 9] + held[w][end - size:end] for i, (w, end, size) in enumerate(zip(rows[:, 0].tolist(), ends.tolist(), sizes.tolist()))]


def _found(numbers: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among sorted numbers, and whether the wanted are there."""
    at = np.minimum(np.searchsorted(numbers, wanted), max(len(numbers) - 1, 0))
    return at, numbers[at] == wanted if len(numbers) else np.zeros(len(wanted), bool)


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    """To each block, in the order in which it asked: customers and tables of pairs; customers, tables served and seats of words."""
    kinds, parts = model["kind"].to_pylist(), model["parts"].to_pylist()
    of = lambda kind: [x for k, x in zip(kinds, parts) if k == kind]
    lists, named, sums = of(PAIRS), of(WORDS), of(SERVED)
    prevs, words, keys = _merged(lists)
    order = np.argsort(keys)
    keys, customers, tables = keys[order], *(_joined(_loosened(x[k], "<u8") for x in lists)[order] for k in (4, 5))
    numbers = _joined(_risen(x[0]) for x in named)
    order = np.argsort(numbers)
    numbers, known = numbers[order], _joined(_loosened(x[1], "<u8") for x in named)[order]
    seats = [y for x in named for y in _unpack_seats(*x[2:])]
    seats = [seats[i] for i in order]
    contexts, served = _summed(_joined(_risen(x[0]) for x in sums), _joined(_loosened(x[1], "<u8") for x in sums))
    out = []
    for bucket, block, parts in ((asked[c][i].as_py() for c in ("bucket", "block", "parts")) for i in range(len(asked))):
        before, after, first, second = _unlisted(parts)
        (p, p_there), (w, w_there) = _found(prevs, before), _found(words, after)
        at, there = _found(keys, p[first] * len(words) + w[second])
        there &= p_there[first] & w_there[second]
        of_pairs = [_squeezed(np.where(there, x[at], 0) if len(x) else np.zeros(len(there), np.int64), "<u8") for x in (customers, tables)]
        wanted = _risen(parts[4])
        (w, w_there), (c, c_there) = _found(numbers, wanted), _found(contexts, wanted)
        of_words = [_squeezed(np.where(there, x[at], 0) if len(x) else np.zeros(len(there), np.int64), "<u8") for x, at, there in ((known, w, w_there), (served, c, c_there))]
        out.append(_parts([(block, bucket, [*of_pairs, *of_words, *_pack_seats([seats[i] if k else UNKNOWN for i, k in zip(w.tolist(), w_there.tolist())])])], ANSWERED))
    return pa.Table.from_batches(out, _parts([], ANSWERED).schema)


UNKNOWN = bytes(9)      # the seats of a word without customers


def _score(totals: Totals, tokens: int, discount: float, sampling: Sampling, grid: int, boxes: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of a block's documents from the seats of the block's words and pairs; an unknown word has none."""
    strength, docs = sampling.strength, _unboxed(boxes)
    (pairs, lengths, _, numbers), docs, _ = numbered(_texts(docs)), docs.select(["doc_id", "held_out"]), None
    pa.default_memory_pool().release_unused()
    keys, of = np.unique(pairs, return_inverse=True)
    answered = dict(zip(answers["bucket"].to_pylist(), answers["parts"].to_pylist()))
    own, known, served, seats = np.zeros(len(keys)), np.zeros(len(numbers), np.int64), np.zeros(len(numbers)), [UNKNOWN] * len(numbers)
    for bucket, at in _cells(keys, numbers, grid):
        if bucket in answered:
            own[at] = _loosened(answered[bucket][0], "<u8") - discount * (_loosened(answered[bucket][1], "<u8") / sampling.samples)
    for bucket, at in _dealt((numbers >> 5) % grid ** 2):
        if bucket in answered:
            parts = answered[bucket]
            known[at], served[at] = _loosened(parts[2], "<u8"), _loosened(parts[3], "<u8") / sampling.samples
            for i, seat in zip(at.tolist(), _unpack_seats(*parts[4:])):
                seats[i] = seat
    more, size = strength + totals.discount * np.array(totals.tables), strength + np.array(totals.customers)
    classes = np.empty((len(numbers), CLASSES), np.float32)
    # A slice of the words at a time: their unpacked seats would be the largest of a block's arrays.
    for at in range(0, len(seats), 1 << 15):
        some = slice(at, at + (1 << 15))
        counts, tables, parents = _unpacked(seats[some])
        p1 = _parent(tables.sum(axis=1) / sampling.samples, parents / sampling.samples, totals, strength)
        classes[some] = (counts - totals.discount * tables / sampling.samples + more * p1[:, None]) / size
    del seats, counts, tables
    context, word = keys >> 32, keys & 0xFFFFFFFF
    p = (own + (strength + discount * served[context]) * classes[word, numbers[context] & 31]) / (strength + known[context])
    base, starts, words = np.log10((known + 1) / (tokens + totals.types + 1)), np.cumsum(lengths) - lengths, pairs & 0xFFFFFFFF
    total = lambda values: np.add.reduceat(values, starts)
    return pa.table([docs["doc_id"].combine_chunks(), docs["held_out"].combine_chunks(), pa.array(lengths), pa.array(total((known[words] > 0).astype(np.int64))),
                     pa.array(np.full(len(lengths), tokens, np.int64)), pa.array(total(base[words])), pa.array(total(np.log10(p)[of]))], [x.split()[0] for x in SCORES.split(", ")])


def score(docs: DataFrame, pairs: DataFrame, seated: DataFrame, totals: Totals, discount: float, sampling: Sampling = Sampling()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of `docs` (doc_id, held_out, text)."""
    blocks = _text_blocks(docs, sampling)
    grid, tokens = _grid(blocks), seated.agg(F.sum("known")).first()[0] or 0
    let_go(docs.sparkSession)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "held_out", "text")
    boxes = dealt.mapInArrow(partial(_boxed, 4 * sampling.block), "block int, box binary").repartition("block")
    asked = boxes.groupBy("block").applyInArrow(partial(_ask, grid), ASKED)
    model = (pairs.mapInArrow(partial(_pack_pairs, sampling.samples, sampling.pairs, grid), PARTS)
             .unionByName(seated.select("word", "known", "counts", "tables", "parent").mapInArrow(partial(_pack_words, sampling.samples, grid), PARTS)))
    answers = asked.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(_answer, ANSWERED)
    return boxes.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(partial(_score, totals, tokens, discount, sampling, grid), SCORES)


def language_model_scores(docs: DataFrame, sampling: Sampling = Sampling()) -> DataFrame:
    """Scores of all rows of `docs` (doc_id, text) under the model of those whose id leaves no rest 2 modulo 7."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fold("doc_id", 7, 2).alias("held_out"), whole("text").cast("binary").alias("text"))
    words, pairs = count_pairs(rows.where(~F.col("held_out")).select(F.col("text")), sampling)
    return score(rows, *seat_pairs(words, pairs, sampling), sampling)
