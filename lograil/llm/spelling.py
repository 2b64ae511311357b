"""Spelling variants: words at one edit, found with an index of variable-length grams.

The dictionary of grams is pruned by frequency: a gram may be longer than two letters only if what it
extends is frequent, that is stands in more than a share of all places. A word's gram at a place is
the shortest entry there that is not frequent, of at most `Grams.longest` letters and half the word.
Whether a gram stands at a place so depends on its own letters and the word's length alone, and an
edit affects just the grams that contain it. Each word is listed under as few of its grams as the bound on affected grams
allows: grams of which no edit hits all, with the shortest lists. One edit hits at most one of two
disjoint grams, so a word and its near word meet in at least one list of the shorter word (of equally
long ones, of the lesser) at a place that the edit leaves or moves by one. Lists are merged in sorted
blocks and every candidate is verified letter by letter; a pair is passed on from the first list it
meets in, so it is found once.

Words are counted per document with the planted damage, then by shuffle. Frequent grams are at most
`Grams.share` of each length, so the dictionary is of bounded size and goes to every task. A list longer
than `Grams.block` is dealt to several tasks.

Defined cases: a null text has no words; a null id is an empty id in the hash; equal rows count as often
as they stand; a table without words gives no rows; words of more than twice `Grams.window` letters are
listed by their first and last places, which is exact for one edit as well.
"""
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import sized, whole
from lograil.session import durable

LETTERS = "a-zÀ-ÿ"
OTHER = re.compile(f"[^{LETTERS}]")


@dataclass(frozen=True)
class Grams:
    longest: int = 6
    share: int = 8000       # a frequent gram stands in more than one of so many places
    least: int = 16         # and in more than so many
    window: int = 32        # of a long word, places at either end
    block: int = 4096       # longest list in one piece
    pairs: int = 1 << 19    # candidates verified at once


# ---- words and their numbers ----

def _slices(text: str, size: int = 1 << 20):
    """The text in parts that cut no run of letters."""
    at = 0
    while at < len(text):
        end = OTHER.search(text, at + size)
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def words_of(doc_id, text: str, shortest: int) -> Counter:
    """Words of a document with the planted damage; lower-cases A-Z only."""
    found: Counter = Counter()
    runs = re.compile(f"[{LETTERS}]{{{shortest},}}")
    for part in _slices(text.encode().lower().decode()):
        found.update(runs.findall(part))
    begin, damaged = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), []
    for word in found:
        if not (h := zlib.crc32(word.encode(), begin)) % 97:
            damaged.append((word, h))
    fixed = [(word[:h % len(word)] + word[h % len(word) + 1:], found.pop(word)) for word, h in damaged]
    for word, n in fixed:
        if len(word) >= shortest:
            found[word] += n
    return found


def _counted(shortest: int, limit: int, batches):
    held: Counter = Counter()

    def passed():
        words = list(held)
        for at in range(0, len(words), 1 << 16):
            part = words[at:at + (1 << 16)]
            yield pa.record_batch([pa.array(part), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            held.update(words_of(doc_id, text, shortest))
        if len(held) > limit:
            yield from passed()
            held = Counter()
    yield from passed()


def count_words(docs: DataFrame, shortest: int = 5, least: int = 3, limit: int = 400_000) -> DataFrame:
    """(word, n) of the words of `docs` (doc_id, text) with at least `shortest` letters and `least` occurrences."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), whole("text").alias("text"))
    found = rows.mapInArrow(partial(_counted, shortest, limit), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- the dictionary ----

def _gram_counts(longest: int, batches):
    for batch in batches:
        found: Counter = Counter()
        for word in batch.column("word").to_pylist():
            for size in range(2, longest):
                found.update(word[at:at + size] for at in range(len(word) - size + 1))
        yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"])


def frequent_grams(words: DataFrame, grams: Grams = Grams()) -> dict[str, int]:
    """How often each frequent gram stands in the distinct words; at most (longest - 2) * share entries."""
    places = words.agg(F.sum(F.length("word") - 1)).first()[0] or 0
    found = words.select("word").mapInArrow(partial(_gram_counts, grams.longest), "gram string, n bigint")
    often = found.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > max(grams.least, places // grams.share))
    return {r.gram: r.n for r in often.toLocalIterator()}


@lru_cache(maxsize=1 << 10)
def _places(length: int, window: int) -> tuple[int, ...]:
    """Places of a word whose grams may be listed or asked for."""
    return tuple(p for p in range(length - 1) if p <= window or p >= length - 1 - window)


class Decomposer:
    def __init__(self, frequent: dict[str, int], grams: Grams):
        self.frequent, self.grams = frequent, grams
        self.seldom = max(min(frequent.values(), default=4) // 4, 1)

    def limit(self, length: int) -> int:
        """Longest gram of a word of this length; two at its ends are disjoint."""
        return min(self.grams.longest, length // 2)

    def at(self, word: str, limit: int, more: int = 0) -> list[tuple[int, str]]:
        """(place, gram) of a word; those that only the word's end stops are left out."""
        frequent, size, out = self.frequent, len(word), []
        for place in _places(size, self.grams.window + more):
            end = place + 2
            while word[place:end] in frequent and end - place < limit and end < size:
                end += 1
            if end - place == limit or word[place:end] not in frequent:
                out.append((place, word[place:end]))
        return out

    def listed(self, word: str) -> list[tuple[int, str]]:
        """Two disjoint grams with the shortest lists: an edit affects at most one of them."""
        found = self.at(word, self.limit(len(word)))
        cost = [self.frequent.get(gram, self.seldom) for _, gram in found]
        best, least, behind, cheapest = None, None, None, [0] * len(found)     # the cheapest gram from each on
        for i in range(len(found) - 1, -1, -1):
            behind = i if behind is None or cost[i] <= cost[behind] else behind
            cheapest[i] = behind
        starts = [place for place, _ in found]
        for i, (place, gram) in enumerate(found):
            ahead = int(np.searchsorted(starts, place + len(gram)))
            if ahead < len(found):
                j = cheapest[ahead]
                if least is None or cost[i] + cost[j] < least:
                    best, least = (i, j), cost[i] + cost[j]
        return [found[k] for k in best]


ENTRIES = "length int, key string, listed boolean, word string, n bigint, place int, size int, other int, other_size int, shift int"
_ENTRY_NAMES = [x.split()[0] for x in ENTRIES.split(", ")]


def _key(limit: int, place: int, gram: str) -> str:
    return f"{gram}{place}/{limit}"


def _entries(shared, listed: bool, batches):
    """Entries of the lists, or of what is looked up in them.

    An entry: the length of the word looked up, the key; for listed words the place and size of the gram, of
    the word's gram before it (0 if it is the first) and by how much the edit moved it.
    """
    decomposer = shared.value
    for batch in batches:
        rows = []
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            size, limit = len(word), decomposer.limit(len(word))
            if listed:
                other = (0, "")
                for place, gram in decomposer.listed(word):
                    for length, shift in ((size, 0), (size + 1, 0), (size + 1, 1)):
                        rows.append((length, _key(limit, place + shift, gram), True, word, n, place, len(gram), other[0], len(other[1]), shift))
                    other = place, gram
            else:
                for one in {limit, decomposer.limit(size - 1)}:
                    rows += [(size, _key(one, place, gram), False, word, n, 0, 0, 0, 0, 0) for place, gram in decomposer.at(word, one, 1)]
        kinds = (pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int64(), *[pa.int32()] * 5)
        for at in range(0, len(rows), 1 << 14):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[at:at + (1 << 14)]), kinds)], _ENTRY_NAMES)


# ---- merging ----

def _letters(words: list[str], width: int) -> np.ndarray:
    """A row of letters for each word, padded by zeros."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("latin-1"), np.uint8).reshape(len(words), width)


def _near(length: int, left: np.ndarray, short: np.ndarray, right: np.ndarray, place, size, other, other_size, shift) -> np.ndarray:
    """Which candidates differ by one edit and meet here for the first time.

    `left` has the listed words' letters (`short`: one letter less than `right`), `right` those looked up.
    """
    same = left == right
    ahead = np.argmin(np.concatenate([same, np.zeros((len(same), 1), bool)], axis=1), axis=1)       # equal letters at the beginning
    # A replaced letter: one mismatch, and the lesser word is the listed one.
    mismatches = length - same.sum(axis=1)
    at = np.minimum(ahead, length - 1)
    rows = np.arange(len(left))
    good = ~short & (mismatches == 1) & (left[rows, at] < right[rows, at])
    # An inserted letter: beginning and end together cover the shorter word.
    moved = (left[:, :-1] == right[:, 1:])[:, ::-1]
    behind = np.argmin(np.concatenate([moved, np.zeros((len(moved), 1), bool)], axis=1), axis=1)
    good |= short & (np.minimum(ahead, length - 1) + behind >= length - 1)

    here = np.flatnonzero(good)
    if not len(here):
        return here
    left, right, short = left[here], right[here], short[here]
    place, size, other, other_size, shift = (x[here] for x in (place, size, other, other_size, shift))
    unmoved = _equal(left, right, place, size, 0)
    stands = np.where(shift == 0, unmoved, ~unmoved & _equal(left, right, place, size, 1))
    before = (other_size > 0) & (_equal(left, right, other, other_size, 0) | short & _equal(left, right, other, other_size, 1))
    return here[stands & ~before]


def _equal(left: np.ndarray, right: np.ndarray, begin: np.ndarray, size: np.ndarray, by: int) -> np.ndarray:
    """Whether `size` letters of `left` from `begin` on stand in `right`, moved by `by`."""
    out, last = np.ones(len(left), bool), left.shape[1] - 1
    rows = np.arange(len(left))
    for k in range(int(size.max(initial=0))):
        inside = k < size
        out &= ~inside | (left[rows, np.minimum(begin + k, last)] == right[rows, np.minimum(begin + k + by, last)])
    return out


PAIRS = "word string, n bigint, near string, near_n bigint"


def _group_pairs(starts: np.ndarray, listed: np.ndarray, most: int):
    """Index pairs (listed, looked up) inside each run of rows that begins at `starts`; listed rows come first in a run."""
    ends = np.append(starts[1:], len(listed))
    tops = starts + np.add.reduceat(listed.astype(np.int64), starts)
    widths = ends - tops
    owner = np.repeat(np.arange(len(starts)), tops - starts)
    rows = np.flatnonzero(listed)
    n = widths[owner]
    rows, owner, n = rows[n > 0], owner[n > 0], n[n > 0]
    at = 0
    total = np.cumsum(n)
    while at < len(rows):
        base = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, base + most, "right")), at + 1)
        if to == at + 1 and n[at] > most:
            for first in range(0, n[at], most):
                right = tops[owner[at]] + np.arange(first, min(first + most, n[at]))
                yield np.full(len(right), rows[at]), right
        else:
            left = np.repeat(rows[at:to], n[at:to])
            inner = np.arange(len(left)) - np.repeat(total[at:to] - n[at:to] - base, n[at:to])
            yield left, np.repeat(tops[owner[at:to]], n[at:to]) + inner
        at = to


def _runs(batches, size: int = 1 << 16):
    """Rows of whole lists, gathered; a task's rows are sorted by length, block and key."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < size:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        last = {c: rows[c][-1].as_py() for c in ("length", "part", "key")}
        tail = np.ones(len(rows), bool)
        for c in ("length", "part"):
            tail &= rows[c].to_numpy() == last[c]
        tail &= np.array(pc.equal(rows["key"], last["key"]))
        cut = len(rows) - int(tail.sum())
        if cut:
            yield rows.slice(0, cut)
        held = rows.slice(cut).to_batches()
        n = len(rows) - cut
    if n:
        yield pa.Table.from_batches(held)


def _merged(most: int, batches):
    """Near pairs from the lists of a task."""
    for rows in _runs(batches):
        length, part, listed = (rows[c].to_numpy(zero_copy_only=False) for c in ("length", "part", "listed"))
        keys = np.array(rows["key"].combine_chunks().dictionary_encode().indices)
        words, n = np.array(rows["word"].to_pylist(), object), rows["n"].to_numpy()
        numbers = [rows[c].to_numpy() for c in ("place", "size", "other", "other_size", "shift")]
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            changed = (np.diff(keys[at]) != 0) | (np.diff(part[at]) != 0)
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            letters = _letters(list(words[at]), int(one))
            short = letters[:, -1] == 0
            columns = [x[at] for x in numbers]
            for left, right in _group_pairs(starts, listed[at], max(most * 16 // (16 + int(one)), 1)):
                near = _near(int(one), letters[left], short[left], letters[right], *(x[left] for x in columns))
                if len(near):
                    a, b = at[left[near]], at[right[near]]
                    yield pa.record_batch([pa.array(words[a], pa.string()), pa.array(n[a]), pa.array(words[b], pa.string()), pa.array(n[b])],
                                          ["word", "n", "near", "near_n"])


def near_words(words: DataFrame, grams: Grams = Grams()) -> DataFrame:
    """(word, n, near, near_n): every pair at one edit of the distinct `words` (word, n), stored, once."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(Decomposer(frequent_grams(words, grams), grams))
    listed = words.mapInArrow(partial(_entries, shared, True), ENTRIES)
    asked = words.mapInArrow(partial(_entries, shared, False), ENTRIES)
    # Lists longer than a block are dealt to parts; what is looked up goes to all parts of its list.
    sizes = listed.groupBy("length", "key").agg(F.count("*").alias("entries")).where(F.col("entries") > grams.block)
    long = sized(durable(sizes.select("length", "key", F.ceil(F.col("entries") / grams.block).cast("int").alias("parts"))))
    listed = listed.join(long, ["length", "key"], "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    asked = asked.join(long, ["length", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    entries = listed.unionByName(asked).drop("parts")
    merged = (entries.repartition("length", "part", "key").sortWithinPartitions("length", "part", "key", F.desc("listed"))
              .mapInArrow(partial(_merged, grams.pairs), PAIRS))
    return durable(merged)


# ---- forms and roots ----

def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): the last of the forms that follow on a word.

    A form is at least twice as frequent as its word, so few rounds of doubling reach every end.
    """
    state = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = durable(state.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not ahead.where("moved").limit(1).count():
            return ahead.select("word", "root")
        state = ahead.select("word", "root")


def variants(words: DataFrame, times: int = 2, grams: Grams = Grams()) -> DataFrame:
    """word, form, root, n, n_near, form_n for the distinct `words` (word, n).

    The form is the near word of largest n (of equals the least), if its n is at least `times` the word's.
    """
    words = durable(words)
    pairs = near_words(words, grams)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    follows = -F.col("best.minus") >= times * F.col("n")
    near = durable(best.select("word", "n_near", F.when(follows, F.col("best.near")).alias("form"), F.when(follows, -F.col("best.minus")).alias("form_n")))
    roots = _roots(near.where("form IS NOT NULL"))
    return (words.join(near, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"))


def spelling_variants(docs: DataFrame, grams: Grams = Grams()) -> DataFrame:
    """The variants among the words of all `docs` (doc_id, text) with at least five letters and three occurrences."""
    return variants(count_words(docs), grams=grams)
