"""Toxicity by a convolutional text classifier trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first four letters, so
that inflected forms share a part. Filters one to three words wide slide over the vectors; of each
filter the largest values of a text are pooled, and a logistic unit turns them into a score.

Every labelled row that is not held out teaches. A bounded sample (`Fit.toxic` and `Fit.clean` rows of at
most `Fit.longest` bytes, whole texts) only gives the network its start, on the driver. Then all rows pass
through it: they are dealt into parts, each part goes on learning from the start by itself, and what its
parameters moved is averaged over the parts. Which words count is decided by their texts among all rows.
Operating points come from cross-validation: every row is judged by a network that learned without its fold,
from the sample's start on, and the common threshold is where F0.5 is largest, for a clean text thrown away
costs more than a toxic one kept. The threshold of a language is where F0.5 of its own rows is largest, the
other rows weighing less the more toxic rows it has itself; the same rules hold for any number of rows.
Judgements are counted at steps of 1/256 of a logit. Scores are moved so that the common threshold is
`Fit.cut`; language, source, id and labels are never part of a score.

Scoring is one pass over the documents without a shuffle. Defined cases: null and empty texts get the
score of a text without words; every row gets a row; documents with contradictory labels teach nothing,
repeated labels count once; without usable labels of both kinds every score is 0.
"""
import copy
import re
import zlib
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograil.llm.common import fold, remembered, sized, whole
from lograil.session import durable

WORD = re.compile(r"\w+")
WIDTHS = (1, 2, 3)


@dataclass(frozen=True)
class Fit:
    """Settings of fitting; the sample of the start is at most toxic + clean rows at any corpus size."""
    toxic: int = 1500
    clean: int = 3000
    longest: int = 1 << 16
    folds: int = 3
    buckets: int = 1 << 17
    dim: int = 12
    filters: int = 12
    pooled: int = 3
    known: int = 4      # a bucket's embedding counts if its words stand in this many texts it learns from
    part: int = 4096    # labelled rows that learn one after the other; more in each of `parts` if there are more
    parts: int = 64
    epochs: int = 6
    rate: float = 0.08
    own: float = 20.0   # toxic rows with which a language weighs as much in its threshold as all others
    cut: float = 0.7
    seed: int = 7


@dataclass
class Network:
    fit: Fit
    embedding: np.ndarray               # (2 * buckets, dim): words, then beginnings of words
    convolutions: list[np.ndarray]      # for each width, (width, dim, filters)
    biases: list[np.ndarray]
    weights: np.ndarray                 # (widths, pooled, filters)
    bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        """Without the embedding's zero rows, of words that do not count."""
        at = np.flatnonzero(np.any(self.embedding, axis=1)).astype(np.int32)
        return self.__dict__ | {"embedding": (at, self.embedding[at], self.embedding.shape)}

    def __setstate__(self, state):
        at, rows, shape = state["embedding"]
        self.__dict__.update(state, embedding=np.zeros(shape, rows.dtype))
        self.embedding[at] = rows


def buckets_of(word: str, buckets: int) -> tuple[int, int]:
    return (zlib.crc32(word.encode()) % buckets, buckets + zlib.crc32(b"^" + word[:4].encode()) % buckets)


class _Buckets(dict):
    """Word to its buckets, the first in the low 32 bits; bounded, kept over the texts of a process."""

    LIMIT = 50_000

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word):
        low, high = buckets_of(word, self.buckets)
        found = low | high << 32
        if len(self) < self.LIMIT:
            self[word] = found
        return found


def _ids(words: list[str], buckets: int) -> np.ndarray:
    return np.fromiter(map(remembered(_Buckets, buckets).__getitem__, words), "<i8", len(words)).view("<i4").reshape(-1, 2)


def word_ids(text: str, buckets: int) -> np.ndarray:
    return _ids(WORD.findall(text.lower()), buckets)


def _seen(fit: Fit, texts) -> np.ndarray:
    """In how many texts each bucket stands."""
    seen = np.zeros(2 * fit.buckets, np.int64)
    for ids in texts:
        seen[ids.ravel()] += 1      # a bucket that is named again gets the same value again
    return seen


def _start(fit: Fit, seen: np.ndarray) -> Network:
    rng = np.random.default_rng(fit.seed)
    embedding = np.empty((2 * fit.buckets, fit.dim), np.float32)
    for at in range(0, len(embedding), 1 << 12):    # the same draws as all at once, without as many doubles in memory
        part = embedding[at:at + (1 << 12)]
        part[:] = rng.normal(0, 0.1, part.shape)
    embedding[seen < fit.known] = 0
    shapes = [(w, fit.dim, fit.filters) for w in WIDTHS]
    return Network(fit, embedding, [rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)).astype(np.float32) for w, d, f in shapes],
                   [np.zeros(fit.filters, np.float32) for _ in WIDTHS],
                   np.abs(rng.normal(0, 0.3, (len(WIDTHS), fit.pooled, fit.filters))).astype(np.float32), -1.0)


def _matrix(net: Network) -> np.ndarray:
    """The filters side by side, (dim, all): of all widths what meets a window's first word, then its second, its third."""
    return np.concatenate([c[o] for o in range(max(WIDTHS)) for c in net.convolutions if o < len(c)], axis=1)


def _values(net: Network, matrix: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """(widths * filters, n): every filter's value, without its bias, at the windows that begin at the first n rows of x."""
    products, all_ = matrix.T @ x.T, len(WIDTHS) * net.fit.filters
    out, at = products[:all_, :n], all_
    for o in range(1, max(WIDTHS)):
        rows = sum(width > o for width in WIDTHS) * net.fit.filters
        out[all_ - rows:] += products[at:at + rows, o:o + n]
        at += rows
    return out


def _pool(values: np.ndarray, pooled: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of each filter's largest values, largest first, (pooled, filters); `values` are used up."""
    top = np.empty((min(pooled, values.shape[1]), len(values)), np.int64)
    best, lanes = np.empty(top.shape, np.float32), np.arange(len(values))
    for p in range(len(top)):
        top[p] = values.argmax(axis=1)
        best[p] = values[lanes, top[p]]
        values[lanes, top[p]] = -np.inf
    return top, best


def _vectors(net: Network, ids: np.ndarray, behind: int) -> np.ndarray:
    """The words' vectors and `behind` zero vectors."""
    x = np.zeros((len(ids) + behind, net.fit.dim), np.float32)
    np.add(net.embedding.take(ids[:, 0], axis=0), net.embedding.take(ids[:, 1], axis=0), out=x[:len(ids)])
    return x


def _forward(net: Network, ids: np.ndarray, matrix: np.ndarray | None = None):
    """Logit, and what the backward pass needs; positions beyond the text are zero vectors."""
    fit, logit, traces = net.fit, net.bias, []
    padded = _vectors(net, ids, max(WIDTHS))
    top, best = _pool(_values(net, _matrix(net) if matrix is None else matrix, padded, max(len(ids), 1)), fit.pooled)
    best = np.maximum(best + np.concatenate(net.biases), 0)
    for k in range(len(WIDTHS)):
        own = slice(k * fit.filters, (k + 1) * fit.filters)
        logit += float((best[:, own] * net.weights[k][:len(best)]).sum())
        traces.append((padded, top[:, own], best[:, own]))
    return logit, traces


class _Steps:
    """Adagrad steps on whole arrays or rows of them."""

    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, name, array: np.ndarray, rows, gradient: np.ndarray):
        if name not in self.sums:
            self.sums[name] = np.zeros(array.shape, array.dtype)    # only what is written takes memory
        total = self.sums[name]
        total[rows] += gradient ** 2
        array[rows] -= self.rate * gradient / (np.sqrt(total[rows]) + 1e-6)


def _learn(net: Network, ids: np.ndarray, slope: float, traces, steps: _Steps, frozen: np.ndarray):
    down = np.zeros((len(ids) + max(WIDTHS), net.fit.dim), np.float32)
    for k, (padded, top, best) in enumerate(traces):
        live = (best > 0) * net.weights[k][:len(best)] * slope
        steps.step(("w", k), net.weights[k], slice(0, len(best)), slope * best)
        steps.step(("b", k), net.biases[k], slice(None), live.sum(0))
        gradient = np.empty_like(net.convolutions[k])
        for o in range(WIDTHS[k]):
            gradient[o] = np.einsum("pfd,pf->df", padded[top + o], live)
            np.add.at(down, (top + o).ravel(), (live[..., None] * net.convolutions[k][o].T).reshape(-1, net.fit.dim))
        steps.step(("c", k), net.convolutions[k], slice(None), gradient)
    moved = np.flatnonzero(np.any(down[:len(ids)], axis=1))
    rows = ids[moved]
    for side in (0, 1):
        uniq, inverse = np.unique(rows[:, side], return_inverse=True)
        gradient = np.zeros((len(uniq), net.fit.dim), np.float32)
        np.add.at(gradient, inverse, down[moved])
        trained = ~frozen[uniq]
        steps.step("e", net.embedding, uniq[trained], gradient[trained])
    net.bias -= steps.rate * 0.1 * slope


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _best_threshold(scores: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """The logit at which F0.5 is largest, in the middle of the gap to the next score below.

    One more toxic row is counted above all scores, so that few toxic rows below many clean ones do not make
    everything toxic.
    """
    order = np.argsort(-scores, kind="stable")
    ordered, hits, taken = scores[order], (toxic * weights)[order], weights[order]
    f = 1.25 * np.append(1, 1 + np.cumsum(hits)) / (np.append(1, 1 + np.cumsum(taken)) + 0.25 * (1 + hits.sum()))
    edges = np.concatenate([[ordered[0] + 2], ordered, [ordered[-1] - 2]])
    at = int(np.argmax(np.where(edges[:-1] > edges[1:], f, -1)))
    return float(edges[at] + edges[at + 1]) / 2


def _folds(rng, toxic: np.ndarray, langs: list[str | None], folds: int) -> np.ndarray:
    """A fold for each row; every language and label is spread evenly."""
    out, names, at = np.zeros(len(toxic), int), np.array([x or "" for x in langs]), 0
    for label in (0, 1):
        for lang in np.unique(names):
            rows = rng.permutation(np.flatnonzero((names == lang) & (toxic == label)))
            out[rows] = (at + np.arange(len(rows))) % folds
            at += len(rows)
    return out


def _pass(net: Network, ids: np.ndarray, y: float, steps: _Steps, frozen: np.ndarray):
    """One row teaches, unless its judgement is as good as right."""
    logit, traces = _forward(net, ids)
    slope = float(_sigmoid(logit) - y)
    if abs(slope) > 0.02:
        _learn(net, ids, slope, traces, steps, frozen)


def _network(ids: list[np.ndarray], y: np.ndarray, fit: Fit, seen: np.ndarray | None = None) -> tuple[Network, _Steps]:
    net, steps = _start(fit, _seen(fit, ids) if seen is None else seen), _Steps(fit.rate)
    if not 0 < y.sum() < len(y):
        net.weights[:], net.bias = 0, -40.0
        return net, steps
    frozen, rng = ~np.any(net.embedding, axis=1), np.random.default_rng(fit.seed)
    for _ in range(fit.epochs):
        for i in rng.permutation(len(ids)):
            _pass(net, ids[i], y[i], steps, frozen)
    return net, steps


def _calibrate(net: Network, logits: np.ndarray, y: np.ndarray, weights: np.ndarray, langs: list[str | None]) -> Network:
    """Sets the common threshold and those of the languages from judgements, each standing for `weights` rows."""
    fit = net.fit
    net.shift = float(np.log(fit.cut / (1 - fit.cut)) - _best_threshold(logits, y, weights))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        rest = fit.own / (fit.own + (y * weights)[own].sum()) / max((y * weights).sum() / fit.own, 1)
        best = _best_threshold(logits, y, weights * np.where(own, 1.0, rest))
        net.thresholds[lang] = float(_sigmoid(best + net.shift))
    return net


def train(texts: list[str], toxic: list[int], langs: list[str | None], stands: list[float] | None = None, fit: Fit = Fit()) -> Network:
    """Fit on rows in memory; `stands` is how many labelled rows each row stands for in the thresholds."""
    ids = [word_ids(t, fit.buckets) for t in texts]
    y = np.array(toxic, np.float64)
    net, _ = _network(ids, y, fit)
    if not 0 < y.sum() < len(y):
        return net
    fold, logits = _folds(np.random.default_rng(fit.seed), y, langs, fit.folds), np.zeros(len(y))
    for k in range(fit.folds):
        inside, outside = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        judge, _ = _network([ids[i] for i in outside], y[outside], fit)
        logits[inside] = [_forward(judge, ids[i])[0] for i in inside]
    return _calibrate(net, logits, y, np.ones(len(y)) if stands is None else np.array(stands, float), langs)


class _Words:
    """A network to score with, and its filters, biases and weights side by side."""

    def __init__(self, net: Network):
        self.net, self.matrix, self.biases = net, _matrix(net), np.concatenate(net.biases)
        self.weights = np.concatenate(list(net.weights), axis=1)


def _score(words: _Words, text: str) -> float:
    """Long texts go in overlapping pieces whose largest values are pooled again; the result is the same."""
    found, net = WORD.findall(text.lower()), words.net
    step, best = 1 << 14, None
    for at in range(0, max(len(found), 1), step):
        ids, starts = _ids(found[at:at + step + max(WIDTHS) - 1], net.fit.buckets), min(step, max(len(found) - at, 1))
        values = _pool(_values(net, words.matrix, _vectors(net, ids, max(WIDTHS)), starts), net.fit.pooled)[1]
        best = values if best is None else np.sort(np.concatenate([best, values]), axis=0)[::-1][:net.fit.pooled]
    logit = net.bias + float((np.maximum(best + words.biases, 0) * words.weights[:len(best)]).sum())
    return float(_sigmoid(logit + net.shift))


def _score_batches(shared, batches):
    """Scores of a task's texts."""
    words = _Words(shared.value)
    for texts in batches:
        yield pa.array([_score(words, text) for text in texts.to_pylist()], pa.float64())


UNIT = 1 << 24      # moves of parameters are added as whole multiples of 1 / UNIT, so that no order of adding matters
CELL = 256


def _dense(net: Network) -> np.ndarray:
    """All parameters but the embedding, in rows as wide as it."""
    flat = np.concatenate([*[c.ravel() for c in net.convolutions], *net.biases, net.weights.ravel(), [net.bias]])
    return np.pad(flat, (0, -len(flat) % net.fit.dim)).reshape(-1, net.fit.dim)


def _move_dense(net: Network, moved: np.ndarray):
    flat, at = _dense(net).ravel() + moved.ravel(), 0
    for array in (*net.convolutions, *net.biases, net.weights):
        array[...] = flat[at:at + array.size].reshape(array.shape)
        at += array.size
    net.bias = float(flat[at])


def _count_batches(fit: Fit, batches):
    """(fold, bucket, n): texts of a task in which a bucket stands."""
    seen = np.zeros((fit.folds, 2 * fit.buckets), np.int64)
    for batch in batches:
        for fold_, text in zip(*(batch.column(c).to_pylist() for c in ("fold", "text"))):
            seen[fold_][word_ids(text, fit.buckets).ravel()] += 1
    folds, buckets = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(folds.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(seen[folds, buckets])], ["fold", "bucket", "n"])


def _thin(net: Network, steps: _Steps, seen: np.ndarray):
    """A network and its steps by what the sample changed; the rest follows from the seed and the words that count."""
    begun, sums = _start(net.fit, seen).embedding, steps.sums.get("e", np.zeros((1, 1)))
    at = np.flatnonzero(np.any(net.embedding != begun, axis=1) | np.any(sums, axis=1)).astype(np.int32)
    small = copy.copy(steps)
    small.sums = steps.sums | ({"e": sums[at]} if "e" in steps.sums else {})
    return replace(net, embedding=net.embedding[at]), small, at, np.packbits(seen >= net.fit.known)


def _thick(net: Network, steps: _Steps, at: np.ndarray, counts: np.ndarray) -> tuple[Network, _Steps]:
    """What `_thin` was made of, in arrays of their own."""
    embedding = _begun(net, at, counts)
    small, steps = copy.deepcopy(net), copy.deepcopy(steps)
    if "e" in steps.sums:
        sums = np.zeros(embedding.shape, embedding.dtype)
        sums[at] = steps.sums["e"]
        steps.sums["e"] = sums
    return replace(small, embedding=embedding), steps


def _begun(net: Network, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The whole embedding of a network that `_thin` made."""
    embedding = _start(net.fit, np.unpackbits(counts, count=2 * net.fit.buckets).astype(np.int64) * net.fit.known).embedding
    embedding[at] = net.embedding
    return embedding


def _moves(net_at: int, net: Network, start: Network, begun: np.ndarray):
    """How far a network has come from its start, whose whole embedding is `begun`, as (net, at, parts, d0 ...)."""
    moved = np.subtract(net.embedding, begun, out=begun)
    at = np.flatnonzero(np.any(moved, axis=1))
    dense = _dense(net) - _dense(start)
    whole_ = np.concatenate([moved[at], dense]).astype(np.float64)
    at = np.concatenate([at, len(moved) + np.arange(len(dense))])
    for k in range(0, len(at), 4096):
        units = np.rint(whole_[k:k + 4096] * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(units), net_at, np.int32)), pa.array(at[k:k + 4096].astype(np.int32)),
                                          pa.array(np.ones(len(units), np.int64)), *[pa.array(units[:, d]) for d in range(units.shape[1])]],
                                         ["net", "at", "parts", *[f"d{d}" for d in range(units.shape[1])]])


def _learn_batches(shared, batches):
    """(net, at, parts, moved): how far a part's rows move each network's embedding, and behind it the other parameters.

    A row is read once and teaches the networks that do not leave out its fold.
    """
    learners = None
    for batch in batches:
        for text, toxic, fold_ in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
            if learners is None:
                learners = []
                for *thin, left_out in shared.value:
                    net, steps = _thick(*thin)
                    learners.append([net, steps, ~np.any(net.embedding, axis=1), left_out, 0])
            ids = None
            for learner in learners:
                net, steps, frozen, left_out, _ = learner
                if fold_ != left_out:
                    ids = word_ids(text, net.fit.buckets) if ids is None else ids
                    _pass(net, ids, float(toxic), steps, frozen)
                    learner[-1] += 1
    for k, (start, _, at, counts, _) in enumerate(shared.value):
        if learners and learners[k][-1]:
            yield from _moves(k, learners[k][0], start, _begun(start, at, counts))
            learners[k][0] = learners[k][1] = None


def _judge_batches(shared, batches):
    """(lang, toxic, cell): each row judged by the network that learned without its fold."""
    judges = [(net, _matrix(net)) for net in shared.value]
    for batch in batches:
        cells = [round(_forward(judges[fold_][0], word_ids(text, judges[fold_][0].fit.buckets), judges[fold_][1])[0] * CELL)
                 for fold_, text in zip(*(batch.column(c).to_pylist() for c in ("fold", "text")))]
        cells = np.clip(cells, -40 * CELL, 40 * CELL).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(cells)], ["lang", "toxic", "cell"])


def _taught(rows: DataFrame, starts: list[tuple[Network, _Steps, np.ndarray, int | None]], parts: int) -> list[Network]:
    """The networks after all rows but those of the fold each leaves out have passed through, part by part; what the
    parts moved is averaged. A start is a network, its steps, in how many texts each bucket stands, and the fold.

    Rows are dealt and read once for all networks. An embedding's row is averaged over the parts that moved it, so
    that rare words are not diluted.
    """
    fit, spark = starts[0][0].fit, rows.sparkSession
    names = [f"d{d}" for d in range(fit.dim)]
    shared = spark.sparkContext.broadcast([(*_thin(net, steps, seen), left_out) for net, steps, seen, left_out in starts])
    dealt = rows.select("text", "toxic", "fold", "place").repartition(parts, F.pmod("place", F.lit(parts))).sortWithinPartitions("place", "text").drop("place")
    moves = dealt.mapInArrow(partial(_learn_batches, shared), "net int, at int, parts bigint, " + ", ".join(f"{n} bigint" for n in names))
    # For each network at most 2 * buckets rows and those of the other parameters, whatever the number of parts.
    summed = moves.groupBy("net", "at").agg(F.sum("parts").alias("parts"), *[F.sum(n).alias(n) for n in names]).toArrow()
    of, out = summed.column("net").to_numpy(), []
    for k, (start, *_) in enumerate(starts):
        found = summed.filter(pa.array(of == k))
        net, n = copy.deepcopy(start), found.num_rows
        at = found.column("at").to_numpy()
        mean = np.stack([found.column(c).to_numpy() for c in names], axis=1).reshape(n, -1) / UNIT / found.column("parts").to_numpy()[:, None]
        inner = at < len(net.embedding)
        net.embedding[at[inner]] += mean[inner].astype(np.float32)
        dense = np.zeros_like(_dense(net))
        dense[at[~inner] - len(net.embedding)] = mean[~inner]
        _move_dense(net, dense)
        out.append(net)
    shared.unpersist()
    return out


def _usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): labels that are not held out and not contradictory."""
    return (labels.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 3, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
            .where((F.col("toxic") == F.col("most")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic"))


def _fold_of(fit: Fit, doc_id: str = "doc_id"):
    return F.pmod(F.xxhash64(F.lit(fit.seed + 1), doc_id), F.lit(fit.folds)).cast("int")


def teaching(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """text, lang, toxic, fold, place: every document with a usable label, its whole text."""
    # Few labels go to the texts; of texts that meet many by shuffle, those of held-out ids stay behind.
    free = docs.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 3, 1)).select("doc_id", whole("text").alias("text"), "lang")
    rows = free.join(sized(durable(_usable(labels))), "doc_id")
    return rows.select("text", "lang", F.col("toxic").cast("int").alias("toxic"), _fold_of(fit).alias("fold"),
                       F.xxhash64(F.lit(fit.seed + 2), "doc_id").alias("place"))


def sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """doc_id, text, lang, toxic, stands: at most fit.toxic + fit.clean labelled rows by a hash of the id, in turns from every language.

    Column `stands` is how many labelled rows of its language and label a row stands for.
    """
    usable = _usable(labels)
    langs = (docs.where(F.col("doc_id").isNotNull() & (F.octet_length(whole("text")) <= fit.longest)).groupBy("doc_id").agg(F.min("lang").alias("of")))
    usable = durable(usable.join(langs, "doc_id").withColumn("hash", F.xxhash64(F.lit(fit.seed), "doc_id")))
    # First inside parts of a language, then among what is left, so that a language of any size is ranked by many tasks.
    part, most = F.pmod(F.xxhash64("doc_id"), F.lit(64)), F.when(F.col("toxic") == 1, fit.toxic).otherwise(fit.clean)
    first = usable.withColumn("turn", F.row_number().over(Window.partitionBy("of", "toxic", part).orderBy("hash", "doc_id"))).where(F.col("turn") <= most)
    ranked = durable(first.withColumn("turn", F.row_number().over(Window.partitionBy("of", "toxic").orderBy("hash", "doc_id"))).where(F.col("turn") <= most))
    takes = [ranked.where(F.col("toxic") == value).orderBy("turn", "hash", "doc_id").limit(limit) for value, limit in ((1, fit.toxic), (0, fit.clean))]
    chosen = durable(takes[0].union(takes[1]).select("doc_id", "toxic", "of"))
    all_rows, taken = (x.groupBy("toxic", "of").agg(F.count("*").alias(n)) for x, n in ((usable, "n"), (chosen, "m")))
    weight = all_rows.join(taken, (all_rows["toxic"] == taken["toxic"]) & all_rows["of"].eqNullSafe(taken["of"])).select(
        all_rows["toxic"], all_rows["of"], (F.col("n") / F.col("m")).alias("stands"))
    weighted = chosen.join(weight, (chosen["toxic"] == weight["toxic"]) & chosen["of"].eqNullSafe(weight["of"])).select("doc_id", chosen["toxic"], "stands")
    # At most fit.toxic + fit.clean rows of three numbers.
    return docs.select("doc_id", "text", "lang").where(F.octet_length(whole("text")) <= fit.longest).join(F.broadcast(weighted), "doc_id")


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Network:
    """The network for `docs` (doc_id, text, lang) and `labels` (doc_id, toxic); held-out ids are not read."""
    chosen = sample(docs, labels, fit).withColumn("fold", _fold_of(fit))
    order = sorted(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(fit.toxic + fit.clean).collect(), key=lambda r: (r.doc_id, r.toxic, r.text or ""))
    ids, y = [word_ids(r.text or "", fit.buckets) for r in order], np.array([r.toxic for r in order], np.float64)
    if not 0 < y.sum() < len(y):
        return _network(ids, y, fit)[0]
    rows = durable(teaching(docs, labels, fit))
    spark, parts = rows.sparkSession, min(-(-rows.count() // fit.part), fit.parts)
    # At most folds * 2 * buckets rows.
    counts = rows.select("fold", "text").mapInArrow(partial(_count_batches, fit), "fold int, bucket int, n bigint").groupBy("fold", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen, folds = np.zeros((fit.folds, 2 * fit.buckets), np.int64), np.array([r.fold for r in order])
    seen[counts.column("fold").to_numpy(), counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    starts = []
    for k in range(fit.folds):
        outside, stand = np.flatnonzero(folds != k), seen.sum(0) - seen[k]
        starts.append((*_network([ids[i] for i in outside], y[outside], fit, stand), stand, k))
    *judges, net = _taught(rows, [*starts, (*_network(ids, y, fit, seen.sum(0)), seen.sum(0), None)], parts)
    # For each language and label at most as many rows as there are cells.
    judged = rows.select("fold", "text", "lang", "toxic").mapInArrow(partial(_judge_batches, spark.sparkContext.broadcast(judges)), "lang string, toxic int, cell int")
    cells = judged.groupBy("lang", "toxic", "cell").count().orderBy("lang", "toxic", "cell").collect()
    return _calibrate(net, np.array([r["cell"] / CELL for r in cells]), np.array([r["toxic"] for r in cells], float),
                      np.array([r["count"] for r in cells], float), [r["lang"] for r in cells])


def _scores(spark, net: Network):
    """An Arrow function from a text column to its score; the network goes to all tasks.

    Its size is that of a fixed number of buckets, whatever the data.
    """
    return F.arrow_udf(partial(_score_batches, spark.sparkContext.broadcast(net)), "double", F.ArrowUDFType.SCALAR_ITER)


def _threshold(net: Network, lang: Column) -> Column:
    """The threshold of a row's language, else the common one."""
    threshold = F.lit(net.fit.cut)
    for name, value in sorted(net.thresholds.items()):
        threshold = F.when(lang == name, value).otherwise(threshold)
    return threshold


def classify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, flagged for every row of `docs`.

    `predicted` uses the common threshold, `flagged` the one of the row's language.
    """
    scored = docs.select("doc_id", "lang", _scores(docs.sparkSession, net)(whole("text")).alias("score"))
    return (scored.withColumn("threshold", _threshold(net, F.col("lang")))
            .select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score",
                    (F.col("score") >= net.fit.cut).cast("int").alias("predicted"), "threshold",
                    (F.col("score") >= F.col("threshold")).alias("flagged")))


def clean(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of `docs` that are below the threshold of their language, with their columns as they were."""
    scores = _scores(docs.sparkSession, net)(whole(docs["text"]))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), scores.alias("score"))
    return rows.where(F.col("score") < _threshold(net, F.col("doc.lang"))).select("doc.*")
