"""Quality by compression: zstandard dictionaries of good and of bad text, and which of them shortens a text more.

A text is cut into blocks, so that a dictionary matters throughout a long one, and every block is
compressed with either dictionary. The sum of the differences in size, over the bytes of the text, is its
`difference`; a logistic curve fitted to labelled rows turns it into the probability of label 1.

The labelled documents are split by a hash of the id. One part gives the dictionaries: of each label a
bounded sample of documents (`Fit.documents`) and of those, anywhere in their texts, a bounded sample of
distinct blocks (`Fit.blocks`), both chosen by hashes. The other part gives the curve: differences are
worked out for all documents in one pass, met with the labels by id, and only counts of each label in
steps of the difference reach the driver, at most 2 * `Fit.steps` + 1 rows.

No text is shuffled. Defined cases: null and empty texts have difference 0; a null id
has no label; documents with contradictory labels or labels other than 0 and 1 teach nothing, repeated labels
count once; equal rows are all used; with too few blocks to train on, a dictionary holds the blocks as they are;
without labels every score is one half.
"""
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import fold, whole
from lograil.session import durable


@dataclass(frozen=True)
class Fit:
    """Settings; the driver holds at most 2 * blocks * block bytes of text at any corpus size."""
    block: int = 1024       # bytes compressed at once
    documents: int = 4000   # of each label, from which blocks are taken
    blocks: int = 4000      # of each label
    dictionary: int = 112_640
    level: int = 3
    steps: int = 2000       # of the difference, from 0 to 1
    ridge: float = 1e-3     # holds the curve where labels are few or separate wholly
    cut: float = 0.3
    seed: int = 5


@dataclass(frozen=True)
class Curve:
    slope: float = 0.0
    offset: float = 0.0

    def __call__(self, difference):
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -40, 40)))


@dataclass(frozen=True)
class Model:
    fit: Fit
    dictionaries: tuple[bytes, bytes]   # of bad and of good text
    curve: Curve = Curve()


def dictionary(blocks: list[bytes], fit: Fit) -> bytes:
    """A trained dictionary, or the blocks themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(fit.dictionary, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-fit.dictionary:]


class Differences:
    """Normalised difference of a text's compressed sizes; positive if the good dictionary shortens it more."""

    def __init__(self, model: Model):
        self.block = model.fit.block
        self.compress = []
        for data in model.dictionaries:
            given = zstandard.ZstdCompressionDict(data) if data else None
            if given:
                given.precompute_compress(level=model.fit.level)
            self.compress.append(zstandard.ZstdCompressor(level=model.fit.level, dict_data=given, write_content_size=False,
                                                          write_dict_id=False, write_checksum=False).compress)

    def __call__(self, text: bytes) -> float:
        bad, good = self.compress
        total = 0
        for at in range(0, len(text), self.block):
            part = text[at:at + self.block]
            total += len(bad(part)) - len(good(part))
        return total / len(text) if text else 0.0


def _difference_batches(shared, batches):
    differences = Differences(shared.value)
    for texts in batches:
        yield pa.array([differences(text) for text in texts.to_pylist()], pa.float64())


def _differences(spark, model: Model):
    """An Arrow function from a column of bytes; the dictionaries, of fixed size, go to all tasks."""
    return F.arrow_udf(partial(_difference_batches, spark.sparkContext.broadcast(model)), "double", F.ArrowUDFType.SCALAR_ITER)


def _text(column="text"):
    return whole(column).cast("binary")


def calibrated(differences: np.ndarray, good: np.ndarray, bad: np.ndarray, ridge: float) -> Curve:
    """The logistic curve of largest likelihood for counts of either label at each difference.

    Each label is given one more row spread over the other, so that a curve exists for any counts. The
    slope is never negative: a larger difference is never a sign of worse text.
    """
    if not good.sum() + bad.sum():
        return Curve()
    weight = (good + bad).astype(float)
    high, low = (good.sum() + 1) / (good.sum() + 2), 1 / (bad.sum() + 2)
    aim = (good * high + bad * low) / weight
    scale = max(float(np.sqrt((weight * differences ** 2).sum() / weight.sum())), 1e-6)
    x = np.stack([differences / scale, np.ones_like(differences)], axis=1)
    theta = np.array([0.0, np.log((good.sum() + 1) / (bad.sum() + 1))])
    hold = np.array([ridge * weight.sum(), 1e-9])

    def loss(t):
        z = x @ t
        return float((weight * (np.logaddexp(0, z) - aim * z)).sum() + (hold * t ** 2).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (weight * (p - aim)) + hold * theta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-9)
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    if theta[0] < 0:
        return Curve(0.0, float(np.log((good.sum() + 1) / (bad.sum() + 1))))
    return Curve(float(theta[0] / scale), float(theta[1]))


def _usable(labels: DataFrame, fit: Fit) -> DataFrame:
    """doc_id, good, builds: the usable labels, and whether they belong to the dictionaries' part; stored."""
    found = (labels.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 5, 0)).groupBy("doc_id")
             .agg(F.min("quality").alias("good"), F.max("quality").alias("most")).where((F.col("good") == F.col("most")) & F.col("good").isin(0, 1)))
    builds = F.xxhash64(F.lit(fit.seed), "doc_id").bitwiseAND(F.lit(1)) == 0
    return durable(found.select("doc_id", F.col("good").cast("int").alias("good"), builds.alias("builds")))


def _sampled(docs: DataFrame, usable: DataFrame, fit: Fit) -> dict[int, list[bytes]]:
    """About fit.blocks distinct blocks of each label, never more; in an order that depends on them alone."""
    by_hash = [F.xxhash64(F.lit(fit.seed + 1), "doc_id"), "doc_id"]
    parts = [usable.where(F.col("builds") & (F.col("good") == good)).orderBy(*by_hash).limit(fit.documents) for good in (0, 1)]
    chosen = F.broadcast(durable(parts[0].union(parts[1]).select("doc_id", "good")))    # at most 2 * fit.documents ids
    rows = docs.select("doc_id", _text().alias("data")).join(chosen, "doc_id").select("good", "data")
    size = F.octet_length("data")
    totals = {r.good: r.n or 0 for r in rows.groupBy("good").agg(F.sum(F.ceil(size / fit.block)).alias("n")).collect()}
    shares = {good: min(fit.blocks / max(totals.get(good, 0), 1), 1.0) for good in (0, 1)}
    starts = F.explode(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), F.lit(fit.block)))
    blocks = rows.select("good", "data", starts.alias("at")).select("good", F.expr(f"substring(data, at, {fit.block})").alias("block"))
    order = F.xxhash64(F.lit(fit.seed), "block")
    below = F.pmod(order, F.lit(1 << 30)) < F.when(F.col("good") == 1, int(shares[1] * (1 << 30))).otherwise(int(shares[0] * (1 << 30)))
    found = durable(blocks.where((F.octet_length("block") > 0) & below).distinct())
    return {good: sorted(bytes(r.block) for r in found.where(F.col("good") == good).orderBy(order, "block").limit(fit.blocks).collect()) for good in (0, 1)}


def dictionaries(docs: DataFrame, usable: DataFrame, fit: Fit) -> Model:
    """A model without a curve yet, its dictionaries built from labelled rows of `docs` (doc_id, text)."""
    blocks, rng = _sampled(docs, usable, fit), np.random.default_rng(fit.seed)
    return Model(fit, tuple(dictionary([blocks[label][i] for i in rng.permutation(len(blocks[label]))], fit) for label in (0, 1)))


def differences(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, difference for every row of `docs` (doc_id, text)."""
    return docs.select("doc_id", _differences(docs.sparkSession, model)(_text()).alias("difference"))


def _curve(found: DataFrame, usable: DataFrame, fit: Fit) -> Curve:
    """From the differences of the labelled rows that built no dictionary."""
    step = F.greatest(F.lit(-fit.steps), F.least(F.lit(fit.steps), F.round(F.col("difference") * fit.steps))).cast("int")
    rows = found.join(usable.where(~F.col("builds")), "doc_id").groupBy(step.alias("step")).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    columns = np.array([[r.step, r.good, r.bad] for r in rows.orderBy("step").collect()], float).reshape(-1, 3)
    return calibrated(columns[:, 0] / fit.steps, columns[:, 1], columns[:, 2], fit.ridge)


def scored(found: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, difference from doc_id and difference."""
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("difference") * model.curve.slope + model.curve.offset))
    return found.withColumn("score", 1 / (1 + F.exp(-z))).select(
        "doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= model.fit.cut).cast("int").alias("predicted"), "difference")


def fitted(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> tuple[Model, DataFrame]:
    """The model for `docs` (doc_id, text) and `labels` (doc_id, quality), and the stored differences of all docs.

    Labels of held-out ids are not read.
    """
    usable = _usable(labels, fit)
    model = dictionaries(docs, usable, fit)
    found = durable(differences(docs, model))
    return Model(fit, model.dictionaries, _curve(found, usable, fit)), found


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, difference for every row of `docs` (doc_id, text)."""
    return scored(differences(docs, model), model)


def quality_scores(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """The same by a model of the labelled rows of `docs` themselves."""
    model, found = fitted(docs, labels, fit)
    return scored(found, model)
