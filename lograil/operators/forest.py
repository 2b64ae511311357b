"""Isolation forest over feature windows: trees are grown and applied by Spark tasks.

The model is a table of nodes, numbered as in a heap. Trees see samples drawn by a hash of (seed, row key),
and every split is drawn by a hash of (seed, tree, node), so neither partitioning, row order nor a repeated
task can change a fitted model, and any engine draws the same. Vectors are compared at six decimals, for
logarithms differ in the last places between platforms.
"""
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lograil.operators.features import WIDTH

TREES, SAMPLE = 200, 256
NODES = 2_000_000
MINIMUM_WINDOWS = 20
NODE = "tree_id int, node_id int, feature int, split double, left int, right int, size int"


def usable(windows: DataFrame) -> DataFrame:
    """Established, closed windows: the only ones fitted or scored."""
    return windows.where(~F.col("cold_start") & ~F.col("provisional"))


def check_baseline(training: DataFrame, calibration: DataFrame) -> DataFrame:
    """One row of admission facts about two window tables.

    Each side needs twenty usable windows, and training must close before
    calibration opens.
    """
    sides = [usable(side).agg(F.count("*").alias(f"{name}_windows")) for name, side in
             (("training", training), ("calibration", calibration))]
    closes = training.agg(F.max("window_us") + F.lit(WIDTH))
    opens = calibration.agg(F.min("window_us"))
    row = sides[0].withColumn("calibration_windows", sides[1].scalar()).withColumn("closes", closes.scalar()).withColumn("opens", opens.scalar())
    return row.withColumn("error", F.coalesce(
        F.when(F.col("closes").isNull() | F.col("opens").isNull(), "training and calibration both need events"),
        F.when(F.col("closes") > F.col("opens"), "the last training window must close before calibration opens"),
        F.when((F.col("training_windows") < MINIMUM_WINDOWS) | (F.col("calibration_windows") < MINIMUM_WINDOWS),
               "fewer than twenty usable windows on one side")))


def check_later(events: DataFrame, cutoff: Column, calibration_end: Column) -> DataFrame:
    """One row: a baseline may only score what lies after its own calibration data."""
    early = F.count_if((F.col("event_time") <= cutoff) & (F.col("event_time") < calibration_end))
    return events.agg(early.alias("early_events")).withColumn("error", F.when(
        (F.col("early_events") > 0) | (cutoff < calibration_end),
        "a baseline scores only what lies after its calibration"))


def tree_samples(windows: DataFrame, keys: list[str], trees: int = TREES, seed: int = 17, sample: int = SAMPLE) -> DataFrame:
    """(tree_id, _rank, vector): exactly `sample` usable windows for each tree, or all if there are fewer.

    One pool of at most trees x sample windows has the smallest hashes of (seed, key). It stands in a
    ring ordered by hash; each tree takes the next `sample` places. Trees share windows only where the
    ring is shorter than all samples together.
    """
    drawn = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    pool = usable(windows).select(*keys, _compared("vector").alias("vector"), drawn.alias("draw")).orderBy("draw", *keys).limit(trees * sample)
    # At most trees x sample rows meet in these windows.
    place, everything = F.row_number().over(Window.orderBy("draw", *keys)) - 1, Window.partitionBy()
    ring = pool.select("vector", place.cast("bigint").alias("place"), F.count("*").over(everything).alias("n"))
    # Tree t takes the ring's places from t * sample on; a place k rounds further is place + k * n.
    own = F.transform(F.sequence(F.lit(0), F.floor((F.lit(trees * sample - 1) - F.col("place")) / F.col("n"))), lambda k: F.col("place") + k * F.col("n"))
    own = F.transform(own, lambda at: F.struct(F.floor(at / sample).cast("int").alias("tree_id"), (at % sample).cast("int").alias("_rank")))
    # A ring shorter than one sample goes whole to every tree.
    whole = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.cast("int").alias("tree_id"), F.pmod(F.col("place") - t * sample, F.col("n")).cast("int").alias("_rank")))
    return ring.select("vector", F.inline(F.when(F.col("n") < sample, whole).otherwise(own))).select("tree_id", "_rank", "vector")


def _drawn(seed: int, tree: int, node: int, what: str) -> int:
    """48 bits for a draw at a node."""
    return int(hashlib.md5(f"{seed}|{tree}|{node}|{what}".encode()).hexdigest()[:12], 16)


def _grow(seed: int):
    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree_id"].iloc[0])
        data = np.stack(sample.sort_values("_rank")["vector"].to_numpy())
        limit = math.ceil(math.log2(max(len(data), 2)))
        nodes, waiting = [], [(0, data, 0)]
        while waiting:
            node, part, depth = waiting.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            spread = np.flatnonzero(high > low) if depth < limit and len(part) > 1 else ()
            if len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(part)))
                continue
            feature = int(spread[_drawn(seed, tree, node, "feature") % len(spread)])
            split = float(low[feature]) + _drawn(seed, tree, node, "split") / 2 ** 48 * (float(high[feature]) - float(low[feature]))
            if split >= high[feature]:  # a draw at the upper end would not separate anything
                split = float(low[feature])
            goes_left = part[:, feature] <= split
            left, right = 2 * node + 1, 2 * node + 2
            nodes.append((tree, node, feature, split, left, right, len(part)))
            waiting += [(left, part[goes_left], depth + 1), (right, part[~goes_left], depth + 1)]
        return pd.DataFrame(nodes, columns=["tree_id", "node_id", "feature", "split", "left", "right", "size"])
    return grow


def _compared(vector: str) -> Column:
    return F.transform(vector, lambda x: F.round(x, 6))


def fit_forest(windows: DataFrame, keys: list[str], trees: int = TREES, seed: int = 17, sample: int = SAMPLE) -> DataFrame:
    """Model table; each tree is grown from its sample of at most `sample` rows in one task.

    The samples are small but growing is not, so the trees are spread over the cores
    instead of being packed by size.
    """
    parts = min(trees, windows.sparkSession.sparkContext.defaultParallelism)
    samples = tree_samples(windows, keys, trees, seed, sample).repartition(parts, "tree_id")
    return samples.groupBy("tree_id").applyInPandas(_grow(seed), NODE)


def expected_depth(size):
    """Mean path length of an unsuccessful search among `size` points."""
    size = np.asarray(size, dtype=float)
    harmonic = np.log(np.maximum(size - 1, 1)) + np.euler_gamma
    return np.where(size > 2, 2 * harmonic - 2 * (size - 1) / np.maximum(size, 1), np.where(size == 2, 1.0, 0.0))


def _flat(tree: pd.DataFrame):
    """Arrays of one tree in which a leaf leads to itself, so all rows take equally many steps."""
    node, feature, split = (tree[c].to_numpy() for c in ("node_id", "feature", "split"))
    own, leaf = np.arange(len(tree)), feature < 0
    left, right = (np.where(leaf, own, np.searchsorted(node, tree[c].to_numpy())) for c in ("left", "right"))
    depth = np.floor(np.log2(node + 1))     # of a heap's node
    path = depth + expected_depth(tree["size"].to_numpy())
    return (np.where(leaf, 0, feature).astype(np.int32), split, left.astype(np.int32), right.astype(np.int32), path, int(depth.max()))


def score_forest(windows: DataFrame, model: DataFrame) -> DataFrame:
    """Add raw_anomaly_score in (0, 1]; null for cold-start and provisional windows.

    The model is shipped to the tasks: a forest has at most trees x (2 x sample - 1) nodes whatever
    the data size. A table with more than NODES rows is refused.
    """
    if model.count() > NODES:
        raise ValueError(f"a model of more than {NODES} nodes is not shipped to tasks")
    frame = model.toPandas().sort_values(["tree_id", "node_id"])
    forest = [_flat(tree) for _, tree in frame.groupby("tree_id")]
    shared = windows.sparkSession.sparkContext.broadcast(forest)
    base = float(expected_depth(max(int(tree["size"].iloc[0]) for _, tree in frame.groupby("tree_id"))))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trees = shared.value
        for batch in batches:
            data = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            row, total = np.arange(len(data)), np.zeros(len(data))
            for feature, split, left, right, path, levels in trees:
                at = np.zeros(len(data), dtype=np.int32)
                for _ in range(levels):
                    at = np.where(data[row, feature[at]] <= split[at], left[at], right[at])
                total += path[at]
            yield pd.Series(np.power(2.0, -total / len(trees) / base))

    scored = F.pandas_udf(score, DoubleType())
    ready = usable(windows).withColumn("raw_anomaly_score", scored(_compared("vector")))
    rest = windows.where(F.col("cold_start") | F.col("provisional"))
    return ready.unionByName(rest.withColumn("raw_anomaly_score", F.lit(None).cast("double")))
