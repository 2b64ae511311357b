"""Near-duplicate vectors by collision counting on one-dimensional projections.

Vectors of a label are compared by cosine. Equal vectors are one representative with a number of
copies. Representatives are dealt into overlapping cells: in each of several rounds a cell is the
grid cell of a few random projections, fine enough that cells stay small whatever the label's size,
with as many rounds as it takes for a pair at the threshold to share a cell in one of them. Inside a
cell many one-dimensional projections are sorted; around each vector's value lies a window, and the
vectors in it collide with the one in its centre. Pairs that collide in at least as many projections
as a pair at the threshold does with probability `recall` are verified in double precision.
A pair is counted in the first round in which it shares a cell, so links need no shuffle of pairs.

Defined cases: a null label, and vectors that are null, zero, or hold null or non-finite components,
link with nothing; vectors of different lengths never link; repeated rows are copies; components take
the smallest non-null vec_id.
"""
import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import sized
from lograil.llm.components import components
from lograil.session import durable


@dataclass(frozen=True)
class Search:
    least: float = 0.93     # cosine of a link
    recall: float = 0.985   # wanted of cells, and again of the collision count, at exactly that cosine
    cell: int = 512         # representatives an average cell should hold
    block: int = 1024       # larger cells are compared block by block in tasks of their own
    width: float = 3.0      # of a grid cell
    window: float = 0.5     # half width of a collision window
    projections: int = 24
    seed: int = 20

    @property
    def distance(self) -> float:
        """Between unit vectors at the threshold; a projection's difference has this deviation."""
        return math.sqrt(2 - 2 * self.least)

    def grid(self, n: int) -> tuple[int, int]:
        """Projections of a cell, and rounds, for a label of n representatives."""
        share = lambda d: 1 - min(1.0, d * math.sqrt(2 / math.pi) / self.width)
        depth = max(0, math.ceil(math.log(max(n, 1) / self.cell) / -math.log(share(math.sqrt(2)))))
        near = share(self.distance) ** depth
        return depth, 1 if near == 1 else math.ceil(math.log(1 - self.recall) / math.log(1 - near))

    def count(self) -> int:
        """The largest count that a pair at the threshold reaches with probability `recall`."""
        p, m = math.erf(self.window / self.distance / math.sqrt(2)), self.projections
        tail = 0.0
        for t in range(m, -1, -1):
            tail += math.comb(m, t) * p ** t * (1 - p) ** (m - t)
            if tail >= self.recall:
                return t
        return 0

    def directions(self, dim: int, number: int, salt: int) -> np.ndarray:
        return np.random.default_rng([self.seed, dim, salt]).standard_normal((dim, number))


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; powers of two first, so that no square overflows."""
    scaled = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array([np.frombuffer(x, "<f8") for x in column.to_pylist()]).reshape(-1, dim)


CELLS = "cell binary, rnd int, rid bigint, copies bigint, vec binary, grid binary"


def _cells(search: Search, depth: int, rounds: int, batches):
    """For each representative and round its cell; `grid` holds its coordinates in all rounds."""
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        out = []
        for rid, copies, label, vector in zip(*columns):
            raw = np.array(vector, "<f8")
            place = np.empty((rounds, depth), "<i2")
            if depth:
                spread = unit(raw[None, :])[0] @ search.directions(len(raw), rounds * depth, 1)
                shift = np.random.default_rng([search.seed, 2]).random(rounds * depth)
                place[:] = np.floor(spread / search.width + shift).reshape(rounds, depth)
            head = f"{label}/{len(raw)}/".encode()
            out += [(head + r.to_bytes(4, "little") + place[r].tobytes(), r, rid, copies, raw.tobytes(), place.tobytes()) for r in range(rounds)]
        if out:
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["cell", "rnd", "rid", "copies", "vec", "grid"])


def collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """How many projections put each of `right` into the window around each of `left`; (left, right)."""
    n, m = len(left), len(right)
    counts = np.zeros(n * m, np.int64)
    for j in range(left.shape[1]):
        order = np.argsort(right[:, j], kind="stable")
        values = right[order, j]
        low, high = np.searchsorted(values, left[:, j] - window), np.searchsorted(values, left[:, j] + window, "right")
        size = high - low
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        counts += np.bincount(np.repeat(np.arange(n) * m, size) + order[np.repeat(low, size) + within], minlength=n * m)
    return counts.reshape(n, m)


def _compare(search: Search, rows: dict, first: np.ndarray, second: np.ndarray, same: bool):
    """Index pairs of a unit's rows that are linked and meet here for the first time."""
    u, p, grid, rnd = rows["unit"], rows["proj"], rows["grid"], rows["rnd"]
    i, j = np.nonzero(collisions(p[first], p[second], search.window) >= search.count())
    if same:
        i, j = i[i < j], j[i < j]
    i, j = first[i], second[j]
    linked = np.einsum("ij,ij->i", u[i], u[j]) >= search.least
    i, j = i[linked], j[linked]
    if rnd:
        fresh = ~np.any(np.all(grid[i, :rnd] == grid[j, :rnd], axis=2), axis=1)
        i, j = i[fresh], j[fresh]
    return i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n by the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _unit_rows(search: Search, depth: int, rounds: int, block: list[tuple]):
    rids, copies = np.array([r[2] for r in block]), np.array([r[3] for r in block])
    sides, rnd = np.array([r[1] for r in block]), block[0][6]
    raw = np.array([np.frombuffer(r[4], "<f8") for r in block])
    u = unit(raw)
    rows = {"unit": u, "proj": u @ search.directions(u.shape[1], search.projections, 3), "rnd": rnd,
            "grid": np.array([np.frombuffer(r[5], "<i2") for r in block]).reshape(len(block), rounds, depth)}
    if sides.any():
        i, j = _compare(search, rows, np.flatnonzero(sides == 0), np.flatnonzero(sides == 1), False)
    else:
        all_rows = np.arange(len(block))
        i, j = _compare(search, rows, all_rows, all_rows, True)
    if not len(i):
        return
    found = np.bincount(i, copies[j], len(block)) + np.bincount(j, copies[i], len(block))
    root = _forest(len(block), i, j)
    linked = np.flatnonzero(found)
    yield pa.record_batch([pa.array(rids[linked]), pa.array(rids[root[linked]]), pa.array(found[linked].astype(np.int64))], ["a", "b", "links"])


def _units(search: Search, depth: int, rounds: int, batches):
    """Rows arrive sorted by unit; one unit at a time is held, at most two blocks of rows."""
    held, current = [], None
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[0] != current:
                if len(held) > 1:
                    yield from _unit_rows(search, depth, rounds, held)
                held, current = [], row[0]
            held.append(row)
    if len(held) > 1:
        yield from _unit_rows(search, depth, rounds, held)


def near_vectors(vectors: DataFrame, search: Search = Search()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label)."""
    inf = F.lit(float("inf"))
    finite = F.forall("embedding", lambda x: F.coalesce((F.abs(x) < inf) & ~F.isnan(x), F.lit(False)))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", F.when(usable, F.col("label").cast("string")).alias("label"), F.when(usable, F.col("embedding")).alias("embedding"))
    classes = durable(rows.where(F.col("label").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("smallest"), F.count("*").alias("copies"))
                      .withColumn("rid", F.monotonically_increasing_id()))
    largest = classes.groupBy("label", F.size("embedding")).count().agg(F.max("count")).first()[0] or 0
    depth, rounds = search.grid(largest)
    cells = durable(classes.select("rid", "copies", "label", "embedding").mapInArrow(partial(_cells, search, depth, rounds), CELLS))
    links = durable(_linked(cells, search, depth, rounds))
    found = components(links.select("a", "b"))
    named = classes.join(found, classes["rid"] == found["node"], "left").withColumn("component", F.coalesce("component", "rid"))
    names = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    counts = links.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    result = durable(named.join(names, "component").join(counts, "rid", "left")
                     .select("label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return rows.join(result, ["label", "embedding"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))


def _linked(cells: DataFrame, search: Search, depth: int, rounds: int) -> DataFrame:
    """(a, b, links): a's newly found links, and the smallest of the unit that a is linked with."""
    large = durable(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > search.block)
                    .select("cell", F.ceil(F.col("n") / search.block).cast("int").alias("blocks")))
    joined = cells.join(sized(large), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(
        F.least(own, other).alias("low"), F.greatest(own, other).alias("high"), (own > other).cast("int").alias("side")))
    dealt = joined.withColumn("pair", F.explode(pairs)).select(
        F.concat("cell", F.encode(F.concat_ws(",", F.lit(""), "pair.low", "pair.high"), "utf-8")).alias("unit"),
        F.col("pair.side").alias("side"), "rid", "copies", "vec", "grid", "rnd")
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(n, "unit").sortWithinPartitions("unit")
            .mapInArrow(partial(_units, search, depth, rounds), "a bigint, b bigint, links bigint"))
