"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text is cut into chunks of bytes; a chunk's fingerprint is its polynomial over two primes. The
fingerprint of a whole is the sum of its chunks' fingerprints, each shifted by the number of bytes
behind it, so the chunks of a huge document are hashed by any number of tasks in any order. Texts of
equal length and fingerprint are then compared with their group's representative chunk by chunk; if
even one differs, the whole group is told apart by its texts.

Defined cases: a null text counts as empty; every row gets a row. Of equal texts the row with the
largest doc_id stays, null being smaller than any; of rows that also share that id exactly one stays.
Other columns, whatever their names, are neither read nor changed.
"""
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import same, sized, whole
from lograil.session import durable

KEY = ("n_bytes", "h1", "h2")


@dataclass(frozen=True)
class Polynomial:
    """Primes below 2**31, a base for each, and the bytes in a chunk.

    255 * 2**31 * chunk stays below 2**63, so a chunk's sum is exact in 64-bit integers.
    Documents above `huge` bytes are hashed by chunk rows dealt out over all tasks.
    """
    primes: tuple[int, int] = (2_147_483_647, 2_147_483_629)
    bases: tuple[int, int] = (1_103_515_245, 69_069_069)
    chunk: int = 1 << 16
    huge: int = 8 << 20

    def powers(self) -> list[np.ndarray]:
        """For each prime, base**(chunk - 1) ... base**0."""
        out = []
        for p, r in zip(self.primes, self.bases):
            power, row = 1, np.empty(self.chunk, np.int64)
            for i in range(self.chunk - 1, -1, -1):
                row[i] = power
                power = power * r % p
            out.append(row)
        return out

    def of_chunk(self, data: np.ndarray, powers: list[np.ndarray]) -> tuple[int, ...]:
        wide = data.astype(np.int64)
        return tuple(int(wide @ row[self.chunk - len(data):]) % p for p, row in zip(self.primes, powers))

    def shifted(self, value: tuple[int, ...], behind: int) -> tuple[int, ...]:
        """The fingerprint of the same bytes with `behind` zero bytes after them."""
        return tuple(h * pow(r, behind, p) % p for h, r, p in zip(value, self.bases, self.primes))

    def of_text(self, data: bytes, powers: list[np.ndarray]) -> tuple[int, ...]:
        buffer, total = np.frombuffer(data, np.uint8), [0, 0]
        for at in range(0, len(buffer), self.chunk):
            part = buffer[at:at + self.chunk]
            shifted = self.shifted(self.of_chunk(part, powers), len(buffer) - at - len(part))
            total = [(t + s) % p for t, s, p in zip(total, shifted, self.primes)]
        return tuple(total)


_POWERS: dict[Polynomial, list[np.ndarray]] = {}


def _powers(poly: Polynomial) -> list[np.ndarray]:
    if poly not in _POWERS:
        _POWERS[poly] = poly.powers()
    return _POWERS[poly]


def _pairs(values: list[tuple[int, ...]]) -> pa.Array:
    columns = np.array(values, np.int64).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], ["h1", "h2"])


def _hash_udf(poly: Polynomial):
    @F.arrow_udf("struct<h1:bigint,h2:bigint>")
    def hashed(text: pa.Array) -> pa.Array:
        return _pairs([poly.of_text(x, _powers(poly)) for x in text.to_pylist()])
    return hashed


def _chunk_udf(poly: Polynomial):
    @F.arrow_udf("struct<h1:bigint,h2:bigint>")
    def hashed(chunk: pa.Array, behind: pa.Array) -> pa.Array:
        return _pairs([poly.shifted(poly.of_chunk(np.frombuffer(x, np.uint8), _powers(poly)), n)
                       for x, n in zip(chunk.to_pylist(), behind.to_pylist())])
    return hashed


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """A row for each chunk of the binary column `data`: at, piece; an empty text has one empty chunk."""
    last = F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / chunk)
    return (rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
            .withColumn("piece", F.substring("data", (F.col("at") * chunk + 1).cast("int"), F.lit(chunk))).drop("data"))


def fingerprints(docs: DataFrame, poly: Polynomial = Polynomial()) -> DataFrame:
    """row, doc_id, n_bytes, h1, h2, sha for each document; stored, since `row` must not change.

    sha is the SHA-256 of the text; with the doc_id it leads back to the document, it groups nothing.
    """
    text = whole("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.cast("binary").alias("data"),
                       F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    short = (rows.where(F.col("n_bytes") <= poly.huge).withColumn("h", _hash_udf(poly)("data"))
             .select("row", "doc_id", "n_bytes", "h.h1", "h.h2", "sha"))
    pieces = _chunks(rows.where(F.col("n_bytes") > poly.huge), poly.chunk).repartition("row", "at")
    behind = F.greatest(F.col("n_bytes") - (F.col("at") + 1) * poly.chunk, F.lit(0))
    long = (pieces.withColumn("h", _chunk_udf(poly)("piece", behind)).groupBy("row", "doc_id", "n_bytes", "sha")
            .agg((F.sum("h.h1") % poly.primes[0]).alias("h1"), (F.sum("h.h2") % poly.primes[1]).alias("h2"))
            .select("row", "doc_id", "n_bytes", "h1", "h2", "sha"))
    return durable(short.union(long))


def _members(docs: DataFrame, prints: DataFrame, groups: DataFrame, chunk: int) -> DataFrame:
    """Documents of the given groups with their group's columns and text bytes."""
    keys = durable(prints.join(sized(groups), list(KEY)).groupBy("doc_id", "sha", *KEY)
                   .agg(F.first("top").alias("top")))
    texts = docs.select("doc_id", F.sha2(whole("text"), 256).alias("sha"), whole("text").cast("binary").alias("data"))
    build = sized(keys)
    return texts.join(build, same(texts, build, "doc_id", "sha")).select(build["doc_id"], *KEY, "top", "data")


def _differing(docs: DataFrame, prints: DataFrame, groups: DataFrame, chunk: int) -> DataFrame:
    """Keys of groups in which some text differs from the representative's."""
    pieces = _chunks(_members(docs, prints, groups, chunk), chunk)
    # Stored, so that both sides of the join come from plain exchanges and a hot group can be split.
    first = durable(pieces.where(F.col("doc_id").eqNullSafe(F.col("top.doc_id"))).groupBy(*KEY, "at")
                    .agg(F.first("piece").alias("model")))
    return (pieces.join(first, [*KEY, "at"], "left")
            .groupBy(*KEY).agg(F.bool_and(F.col("piece").eqNullSafe(F.col("model"))).alias("equal"))
            .where(~F.col("equal")).select(*KEY))


def exact_duplicates(docs: DataFrame, poly: Polynomial = Polynomial()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs` (doc_id, text)."""
    prints = fingerprints(docs, poly)
    groups = durable(prints.groupBy(*KEY).agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("size"))
                     .where(F.col("size") > 1))
    mixed = durable(_differing(docs, prints, groups, poly.chunk))
    decided = _decided(prints, groups, mixed)
    if mixed.isEmpty():
        return decided
    return decided.union(_by_text(docs, prints, groups.join(mixed, list(KEY)), poly.chunk))


def _decided(prints: DataFrame, groups: DataFrame, mixed: DataFrame) -> DataFrame:
    named = sized(groups)
    rows = prints.join(sized(mixed), list(KEY), "left_anti")
    return (rows.join(named, list(KEY), "left")
            .select("doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
                    F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
                    F.coalesce(F.col("top.row") == F.col("row"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256")))


def _by_text(docs: DataFrame, prints: DataFrame, groups: DataFrame, chunk: int) -> DataFrame:
    """Rows of groups whose fingerprint is shared by different texts, grouped by the texts themselves."""
    rows = durable(_members(docs, prints, groups, chunk).select("doc_id", "data", F.monotonically_increasing_id().alias("row")))
    texts = rows.groupBy("data").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("size"))
    return rows.join(texts, "data").select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("size").alias("group_size"),
                                           (F.col("top.row") == F.col("row")).alias("kept"), F.sha2("data", 256).alias("text_sha256"))


def keep_decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of `docs` that `decisions` (doc_id, text_sha256, kept; a row for each of theirs) keeps.

    A document is found again by its id and text. Where only some of the rows that share both stay,
    one of them does. Columns of `docs` come back as they were, whatever their names.
    """
    changed = durable(decisions.groupBy("doc_id", "text_sha256")
                      .agg(F.count("*").alias("n"), F.count_if("kept").alias("stay")).where(F.col("stay") < F.col("n")))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs["doc_id"],
                        F.sha2(whole(docs["text"]), 256).alias("text_sha256"))
    build = sized(changed)
    joined = keyed.join(build, same(keyed, build, "doc_id", "text_sha256"), "left").select(
        "doc", "stay", keyed["doc_id"].alias("k1"), keyed["text_sha256"].alias("k2"))
    clear = joined.where(F.col("stay").isNull()).select("doc.*")
    if changed.where(F.col("stay") > 0).isEmpty():
        return clear
    once = joined.where(F.col("stay") > 0).groupBy("k1", "k2").agg(F.first("doc").alias("doc")).select("doc.*")
    return clear.union(once)
