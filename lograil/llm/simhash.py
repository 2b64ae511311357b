"""Near duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most `bits` bits differ
in at most `bits` bytes, so they share at least 8 - bits of them: the guaranteed minimum count. A
posting list of one positional byte holds a 256th of all fingerprints, and tallying pairs over such
lists is quadratic. The index is therefore kept by sets of as many positional bytes as the minimum
count asks for (28 sets of six for two bits): two fingerprints meet in a posting list exactly if their
tally of shared positional bytes reaches the minimum. Distinct fingerprints in one list differ only
in the bytes left out, so a list has at most 256**bits entries whatever the data; links inside it are
found by looking up near values, never by all pairs.

Defined cases: null and wordless texts have fingerprint zero, which links like any other; a
component is named by its smallest non-null doc_id; repeated rows get equal rows.
"""
from functools import partial
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograil.llm.common import whole
from lograil.llm.components import components
from lograil.session import durable

SEED = 42
BLOCK = 1 << 15
PAIRWISE = 256


def simhash(text: bytes, width: int = 3) -> int:
    """Signed 64-bit fingerprint of the text's word shingles, each counted as often as it occurs."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
        total = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for at in range(0, total, BLOCK):
        part = np.fromiter(islice(hashes, BLOCK), np.uint64, min(BLOCK, total - at))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints_of(data: pa.Array) -> pa.Array:
    return pa.array([simhash(x) for x in data.to_pylist()], pa.int64())


def _masks(bits: int) -> list[int]:
    """For each set of bytes to share, those bytes' mask as a signed number."""
    out = []
    for left_out in combinations(range(8), bits):
        mask = sum(0xFF << (8 * i) for i in range(8) if i not in left_out)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _near(bits: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of members (distinct, equal in the shared bytes) within `bits` bits."""
    if len(members) <= PAIRWISE:
        i, j = np.triu_indices(len(members), 1)
        close = np.bitwise_count(members[i] ^ members[j]) <= bits
        return i[close], j[close]
    members_sorted = np.argsort(members)
    values = members[members_sorted]
    varying = np.bitwise_or.reduce(members ^ members[0])
    places = [1 << k for k in range(64) if varying >> np.uint64(k) & np.uint64(1)]
    left, right = [], []
    for size in range(1, bits + 1):
        for flips in combinations(places, size):
            other = members ^ np.uint64(sum(flips))
            at = np.minimum(np.searchsorted(values, other), len(values) - 1)
            hit = np.nonzero((values[at] == other) & (members < other))[0]
            left.append(hit)
            right.append(members_sorted[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def _links(bits: int, batches):
    for batch in batches:
        left, right = [], []
        for row in batch.column("members"):
            members = row.values.to_numpy(zero_copy_only=False).view(np.uint64)
            i, j = _near(bits, members)
            left.append(members[i])
            right.append(members[j])
        if left:
            yield pa.record_batch([pa.array(np.concatenate(side).view(np.int64)) for side in (left, right)], ["a", "b"])


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): all pairs of distinct values of `prints` (fp) that differ in 1 to `bits` bits."""
    keys = F.array(*[F.struct(F.lit(n).alias("set"), F.col("fp").bitwiseAND(F.lit(mask)).alias("shared"))
                     for n, mask in enumerate(_masks(bits))])
    # Few bytes become many rows here, so they are spread over tasks by number and not by size.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = (prints.select("fp").distinct().repartition(parts, "fp").select("fp", F.explode(keys).alias("key"))
                .groupBy("key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1))
    return postings.select("members").mapInArrow(partial(_links, bits), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, bits: int = 2) -> DataFrame:
    """doc_id, text_sha256, fingerprint, component_id for every row of `docs` (doc_id, text)."""
    rows = durable(docs.select("doc_id", F.sha2(whole("text"), 256).alias("text_sha256"),
                               F.arrow_udf(fingerprints_of, "bigint")(whole("text").cast("binary")).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("smallest"))
    found = components(links(rows, bits))
    named = prints.join(found, prints["fp"] == found["node"], "left").select(
        "fp", "smallest", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
    label = durable(named.join(smallest, "component").select("fp", "component", "component_id"))
    return rows.join(label, "fp").select("doc_id", "text_sha256", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                         "component_id", "component")


def one_of_each(found: DataFrame) -> DataFrame:
    """The rows of near_duplicates with `kept`: of each component exactly one row, of its smallest doc_id."""
    rows = durable(found.withColumn("row", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stays = rows.groupBy("component").agg(F.min(order).alias("least"))
    return rows.join(stays, "component").select("doc_id", "text_sha256", "fingerprint", "component_id",
                                                (F.col("row") == F.col("least.row")).alias("kept"))
