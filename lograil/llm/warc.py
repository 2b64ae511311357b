"""WARC archives written and read by Spark's text source, with boundary-chain verification.

Writing: a record is one row of text and the blank lines between records are the row separator, so
any shared storage that Spark writes to will do. Reading: archives are split anywhere, and every
occurrence of the version line begins a candidate, inside payloads too. A candidate knows the offset
of its successor from its declared length. Chains are shortened inside each block, then pointer
jumping from the start of each file, over one pointer for each block, tells which candidates are
reached; only those are records. Bytes of a payload that look like records stay part of the payload.

Defined cases: null payloads are empty, null urls leave their header out, line breaks and other
control characters of urls are percent-encoded. A file whose chain breaks (a header without a length,
a length beyond the next record) has the records up to the break. Of pages with equal payloads of at
least `least` bytes those with the largest id are responses and the others revisit it.
"""
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lograil.llm.common import sized, whole
from lograil.session import durable

MAGIC = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
LINE = "\r\n"
URN = "urn:page:"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _escaped(url: Column) -> Column:
    """The url with spaces and control characters as %XX."""
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def records(pages: DataFrame, least: int = 1000, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """One text row `record` for each row of `pages` (page_id, url, html), without the blank lines behind it."""
    html = whole("html")
    rows = pages.select("page_id", "url", html.alias("payload"), F.octet_length(html).alias("size"), F.sha2(html, 256).alias("same"))
    repeated = durable(rows.where(F.col("size") >= least).groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
                       .where(F.col("n") > 1).select("same", "first"))
    joined = rows.join(sized(repeated), (rows["same"] == repeated["same"]) & (F.col("size") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + LINE + "Content-Type: text/html;charset=utf-8" + LINE + "Content-Length: "),
                    F.col("size").cast("string"), F.lit(BLANK))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.sha1(F.col("payload").cast("binary")), F.lit(LINE))
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _escaped(F.col("url")), F.lit(LINE)), F.lit(""))
    refers = F.concat(F.lit(f"WARC-Profile: {IDENTICAL}{LINE}WARC-Refers-To: "), _urn(F.col("first")), F.lit(LINE))
    record = F.concat(F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(LINE + "WARC-Record-ID: "),
                      _urn(F.col("page_id")), F.lit(f"{LINE}WARC-Date: {date}{LINE}"), target, digest,
                      F.when(revisit, refers).otherwise(""),
                      F.lit("Content-Type: application/http;msgtype=response" + LINE + "Content-Length: "), length.cast("string"),
                      F.lit(BLANK), http, F.when(revisit, "").otherwise(F.col("payload")))
    return joined.select(record.alias("record"))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Archives of all pages under `path`, one for each task."""
    records(pages, **options).write.option("lineSep", BLANK).text(path)


def _header(head: Column, name: str) -> Column:
    value = F.trim(F.regexp_extract(head, rf"(?im)^{name}:([^\r\n]*)", 1))
    return F.when(value != "", value)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between occurrences of the version line: file, block, seq, value.

    Offsets follow from the lengths: rows of a block come in order and blocks are numbered by where
    they begin. What stands before the first version line of a file is a fragment too.
    """
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("seq"), "value")


def _parsed(value: Column) -> dict[str, Column]:
    """Header fields of a record's bytes behind the version line, and its block."""
    head = F.substring_index(value, BLANK, 1)
    before = F.octet_length(head) + len(BLANK)
    content = _header(head, "Content-Length").try_cast("bigint")
    block = F.substring(value.cast("binary"), before + 1, content.cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), BLANK, 1)) + len(BLANK)
    fields = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To",
              "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest"}
    return {name: _header(head, field) for name, field in fields.items()} | {
        "http_length": _header(F.substring_index(block.cast("string"), BLANK, 1), "Content-Length").try_cast("bigint"),
        "declared": len(MAGIC) + before + content + len(BLANK), "payload": F.substring(block, http + 1, 2**31 - 1)}


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a block where its chain leaves the block; -1 if it breaks."""
    rows = rows.sort_values("offset")
    offsets, following = rows["offset"].to_numpy(), rows["next"].to_numpy()
    at, exits = np.searchsorted(offsets, following), np.empty(len(rows), np.int64)
    for i in range(len(rows) - 1, -1, -1):
        if following[i] > offsets[-1]:
            exits[i] = following[i]
        else:
            exits[i] = exits[at[i]] if following[i] > offsets[i] and offsets[at[i]] == following[i] else -1
    return pd.DataFrame({"file": rows["file"].to_numpy(), "offset": offsets, "exit": exits})


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Marks the records of a block from where a chain enters it; `owner` is the record a candidate lies in."""
    rows = rows.sort_values("offset")
    offsets, following = rows["offset"].to_numpy(), rows["next"].to_numpy()
    real, at = np.zeros(len(rows), bool), np.flatnonzero(rows["entered"].to_numpy())
    i = int(at[0]) if len(at) else len(rows)
    while i < len(rows):
        real[i] = True
        j = int(np.searchsorted(offsets, following[i]))
        i = j if following[i] > offsets[i] and j < len(rows) and offsets[j] == following[i] else len(rows)
    last = np.maximum.accumulate(np.where(real, np.arange(len(rows)), -1))
    return pd.DataFrame({"file": rows["file"].to_numpy(), "block": rows["block"].to_numpy(), "seq": rows["seq"].to_numpy(),
                         "offset": offsets, "real": real, "owner": np.where(last >= 0, offsets[last], -1)})


def _reached(chains: DataFrame) -> DataFrame:
    """Pointer jumping: (file, offset) of the block entries that a chain from offset 0 arrives at."""
    targets = chains.where("exit >= 0").select("file", F.col("exit").alias("offset")).distinct()
    begin = chains.where("offset = 0").select("file", "offset")
    hops = durable(chains.join(targets.union(begin).distinct(), ["file", "offset"]))
    reached, n = durable(begin), -1
    while n != (n := reached.count()):
        onward = reached.join(hops, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = durable(reached.union(onward.where("offset >= 0")).distinct())
        second = hops.select("file", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        hops = durable(hops.join(second, ["file", "exit"], "left").select("file", "offset", F.coalesce("further", F.lit(-1)).alias("exit")))
    return reached


def verified(candidates: DataFrame) -> DataFrame:
    """file, block, seq, offset, real, owner for each candidate (file, block, seq, size, next relative to its start)."""
    blocks = candidates.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = candidates.select("file", "block", "seq", "declared", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(inside), F.lit(0)).alias("at"))
    start = F.col("base") + F.col("at") - len(MAGIC)
    nodes = durable(placed.join(bases, ["file", "block"]).where(start >= 0)
                    .select("file", "block", "seq", start.alias("offset"), F.coalesce(start + F.col("declared"), F.lit(-1)).alias("next")))
    chains = durable(nodes.groupBy("file", "block").applyInPandas(_exits, "file string, offset bigint, exit bigint"))
    reached = _reached(chains).withColumn("entered", F.lit(True))
    walked = (nodes.join(reached, ["file", "offset"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
              .groupBy("file", "block").applyInPandas(_walk, "file string, block bigint, seq bigint, offset bigint, real boolean, owner bigint"))
    walked = durable(walked)
    last = walked.where("real").groupBy("file", "block").agg(F.max("offset").alias("last"))
    held = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (bases.join(last, ["file", "block"], "left")
               .select("file", "block", F.last("last", ignorenulls=True).over(held).alias("carried")))
    return walked.join(carried, ["file", "block"]).select(
        "file", "block", "seq", "offset", "real", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("carried")).alias("owner"))


def read_warc(spark: SparkSession, path: str, measures: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A row for each record of the archives under `path`.

    file, offset, record_type, record_id, refers_to, target_uri, payload_digest and http_length come
    from the headers; then `payload` (binary), or what `measures` make of it, worked out where the
    archive is read so that payloads need not move.
    """
    measures = measures or {"payload": lambda payload: payload}
    fragments = _fragments(spark, path)
    fields = _parsed(F.col("value"))
    declared, payload = fields.pop("declared"), fields.pop("payload")
    whole_here = declared == F.octet_length("value") + len(MAGIC)
    candidates = durable(fragments.select(
        "file", "block", "seq", F.octet_length("value").cast("bigint").alias("size"), declared.alias("declared"),
        F.coalesce(whole_here, F.lit(False)).alias("complete"), *[c.alias(n) for n, c in fields.items()],
        *[F.when(whole_here, make(payload)).alias(n) for n, make in measures.items()]))
    marks = durable(verified(candidates))
    names = [*fields, *measures]
    key = ["file", "block", "seq"]
    found = candidates.where("complete").join(marks.where("real"), key).select("file", "offset", *names)
    torn = durable(candidates.where("NOT complete").join(marks.where("real"), key).select("file", F.col("offset").alias("owner"), "declared"))
    if torn.isEmpty():
        return found
    parts = marks.join(sized(torn), ["file", "owner"]).join(fragments, key)
    bytes_of = F.array_sort(F.collect_list(F.struct("offset", "value")))
    whole_text = F.array_join(F.transform(bytes_of, lambda x: x["value"]), MAGIC)
    joined = (parts.groupBy("file", F.col("owner").alias("offset"), "declared").agg(whole_text.alias("value"))
              .where(F.octet_length("value") + len(MAGIC) >= F.col("declared")))
    return found.union(joined.select("file", "offset", *[c.alias(n) for n, c in fields.items()], *[make(payload).alias(n) for n, make in measures.items()]))


def round_trip(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """Archives of `pages` under `path`, read back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    write_warc(pages, path)
    found = read_warc(spark, path, {"n": F.octet_length, "sha1": F.sha1})
    page = lambda name: F.regexp_extract(name, rf"{URN}(-?\d+)>", 1).try_cast("bigint")
    response = F.col("record_type") == "response"
    return found.select(page("record_id").alias("page_id"), F.when(response, F.col("n")).otherwise(F.col("http_length")).cast("bigint").alias("payload_bytes"),
                        F.when(response, F.col("sha1")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
                        "record_type", page("refers_to").alias("refers_to"), "target_uri")
