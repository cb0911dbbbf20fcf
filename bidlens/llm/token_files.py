"""Token ids as Parquet list columns, with a manifest, for reading some documents, some tokens or metadata alone.

A folder of token files holds ``tokens/`` (one row per document: shard, doc_id, n_tokens,
checksum, ids) and ``manifest/`` (one row per shard). Shards are ranges of doc_id, rows
stand in ascending doc_id, so a row group's and a page's bounds tell which ids are inside:
a read of few documents opens few pages, a read of metadata no page of ids, and a stretch
of the token stream only the shards that it touches.

Ids are dictionary encoded (two bytes or less for a vocabulary of 65,536) or delta encoded;
metadata columns are delta encoded. Row groups and pages have the sizes that are asked for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bidlens.llm.common import documents, rows_of
from bidlens.llm.encoding import flat_encoder

ROW_GROUP_BYTES = 32 << 20
ROW_GROUP_ROWS = 1 << 17
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
# Characters that are encoded at a time.
TEXT_BATCH = 1 << 21
# Where rows without an id stand: before all others.
BEFORE_ALL = -(1 << 63)
ROWS = "shard int, doc_id long, n_tokens long, checksum long, ids array<int>"


def shard_bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """The largest doc_id of every shard but the last; an id that fills several shards stands there several times."""
    if shards < 2:
        return np.zeros(0, np.int64)
    cuts = [k / shards for k in range(1, shards)]
    key = F.coalesce(F.col("doc_id"), F.lit(BEFORE_ALL))
    found = docs.agg(F.percentile_approx(key, cuts, max(10_000, 20 * shards)).alias("b")).first()["b"]
    return np.asarray(found or [], np.int64)


def checksums(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """crc32 of each run of ids as little-endian 32-bit integers."""
    data = memoryview(np.ascontiguousarray(tokens)).cast("B")
    return np.fromiter((zlib.crc32(data[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.int64, len(offsets) - 1)


def encoded(docs: DataFrame, vocabulary: str, bounds: np.ndarray, end_id: int) -> DataFrame:
    """``ROWS`` of every document, not yet in order; each text is encoded once."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def encode(batches):
        flat, edges, seen = flat_encoder(vocabulary), shared.value, 0
        for ids, texts in rows_of(batches, TEXT_BATCH):
            tokens, lengths = flat.encode(texts)
            tokens = np.insert(tokens, np.cumsum(lengths), end_id).astype("<i4", copy=False)
            offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
            keys = np.array([BEFORE_ALL if k is None else k for k in ids], np.int64)
            low, high = np.searchsorted(edges, keys, "left"), np.searchsorted(edges, keys, "right")
            # Only an id that fills whole shards is dealt over them, row by row.
            dealt = low + np.where(high - low > 1, np.arange(seen, seen + len(ids)) % np.maximum(high - low, 1), 0)
            seen += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(dealt.astype(np.int32)), pa.array(ids, pa.int64()), pa.array(lengths + 1), pa.array(checksums(tokens, offsets)),
                 pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens))],
                names=["shard", "doc_id", "n_tokens", "checksum", "ids"],
            )

    return docs.mapInArrow(encode, ROWS)


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shards: int | None = None, encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES, row_group_rows: int = ROW_GROUP_ROWS, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode every whole text, append ``end_id`` and write the ids below ``path`` in ascending doc_id order.

    ``shards`` is the number of files, by default the session's shuffle partitions. A null
    or empty text has the end id alone. Rows without an id come first. Repeated ids stand
    next to each other, by length and checksum inside a shard; an id with more rows than
    shards hold is dealt over several shards. An empty table gives files without rows.
    Other columns are left behind, whatever their names. A long text is cut for encoding
    where no token spans, and its ids are one list.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    spark = docs.sparkSession
    plain = documents(docs, id_col, text_col)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = shard_bounds(plain, shards)
    rows = encoded(plain, vocabulary, bounds, end_id)
    ordered = rows.repartitionById(shards, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "checksum")
    ordered.write.options(**{
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.block.row.count.limit": row_group_rows,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "n_tokens", "checksum")},
    }).parquet(f"{path}/tokens")
    totals = read_metadata(spark, path).groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
    )
    # One row per file, so one task may number them.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, rows, tokens, first_id, last_id, start): the files and where their tokens begin."""
    return spark.read.schema("shard int, rows long, tokens long, first_id long, last_id long, start long").parquet(f"{path}/manifest")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(shard, row, doc_id, n_tokens, checksum) without opening a page of ids."""
    rows = spark.read.schema(ROWS).parquet(f"{path}/tokens")
    return rows.select("shard", F.col("_metadata.row_index").alias("row"), "doc_id", "n_tokens", "checksum")


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Rows of (shard, row, n_tokens) and ``start``: how many ids stand before the document in the whole folder.

    All rows of a shard must be present.
    """
    before = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    bases = read_manifest(rows.sparkSession, path).select("shard", F.col("start").alias("_base"))
    local = rows.withColumn("_local", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return local.join(bases, "shard").withColumn("start", F.col("_base") + F.col("_local")).drop("_base", "_local")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(shard, row, doc_id, n_tokens, checksum, ids), of the named documents or of doc_ids from ``first`` to ``last`` only.

    The condition goes to the scan, where bounds of files, row groups and pages leave out the rest.
    """
    rows = spark.read.schema(ROWS).parquet(f"{path}/tokens")
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.select("shard", F.col("_metadata.row_index").alias("row"), "doc_id", "n_tokens", "checksum", "ids")


def token_stretch(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """(doc_id, start, ids): the parts of documents that lie in ids ``start`` to ``start + length`` of the whole stream.

    The manifest names the shards, metadata the rows; only the ids of these are read.
    """
    end = start + length
    touched = read_manifest(spark, path).filter((F.col("start") < end) & (F.col("start") + F.col("tokens") > start))
    shards = [r["shard"] for r in touched.select("shard").orderBy("shard").collect()]
    held = with_starts(read_metadata(spark, path).filter(F.col("shard").isin(shards)), path)
    inside = held.filter((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start)).select("shard", "row", "start")
    ids = read_tokens(spark, path).filter(F.col("shard").isin(shards)).join(inside, ["shard", "row"])
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    take = F.least(F.col("n_tokens"), F.lit(end) - F.col("start")) - skip
    return ids.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), take.cast("int")).alias("ids"))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, intact) of every document from the ids in the files.

    ``intact`` compares the ids with the length and checksum that were written beside them.
    """
    schema = "shard int, row long, doc_id long, n_tokens long, ids_crc32 long, intact boolean"

    def summed(batches):
        for batch in batches:
            ids = batch.column(5)
            edges = ids.offsets.to_numpy().astype(np.int64)
            lengths, sums = np.diff(edges), checksums(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), edges)
            intact = (lengths == batch.column(3).to_numpy()) & (sums == batch.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(lengths, pa.int64()), pa.array(sums), pa.array(intact)],
                names=["shard", "row", "doc_id", "n_tokens", "ids_crc32", "intact"],
            )

    rows = read_tokens(spark, path).mapInArrow(summed, schema)
    return with_starts(rows, path).select("doc_id", "start", "n_tokens", "ids_crc32", "intact")
