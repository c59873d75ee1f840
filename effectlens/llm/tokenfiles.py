"""Token ids of a corpus as Parquet files that can be read in part.

A row is a document: its file's number, its id, how many ids of the file come before it, how many it has,
and the ids as a list.  Documents are range-partitioned by id, so files follow each other in ascending
order of id (nulls first), and so do the rows in each.  A partition is encoded as a stream: a batch's texts, then
their ids, and nothing else, are in memory.

The files' layout is set by ``Layout``.  Ids are dictionary-encoded, each as few bits as the row group's
distinct ids need; where a dictionary doesn't pay, and in the columns of numbers that ascend, values are
delta-encoded.  Row groups and pages are bounded in bytes; page indexes let a reader skip pages by
id or place, and the columns beside the ids answer what concerns lengths and places without reading ids.

A second table, the index, has a row per file: its ids, rows and tokens, and how many tokens all files
before it have.  A document's place in the whole corpus is its file's plus its own in the file.  Summing up
needs no order over documents, only over files.

Edge cases: a null text is encoded as an empty one, which has only the end id.  Documents of one id are
ordered by a hash of their text; equal rows are interchangeable, and a number of their own lets many copies of one id lie in
several files.  An empty table gives an index without rows.  Columns besides id and text are not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from effectlens.llm.bpe import BATCH_BYTES, tokenizer
from effectlens.llm.shared import frugal, slices, small_batches

#: Columns that ascend or are small numbers: deltas need fewer bits than a dictionary.
DELTAS = ("part", "id", "before", "n_tokens")


@dataclass(frozen=True)
class Layout:
    row_group_bytes: int = 32 << 20
    page_bytes: int = 128 << 10
    page_rows: int = 2_000
    dictionary_bytes: int = 2 << 20
    check_rows: int = 16  # rows after which sizes are looked at: documents can be long
    compression: str = "snappy"  # bits of dictionary codes hardly compress further

    def options(self) -> dict[str, str]:
        """What Spark's Parquet writer is told; version 2 pages are those with delta encodings."""
        sizes = {
            "parquet.block.size": self.row_group_bytes,
            "parquet.page.size": self.page_bytes,
            "parquet.page.row.count.limit": self.page_rows,
            "parquet.dictionary.page.size": self.dictionary_bytes,
            "parquet.page.size.row.check.min": self.check_rows,
            "parquet.page.size.row.check.max": max(self.check_rows, 1_000),
        }
        kinds = {"compression": self.compression, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true"}
        return {k: str(v) for k, v in sizes.items()} | kinds | {f"parquet.enable.dictionary#{c}": "false" for c in DELTAS}


def schema(id_type: T.DataType) -> T.StructType:
    return T.StructType().add("part", "integer").add("id", id_type).add("before", "long").add("n_tokens", "integer").add("ids", T.ArrayType(T.IntegerType()))


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in a row with the end id after those of each text, and the offsets of the texts."""
    ends = np.cumsum(counts + 1)
    out = np.empty(len(ids) + len(counts), np.int32)
    mine = np.ones(len(out), bool)
    mine[ends - 1] = False
    out[mine], out[ends - 1] = ids, end_id
    return out, np.r_[0, ends]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", layout: Layout | None = None) -> None:
    """Write ``path``/tokens and ``path``/index.  Session settings of shuffles decide how many files there are."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("own"))
    order = ["id", "tie", "own"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "id", "text")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, before = tokenizer(tokenizer_path), 0
        try:
            for batch in batches:
                for at, to in slices(batch.column(2), BATCH_BYTES):
                    ids, counts = bpe.encode(batch.column(2).slice(at, to - at))
                    flat, offsets = ended(ids, counts, end_id)
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                    columns = [*(batch.column(k).slice(at, to - at) for k in (0, 1)), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets).astype(np.int32)), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "id", "before", "n_tokens", "ids"])
                    before += int(offsets[-1])
        finally:
            bpe.forget()

    kind = schema(docs.schema[id_col].dataType)
    dealt.mapInArrow(run, kind).write.options(**(layout or Layout()).options()).parquet(f"{path}/tokens")
    files = spark.read.schema(kind).parquet(f"{path}/tokens").groupBy("part").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    # One row per file.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(part, first_id, last_id, rows, tokens, start) of the files."""
    return spark.read.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids) of all documents; columns that aren't selected later aren't read.

    The index has a row per file, and Spark sends it out or not by its size.
    """
    index = read_index(spark, path)
    rows = spark.read.schema(schema(index.schema["first_id"].dataType)).parquet(f"{path}/tokens")
    return rows.join(index.select("part", F.col("start").alias("at")), "part").select("id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(id, start, ids) of the tokens whose places in the corpus are ``first`` up to before ``last``; only files, row groups and pages that hold some are read."""
    index = read_index(spark, path).filter((F.col("start") < last) & (F.col("start") + F.col("tokens") > first))
    ends = index.agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("start").alias("at"), F.max("start").alias("top")).first()
    rows = spark.read.schema(schema(index.schema["first_id"].dataType)).parquet(f"{path}/tokens")
    rows = rows.filter(F.col("part").between(ends.low, ends.high)) if ends.low is not None else rows.limit(0)
    if ends.low is not None and ends.low == ends.high:
        rows = rows.filter(F.col("before") < last - ends.at)
    start = F.col("at") + F.col("before")
    rows = rows.join(index.select("part", F.col("start").alias("at")), "part").filter((start < last) & (start + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - start, F.lit(0)).cast("int")
    many = (F.least(F.lit(last) - start, F.col("n_tokens")) - skip).cast("int")
    return rows.select("id", (start + skip).alias("start"), F.slice("ids", skip + 1, many).alias("ids"))


def checksums(tokens: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of what ``read_tokens`` gives: crc32 of the ids as little-endian unsigned 32-bit integers."""
    kind = tokens.schema["id"].dataType

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy()
            flat = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    out = T.StructType().add("id", kind).add("start", "long").add("n_tokens", "long").add("ids_crc32", "long")
    return tokens.select("id", "start", "ids").mapInArrow(run, out)
