"""Token ids as ORC files in ascending order of documents.

Ids lie in ORC's integer run-length encoding, with row indexes and a Bloom
filter on the document's id, so a reader prunes stripes by metadata and reads
stripes in parallel. Files are ranges of the identifier: their names are in
order, so the place of a document in the whole stream is its file's offset
plus a running total within the file.

Nulls: a null text is empty and has the end id only; a null identifier sorts
last. Repeated identifiers are written each, ordered by their ids' checksum. A
very long text is one row of a stripe. Columns besides the two named ones are
not read. An empty table writes an empty file set with its schema.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, arrow_map, partitions
from .tokens import id_type, word_ids

END = 2
FILE_SCHEMA = "doc_id long, n_tokens long, ids array<int>"
ORC = {
    "compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "1000", "orc.stripe.size": str(8 << 20),
}


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end: int | None = END, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (packed in the vocabulary's id_type); end: the id appended to each document."""
    kind = np.dtype(id_type(path))
    tail = b"" if end is None else np.array([end], kind).tobytes()

    def run(batches):
        memo = word_ids(path)
        for batch in batches:
            parts = [p + tail for p in memo.texts(batch.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // kind.itemsize for p in parts], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, "doc_id long, n_tokens long, ids binary")


def _widened(path: str | None):
    """Packed ids as lists of integers."""
    kind = np.dtype(id_type(path))

    def run(batches):
        for batch in batches:
            parts = batch.column(2).to_pylist()
            ends = np.cumsum([0, *[len(p) // kind.itemsize for p in parts]], dtype=np.int32)
            flat = np.frombuffer(b"".join(parts), kind).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, path: str, **how) -> None:
    """Encode docs and write them to path. The encoding is written once, packed and unsorted, so that sampling the ranges
    doesn't repeat it; ids become integers again as the files are written."""
    scratch = Scratch(docs.sparkSession)
    ids = scratch.keep(encoded(docs, **how), "ids")
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_tokens")]
    files = ids.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, F.hash("ids"))
    arrow_map(files, _widened(how.get("path")), FILE_SCHEMA).write.mode("overwrite").options(**ORC).orc(path)
    scratch.drop("ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and file, in files whose names are in order."""
    return spark.read.schema(FILE_SCHEMA).orc(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("int"))


def checked(tokens: DataFrame) -> DataFrame:
    """What read_tokens gives, with start (ids of all documents before) and ids_crc32."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(flat[4 * int(a) : 4 * int(b)]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64()), pa.array([int(b - a) for a, b in zip(ends, ends[1:])], pa.int64()), batch.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "n_read", "file"])

    rows = arrow_map(tokens.select("doc_id", "n_tokens", "ids", "file"), run, "doc_id long, n_tokens long, ids_crc32 long, n_read long, file int")
    scratch = Scratch(tokens.sparkSession)
    rows = scratch.keep(rows, "sums")
    # a row a file: bounded by the number of files
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("file").agg(F.sum("n_read").alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_last(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("n_read").over(within), F.lit(0))
    return rows.join(F.broadcast(offsets), "file").select("doc_id", start.alias("start"), F.col("n_read").alias("n_tokens"), "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.path("orc"))
    out = checked(read_tokens(spark, scratch.path("orc")))
    scratch.drop("orc")  # checked() has written all that it reads
    return out
