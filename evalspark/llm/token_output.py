"""Operator 4, token ids as ORC files in document order.

Texts are dealt by ranges of document id, sorted and encoded within their range, and written as one ORC file per
range: ids in run-length encoded integer columns, a row index entry every thousand rows, and a Bloom filter on document
ids, so that a reader prunes files, stripes and row groups by metadata and reads stripes in parallel. Each row has
its place within its file's ids; a document's place in the whole corpus is that plus the ids of all files before,
which is a sum over one row per file.

Only the texts are shuffled, once; encoding happens behind the shuffle, so ids never travel.

Defined cases: a null text is the empty one and has only the end id; rows of equal document id are ordered by text
(null first) and all kept; a null id sorts first; an empty table gives files without rows; further columns are not
written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.tokens import encoder

END_ID = 1
#: ORC settings: Bloom filters and row indexes serve look-ups by id; rows are documents, so index strides are short.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20), "compression": "zstd"}
#: A row per file is broadcast (about 50 bytes each) up to this many files, joined by shuffle beyond.
BROADCAST_FILES = 100_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes (doc_id, local_start, n_tokens, ids, part) as ORC under path; tokenizer is a file that executors have."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    ordered = narrow.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, upto = encoder(tokenizer), 0
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                ends, ids = enc.lists(part.column("text"))
                # one end id behind each text's ids
                bounds = ends + np.arange(len(ends))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.insert(ids, ends[1:], end_id).view("<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(upto + bounds[:-1]), pa.array(np.diff(bounds).astype(np.int32)), lists], schema=_SCHEMA)
                upto += int(bounds[-1])

    encoded = ordered.mapInArrow(encode, "doc_id long, local_start long, n_tokens int, ids array<int>")
    encoded.withColumn("part", F.spark_partition_id()).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before, in id order."""
    rows = spark.read.orc(path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    # one row per file meets in one task here
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("base"))
    bases = F.broadcast(bases) if files.count() <= BROADCAST_FILES else bases
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def find_document(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """A document's row; the filter reaches the files' Bloom filters and row indexes."""
    return spark.read.orc(path).filter(F.col("doc_id") == doc_id)


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that read_tokens returns."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
