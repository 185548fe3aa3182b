"""Token ids in ORC files, in ascending doc_id order.

Documents are range-partitioned and sorted by (doc_id, hash of the text), encoded a
batch at a time and written as ORC: ids are an integer column, so ORC's run-length
integer encoding holds them; row indexes and a Bloom filter on ``doc_id`` let a
reader skip stripes and row groups, and each stripe can be read by a task of its
own. ``local_start`` counts the ids before a document in its file; the ids of
earlier files come from one sum a file, so no task sees more than its own part.

Null texts are empty and still get the end id; null ids sort first; rows that repeat
a doc_id are kept, ordered by their text's hash; an empty table writes no documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streakline.llm.common import shared_folder, table
from streakline.llm.tokens import encoder_of, text_groups

END = 0
ORC = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, shard int, local_start long, n_tokens long, ids array<int>"


def encode_documents(batches: Iterator[pa.RecordBatch], path: str, end: int):
    encoder, shard, before = encoder_of(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in text_groups(batch.column("chars").to_pylist()):
            rows = batch.slice(part.start, part.stop - part.start)
            ids, counts = encoder.encode([t or "" for t in rows.column("text").to_pylist()])
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end)
            counts = counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts)])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.full(len(counts), shard, np.int32)),
                    pa.array(before + offsets[:-1]),
                    pa.array(counts),
                    pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32)),
                ],
                ["doc_id", "shard", "local_start", "n_tokens", "ids"],
            )
            before += int(offsets[-1])


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer file and write ``path``."""
    key = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
        .repartitionByRange("doc_id", key)
        .sortWithinPartitions("doc_id", key)
    )
    ordered.mapInArrow(lambda b: encode_documents(b, tokenizer, end), SCHEMA).write.options(
        **ORC
    ).orc(path)


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); ``doc_ids`` reads only stripes that may hold them."""
    files = spark.read.schema(SCHEMA).orc(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row a file
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    chosen = files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))
    return chosen.join(starts, "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy().astype("<u4")
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("shard"),
                batch.column("local_start"),
                pa.array(np.diff(at).astype(np.int64)),
                pa.array(crc, pa.int64()),
            ],
            ["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"],
        )


def op4_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    write_token_orc(
        table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json")
    )
    files = spark.read.schema(SCHEMA).orc(path)
    summed = files.mapInArrow(
        checksums, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long"
    )
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return summed.join(starts, "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


QUERIES = {"op4_token_orc": op4_token_orc}
ORACLES: dict[str, str] = {}
