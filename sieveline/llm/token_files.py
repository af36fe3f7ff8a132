"""Token ids in Simple-8b block files, in document order, and back.

`write_tokens` range-partitions documents by id, encodes whole texts and writes one file a partition: a
Parquet container whose rows are blocks (any store that Spark can write will do). A block holds whole
documents, about `BLOCK_IDS` ids, with the offset of every document in it, so that any block can be
decoded alone. `read_tokens` gives a row per document with its ids' place in the whole corpus.

Null texts count as empty, repeated rows stay separate documents, an empty table gives an empty file
set, other columns are ignored, rows whose doc_id is null come first. A text longer than a block makes
a longer block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch
from .encoders import encoder
from .simple8b import decode_block, encode_block

BLOCK_IDS = 65_536

_BLOCK = pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("words", pa.binary())])
_BLOCK_DDL = "file_no int, block_no int, first long, n_ids long, docs array<long>, counts array<long>, words binary"


def _to_blocks(path: str, end_id: int, special_as_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, held, size, block, first
            ids = np.concatenate(held)
            row = {"file_no": part, "block_no": block, "first": first, "n_ids": len(ids), "docs": docs, "counts": [len(x) for x in held], "words": encode_block(ids)}
            block, first, docs, held, size = block + 1, first + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

        enc = encoder(path, special_as_text)
        for batch in batches:
            for doc, got in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                got = np.append(got, end_id).astype(np.uint64)
                if size and size + len(got) > BLOCK_IDS:
                    yield flush()
                docs.append(doc)
                held.append(got)
                size += len(got)
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, scratch: Scratch, path: str, end_id: int, name: str = "tokens", special_as_text: bool = False) -> DataFrame:
    """Writes the block files; returns them as a table of blocks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return scratch.keep(ordered.mapInArrow(_to_blocks(path, end_id, special_as_text), _BLOCK_DDL), name)


_ROW_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"
_ROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def file_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each file: one number a file, so as many as tasks wrote, not as documents."""
    totals = {r.file_no: r.n for r in blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n")).collect()}
    starts, at = {}, 0
    for k in sorted(totals):
        starts[k], at = at, at + totals[k]
    return starts


def read_ids(blocks: DataFrame) -> DataFrame:
    """One row per document with its ids (array<long>): the exact inverse of `write_tokens`."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_block(r["words"]).astype(np.int64)
                ends = np.cumsum(r["counts"])
                yield pa.RecordBatch.from_pydict({"doc_id": r["docs"], "ids": [ids[e - n : e] for e, n in zip(ends, r["counts"], strict=True)]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return blocks.select("docs", "counts", "words").mapInArrow(run, "doc_id long, ids array<long>")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the block files."""
    starts = file_starts(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, counts = decode_block(r["words"]).astype("<u4"), np.asarray(r["counts"], np.int64)
                ends = np.cumsum(counts)
                begin = starts[r["file_no"]] + r["first"]
                crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["docs"], pa.int64()), pa.array(begin + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], schema=_ROW)

    return blocks.select("file_no", "first", "docs", "counts", "words").mapInArrow(run, _ROW_DDL)


def token_output(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes every document's ids, reads the files back and reports each document from them."""
    return read_tokens(write_tokens(docs, Scratch(spark), path, end_id))


