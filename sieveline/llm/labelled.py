"""Bounded samples of labelled documents, and fitting in a task instead of on the driver."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Range of the sampling hash.
_RANGE = 1 << 30


def _chance(column: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(column).cast("long")), F.lit(_RANGE))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bounds: dict[int, int]) -> DataFrame:
    """text (binary), label, weight of at most `bounds[v]` training rows of each label value v, chosen by a
    hash of the id. A row weighs as many training rows as it stands for. Null labels are left out; of
    repeated label rows of an id the largest counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).where(train)
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value, bound in sorted(bounds.items()):
        near, share = rows.where(F.col("label") == value), 1.0
        if counts.get(value, 0) > bound:
            share = bound / counts[value]
            near = near.where(_chance("doc_id") < int(_RANGE * share))
        near = near.limit(2 * bound).withColumn("weight", F.lit(1 / share))  # never reached but by a freak of the hash; it proves the bound
        picked = near if picked is None else picked.unionByName(near)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("text", "label", "weight")


def in_one_task(rows: DataFrame, work: Callable[[pa.Table], Any]) -> Any:
    """What `work` gives for all rows, a bounded sample, done in one task in a fixed order; only the result
    reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(pa.Table.from_batches(held)))], pa.binary())], names=["result"])

    got = rows.repartition(1).sortWithinPartitions(*rows.columns).mapInArrow(run, "result binary").collect()
    return pickle.loads(got[0].result) if got else work(rows.limit(0).toArrow())
