"""What the operators of this folder share: scratch tables, text as bytes, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where it is unset and
    Spark runs on one machine, as in tests) a fresh temporary folder, then kept in the session's settings."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Spark's setting to remove the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/sieveline/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes `df` and reads it back with its schema. The shuffle files behind it go when it is written."""
        at, conf, before = f"{self.path}/{name}", self.spark.conf, self.spark.conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Removes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop_all_but(self, *names: str) -> None:
        """Removes all tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)


#: Models averaged in one task.
TOGETHER = 64


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    total = pdf["seen"].sum()
    mean = sum(np.frombuffer(n, "<f8") * (s / total) for n, s in zip(pdf["net"], pdf["seen"], strict=True))
    return pd.DataFrame({"part": [pdf["part"].iloc[0] // TOGETHER], "net": [mean.tobytes()], "seen": [total]})


def average(nets: DataFrame, scratch: Scratch) -> np.ndarray | None:
    """Mean of tasks' parameters (part, net as doubles, seen), weighed by rows seen, some of them a task in
    as many rounds as needed; None where no task saw a row."""
    nets = nets.where("seen > 0")
    last = nets.agg(F.max("part")).first()[0]
    if last is None:
        return None
    tasks, level = last + 1, 0
    while tasks > 1:
        nets = scratch.keep(nets.groupBy(F.floor(F.col("part") / TOGETHER)).applyInPandas(_average, nets.schema), f"nets{level}")
        tasks, level = -(-tasks // TOGETHER), level + 1
    return np.frombuffer(nets.first().net, "<f8")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def fold(column: str, modulus: int) -> Column:
    """crc32 of an integer id written as text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def release() -> None:
    """Gives memory that a finished task left unused back to the system: workers live on, for other stages too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def by_size(items: list, sizes: list[int], limit: int):
    """Slices (from, to) of a list whose sizes sum to about `limit`; at least one item each."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(items):
        yield start, len(items)
