"""Nearest neighbours by a block matrix join over int8 codes, exact in its result.

Vectors are coded as int8 with one scale each. A tile joins a block of queries with a block of
candidates: one product of the codes gives approximate inner products, and the norms of the codes and
of the coding errors bound each one's error. A candidate survives a tile if its upper bound reaches the
tile's k-th largest lower bound; the tiles' survivors are thinned again by the k-th largest lower bound
over all tiles. Survivors are recomputed in double precision from the original vectors, summed from left
to right; every task keeps a query's k best of its own in a heap, and the heaps of a query are merged,
ties to the smaller id. Nothing is lost: recall is 1, whatever the vectors' width (products of codes are
summed in single precision only where all sums are exact there).

Equal vectors collapse first to one that carries its k + 1 smallest ids (no more can be in an answer),
so a vector that a third of all rows share costs one candidate. Vectors that are null, zero, empty or
hold null or non-finite components take no part; only vectors of one width are compared. Repeated rows
of an id count once each as candidates, and not for the query of that id. No queries: no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch
from .vectors import matrix, valid

NEAREST = 20
#: Rows of a tile's two sides.
QUERY_TILE, CANDIDATE_TILE = 16_384, 8_192
_SALTS = 64
#: Entries of all heaps that a task holds; beyond it they are handed on.
HELD = 1 << 18


def _code(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, norms of the decoded vectors, norms of the errors (rounded up)."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.linalg.norm(decoded, axis=1) * up, np.linalg.norm(x - decoded, axis=1) * up


def _with_codes(rows: DataFrame) -> DataFrame:
    """id, width, tile keys and codes of vectors (id, v)."""

    def run(batches):
        for b in batches:
            sizes = b.column("v").value_lengths().to_numpy()
            for w in np.unique(sizes).tolist():
                own = pa.array(np.flatnonzero(sizes == w))
                part = b.take(own)
                codes, scale, norm, error = _code(matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.full(len(part), w)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(norm), pa.array(error)], names=["id", "width", "codes", "scale", "norm", "error"])

    return rows.select("id", "v").mapInArrow(run, "id long, width long, codes binary, scale double, norm double, error double")


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("candidate", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()

        def side(t: pa.Table):
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int8).reshape(len(t), -1)
            codes = codes.astype(np.float32 if 127 * 127 * codes.shape[1] <= 1 << 24 else np.float64)  # sums of products are exact
            return t.column("id").to_numpy(), codes, *(t.column(c).to_numpy() for c in ("scale", "norm", "error"))

        q_id, q, q_scale, q_norm, q_error = side(left)
        c_id, c, c_scale, c_norm, c_error = side(right)
        out = []
        for a in range(0, len(q), 256):
            s = slice(a, a + 256)
            near = (q[s] @ c.T).astype(np.float64) * q_scale[s, None] * c_scale
            bound = q_norm[s, None] * c_error + q_error[s, None] * (c_norm + c_error)
            bound += 1e-12 * (1 + np.abs(near))
            lower = near - bound
            floor = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(lower), -np.inf)
            i, j = np.nonzero(near + bound >= floor[:, None])
            out.append(pa.table([q_id[s][i], c_id[j], lower[i, j], near[i, j] + bound[i, j]], schema=schema))
        return pa.concat_tables(out)

    return run


_HEAP = "query long, query_id long, vec_id long, score double"


def _heaps(k: int):
    """The k best of each query among a task's rows."""

    def run(batches):
        held: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for b in batches:
            for q, i, v, s in zip(*(b.column(c).to_pylist() for c in ("query", "query_id", "vec_id", "score")), strict=True):
                heap = held.setdefault((q, i), [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
            if sum(map(len, held.values())) > HELD:
                yield _rows(held)
                held = {}
        yield _rows(held)

    return run


def _rows(held: dict[tuple[int, int], list[tuple[float, int]]]) -> pa.RecordBatch:
    rows = [(q, i, -v, s) for (q, i), heap in held.items() for s, v in heap]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.float64())], names=["query", "query_id", "vec_id", "score"])


def _merged(k: int):
    """A query's k best of all its heaps, with their ranks."""

    def run(t: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, zip((-x for x in t.column("score").to_pylist()), t.column("vec_id").to_pylist(), strict=True))
        ids = pa.array([t.column("query_id")[0].as_py()] * len(best), pa.int64())
        return pa.table({"query_id": ids, "rank": pa.array(range(1, len(best) + 1), pa.int32()), "vec_id": pa.array([v for _, v in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.float64())})

    return run


def nearest(spark: SparkSession, table: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score for queries (a condition on vec_id) against all rows."""
    scratch = Scratch(spark)
    rows = scratch.keep(valid(table).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "rows")
    # equal vectors: the k + 1 smallest ids, first of each of some salts, then of all
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
    ids = rows.select("h1", "h2", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(_SALTS)).alias("salt"))
    ids = ids.withColumn("n", rank("h1", "h2", "salt")).where(F.col("n") <= k + 1).withColumn("n", rank("h1", "h2")).where(F.col("n") <= k + 1)
    ids = scratch.keep(ids.select("h1", "h2", "vec_id"), "ids")
    heads = ids.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"))
    distinct = scratch.keep(rows.join(heads, ["h1", "h2", "vec_id"]).select(F.col("vec_id").alias("id"), "h1", "h2", "v").dropDuplicates(["h1", "h2"]), "distinct")
    queries = scratch.keep(rows.where(is_query).dropDuplicates(["vec_id", "h1", "h2"]).withColumn("id", F.xxhash64("vec_id", "h1", "h2")), "queries")
    n_queries, n = queries.count(), distinct.count()
    across, down = max(1, -(-n // CANDIDATE_TILE)), max(1, -(-n_queries // QUERY_TILE))
    tile = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = _with_codes(queries).withColumn("i", tile(down, 2)).withColumn("j", each(across))
    right = _with_codes(distinct).withColumn("j", tile(across, 3)).withColumn("i", each(down))
    keys = ["i", "j", "width"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k + 1), "query long, candidate long, lower double, upper double")
    near = scratch.keep(near, "near")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("lower")))).where(F.col("n") <= k + 1)
    floor = best.groupBy("query").agg(F.when(F.count("*") == k + 1, F.min("lower")).alias("floor"))
    pairs = near.join(floor, "query").where("floor is null or upper >= floor").select("query", "candidate")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(queries.select(F.col("id").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("a")), "query").join(distinct.select(F.col("id").alias("candidate"), "h1", "h2", F.col("v").alias("b")), "candidate")
    scored = scored.select("query", "query_id", "h1", "h2", dot.alias("score")).join(ids, ["h1", "h2"]).where("vec_id <> query_id")
    heaps = scored.select("query", "query_id", "vec_id", "score").mapInArrow(_heaps(k), _HEAP)
    return heaps.groupBy("query").applyInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")
