"""Near-duplicate vectors by a pivot-permutation index.

A bounded sample of vectors serves as pivots; of sampled vectors that lie close together one is taken, so
a large group of near copies gets one pivot and its members agree on the others. Every vector is described by its `NEAREST` nearest pivots in
order and enters the inverted list of each. Two vectors meet in the lists of the pivots they share; with
at least `SHARED` of them they are candidates, and their cosine is verified in double precision. A pair is
counted in the list of its first shared pivot only. Lists longer than `TILE` are split by a hash into
parts, and every two parts form a tile of their own. Tiles never emit pairs: they return, for each vector
that links, the weighted number of links counted there and one link of a spanning forest.

Equal vectors collapse to one with a weight before the index, so copies cost nothing. Vectors that are
null, empty, zero or hold null or non-finite components link with nothing; vectors of different width
neither. Repeated rows of an id count as vectors, rows without an id are left out. An empty table gives an empty result.

Recall depends on pivots per vector: measured against brute force at cosine 0.9 it is above 0.97 for 128
to 2048 pivots of 64-dimensional vectors, also where a third of them are near copies of one, and rises
with the cosine. Tables and widths of any size go the same way; `TILE` tells only how the work is dealt.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, by_size
from .components import components
from .vectors import matrix, valid

COSINE = 0.9
NEAREST, SHARED, TILE = 8, 2, 4_096
#: Pivots: a hundredth of the different vectors, between these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 128, 2_048
#: Pivots lie no closer than this cosine. They are sought among so many times their number, and so many bytes.
APART, POOL, POOL_BYTES = 0.7, 4, 1 << 25


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spread(unit: np.ndarray, wanted: int) -> np.ndarray:
    """At most `wanted` of the unit vectors, in order, each closer than APART to none before it."""
    kept = unit[:0]
    for s in range(0, len(unit), 256):
        part = unit[s : s + 256]
        far = part[(part @ kept.T).max(axis=1) < APART] if len(kept) else part
        near, own = far @ far.T >= APART, []
        for i in range(len(far)):
            if not near[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, far[own]])
        if len(kept) >= wanted:
            break
    return kept[:wanted]


def _chosen(wanted: dict[int, int], least: int):
    """Pivots of one width from its sample, smallest hash first; only the first, if there are fewer than `least`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int(pdf["w"].iloc[0])
        found = spread(_units(np.stack(pdf.sort_values("n")["v"].to_numpy())), wanted[w])
        if len(found) < least:
            found = found[:1]
        return pd.DataFrame({"w": w, "pivots": [found.tobytes()]})

    return run


def _described(pivots: dict[int, np.ndarray], nearest: int):
    """Adds each vector's width, nearest pivots (short array) and its unit vector (binary)."""

    def run(batches):
        for b in batches:
            sizes = b.column("v").value_lengths().to_numpy()
            for w in np.unique(sizes).tolist():
                part = b.take(pa.array(np.flatnonzero(sizes == w)))
                unit = _units(matrix(part.column("v")))
                order = np.argsort(-np.round(unit @ pivots[w].T, 12), axis=1, kind="stable")[:, :nearest].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), w, np.int32)), part.column("id"), part.column("weight"), pa.array(list(order), pa.list_(pa.int32())), pa.array([u.tobytes() for u in unit], pa.binary())], names=["w", "id", "weight", "near", "unit"])

    return run


_TILE_OUT = "id long, links long, root long"


def _tile(shared: int, cosine: float, pivots: dict[int, int]):
    """Links of a tile, given the number of pivots of each width."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        width, pivot, a, b = pivots[key[0]], *key[1:]
        enough = min(shared, width)
        ids, weight, part = pdf["id"].to_numpy(), pdf["weight"].to_numpy(np.int64), pdf["part"].to_numpy()
        unit = np.frombuffer(b"".join(pdf["unit"]), np.float64).reshape(len(pdf), -1)
        near = np.stack(pdf["near"].to_numpy())
        flags = np.zeros((len(pdf), width), np.float32)
        flags[np.arange(len(pdf))[:, None], near] = 1
        links, label = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        masks = []
        for s in range(0, len(pdf), 512):
            rows = slice(s, s + 512)
            ok = (flags[rows] @ flags.T >= enough) & (unit[rows] @ unit.T >= cosine)
            ok[np.arange(len(ok)), np.arange(s, s + len(ok))] = False
            if pivot and ok.any():
                ok &= flags[rows, :pivot] @ flags[:, :pivot].T == 0
            if a != b:
                ok &= part[rows, None] != part
            links[rows] = ok @ weight
            masks.append(np.packbits(ok, axis=1))
        while True:  # least label of the neighbours, until nothing changes
            before = label.copy()
            for k, packed in enumerate(masks):
                ok = np.unpackbits(packed, axis=1, count=len(pdf)).astype(bool)
                some = ok.any(axis=1)
                rows = np.arange(512 * k, 512 * k + len(ok))[some]
                if len(rows):
                    label[rows] = np.minimum(label[rows], np.where(ok[some], label, len(pdf)).min(axis=1))
            label = label[label]
            if (label == before).all():
                break
        own = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[own], "links": links[own], "root": ids[label[own]]})

    return run


def near_vectors(spark: SparkSession, table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch(spark)
    rows = scratch.keep(valid(table).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "rows")
    heads = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    distinct = scratch.keep(rows.join(heads, ["h1", "h2", "vec_id"]).select("h1", "h2", "weight", "v").dropDuplicates(["h1", "h2"]).withColumn("id", F.monotonically_increasing_id()), "distinct")
    named = None
    widths = {r.w: r.c for r in distinct.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("c")).where("c > 1").collect()}  # a number a width
    wanted = {w: min(c, max(LEAST_PIVOTS, min(MOST_PIVOTS, c // 100))) for w, c in sorted(widths.items())}
    pool = {w: max(k, min(POOL * k, POOL_BYTES // (8 * w))) for w, k in wanted.items()}
    for k, (x, y) in enumerate(by_size(list(pool), [8 * w * n for w, n in pool.items()], POOL_BYTES)):
        some = list(pool)[x:y]  # widths whose pivots are held together
        own = distinct.withColumn("w", F.size("v")).where(F.col("w").isin(some))
        first = own.withColumn("n", F.row_number().over(Window.partitionBy("w").orderBy(F.xxhash64(F.lit(5), "h1"), "h1", "h2"))).where(F.col("n") <= max(pool[w] for w in some))
        first = first.where(F.col("n") <= F.element_at(F.create_map(*[F.lit(v) for w in some for v in (w, pool[w])]), F.col("w")))
        # any two vectors share SHARED of fewer pivots than so many: one list has the same pairs
        chosen = first.select("w", "n", "v").groupBy("w").applyInPandas(_chosen({w: wanted[w] for w in some}, 2 * NEAREST - SHARED + 1), "w int, pivots binary").collect()
        pivots = {r.w: np.frombuffer(r.pivots).reshape(-1, r.w) for r in chosen}
        described = scratch.keep(own.select("id", "weight", "v").mapInArrow(_described(pivots, NEAREST), "w int, id long, weight long, near array<int>, unit binary"), f"described{k}")
        lists = described.withColumn("pivot", F.explode("near"))
        sizes = lists.groupBy("w", "pivot").agg(F.count("*").alias("c"))  # a number a pivot
        parts = F.broadcast(sizes.select("w", "pivot", F.ceil(F.col("c") / TILE).alias("parts")).where("parts > 1"))
        lists = lists.join(parts, ["w", "pivot"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        lists = lists.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
        lists = lists.withColumns({"a": F.least("part", "other"), "b": F.greatest("part", "other")})
        found = lists.select("w", "pivot", "a", "b", "id", "weight", "part", "near", "unit").groupBy("w", "pivot", "a", "b").applyInPandas(_tile(SHARED, cosine, {w: len(p) for w, p in pivots.items()}), _TILE_OUT)
        found = scratch.keep(found, f"found{k}")
        named = found if named is None else named.unionAll(found)
    if named is None:
        named = spark.createDataFrame([], _TILE_OUT)
    roots = components(named.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    links = named.groupBy("id").agg(F.sum("links").alias("links"))
    merged = distinct.select("h1", "h2", "id", "weight").join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    merged = merged.select("h1", "h2", F.coalesce("links", F.lit(0)).alias("links"), "weight", F.coalesce("root", "id").alias("root"))
    least = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"))
    merged = merged.join(least, ["h1", "h2"])
    smallest = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    merged = merged.join(smallest, "root").select("h1", "h2", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.select("vec_id", "h1", "h2").join(merged, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    fine = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    apart = _invalid(fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _invalid(rows: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & ~F.coalesce(fine, F.lit(False)))
