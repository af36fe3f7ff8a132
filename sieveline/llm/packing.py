"""Best-fit packing of documents into fixed-length sequences, improved by a swap-based local search.

Documents are encoded, longer ones cut into pieces of `capacity` ids, and only (piece, length) rows are
shuffled. Pieces are dealt by a hash to shards of about `SHARD` pieces; a shard is packed best-fit in
decreasing order, and a local search then exchanges pieces between underfull bins (one for one, two for
one, or moves), each step increasing the sum of squared fills, until bins empty. Of every shard the
emptiest underfull bins, up to a sixteenth of its pieces, meet those of 15 others in a further round, and
so on to one shard. A hash of the piece decides the shard, so no source or group of copies makes one large.

Null texts are empty documents (one piece: the end id). Repeated rows are separate documents. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, release
from .encoders import encoder

#: Pieces packed together; also the bound of a packing task's memory.
SHARD = 20_000
#: Shards that meet in a further round; each hands on its emptiest bins, this part of a shard's pieces.
FAN_IN = 16

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special_as_text)
        for batch in batches:
            rows: list[tuple] = []
            for doc, got in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text")), strict=True):
                got = np.append(got, end_id).astype("<u4")
                rows += [(doc, k, s, min(capacity, len(got) - s), zlib.crc32(got[s : s + capacity])) for k, s in enumerate(range(0, len(got), capacity))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)
        batch = rows = got = None  # noqa: F841
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, into the fullest bin that still has room."""
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    bins, made = np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, made = capacity, made, made + 1
        bins[i] = b
        if free > n:
            insort(room, (free - n, b))
    return bins


def _sums(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For every total from 0 to `capacity`: the largest sum of one or two of the lengths that isn't above
    it (0 if none), and the first length of that sum (the sum itself for one length)."""
    distinct, first = np.unique(lengths, return_counts=True)
    part = np.zeros(capacity + 1, np.int64)
    for n, many in zip(distinct.tolist(), first.tolist(), strict=True):
        other = n + (distinct if many > 1 else distinct[distinct != n])
        part[other[other <= capacity]] = n
    part[distinct] = distinct
    return np.maximum.accumulate(np.where(part > 0, np.arange(capacity + 1), 0)), part


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search over underfull bins. The emptiest bin gives: a piece moves to a bin with room, is
    exchanged for a shorter piece of a fuller bin, or two pieces for one; the exchange that leaves its
    target fullest is taken, of all there are. Every exchange fills a fuller bin, so squared fills grow and
    the search ends when no exchange of the emptiest bins is left."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths, minlength=int(bins.max()) + 1 if len(bins) else 0).astype(np.int64)
    settled = (fill >= capacity) | (fill == 0)  # full bins, and givers that no exchange can help

    def exchange(out: np.ndarray, back: np.ndarray, giver: int, taker: int) -> None:
        bins[out], bins[back] = taker, giver
        moved = int(lengths[out].sum() - lengths[back].sum())
        fill[giver] -= moved
        fill[taker] += moved
        settled[taker] |= fill[taker] >= capacity
        settled[giver] |= fill[giver] == 0

    none = np.zeros(0, np.int64)
    while not settled.all():
        giver = int(np.argmin(np.where(settled, capacity + 1, fill)))
        gap = np.where((fill >= fill[giver]) & (fill > 0), capacity - fill, 0)  # of the bins that may take
        gap[giver] = 0
        mine = np.flatnonzero(bins == giver)
        own = lengths[mine]
        # a move that leaves its target fullest, of the longest piece that has one
        fits = own[own <= gap.max()]
        if len(fits):
            n = int(fits.max())
            exchange(mine[own == n][:1], none, giver, int(np.argmin(np.where(gap >= n, gap, capacity + 1))))
            continue
        theirs = np.flatnonzero(gap[bins] > 0)
        if len(theirs):
            most, part = _sums(own, capacity)
            target = np.minimum(lengths[theirs] + gap[bins[theirs]], capacity)
            gain = most[target] - lengths[theirs]
            best = int(np.argmax(gain))
            if gain[best] > 0:
                total = int(most[target[best]])
                one = mine[own == part[total]][:1]
                two = mine[(own == total - part[total]) & (mine != one[0])][:1] if part[total] != total else none
                exchange(np.concatenate([one, two]), theirs[best : best + 1], giver, int(bins[theirs[best]]))
                continue
        settled[giver] = True
    return np.unique(bins, return_inverse=True)[1].astype(np.int64) if len(bins) else bins


def handed_on(fill: np.ndarray, pieces: np.ndarray, capacity: int, share: int) -> np.ndarray:
    """The emptiest underfull bins, as many as hold at most `share` pieces together (one at least)."""
    order = np.argsort(fill, kind="stable")
    order = order[fill[order] < capacity]
    return order[: max(1, int(np.searchsorted(np.cumsum(pieces[order]), share, side="right")))]


def pack(table: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece, length."""
    total = table.count()
    shards = max(1, -(-total // SHARD))
    names = table.columns
    ddl = ", ".join(f"{n} {t}" for n, t in table.dtypes)

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = improve(lengths, best_fit(lengths, capacity), capacity)
        order = np.argsort(bins, kind="stable")
        pdf, bins, lengths = pdf.iloc[order].reset_index(drop=True), bins[order], lengths[order]
        before = np.cumsum(lengths) - lengths
        first = np.searchsorted(bins, np.arange(bins[-1] + 1))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        handed = handed_on(fill, np.bincount(bins), capacity, SHARD // FAN_IN)
        out = pdf[names].copy()
        out["sequence_id"] = (pdf["shard"].to_numpy(np.int64) << 32) + bins
        out["offset"] = before - before[first[bins]]
        out["handed_on"] = np.isin(bins, handed)
        return out

    full = table.where(F.col("length") >= capacity)
    row = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    alone = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    parts, todo, level = [alone], table.where(F.col("length") < capacity).withColumn("shard", F.pmod(row, F.lit(shards))), 0
    while True:
        packed = todo.groupBy("shard").applyInPandas(pack_shard, f"{ddl}, sequence_id long, offset long, handed_on boolean")
        if shards == 1:
            parts.append(packed.select(*names, "sequence_id", "offset"))
            break
        packed = scratch.keep(packed, f"packed{level}")
        parts.append(packed.where("not handed_on").select(*names, "sequence_id", "offset"))
        base, shards, level = shards, max(1, shards // FAN_IN), level + 1
        # numbers of further rounds lie above those of the rounds before
        above = (base + 1) if level == 1 else above + base + 1
        held = packed.where("handed_on").select(*names)
        todo = held.withColumn("shard", F.pmod(row, F.lit(shards)) + F.lit(above))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """A row per piece of every document with its sequence and its place in it."""
    scratch = Scratch(spark)
    return pack(scratch.keep(pieces(docs, path, end_id, capacity), "pieces"), scratch, capacity)
