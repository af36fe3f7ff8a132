"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance `RADIUS` or less share a point within half of it from both. Every distinct
fingerprint therefore emits all its variants within half the radius (2081 for 64 bits and 4), variants
are dealt to buckets by a hash, and equal variants of different fingerprints collide. All that collide
in one variant lie within the radius of each other by the triangle inequality, so a star over them keeps
their component whole without forming pairs; every star link is verified on the fingerprints.

Variants travel as packed arrays, a row per bucket and chunk of fingerprints. They are dealt in `ROUNDS`
rounds by another part of their hash, one after the other, so that the disk holds one round's share.
Copies collapse to one fingerprint before anything is emitted.

Null and word-less texts have fingerprint zero and link like any other. Repeated rows count as documents
with the same id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, text_bytes
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: Rounds in which variants are dealt, and variants a bucket holds on average.
ROUNDS, BUCKET = 8, 1 << 18
#: Fingerprints whose variants are formed together.
CHUNK = 1024


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 hashes of a text's shingles of some words, repeats included; of all its words, if it has fewer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :], strict=False)), np.uint64, len(words) - k + 1)


def majority(words: np.ndarray) -> bytes:
    """Bits set in over half of the rows of words, big-endian."""
    ones = np.zeros(64 * words.shape[1], np.int64)
    for a in range(0, len(words), 100_000):
        part = np.ascontiguousarray(words[a : a + 100_000], ">u8")
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(words)).tobytes()


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 hashes of a text's shingles; zero without words."""
    return int.from_bytes(majority(shingle_hashes(text, SHINGLE)[:, None]), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball() -> np.ndarray:
    """Masks of at most half the radius in bits, the empty one first."""
    return np.array([sum(1 << b for b in bits) for n in range(RADIUS // 2 + 1) for bits in combinations(range(BITS), n)], np.uint64)


def mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Forest:
    """Union-find over fingerprints; keeps a spanning forest of the links it is given."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in list(self.up)]


def _variants(turn: int, buckets: int):
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball()
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), CHUNK):
                v = (fps[a : a + CHUNK, None] ^ masks).reshape(-1)
                h = mix(v)
                own = np.flatnonzero((h & np.uint64(ROUNDS - 1)) == np.uint64(turn))
                bucket = (h[own] >> np.uint64(64 - bits)).astype(np.uint32) if bits else np.zeros(len(own), np.uint32)
                order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                own, bucket = own[order], bucket[order]
                cuts = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), len(bucket))
                v, code = v[own], (own % len(masks)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array([v[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([code[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "variants", "codes"])

    return run


def _collide(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one bucket, as a spanning forest."""
    masks = ball()
    v = np.frombuffer(b"".join(pdf["variants"]), np.uint64)
    code = np.frombuffer(b"".join(pdf["codes"]), np.uint16)
    order = np.argsort(v)
    v = v[order]
    same = v[1:] == v[:-1]
    touched = np.flatnonzero(np.append(same, False) | np.append(False, same))
    v, fps = v[touched], v[touched] ^ masks[code[order[touched]]]
    center = fps[np.flatnonzero(np.append(True, v[1:] != v[:-1]))][np.cumsum(np.append(True, v[1:] != v[:-1])) - 1] if len(v) else fps
    pairs = np.unique(np.stack([np.maximum(center, fps), np.minimum(center, fps)], 1)[center != fps], axis=0) if len(v) else np.zeros((0, 2), np.uint64)
    pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS].view(np.int64)
    forest = Forest()
    for a, b in pairs.tolist():
        forest.link(a, b)
    return pd.DataFrame(forest.links(), columns=["a", "b"], dtype="int64")


def near_links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that keep every component whole."""
    total = distinct.count()
    buckets = 1
    while buckets * BUCKET * ROUNDS < total * len(ball()):
        buckets *= 2
    out, spread = None, distinct.select("fp").repartition(max(1, -(-total // (4 * CHUNK))), "fp")
    for turn in range(ROUNDS):
        found = scratch.keep(spread.mapInArrow(_variants(turn, buckets), "bucket long, variants binary, codes binary").groupBy("bucket").applyInPandas(_collide, "a long, b long"), f"links{turn}")
        out = found if out is None else out.unionAll(found)
    return out


def near_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    prints = scratch.keep(fingerprints(docs), "fingerprints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = components(near_links(distinct, scratch), scratch)
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_components(docs, Scratch(spark))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
