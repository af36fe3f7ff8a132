"""One document of each near-duplicate group, by SimHash and ball hashing on bands of wide fingerprints.

A text's fingerprint has `BITS` bits, majorities over hashes of its five-word shingles. For texts of a
similarity (shared part of all their different shingles) s, bits differ with a chance of
acos(2s / (1 + s)) / pi; two texts are near duplicates if no more bits differ than that share for
`SIMILARITY` and one standard deviation. 64 bits can't tell 0.8 from 0.6, and no ball around that many
differing bits can be listed. So candidates meet in bands: `BANDS` fixed selections of `BAND` bits. In
each, as in `simhash`, every fingerprint has all variants within half of `RADIUS`, and fingerprints that
collide lie within `RADIUS` of each other there. Variants don't travel: a cell holds those of a band that
begin with the same few bits, so a fingerprint reaches its own cell and those with one of these bits flipped,
whole and with its component, and its variants are formed there. Every link is verified on all bits where
it is found, and colliding variants never become rows. The empty mask goes first: what it links needs no
other variant.
At similarity 0.8 some band lies within the radius with a chance of about 0.9, at 0.85 of 0.98.

A cell returns a spanning forest of its links, never pairs; one with many variants forms them by parts. Equal fingerprints collapse to one first.
Null and word-less texts have fingerprint zero and link with each other. Repeated rows are one group. An
empty table gives an empty result; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, text_bytes
from .components import components
from .simhash import BUCKET, Forest, majority, mix, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
BITS, BANDS, BAND, RADIUS = 256, 20, 32, 2
_P = acos(2 * SIMILARITY / (1 + SIMILARITY)) / pi
#: Differing bits of near duplicates, at most.
FURTHEST = int(BITS * _P + sqrt(BITS * _P * (1 - _P)))
#: Rounds in which cells are dealt, fingerprints that are dealt together in small tables and at most, first bits that
#: tell cells apart at least (so that small tables keep all cores busy), and variants formed together. None affects the links.
ROUNDS, CHUNK, MOST, LEAST, PART = 16, 1024, 1 << 16, 5, 1 << 17


def fingerprint(text: bytes) -> bytes:
    """BITS majority bits, zero without words."""
    h = shingle_hashes(text, SHINGLE)
    return majority(np.stack([mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) for k in range(1, BITS // 64 + 1)], 1))


def _selected() -> np.ndarray:
    """The bits of each band, each bit in about as many bands as any other."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.permutation(BITS).reshape(-1, BAND) for _ in range(-(-BANDS * BAND // BITS))])
    return rows[:BANDS]


def _masks() -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for n in range(RADIUS // 2 + 1) for bits in combinations(range(BAND), n)], np.uint64)


def bands(prints: np.ndarray) -> np.ndarray:
    """The bands of fingerprints, given as rows of bytes: a row of longs each, band number above its bits."""
    bits = np.unpackbits(prints, axis=1)[:, _selected()]
    own = np.packbits(bits, axis=2).view(">u4").reshape(len(prints), BANDS).astype(np.uint64)
    return own | np.arange(BANDS, dtype=np.uint64) << np.uint64(BAND)


def _band(prints: np.ndarray, band: int) -> np.ndarray:
    """The bits of one band of fingerprints, given as rows of longs."""
    chosen, rows = _selected()[band], prints.view(np.uint8)
    parts = [np.packbits(np.unpackbits(rows[a : a + 16 * CHUNK], axis=1)[:, chosen], axis=1) for a in range(0, len(rows), 16 * CHUNK)]
    return np.ascontiguousarray(np.concatenate(parts)).view(">u4").reshape(-1).astype(np.uint64)


def _together(first: int) -> int:
    """Fingerprints dealt together: as many more as there are more cells, so that a row holds about as many in tables
    of any size."""
    return min(CHUNK << max(0, first - LEAST), MOST)


def _spread(df: DataFrame, total: int, first: int) -> DataFrame:
    """Fingerprints in tasks of about four packs, dealt in turn: a pack makes a row for every cell it reaches."""
    return df.select("root", "fp").repartition(max(1, -(-total // (4 * _together(first)))))


def _packs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Components and fingerprints of a task, so many at a time whatever its batches."""
    roots, prints = np.zeros(0, np.int64), np.zeros((0, BITS // 8), np.uint8)
    for batch in batches:
        more = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, BITS // 8)
        roots, prints = np.concatenate([roots, batch.column("root").to_numpy()]), np.concatenate([prints, more])
        while len(roots) >= size:
            yield roots[:size], prints[:size]
            roots, prints = roots[size:], prints[size:]
    if len(roots):
        yield roots, prints


def _dealt(first: int, flips: int, rounds: int, turn: int):
    """A task's fingerprints and their components, dealt to the cells of a round that they reach: cells are
    told apart by a band's first bits, of which one in `flips` is flipped."""
    masks, size = np.array([0, *(1 << k for k in range(flips))], np.uint64), _together(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for roots, prints in _packs(batches, size):
            reached = []
            for a in range(0, len(roots), CHUNK):
                cells = ((bands(prints[a : a + CHUNK]) >> np.uint64(BAND - first))[:, :, None] ^ masks).reshape(-1)
                own = np.flatnonzero((mix(cells) >> np.uint64(32)) % np.uint64(rounds) == np.uint64(turn))
                reached.append((cells[own].astype(np.int64), a + own // (BANDS * len(masks))))
            cell, of = (np.concatenate(x) for x in zip(*reached, strict=True))
            if not len(cell):
                continue
            order = np.argsort(cell, kind="stable")
            cell, of = cell[order], of[order]
            cuts = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell)).tolist()
            packed = [pa.array([x[of[i:j]].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for x in (roots, prints)]
            yield pa.RecordBatch.from_arrays([pa.array(cell[cuts[:-1]]), *packed], names=["cell", "roots", "prints"])

    return run


def _unpacked(pdf: pd.DataFrame, first: int) -> tuple:
    """First bits of a cell; bits in its band, components and fingerprints (rows of longs) that reach it."""
    cell = int(pdf["cell"].iloc[0])
    roots = np.frombuffer(b"".join(pdf["roots"]), np.int64)
    prints = np.frombuffer(b"".join(pdf["prints"]), np.uint64).reshape(len(roots), -1)
    return np.uint64(cell & ((1 << first) - 1)), _band(prints, cell >> first), roots, prints


def _variants(own: np.ndarray, begin: np.uint64, first: int) -> tuple[np.ndarray, ...]:
    """Variants of bands that begin with some first bits: they, whose they are, and their masks' numbers."""
    rest = BAND - first
    flip = (own >> np.uint64(rest)) ^ begin
    inside, beside = np.flatnonzero(flip == 0), np.flatnonzero(np.bitwise_count(flip) == 1)
    masks = _masks()[: 1 + rest]  # mask k flips bit k - 1
    v = np.concatenate([(own[inside, None] ^ masks).reshape(-1), own[beside] ^ flip[beside] << np.uint64(rest)])
    codes = np.concatenate([np.tile(np.arange(len(masks)), len(inside)), np.bitwise_count(flip[beside] - np.uint64(1)) + rest + 1])
    return v, np.concatenate([np.repeat(inside, len(masks)), beside]), codes.astype(np.uint8)


def _collide(first: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of one cell's fingerprints that share a variant, where they are of different components and
        bits in the band; those with equal bits have met before."""
        forest, todo = Forest(), [(first, *_unpacked(pdf, first))]
        while todo:
            bits, begin, own, roots, prints = todo.pop()
            if not len(own) or roots.min() == roots.max():
                continue
            if bits < BAND and np.count_nonzero(own >> np.uint64(BAND - bits) == begin) * (BAND - bits) + len(own) > PART:
                for longer in (begin << np.uint64(1), begin << np.uint64(1) | np.uint64(1)):
                    some = np.bitwise_count((own >> np.uint64(BAND - bits - 1)) ^ longer) <= 1
                    todo.append((bits + 1, longer, own[some], roots[some], prints[some]))
                continue
            v, at, codes = _variants(own, begin, bits)
            order = np.lexsort((roots[at], v))
            told = _told_once(v[order], codes[order])
            v, at = v[order][told], at[order][told]
            if len(v):
                new = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                differ = np.minimum.reduceat(roots[at], new) != np.maximum.reduceat(roots[at], new)
                differ = np.repeat(differ, np.diff(np.append(new, len(v))))
                _link(forest, v[differ], roots[at[differ]], prints[at[differ]])
        return pd.DataFrame(forest.links(), columns=["a", "b"], dtype="int64")

    return run


def _told_once(v: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which members of the groups (equal v, neighbours; mask 0 is empty, mask k flips bit k - 1) to give, so
    that bands at distance 1 and 2 meet. Two such bands share two variants, which differ in the higher
    of the bits flipped from either: of them the one without that bit is told."""
    if not len(v):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    size = np.diff(np.append(first, len(v)))
    codes = codes.astype(np.int64)
    clear = (codes > 0) & ((v >> np.maximum(codes - 1, 0).astype(np.uint64)) & np.uint64(1) == 0)
    higher = clear & (codes > np.repeat(np.minimum.reduceat(codes, first), size))  # has a lower partner
    most = np.repeat(np.maximum.reduceat(np.where(higher, codes, -1), first), size)
    return higher | (codes < most)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1) <= FURTHEST


def _group_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that keep the components of a group whole: from each reached member to those not yet reached."""
    out, left = [], np.arange(len(prints))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = _near(prints[left], prints[x])
            out += [(x, y) for y in left[near].tolist()]
            todo += left[near].tolist()
            left = left[~near]
    return out


def _link(forest: Forest, v: np.ndarray, ids: np.ndarray, prints: np.ndarray) -> None:
    """Adds the links of groups (equal v, neighbours), verified on whole fingerprints, to a spanning forest."""
    if len(v):
        new = np.append(True, v[1:] != v[:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        near = _near(prints, prints[first[group]])
        for a, b in np.unique(np.stack([ids[first[group]], ids], 1)[near & ~new], axis=0).tolist():
            forest.link(a, b)
        # groups of three or more whose first member doesn't reach all
        ends = np.append(first[1:], len(v))
        for g in np.unique(group[~near]).tolist():
            if ends[g] - first[g] > 2:
                own = slice(first[g], ends[g])
                for a, b in _group_links(prints[own]):
                    forest.link(*ids[own][[a, b]].tolist())


def _equal(first: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of one cell's fingerprints with equal bits in the band."""
        _, v, roots, prints = _unpacked(pdf, first)
        order = np.lexsort((roots, v))
        v = v[order]
        same = v[1:] == v[:-1]
        met = np.append(same, False) | np.append(False, same)
        forest = Forest()
        _link(forest, v[met], roots[order][met], prints[order][met])
        return pd.DataFrame(forest.links(), columns=["a", "b"], dtype="int64")

    return run


_PACKED = "cell long, roots binary, prints binary"


def near_links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links between different fingerprints (id, fp) that keep every component whole. Fingerprints
    with equal bits in a band meet first; variants then only link members of different components, so that
    a large group of near copies isn't compared again in all its variants. A link between components found
    before stands between their roots."""
    total, first = distinct.count(), LEAST
    while first < BAND and BUCKET << first < total * len(_masks()):
        first += 1
    dealt = _spread(distinct.withColumn("root", F.col("id")), total, first).mapInArrow(_dealt(first, 0, 1, 0), _PACKED)
    links = scratch.keep(dealt.groupBy("cell").applyInPandas(_equal(first), "a long, b long"), "equal")
    # the first round's links spare the others what they'd tell of the same components
    for turns in ((0,), tuple(range(1, ROUNDS))):
        found = components(links, scratch, f"before{turns[0]}")
        rooted = distinct.join(found, distinct.id == found.node, "left").select(F.coalesce("root", "id").alias("root"), "fp")
        rooted = scratch.keep(rooted, f"rooted{turns[0]}")
        for turn in turns:
            dealt = _spread(rooted, total, first).mapInArrow(_dealt(first, first, ROUNDS, turn), _PACKED)
            links = links.unionAll(scratch.keep(dealt.groupBy("cell").applyInPandas(_collide(first), "a long, b long"), f"links{turn}"))
    return links


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group, with its columns: that with the smallest id; one without
    an id only where the whole group has none. Of a group's rows with that id one stays, the same each run
    as far as their texts differ. Groups never lose a document to another group's equal id."""
    scratch = Scratch(spark)
    # a row's key: 128 bits of id and text, so rows of one key are copies and in one group
    key = [F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))]
    keyed = docs.select(F.struct("*").alias("doc"), *(F.xxhash64(F.lit(k), *key).alias(f"k{k}") for k in (1, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array(map(fingerprint, b.column("text").to_pylist()), pa.binary())], names=["doc_id", "k1", "k2", "fp"])

    rows = keyed.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "k1", "k2", text_bytes("doc.text").alias("text"))
    heads = rows.mapInArrow(run, "doc_id long, k1 long, k2 long, fp binary").groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("head"))
    distinct = scratch.keep(heads.withColumn("id", F.monotonically_increasing_id()), "distinct")
    found = components(near_links(distinct, scratch), scratch)
    groups = distinct.select("id", "head").join(found, distinct.id == found.node, "left").groupBy(F.coalesce("root", "id").alias("root"))
    kept = groups.agg(F.min("head").alias("head")).select("head.k1", "head.k2")
    return keyed.join(kept.hint("merge"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("doc.*")
