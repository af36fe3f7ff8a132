"""Removal of byte strings that occur again anywhere in a corpus, by suffix and common-prefix arrays.

A byte goes if a string of `length` bytes that covers it begins at another place too, judged on the
input. Equal strings meet as follows.

1. Every window (string of `length` bytes) is put under the least hash of its k-byte strings; equal
   windows have the same least hash. Neighbouring windows with the same one form a segment. Segments
   travel as hashes; those whose least hash occurs once in the corpus have no partner and end here.
2. Segments of a least hash that are all equal are copies of each other and end here too: all their
   windows repeat. Of other least hashes equal segments are read once, and those of two or more places
   stand in their shard's text twice, as two copies are enough to show that all their windows repeat.
3. Least hashes are dealt to shards; a shard's segments are joined to one text, sorted by external
   induced sorting (`suffix_sort`), and the windows whose suffix shares `length` bytes with a neighbour
   are the repeated ones.
4. A least hash with more than `HOT` different segments is split before that: its segments are cut
   again under least hashes of longer strings, copies collapse again, and so on. The last strings have
   `length - 1` bytes: pieces that share one differ by a byte before and a byte behind it, so that no
   group can hold more than 2 * 256 + 256 * 256 different ones, whatever the corpus.

Joins whose sides grow with the corpus are merge joins at every size. Documents are known by id and
content, so copies spread over all tasks, and repeated rows (same id, same text) get the same ranges.

Null texts count as empty. Copies of a text are judged as separate documents, as are repeated rows.
Texts shorter than `length` keep all bytes. An empty table gives an empty result; other columns are
ignored here and kept by `remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, by_size, text_bytes
from .suffix_sort import repeated_at

LENGTH = 400
#: Different segments of one least hash beyond which it is split, and bytes that a shard sorts.
HOT, SHARD_BYTES = 4_096, 3_000_000
#: Bytes hashed at the first cut, and those that the strings of further cuts leave free of a window of LENGTH bytes.
FIRST, _SLACK = 32, (92, 23, 5, 1)


def _hashed(length: int, level: int) -> int:
    """Length of the strings hashed at a cut of windows of any length."""
    return min(FIRST, (length + 1) // 2) if not level else max(1, length - max(1, _SLACK[level - 1] * length // LENGTH))


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(31))


def _hashes(data: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of the k bytes from each position on, by doubling."""
    part = _mix(data.astype(np.uint64) + np.uint64(salt + 1))
    out, width, done = None, 1, 0
    while True:
        if k & width:
            if out is None:
                out, done = part, width
            else:
                n = len(data) - done - width + 1
                out = out[:n] * np.uint64(0x9E3779B97F4A7C15) + _mix(part[done : done + n])
                done += width
        if 2 * width > k:
            return _mix(out)
        part = _mix(part[:-width] * np.uint64(0xD6E8FEB86659FD93) + part[width:])
        width *= 2


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of `width` values."""
    n = len(values) - width + 1
    if width == 1:
        return values
    blocks = -(-len(values) // width)
    x = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    x[: len(values)] = values
    x = x.reshape(blocks, width)
    ahead = np.minimum.accumulate(x, axis=1).reshape(-1)
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def cut(texts: list[bytes], length: int, k: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Segments of texts: text number, first window, number of windows, least hash, and 1 if windows of the
    segment itself may be equal: then the least hash leaves a window at its start and the next still has it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    windows = len(data) - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = _hashes(data, k, salt)
    least = _sliding_least(hashes, length - k + 1)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)[:windows]
    inside = np.arange(windows) + length <= ends[of]
    new = np.append(True, (least[1:] != least[:-1]) | (of[1:] != of[:-1]))
    at = np.flatnonzero(new & inside)
    stop = np.minimum(np.append(np.flatnonzero(new), windows)[np.searchsorted(np.flatnonzero(new), at) + 1], ends[of[at]] - length + 1)
    leaves = np.append(0, np.cumsum(hashes[:windows] == least))
    inner = leaves[np.maximum(stop - 1, at)] > leaves[at]
    return of[at], at - (ends - sizes)[of[at]], stop - at, least[at].view(np.int64), inner.astype(np.int64)


def _digest(data: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SEGMENTS = "d long, t long, start long, n long, m long, r long, s1 long, s2 long"


def segments(docs: DataFrame, length: int) -> DataFrame:
    """A row per segment of documents (d, t, text)."""
    k = _hashed(length, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, t, texts = (b.column(c).to_pylist() for c in ("d", "t", "text"))
            for x, y in by_size(texts, [len(t) for t in texts], 1_000_000):
                of, start, n, m, r = cut(texts[x:y], length, k)
                own = [_digest(texts[x + o][a : a + c + length - 1]) for o, a, c in zip(of.tolist(), start.tolist(), n.tolist(), strict=True)]
                row = (of + x).tolist()
                columns = [[d[i] for i in row], [t[i] for i in row], start, n, m, r, [s[0] for s in own], [s[1] for s in own]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["d", "t", "start", "n", "m", "r", "s1", "s2"])

    return docs.mapInArrow(run, _SEGMENTS)


def _runs(windows: np.ndarray) -> list[list[int]]:
    """Sorted window numbers as [first, behind the last) pairs."""
    if not len(windows):
        return []
    new = np.flatnonzero(np.append(True, np.diff(windows) > 1))
    return np.stack([windows[new], windows[np.append(new[1:], len(windows)) - 1] + 1], 1).tolist()


_FOUND = "s1 long, s2 long, runs array<array<long>>"
_FOUND_ARROW = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("runs", pa.list_(pa.list_(pa.int64())))])


def _sort_shard(length: int, memory: int | None = None):
    """Sorts all pieces of a task as shards of some size each; whole groups stay together, as a task's
    shard ends only between groups. `memory`: tuples that a sorter's queue holds before it spills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []  # a second copy follows its first one
        size, group, own = 0, None, set()

        def shard() -> pa.RecordBatch:
            sizes = np.array([len(p[2]) + 1 for p in held], np.int64)
            begin = np.cumsum(sizes) - sizes
            with tempfile.TemporaryDirectory() as folder:
                text = np.memmap(f"{folder}/text", np.uint16, "w+", shape=(int(sizes.sum()),))
                for a, n, (_, _, data) in zip(begin.tolist(), sizes.tolist(), held, strict=True):
                    text[a : a + n - 1] = np.frombuffer(data, np.uint8)
                    text[a : a + n - 1] += 1  # 0 ends a piece
                hits: list[np.ndarray] = []
                repeated_at(text, length, folder, hits.append, memory=memory)
                del text
            found = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            cuts = np.searchsorted(found, np.append(begin, begin[-1] + sizes[-1]))
            rows, last = [], None
            for p, s, a, b in zip(held, begin.tolist(), cuts[:-1], cuts[1:], strict=True):
                own = found[a:b] - s
                own = own[own <= len(p[2]) - length]  # behind the last window, prefixes run into the next piece
                if len(own) and p is not last:
                    rows.append({"s1": p[0], "s2": p[1], "runs": _runs(own)})
                last = p
            return pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)

        for b in batches:
            for m, s1, s2, w, data in zip(*(b.column(c).to_pylist() for c in ("m", "s1", "s2", "w", "data")), strict=True):
                if m != group and size > SHARD_BYTES:
                    yield shard()
                    held, size = [], 0
                if m != group:
                    group, own = m, set()
                if (s1, s2) not in own:
                    own.add((s1, s2))
                    held += [(s1, s2, data)] * min(w, 2)
                    size += len(data) * min(w, 2)
        if held:
            yield shard()

    return run


def _cut_again(length: int, k: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p1, p2, m, w, texts = (b.column(c).to_pylist() for c in ("s1", "s2", "m", "w", "data"))
            for x, y in by_size(texts, [len(t) for t in texts], 1_000_000):
                of, start, n, least, r = cut(texts[x:y], length, k, salt)
                data = [texts[x + o][a : a + c + length - 1] for o, a, c in zip(of.tolist(), start.tolist(), n.tolist(), strict=True)]
                own, row = [_digest(d) for d in data], (of + x).tolist()
                group = _mix(np.array([m[i] for i in row], np.int64).view(np.uint64) ^ least.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in row], pa.int64()) for v in (p1, p2)] + [pa.array(start), pa.array(n), pa.array(r), pa.array(group), pa.array([s[0] for s in own], pa.int64()), pa.array([s[1] for s in own], pa.int64()), pa.array([w[i] for i in row], pa.int64()), pa.array(data, pa.binary())], names=["p1", "p2", "start", "n", "r", "m", "s1", "s2", "w", "data"])

    return run


def _repeating(pieces: DataFrame, scratch: Scratch, length: int, level: int) -> DataFrame:
    """(s1, s2, runs): the repeated windows of different pieces (m, s1, s2, w, data) that share m; a piece
    stands for w places."""
    spark = scratch.spark
    sizes = scratch.keep(pieces.groupBy("m").agg(F.count("*").alias("c")), f"sizes{level}")
    hot = sizes.where(F.col("c") > HOT).select("m") if level <= len(_SLACK) else sizes.where("false").select("m")
    any_hot = not hot.isEmpty()
    cold = pieces.join(hot, "m", "left_anti") if any_hot else pieces
    total = cold.agg(F.sum(F.length("data") * F.least("w", F.lit(2))).alias("n")).first().n or 0
    tasks = max(1, min(-(-total // (4 * SHARD_BYTES)), 100_000))
    found = scratch.keep(cold.repartition(tasks, "m").sortWithinPartitions("m").select("m", "s1", "s2", "w", "data").mapInArrow(_sort_shard(length), _FOUND), f"found{level}")
    if not any_hot:
        return found
    k = _hashed(length, level)
    parts = scratch.keep(pieces.join(hot, "m", "left_semi").select("s1", "s2", "m", "w", "data").mapInArrow(_cut_again(length, k, level), "p1 long, p2 long, start long, n long, r long, m long, s1 long, s2 long, w long, data binary"), f"parts{level}")
    once = scratch.keep(parts.groupBy("m", "s1", "s2").agg(F.sum("w").alias("w"), F.max("r").alias("r"), F.min("data").alias("data")), f"once{level}")
    again = once.groupBy("m").agg(F.sum("w").alias("c"), F.max("r").alias("r")).where("c >= 2 or r = 1").select("m")
    below = _repeating(once.join(again, "m", "left_semi").select("m", "s1", "s2", "w", "data"), scratch, length, level + 1)
    back = parts.select("p1", "p2", "start", "s1", "s2").join(below, ["s1", "s2"])
    back = back.select("p1", "p2", F.transform("runs", lambda r: F.array(r[0] + F.col("start"), r[1] + F.col("start"))).alias("runs"))
    deeper = back.groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.flatten(F.collect_set("runs")).alias("runs"))
    return found.unionByName(scratch.keep(deeper, f"deeper{level}"))


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """(d, t, ranges): byte ranges to remove of each document that has any.
    docs: d, t, text (binary); d and t tell documents apart unless they are copies with one id."""
    segs = scratch.keep(segments(docs.where(F.length("text") >= length), length), "segments")
    different = "min(s1) <> max(s1) or min(s2) <> max(s2) or max(r) = 1"
    again = segs.groupBy("m").agg(F.count("*").alias("c"), F.expr(different).alias("many")).where("c >= 2 or many").select("m", "many")
    kept = scratch.keep(segs.join(again.hint("merge"), "m").select("d", "t", "start", "n", "m", "s1", "s2", "many"), "repeated")
    scratch.drop("segments")
    # every different segment is read from one of its places
    wanted = kept.where("many").groupBy("m", "s1", "s2").agg(F.count("*").alias("w"), F.min(F.struct("d", "t", "start", "n")).alias("at"))
    wanted = wanted.select("m", "s1", "s2", "w", "at.*").groupBy("d", "t").agg(F.collect_list(F.struct("m", "s1", "s2", "w", "n", "start")).alias("own"))
    read = docs.where(F.length("text") >= length).join(wanted.hint("merge"), ["d", "t"]).select("text", F.explode("own").alias("o"))
    data = F.expr(f"substring(text, cast(o.start + 1 as int), cast(o.n + {length - 1} as int))").alias("data")
    pieces = scratch.keep(read.select("o.m", "o.s1", "o.s2", "o.w", data), "pieces")  # a repeated row gives its segments again
    found = _repeating(pieces, scratch, length, 1)
    scratch.drop("pieces")
    ranges = kept.where("many").join(found.hint("merge"), ["s1", "s2"])
    ranges = ranges.select("d", "t", F.transform("runs", lambda r: F.array(r[0] + F.col("start"), r[1] + F.col("start") + length - 1)).alias("ranges"))
    copies = kept.where("not many").select("d", "t", F.array(F.array("start", F.col("start") + F.col("n") + length - 1)).alias("ranges"))
    out = scratch.keep(ranges.unionByName(copies).groupBy("d", "t").agg(F.flatten(F.collect_set("ranges")).alias("ranges")), "ranges")
    scratch.drop_all_but("ranges")
    return out


def _merged(ranges: list | None) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _without(text: bytes, spans: list[list[int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _keys() -> tuple[Column, Column]:
    """d and t of a document: its id (a fixed long for none) and a hash of its bytes."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("d"), F.xxhash64(text_bytes()).alias("t")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    scratch = Scratch(spark)
    rows = docs.select(*_keys(), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    joined = rows.join(repeated_ranges(rows, scratch, length).hint("merge"), ["d", "t"], "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
                spans = _merged(ranges)
                out.append((doc, len(text), sum(y - x for x, y in spans), len(spans), hashlib.sha256(_without(text, spans)).hexdigest()))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """The documents with their texts cut, all columns kept. Removed runs of fewer than `words` words stay.
    A cut within a character drops its other bytes too; null texts stay null; n_chars, where there is one,
    is counted anew."""
    scratch, names = Scratch(spark), docs.columns
    ranges = repeated_ranges(docs.select(*_keys(), text_bytes().alias("text")), scratch, length)
    # the documents as one struct, so that none of their columns can clash
    joined = docs.select(F.struct("*").alias("doc"), *_keys()).join(ranges.hint("merge"), ["d", "t"], "left").select("doc", "ranges")
    at = names.index("text")

    def shortened(text: str | None, ranges: list | None) -> str | None:
        if not text or not ranges:
            return text
        data = text.encode()
        return _without(data, [(a, b) for a, b in _merged(ranges) if len(data[a:b].split()) >= words]).decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.column("doc").flatten()
            cols[at] = pa.array(map(shortened, cols[at].to_pylist(), b.column("ranges").to_pylist()), cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
