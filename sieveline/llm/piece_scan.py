"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

A text of up to `CHUNK` normalised characters is one chunk, and is encoded by the library at once. A longer
one is split into chunks at any character. What crosses a boundary is a token: the boundary's states are the
tokens that begin before it and end at or after it. A chunk's transfer matrix holds, for every state at its
begin and at its end, the best score of the tokens between them (missing: impossible). Matrices combine
associatively by max-plus products, `FAN` neighbours a task and Spark round; going down the rounds again
fixes the best state at every boundary, and each chunk then traces its own tokens back, independently. The
library takes no part in that.

For unigram models tokens score their log-probabilities. For merge (BPE) models a token sequence is the
encoding exactly if every two neighbours merge to themselves, so such steps score 0 and others don't
exist. Where no vocabulary piece spans the begin of a word, words can't interact: the paths of a chunk's
whole words are those of each word alone, found once per different word by the same lattice (by merge models,
which let one path through a word, depth first), and only the cut words depend on the boundary states. If a scan finds no path (a model outside these two kinds), the
document is encoded by the library whole; so are texts with NUL, which the library ends strings at.

Null texts count as empty; repeated rows are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, by_size

CHUNK = 8_192
#: Matrices that one task combines; words, and tokens with what may follow, that a worker remembers (speed only).
FAN, WORDS, PAIRS = 64, 300_000, 20_000
#: Bytes of texts or ids handled together.
TOGETHER = 2_000_000
_SPACE = "▁"
#: A token that crosses or ends at a boundary: characters before it, characters from it on. The start of a text or word has no token.
State = tuple[str, str]
FRESH: State = ("", "")
Matrix = dict[State, dict[State, float]]


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score = {}, {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[sp.id_to_piece(i)], self.score[sp.id_to_piece(i)] = i, sp.get_score(i)
        self.longest = max(map(len, self.ids))
        self.kinds = dict.fromkeys((p for p in self.ids if len(p) > 1), 1)  # of strings: 1 a token, 2 a longer token may begin so, 3 both
        for p in {p[:n] for p in self.ids for n in range(2, len(p))}:
            self.kinds[p] = self.kinds.get(p, 0) + 2
        scores = [self.score[p] for p in self.ids if len(p) > 1]
        self.merges = all(s == int(s) for s in scores)  # ranks of merges are whole numbers
        self.words_apart = not any(_SPACE in p[1:] and p.strip(_SPACE) for p in self.ids)
        self.unknown = min(self.score.values()) - 10
        self._fits: dict[str, dict[str, float | None]] = {}
        self._words: dict[str, bytes] = {}

    def raw(self, char: str) -> list[int]:
        """ids of a character that has no piece."""
        got = [self.library.piece_to_id(f"<0x{b:02X}>") for b in char.encode()]
        return got if all(self.library.is_byte(i) for i in got) else [self.library.unk_id()]

    def to_ids(self, tokens: list[str]) -> list[int]:
        ids = self.ids
        try:
            return [ids[t] for t in tokens]
        except KeyError:  # a character without a piece
            return [i for t in tokens for i in ([ids[t]] if t in ids else self.raw(t))]

    def merged(self, text: str) -> list[str]:
        """Merges of a short text, best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids), default=(0, None))
            if at is None:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def follows(self, before: str) -> dict[str, float | None]:
        """Scores of tokens after another ('' for the begin), as far as they are known."""
        known = self._fits.get(before)
        if known is None:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            known = self._fits[before] = {}
        return known

    def step(self, before: str, token: str) -> float | None:
        """Score of a token after another; None if it can't follow."""
        if not self.merges:
            return self.score.get(token, self.unknown)
        return 0.0 if self.merged(before + token) == ([before, token] if before else [token]) else None

    def tokens_at(self, text: str, at: int) -> list[str]:
        """Tokens that may begin at a place, shorter ones first."""
        found, kinds, n = [text[at]], self.kinds, at + 2
        while n <= len(text):
            part = text[at:n]
            kind = kinds.get(part, 0)
            if kind & 1:
                found.append(part)
            if kind < 2:
                break
            n += 1
        return found

    def paths(self, text: str, first: int, end: int, entry: State) -> list[dict[str, tuple[float, str]]]:
        """By place from `first` on, all reachable tokens (from `entry`, beginning before `end`) that end
        there, with the best score and the token before. text[first:] begins right at the boundary."""
        open_: list[dict[str, tuple[float, str]]] = [{} for _ in range(end + self.longest + 1 - first)]
        start = len(entry[1])
        open_[start][entry[0] + entry[1]] = (0.0, "")
        for at in range(start, end - first):
            here = open_[at]
            if not here:
                continue
            tokens = self.tokens_at(text, first + at)
            for before, (score, _) in here.items():
                known = self.follows(before)
                for token in tokens:
                    if token in known:
                        s = known[token]
                    else:
                        s = known[token] = self.step(before, token)
                    if s is not None:
                        there = open_[at + len(token)]
                        if token not in there or score + s > there[token][0]:
                            there[token] = (score + s, before)
        return open_

    def exits(self, text: str, first: int, end: int, entry: State) -> dict[State, float]:
        """States at `end` and their scores."""
        out: dict[State, float] = {}
        for stop, tokens in enumerate(self.paths(text, first, end, entry)[end - first :], end):
            for token, (score, _) in tokens.items():
                if stop - len(token) < end:
                    cut = len(token) - (stop - end)
                    out[token[:cut], token[cut:]] = max(score, out.get((token[:cut], token[cut:]), -np.inf))
        return out

    def entries(self, text: str, at: int) -> list[State]:
        """Tokens that may cross or end at position `at`."""
        found = []
        for a in range(max(0, at - self.longest), at):
            found += [(t[: at - a], t[at - a :]) for t in self.tokens_at(text, a) if a + len(t) >= at]
        return found

    def cuts(self, text: str, first: int, end: int) -> list[int]:
        """The first and the last begin of a word after `first` and before `end`, if there are any."""
        if not self.words_apart:
            return []
        found = [k for k in range(first + 1, end) if text[k] == _SPACE and text[k - 1] != _SPACE] if end - first < 4 * self.longest else None
        if found is None:
            a = first + 1
            while a < end and not (text[a] == _SPACE and text[a - 1] != _SPACE):
                a += 1
            b = end - 1
            while b > a and not (text[b] == _SPACE and text[b - 1] != _SPACE):
                b -= 1
            found = [a, b] if a < end else []
        return [found[0], found[-1]] if found else []

    def transfer(self, text: str, first: int, end: int, is_first: bool) -> Matrix:
        starts = [FRESH] if is_first else self.entries(text, first)
        cuts = self.cuts(text, first, end)
        if not cuts:
            return {s: e for s in starts if (e := self.exits(text, first, end, s))}
        out: Matrix = {}
        tail, middle = self.exits(text, cuts[1], end, FRESH), self._between(text, *cuts)
        for s in starts:
            into = self.exits(text, first, cuts[0], s)
            whole = max((v for k, v in into.items() if not k[1]), default=None)
            if whole is not None:
                out[s] = {k: v + whole + middle for k, v in tail.items()}
        return out

    def _between(self, text: str, begin: int, end: int) -> float:
        """Best score of whole words; only unigram models tell words apart by it."""
        return 0.0 if self.merges else sum(max(self.exits(w, 0, len(w), FRESH).items(), key=lambda x: (not x[0][1], x[1]))[1] for w in _words(text[begin:end]))

    def word_ids(self, word: str) -> bytes:
        """ids of a whole word (little-endian uint32), by the lattice."""
        ids = self._words.get(word)
        if ids is None:
            if len(self._words) >= WORDS:
                self._words.clear()
            got = self.to_ids(self._only(word) if self.merges else self._best(word))
            ids = self._words[word] = struct.pack(f"<{len(got)}I", *got)
        return ids

    def _best(self, word: str) -> list[str]:
        """Tokens of a whole word's best path."""
        reached = self.paths(word, 0, len(word), FRESH)
        last = reached[len(word)]
        return _traced(reached, len(word), max(last, key=lambda t: last[t][0]), 0)

    def _only(self, word: str) -> list[str]:
        """Tokens of a whole word's path by a merge model, where every path through the word is its encoding:
        from each state the lattice goes on by the longest token first, and by others where that ends nowhere."""
        tokens, at, end, before = [], 0, len(word), ""
        open_ = [self.tokens_at(word, 0)] if word else []
        dead: set[tuple[int, str]] = set()
        while at < end:
            known, todo = self._fits.get(before), open_[-1]
            if known is None:
                known = self.follows(before)
            while todo:
                token = todo.pop()
                if token in known:
                    s = known[token]
                else:
                    s = known[token] = self.step(before, token)
                if s is not None and not (dead and (at, token) in dead):
                    tokens.append(token)
                    before, at = token, at + len(token)
                    if at < end:
                        open_.append(self.tokens_at(word, at))
                    break
            else:
                open_.pop()
                if not tokens:
                    raise ValueError("no path through a word")
                at -= len(before)
                dead.add((at, before))
                tokens.pop()
                before = tokens[-1] if tokens else ""
        return tokens

    def trace(self, text: str, first: int, end: int, entry: State, leave: State) -> list[int]:
        """ids of the tokens that begin in the chunk, given its boundary states."""
        return self.packed(text, first, end, entry, leave).tolist()

    def packed(self, text: str, first: int, end: int, entry: State, leave: State) -> np.ndarray:
        """The same ids as uint32."""
        cuts = self.cuts(text, first, end)
        if not cuts:
            return np.asarray(self.to_ids(self._back(text, first, end, entry, leave)), "<u4")
        into = self.exits(text, first, cuts[0], entry)
        best = max((k for k in into if not k[1]), key=lambda k: into[k])
        parts = [_packed(self.to_ids(self._back(text, first, cuts[0], entry, best)))]
        known = self._words
        for word in _words(text[cuts[0] : cuts[1]]):
            parts.append(known.get(word) or self.word_ids(word))
        parts.append(_packed(self.to_ids(self._back(text, cuts[1], end, FRESH, leave))))
        return np.frombuffer(b"".join(parts), "<u4")

    def _back(self, text: str, first: int, end: int, entry: State, leave: State) -> list[str]:
        return _traced(self.paths(text, first, end, entry), end - first + len(leave[1]), leave[0] + leave[1], len(entry[1]))


def _traced(reached: list[dict[str, tuple[float, str]]], at: int, token: str, start: int) -> list[str]:
    """Tokens of the best path from `start` to a token that ends at a place."""
    out = []
    while at > start:
        out.append(token)
        at, token = at - len(token), reached[at][token][1]
    return out[::-1]


def _words(text: str) -> list[str]:
    """Words, each from its run of spaces on."""
    return re.findall(f"{_SPACE}+[^{_SPACE}]*", text)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of two transfer matrices."""
    out: Matrix = {}
    for s, mids in a.items():
        row: dict[State, float] = {}
        for m, x in mids.items():
            for e, y in b.get(m, {}).items():
                row[e] = max(row.get(e, -np.inf), x + y)
        if row:
            out[s] = row
    return out


def combined(matrices: list[Matrix]) -> Matrix:
    """Product of neighbours in order, as a tree."""
    while len(matrices) > 1:
        matrices = [product(matrices[i], matrices[i + 1]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def best_ends(matrix: Matrix) -> tuple[State, State] | None:
    """Begin and end state of a whole text's best path; None if there is no path."""
    ends = {e: v for e, v in matrix.get(FRESH, {}).items() if not e[1]}
    return (FRESH, max(ends, key=lambda e: ends[e])) if ends else None


def fix_states(matrices: list[Matrix], ends: tuple[State, State] | None = None) -> list[tuple[State, State]] | None:
    """Begin and end state of every chunk on the best path between two states (of a whole text, if they
    aren't given); None if there is no path."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([product(now[i], now[i + 1]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    ends = ends or best_ends(levels[-1][0])
    if ends is None:
        return None
    fixed = [ends]
    for level in levels[-2::-1]:
        down = []
        for k, (s, e) in enumerate(fixed):
            if 2 * k + 1 >= len(level):
                down.append((s, e))
                continue
            a, b = level[2 * k].get(s, {}), level[2 * k + 1]
            mid = max((m for m in a if e in b.get(m, {})), key=lambda m: a[m] + b[m][e])
            down += [(s, mid), (mid, e)]
        fixed = down
    return fixed


_LOADED: dict[str, Lattice] = {}


def lattice(path: str) -> Lattice:
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


_OUT = "row long, doc_id long, n_chars long, n_chunks int, ids binary, text_crc long"
_CHUNKS = "row long, doc_id long, n_chars long, n_chunks int, text_crc long, chunk int, piece string, first int, end int"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _small(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `TOGETHER` bytes of a column, as Python objects take far more than Arrow's."""
    for b in batches:
        for x, y in by_size(range(len(b)), pc.binary_length(b.column(column)).fill_null(0).to_pylist(), TOGETHER):
            yield b.slice(x, y - x)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, column: str) -> Iterator[list[tuple]]:
    """Neighbouring rows that are equal in the first so many columns, read by slices of a column's bytes."""
    rows = (r for b in _small(batches, column) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for _, group in groupby(rows, key=lambda r: r[:keys]):
        yield list(group)


def _tables(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about `TOGETHER` bytes."""
    schema, held, size = _arrow(ddl), [], 0
    for r in rows:
        held.append(r)
        size += sum(100 if v is None or isinstance(v, int) else len(v) for v in r)
        if size >= TOGETHER:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _by(df: DataFrame, *keys: str) -> DataFrame:
    """Chunks dealt by some columns, which go first, and in order."""
    return df.select(*keys, *(c for c in df.columns if c not in keys)).repartition(*keys).sortWithinPartitions(*keys, "chunk")


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _narrow(ids: list[int] | np.ndarray) -> bytes:
    """ids on their way to their document: a byte that tells their width, then as few bytes as hold the largest."""
    x = np.asarray(ids, "<u4")
    return b"\2" + x.astype("<u2").tobytes() if not len(x) or x.max() < 1 << 16 else b"\4" + x.tobytes()


def _wide(data: bytes) -> bytes:
    """Little-endian uint32 ids of `_narrow`."""
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4").tobytes()


def _boundaries(matrices: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """(row, chunk, states) of every chunk from (row, chunk, matrix): products of `FAN` neighbours a task,
    round by round up to one matrix a text, and the states of the boundaries round by round down again.
    Texts without a path have null states."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _groups(batches, 2, "matrix")
        return _tables(((g[0][0], g[0][1], pickle.dumps(combined([pickle.loads(r[3]) for r in g]))) for g in groups), schema)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [best_ends(pickle.loads(m)) for m in b.column("matrix").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), pa.array([f and pickle.dumps(f) for f in found], pa.binary())], names=["row", "chunk", "states"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for g in _groups(batches, 2, "matrix"):
                ends = g[0][4]
                fixed = fix_states([pickle.loads(r[3]) for r in g], pickle.loads(ends)) if ends else [None] * len(g)
                yield from ((r[0], r[2], f and pickle.dumps(f)) for r, f in zip(g, fixed, strict=True))

        return _tables(rows(), states)

    above = F.floor(F.col("chunk") / FAN).cast("int").alias("above")
    schema, states, levels = "row long, chunk int, matrix binary", "row long, chunk int, states binary", [matrices]
    while most > 1:
        own = _by(levels[-1].select("row", above, "chunk", "matrix"), "row", "above")
        levels.append(scratch.keep(own.mapInArrow(up, schema), f"level{len(levels)}"))
        most = -(-most // FAN)
    fixed = levels[-1].mapInArrow(top, states)
    for level in levels[-2::-1]:
        both = level.select("row", above, "chunk", "matrix").join(fixed.withColumnRenamed("chunk", "above"), ["row", "above"])
        fixed = _by(both, "row", "above").mapInArrow(down, states)
    return fixed


def encode_pieces(docs: DataFrame, scratch: Scratch, path: str, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, n_chars, n_chunks, ids (binary, little-endian uint32), text_crc of every document."""

    def read(batches: Iterator[pa.RecordBatch], long: bool) -> Iterator[pa.RecordBatch]:
        """Texts of one chunk with their ids; or the chunks of the long ones."""
        m, schema = lattice(path), _arrow(_CHUNKS if long else _OUT)
        for b in _small(batches):
            out = []
            for row, doc, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                plain = m.library.normalize(text) if len(text) > chunk and "\0" not in text else ""
                if (len(plain) > chunk) != long:
                    continue
                own = {"row": row, "doc_id": doc, "n_chars": len(text), "text_crc": zlib.crc32(text.encode())}
                if not long:
                    out.append(own | {"n_chunks": 1, "ids": m.library.EncodeAsNumpy(text).astype("<u4").tobytes()})
                    continue
                starts = range(0, len(plain), chunk)
                for k, a in enumerate(starts):
                    c, z = min(a + chunk, len(plain)), max(0, a - m.longest)
                    out.append(own | {"n_chunks": len(starts), "chunk": k, "piece": plain[z : c + m.longest], "first": a - z, "end": c - z})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # ids of one-chunk texts go on as they are made; only long texts' chunks are written
    whole = rows.mapInArrow(lambda b: read(b, False), _OUT)
    parts = scratch.keep(rows.where(F.length("text") > chunk).mapInArrow(lambda b: read(b, True), _CHUNKS), "chunks")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(path)
        for b in _small(batches, "piece"):
            made = [pickle.dumps(m.transfer(t, a, e, k == 0)) for t, a, e, k in zip(*(b.column(c).to_pylist() for c in ("piece", "first", "end", "chunk")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), pa.array(made, pa.binary())], names=["row", "chunk", "matrix"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(path)
        for b in _small(batches, "piece"):
            got = [_narrow(m.packed(t, a, e, *pickle.loads(s))) if s else None for t, a, e, s in zip(*(b.column(c).to_pylist() for c in ("piece", "first", "end", "states")), strict=True)]
            plain = [None if g is not None else t[a:e] for g, t, a, e in zip(got, *(b.column(c).to_pylist() for c in ("piece", "first", "end")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(got, pa.binary()), pa.array(plain, pa.string())], names=[*kept, "ids", "plain"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's ids, which one row holds as its text did."""

        def rows() -> Iterator[tuple]:
            for g in _groups(batches, 1, "ids"):
                parts = [r[6] for r in g]
                if None in parts:  # no path: the normalised chunks together, by the library
                    ids = _packed(lattice(path).library.encode("".join(r[7] for r in g).replace(_SPACE, " ").removeprefix(" ")))
                else:
                    ids = b"".join(map(_wide, parts))
                yield *g[0][:4], ids, g[0][4]

        return _tables(rows(), _OUT)

    kept = ["row", "doc_id", "n_chars", "n_chunks", "text_crc", "chunk"]
    most = parts.agg(F.max("n_chunks")).first()[0]
    if most is None:
        return whole
    matrices = scratch.keep(parts.select("row", "chunk", "piece", "first", "end").mapInArrow(transfers, "row long, chunk int, matrix binary"), "matrices")
    ready = parts.join(_boundaries(matrices, most, scratch), ["row", "chunk"]).select(*kept, "piece", "first", "end", "states")
    traced = ready.mapInArrow(trace, "row long, doc_id long, n_chars long, n_chunks int, text_crc long, chunk int, ids binary, plain string")
    return whole.unionByName(_by(traced, "row").mapInArrow(join, _OUT))


def decode_ids(path: str, data: bytes) -> str:
    """The text of little-endian uint32 ids."""
    return lattice(path).library.decode(np.frombuffer(data, "<u4").astype(np.int32))


def piece_round_trip(spark: SparkSession, docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, n_chunks, n_tokens, ids_crc32, round_trip (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, "ids"):
            ids = b.column("ids").to_pylist()
            same = [zlib.crc32(decode_ids(path, x).encode()) == c for x, c in zip(ids, b.column("text_crc").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_chars"), b.column("n_chunks"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_chars", "n_chunks", "n_tokens", "ids_crc32", "round_trip"])

    coded = encode_pieces(docs, Scratch(spark), path, chunk).select("doc_id", "n_chars", "n_chunks", "ids", "text_crc")
    return coded.mapInArrow(run, "doc_id long, n_chars long, n_chunks int, n_tokens long, ids_crc32 long, round_trip boolean")
