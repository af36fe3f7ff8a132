"""Suffix and common-prefix arrays of texts larger than memory, by external induced sorting.

The text lies in a memory-mapped file. The suffixes that begin a rise after a fall (here: seeds) are
sorted by sorting and naming their substrings and, where names repeat, by recursion on the string of
names; all arrays of the text's length are mapped to files. From the seeds a forward scan induces the falling suffixes and a backward scan the rising ones:
each scanned suffix hands its left neighbour, as a tuple of position and common-prefix length, to a
disk-backed priority queue keyed by first symbol; tuples of a key leave in the order they came, which is
their sorted order. The common prefix of two tuples of a key is one more than the least common prefix
scanned between their senders, so it needs no text access. Queues are popped and pushed in bulk, and
spill their tuples to one file once they hold more than `memory` of them.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples handled together, and names up to which a string of names is sorted in memory.
BULK, BASE = 1 << 17, 1 << 22
#: Tuples that a queue holds before it spills them.
MEMORY = 1 << 18
_FAR = np.iinfo(np.int64).max


class DiskQueue:
    """A priority queue of (position, prefix) tuples with few distinct keys, popped key by key."""

    def __init__(self, folder: str, name: str, memory: int, kind: type):
        self.memory, self.kind, self.held, self.end, self.spills = memory, np.dtype(kind), 0, 0, 0
        self.chunks: dict[int, deque] = {}
        self.file = open(os.path.join(folder, name), "w+b")  # noqa: SIM115
        os.unlink(self.file.name)  # lives as long as it is open

    def push(self, key: int, rows: np.ndarray) -> None:
        """Appends tuples (an array of two rows) behind those of the key."""
        self.chunks.setdefault(key, deque()).append(rows)
        self.held += rows.shape[1]
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for chunks in self.chunks.values():
            for k, c in enumerate(chunks):
                if isinstance(c, np.ndarray):
                    self.file.seek(self.end)
                    self.file.write(np.ascontiguousarray(c, self.kind).tobytes())
                    chunks[k] = (self.end, c.shape[1])
                    self.end += 2 * self.kind.itemsize * c.shape[1]
        self.held, self.spills = 0, self.spills + 1

    def _load(self, chunk: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(chunk, np.ndarray):
            self.held -= chunk.shape[1]
            return chunk
        self.file.seek(chunk[0])
        return np.frombuffer(self.file.read(2 * self.kind.itemsize * chunk[1]), self.kind).reshape(2, -1).astype(np.int64)

    def pop(self, key: int, last: bool = False) -> np.ndarray | None:
        """The key's first tuples (or, with `last`, its last ones), about BULK of them; None if it has none."""
        chunks, got, size = self.chunks.get(key), [], 0
        while chunks and size < BULK:
            got.append(self._load(chunks.pop() if last else chunks.popleft()))
            size += got[-1].shape[1]
        return np.concatenate(got[::-1] if last else got, axis=1) if got else None

    def close(self) -> None:
        self.file.close()


class _Least:
    """Least values of ranges of one array."""

    def __init__(self, values: np.ndarray):
        self.levels, step = [values], 1
        while 2 * step <= len(values):
            a = self.levels[-1]
            self.levels.append(np.minimum(a[:-step], a[step:]))
            step *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(values[a..b]) for each pair; very large where a > b."""
        out = np.full(len(a), _FAR)
        ok = np.flatnonzero(a <= b)
        level = np.frexp((b[ok] - a[ok] + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = ok[level == k]
            out[own] = np.minimum(self.levels[k][a[own]], self.levels[k][b[own] - (1 << k) + 1])
        return out


class _Scan:
    """Hands the left neighbours of scanned suffixes to a queue, with their common prefixes."""

    def __init__(self, queue: DiskQueue):
        self.queue, self.last, self.batch = queue, {}, 0
        self.numbers: list[int] = []  # batches whose least prefix no later batch undercuts
        self.least: list[int] = []

    def feed(self, prefixes: np.ndarray, left: np.ndarray, symbols: np.ndarray, taken: np.ndarray) -> None:
        at = np.flatnonzero(taken)
        if len(at):
            at = at[np.argsort(symbols[at], kind="stable")]
            keys, ranges, end = symbols[at], _Least(prefixes), len(prefixes) - 1
            head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            tail = np.append(head[1:], len(at)) - 1
            value = 1 + ranges.of(np.append(0, at[:-1] + 1), at)
            rest = ranges.of(at[tail] + 1, np.full(len(tail), end))
            upto = ranges.of(np.zeros(len(head), np.int64), at[head])
            for h, t, r, u, key in zip(head.tolist(), tail.tolist(), rest.tolist(), upto.tolist(), keys[head].tolist(), strict=True):
                if key in self.last:
                    batch, since = self.last[key]
                    k = bisect_left(self.numbers, batch + 1)
                    value[h] = 1 + min(since, u, self.least[k] if k < len(self.least) else _FAR)
                else:
                    value[h] = 0
                self.last[key] = (self.batch, r)
                self.queue.push(key, np.stack([left[at[h : t + 1]], value[h : t + 1]]))
        low = int(prefixes.min())
        while self.least and self.least[-1] >= low:
            self.least.pop()
            self.numbers.pop()
        self.numbers.append(self.batch)
        self.least.append(low)
        self.batch += 1


def _run(text: np.ndarray, at: int) -> int:
    """How often the symbol at `at` repeats from there on."""
    n, step = 1, 64
    while at + n < len(text):
        some = np.asarray(text[at + n : at + n + step])
        other = np.flatnonzero(some != text[at])
        if len(other):
            return n + int(other[0])
        n, step = n + len(some), min(step * 2, BULK)
    return n


def _rising(text: np.ndarray, rises: np.ndarray) -> None:
    """Sets whether each suffix is less than the next one; the last isn't."""
    n = len(text)
    later = False  # of the suffix after the chunk
    for b in range(n, 0, -BULK):
        a = max(0, b - BULK)
        x = np.asarray(text[a : min(n, b + 1)]).astype(np.int64)
        step = np.sign(np.diff(x))
        if b == n:
            step = np.append(step, -1)
        known = np.flatnonzero(step)
        nxt = np.searchsorted(known, np.arange(len(step)))
        inside = nxt < len(known)
        rises[a:b] = np.where(inside, step[known[np.minimum(nxt, len(known) - 1)]] > 0, later) if len(known) else later
        later = bool(rises[a])


def in_memory(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes (with the suffix before) of a short string, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    levels, step, order = [rank.astype(np.int32 if n < 1 << 30 else np.int64)], 1, np.argsort(rank)
    while n and rank[order[-1]] < n - 1:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, sorted_key[1:] != sorted_key[:-1]))
        levels.append(rank.astype(levels[0].dtype))
        step *= 2
    prefix = np.zeros(n, np.int64)
    if n > 1:
        i, j, run = order[1:], order[:-1], np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            a, b = i + run, j + run
            ok = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
            run[same] += 1 << k
        prefix[1:] = run
    return order, prefix


def _array(folder: str, name: str, size: int, kind: type = np.int64) -> np.ndarray:
    """A memory-mapped array of zeros; its file lives as long as the array."""
    if not size:
        return np.zeros(0, kind)
    at = os.path.join(folder, name)
    out = np.memmap(at, kind, "w+", shape=(size,))
    os.unlink(at)
    return out


def _seeds(rises: np.ndarray, folder: str, depth: int, kind: type) -> np.ndarray:
    """Positions where a rise begins after a fall, ascending."""
    n = len(rises)
    parts = [(a, min(n - 1, a + BULK)) for a in range(0, n - 1, BULK)]
    counts = [int(np.count_nonzero(rises[a + 1 : b + 1] & ~rises[a:b])) for a, b in parts]
    out, at = _array(folder, f"places{depth}", sum(counts), kind), 0
    for (a, b), m in zip(parts, counts, strict=True):
        out[at : at + m] = a + 1 + np.flatnonzero(rises[a + 1 : b + 1] & ~rises[a:b])
        at += m
    return out


def _by_symbol(text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols at the places, ascending, and how many places have each."""
    seen: dict[int, int] = {}
    for a in range(0, len(places), BULK):
        for s, m in zip(*(x.tolist() for x in np.unique(text[places[a : a + BULK]], return_counts=True)), strict=True):
            seen[s] = seen.get(s, 0) + m
    keys = np.array(sorted(seen), np.int64)
    return keys, np.array([seen[k] for k in keys.tolist()], np.int64)


def _own(text: np.ndarray, seeds: np.ndarray, symbols: list[int]) -> Iterator[np.ndarray]:
    """For each symbol the numbers of the seeds that begin with it."""
    if len(symbols) == 1 or len(seeds) > MEMORY and len(symbols) < 512:  # one pass a symbol, nothing held
        for c in symbols:
            yield np.concatenate([a + np.flatnonzero(text[seeds[a : a + BULK]] == c) for a in range(0, len(seeds), BULK)])
    else:
        first = np.asarray(text[seeds])
        order = np.argsort(first, kind="stable")
        yield from np.split(order, np.searchsorted(first[order], symbols[1:]))


def _names(text: np.ndarray, rises: np.ndarray, seeds: np.ndarray, names: np.ndarray, symbols: list[int]) -> int:
    """Sets the names of the seeds' substrings in their order; gives how many names there are. A substring
    runs to the next seed inclusive; symbols count with their kind. Seeds are taken one first symbol at a time."""
    n, m, made = len(text), len(seeds), 0
    width = max(2, 2 * int(np.max(text)) + 2).bit_length()
    per = 63 // width
    for own in _own(text, seeds, symbols):
        start, end = seeds[own].astype(np.int64), np.where(own + 1 < m, seeds[np.minimum(own + 1, m - 1)].astype(np.int64), n - 1)
        group, active, offset = np.zeros(len(own), np.int64), np.arange(len(own)), 0
        while len(active):
            key = np.zeros(len(active), np.int64)
            for k in range(offset, offset + per):
                p = start[active] + k
                inside = p <= end[active]
                p = np.minimum(p, n - 1)
                key = (key << width) | np.where(inside, 2 * text[p].astype(np.int64) + rises[p] + 1, 0)
            order = np.lexsort((key, group[active]))
            g, k = group[active][order], key[order]
            new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
            # a group's members stay within its span: its number plus the members before
            begin = np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1]), np.arange(len(g)), 0))
            place = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            group[active[order]] = g + place - begin
            many = np.diff(np.append(np.flatnonzero(new), len(g)))[np.cumsum(new) - 1] > 1
            offset += per
            rest = active[order][many]
            active = rest[start[rest] + offset <= end[rest]]
        distinct, names_here = np.unique(group, return_inverse=True)
        names[own] = names_here + made
        made += len(distinct)
    return made


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Common prefixes of suffix pairs that share at least `known` symbols and differ soon after."""
    run, n, active = known.copy(), len(text), np.arange(len(a))
    while len(active):
        p, q = a[active] + run[active], b[active] + run[active]
        ok = (p < n) & (q < n)
        ok[ok] = text[p[ok]] == text[q[ok]]
        active = active[ok]
        run[active] += 1
    return run


def scan_suffixes(text: np.ndarray, folder: str, memory: int | None = None, base: int | None = None, depth: int = 0, spilled: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the greatest to the least, in batches: positions, and the common prefix of each
    with the suffix before it in this order (0 for the first). The text itself is always sorted by
    induction; a string of names is from `base` names down sorted in memory. `spilled` gathers how often
    each queue spilled."""
    n, memory, base = len(text), MEMORY if memory is None else memory, BASE if base is None else base
    if depth and n <= base or n < 3:
        order, prefix = in_memory(np.asarray(text))
        yield order[::-1], np.append(0, prefix[::-1][:-1])[:n]
        return
    rises = _array(folder, f"rises{depth}", n, bool)
    _rising(text, rises)
    kind = np.int32 if n < 1 << 30 else np.int64
    seeds = _seeds(rises, folder, depth, kind)
    m = len(seeds)
    seed_symbols, seed_counts = _by_symbol(text, seeds)
    reduced = _array(folder, f"names{depth}", m, kind)
    made = _names(text, rises, seeds, reduced, seed_symbols.tolist()) if m else 0
    del rises
    ordered, shared, matched = (_array(folder, f"{x}{depth}", m, kind) for x in ("seeds", "shared", "matched"))
    if made == m:
        for a in range(0, m, BULK):
            ordered[reduced[a : a + BULK]] = seeds[a : a + BULK]
    else:
        at, before = m, None
        for pos, prefix in scan_suffixes(reduced, folder, memory=memory, base=base, depth=depth + 1, spilled=spilled):
            for c in range(0, len(pos), BULK):
                own_pos, own_prefix = pos[c : c + BULK], prefix[c : c + BULK]
                at -= len(own_pos)
                ordered[at : at + len(own_pos)] = seeds[own_pos[::-1]]
                # the prefix of a suffix with the greater one before it belongs to that greater one
                own = np.append(own_pos[0] if before is None else before, own_pos[:-1])
                start, upto = at + 1, np.minimum(own + own_prefix, m)
                far = np.where(upto < m, seeds[np.minimum(upto, m - 1)].astype(np.int64), n) - seeds[own]
                stop = min(m, at + len(own_pos) + 1)
                matched[start:stop] = far[::-1][: stop - start]
                before = int(own_pos[-1])
    if m > 1:
        for a in range(1, m, BULK):
            b = min(m, a + BULK)
            shared[a:b] = _extend(text, ordered[a:b].astype(np.int64), ordered[a - 1 : b - 1].astype(np.int64), np.minimum(matched[a:b], n).astype(np.int64))
    del reduced, seeds, matched
    symbols = np.unique(np.concatenate([np.unique(text[a : a + BULK]) for a in range(0, n, BULK)])).tolist()
    falling = DiskQueue(folder, f"falling{depth}", memory, kind)
    kept = DiskQueue(folder, f"kept{depth}", memory, kind)
    scan = _Scan(falling)
    seed_ends = np.append(0, np.cumsum(seed_counts))
    falling.push(int(text[n - 1]), np.array([[n - 1], [0]], np.int64))
    scan.last[int(text[n - 1])] = (-1, 0)  # sent by the end of the text, which shares nothing
    for c in symbols:
        last = -1
        while (rows := falling.pop(c)) is not None:
            pos, prefix = rows
            kept.push(c, rows)
            left = pos - 1
            s = np.asarray(text[np.maximum(left, 0)]).astype(np.int64)
            last = int(pos[-1])
            scan.feed(prefix, left, s, (pos > 0) & (s >= c))
        lo, hi = seed_ends[np.searchsorted(seed_symbols, [c, c + 1])].tolist()
        for a in range(lo, hi, BULK):
            pos, prefix = (x[a : min(hi, a + BULK)].astype(np.int64) for x in (ordered, shared))
            if a == lo:
                prefix[0] = min(_run(text, last), _run(text, int(pos[0]))) if last >= 0 else 0
            left = pos - 1
            scan.feed(prefix, left, np.asarray(text[left]).astype(np.int64), np.ones(len(pos), bool))
    falling.close()
    del ordered, shared
    rising = DiskQueue(folder, f"rising{depth}", memory, kind)
    scan = _Scan(rising)
    for c in reversed(symbols):
        last = -1
        while (rows := rising.pop(c)) is not None:
            pos, prefix = rows
            left = pos - 1
            s = np.asarray(text[np.maximum(left, 0)]).astype(np.int64)
            last = int(pos[-1])
            scan.feed(prefix, left, s, (pos > 0) & (s <= c))
            yield pos, prefix
        after = None  # prefix of the falling suffix scanned last with the one below it
        while (rows := kept.pop(c, last=True)) is not None:
            pos, below = rows[0][::-1], rows[1][::-1]
            if after is None:
                after = min(_run(text, last), _run(text, int(pos[0]))) if last >= 0 else 0
            prefix, after = np.append(after, below[:-1]), int(below[-1])
            left = pos - 1
            s = np.asarray(text[np.maximum(left, 0)]).astype(np.int64)
            scan.feed(prefix, left, s, (pos > 0) & (s < c))
            yield pos, prefix
    if spilled is not None:
        spilled += [falling.spills, kept.spills, rising.spills]
    rising.close()
    kept.close()


def repeated_at(text: np.ndarray, length: int, folder: str, each: Callable[[np.ndarray], None], **how) -> None:
    """Calls `each` with positions whose suffix shares at least `length` symbols with another's."""
    held: tuple[int, bool] | None = None
    for pos, prefix in scan_suffixes(text, folder, **how):
        if not len(pos):
            continue
        far = prefix >= length
        if held is not None and far[0] and not held[1]:
            each(np.array([held[0]]))
        hit = far | np.append(far[1:], False)
        each(pos[hit])
        held = (int(pos[-1]), bool(hit[-1]))
