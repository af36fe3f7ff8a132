"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling.

Every word (of a very long one, every overlapping piece) enters as the sum of two inputs: a word vector (words seen in at least `WORD_DOCS` training
documents; others share the unknown vector) and the mean of its character vectors (hashed trigrams and
word beginnings). A window of `WINDOW` words is read in both directions, attention pools the states, and
a logistic layer gives the window's logit. Windows begin every `STRIDE` words, so that any passage of up to
`WINDOW - STRIDE + 1` words lies whole in one; the text's logit is the largest, calibrated to a probability.
Where that is below the threshold but not below `NEAR`, windows beginning at every word are scored. Trained in numpy with Adam on a bounded sample
of labelled documents: first on the windows with the most telling words, then, in further rounds, on
the windows that the network itself finds most toxic (for either label).

Null and empty texts have one empty window; repeated rows are scored each; an empty table gives an empty
result; without training labels of both kinds every score is the training share (0.5 if unknown).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import by_size, fold, release, text_bytes
from .labelled import in_one_task, labelled_sample

#: Bounds of the fitting sample.
TOXIC, CLEAN = 2_000, 4_000
WINDOW, STRIDE, STATE, INPUT = 32, 8, 8, 12
WORDS, WORD_DOCS, TRIGRAMS, BEGINNINGS = 20_000, 4, 4_096, 1 << 16
THRESHOLD, NEAR = 0.7, 0.1
#: Windows formed together, and windows the network reads together; affect memory and speed only.
FORMED, READ = 1 << 15, 512
#: Distinct words whose inputs a worker remembers; affects speed only.
REMEMBERED = 150_000

#: Bytes of a word that stays whole, of the pieces of a longer one, and of their overlap.
LONG, PIECE, OVERLAP = 40, 18, 6
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
Parameters = dict[str, np.ndarray]


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and bytes from 128; those of over LONG bytes in overlapping pieces, so that
    scripts without spaces are read whole."""
    words = text.translate(_LETTERS).split()
    if max(map(len, words), default=0) <= LONG:
        return words
    return [p for w in words for p in (_pieces(w) if len(w) > LONG else (w,))]


def _pieces(word: bytes) -> Iterator[bytes]:
    """Pieces of at most PIECE bytes, each beginning about OVERLAP bytes before the last one's end; UTF-8 characters stay whole."""
    a = 0
    while len(word) - a > PIECE:
        b = _begin(word, a + PIECE)
        yield word[a:b]
        a = _begin(word, b - OVERLAP)
    yield word[a:]


def _begin(word: bytes, at: int) -> int:
    """Where the character that holds this byte begins."""
    return next((k for k in range(at, at - 4, -1) if word[k] & 0xC0 != 0x80), at)


def _characters(word: bytes) -> list[int]:
    """Rows of a word's trigrams and of its beginnings of 4 to 8 bytes."""
    w = b"^" + word + b"$"
    return [zlib.crc32(w[i : i + 3]) % TRIGRAMS for i in range(max(1, len(w) - 2))] + [TRIGRAMS + zlib.crc32(word[:k]) % BEGINNINGS for k in range(4, min(8, len(word)) + 1)]


def _character_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all words one after the other, where each word's begin, and how many it has."""
    flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a in range(0, len(words), 10_000):
        rows = [_characters(w) for w in words[a : a + 10_000]]
        counts.append(np.fromiter(map(len, rows), np.int64, len(rows)))
        flat.append(np.fromiter((r for x in rows for r in x), np.int32, int(counts[-1].sum())))
    n = np.concatenate(counts)
    return np.concatenate(flat), np.cumsum(n) - n, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _gru(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, back: bool, tape: list | None = None) -> np.ndarray:
    """States (time, window, STATE) from input gates (time, window, 3*STATE)."""
    t_all, b, h = gates.shape[0], gates.shape[1], STATE
    state, out = np.zeros((b, h), np.float32), np.zeros((t_all, b, h), np.float32)
    for t in range(t_all - 1, -1, -1) if back else range(t_all):
        g, inner = gates[t], state @ u
        zr = _sigmoid(g[:, : 2 * h] + inner[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(g[:, 2 * h :] + r * inner[:, 2 * h :])
        new = n + z * (state - n)
        m = mask[t][:, None]
        if tape is not None:
            tape.append((t, state, z, r, n, inner[:, 2 * h :], m))
        state = state + m * (new - state)
        out[t] = state
    return out


def _gru_back(grad: np.ndarray, tape: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of u, from gradients of the states."""
    h = STATE
    g_gates, g_u, carried = np.zeros((*grad.shape[:2], 3 * h), np.float32), np.zeros_like(u), np.zeros(grad.shape[1:], np.float32)
    for t, state, z, r, n, inner_n, m in reversed(tape):
        carried = carried + grad[t]
        new = carried * m
        g_n = new * (1 - z) * (1 - n * n)
        g_z = new * (state - n) * z * (1 - z)
        g_r = g_n * inner_n * r * (1 - r)
        g_inner = np.concatenate([g_z, g_r, g_n * r], 1)
        g_gates[t] = np.concatenate([g_z, g_r, g_n], 1)
        g_u += state.T @ g_inner
        carried = carried * (1 - m) + new * z + g_inner @ u.T
    return g_gates, g_u


def _pool(p: Parameters, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    act = np.tanh(states @ p["attend"])
    e = np.where(mask > 0, act @ p["query"], -1e9)
    w = np.exp(e - e.max(0)) * mask
    w = w / np.maximum(w.sum(0), 1e-9)
    pooled = (w[:, :, None] * states).sum(0)
    return act, w, pooled, pooled @ p["out"] + p["bias"][0]


def _logits(p: Parameters, gates: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Window logits from both directions' input gates (time, window, 6*STATE)."""
    k = 3 * STATE
    states = np.concatenate([_gru(gates[:, :, :k], mask, p["u_f"], False), _gru(gates[:, :, k:], mask, p["u_b"], True)], 2)
    return _pool(p, states, mask)[3]


def _step(p: Parameters, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[Parameters, np.ndarray]:
    """Gradients of the mean log loss for inputs (time, window, INPUT); also of the inputs."""
    k, tapes = 3 * STATE, ([], [])
    gates = x @ p["w"] + p["b"]
    states = np.concatenate([_gru(gates[:, :, :k], mask, p["u_f"], False, tapes[0]), _gru(gates[:, :, k:], mask, p["u_b"], True, tapes[1])], 2)
    act, w, pooled, logit = _pool(p, states, mask)
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g: Parameters = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
    g_pooled = d[:, None] * p["out"]
    g_w = (states * g_pooled).sum(2)
    g_e = w * (g_w - (w * g_w).sum(0))
    g_act = g_e[:, :, None] * p["query"] * (1 - act * act)
    g["query"] = np.einsum("tb,tbk->k", g_e, act)
    g["attend"] = np.einsum("tbi,tbj->ij", states, g_act)
    g_states = w[:, :, None] * g_pooled + g_act @ p["attend"].T
    gf, g["u_f"] = _gru_back(np.ascontiguousarray(g_states[:, :, :STATE]), tapes[0], p["u_f"])
    gb, g["u_b"] = _gru_back(np.ascontiguousarray(g_states[:, :, STATE:]), tapes[1], p["u_b"])
    g_gates = np.concatenate([gf, gb], 2)
    g["w"], g["b"] = np.einsum("tbi,tbj->ij", x, g_gates), g_gates.sum((0, 1))
    return g, g_gates @ p["w"].T


@dataclass
class Model:
    vocabulary: dict[bytes, int]  # from 1; 0 is the unknown word
    p: Parameters
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    _seen: dict[bytes, int] = field(default_factory=dict)
    _gates: np.ndarray | None = None

    def inputs(self, words: list[bytes]) -> np.ndarray:
        return _inputs(self.p, np.array([self.vocabulary.get(w, 0) for w in words], np.int64), *_character_table(words))

    def index(self, words: list[bytes]) -> np.ndarray:
        """Rows of the remembered input gates; row 0 is padding."""
        seen = self._seen
        new = [w for w in dict.fromkeys(words) if w not in seen]
        if new:
            while self._rows + len(new) > len(self._gates):
                self._gates = np.concatenate([self._gates, np.zeros_like(self._gates)])
            self._gates[self._rows : self._rows + len(new)] = self.inputs(new) @ self.p["w"] + self.p["b"]
            seen.update(zip(new, range(self._rows, self._rows + len(new)), strict=True))
            self._rows += len(new)
        return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))

    def raw(self, texts: list[bytes], stride: int = STRIDE) -> np.ndarray:
        """Largest logit of each text's windows that begin every `stride` words."""
        if self._gates is None or len(self._seen) > REMEMBERED:
            self._seen, self._gates, self._rows = {}, np.zeros((4096, 6 * STATE), np.float32), 1
        largest = np.full(len(texts), -np.inf, np.float32)
        for rows, of in windows([self.index(words_of(t)) for t in texts], stride):
            np.maximum.at(largest, of, read(self.p, self._gates, rows))
        return largest

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for a, b in by_size(texts, [len(t) + 100 for t in texts], 500_000):
            f = self.raw(texts[a:b])
            p = _sigmoid(self.slope * f.astype(np.float64) + self.shift)
            near = np.flatnonzero((p >= NEAR) & (p < THRESHOLD)).tolist()
            if near:
                f[near] = self.raw([texts[a + k] for k in near], 1)
                p = _sigmoid(self.slope * f.astype(np.float64) + self.shift)
            out[a:b] = p
        return out


def read(p: Parameters, gates: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of windows given as rows of the gates; row 0 is padding."""
    parts = [rows[a : a + READ].T for a in range(0, len(rows), READ)]
    return np.concatenate([_logits(p, gates[x], (x > 0).astype(np.float32)) for x in parts]) if parts else np.zeros(0, np.float32)


def windows(indexes: list[np.ndarray], stride: int = STRIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What window_rows gives, in parts of at most about FORMED windows; a long text is cut so that no window is lost."""
    pieces, of, n = [], [], 0
    for k, x in enumerate(indexes):
        starts = max(1, -(-(len(x) - WINDOW) // stride) + 1)
        for a in range(0, starts, FORMED):
            here = min(FORMED, starts - a)
            if pieces and n + here > FORMED:
                rows, own = window_rows(pieces, stride)
                yield rows, np.array(of)[own]
                pieces, of, n = [], [], 0
            pieces.append(x[a * stride : (a + here - 1) * stride + WINDOW])
            of.append(k)
            n += here
    if pieces:
        rows, own = window_rows(pieces, stride)
        yield rows, np.array(of)[own]


def window_rows(indexes: list[np.ndarray], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts as rows of word indexes padded with 0, and the text of each."""
    n = np.array([len(x) for x in indexes])
    count = np.maximum(1, -(-(n - WINDOW) // stride) + 1)
    of = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.concatenate([[0], np.cumsum(n)])
    flat = np.concatenate([*indexes, np.zeros(WINDOW, np.int32)]).astype(np.int32)
    at = (begin[of] + nth * stride)[:, None] + np.arange(WINDOW)
    return np.where(at < begin[of + 1][:, None], flat[np.minimum(at, len(flat) - 1)], np.int32(0)), of


def _telling(docs: list[np.ndarray], y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of word numbers: those for the vocabulary, most frequent first, and log odds of occurring in a toxic
    rather than a clean document (0 outside the vocabulary)."""
    seen = np.zeros((2, n), np.int64)
    for words, toxic in zip(docs, y.tolist(), strict=True):
        seen[toxic, np.unique(words)] += 1
    total = seen.sum(0)
    top = np.argsort(-total, kind="stable")[:WORDS]
    top = top[total[top] >= WORD_DOCS]
    odds = np.zeros(n)
    odds[top] = np.log((seen[1, top] + 1) / (max(1, int(y.sum())) + 2)) - np.log((seen[0, top] + 1) / (max(1, int((1 - y).sum())) + 2))
    return top, odds


def fit_model(texts: list[bytes], y: np.ndarray, weight: np.ndarray | None = None, seed: int = 11, rounds: int = 3, epochs: int = 3, rate: float = 0.02) -> Model:
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {b"": 0}  # 0 is padding
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    distinct = list(number)
    top, telling = _telling(docs, y, len(number))
    vocabulary = {distinct[k]: i + 1 for i, k in enumerate(top.tolist())}
    normal = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    characters = np.concatenate([normal(TRIGRAMS, INPUT) * np.float32(0.3), np.zeros((BEGINNINGS, INPUT), np.float32)])
    p = {"words": normal(len(vocabulary) + 1, INPUT) * np.float32(0.3), "characters": characters, "w": normal(INPUT, 6 * STATE), "b": np.zeros(6 * STATE, np.float32), "u_f": normal(STATE, 3 * STATE), "u_b": normal(STATE, 3 * STATE), "attend": normal(2 * STATE, STATE), "query": normal(STATE), "out": normal(2 * STATE), "bias": np.zeros(1, np.float32)}
    model = Model(vocabulary, p)
    known = np.zeros(len(distinct), np.int64)
    known[top] = np.arange(1, len(top) + 1)
    del number
    flat, begin, count = _character_table(distinct)
    rows, of = (np.concatenate(x) for x in zip(*windows(docs), strict=True))
    value = np.concatenate([np.sort(telling[rows[a : a + 4096]], 1)[:, -3:].sum(1) for a in range(0, len(rows), 4096)])
    moments: dict[str, list] = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    step = 0
    for turn in range(rounds):
        if turn:
            gates = _inputs(p, known, flat, begin, count) @ p["w"] + p["b"]
            value = read(p, gates, rows)
        # the most telling window of each document, and for clean ones two more at random
        order = np.lexsort((-value, of))
        first = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
        clean = np.flatnonzero(y[of] == 0)
        chosen = np.unique(np.concatenate([first, rng.choice(clean, min(len(clean), 2 * len(texts)), replace=False)]))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(chosen), max(min(60, len(chosen) // 8), len(chosen) // 256, 1)):
                own, at = np.unique(rows[part].T, return_inverse=True)
                at = at.reshape(rows.shape[1], len(part))
                mask = (own[at] > 0).astype(np.float32)
                n = count[own]
                of_own = np.repeat(np.arange(len(own)), n)
                chars = flat[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                x = _inputs(p, known[own], chars, np.cumsum(n) - n, n)
                g, g_x = _step(p, x[at], mask, y[of[part]].astype(np.float32))
                g_own = np.zeros_like(x)
                np.add.at(g_own, at.reshape(-1), (g_x * mask[:, :, None]).reshape(-1, INPUT))
                g["words"], g["characters"] = np.zeros_like(p["words"]), np.zeros_like(p["characters"])
                np.add.at(g["words"], known[own], g_own)
                np.add.at(g["characters"], chars, (g_own / n[:, None].astype(np.float32))[of_own])
                step += 1
                for k, m in moments.items():
                    m[0] += np.float32(0.1) * (g[k] - m[0])
                    m[1] += np.float32(0.01) * (g[k] * g[k] - m[1])
                    p[k] -= np.float32(rate / (1 + 0.01 * step) / (1 - 0.9**step)) * m[0] / (np.sqrt(m[1] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    from .quality import calibrate

    f = np.concatenate([model.raw(texts[a:b]) for a, b in by_size(texts, [len(t) + 100 for t in texts], 500_000)]).astype(np.float64)
    model.slope, model.shift = calibrate(f, y.astype(float), weight)
    model._seen, model._gates = {}, None
    return model


def _inputs(p: Parameters, known: np.ndarray, chars: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Word vector plus mean character vector of each word."""
    if not len(known):
        return np.zeros((0, INPUT), np.float32)
    return p["words"][known] + np.add.reduceat(p["characters"][chars], begin, axis=0) / count[:, None].astype(np.float32)


def _fit_rows(rows: pa.Table) -> Model:
    y, weight = (rows.column(c).to_numpy() for c in ("label", "weight"))
    if len(set(y.tolist())) < 2:
        return Model({}, {}, constant=float(y.mean()) if len(y) else 0.5)
    return fit_model(rows.column("text").to_pylist(), y.astype(np.int64), weight)


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    """The model of a bounded sample of the labelled training rows, fitted in one task."""
    return in_one_task(labelled_sample(docs, labels, "toxic", train, {0: CLEAN, 1: TOXIC}), _fit_rows)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc (all columns of docs as a struct) and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a model of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(m.score(b.column("text").to_pylist()), pa.float64())], names=["doc", "score"])
        b = None
        release()

    rows = docs.select(F.struct("*").alias("doc"), text_bytes().alias("text"))
    return rows.mapInArrow(run, rows.select("doc", F.lit(0.0).alias("score")).schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out ids are never read."""
    held = fold("doc_id", 3) == 1 if held_out is None else held_out
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, ~held)).select("doc.doc_id", "score")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the network does not reject, with their columns."""
    return score(docs, fit(docs, labels, ~(fold("doc_id", 3) == 1))).where(F.col("score") < THRESHOLD).select("doc.*")
