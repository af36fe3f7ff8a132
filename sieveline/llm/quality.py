"""Quality of whole texts by positive-unlabelled learning.

Features describe the shape of a text, not its words: shares of character-class trigrams and figures on
repetition, symbols and lengths. A linear scorer is fitted with numpy by the non-negative unbiased risk
estimator: trusted positives (label 1) against unlabelled web text, with the share of positives in the
unlabelled text (the class prior) estimated from the scores of positives and of unlabelled text. A first
scorer comes from a bounded sample of labelled rows (`POSITIVES` + `CALIBRATION`), fitted in one task. Then
all documents, whatever their labels, are the unlabelled text: their scores give the prior, and every task
descends the risk over its documents from the first scorer; the tasks' scorers are averaged by documents.
The output is calibrated to a probability on the sample, each row weighing what it stands for.

Null texts count as empty and get a score like any other; repeated rows are scored each; an empty table
gives an empty result; without training labels of both kinds every score is the prior (0.5 if unknown).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, average, fold, text_bytes
from .labelled import in_one_task, labelled_sample

#: Bounds of the sample of labelled rows: with label 1, and with label 0.
POSITIVES, CALIBRATION = 4_000, 2_000
THRESHOLD = 0.7
#: Texts of one step, and bins of a histogram of scores.
BATCH, BINS = 512, 512

_CLASSES = 10


def _class_table() -> bytes:
    """Class of each byte: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 stop, 7 bar, 8 symbol, 9 beyond ASCII."""
    kind = np.zeros(256, np.uint8)
    kind[128:] = 9
    for c, chars in ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (4, " \t"), (5, "\n\r\x0b\x0c"), (6, ".,;:?'\"-()"), (7, "|"), (8, "!#$%&*+/<=>@[\\]^_`{}~")):
        kind[list(chars.encode())] = c
    return kind.tobytes()


_TABLE = _class_table()
FEATURES = _CLASSES**3 + 10


def features(text: bytes) -> np.ndarray:
    """Shape of a text as float32: square roots of trigram shares, then ten figures."""
    out = np.zeros(FEATURES, np.float32)
    kinds = np.frombuffer(text.translate(_TABLE), np.uint8)
    n = len(kinds)
    if n > 2:
        code = kinds[:-2].astype(np.int16) * 100 + kinds[1:-1] * np.int16(10) + kinds[2:]
        out[:1000] = np.sqrt(np.bincount(code, minlength=1000) / (n - 2))
    words = text.split()
    lines = text.split(b"\n")
    m = max(1, len(words))
    share = np.bincount(kinds, minlength=_CLASSES) / max(1, n)
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    out[1000:] = [again / m, len(set(words)) / m, min(3.0, n / m / 10), share[7] + share[8], share[2], share[3], min(2.0, np.log1p(n) / 10), 1 - len(set(lines)) / len(lines), share[6], share[5] * 10]
    return out


@dataclass
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


class Trainer:
    """Minimises prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)) with the sigmoid loss by Adam; where the
    negative part falls below zero, a step undoes it instead. Weights end with the bias."""

    def __init__(self, w: np.ndarray, prior: float, rate: float, decay: float = 1e-4):
        self.w, self.prior, self.rate, self.decay = w.copy(), prior, rate, decay
        self.m, self.v, self.steps = np.zeros_like(w), np.zeros_like(w), 0

    def step(self, positive: np.ndarray, unlabelled: np.ndarray, weight: np.ndarray | None = None) -> None:
        """`weight` of the unlabelled rows."""
        share = np.full(len(unlabelled), 1 / len(unlabelled)) if weight is None else weight / weight.sum()
        fp, fu = positive @ self.w[:-1] + self.w[-1], unlabelled @ self.w[:-1] + self.w[-1]
        sp, su = _sigmoid(fp), _sigmoid(fu)
        slope_p, slope_u = sp * (1 - sp) / len(fp), su * (1 - su) * share
        minus = float(su @ share) - self.prior * float(sp.mean())
        g_p = np.append(slope_p @ positive, slope_p.sum())
        g_minus = np.append(slope_u @ unlabelled, slope_u.sum()) - self.prior * g_p
        g = (-g_minus if minus < 0 else g_minus - self.prior * g_p) + self.decay * self.w
        self.steps += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.w = self.w - self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, weight: np.ndarray | None = None, seed: int = 7, epochs: int = 12) -> np.ndarray:
    """Weights and bias of a linear scorer of standardised rows."""
    rng = np.random.default_rng(seed)
    weight = np.ones(len(unlabelled)) if weight is None else weight
    trainer, batches = Trainer(np.zeros(positive.shape[1] + 1), prior, 0.01), max(1, len(unlabelled) // BATCH)
    for _ in range(epochs):
        parts = zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches), strict=True)
        for i, j in parts:
            if len(i) and len(j):
                trainer.step(positive[i], unlabelled[j], weight[j])
    return trainer.w


def histogram(scores: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Weight of the scores by bins of their logistic value."""
    return np.bincount(np.minimum((_sigmoid(scores) * BINS).astype(np.int64), BINS - 1), weight, BINS).astype(float)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores, from two histograms: above any score unlabelled rows are
    at least the positives among them, so the share is at most the ratio of both tails; the least ratio
    (each with a margin for chance) over tails that hold enough positives is taken."""
    p, u = (np.cumsum(h[::-1]) / h.sum() for h in (positive, unlabelled))
    chance = 1 / np.sqrt(positive.sum()) + 1 / np.sqrt(unlabelled.sum())
    tail = p >= 0.2
    return float(np.clip(((u[tail] + 0.25 * chance) / p[tail]).min(), 0.02, 0.98))


def calibrate(f: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (score, label): damped Newton steps on standardised
    scores from the labels' share, with a weak penalty so that separable labels keep a finite slope.
    `weight`: how many rows each stands for, so that labels sampled at different rates count by their shares."""
    middle, spread = f.mean(), f.std() + 1e-6
    x = np.stack([(f - middle) / spread, np.ones(len(f))], 1)
    weight = np.ones(len(f)) if weight is None else weight / weight.mean()
    share = np.clip((weight * y).mean(), 1e-3, 1 - 1e-3)
    a, penalty = np.array([0.0, np.log(share / (1 - share))]), np.array([0.05, 0.0])

    def loss(a: np.ndarray) -> float:
        z = x @ a
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + (penalty * a * a).sum() / 2)

    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(penalty) + 1e-6 * np.eye(2), x.T @ (weight * (q - y)) + penalty * a)
        size = 1.0
        while size > 1e-6 and loss(a - size * step) > loss(a):
            size /= 2
        a = a - size * step
    return float(a[0] / spread), float(a[1] - a[0] * middle / spread)


def _with_features(rows: DataFrame) -> DataFrame:
    """Adds the features as packed float16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [features(t).astype("<f2").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("weight"), pa.array(packed, pa.binary())], names=["label", "weight", "features"])

    return rows.select("label", "weight", "text").mapInArrow(run, "label int, weight double, features binary")


def _unpacked(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("features").to_pylist()), "<f2").reshape(-1, FEATURES).astype(np.float32)


def _start(rows: pa.Table) -> tuple[Scorer, bytes, np.ndarray] | None:
    """A scorer of the sample alone, its positives' standardised features, and their scores' histogram.
    For it the sampled rows, weighed back to their shares, are the unlabelled text."""
    y, weight, x = rows.column("label").to_numpy(), rows.column("weight").to_numpy(), _unpacked(rows)
    if not ((y == 1).any() and (y == 0).any()):
        return None
    mean = (weight @ x / weight.sum()).astype(np.float32)
    scale = (np.sqrt(weight @ np.square(x - mean) / weight.sum()) + 1e-3).astype(np.float32)
    x, prior = (x - mean) / scale, 0.5
    for _ in range(2):
        w = fit_pu(x[y == 1], x, prior, weight)
        seen = histogram(x[y == 1] @ w[:-1] + w[-1])
        prior = estimated_prior(seen, histogram(x @ w[:-1] + w[-1], weight))
    return Scorer(mean, scale, w[:-1], float(w[-1]), 1.0, 0.0, prior), x[y == 1].astype("<f2").tobytes(), seen


def _histograms(scorer: Scorer):
    """One histogram of all scores of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS)
        for x, _ in _blocks(batches):
            total += histogram(scorer.raw(x))
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(total)], names=["bin", "n"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """Features of up to BATCH texts, and their number."""
    for b in batches:
        for a in range(0, len(b), BATCH):
            texts = b.column("text").slice(a, BATCH).to_pylist()
            yield np.stack([features(t) for t in texts]), len(texts)


def _descend(scorer: Scorer, positive: bytes):
    """A task's weights after steps over all its texts as unlabelled ones, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = np.frombuffer(positive, "<f2").reshape(-1, FEATURES).astype(np.float32)
        rng, seen = np.random.default_rng(7), 0
        trainer = Trainer(np.append(scorer.weight, scorer.bias), scorer.prior, 0.002)
        for x, n in _blocks(batches):
            trainer.step(known[rng.choice(len(known), min(BATCH, len(known)), replace=False)], (x - scorer.mean) / scorer.scale)
            seen += n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([trainer.w.astype("<f8").tobytes()], pa.binary()), pa.array([float(seen)])], names=["part", "net", "seen"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Scorer:
    """`train`: which doc_id's labels may be learned. Starts from a bounded sample of labelled rows; then
    the prior is estimated from, and the risk descended over, all documents as unlabelled text."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    known = scratch.keep(_with_features(labelled_sample(docs, labels, "quality", train, {0: CALIBRATION, 1: POSITIVES})), "known")
    started = in_one_task(known, _start)
    if started is None:
        share = known.agg((F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("p")).first().p
        prior = 0.5 if share is None else float(np.clip(share, 0.02, 0.98))
        return Scorer(np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), np.zeros(FEATURES), 0.0, 0.0, float(np.log(prior / (1 - prior))), prior)
    scorer, positive, seen = started
    texts = docs.select(text_bytes().alias("text"))
    shared = spark.sparkContext.broadcast((scorer, positive))  # of bounded size
    bins = texts.mapInArrow(lambda b: _histograms(shared.value[0])(b), "bin int, n double").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS rows
    total = np.zeros(BINS)
    for r in bins:
        total[r.bin] = r.n
    scorer.prior = estimated_prior(seen, total) if total.any() else scorer.prior
    shared = spark.sparkContext.broadcast((scorer, positive))
    nets = scratch.keep(texts.mapInArrow(lambda b: _descend(*shared.value)(b), "part long, net binary, seen double"), "nets")
    w = average(nets, scratch)
    if w is not None:
        scorer.weight, scorer.bias = w[:-1], float(w[-1])
    plain = scorer

    def curve(rows: pa.Table) -> tuple[float, float]:
        return calibrate(plain.raw(_unpacked(rows)), rows.column("label").to_numpy().astype(float), rows.column("weight").to_numpy())

    slope, shift = in_one_task(known, curve)
    scorer.slope, scorer.shift = slope, shift
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc (all columns of docs as a struct) and score."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)  # one scorer of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for b in batches:
            got = [s.score(x) for x, _ in _blocks([b])]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], names=["doc", "score"])

    rows = docs.select(F.struct("*").alias("doc"), text_bytes().alias("text"))
    return rows.mapInArrow(run, rows.select("doc", F.lit(0.0).alias("score")).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out ids are never read."""
    held = fold("doc_id", 4) == 2 if held_out is None else held_out
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, ~held)).select("doc.doc_id", "score")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    held = fold("doc_id", 4) == 2
    return score(docs, fit(docs, labels, ~held)).where(F.col("score") >= THRESHOLD).select("doc.*")
