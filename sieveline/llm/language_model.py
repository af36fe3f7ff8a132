"""Log-bilinear language model scores.

Tokens are ASCII-lower-cased words and one end per text. Token counts over all training rows give a base
(add-0.1 unigram) score. The neural model predicts a token's class from the two tokens before it: their
classes' vectors, each under its position's weights, sum to a predicted vector whose products with the
classes' vectors, plus biases, are the classes' scores. The `WORDS` most frequent tokens are classes of
their own; every other token, seen or not, belongs to the class of its ending (a hash of its last three
characters, `ENDINGS` classes), so that no token is the same to the network as all others. It is trained in
numpy by noise-contrastive estimation on the whole training rows in `ROUNDS` rounds: every task on its own
rows from the same start, averaged by rows seen. Of a sum of two scores the exponential is a product, so one
matrix product gives the exact normalisers of all contexts, and a token's log-probability is a sum of
looked-up terms. A token without a class of its own has its class's probability times its add-0.1 share of
the class, with one share for all tokens of the class never seen: the model sums to one.

Counts of the `HEAD` most frequent tokens travel to every task; the texts' other tokens are joined with
the counts, each once per text. Null and empty texts consist of the end. Repeated rows are scored (and
counted) each; an empty table gives an empty result; other columns are ignored. How the table is dealt to
tasks changes the network slightly, not the counts or the base score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, average, fold

WORDS, ENDINGS, WIDTH, HEAD = 1_024, 1_024, 24, 1 << 18
NOISE, BATCH, RATE, ROUNDS = 64, 4_096, 0.05, 2
SMOOTH = 0.1


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts one after the other, each one's text, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, of = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = pc.greater(pc.binary_length(words), 0)
    if pc.sum(some).as_py() != len(words):
        words, of = words.filter(some), of[some.to_numpy(zero_copy_only=False)]
    return words, of, np.bincount(of, minlength=len(texts))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c over all rows of docs; the end is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, _, _ = tokens(b.column("text"))
            got = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([got.field("values"), pa.array([""], pa.string())]), pa.concat_arrays([got.field("counts").cast(pa.int64()), pa.array([len(b)], pa.int64())])], names=["token", "c"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "token string, c long")
    return rows.groupBy("token").agg(F.sum("c").alias("c")).where("c > 0")


def _ending(token: str) -> int:
    """Class of a token's last three characters; the same as `_ending_of` in Spark."""
    return zlib.crc32(token[-3:].encode()) % ENDINGS


def _ending_of(token: Column) -> Column:
    return (F.crc32(F.right(token, F.lit(3)).cast("binary")) % ENDINGS).cast("int")


def ending_classes(words: pa.Array) -> np.ndarray:
    """Ending of each word, each different one looked up once."""
    coded = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    own = np.array([_ending(w) for w in coded.dictionary.to_pylist()], np.int64)
    return own[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)


@dataclass
class Net:
    """Vectors of context classes (the last is the beginning), weights of the two positions, class vectors and biases."""

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    classes: np.ndarray
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.near, self.far, self.classes, self.bias]

    def packed(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype("<f8").tobytes()

    def unpacked(self, data: bytes) -> Net:
        flat, at, out = np.frombuffer(data, "<f8"), 0, []
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return Net(*out)


def start_net(share: np.ndarray, seed: int = 5) -> Net:
    rng, k = np.random.default_rng(seed), len(share)
    small = lambda *s: rng.standard_normal(s) * 0.1
    return Net(small(k + 1, WIDTH), np.ones(WIDTH) + small(WIDTH), np.ones(WIDTH) * 0.5 + small(WIDTH), small(k, WIDTH), np.log(share))


class Trainer:
    """Noise-contrastive steps by Adagrad; the noise is drawn by the classes' shares, common to a batch."""

    def __init__(self, net: Net, share: np.ndarray, seed: int):
        self.net, self.share, self.rng = Net(*(p.astype(np.float32) for p in net.parts())), share, np.random.default_rng(seed)
        self.seen = [np.full_like(p, 1e-2) for p in self.net.parts()]
        self.log_noise = np.log(NOISE * share).astype(np.float32)

    def step(self, c1: np.ndarray, c2: np.ndarray, target: np.ndarray) -> None:
        n, w = self.net, len(target)
        noise = self.rng.choice(len(self.share), NOISE, p=self.share)
        r1, r2, aim, drawn = n.context.take(c1, 0), n.context.take(c2, 0), n.classes.take(target, 0), n.classes.take(noise, 0)
        guess = r1 * n.near + r2 * n.far
        own = (guess * aim).sum(1) + n.bias[target] - self.log_noise[target]
        other = guess @ drawn.T
        other += n.bias[noise]
        other -= self.log_noise[noise]
        g_own = (_logistic(own) - 1) / np.float32(w)
        g_other = _logistic(other)
        g_other /= np.float32(w)
        g_guess = g_own[:, None] * aim + g_other @ drawn
        grads = [np.zeros_like(p) for p in n.parts()]
        _add(grads[0], c1, g_guess * n.near)
        _add(grads[0], c2, g_guess * n.far)
        grads[1], grads[2] = (g_guess * r1).sum(0), (g_guess * r2).sum(0)
        _add(grads[3], target, g_own[:, None] * guess)
        _add(grads[3], noise, g_other.T @ guess)
        grads[4] = (np.bincount(target, g_own, len(self.share)) + np.bincount(noise, g_other.sum(0), len(self.share))).astype(np.float32)
        for p, s, g in zip(n.parts(), self.seen, grads, strict=True):
            g *= np.float32(np.sqrt(w))
            s += g * g
            p -= np.float32(RATE) * g / np.sqrt(s)


def _logistic(x: np.ndarray) -> np.ndarray:
    """Of each value, in its place: no large temporaries."""
    np.maximum(x, -30, out=x)
    np.minimum(x, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds each value to its row."""
    order = np.argsort(rows.astype(np.uint16) if len(into) <= 1 << 16 else rows, kind="stable")  # short keys are sorted by digits
    own = rows[order]
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    into[own[cut]] += np.add.reduceat(values.take(order, 0), cut, axis=0)


@dataclass
class Classes:
    """The head's tokens, most frequent first, the place of the end among them, and each one's class: its own
    place, or `own` and more by its ending. The class after the last one stands before a text."""

    head: pa.Array
    end: int
    own: int

    def __post_init__(self):
        self.of_head = np.append(np.arange(self.own), self.own + ending_classes(self.head[self.own :]))

    @property
    def count(self) -> int:
        return self.own + ENDINGS

    def sequences(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """For the texts' tokens with their ends: place in the head (-1 beyond), text, class, the two classes
        before; then the words themselves and their places among the tokens."""
        words, of, n = tokens(texts)
        rank = pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.arange(len(words)) + of
        ranks = np.full(len(words) + len(n), self.end, np.int64)
        ranks[at] = rank
        text = np.repeat(np.arange(len(n)), n + 1)
        own = self.of_head[ranks]
        tail = np.flatnonzero(rank < 0)
        own[at[tail]] = self.own + ending_classes(words.take(pa.array(tail)))
        begin = self.count
        c1, c2 = np.append(begin, own[:-1])[: len(own)], np.append([begin, begin], own[:-2])[: len(own)]
        first = np.cumsum(n + 1) - n - 1
        c1[first], c2[first] = begin, begin
        c2[first[n > 0] + 1] = begin
        return ranks, text, own, c1, c2, words, at


def _train(classes: Classes, share: np.ndarray, net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer, seen = Trainer(net.unpacked(net.packed()), share, 3), 0
        for b in batches:
            for a in range(0, len(b), 500):
                _, _, own, c1, c2, _, _ = classes.sequences(b.column("text")[a : a + 500])
                order = trainer.rng.permutation(len(own))
                for x in range(0, len(own), BATCH):
                    k = order[x : x + BATCH]
                    trainer.step(c1[k], c2[k], own[k])
                seen += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([trainer.net.packed()], pa.binary()), pa.array([float(seen)])], names=["part", "net", "seen"])

    return run


def normalisers(net: Net) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all classes after each near and each far class (biases are with the far ones), and the log
    normalisers of all pairs of them, by one matrix product."""
    near, far = ((net.context * w @ net.classes.T).astype(np.float32) for w in (net.near, net.far))
    far += net.bias.astype(np.float32)
    top1, top2 = near.max(1, keepdims=True), far.max(1, keepdims=True)
    right, normal = np.exp((far - top2).astype(np.float64)).T, np.empty((len(near), len(far)), np.float32)
    for a in range(0, len(near), 256):  # bounded temporaries in double precision
        z = np.exp((near[a : a + 256] - top1[a : a + 256]).astype(np.float64)) @ right
        normal[a : a + 256] = np.log(np.maximum(z, 1e-300)) + top1[a : a + 256] + top2.T
    return near, far, normal


@dataclass
class Model:
    classes: Classes
    counts: np.ndarray  # of the head's tokens
    total: int
    distinct: int
    rest: np.ndarray  # by ending: counts, and different tokens, without a class of their own
    net: Net
    _tables: tuple | None = None

    def __post_init__(self):
        self.base = np.log10((self.counts + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))
        # what a class's shares are divided by; 0 for tokens of their own class
        self.whole = np.append(np.zeros(self.classes.own), np.log10(self.rest[:, 0] + SMOOTH * (self.rest[:, 1] + 1)))

    def log_classes(self, own: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        """log10 probabilities of classes after others."""
        if self._tables is None:  # made in each worker, not sent
            self._tables = normalisers(self.net)
        near, far, normal = self._tables
        return (near[c1, own] + far[c2, own] - normal[c1, c2]).astype(np.float64) / np.log(10)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray | pa.Array]:
        """Sums of each text over the head's tokens, and its other words with their numbers; of those the
        score lacks the logarithm of their count and 0.1."""
        ranks, text, own, c1, c2, words, at = self.classes.sequences(texts)
        value, n = self.log_classes(own, c1, c2) - self.whole[own], len(texts)
        inside = np.flatnonzero(ranks >= 0)
        base = np.zeros(len(ranks))
        base[inside] = self.base[ranks[inside]]
        late = inside[ranks[inside] >= self.classes.own]
        value[late] += np.log10(self.counts[ranks[late]] + SMOOTH)
        tail = np.flatnonzero(ranks[at] < 0)
        add = lambda v: np.bincount(text, v, n)
        return {"n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text[inside], self.counts[ranks[inside]] > 0, n).astype(np.int64), "base": add(base), "score": add(value), "tail": words.take(pa.array(tail)), "tail_of": text[at[tail]]}


def fit(docs: DataFrame, train: Column, scratch: Scratch) -> tuple[Model, DataFrame]:
    """The model and the table of all training counts."""
    rows = docs.where(train).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = scratch.keep(count_tokens(rows), "counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(HEAD).toArrow()
    head, c = top.column("token").combine_chunks(), top.column("c").to_numpy()
    if not len(top):
        head, c = pa.array([], pa.string()), np.zeros(0, np.int64)
    end = pc.index(head, pa.scalar("", pa.string())).as_py()
    if end < 0:  # rarer than all of the head, or without any training text
        seen = counts.where("token = ''").first()
        head, c, end = pa.concat_arrays([head, pa.array([""], pa.string())]), np.append(c, seen.c if seen else 0), len(head)
    classes = Classes(head, end, min(WORDS, len(head)))
    by_ending = counts.groupBy(_ending_of(F.col("token")).alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # ENDINGS rows
    rest = np.zeros((ENDINGS, 2), np.int64)
    for r in by_ending:
        rest[r.e] = r.c, r.v
    for token, k in zip(head[: classes.own].to_pylist(), c[: classes.own].tolist(), strict=True):
        rest[_ending(token)] -= (k, k > 0)
    share = np.append(c[: classes.own], rest[:, 0]).astype(float) + 1.0
    share /= share.sum()
    spark, schema, net = docs.sparkSession, "part long, net binary, seen double", start_net(share)
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((classes, share, net))  # of bounded size
        nets = scratch.keep(rows.mapInArrow(lambda b, shared=shared: _train(*shared.value)(b), schema), f"round{turn}")
        mean = average(nets, scratch)
        net = net if mean is None else net.unpacked(mean.tobytes())
    return Model(classes, c, totals.n or 0, totals.v, rest, net), counts


def language_model_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    model, counts = fit(rows, ~held, scratch)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for a in range(0, len(b), 1000):
                part = b.slice(a, 1000)
                got = m.score(part.column("text"))
                pairs = pa.table({"of": got["tail_of"], "token": got["tail"]}).group_by(["of", "token"]).aggregate([([], "count_all")]).sort_by("of")
                upto = np.cumsum(np.bincount(pairs.column("of").to_numpy(), minlength=len(part)))
                items = pa.StructArray.from_arrays([pairs.column("token").combine_chunks(), pairs.column("count_all").combine_chunks().cast(pa.int64())], names=["token", "k"])
                tail = pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), items)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *(pa.array(got[c]) for c in ("n_tokens", "n_known", "base", "score")), tail], names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "tail"])

    first = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<struct<token:string,k:long>>")
    first = scratch.keep(first, "first")
    tail = first.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.k").join(counts, "token", "left")
    c = F.coalesce("c", F.lit(0))
    sums = tail.groupBy("row").agg(F.sum(F.col("k") * F.log10(c + F.lit(SMOOTH))).alias("logs"), F.sum("k").alias("k"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known"))
    base_log = float(np.log10(model.total + SMOOTH * (model.distinct + 1)))
    out = first.drop("tail").join(sums, "row", "left")
    logs, k = F.coalesce("logs", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + logs - k * base_log).alias("base_score"), (F.col("score") + logs).alias("score"))
