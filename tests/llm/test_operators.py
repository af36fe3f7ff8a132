"""Every operator over a small awkward table, against brute force: null, empty and long texts, repeated rows, clashing columns, no rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import language_model, nearest, packing, piece_scan, pivots, quality, simhash, suffix_dedup, suffix_sort, token_files, toxicity, wide_simhash
from sieveline.llm._common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
DDL = "doc_id long, text string, label string, score double, row string, m long"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(n))
    shared, doc = say(120), say(300)
    rows = [None, "", "   ", "a", doc, doc, doc + " tail", say(20) + shared + say(30), say(9) + shared, "ab" * 900, say(4000), "x\n" * 300]
    rows += [say(r.randint(1, 200)) for _ in range(20)]
    return [(k, t) for k, t in enumerate(rows)] + [(4, doc), (40, "ab" * 900)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "l", 0.5, "r", 7) for k, t in texts], DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def by_id(df):
    return sorted(df.collect(), key=lambda r: tuple((v is None, str(v)) for v in (r[0], *r)))


def removed(text, counts, length):
    hit = np.zeros(len(text) + 1, int)
    for i in range(len(text) - length + 1):
        if counts[text[i : i + length]] > 1:
            hit[i] += 1
            hit[i + length] -= 1
    return np.cumsum(hit)[:-1] > 0


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_array_dedup(spark, docs, texts, none, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    raw = [(k, (t or "").encode()) for k, t in texts]
    counts = Counter(t[i : i + 400] for _, t in raw for i in range(len(t) - 399))
    want = []
    for k, t in raw:
        m = removed(t, counts, 400)
        kept = np.frombuffer(t, np.uint8)[~m].tobytes()
        want.append((k, len(t), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r) for r in suffix_dedup.suffix_array_dedup(spark, docs).collect()) == sorted(want)
    assert any(w[2] for w in want) and suffix_dedup.suffix_array_dedup(spark, none).count() == 0


def test_suffix_sorter_spills(spark, docs, texts):
    """In a task of Spark, with queues far smaller than the shard; its windows equal brute force."""
    data = [t.encode() for _, t in texts if t and len(t.encode()) >= 400]
    rows = [(7, k, 0, 1, d) for k, d in enumerate(data)]

    def run(batches):
        import pandas as pd

        spilled, sort = [], suffix_sort.scan_suffixes
        suffix_sort.scan_suffixes = lambda *a, **how: sort(*a, **(how | {"spilled": spilled}))
        try:
            found = [r for b in suffix_dedup._sort_shard(400, memory=500)(batches) for r in b.to_pylist()]
        finally:
            suffix_sort.scan_suffixes = sort
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"s1": [-1, *(r["s1"] for r in found)], "runs": [[[sum(spilled), 0]], *(r["runs"] for r in found)]}), preserve_index=False)

    got = {r.s1: r.runs for r in spark.createDataFrame(rows, "m long, s1 long, s2 long, w long, data binary").repartition(1).mapInArrow(run, "s1 long, runs array<array<long>>").collect()}
    assert got.pop(-1)[0][0] > 10
    counts = Counter(t[i : i + 400] for t in data for i in range(len(t) - 399))
    want = {k: [i for i in range(len(t) - 399) if counts[t[i : i + 400]] > 1] for k, t in enumerate(data)}
    assert {k: [i for a, b in runs for i in range(a, b)] for k, runs in got.items()} == {k: w for k, w in want.items() if w}


@pytest.mark.parametrize("length,words", [(400, 0), (200, 0), (100, 40)])
def test_remove_repeats(spark, docs, texts, none, length, words):
    counts = Counter((t or "").encode()[i : i + length] for _, t in texts for i in range(len((t or "").encode()) - length + 1))

    def short(text):
        if text is None:
            return None
        data = text.encode()
        m = removed(data, counts, length)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], m.astype(int), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            m[a:b] = len(data[a:b].split()) >= words
        return np.frombuffer(data, np.uint8)[~m].tobytes().decode(errors="ignore")

    out = suffix_dedup.remove_repeats(spark, docs.withColumn("ranges", F.lit(1)).withColumn("d", F.lit("x")), length, words)
    got = sorted(((r.doc_id, r.text) for r in out.select("doc_id", "text", "ranges", "d").collect()), key=str)
    assert got == sorted(((k, short(t)) for k, t in texts), key=str) and any(short(t) != t for _, t in texts)
    assert suffix_dedup.remove_repeats(spark, none, length).count() == 0


def test_language_model(spark, docs, texts, none):
    rows = [(k, (t or "").encode().lower().split() + [b""]) for k, t in texts]
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows}
    c = Counter(w for k, ws in rows if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    got = language_model.language_model_scores(spark, docs).collect()
    base = sorted((k, round(float(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)), 6), len(ws), sum(c[w] > 0 for w in ws)) for k, ws in rows)
    assert sorted((r.doc_id, round(r.base_score, 6), r.n_tokens, r.n_known) for r in got) == base
    assert all(r.score < 0 and r.train_tokens == n and r.held_out == held[r.doc_id] for r in got)
    assert language_model.language_model_scores(spark, none).count() == 0


def test_language_model_sums_to_one():
    """Over all classes after any two, and over a class's tokens, one of them never seen."""
    classes = language_model.Classes(pa.array(["the", "", "house", "mouse", "blouse"]), 1, 2)
    rest = np.zeros((language_model.ENDINGS, 2), np.int64)
    for word, c in (("house", 3), ("mouse", 2), ("blouse", 1)):
        rest[language_model._ending(word)] += (c, 1)
    net = language_model.start_net(np.full(classes.count, 1 / classes.count))
    m = language_model.Model(classes, np.array([9, 5, 3, 2, 1]), 20, 5, rest, net)
    every = np.arange(classes.count)
    for c1, c2 in ((0, 1), (classes.count, classes.count), (7, classes.count)):
        p = 10 ** m.log_classes(every, np.full_like(every, c1), np.full_like(every, c2))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    own = language_model._ending("house")
    assert language_model._ending("mouse") == own and sum(10 ** (np.log10(c + 0.1) - m.whole[2 + own]) for c in (3, 2, 1, 0)) == pytest.approx(1)


def test_language_model_learns_order(spark):
    """Held-out texts of a fixed order score better than shuffled ones, for frequent and for rare words."""
    r = random.Random(9)
    rare = [f"w{k}ing" for k in range(400)] + [f"v{k}ed" for k in range(400)]
    say = lambda: " ".join(f"the {r.choice(rare[:400])} was {r.choice(rare[400:])} and" for _ in range(30))
    texts = [say() for _ in range(600)]
    mixed = []
    for t in texts[:60]:
        words = t.split()
        r.shuffle(words)
        mixed.append(" ".join(words))
    rows = list(enumerate(texts)) + [(1000 + k, t) for k, t in enumerate(mixed)]
    got = {q.doc_id: q for q in language_model.language_model_scores(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    held = [k for k in range(60) if got[k].held_out]
    assert held and all(got[k].score > got[k].base_score + 5 for k in held) and sum(got[k].score for k in range(60)) > sum(got[1000 + k].score for k in range(60)) + 300


def test_token_files(spark, docs, texts, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for k, x in sorted(texts, key=lambda r: r[0]):
        ids = np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(tuple(r) for r in token_files.token_output(spark, docs, path).collect())
    assert [g[:3] for g in got if g[0] not in (4, 40)] == [w[:3] for w in want if w[0] not in (4, 40)]
    assert sorted((g[0], g[3]) for g in got) == sorted((w[0], w[3]) for w in want)
    assert token_files.token_output(spark, none, path).count() == 0


@pytest.mark.parametrize("fan", [2, 64])
def test_pieces(spark, docs, texts, none, fan, monkeypatch):
    monkeypatch.setattr(piece_scan, "FAN", fan)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = piece_scan.lattice(path).library
    got = piece_scan.piece_round_trip(spark, docs, path, chunk=100).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == sorted((k, zlib.crc32(np.asarray(library.encode(t or ""), "<u4").tobytes())) for k, t in texts)
    assert max(r.n_chunks for r in got) > 50 and piece_scan.piece_round_trip(spark, none, path).count() == 0


def test_pieces_write_only_long_texts(spark, tmp_path):
    """The scratch tables grow with the texts of several chunks, not with ids of the others."""
    r = random.Random(3)
    rows = [(k, " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40)), None, None, None, None) for k in range(400)]
    scratch = Scratch(spark)
    scratch.path = f"file://{tmp_path}/s"
    got = piece_scan.encode_pieces(spark.createDataFrame([*rows, (400, "abc " * 300, None, None, None, None)], DDL), scratch, public_tokenizers.path("piece_bpe_32k.model"), chunk=400)
    assert got.count() == 401
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 50_000


def test_simhash(spark, docs, texts, none):
    fp = {i: simhash.fingerprint((t or "").encode()) for i, (_, t) in enumerate(texts)}
    up = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            up[i] = min(up[j] for j in fp if bin(fp[i] ^ fp[j]).count("1") <= 4)
    least = {}
    for i, (k, _) in enumerate(texts):
        least[up[i]] = min(least.get(up[i], k), k)
    want = sorted((k, "%016x" % fp[i], least[up[i]]) for i, (k, _) in enumerate(texts))
    assert sorted(tuple(r) for r in simhash.simhash_near_duplicates(spark, docs).collect()) == want
    assert simhash.simhash_near_duplicates(spark, none).count() == 0


def test_keep_one_keeps_one_of_each_group(spark):
    """Rows without an id, and one id on different texts."""
    r = random.Random(6)
    say = lambda: " ".join(str(r.random()) for _ in range(60))
    alone, one, two, three = [say() for _ in range(5)], say(), say(), say()
    rows = [(None, t) for t in alone] + [(None, alone[0]), (None, one), (3, one), (3, one), (2, one), (7, two), (7, three), (None, three), (9, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((-1 if q.doc_id is None else q.doc_id), q.text or "") for q in wide_simhash.keep_one(spark, df).collect())
    assert got == sorted([(-1, t) for t in alone] + [(2, one), (7, two), (7, three), (9, "")])


def test_bands_that_collide_without_links_make_no_rows(spark, tmp_path, monkeypatch):
    """Many fingerprints whose first bands differ by one bit, all others at random: they meet, and none is near."""
    monkeypatch.setattr(wide_simhash, "ROUNDS", 2)
    r = np.random.default_rng(5)
    bits = r.integers(0, 2, (60, wide_simhash.BITS), dtype=np.uint8)
    band = wide_simhash._selected()[0]
    bits[:, band] = bits[0, band]
    bits[np.arange(60), band[np.arange(60) % 30]] ^= 1
    rows = [(k, bytearray(np.packbits(b).tobytes())) for k, b in enumerate(bits)]
    scratch = Scratch(spark)
    scratch.path = f"file://{tmp_path}/s"
    links = wide_simhash.near_links(spark.createDataFrame(rows, "id long, fp binary"), scratch)
    assert links.count() == 0
    made = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "s").iterdir() if not p.name.startswith("rooted")}
    assert len(made) >= 3 and not any(made.values())


@pytest.mark.parametrize("bucket", [1 << 18, 50])
def test_keep_one_by_similarity(spark, texts, none, bucket, monkeypatch):
    """Against all pairs of fingerprints; near copies of shingle similarity 0.85 and more go, other texts stay."""
    monkeypatch.setattr(wide_simhash, "BUCKET", bucket)
    monkeypatch.setattr(wide_simhash, "ROUNDS", 2)
    r = random.Random(12)
    say = lambda n: [str(r.randint(0, 10**6)) for _ in range(n)]
    rows, near = [(k, t) for k, t in texts], 0
    for k in range(60):
        words = say(300)
        rows.append((1000 + 10 * k, " ".join(words)))
        for c in range(1, 4):
            other = list(words)
            for at in r.sample(range(300), 4):  # up to 20 of 296 shingles
                other[at] = "x" + str(r.randint(0, 10**6))
            rows.append((1000 + 10 * k + c, " ".join(other)))
            near += 1
    df = spark.createDataFrame([(k, t, 1, "k") for k, t in rows], "doc_id long, text string, k1 long, doc string").repartition(3)
    kept = wide_simhash.keep_one(spark, df)
    ids = sorted(q.doc_id for q in kept.collect())
    assert kept.columns == df.columns and len(ids) == len(set(ids))
    prints = [np.frombuffer(wide_simhash.fingerprint((t or "").encode()), np.uint64) for _, t in rows]
    up = list(range(len(rows)))
    for _ in range(6):
        for i in range(len(rows)):
            up[i] = min(up[j] for j in range(len(rows)) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= wide_simhash.FURTHEST)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[up[i]] = min(least.get(up[i], k), k)
    want = set(least.values())
    assert want <= set(ids) and len(set(ids) - want) <= 0.05 * near
    assert {1000 + 10 * k for k in range(60)} <= want and wide_simhash.keep_one(spark, none).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for k in range(140):
        v = base[k % 9] / np.linalg.norm(base[k % 9]) + rng.standard_normal(16) * 0.08
        rows.append((100 + k, v.tolist()))
    rows += [(300 + k, base[3].tolist()) for k in range(30)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [1.0] * 3), (404, [None] * 16), (405, [])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_nearest(spark, vectors, monkeypatch):
    monkeypatch.setattr(nearest, "CANDIDATE_TILE", 50)
    rows, df = vectors
    fine = [(i, np.array(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    got = {}
    for r in nearest.nearest(spark, df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for i, v in fine:
        if i % 20 == 0:
            scores = sorted((-float(np.add.accumulate(v * w)[-1]), j) for j, w in fine if j != i)[:20]
            assert [(k + 1, j, -s) for k, (s, j) in enumerate(scores)] == sorted(got.pop(i))
    assert not got and nearest.nearest(spark, df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_wide_vectors(spark, monkeypatch):
    """Codes of 4,096 dimensions sum beyond what single precision holds exactly."""
    monkeypatch.setattr(nearest, "CANDIDATE_TILE", 40)
    monkeypatch.setattr(nearest, "HELD", 10)
    rng = np.random.default_rng(3)
    base = rng.integers(100, 128, 4096).astype(float)
    x = np.stack([base + (rng.random(4096) < 0.001) * rng.standard_normal(4096) for _ in range(90)])
    x[7] = x[11]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(spark, df, F.col("vec_id") % 20 == 0, 5).collect()
    want = []
    for q in range(0, 90, 20):
        scores = sorted((-float(np.add.accumulate(x[q] * v)[-1]), k) for k, v in enumerate(x) if k != q)[:5]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == want


def test_near_vectors(spark, vectors, monkeypatch):
    monkeypatch.setattr(pivots, "TILE", 40)
    rows, df = vectors
    fine = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    m = np.stack([v for _, v in fine])
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.vec_id: r for r in pivots.near_vectors(spark, df).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i, _ in fine)
    assert 0.9 * link.sum() <= found <= link.sum() and all(got[i].n_links <= n for (i, _), n in zip(fine, link.sum(1), strict=True))
    assert all(got[i].n_links == 0 and got[i].kept for i in (400, 401, 402, 404, 405))
    assert len({got[300 + k].component_id for k in range(30)}) == 1 and pivots.near_vectors(spark, df.limit(0)).count() == 0


def test_near_vectors_whatever_the_tiles(spark, monkeypatch):
    """A table that fits one tile goes the way of larger ones: the same links, found by (here too few) shared pivots."""
    r = np.random.default_rng(12)
    x = r.normal(size=(300, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, x + 0.4 * r.normal(size=x.shape)]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(pivots, "NEAREST", 2)
    got = []
    for tile in (4096, 16):
        monkeypatch.setattr(pivots, "TILE", tile)
        got.append(sorted(tuple(q) for q in pivots.near_vectors(spark, df).collect()))
    assert got[0] == got[1] and sum(n for _, n, _, _ in got[0]) > 100


def test_near_vectors_hot_group(spark, monkeypatch):
    """A third of the rows near copies of one vector, and more widths than 64."""
    monkeypatch.setattr(pivots, "TILE", 700)
    monkeypatch.setattr(pivots, "LEAST_PIVOTS", 512)
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 64))
    x[:1000] = x[0] / np.linalg.norm(x[0]) + 0.28 * x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(10_000 + 2 * w + k, [1.0] * w + [0.01 * k]) for w in range(70, 150) for k in range(2)]
    got = {q.vec_id: q for q in pivots.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows) and links[:1000].sum() > 100_000
    assert all(got[k].n_links <= links[k] for k in range(3000))
    assert sum(got[k].n_links for k in range(1000)) >= 0.97 * links[:1000].sum()
    assert all(got[k].n_links == 1 and got[k].component_id == k // 2 * 2 for k in range(10_140, 10_300))


def test_packing(spark, docs, texts, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path := public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack_documents(spark, docs, path, capacity=300).collect()
    sizes = sorted((k, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for k, x in texts)
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert total == sum((Counter({k: n}) for k, n in sizes), Counter())
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 300
    assert len(bins) <= -(-sum(n for _, n in sizes) // 300) * 1.05 + 1 and packing.pack_documents(spark, none, path).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_anything(spark, docs, texts, none, module):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k, _ in texts[:20]] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    score = module.quality_scores if module is quality else module.toxicity_scores
    got = score(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert score(none, labels).count() == 0 and score(docs, labels.limit(0)).count() == len(texts)
    keep = module.keep_good if module is quality else module.keep_clean
    assert keep(spark, docs, labels).columns == docs.columns
