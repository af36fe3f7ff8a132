"""Every stage of the pipeline on planted cases: what has to go goes, all else stays as it was."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sieveline.llm import quality, toxicity
from sieveline.llm._common import fold

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    clean = {k: say(r.randint(30, 400)) for k in range(60)}
    passages = [say(51), say(70), " ".join(r.choice("abcdef") + r.choice("ghi") + r.choice("xyz") for _ in range(60))]
    with_passage = {1000 + 10 * p + c: f"{say(80)} {text} {say(60)}" for p, text in enumerate(passages) for c in range(3)}
    copies = {2000 + k: clean[k] for k in range(20)}
    near = {}
    for k in range(20, 40):
        words = clean[k].split()
        words[len(words) // 2] = "changed"
        near[3000 + k] = " ".join(words)
    rows = [(k, t, "en", "web", len(t)) for k, t in (clean | with_passage | copies | near).items()]
    rows += [(None, say(50), "en", "web", 0), (None, say(50), "en", "web", 0), (9000, None, None, None, None), (9001, "", "", "", 0), (5, clean[5], "en", "web", 0)]
    return clean, passages, with_passage, near, spark.createDataFrame(rows, DDL).repartition(3)


def test_near_duplicate_stage(spark, planted):
    clean, _, with_passage, near, df = planted
    kept = corpus_pipeline.near_duplicate_stage(spark, df, SF)
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    assert kept.dtypes == df.dtypes and set(clean) <= set(ids) and set(with_passage) <= set(ids) and ids.count(None) == 2 and ids.count(5) == 1
    assert not any(2000 <= (k or 0) < 2020 for k in ids) and ids.count(9000) + ids.count(9001) == 1
    long = [k for k in near if len(near[k].split()) >= 120]  # one word of 120: similarity 0.92 at least
    assert sum(k in ids for k in long) <= 0.1 * len(long)


def test_repeated_passage_stage(spark, planted):
    clean, passages, with_passage, _, df = planted
    docs = df.where(F.col("doc_id").isNull() | ~F.col("doc_id").between(2000, 4000)).dropDuplicates(["doc_id", "text"])
    out = corpus_pipeline.repeated_passage_stage(spark, docs, SF)
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.dtypes == docs.dtypes and out.count() == docs.count()
    assert all(got[k].text == t for k, t in clean.items()) and got[9000].text is None and got[9001].text == ""
    for k, text in with_passage.items():
        passage = passages[(k - 1000) // 10]
        a, b = text.split(passage)
        # the bytes around a passage may agree by chance in two texts
        cut = {a[: len(a) - x] + b[y:] for x in range(4) for y in range(4)}
        assert passage not in got[k].text and got[k].text in cut and got[k].n_chars == len(got[k].text)


@pytest.mark.parametrize("stage,score,held", [(corpus_pipeline.quality_stage, quality.quality_scores, ("doc_id", 4, 2)), (corpus_pipeline.toxicity_stage, toxicity.toxicity_scores, ("doc_id", 3, 1))])
def test_classifying_stages_keep_what_the_operator_accepts(spark, stage, score, held):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = stage(spark, docs, SF)
    accepted = 1 if score is quality.quality_scores else 0
    want = {r.doc_id for r in score(docs, labels, fold(held[0], held[1]) == held[2]).where(F.col("predicted") == accepted).collect()}
    assert kept.dtypes == docs.dtypes and {r.doc_id for r in kept.collect()} == want and len(want) > 50


def test_packing_stage(spark, planted):
    from tokenizers import Tokenizer

    import public_tokenizers

    df = planted[-1].where("doc_id is not null")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in df.collect())
    out = corpus_pipeline.packing_stage(spark, df, SF).toPandas()
    assert out.length.sum() == want and (out.groupby("sequence_id").length.sum() <= 4096).all() and out.sequence_id.nunique() == -(-want // 4096)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 4096).all()
