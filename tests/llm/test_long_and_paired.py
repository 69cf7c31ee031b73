"""Toxicity from pairs of words among many, and personal data in very long texts."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import pii, toxicity


def test_pairs_among_many_words(spark):
    """The label hangs on which one of two words stands there; 1,200 other words are more
    frequent, and no word tells anything by itself.  (Words whose hashes share a bucket with
    others would blur it; these do not.)"""
    rnd = random.Random(2)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}ordinary{chr(97 + i // 676)}x{i % 7 * 'o'}{i}" for i in range(1200)]
    rows = []
    for i in range(6000):
        k, a, b = i % 4, rnd.random() < 0.5, rnd.random() < 0.5
        text = rnd.sample(words, 400) + [f"near{k}wing"] * a + [f"far{k}wing"] * b
        rnd.shuffle(text)
        rows.append((i, " ".join(text), int(a != b)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    assert len(got) > 1000 and (got["predicted"] == got["toxic"]).mean() > 0.95


def test_weights_are_learnt_in_tasks(spark, monkeypatch):
    """The driver trains on no text and no task on all of them; the mean of the parts' models
    knows what each part alone knows, however the rows lie."""
    rnd = random.Random(3)
    rows = [(i, " ".join([f"word{rnd.randrange(200)}" for _ in range(30)] + ["insult"] * (i % 3 == 0)), int(i % 3 == 0)) for i in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    driver, train = os.getpid(), toxicity.train

    def watched(begin, term, label, *rest, **how):
        assert os.getpid() != driver and len(label) < 900
        return train(begin, term, label, *rest, **how)

    monkeypatch.setattr(toxicity, "train", watched)
    monkeypatch.setattr(toxicity, "PART_DOCS", 600, raising=False)
    model, again = (toxicity.fit(docs.repartition(n), labels) for n in (2, 7))
    assert np.array_equal(model.index, again.index) and np.array_equal(model.factor, again.factor) and np.array_equal(model.weight, again.weight)
    got = toxicity.scored(docs, model).join(labels, "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    assert len(got) > 500 and (got["predicted"] == got["toxic"]).mean() > 0.99


def test_scores_are_plain():
    rng = np.random.default_rng(3)
    index = np.full(toxicity.BUCKETS, -1, np.int32)
    texts = ["insult group insult", "", None, "group only here", "nothing known"]
    terms = {int(b) for _, _, bucket in toxicity.hashed_terms(texts[:4]) for b in bucket}
    for row, bucket in enumerate(sorted(terms)):
        index[bucket] = row
    n = len(terms)
    model = toxicity.FactorizationMachine(index, 0.3, rng.normal(size=n), rng.normal(size=(n, 4)))
    for text, score in zip(texts, model.scores(texts), strict=True):
        held = sorted({int(index[b]) for _, _, bucket in toxicity.hashed_terms([text]) for b in bucket if index[b] >= 0})
        margin = 0.3 + sum(model.weight[i] for i in held) + sum(model.factor[i] @ model.factor[j] for i in held for j in held if i < j)
        assert np.isclose(score, 1 / (1 + np.exp(-margin)))


def test_pairs_by_counting(spark):
    """Against a count over all pairs of words."""
    rng = np.random.default_rng(4)
    terms, docs = 40, 300
    x = rng.random((docs, terms)) < rng.uniform(0.05, 0.6, terms)
    label = (x[:, 0] ^ x[:, 1]).astype(float)
    owner, place = np.nonzero(x)
    held = toxicity.Presence(owner, place, label, terms)
    p = label.mean()
    far = lambda rows: abs(label[rows].sum() - p * rows.sum()) / np.sqrt(max(rows.sum(), 1) * p * (1 - p))
    want = set()
    for i in range(terms):
        for j in range(i + 1, terms):
            both = x[:, i] & x[:, j]
            if both.sum() >= toxicity.PAIR_LEAST and far(both) >= toxicity.PAIR_FAR and far(both) >= toxicity.PAIR_GAIN * max(far(x[:, i]), far(x[:, j])):
                want |= {i, j}
                assert j in held.telling(i)
    assert want and set(toxicity.paired_terms(spark, owner, place, label, terms)) == want
    assert len(toxicity.paired_terms(spark, owner, place, np.ones(docs), terms)) == 0


def test_long_text_is_its_parts(spark):
    """Spans of a text of some 200,000 characters are those of its parts, moved along."""
    rnd = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(docs)
    pool = [r["text"] for r in docs.where("text is not null and instr(text, '@') > 0").orderBy("doc_id").limit(25).collect()]
    pool += [" ".join(str(rnd.randrange(10 ** rnd.randrange(1, 8))) for _ in range(1200)) for _ in range(25)]
    pool += [" ".join(f"mail é{i}x a{i}@b.org or +49 170 12345{i % 100:02d}" for i in range(80))]
    gap = "\n" + 40 * "." + "\n"
    whole = gap.join(pool)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*(gap + t + gap for t in pool), gap + whole + gap])], "doc_id bigint, text string").repartition(8, "doc_id")
    got = {r["doc_id"]: r for r in pii.personal_data(rows, model).collect()}
    parse = lambda t, by: {(k, int(s) + by, int(e) + by) for k, s, e in (x.split(":") for x in t.split(",") if x)}
    want, at = set(), 0
    for i, t in enumerate(pool):
        want |= parse(got[i]["spans"], at)
        at += len(t) + len(gap)
    found = parse(got[len(pool)]["spans"], 0)
    text = gap + whole + gap
    assert [(k, text[s:e]) for k, s, e in found ^ want] == []
    assert len(whole) > 100_000 and len(want) > 300


def test_blocks_and_lookups(spark):
    """What is looked up in blocks is what stands in the text, at every place."""
    text = "".join(chr(0x61 + i % 26) if i % 5 else "é" for i in range(3 * pii.BLOCK + 7))
    row = spark.createDataFrame([(text,)], "t string").withColumn("__blocks", F.expr(f"transform(sequence(0, length(t) div {pii.BLOCK}), i -> substring(t, i * {pii.BLOCK} + 1, {2 * pii.BLOCK}))"))
    places = [0, 1, 23, 24, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 2 * pii.BLOCK - 30, 3 * pii.BLOCK + 6]
    for s in places:
        want = text[s : s + 80]
        assert row.select(F.expr(pii._seen(str(s + 1), "80"))).first()[0] == want


def test_pii_learns_from_all_documents(spark, monkeypatch):
    """Each of more than twenty thousand documents counts, by the weight of examples that are alike."""
    held = {}

    class Seen(Exception):
        pass

    def seen(df, name):
        held[name] = df
        raise Seen

    monkeypatch.setattr(pii, "stored", seen)
    with pytest.raises(Seen):
        pii.fit(spark.range(25_000).select(F.col("id").alias("doc_id"), F.lit("mail a@b.cd").alias("text")))
    rows = held["shows"].where("label = 1").groupBy("fold").agg(F.count("*").alias("k"), F.sum("weight").alias("n")).collect()
    assert sum(r["n"] for r in rows) % 25_000 == 0 and len(rows) == 4 and max(r["k"] for r in rows) < 20
