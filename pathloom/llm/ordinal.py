"""Quality by ordinal cumulative-link regression over hashed text.

P(grade > k) = sigmoid(w . x - theta_k) with one weight vector for all grades and ordered
thresholds theta_1 < theta_2 < ...; x holds the text's hashed terms (words, beginnings of
words, runs of signs) scaled to unit length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BUCKETS, hashed_terms

#: Rated documents that a model learns from at most, about; dealt by a hash of doc_id.
TRAIN_DOCS = 12_000


@dataclass
class CumulativeLink:
    weight: np.ndarray
    theta: np.ndarray  # ordered; one fewer than grades

    def tails(self, texts) -> np.ndarray:
        """P(grade > k) for each text (row) and each k below the highest grade."""
        margin = np.zeros(len(texts))
        for first, owner, bucket in hashed_terms(texts, signs=True):
            n = int(owner.max()) + 1 if len(owner) else 0
            size = np.bincount(owner, minlength=n)
            margin[first : first + n] += np.bincount(owner, self.weight[bucket], n) / np.sqrt(np.maximum(size, 1))
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.theta[None], -30, 30)))


def train(owner: np.ndarray, bucket: np.ndarray, grade: np.ndarray, grades: int, epochs: int = 12, batch: int = 256, rate: float = 0.5, decay: float = 1e-6, seed: int = 3) -> CumulativeLink:
    """Adagrad on the negative log likelihood; ``owner`` is sorted and numbers texts from 0.
    theta_1 and the logarithms of the gaps are what is learnt, so the order holds."""
    rng = np.random.default_rng(seed)
    above = np.clip([(grade > k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(grades - 1))
    first, gaps = float(theta[0]), np.log(np.maximum(np.diff(theta), 1e-3))
    weight, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    g1, gg = 1e-6, np.full(grades - 2, 1e-6)
    begin = np.searchsorted(owner, np.arange(len(grade) + 1))
    scale = 1 / np.sqrt(np.maximum(np.diff(begin), 1))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        order = rng.permutation(len(grade))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            size = begin[pick + 1] - begin[pick]
            at = np.arange(int(size.sum())) + np.repeat(begin[pick] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            own, t = np.repeat(np.arange(len(pick)), size), bucket[at]
            margin = np.bincount(own, weight[t], len(pick)) * scale[pick]
            theta = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
            # P(grade = y) = s(margin - theta_{y-1}) - s(margin - theta_y)
            edges = np.concatenate(([-np.inf], theta, [np.inf]))
            lo, hi = sig(np.maximum(margin - edges[grade[pick]], -30)), sig(np.maximum(margin - edges[grade[pick] + 1], -30))
            lo[grade[pick] == 0], hi[grade[pick] == grades - 1] = 1.0, 0.0
            p = np.maximum(lo - hi, 1e-9)
            slo, shi = lo * (1 - lo) / p, hi * (1 - hi) / p
            dm = -(slo - shi) / len(pick)
            d_theta = np.zeros(grades - 1)
            for k in range(grades - 1):
                d_theta[k] = (slo[grade[pick] == k + 1].sum() - shi[grade[pick] == k].sum()) / len(pick)
            d = np.bincount(t, (dm * scale[pick])[own], BUCKETS)
            used = np.flatnonzero(d)
            gw[used] += d[used] ** 2
            weight[used] -= rate * (d[used] / np.sqrt(gw[used]) * 0.2 + decay * weight[used])
            d1 = d_theta.sum()
            g1 += d1 * d1
            first -= 0.1 * rate * d1 / np.sqrt(g1)
            if grades > 2:
                dg = np.exp(gaps) * np.cumsum(d_theta[::-1])[::-1][1:]
                gg += dg * dg
                gaps -= 0.1 * rate * dg / np.sqrt(gg)
    return CumulativeLink(weight, first + np.concatenate(([0], np.cumsum(np.exp(gaps)))))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, train_docs: int = TRAIN_DOCS) -> CumulativeLink:
    """Learns from at most about ``train_docs`` documents of ``ratings`` (doc_id, grade from
    0 to grades - 1; others and nulls are left out; of several grades the largest holds)
    whose crc32(doc_id) modulo 5 is not 0; the rest is for testing.  Without ratings every
    grade is as likely as another."""
    learn = lambda df: df.where("doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    marks = learn(ratings).where(f"grade between 0 and {grades - 1}").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    share = min(1.0, train_docs / max(1, marks.count()))
    # the labels dealt are bounded by train_docs, so they go to the texts, not the texts to them
    dealt = F.expr(f"pmod(xxhash64(doc_id, 13), 1000000) < {int(share * 1_000_000)}")
    rows = learn(docs.select("doc_id", "text")).where(dealt).join(F.broadcast(marks.where(dealt)), "doc_id").select("doc_id", "text", "grade")

    def terms(batches):
        for pdf in batches:
            held = [b""] * len(pdf)
            for first, owner, bucket in hashed_terms(pdf["text"].tolist(), signs=True):
                cut = np.searchsorted(owner, np.arange(int(owner[-1]) + 2 if len(owner) else 1))
                for k in range(len(cut) - 1):
                    held[first + k] = bucket[cut[k] : cut[k + 1]].astype(np.int32).tobytes()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "terms": held})

    data = rows.mapInPandas(terms, "doc_id bigint, grade int, terms binary").toPandas().sort_values(["doc_id", "terms"], kind="stable")
    if not len(data):
        return CumulativeLink(np.zeros(BUCKETS), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    held = [np.frombuffer(b, np.int32) for b in data["terms"]]
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    return train(owner, np.concatenate(held), data["grade"].to_numpy(int), grades)


def graded(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, expected_grade, tail (probability of
    the highest grade).  Null and empty texts have no terms: thresholds alone grade them.
    Whole texts are read; other columns are not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected double, tail double")
    def grade(texts: pd.Series) -> pd.DataFrame:
        tails = shared.value.tails(texts.tolist())
        return pd.DataFrame({"expected": tails.sum(1), "tail": tails[:, -1]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.expr(f"pmod(crc32(cast(`{id_col}` as string)), 5) = 0"), F.lit(False)).alias("held_out"), grade(F.col(text_col)).alias("g"))
    return rows.select("doc_id", "held_out", F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("tail"))
