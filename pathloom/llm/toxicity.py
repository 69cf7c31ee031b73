"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 where a text
holds term i: the factors v let a pair of terms weigh more, or less, than its two members.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .bytewords import arrow_texts, tidied
from .hashing import BEGINNINGS, BUCKETS, beginnings_of, hashed_terms
from .store import stored

#: Labelled documents that a model learns from at most, about; dealt by a hash of doc_id.
TRAIN_DOCS = 30_000
#: Deviations from the labels' share from which a term keeps a weight: all such terms do.
FAR = 2.5
#: Labelled documents in which pairs of terms are tried, at most, about.
PAIR_DOCS = 8_000
#: Texts that hold both words of a pair, at least.
PAIR_LEAST = 5
#: Deviations from the labels' share that make a pair, and how much more than its members'.
PAIR_FAR, PAIR_GAIN = 5.5, 1.5
FACTORS = 8
#: Documents that one task learns from, about, and how often the tasks' models are averaged,
#: with how many passes of each task over its documents before.
PART_DOCS = 6_000
ROUNDS, PASSES = 10, 4


@dataclass
class FactorizationMachine:
    index: np.ndarray  # bucket -> row of the weights, -1 without any
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, texts) -> np.ndarray:
        """``texts``: an Arrow column, or a list."""
        out = np.full(len(texts), self.bias)
        for first, owner, bucket in hashed_terms(arrow_texts(texts) if isinstance(texts, pa.Array) else texts, self.index >= 0):
            n = int(owner.max()) + 1 if len(owner) else 0
            term = self.index[bucket]
            out[first : first + n] += _margin(owner, term, n, self.weight, self.factor)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _margin(owner, term, n, weight, factor) -> np.ndarray:
    out = np.bincount(owner, weight[term], n)
    for f in range(factor.shape[1]):
        v = factor[term, f]
        out += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
    return out


def least_texts(share: float) -> int:
    """Texts that a pair must stand in to reach PAIR_FAR at all, if all of them have the rarer
    label: words in fewer texts are in no such pair, so none is lost by leaving them out."""
    odds = min(share, 1 - share) / max(share, 1 - share)
    return max(PAIR_LEAST, int(np.ceil(PAIR_FAR**2 * odds)))


def _counts(values: np.ndarray, size: int, step: int = 1 << 18) -> np.ndarray:
    """``bincount`` in steps, as it makes eight bytes of each value."""
    return sum((np.bincount(values[a : a + step], minlength=size) for a in range(0, len(values), step)), np.zeros(size, np.int64))


class Presence:
    """Which texts hold which words, from both sides."""

    def __init__(self, owner: np.ndarray, place: np.ndarray, label: np.ndarray, terms: int):
        # ``owner`` is sorted
        kind = np.uint16 if max(terms, len(label)) < (1 << 16) - 1 else np.int32
        self.label = label == 1
        self.n = _counts(place, terms)
        self.ones = _counts(place[self.label[owner]], terms)
        self.words = place.astype(kind)  # of each text, one text after the other
        self.text = np.searchsorted(owner, np.arange(len(label) + 1, dtype=owner.dtype))
        self.texts = owner.astype(kind)[np.argsort(self.words, kind="stable")]  # of each word
        self.word = np.concatenate(([0], np.cumsum(self.n)))

    def apart(self, n: np.ndarray, ones: np.ndarray) -> np.ndarray:
        p = self.label.mean()
        return np.abs(ones - p * n) / np.sqrt(np.maximum(n, 1) * p * (1 - p))

    def telling(self, word: int) -> np.ndarray:
        """The words behind ``word`` that tell the labels apart with it much better than
        either does alone."""
        texts = self.texts[self.word[word] : self.word[word + 1]]
        size = self.text[texts + 1] - self.text[texts]
        at = np.arange(int(size.sum())) + np.repeat(self.text[texts] - (np.cumsum(size) - size), size)
        others = self.words[at]
        keep = others > word
        others, toxic = others[keep], np.repeat(self.label[texts], size)[keep]
        if 8 * len(others) < len(self.n):
            found, inverse = np.unique(others, return_inverse=True)
            both, ones = np.bincount(inverse, minlength=len(found)), np.bincount(inverse, toxic, len(found))
        else:
            both, ones = np.bincount(others, minlength=len(self.n)), np.bincount(others[toxic], minlength=len(self.n))
            found = np.flatnonzero(both)
            both, ones = both[found], ones[found]
        far = self.apart(both, ones)
        alone = np.maximum(self.apart(self.n[word], self.ones[word]), self.apart(self.n[found], self.ones[found]))
        return found[(both >= PAIR_LEAST) & (far >= PAIR_FAR) & (far >= PAIR_GAIN * alone)]


def paired_terms(spark: SparkSession, owner: np.ndarray, place: np.ndarray, label: np.ndarray, terms: int) -> np.ndarray:
    """The words, of all ``terms``, that are in any pair that tells.  Each word is a row of a
    Spark job and meets those it shares a text with; the texts, a bounded number, go to
    every task."""
    if not 0 < (label.mean() if len(label) else 0) < 1 or not terms:
        return np.zeros(0, np.int64)
    held = spark.sparkContext.broadcast(Presence(owner, place, label, terms))

    def tried(frames):
        for pdf in frames:
            found = [np.zeros(0, np.int64)]
            for word in pdf["id"]:
                other = held.value.telling(word)
                if len(other):
                    found += [np.array([word]), other]
            yield pd.DataFrame({"place": np.unique(np.concatenate(found))})
        tidied()

    tidied()
    words = spark.range(0, terms, 1, 4 * spark.sparkContext.defaultParallelism)
    return np.sort(words.mapInPandas(tried, "place bigint").distinct().toPandas()["place"].to_numpy(np.int64))


def start(share: float, terms: int, factors: int = FACTORS, seed: int = 7) -> np.ndarray:
    """A row for each term and a last one for the bias; of each its weight, then its factors:
    in 0 the values, in 1 the squares that Adagrad has summed."""
    state = np.full((terms + 1, 2, 1 + factors), 1e-6)
    state[:, 0] = 0
    state[:-1, 0, 1:] = np.random.default_rng(seed).normal(0, 0.01, (terms, factors))
    share = np.clip(share, 1e-3, 1 - 1e-3)
    state[-1, 0, 0] = np.log(share / (1 - share))
    return state


def train(begin: np.ndarray, term: np.ndarray, label: np.ndarray, state: np.ndarray, epochs: int, seed=0, batch: int = 512, rate: float = 0.1, decay: float = 2e-5) -> np.ndarray:
    """Adagrad on the log loss, on from ``state``; a text's terms are those from its place in
    ``begin`` to the next."""
    rng = np.random.default_rng(seed)
    terms, factors = len(state) - 1, state.shape[2] - 1
    bias, gb = (float(x) for x in state[-1, :, 0])
    weight, gw = (state[:-1, k, 0].astype(float) for k in (0, 1))
    factor, gv = (state[:-1, k, 1:].astype(float) for k in (0, 1))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            size = begin[pick + 1] - begin[pick]
            at = np.arange(int(size.sum())) + np.repeat(begin[pick] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            own, t = np.repeat(np.arange(len(pick)), size), term[at]
            v, there = factor[t], np.flatnonzero(size)  # reduceat takes no empty runs
            runs = (np.cumsum(size) - size)[there]
            sums, rest = np.zeros((len(pick), factors)), np.zeros(len(pick))
            if len(there):
                sums[there] = np.add.reduceat(v, runs, axis=0)
                rest[there] = np.add.reduceat(weight[t] - 0.5 * np.einsum("ij,ij->i", v, v), runs)
            margin = bias + rest + 0.5 * (sums**2).sum(1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[pick]) / len(pick)
            gb += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(gb)
            d = np.bincount(t, slope[own], terms) + decay * weight
            gw += d * d
            weight -= rate * d / np.sqrt(gw)
            pull = slope[own, None] * (sums[own] - v)
            dv = np.stack([np.bincount(t, pull[:, f], terms) for f in range(factors)], 1) + decay * factor
            gv += dv * dv
            factor -= 0.3 * rate * dv / np.sqrt(gv)
    out = np.zeros(state.shape)
    out[-1, :, 0] = bias, gb
    out[:-1, 0, 0], out[:-1, 1, 0] = weight, gw
    out[:-1, 0, 1:], out[:-1, 1, 1:] = factor, gv
    return out


def trained(texts: DataFrame, state: np.ndarray, rounds: int = ROUNDS, passes: int = PASSES) -> np.ndarray:
    """``texts`` (of ``_term_rows``) teach ``state`` where they are: in each round every part
    goes on from the same state by itself, and the mean of the parts, weighed by their texts,
    is the next one.  The driver sees states, never texts."""
    spark = texts.sparkSession
    for k in range(rounds):
        held = spark.sparkContext.broadcast(state.astype(np.float32))

        def learn(batches, k=k, held=held):
            got = list(batches)
            if got:
                data = pa.Table.from_batches(got)
                for part in sorted(data.column("part").unique().to_pylist()):
                    begin, term, label = _placed(data.filter(pc.equal(data.column("part"), part)))
                    out = train(begin, term, label, held.value, passes, (7, k, part))
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "texts": [len(label)], "state": [out.astype(np.float32).tobytes()]})
            tidied()

        parts = sorted(texts.mapInArrow(learn, "part int, texts bigint, state binary").toArrow().to_pylist(), key=lambda r: r["part"])
        total = sum(r["texts"] for r in parts)
        state = sum(np.frombuffer(r["state"], np.float32).astype(float) * (r["texts"] / total) for r in parts).reshape(state.shape)
        held.destroy()
        del parts
    return state


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> FactorizationMachine:
    """Learns ``toxic`` of the labelled documents whose crc32(doc_id) modulo 5 is not 0.

    At most about ``train_docs`` of them, dealt by a hash of doc_id.  Counts of terms by
    label are summed on the executors; every term that tells the labels apart by FAR
    deviations keeps a weight, and so does every word of a pair that tells much more than
    its words do, tried over all words of about PAIR_DOCS documents that can reach it.  No
    number of terms or pairs is set.  The weights are learnt in tasks (``trained``), so the
    driver holds the model and no text.  Labels that are null or not 0 or 1 are left out;
    without any, every score is one half.
    """
    learn = lambda df: df.where("doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    marks = learn(labels.select("doc_id", "toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, train_docs / max(1, marks.count()))
    # the labels dealt are bounded by train_docs, so they go to the texts, not the texts to them
    dealt = F.expr(f"pmod(xxhash64(doc_id, 11), 1000000) < {int(share * 1_000_000)}")
    rows = learn(docs.select("doc_id", "text")).where(dealt).join(F.broadcast(marks.where(dealt)), "doc_id").select("doc_id", "text", "toxic")

    def count(batches):
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for first, owner, bucket in hashed_terms(arrow_texts(batch.column("text"))):
                for k in (0, 1):
                    n[k] += np.bincount(bucket[toxic[first + owner] == k], minlength=BUCKETS)
        used = np.flatnonzero(n.sum(0))
        tidied()
        yield pa.RecordBatch.from_pydict({"bucket": used, "zeros": n[0, used], "ones": n[1, used]})

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    zeros, ones = sizes.get(0, 0), sizes.get(1, 0)
    index = np.full(BUCKETS, -1, np.int32)
    if not zeros or not ones:
        return FactorizationMachine(index, 0.0 if not zeros + ones else (4.0 if ones else -4.0), np.zeros(1), np.zeros((1, FACTORS)))
    counted = rows.mapInArrow(count, "bucket bigint, zeros bigint, ones bigint").groupBy("bucket").agg(F.sum("zeros").alias("z"), F.sum("ones").alias("o"))
    counted = stored(counted.where("z + o >= 3"), "terms")
    # how far the share of ones among a term's texts is from all texts' share, in deviations
    p = ones / (ones + zeros)
    tells = counted.withColumn("far", F.abs(F.col("o") - p * (F.col("z") + F.col("o"))) / F.sqrt((F.col("z") + F.col("o")) * F.lit(p * (1 - p))))
    best = tells.where(F.col("far") > FAR).select("bucket").toPandas()["bucket"].to_numpy()
    tried = F.expr(f"pmod(xxhash64(doc_id, 12), 1000000) < {int(min(1.0, PAIR_DOCS / (ones + zeros)) * 1_000_000)}")
    begin, term, label = _placed(_term_rows(rows.where(tried).withColumn("part", F.lit(0)), np.arange(BUCKETS), ()).toArrow())
    tidied()
    owner = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(begin))
    share = label.mean() if len(label) else 0.0
    texts = _counts(term, BUCKETS)
    words = np.flatnonzero((texts >= least_texts(share)) & (texts < len(label))) if 0 < share < 1 else np.zeros(0, np.int64)
    place = np.full(BUCKETS, -1, np.int32)
    place[words] = np.arange(len(words))
    term = place[term]
    keep = term >= 0
    owner, term = owner[keep], term[keep]
    paired = words[paired_terms(docs.sparkSession, owner, term, label, len(words))]
    del begin, owner, term, label, keep
    tidied()
    # forms of a word share its beginnings, so a pair's words bring theirs along
    chosen = np.union1d(best, np.union1d(paired, _beginnings(rows.where(tried), paired))).astype(np.int64)
    parts = max(1, round((ones + zeros) / PART_DOCS))
    texts = settled(_term_rows(rows.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc_id, 13), {parts}) as int)")), chosen).repartitionById(parts, F.col("part")))
    state = trained(texts, start(ones / (ones + zeros), max(len(chosen), 1)))
    index[chosen] = np.arange(len(chosen))
    tidied()
    return FactorizationMachine(index, float(state[-1, 0, 0]), state[:-1, 0, 0].copy(), state[:-1, 0, 1:].copy())


def _term_rows(rows: DataFrame, buckets: np.ndarray, beginnings: tuple[int, ...] = BEGINNINGS) -> DataFrame:
    """A row for each of ``rows``: part, label, a number that hangs on its terms alone, its
    terms (places in ``buckets``)."""
    index = np.full(BUCKETS, -1, np.int32)
    index[buckets] = np.arange(len(buckets))
    kept = rows.sparkSession.sparkContext.broadcast(index)

    def select(batches):
        for batch in batches:
            held = [np.zeros(0, np.int32)] * batch.num_rows
            for first, owner, bucket in hashed_terms(arrow_texts(batch.column("text")), kept.value >= 0, beginnings=beginnings):
                cut = np.searchsorted(owner, np.arange(int(owner[-1]) + 2 if len(owner) else 1))
                for k in range(len(cut) - 1):
                    held[first + k] = kept.value[bucket[cut[k] : cut[k + 1]]]
            key = [zlib.crc32(h.tobytes()) for h in held]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("toxic"), pa.array(key, pa.int64()), pa.array([h.astype(np.int32).tobytes() for h in held], pa.binary())], ["part", "toxic", "key", "terms"])
        tidied()

    return rows.select("part", "text", "toxic").mapInArrow(select, "part int, toxic int, key bigint, terms binary")


def _placed(data: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text begins among the terms, the terms of all texts, and the labels; texts
    in an order that hangs on them alone."""
    toxic, key = (data.column(c).to_numpy() for c in ("toxic", "key"))
    size = pc.binary_length(data.column("terms")).to_numpy().astype(np.int64) // 4
    order = np.lexsort((size, key, toxic))
    begin = np.concatenate(([0], np.cumsum(size[order])))
    place = np.empty(len(order), np.int64)
    place[order] = begin[:-1]
    term = np.empty(int(begin[-1]), np.int32)
    at = 0
    for chunk in data.column("terms").chunks:  # a text at a time, none is held twice
        for value in chunk:
            t = np.frombuffer(value.as_buffer(), np.int32)
            term[place[at] : place[at] + len(t)] = t
            at += 1
    return begin, term, toxic[order].astype(float)


def _beginnings(rows: DataFrame, buckets: np.ndarray) -> np.ndarray:
    """The buckets of the beginnings of words in ``buckets``."""
    marked = np.zeros(BUCKETS, bool)
    marked[buckets] = True
    if not len(buckets):
        return np.zeros(0, np.int64)

    def find(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bucket": beginnings_of(arrow_texts(batch.column("text")), marked)})
        tidied()

    return rows.select("text").mapInArrow(find, "bucket bigint").distinct().toPandas()["bucket"].to_numpy(np.int64)


def scored(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.  Null and empty texts
    have no terms and get the model's bias; other columns are not read; texts are scored
    whole, in chunks; a null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = pa.array(shared.value.scores(texts))
        tidied()
        return out

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), score(F.col(text_col)).alias("score"), F.coalesce(F.expr(f"pmod(crc32(cast(`{id_col}` as string)), 5) = 0"), F.lit(False)).alias("held_out"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` without those that score one half or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        out = pa.array(shared.value.scores(texts) < 0.5)
        tidied()
        return out

    return docs.where(clean(F.col("text"))).select(*docs.columns)
