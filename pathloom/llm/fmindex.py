"""Benchmark decontamination with an FM-index per shard of documents.

The test items' words make the alphabet.  A shard (a chunk of a task's documents) becomes
one sequence of word numbers in which a separator stands for every run of words that no
item holds; stretches too short for the shortest test phrase hold no occurrence and are
left out.  The shard's FM-index is a wavelet matrix over the Burrows-Wheeler transform of
that sequence; all phrases are searched at once, last word first, by ranks; occurrences are
located by walking back to sampled suffix positions.  Their spans are merged per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, arrow_texts, chunks, encoded, tidied

WINDOW_WORDS = 10
#: Bytes of item texts that one broadcast holds; more items are searched block by block.
BLOCK_BYTES = 16_000_000
#: Every so many positions of a stretch are kept for locating.
SAMPLE = 8


class Phrases:
    """Windows of ``size`` consecutive words of the items; an item of fewer words is one
    window.  Equal windows are kept once, with all the items that hold them."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW_WORDS):
        grams: dict[bytes, set] = {}
        for item, text in items:
            w = Words([encoded(text)], ALNUM)
            words = [w.bytes[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
            for i in range(max(len(words) - size + 1, 1) if words else 0):
                grams.setdefault(b" ".join(words[i : i + size]), set()).add(item)
        self.grams = list(grams)
        self.items = [sorted({str(x) for x in held if x is not None}) for held in grams.values()]
        split = [g.split(b" ") for g in self.grams]
        vocabulary = sorted({x for g in split for x in g})
        h = Words([b" ".join(vocabulary)], ALNUM).hash if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.number = (order + 2).astype(np.int32)  # 0 ends the sequence, 1 separates
        number = {w: i + 2 for i, w in enumerate(vocabulary)}
        self.length = np.array([len(g) for g in split], np.int64)
        self.codes = np.zeros((len(split), size), np.int32)
        for i, g in enumerate(split):
            self.codes[i, size - len(g) :] = [number[x] for x in g]
        self.least = int(self.length.min()) if len(split) else 0
        self.alphabet = len(vocabulary) + 2
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, 1 for words that no item holds."""
        out = np.ones(len(hashes), np.int32)
        near = np.flatnonzero(self.known[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[near]), len(self.hashes) - 1)
        same = self.hashes[at] == hashes[near]
        out[near[same]] = self.number[at[same]]
        return out


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling.  Separators differ from each other by position,
    so ranks are settled after about log2 of the longest stretch rounds."""
    n = len(seq)
    rank = seq.astype(np.int64) + n
    cuts = np.flatnonzero(seq <= 1)
    rank[cuts] = np.arange(len(cuts))[::-1]  # the end mark stands last and is the least
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        ordered = rank[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if new[-1] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: n - k] = ranks[k:] + 1
        rank = ranks * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector per level of the symbol's bits."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(alphabet - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            self.levels.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position i."""
        low = np.zeros_like(i)
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            i = np.where(bit, zeros + ones[i], i - ones[i])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return i - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions i, and how often each stands before its position."""
        symbol, at = np.zeros_like(i), i
        low = np.zeros_like(i)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            bit = ones[at + 1] > ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return symbol, at - low


class FMIndex:
    """Counts and locates phrases in a sequence that ends with 0."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        order = suffix_order(seq)
        self.tree = WaveletMatrix(seq[order - 1].astype(np.int64), alphabet)
        counts = np.bincount(seq, minlength=alphabet)
        self.before = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.n = len(seq)
        at = np.arange(len(seq))
        in_stretch = at - np.maximum.accumulate(np.where(seq <= 1, at, -1)) - 1
        kept = (in_stretch % SAMPLE == 0)[order]  # the first of a stretch is kept, so no walk leaves it
        self.sampled = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]

    def search(self, codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes start with each phrase; codes are aligned
        to the right."""
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), self.n, np.int64)
        for step in range(codes.shape[1]):
            live = np.flatnonzero((length > step) & (low < high))
            if not len(live):
                break
            symbol = codes[live, codes.shape[1] - 1 - step].astype(np.int64)
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: steps back through the text until a sampled suffix."""
        out, steps = np.zeros(len(rows), np.int64), 0
        open_, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            hit = self.sampled[at + 1] > self.sampled[at]
            out[open_[hit]] = self.positions[self.sampled[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            if len(open_):
                symbol, before = self.tree.access(at)
                at = self.before[symbol] + before
                steps += 1
        return out


def occurrences(w: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in the chunk, words counted over it."""
    none = np.zeros(0, np.int64)
    if not len(phrases.grams) or not len(w.hash):
        return none, none
    number = phrases.numbers(w.hash)
    # stretches of known words inside one text, no shorter than the shortest phrase
    text = w.text_of_word()
    known = number > 1
    edge = np.ones(len(number), bool)
    edge[1:] = (known[1:] != known[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(edge)
    size = np.diff(np.append(begin, len(number)))
    keep = known[begin] & (size >= phrases.least)
    begin, size = begin[keep], size[keep]
    if not len(begin):
        return none, none
    place = np.concatenate(([0], np.cumsum(size + 1)))
    seq = np.ones(place[-1] + 1, np.int32)
    seq[-1] = 0
    word = np.full(len(seq), -1, np.int64)
    inside = np.arange(int(size.sum())) + np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    seq[at], word[at] = number[inside], inside
    index = FMIndex(seq, phrases.alphabet)
    low, high = index.search(phrases.codes, phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(int(count.sum())) + np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    first = word[index.locate(rows)]
    # hashes stand for words up to here: compare the words themselves
    good = np.fromiter((b" ".join(w.bytes[w.start[k] : w.end[k]].tobytes() for k in range(a, a + phrases.length[p])) == phrases.grams[p] for a, p in zip(first, which, strict=True)), bool, len(first))
    return first[good], which[good]


def scan(texts: Iterable[str | bytes | None], phrases: Phrases):
    """For each text: its number of words, merged (first, end) word spans, the items that
    occur, and the same spans in bytes of its UTF-8 form."""
    for _, held in chunks(texts):
        w = Words(held, ALNUM)
        first, which = occurrences(w, phrases)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + phrases.length[which] if len(which) else first, -1)
        hit = np.cumsum(cover)[:-1] > 0
        text = w.text_of_word()
        edge = np.ones(len(hit), bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(hit))
        begin, end = begin[hit[begin]] if len(begin) else begin, end[hit[begin]] if len(begin) else begin
        spans: dict[int, list] = {}
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            spans.setdefault(int(text[a]), []).append((a, b))
        items: dict[int, set] = {}
        for t, p in set(zip(text[first].tolist(), which.tolist(), strict=True)):
            items.setdefault(t, set()).update(phrases.items[p])
        for k in range(len(held)):
            base, byte = int(w.first[k]), int(w.text_start[k])
            own = spans.get(k, [])
            yield int(w.counts[k]), [(a - base, b - base) for a, b in own], items.get(k, set()), [(int(w.start[a]) - byte, int(w.end[b - 1]) - byte) for a, b in own]


def _blocks(items: DataFrame, size: int) -> list[Broadcast]:
    """The test items, a broadcast for each block of bounded bytes; the driver holds one
    block at a time, the workers hold all: a benchmark, not a corpus."""
    share = items.sparkSession.sparkContext.broadcast
    held, blocks, total = [], [], 0
    for row in items.toLocalIterator():
        held.append((row[0], row[1]))
        total += len(encoded(row[1]))
        if total > BLOCK_BYTES:
            blocks.append(share(Phrases(held, size)))
            held, total = [], 0
    if held or not blocks:
        blocks.append(share(Phrases(held, size)))
    return blocks


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; null and empty items have no windows; an item
    without an id is searched but not counted.  Rows that repeat an id are rows like any
    other.  Texts are read whole.  Other columns are not read.
    """
    blocks = _blocks(items.select(item_id, item_text), size)
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"))

    def find(batches):
        for pdf in batches:
            names, rows = pdf["__id"].to_numpy(), []
            texts = pdf["__text"].tolist()
            for found in zip(*(scan(texts, b.value) for b in blocks), strict=True):
                hit: set = set()
                for f in found:
                    for a, b in f[1]:
                        hit.update(range(a, b))
                ids = sorted(set().union(*(f[2] for f in found)))
                rows.append((found[0][0], len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
            out = pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            out.insert(0, "__id", names)
            yield out
        tidied()

    out = texts.mapInPandas(find, "__id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")
    return out.withColumnRenamed("__id", id_col)


def without_phrases(text: str, phrases: list[Phrases]) -> str:
    """``text`` without the words of any occurrence; what the cut brings together is
    searched again."""
    while True:
        raw = encoded(text)
        cut = np.zeros(len(raw) + 1, np.int64)
        for p in phrases:
            for *_, spans in scan([text], p):
                for a, b in spans:
                    cut[a] += 1
                    cut[b] -= 1
        if not cut.any():
            return text
        keep = np.cumsum(cut)[:-1] == 0
        text = np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "ignore")


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` with every occurrence of a test phrase cut out of text, and n_chars to
    match; other documents and columns stay as they are."""
    blocks = _blocks(items.select("item_id", "text"), size)

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        dirty = sorted({k for b in blocks for k, found in enumerate(scan(arrow_texts(texts), b.value)) if found[1]})
        if dirty:
            mask = np.zeros(len(texts), bool)
            mask[dirty] = True
            texts = pc.replace_with_mask(texts, mask, pa.array([without_phrases(texts[k].as_py(), [b.value for b in blocks]) for k in dirty], texts.type))
        tidied()
        return texts

    # the given columns stay together, so none of their names can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), cut("text").alias("text"))
    same = F.col("text").eqNullSafe(F.col("row.text"))
    new = {"text": F.col("text"), "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
