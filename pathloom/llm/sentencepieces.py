"""SentencePiece ids of many texts at once, for merge-type (BPE) vocabularies.

A text is normalised by the library, then cut between any two characters that stand side by
side in no piece of the vocabulary: no merge can ever cross such a place, so each chunk is
encoded by itself.  Each distinct chunk goes once through the agenda: adjacent symbol pairs
that make a piece, the best score first and the leftmost of equals, merged until none is
left.  What the agenda says of new chunks is compared with the library, all new chunks of a
part in one call; a difference is an error, never a result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import span_hashes, tidied

#: Characters of texts that are encoded together; a longer text makes a part of its own.
PART_CHARS = 400_000
#: Distinct chunks that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000

_END = 0x110000
_known: dict[str, "Pieces"] = {}


class Pieces:
    """Ids by the agenda for the model file at ``path``: a BPE model without symbols of the
    user's own and without unused pieces; any other is refused."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(len(self.library))
        self.pieces, self.bytes, scores = {}, {}, []
        for i in ids:
            piece = self.library.IdToPiece(i)
            if self.library.IsByte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif self.library.IsUnused(i):
                raise ValueError("a model with unused pieces is not supported")
            elif not (self.library.IsControl(i) or self.library.IsUnknown(i)):
                self.pieces[piece] = i
                scores.append((i, self.library.GetScore(i)))
        self.score = dict(scores)
        if any(s > 0 or s != int(s) for _, s in scores):  # merges are scored by their rank, words by a logarithm
            raise ValueError("the scores are not those of merges: not a BPE model")
        self.end = self.library.eos_id()
        self.unknown = self.library.unk_id()
        pairs = {(ord(a) << 21) | ord(b) for p in self.pieces for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.uint64)
        held = set("".join(self.pieces))
        self.apart = next(c for c in map(chr, (10, *range(0xE000, 0xF8FF))) if c not in held)
        # what the library says of that character, and of it behind the mark that begins a text
        one, two = (self.library.encode(self.apart * k) for k in (1, 2))
        self.apart_ids, self.first_ids = two[len(one) :], one
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.offset = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def agenda(self, chunk: str) -> list[int]:
        """The ids of a chunk.  Symbols are a linked list over the characters; an entry of
        the agenda is stale if a symbol of its pair has grown or gone since."""
        symbol = list(chunk)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pieces, score = self.pieces, self.score
        heap = []
        for i in range(n - 1):
            found = pieces.get(symbol[i] + symbol[i + 1])
            if found is not None:
                heap.append((-score[found], i, i + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not symbol[i] or not symbol[j] or len(symbol[i]) + len(symbol[j]) != size or after[i] != j:
                continue
            symbol[i] += symbol[j]
            symbol[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    joined = symbol[a] + symbol[b]
                    found = pieces.get(joined)
                    if found is not None:
                        heapq.heappush(heap, (-score[found], a, b, len(joined)))
        out = []
        for s in symbol:
            if s:
                found = pieces.get(s)
                if found is not None:
                    out.append(found)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode("utf-8", "replace")]
                elif not out or out[-1] != self.unknown:  # unknown characters in a row are one
                    out.append(self.unknown)
        return out

    def learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """``hashes`` are sorted and new."""
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self.forget()
        ids = [self.agenda(c) for c in chunks]
        self.compare(chunks, ids)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        offset = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate((self.pool, np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.offset = np.insert(self.offset, at, offset)
        self.size = np.insert(self.size, at, size)

    def compare(self, chunks: list[str], ids: list[list[int]]) -> None:
        """Asks the library for the chunks, side by side with a character between them that
        stands in no piece."""
        if not self.bytes:  # there unknown characters run together with that character
            return
        want = list(self.first_ids)
        for k, x in enumerate(ids):
            want += x if k == 0 else self.apart_ids + x
        got = self.library.encode(self.apart + self.apart.join(chunks))
        if got != want:
            raise ValueError("the agenda and the library differ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, the end id behind them."""
        out: list[np.ndarray] = []
        part: list[str] = []
        size = 0
        for text in texts:
            if part and size + len(text) > PART_CHARS:
                out += self._part(part)
                part, size = [], 0
            part.append(text)
            size += len(text)
        return out + (self._part(part) if part else [])

    def _part(self, texts: list[str]) -> list[np.ndarray]:
        shown = self.library.Normalize(texts)
        sizes = np.fromiter((len(t) + 1 for t in shown), np.int64, len(shown))
        joined = "\0".join(shown) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum(sizes) - 1
        cp[ends] = _END
        pair = (cp[:-1].astype(np.uint64) << np.uint64(21)) | cp[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        meets = self.pairs[at] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        start = np.flatnonzero(np.concatenate(([True], ~meets)))
        if not self.bytes:
            start = np.flatnonzero(np.concatenate(([True], (cp[1:] == _END) | (cp[:-1] == _END))))
        stop = np.append(start[1:], len(cp))
        found, first, inverse = np.unique(span_hashes(cp.view(np.uint8), 4 * start, 4 * stop), return_index=True, return_inverse=True)
        marks = cp[start[first]] == _END
        new = ~marks
        if len(self.hashes):
            new &= self.hashes[np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)] != found
        if new.any():
            if len(self.hashes) + int(new.sum()) > REMEMBERED:
                self.forget()
                new = ~marks
            self.learn(found[new], [joined[start[i] : stop[i]] for i in first[new]])
        # the last id of the pool is the end id, which stands for the mark behind each text
        pool = np.append(self.pool, np.int32(self.end))
        at = np.minimum(np.searchsorted(self.hashes, found), max(len(self.hashes) - 1, 0))
        size = np.where(marks, 1, self.size[at] if len(self.hashes) else 1)[inverse]
        offset = np.where(marks, len(pool) - 1, self.offset[at] if len(self.hashes) else 0)[inverse]
        reach = np.cumsum(size)
        ids = pool[np.arange(reach[-1]) - np.repeat(reach - size - offset, size)]
        cut = reach[np.searchsorted(start, ends)]
        return [ids[a:b] for a, b in zip(np.append(0, cut[:-1]), cut, strict=True)]


def pieces_of(path: str) -> Pieces:
    """The worker's own encoder for a model file."""
    if path not in _known:
        _known[path] = Pieces(path)
    return _known[path]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` (array<int>: the pieces of the whole text and
    the end id), ``decoded`` (the text that the library makes of these ids).

    A null text counts as empty: the end id alone, decoded to an empty text.  Repeated rows
    and null ids are rows like any other; other columns, whatever their names, are not read.
    A text is never cut at a length: its time and memory grow with its own size.  An empty
    table gives an empty table.
    """

    def encode(batches):
        pieces = pieces_of(model)
        for batch in batches:
            for part in _parts(batch):
                texts = part.column("__text").to_pylist()
                ids = pieces.encode(texts)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = pa.array(np.concatenate(ids) if len(ids) else np.zeros(0, np.int32), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), flat)
                decoded = pa.array(pieces.library.decode([x.tolist() for x in ids], num_threads=1), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("__id"), lists, decoded], ["__id", "ids", "decoded"])
        tidied()

    kind = dict(docs.select(id_col).dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return texts.mapInArrow(encode, f"__id {kind}, ids array<int>, decoded string").withColumnRenamed("__id", id_col)


def _parts(batch: pa.RecordBatch, rows: int = 256) -> list[pa.RecordBatch]:
    return [batch.slice(a, rows) for a in range(0, batch.num_rows, rows)]
