"""Token ids of many texts at once, for byte-level BPE vocabularies.

A byte-level BPE works on pre-tokens (a word with the blank before it, a run of digits, of
signs, of white space), each on its own.  So a chunk of texts is cut into pre-tokens with
numpy, each distinct one is given to the tokenizer once, and ids are put together by
lookup.  Texts that hold a special token's string are given to the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from .bytewords import span_hashes

LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
#: Characters of a chunk; a longer text makes a chunk of its own.
CHUNK_CHARS = 250_000
#: Distinct pre-tokens that a worker remembers before it drops those not met again.
REMEMBERED = 500_000
#: Pre-tokens that the tokenizer is given at a time: what it returns is large beside their ids.
LEARNT = 2048

_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_END_MARK = 0x110000
_tables: dict[str, np.ndarray] = {}
_encoders: dict[str, "Encoder"] = {}


def kinds() -> np.ndarray:
    """The kind of each code point, and END for the mark behind each text."""
    if "kinds" not in _tables:
        kind = np.full(_END_MARK + 1, OTHER, np.uint8)
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))[0]
            if c in "LN":
                kind[cp] = LETTER if c == "L" else NUMBER
        kind[[ord(c) for c in _SPACES]] = SPACE
        kind[_END_MARK] = END
        _tables["kinds"] = kind
    return _tables["kinds"]


def pretoken_starts(cp: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points of texts that end with a mark each.

    Runs of letters, of digits and of other signs take one blank before them along; white
    space before a word stays in one piece but for its last character; the contractions
    's 't 're 've 'm 'll 'd are pieces where no sign and no blank stands before them.
    """
    kind = kinds()[cp]
    before = np.concatenate(([END], kind[:-1])).astype(np.uint8)
    blank_before = np.concatenate(([False], cp[:-1] == 32))
    after = np.concatenate((kind[1:], [END])).astype(np.uint8)
    space = kind == SPACE
    start = np.where(space, (before != SPACE) | ((after != SPACE) & (after != END)), (kind != before) & ~(blank_before & (kind != END)))
    start |= (kind == END) | (before == END)
    quotes = np.flatnonzero((cp == 39) & ~blank_before & (before != OTHER))
    if len(quotes):
        padded = np.concatenate((cp, [0, 0]))
        one, two = padded[quotes + 1], padded[quotes + 2]
        pair = one * np.uint32(256) + two
        long = np.isin(pair, [ord("r") * 256 + ord("e"), ord("v") * 256 + ord("e"), ord("l") * 256 + ord("l")]) & (one < 256) & (two < 256)
        short = np.isin(one, [ord(c) for c in "stmd"])
        for at, size in ((quotes[short], 2), (quotes[long & ~short], 3)):
            start[at + 1] = False
            start[at + size] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids by ``tokenizers`` for the vocabulary file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.offset = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.again = np.zeros(0, bool)

    def drop(self) -> None:
        """Only what was met again since it was learnt or last kept stays, and at most half."""
        kept = np.flatnonzero(self.again)
        if len(kept) > REMEMBERED // 2:
            self.forget()
            return
        size = self.size[kept]
        reach = np.cumsum(size)
        ids = np.arange(int(size.sum())) + np.repeat(self.offset[kept] - (reach - size), size)
        self.known, self.offset, self.size, self.pool = self.known[kept], reach - size, size, self.pool[ids]
        self.again = np.zeros(len(kept), bool)

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted hashes stand among the known ones, and which of them are known."""
        at = np.searchsorted(self.known, hashes)
        if not len(self.known):
            return at, np.zeros(len(hashes), bool)
        at = np.minimum(at, len(self.known) - 1)
        return at, self.known[at] == hashes

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """``hashes`` are sorted and new."""
        pools, sizes = [self.pool], [np.zeros(0, np.int64)]
        for first in range(0, len(pieces), LEARNT):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[first : first + LEARNT], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            pools.append(np.fromiter((i for x in ids for i in x), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        offset = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate(pools)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.offset = np.insert(self.offset, at, offset)
        self.size = np.insert(self.size, at, size)
        self.again = np.insert(self.again, at, False)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, each followed by the id 0."""
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        plain, size = [], 0
        for i, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[i] = np.append(self.whole(text), np.uint32(0))
                continue
            if plain and size + len(text) > CHUNK_CHARS:
                self._chunk(texts, plain, out)
                plain, size = [], 0
            plain.append(i)
            size += len(text)
        if plain:
            self._chunk(texts, plain, out)
        return out

    def _chunk(self, texts: list[str], index: list[int], out: list[np.ndarray]) -> None:
        sizes = np.fromiter((len(texts[i]) + 1 for i in index), np.int64, len(index))
        joined = "\0".join(texts[i] for i in index) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum(sizes) - 1
        cp[ends] = _END_MARK
        start = pretoken_starts(cp)
        stop = np.append(start[1:], len(cp))
        h = span_hashes(cp.view(np.uint8), 4 * start, 4 * stop)
        found, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        marks = cp[start[first]] == _END_MARK
        at, known = self.place(found)
        self.again[at[known]] = True
        new = ~known & ~marks
        if new.any():
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self.drop()
                new = ~self.place(found)[1] & ~marks
            self.learn(found[new], [joined[start[i] : stop[i]] for i in first[new]])
            at = self.place(found)[0]
        pool = np.append(self.pool, np.uint32(0))  # the last one is the id 0 behind a text
        size = np.where(marks, 1, self.size[at] if len(self.known) else 1)[inverse]
        offset = np.where(marks, len(pool) - 1, self.offset[at] if len(self.known) else 0)[inverse]
        reach = np.cumsum(size)
        ids = pool[np.arange(reach[-1]) - np.repeat(reach - size - offset, size)]
        cut = reach[np.searchsorted(start, ends)]
        for i, a, b in zip(index, np.append(0, cut[:-1]), cut, strict=True):
            out[i] = ids[a:b]


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
