"""Hashed terms of texts: words and the beginnings of words, in a fixed number of buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .bytewords import ALNUM, Words, chunks

BUCKETS = 1 << 18
#: Bytes of texts whose terms are made together; each byte takes some sixty.
CHUNK_BYTES = 500_000
#: Bytes of a word's beginning that make a term of their own.
BEGINNINGS = (4, 5, 6)


def hashed_terms(texts, marked: np.ndarray | None = None, signs: bool = False, beginnings: tuple[int, ...] = BEGINNINGS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of texts: index of the first text, text of each term (from there), bucket
    of each term; each pair once.  ``marked`` (by bucket) keeps only terms it marks.
    ``signs`` adds runs of signs between words as terms; without ``beginnings`` only words are."""
    for first, held in chunks(texts, CHUNK_BYTES):
        w = Words(held, ALNUM)
        text = w.text_of_word()
        parts, owner = [w.hash], [text]
        size = w.end - w.start
        for k in beginnings:
            long = np.flatnonzero(size > k)
            parts.append(w.span_hash(w.start[long], w.start[long] + k) * np.uint64(2 * k + 1))
            owner.append(text[long])
        if signs and len(w.start):
            same = np.flatnonzero(text[1:] == text[:-1])
            parts.append(w.span_hash(w.end[same], w.start[same + 1]) * np.uint64(3))
            owner.append(text[same])
        h, owner = np.concatenate(parts), np.concatenate(owner)
        bucket = (h >> np.uint64(46)).astype(np.int64)
        if marked is not None:
            keep = marked[bucket]
            bucket, owner = bucket[keep], owner[keep]
        both = np.unique(owner * BUCKETS + bucket)
        yield first, both // BUCKETS, both % BUCKETS


def beginnings_of(texts, marked: np.ndarray) -> np.ndarray:
    """Buckets of the beginnings of the words in ``texts`` whose own bucket is ``marked``."""
    found = np.zeros(BUCKETS, bool)
    for _, held in chunks(texts, CHUNK_BYTES):
        w = Words(held, ALNUM)
        mine = np.flatnonzero(marked[(w.hash >> np.uint64(46)).astype(np.int64)])
        for k in BEGINNINGS:
            start = w.start[mine[w.end[mine] - w.start[mine] > k]]
            found[((w.span_hash(start, start + k) * np.uint64(2 * k + 1)) >> np.uint64(46)).astype(np.int64)] = True
    return np.flatnonzero(found)
