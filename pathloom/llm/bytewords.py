"""Words of many texts at once: numpy over the UTF-8 bytes of a chunk of texts.

A chunk is a few megabytes, whatever the batch that Spark hands over; a text longer than
that makes a chunk of its own, so no text is ever cut.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000

#: A longer span is hashed by itself, not in step with the others.
LONG_BYTES = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
# by number of bytes: what a load of eight keeps of a span that ends inside it
_ENDS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and everything beyond ASCII, once A-Z is lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words of everything but blank, tab, line feed, vertical tab, form feed, return.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``raw``: equal bytes give equal hashes wherever they
    stand.  Eight bytes at a time go through ``mix``, so no pattern of bytes cancels out,
    as it can in a polynomial modulo a power of two."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    size = end - start
    h = mix(size.astype(np.uint64) * _STEP + _STEP)
    live = np.flatnonzero((size > 0) & (size <= LONG_BYTES))
    at, left, part = start[live], size[live], h[live]
    while len(live):
        part = mix((part ^ (eights[at] & _ENDS[np.minimum(left, 8)])) * _STEP + _STEP)
        ends = left <= 8
        h[live[ends]] = part[ends]
        more = ~ends
        live, at, left, part = live[more], at[more] + 8, left[more] - 8, part[more]
    for k in np.flatnonzero(size > LONG_BYTES):
        h[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def encoded(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")


def tidied() -> None:
    """Gives memory that is free back to the system: workers live on after a task, and what
    they keep adds up beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def arrow_texts(column: pa.Array, step: int = 256) -> Iterator[bytes | None]:
    """The texts of an Arrow column as UTF-8, a few at a time."""
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for a in range(0, len(raw), step):
        yield from raw.slice(a, step).to_pylist()


def chunks(texts: Iterable[str | bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, encoded texts) with about ``limit`` bytes each."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        b = encoded(text)
        if held and size + len(b) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


class Words:
    """The words of a chunk: byte offsets, 64-bit hashes, and each text's share of them."""

    def __init__(self, texts: list[bytes], word: np.ndarray):
        self.bytes = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        flags = np.empty(len(self.bytes) + 1, np.int8)
        flags[0] = 0
        flags[1:] = word[self.bytes]
        edge = np.diff(flags)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.text_start)
        self.counts = np.diff(self.first)
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hashes(self.bytes, start, end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)
