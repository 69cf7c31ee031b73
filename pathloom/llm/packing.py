"""First-fit-decreasing packing in randomised groups of documents.

Token ids never leave the task that made them; what is shuffled is one row per piece.  A
document's full pieces fill sequences of their own, its remainder is packed with those of
a few thousand other documents, dealt to groups by a hash of their ids.  In a group,
remainders go from the longest down into the first sequence that has room, found by a
tournament tree over the room left in each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import tidied
from .store import stored
from .tokens import encoder

#: Documents that a task encodes at a time.
ENCODED_DOCS = 256
#: Documents of a group, about.
GROUP_DOCS = 4096


class Bins:
    """Room left in bins; ``place`` finds the first bin with enough of it."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(most - 1, 0).bit_length()
        self.tree = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it); the winner of each match is the larger room."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        offset = self.capacity - tree[i]
        tree[i] -= size
        b, i = i - self.leaves, i // 2
        while i:
            left, right = tree[2 * i], tree[2 * i + 1]
            best = left if left > right else right
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
        return b, offset


def pack_group(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds sequence (from 0 in the group) and offset.  Ties go by document, then start."""
    pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    sizes = pieces["length"].tolist()
    full = sum(1 for s in sizes if s == capacity)
    bins = Bins(max(len(sizes) - full, 1), capacity)
    placed = [(i, 0) for i in range(full)]
    for s in sizes[full:]:
        b, offset = bins.place(s)
        placed.append((full + b, offset))
    pieces["sequence"] = np.array([p[0] for p in placed], np.int64)
    pieces["offset"] = np.array([p[1] for p in placed], np.int64)
    return pieces


def cutter(vocabulary: str, groups: int, capacity: int):
    """The task that turns batches of pack, doc_id, text into batches of pieces."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            # rows that repeat an id and a text go to one group after another
            pack = batch["pack"].to_pandas()
            packs = ((pack + pack.groupby(pack).cumcount()) % groups).to_numpy()
            for first in range(0, batch.num_rows, ENCODED_DOCS):
                texts = batch["text"].slice(first, ENCODED_DOCS).to_pylist()
                of, start, length, crc, tokens = [], [], [], [], []
                for k, ids in enumerate(enc.encode([t or "" for t in texts]), first):
                    raw, total = ids.astype("<u4").tobytes(), len(ids)
                    for a in range(0, total, capacity):
                        b = min(a + capacity, total)
                        of.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        tokens.append(total)
                columns = {"pack": packs[of], "doc_id": batch["doc_id"].take(pa.array(of, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": tokens}
                yield pa.RecordBatch.from_pydict({name: c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for name, c in columns.items()})
            tidied()

    return cut


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of a byte-level BPE file on every executor.  Null and empty
    texts are the id 0 alone.  Rows that repeat an id are packed once each.  A text of any
    length is encoded whole and cut at multiples of ``capacity``.  An empty table gives no
    rows.  Other columns are not read.
    """
    n = docs.count()
    groups = max(1, -(-n // group_docs))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")))).alias("pack"))

    schema = "pack bigint, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = stored(texts.mapInArrow(cutter(vocabulary, groups, capacity), schema), "pieces")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_group(pdf, capacity)

    packed = pieces.groupBy("pack").applyInPandas(pack, f"{schema}, sequence bigint, offset bigint")
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("pack") * F.lit(1 << 32) + F.col("sequence")).alias("sequence_id"), "offset")
