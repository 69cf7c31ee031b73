"""N-gram Jaccard join by grouped prefixes.

1. Each text becomes its set of distinct word shingles (64-bit hashes, numpy per chunk).
2. Shingles have one global order: by the level of the number of texts that hold them,
   counted over all texts, rare ones first, else by hash.  Two sets of sizes n, m with
   Jaccard >= t share one of the first n - ceil(t n) + 1 shingles of each: the prefix.
3. Equal sets collapse to one unit, units with the same size and prefix to one group, and
   only groups are posted under their prefix shingles.
4. In each posting list all groups are tried against its PIVOTS least ones; each unit's
   closest candidate by bitmaps is verified on the texts.  Such links lead from larger to
   smaller names, so classes are the ends of chains.
5. In lists with more groups than that, what is not of the list's largest class meets this
   class as a whole: units against slices of its members, a block of bounded size of both in
   each task, which finds one link in a slice by an inverted index over the shingles.
6. What could still link two *different* classes is enumerated, filtered by size and by
   bitmaps (both never lose a link), and verified on the texts.  Classes joined by those
   links are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import NONSPACE, Words, arrow_texts, chunks, mix, tidied
from .components import components
from .store import removed, sized, stored

SHINGLE_WORDS = 5
#: A shingle in fewer texts than this is rare (level 0), whatever the number of texts; each
#: level above takes four times as many as the one before, up to level 7.
RARE_TEXTS = 8
#: Shingles that a task counts before it reports them.
REPORTED = 3_000_000
#: Texts whose shingles, about, are added up in one group.
GROUP_TEXTS = 1000
#: Shingles above level 0 that every task holds, at most: with more, the lowest levels join level 0.
LEVELLED = 4_000_000
#: Groups of a posting list that all its groups are tried against.
PIVOTS = 8
#: Shingles of a class that one task holds, about, and of the units that meet them there.
SLICE_SHINGLES = 50_000
BLOCK_SHINGLES = 200_000
#: Sets of shingles that a task remembers, to describe copies once only.
REMEMBERED = 1_000_000

#: Bits of a shingle's hash; its level stands above them.
_BITS = 61
_SIGNED = "__id bigint, __key bigint, n_shingles bigint, uid bigint, prefix array<bigint>, bitmap binary"


class Levels:
    """Levels of the shingles in many texts, by the upper bits of their hashes."""

    def __init__(self, keys: np.ndarray, level: np.ndarray, shift: int):
        self.keys, self.level, self.shift = keys, level, np.uint64(shift)
        self.near = np.zeros(1 << 22, bool)
        self.near[self._bucket(keys << self.shift)] = True

    @staticmethod
    def _bucket(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(_BITS - 22)).astype(np.int64)

    def mark(self, h: np.ndarray) -> None:
        """Puts each hash's level above its bits."""
        if not len(self.keys):
            return
        near = np.flatnonzero(self.near[self._bucket(h)])
        key = h[near] >> self.shift
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        h[near[hit]] |= self.level[at[hit]].astype(np.uint64) << np.uint64(_BITS)


def shingle_sets(texts, words: int, levels: Levels | None = None) -> Iterator[np.ndarray]:
    """One sorted array of distinct shingle hashes for each text: fewer words than a
    shingle make one shingle, none make an empty set.  The top bits hold the level, so
    the rarest sort first."""
    spare = np.uint64(64 - _BITS)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    for _, held in chunks(texts):
        w = Words(held, NONSPACE)
        n = len(w.hash)
        rolled = np.zeros(max(n - words + 1, 0), np.uint64)
        for k in range(words if len(rolled) else 0):
            rolled += w.hash[k : n - words + 1 + k] * factors[k]
        rolled = mix(rolled) >> spare
        if levels is not None:
            levels.mark(rolled)
        for first, count in zip(w.first, w.counts, strict=False):
            if count >= words:
                yield np.unique(rolled[first : first + count - words + 1])
            elif count:
                few = w.hash[first : first + count] * factors[:count]
                one = mix(np.array([few.sum(dtype=np.uint64) + np.uint64(count)])) >> spare
                if levels is not None:
                    levels.mark(one)
                yield one
            else:
                yield np.zeros(0, np.uint64)


def _need(n: int, similarity: int) -> int:
    return -(-similarity * n // 100)


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash modulo the size, a power of two from four bits a hash on."""
    size = max(256, 1 << int(4 * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def bitmap_distance(a: bytes, b: bytes) -> int:
    """At most the number of elements that only one of the two sets holds: each bit that
    differs stands for one of them at least."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (a, b))
    size = min(len(x), len(y))
    x, y = (v.reshape(-1, size).max(axis=0) for v in (x, y))
    return int(np.count_nonzero(x != y))


def shingle_levels(texts: DataFrame, words: int, n_texts: int) -> Levels:
    """The level of each shingle that stands in RARE_TEXTS texts or more, counted over all
    texts.  Only the *order* of shingles hangs on it, never a result.

    Shingles are named by the upper bits of their hashes: a range of hashes, whose number
    grows with the texts, and 24 bits in it, three bytes for each in the shuffle.
    """
    ranges = min(max((n_texts // GROUP_TEXTS).bit_length(), 4), 20)
    shift = _BITS - ranges - 24

    def counted(held: np.ndarray) -> pa.RecordBatch:
        keys, count = np.unique(held >> np.uint64(shift), return_counts=True)
        low = np.ascontiguousarray(keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
        count = np.minimum(count, 65535).astype("<u2")
        first = np.searchsorted(keys, np.arange((1 << ranges) + 1, dtype=np.uint64) << np.uint64(24))
        there = np.flatnonzero(np.diff(first))
        parts = [(low[first[r] : first[r + 1]].tobytes(), count[first[r] : first[r + 1]].tobytes()) for r in there]
        return pa.RecordBatch.from_pydict({"range": there.astype(np.int32), "low": pa.array([x for x, _ in parts], pa.binary()), "count": pa.array([x for _, x in parts], pa.binary())})

    def report(batches):
        held, n = [], 0
        for batch in batches:
            for s in shingle_sets(arrow_texts(batch.column("__text")), words):
                held.append(s)
                n += len(s)
                if n >= REPORTED:
                    yield counted(np.concatenate(held))
                    held, n = [], 0
        if held:
            yield counted(np.concatenate(held))
        del held
        tidied()

    def added(key, pdf):
        low = np.zeros((sum(map(len, pdf["low"])) // 3, 4), np.uint8)
        low[:, :3] = np.frombuffer(b"".join(pdf["low"]), np.uint8).reshape(-1, 3)
        keys, at = np.unique(low.view("<u4").ravel(), return_inverse=True)
        count = np.bincount(at, np.frombuffer(b"".join(pdf["count"]), "<u2"), len(keys))
        many = np.flatnonzero(count >= RARE_TEXTS)
        level = np.minimum(np.log2(count[many] / RARE_TEXTS) // 2 + 1, 7)
        out = pd.DataFrame({"key": (int(key[0]) << 24) + keys[many].astype(np.int64), "level": level.astype(np.int8)})
        del low, keys, at, count
        tidied()
        return out

    rows = stored(texts.select("__text").mapInArrow(report, "range int, low binary, count binary").groupBy("range").applyInPandas(added, "key bigint, level tinyint"), "levels")
    least, total = 8, 0
    for level, k in sorted(rows.groupBy("level").count().collect(), reverse=True):
        total += k
        if total > LEVELLED:
            break
        least = level
    found = rows.where(F.col("level") >= least).toPandas().sort_values("key")
    removed(rows)
    return Levels(found["key"].to_numpy(np.int64).astype(np.uint64), found["level"].to_numpy(np.uint8), shift)


def _signed(texts: DataFrame, words: int, similarity: int, levels: Levels) -> DataFrame:
    """The rows of ``texts`` by id and key, each with the size of its set and the set's
    name; prefix and bitmap only where a task meets the set for the first time."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def sign(batches):
        seen: set[int] = set()
        for batch in batches:
            n, uid, prefix, maps = [], [], [], []
            for s in shingle_sets(arrow_texts(batch.column("__text")), words, shared.value):
                k = len(s)
                name = int(mix((mix(s).sum(dtype=np.uint64) + np.uint64(k))[None]).view(np.int64)[0]) if k else None
                new = k > 0 and name not in seen
                if new:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                n.append(k)
                uid.append(name)
                prefix.append(s[: k - _need(k, similarity) + 1].view(np.int64) if new else None)
                maps.append(bitmap(s) if new else None)
            columns = [batch.column("__id"), batch.column("__key"), pa.array(n, pa.int64()), pa.array(uid, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "__key", "n_shingles", "uid", "prefix", "bitmap"])
        tidied()

    # the number tells rows apart that repeat an id and a text; once stored it stays
    return texts.mapInArrow(sign, _SIGNED).withColumn("row", F.monotonically_increasing_id())


def _texts(uids: DataFrame, units: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of some units: (uid, text)."""
    needed = stored(units.select("uid", "__key").join(uids.distinct(), "uid", "left_semi"), "needed")
    return stored(texts.join(sized(needed), "__key").select("uid", F.col("__text").alias("text")).dropDuplicates(["uid"]), "texts")


def _verified(pairs: DataFrame, units: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """The pairs (a, b of uid) whose texts reach the similarity."""
    found = _texts(pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))), units, texts)
    both = pairs.join(found.select(F.col("uid").alias("a"), F.col("text").alias("s")), "a").join(found.select(F.col("uid").alias("b"), F.col("text").alias("t")), "b")

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(arrow_texts(batch.column("s")), words), shingle_sets(arrow_texts(batch.column("t")), words), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        tidied()

    return both.mapInArrow(verify, "a bigint, b bigint")


def _filtered(pairs: DataFrame, units: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b of uid; a stored table, each pair once) that sizes and bitmaps let
    through, and the bitmaps' distance."""
    pairs = sized(pairs)  # few pairs go to the bitmaps, many meet them in a shuffle
    side = lambda c, n, m: pairs.join(units.select(F.col("uid").alias(c), F.col("n_shingles").alias(n), F.col("bitmap").alias(m)), c)
    both = side("a", "n", "x").join(side("b", "m", "y"), ["a", "b"]).where(F.expr(f"100 * least(n, m) >= {similarity} * greatest(n, m)"))

    def passes(batches):
        for pdf in batches:
            pdf["far"] = np.array([bitmap_distance(x, y) for x, y in zip(pdf["x"], pdf["y"], strict=True)], np.int64)
            total = pdf["n"] + pdf["m"]
            shared = (total - pdf["far"]) // 2
            yield pdf.loc[100 * shared >= similarity * (total - shared), ["a", "b", "far"]]
        tidied()

    return both.mapInPandas(passes, "a bigint, b bigint, far bigint")


class Members:
    """An inverted index over the shingles of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        by = np.argsort(shingle, kind="stable")
        self.owner = owner[by]
        self.shingle, self.first = np.unique(shingle[by], return_index=True)
        self.first = np.append(self.first, len(shingle))

    def shared(self, s: np.ndarray) -> np.ndarray:
        """How many shingles of ``s`` each set holds."""
        at = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
        at = at[self.shingle[at] == s]
        size = self.first[at + 1] - self.first[at]
        rows = np.arange(int(size.sum())) + np.repeat(self.first[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        return np.bincount(self.owner[rows], minlength=len(self.size))


def _in_blocks(meeting: DataFrame, hubs: DataFrame, units: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Links of units with classes that they meet as a whole: (a of uid, b of uid), at least
    one for each unit and class that any link joins.

    ``meeting`` (uid, hub) and ``hubs`` (uid, hub: the class's members) are dealt to slices
    and blocks of about SLICE_SHINGLES and BLOCK_SHINGLES by a hash of the uid; each block
    of units meets each slice of their class in a task of its own.
    """
    sizes = units.select("uid", F.col("n_shingles").alias("n"))
    meeting, hubs = meeting.join(sizes, "uid"), hubs.join(sizes, "uid")
    parts = lambda rows, c, most: rows.groupBy("hub").agg(F.ceil(F.sum("n") / most).cast("int").alias(c))
    dealt = stored(parts(meeting, "blocks", BLOCK_SHINGLES).join(parts(hubs, "slices", SLICE_SHINGLES), "hub"), "dealt")
    found = _texts(meeting.select("uid").unionByName(hubs.select("uid")), units, texts)

    def rows(side: DataFrame, own: str, other: str) -> DataFrame:
        row = side.join(dealt, "hub").withColumn(own[:-1], F.pmod(F.xxhash64("uid", F.lit(own)), F.col(own)))
        return row.withColumn(other[:-1], F.explode(F.expr(f"sequence(0, {other} - 1)"))).select("hub", F.col("slice").cast("int").alias("slice"), F.col("block").cast("int").alias("block"), "uid").join(found.toDF("uid", "text"), "uid")

    def meet(key, few, many):
        out = {"a": [], "b": []}
        if len(few) and len(many):
            encoded = lambda pdf: (t.encode("utf-8", "replace") for t in pdf["text"])
            index = Members(list(shingle_sets(encoded(many), words)))
            for name, s in zip(few["uid"], shingle_sets(encoded(few), words), strict=True):
                both = index.shared(s)
                hit = np.flatnonzero(100 * both >= similarity * (index.size + len(s) - both))
                if len(hit):
                    out["a"].append(name)
                    out["b"].append(many["uid"].iloc[hit[0]])
            del index
        tidied()
        return pd.DataFrame(out, dtype="int64")

    by = ("hub", "slice", "block")
    return rows(meeting, "blocks", "slices").groupBy(*by).cogroup(rows(hubs, "slices", "blocks").groupBy(*by)).applyInPandas(meet, "a bigint, b bigint")


def _key(id_col: str, text_col: str) -> Column:
    """Names a row by its id, null or not, and its text: what was signed."""
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, the smallest id that
    links of at least ``similarity`` percent reach, its own included.

    Null and blank texts have no shingles and link with nothing: their component is their
    own id.  Rows that repeat an id are rows like any other.  A null id never names a
    component unless all ids there are null.  Other columns are not read.  A text is never
    cut; a very long one costs its own length.
    """
    return _rows(docs, id_col, text_col, words, similarity).select(F.col("__id").alias(id_col), "n_shingles", F.coalesce("component_id", "__id").alias("component_id"))


def _rows(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: int) -> DataFrame:
    """One row per row of ``docs``: __id, __key, n_shingles, class (null without shingles)
    and component_id (null if all ids of the class are)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text"), _key(id_col, text_col).alias("__key"))
    levels = shingle_levels(texts, words, texts.count())
    signed = stored(_signed(texts, words, similarity, levels), "signed")

    # equal sets make a unit, units with the same size and prefix a group
    held = signed.where("prefix is not null")
    names = held.groupBy("uid").agg(F.min("row").alias("row"), F.min(F.xxhash64("n_shingles", "prefix")).alias("gkey"))
    members = names.join(names.groupBy("gkey").agg(F.min("uid").alias("gid")), "gkey").select("uid", "gid", "row")
    units = stored(held.join(members, ["uid", "row"]).select("uid", "gid", "__key", "n_shingles", "prefix", "bitmap"), "units")
    members = units.select("uid", "gid")
    ids = stored(signed.select("__id", "__key", "n_shingles", "uid"), "ids")
    removed(signed)

    # groups are posted under their prefix shingles; a shingle of one group makes no list
    posted = units.where("uid = gid").select("gid", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("i", "token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor("gid").alias("same")).where("k > 1")
    # lists of the same groups (a shared passage makes many) propose the same pairs: the
    # first of them in the order of shingles, whose bounds are the widest, stands for all
    turned = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  signed order to unsigned
    lists = lists.groupBy("k", "same").agg(F.min(turned("token")).alias("first")).select(turned("first").alias("token"), "k")
    lists = stored(lists, "lists")
    postings = stored(posted.join(sized(lists), "token"), "postings")
    # what two sets can still share from their first common shingle on, at places i and i2
    # of the order, must do for the similarity (and bounds their sizes too)
    fits = f"{100 + similarity} * least(n - i, n2 - i2) >= {similarity} * (n + n2)"
    least = postings.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy("gid"))).where(F.col("place") <= PIVOTS)
    least = least.select("token", F.col("gid").alias("gid2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
    met = postings.join(least, "token").where(f"gid <> gid2 and {fits}").select(F.greatest("gid", "gid2").alias("a"), F.least("gid", "gid2").alias("b")).distinct()
    alike = members.where("uid <> gid").select(F.col("uid").alias("a"), F.col("gid").alias("b"))
    met = stored(met.unionByName(alike), "met")

    # one verified link for each unit at most, to the closest of those
    near = _filtered(met, units, similarity).groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    linked = stored(_verified(stored(near, "near"), units, texts, words, similarity), "linked")
    placed = stored(_placed(members, _ends(linked)), "placed")

    # in long lists all that is not of the largest class, if that is large, meets that class
    long = postings.where(f"k > {PIVOTS + 1}").select("token", "gid", "n", "i")
    rows = long.join(placed, "gid").select("token", "gid", "uid", "class", "n", "i")
    # the members of a group are a list of their own
    group = members.join(members.groupBy("gid").agg(F.count("*").alias("k")).where("k > 2").select("gid"), "gid", "left_semi")
    group = group.join(units.select("uid", F.col("n_shingles").alias("n")), "uid").join(placed.select("uid", "class"), "uid")
    rows = stored(rows.unionByName(group.select(F.col("gid").alias("token"), "gid", "uid", "class", "n", F.lit(0).alias("i"))), "rows")
    largest = F.min(F.struct(-F.col("k"), "class"))
    hub = rows.groupBy("token", "class").agg(F.count("*").alias("k")).groupBy("token").agg(F.when(-largest["col1"] > PIVOTS, largest["class"]).alias("hub"), F.count("*").alias("classes")).where("classes > 1").select("token", "hub")
    rows = stored(rows.join(hub, "token"), "mixed")
    hubs = stored(rows.where("class = hub").select("uid", "hub").distinct(), "hubs")
    outside = stored(rows.where("class <> hub").select("uid", "hub").distinct(), "outside")
    joined = _classwise(stored(_in_blocks(outside, hubs, units, texts, words, similarity), "blocks"), placed)
    merged = stored(_merged(placed, components(joined, "merge")), "merged")

    # all other pairs of different classes that share a list or a group
    left = rows.where("hub is null or class <> hub").drop("class", "hub").join(merged.select("uid", "class"), "uid")
    mixed = left.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("token")
    left = stored(left.join(mixed, "token", "left_semi"), "left")
    other = left.select("token", F.col("uid").alias("uid2"), F.col("class").alias("class2"), F.col("n").alias("n2"), F.col("i").alias("i2"))
    cross = left.join(other, "token").where(f"class < class2 and {fits}").select(F.col("uid").alias("a"), F.col("uid2").alias("b"))
    side = lambda c, k: merged.select(F.col("gid").alias(f"g{c}"), F.col("uid").alias(c), F.col("class").alias(k))
    apart = met.select(F.col("a").alias("ga"), F.col("b").alias("gb")).join(side("a", "class"), "ga").join(side("b", "class2"), "gb").where("class <> class2")
    rest = stored(cross.unionByName(apart.select("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "rest")
    across = stored(_verified(stored(_filtered(rest, units, similarity).select("a", "b"), "close"), units, texts, words, similarity), "across")
    final = _merged(merged, components(_classwise(across, merged), "links"))

    labelled = stored(final.select("uid", "class"), "labelled")
    removed(units, lists, postings, met, placed, rows, hubs, outside, merged, left, rest, across)
    least = ids.select("uid", "__id").join(labelled, "uid").groupBy("class").agg(F.min("__id").alias("component_id"))
    return ids.join(labelled.join(least, "class"), "uid", "left").drop("uid")


def _ends(links: DataFrame) -> DataFrame:
    """``links`` (a, b; each a once, b less than a) -> (node, component): where each chain
    of links ends.  Chains halve each round, by one join of the table with itself."""
    tree = stored(links.select(F.col("a").alias("node"), F.col("b").alias("component"), F.lit(True).alias("moved")), "chains-0")
    for i in range(1, 64):
        if not tree.where("moved").take(1):
            break
        up = tree.select(F.col("node").alias("component"), F.col("component").alias("next"))
        tree = stored(tree.join(up, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")), f"chains-{i}")
    return tree.select("node", "component")


def _placed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The class of each unit: (uid, gid, class)."""
    return members.join(classes, F.col("uid") == F.col("node"), "left").select("uid", "gid", F.coalesce("component", "uid").alias("class"))


def _merged(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """``placed`` with classes taken together as components of (node: class, component) say."""
    return placed.join(classes, F.col("class") == F.col("node"), "left").select("uid", "gid", F.coalesce("component", "class").alias("class"))


def _classwise(links: DataFrame, placed: DataFrame) -> DataFrame:
    """``links`` (a, b of uid) between classes: (a, b of class)."""
    side = lambda c: placed.select(F.col("uid").alias(c), F.col("class").alias(f"class_{c}"))
    return links.join(side("a"), "a").join(side("b"), "b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()


def keep_one(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each class: one with the smallest doc_id, or none
    where all are null.  Rows that repeat that id and the text stay once.  Texts without
    shingles are of no class and stay; those that repeat an id and the text, once."""
    rows = stored(_rows(docs, "doc_id", "text", SHINGLE_WORDS, similarity).select("__id", "__key", "class"), "rows")
    least = rows.where("class is not null").groupBy("class").agg(F.min_by("__key", F.struct(F.col("__id").isNull(), "__id", "__key")).alias("__key")).select("__key", F.lit(True).alias("least"))
    blank = F.col("class").isNull()
    keys = rows.groupBy("__key").agg(F.count("*").alias("k"), F.bool_and(blank).alias("blank"), F.bool_and(blank & F.col("__id").isNull()).alias("nameless"))
    # most documents stay as they are: only the keys of the others are looked up
    other = stored(keys.join(least, "__key", "left").where("not nameless and (k > 1 or not blank and least is null)").select("__key", (F.col("blank") | F.col("least").isNotNull()).alias("again")), "other")
    keyed = docs.withColumn("__key", _key("doc_id", "text"))
    once = keyed.join(sized(other.select("__key")), "__key", "left_anti")
    again = keyed.join(sized(other.where("again").select("__key")), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(again).select(*docs.columns)
