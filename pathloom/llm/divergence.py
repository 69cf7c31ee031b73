"""Divergence of sources within a language, from Arrow-made partial counts.

1. In each Arrow batch: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and
   a hash ``group_by`` count terms per source and the documents that hold them; a task
   merges its batches' tables up to a bounded size.  Spark adds the tasks' counts.
2. Each language keeps the terms that enough of its documents hold.  Smoothed shares are
   integers: 1 + floor(10^9 (count + 5) / (N + 5 V)).
3. Terms are dealt to shards by a hash, sources to blocks; each task holds one shard of two
   blocks as columns (an array of sources by terms) and adds up absolute differences for its
   pairs of sources.  Shards' sums are added by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import tidied
from .store import stored

#: What stands between terms, once A-Z is lower-cased.
BETWEEN = r"[\x00-\x60\x7B-\x7F]+"
#: Documents of a language that hold a term that is kept.
LEAST_DOCS = 30
SMOOTH, UNIT = 5, 1_000_000_000
#: Terms of a source that are listed.
TOP_TERMS = 50
#: Rows of a batch counted at a time, and of counts that a task merges before it lets go.
BATCH_ROWS, HELD_ROWS = 512, 400_000
#: Terms of a shard, about, and sources of a block.
SHARD_TERMS, BLOCK_SOURCES = 8192, 128

_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch; the term '' counts the documents."""
    lang, source = (pc.fill_null(batch.column(c), "") for c in ("lang", "source"))
    text = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
    terms = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    code = pc.list_flatten(terms).dictionary_encode()
    empty = pc.fill_null(pc.index_in(pa.scalar("", code.dictionary.type), value_set=code.dictionary), -1).as_py()
    held = pa.table({"doc": pc.list_parent_indices(terms), "term": code.indices})
    held = held.filter(pc.not_equal(held["term"], empty))
    each = held.group_by(["doc", "term"]).aggregate([([], "count_all")])
    each = pa.table({"doc": each["doc"], "term": each["term"], "n": each["count_all"]})
    # each document's group as a number, so that strings meet no hash table again
    groups = pa.table({"lang": lang, "source": source})
    named = groups.group_by(["lang", "source"]).aggregate([([], "count_all")])
    pairs = [pc.dictionary_encode(c) for c in (lang, source)]
    key = pc.add(pc.multiply(pairs[0].indices.cast(pa.int64()), 1 << 32), pairs[1].indices.cast(pa.int64()))
    group = pc.dictionary_encode(key)
    by = pa.table({"group": group.indices.take(each["doc"].combine_chunks()), "term": each["term"], "n": each["n"]})
    by = by.group_by(["group", "term"]).aggregate([("n", "sum"), ("n", "count")])
    first = pc.index_in(pa.array(range(len(group.dictionary)), group.indices.type), value_set=group.indices)
    at = first.take(by["group"].combine_chunks())
    found = pa.table({"lang": lang.take(at), "source": source.take(at), "term": code.dictionary.take(by["term"].combine_chunks()).cast(pa.string()), "n": by["n_sum"], "docs": by["n_count"]})
    zero = pa.array([""] * len(named), pa.string())
    every = pa.table({"lang": named["lang"], "source": named["source"], "term": zero, "n": named["count_all"], "docs": named["count_all"]})
    return pa.concat_tables([found, every])


def _merged(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _partial(batches) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    fresh = base = 0
    for batch in batches:
        for a in range(0, batch.num_rows, BATCH_ROWS):
            # taken, not sliced: string kernels have been seen to misread arrays with an offset
            rows = pa.array(range(a, min(a + BATCH_ROWS, batch.num_rows)))
            held.append(_counted(batch.take(rows)))
            fresh += len(held[-1])
            if fresh >= max(HELD_ROWS, base):
                held, fresh = [_merged(held)], 0
                base = len(held[0])
                if base >= HELD_ROWS:
                    yield from held[0].to_batches(65_536)
                    held, base = [], 0
    if held:
        yield from _merged(held).to_batches(65_536)
    held = []
    tidied()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term; the
    term '' gives each group's documents in both.  Null texts, langs and sources read as ''."""
    part = docs.select("lang", "source", "text").mapInArrow(_partial, _COUNTS)
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str) -> F.Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"1 + cast((cast({UNIT} as decimal(10,0)) * {wide(f'{count} + {SMOOTH}')}) div {wide(f'{total} + {SMOOTH} * {kept}')} as bigint)")


def _pairs(rows: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed differences of each two sources of a language.

    ``rows`` (lang, source, term, p) are the kept terms that occur, ``groups`` (lang, source,
    kept, rest: the share of a term that does not occur, place: 0, 1, ... in the language),
    ``kept`` (lang, term).
    """
    block = F.floor(F.col("place") / BLOCK_SOURCES).cast("int")
    shards = F.greatest(F.ceil(F.col("kept") / SHARD_TERMS), F.lit(1)).cast("int")
    sized = groups.groupBy("lang").agg((F.floor(F.max("place") / BLOCK_SOURCES) + 1).cast("int").alias("blocks"))
    placed = groups.join(sized, "lang").withColumns({"block": block, "shards": shards})
    # each block meets itself and every other: a row goes where the lesser, or the greater, is its own
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("lo"), F.greatest(b, F.col("block")).alias("hi"))))
    placed = placed.withColumn("m", meets).select("lang", "source", "rest", "block", "shards", "m.lo", "m.hi")
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    terms = kept.join(placed.select("lang", "shards").distinct(), "lang").groupBy("lang", shard.alias("shard")).agg(F.count("*").alias("terms"))
    left = placed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    left = left.join(terms, ["lang", "shard"], "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    right = rows.join(placed.drop("rest", "block"), ["lang", "source"]).withColumn("shard", shard).drop("shards")

    def differ(members: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("source").reset_index(drop=True)
        at, terms = pd.factorize(held["term"])
        rest, blocks, names = (members[c].to_numpy() for c in ("rest", "block", "source"))
        # one column for each term that one of these sources has
        p = np.repeat(rest.astype(np.int64)[:, None], len(terms), axis=1)
        row = {s: i for i, s in enumerate(names)}
        p[[row[s] for s in held["source"]], at] = held["p"].to_numpy(np.int64)
        source, item, value = [], [], []
        for i, name in enumerate(names):
            # a block by itself: all others in it; two blocks: those of the other one
            alone = members["lo"].iloc[0] == members["hi"].iloc[0]
            other = np.flatnonzero(np.arange(len(names)) != i if alone else blocks != blocks[i])
            apart = np.array([np.abs(p[j] - p[i]).sum() for j in other], np.int64)
            # the shard's other terms, which none of these sources has
            apart += (int(members["terms"].iloc[0]) - len(terms)) * np.abs(rest[other] - rest[i])
            source += [name] * len(other)
            item += list(names[other])
            value += apart.tolist()
        lang = [members["lang"].iloc[0]] * len(source) if len(members) else []
        return pd.DataFrame({"lang": np.array(lang, object), "source": np.array(source, object), "item": np.array(item, object), "value": np.array(value, np.int64)})

    # each block is met by itself (lo = hi) and with each other one
    by = ("lang", "shard", "lo", "hi")
    left, right = (side.toDF(*side.columns) for side in (left, right))  # columns of their own
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(differ, "lang string, source string, item string, value bigint")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: how far each other source of the language lies from the group, summed over
    the kept terms, all ranks.  Part ``term``: the kept terms that the group has and uses
    more than the language, the first ``top_terms``.  Ranks go by falling value, then by the
    item's UTF-8.

    Null text, lang and source read as ''.  Each row is a document, repeated rows too; a text
    without terms counts for its group alone; a language without kept terms has pairs of
    value 0 and no terms.  Texts are never cut.  An empty table gives an empty table.  Other
    columns are not read.
    """
    counts = stored(term_counts(docs), "counts")
    terms = counts.where("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stored(kept.select("lang", "term", "all"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("all").alias("total"), F.count("*").alias("kept"))
    used = terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all")
    used = stored(used, "used")
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")  # a row for each source
    groups = stored(groups.select("lang", "source", zero("own"), zero("total"), zero("kept"), place), "groups")
    rows = stored(used.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "own", "kept").alias("p"), share("all", "total", "kept").alias("q")), "shares")

    rest = groups.select("lang", "source", "kept", "place", F.when(F.col("kept") > 0, share("0", "own", "kept")).otherwise(F.lit(0)).cast("bigint").alias("rest"))
    pairs = _pairs(rows.drop("q"), rest, kept.select("lang", "term"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    # Spark keeps the first ranks of each task before it shuffles
    over = ranked(rows.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).where(F.col("rank") <= top_terms)
    return ranked(pairs).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(over.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
