"""Preference formatting: the common turns of a chosen and a rejected conversation once as
prompt, the rest of each as a completion with a mask of what is to be learnt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered; {role} and {text} are filled in.
TURN = ("<|", "|>\n", "<|end|>\n")


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): array of (turn, role, text), in order; ties by role, then text.
    Null roles and texts count as empty; rows without conv_id are left out."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: conversations 2 n and 2 n + 1.  The one whose
    last answer is longer is chosen, at a tie the first.  (pair_id, chosen, rejected)"""
    last = "coalesce(length(element_at(filter(turns, x -> x.role = 'assistant'), -1).text), 0)"
    rows = conversations.select(F.expr("floor(conv_id / 2)").cast("bigint").alias("pair_id"), F.struct((-F.expr(f"case when exists(turns, x -> x.role = 'assistant') then {last} else 0 end")).alias("k"), "conv_id", "turns").alias("c"))
    pairs = rows.groupBy("pair_id").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("n")).where("n = 2")
    return pairs.select("pair_id", F.col("x.conv_id").alias("chosen_id"), F.col("y.conv_id").alias("rejected_id"), F.col("x.turns").alias("chosen"), F.col("y.turns").alias("rejected"))


def branched(turns: DataFrame) -> DataFrame:
    """Pairs for a table without preferences, one for each conversation of ``turns``
    (conv_id, turn, role, text): chosen is the conversation itself, all its turns; rejected
    leaves it behind its first m turns and goes on as its neighbour does (2 n beside 2 n + 1)
    behind the neighbour's first m.  m is n modulo one more than the turns, so that branches
    lie at the start, in the middle and at the end; how many turns are alike in fact is for
    ``formatted`` to find.  Without a neighbour rejected ends at the branch.

    Both conversations of a pair meet in one shuffle of their turns.  Order, nulls and rows
    without conv_id as in ``conversations_of``; an empty table has no pairs.
    (pair_id, chosen_id, rejected_id: the neighbour's or null, chosen, rejected)"""
    key = F.col("conv_id").cast("bigint")
    rows = turns.where("conv_id is not null").select(F.shiftright(key, 1).alias("pair"), F.struct(key.bitwiseAND(F.lit(1)).alias("odd"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    both = rows.groupBy("pair").agg(F.sort_array(F.collect_list("x")).alias("x"))
    side = lambda k: f"transform(filter(x, t -> t.odd = {k}), t -> named_struct('turn', t.turn, 'role', t.role, 'text', t.text))"
    both = both.select("pair", F.expr(side(0)).alias("even"), F.expr(side(1)).alias("odd"))
    each = both.select("pair", F.expr("inline(array(named_struct('k', 0L, 'chosen', even, 'other', odd), named_struct('k', 1L, 'chosen', odd, 'other', even)))")).where("size(chosen) > 0")
    each = each.withColumn("m", F.expr("cast(pmod(pair, size(chosen) + 1L) as int)"))
    goes_on = "concat(slice(chosen, 1, m), slice(other, m + 1, size(other)))"
    own = F.expr("shiftleft(pair, 1) + k")
    return each.select(own.alias("pair_id"), own.alias("chosen_id"), F.expr("case when size(other) > 0 then shiftleft(pair, 1) + 1 - k end").alias("rejected_id"), "chosen", F.expr(goes_on).alias("rejected"))


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen_id, rejected_id, chosen, rejected: arrays of turns) ->
    pair_id, chosen_id, rejected_id, n_common, prompt, chosen_text, rejected_text,
    chosen_mask, rejected_mask.

    Turns are alike if role and text are; the longest run of alike turns from the start is
    the prompt.  A mask is an array of (start, end), in characters of its completion: the
    texts of assistant turns with the mark that ends them.  Null arrays count as empty, as
    do the completions of conversations that are alike throughout.
    """
    side = lambda c: f"coalesce({c}, cast(array() as array<struct<turn:bigint,role:string,text:string>>))"
    rows = pairs.select("pair_id", "chosen_id", "rejected_id", F.expr(side("chosen")).alias("c"), F.expr(side("rejected")).alias("r"))
    differ = "array_position(transform(arrays_zip(c, r), x -> not (x.c.role <=> x.r.role and x.c.text <=> x.r.text)), true)"
    rows = rows.withColumn("n", F.expr(f"cast(case when {differ} = 0 then least(size(c), size(r)) else {differ} - 1 end as int)"))
    turn = f"concat('{TURN[0]}', x.role, '{TURN[1]}', x.text, '{TURN[2]}')".replace("\n", "\\n")
    render = lambda a: f"array_join(transform({a}, x -> {turn}), '')"
    rest = lambda a: f"slice({a}, n + 1, size({a}))"
    head = f"length('{TURN[0]}') + length(x.role) + length('{TURN[1]}')".replace("\n", "\\n")
    tail = f"length(x.text) + length('{TURN[2]}')".replace("\n", "\\n")
    mask = lambda a: (
        f"aggregate({rest(a)}, named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int>>)), (acc, x) -> named_struct('at', acc.at + {head} + {tail}, 'out', "
        f"case when x.role = 'assistant' then concat(acc.out, array(named_struct('s', acc.at + {head}, 'e', acc.at + {head} + {tail}))) else acc.out end), acc -> acc.out)"
    )
    return rows.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("bigint").alias("n_common"), F.expr(render("slice(c, 1, n)")).alias("prompt"), F.expr(render(rest("c"))).alias("chosen_text"), F.expr(render(rest("r"))).alias("rejected_text"), F.expr(mask("c")).alias("chosen_mask"), F.expr(mask("r")).alias("rejected_mask"))
