r"""Personal data by generators, boosted trees and calibrated thresholds, in DataFrame
expressions alone.

Base patterns with their checks (fixed) give spans that always stay.  Looser generators
propose more: disguised addresses in brackets or words, IPv6 in full or short, cards of other
lengths or separators, national telephone numbers in the usual groups, and all windows of numbers that stand side by side, where the base
patterns take several for one and refuse them.  Gradient-boosted trees of each kind over features of format and context, learnt from
what the base checks accept and refuse, and thresholds calibrated for each kind on a part
held out, decide which of those are added.  The trees become CASE expressions inside the
same projection, so the whole operator is a map: no shuffle and no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

KINDS = ("email", "ip", "card", "phone")
#: Precision that a kind's threshold must reach on the part held out.
PRECISION = 0.95

# Fixed base patterns.  Atomic runs and look-behinds find the same spans as the plain
# patterns without trying each character of a run as a start.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr({t}, '@') > 0"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "instr({t}, '.') > 0"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])", "true"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "instr({t}, '+') > 0"),
}
# Generators of the same kinds with more recall.
MORE = {
    # each guard holds wherever its pattern matches
    "email": (
        r"(?i)[A-Z0-9._%+-]++(?: ?[\[({] ?at ?[\])}] ?| at )[A-Z0-9-]++(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Z0-9-]++)++",
        r"{t} rlike '(?i)[ \\[({{]at[ \\])}}]'",
    ),
    "ip": (
        r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![A-Za-z])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+)?(?![0-9A-Za-z:]))",
        "instr({t}, ':') > 0",
    ),
    "card": (r"(?<![0-9])(?<![0-9][ .-])[0-9](?:[ .-]?[0-9]){12,18}+(?![ .-]?[0-9])", "true"),
    "phone": (r"(?<![0-9+(])(?<![0-9][ .)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])", "true"),
}
# Numbers side by side: each run of digits with at least seven digits from it on starts
# windows, and each length that ends with a run is proposed, so windows overlap.
STARTS = r"(?<![0-9])(?=[+(]{0,2}[0-9](?:[ ()./-]{0,3}[0-9]){6})[+(]{0,2}[0-9]++"
# No window is longer: 19 digits with three signs between them, and one more.
REACH = 80
# Matches that are walked together; characters of a block that candidates are looked up in.
WALK, BLOCK = 256, 1024
# Groups of digits that national telephone numbers are written in.
GROUPS = [(3, 4), (4, 4), (3, 3, 3), (3, 3, 4), (2, 4, 4), (3, 4, 4), (4, 3, 3), (4, 3, 4), (2, 3, 4), (5, 6), (5, 5), (4, 6), (4, 7), (3, 7), (3, 8), (5, 3, 3), (2, 2, 2, 2), (2, 2, 2, 2, 2), (3, 2, 2, 2), (3, 3, 2, 2)]
WINDOWS = {
    "ip": [r"^[+(]*([0-9]{1,3}(?:[.][0-9]{1,3}){3})(?![0-9])"],
    "card": [rf"^[+(]*([0-9](?:[ .-]?[0-9]){{{n - 1}}})(?![0-9])" for n in range(13, 20)],
    "phone": [rf"^[(]*([+][(]?[0-9](?:[ ().-]{{0,3}}[0-9]){{{n - 1}}})(?![0-9])" for n in range(8, 16)]
    # national numbers by their groups, the first in brackets or not
    + [r"^((?:[(][0-9]{%d}[)][ ./-]{0,2}|[0-9]{%d}[ ./-]{1,2})%s)(?![0-9])" % (n, n, "[ ./-]{1,2}".join("[0-9]{%d}" % k for k in rest)) for n, *rest in GROUPS],
}
# Words that often stand before each kind, and before numbers that are none.
NEAR = {"email": "mail|contact|write", "ip": "ip|host|server|address|ping", "card": "card|visa|master|amex|credit|pay", "phone": "tel|phone|call|fax|mobile|cell"}
AGAINST = "version|release|isbn|order|invoice|serial|hash|sku|ref|password|token"

FEATURES = ("kind", "n_digits", "n_chars", "n_signs", "luhn", "largest", "plus", "at", "brackets", "groups", "left", "right", "near", "against", "variety", "dots", "colons", "gap")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(pattern: str, guard: str, text: str) -> str:
    """SQL for the array of (s, e, v) of a pattern's matches, in code points: what lies
    between matches and the matches themselves add up to the positions."""
    p = _quoted(pattern)
    none = "cast(array() as array<struct<s:int,e:int,v:string>>)"
    # by blocks of matches, so that no array grows match by match: first where each block
    # begins, then each block by itself
    size = "length(f.g[i - 1]) + length(f.m[i - 1])"
    inside = f"sequence(b * {WALK} + 1, least(size(f.m), (b + 1) * {WALK}))"
    begins = f"aggregate(sequence(0, (size(f.m) - 1) div {WALK}), named_struct('at', 0, 'out', cast(array() as array<int>)), (a, b) -> named_struct('at', aggregate({inside}, a.at, (t, i) -> t + {size}), 'out', array_append(a.out, a.at)), a -> a.out)"
    block = (
        f"aggregate({inside}, named_struct('at', at, 'out', {none}), "
        f"(a, i) -> named_struct('at', a.at + {size}, 'out', "
        "array_append(a.out, named_struct('s', a.at + length(f.g[i - 1]), 'e', a.at + length(f.g[i - 1]) + length(f.m[i - 1]), 'v', f.m[i - 1]))), a -> a.out)"
    )
    walk = f"flatten(transform({begins}, (at, b) -> {block}))"
    found = f"transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))), f -> case when size(f.m) > 0 then {walk} else {none} end)[0]"
    return f"case when {guard.format(t=text)} and {text} rlike {p} then {found} else {none} end"


def _seen(first: str, count: str) -> str:
    """SQL: at most BLOCK characters of the text from place ``first`` (from 1) on, out of
    __blocks, so that a late place costs no more than an early one."""
    return f"substring(get(__blocks, ({first} - 1) div {BLOCK}), ({first} - 1) % {BLOCK} + 1, {count})"


def _windows(kind: str, starts: str) -> str:
    """SQL for the array of (s, e, v) of a kind's windows from ``starts``."""
    seen = _seen("(p.s + 1)", str(REACH))
    found = ", ".join(f"regexp_extract(w, {_quoted(x)}, 1)" for x in WINDOWS[kind])
    each = f"transform(filter(array({found}), v -> v <> ''), v -> named_struct('s', p.s + instr(w, v) - 1, 'e', p.s + instr(w, v) - 1 + length(v), 'v', v))"
    return f"flatten(transform({starts}, p -> transform(array({seen}), w -> {each})[0]))"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def luhn(v: str) -> str:
    """SQL: the check sum of a string's digits holds."""
    d = f"reverse({_digits(v)})"
    return (
        f"aggregate(sequence(1, greatest(length({d}), 1)), 0, (a, i) -> a + "
        f"case when i % 2 = 1 then coalesce(try_cast(substring({d}, i, 1) as int), 0) "
        f"else element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), 1 + coalesce(try_cast(substring({d}, i, 1) as int), 0)) end) % 10 = 0"
    )


def _largest(v: str) -> str:
    return f"array_max(transform(split({v}, '[^0-9]+'), p -> case when length(regexp_replace(p, '^0+', '')) > 8 then 99999999 else coalesce(try_cast(p as int), 0) end))"


CHECKS = {
    "email": "true",
    "ip": f"{_largest('x.v')} <= 255",
    "card": luhn("x.v"),
    "phone": f"length({_digits('x.v')}) between 8 and 15",
}


def _features(kind: str, x: str) -> str:
    """SQL of a struct: where a candidate stands and its features."""
    v = f"{x}.v"
    left = f"lower({_seen(f'greatest({x}.s - 23, 1)', f'least({x}.s, 24)')})"
    near = f"case {' '.join(f'when {kind} = {i} then cast({left} rlike {_quoted(NEAR[k])} as int)' for i, k in enumerate(KINDS))} end"
    parts = {
        "s": f"{x}.s", "e": f"{x}.e", "kind": kind,
        "n_digits": f"length({_digits(v)})", "n_chars": f"length({v})", "n_signs": f"length(regexp_replace({v}, '[A-Za-z0-9]', ''))",
        "luhn": f"cast({luhn(v)} as int)", "largest": _largest(v),
        "plus": f"cast(startswith({v}, '+') as int)", "at": f"cast(instr({v}, '@') > 0 as int)", "brackets": f"cast({v} rlike '[(\\\\[{{]' as int)", "groups": f"size(split({v}, '[^A-Za-z0-9]+'))",
        "left": f"case when {x}.s = 0 then 0 when {_seen(f'{x}.s', '1')} rlike '[A-Za-z0-9]' then 1 when {_seen(f'{x}.s', '1')} rlike '[=:/#_-]' then 2 else 0 end",
        "right": f"cast(coalesce({_seen(f'({x}.e + 1)', '1')}, '') rlike '[A-Za-z0-9]' as int)",
        "near": near, "against": f"cast({left} rlike {_quoted(AGAINST)} as int)",
        "variety": f"size(array_distinct(split({_digits(v)}, '')))",
        "dots": f"cast({v} rlike '(?i)[^a-z]dot[^a-z]' as int)", "colons": f"length(regexp_replace({v}, '[^:]', ''))", "gap": f"cast(instr({v}, '::') > 0 as int)",
    }
    return "named_struct(" + ", ".join(f"'{k}', {f'cast({e} as int)' if k in FEATURES else e}" for k, e in parts.items()) + ")"


def _meets(base: str) -> str:
    """SQL: x shares a place with one of ``base``, spans in order that share none with each
    other: the first that ends behind x's start, by halves, and whether it starts before x's end."""
    middle = "(a.lo + a.hi) div 2"
    half = f"(a, i) -> case when a.lo >= a.hi then a when {base}[cast({middle} as int)].e > x.s then named_struct('lo', a.lo, 'hi', cast({middle} as int)) else named_struct('lo', cast({middle} + 1 as int), 'hi', a.hi) end"
    first = f"aggregate(sequence(0, cast(log2(size({base})) as int) + 1), named_struct('lo', 0, 'hi', size({base})), {half}, a -> a.lo)"
    return f"(size({base}) > 0 and coalesce(get({base}, {first}).s < x.e, false))"


def _once(spans: str) -> str:
    """SQL: each span once, in order."""
    return f"transform(array(array_sort({spans})), o -> filter(o, (x, i) -> i = 0 or o[i - 1] <> x))[0]"


def _candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __<kind> (accepted base spans), __no_<kind> (refused) and __more_<kind>."""
    docs = docs.withColumn("__blocks", F.expr(f"transform(sequence(0, length({text}) div {BLOCK}), i -> substring({text}, i * {BLOCK} + 1, {2 * BLOCK}))"))
    for kind in KINDS:
        docs = docs.withColumn(f"__all_{kind}", F.expr(_spans(*BASE[kind], text)))
    docs = docs.withColumns({f"__{k}": F.expr(f"filter(__all_{k}, x -> {CHECKS[k]})") for k in KINDS} | {f"__no_{k}": F.expr(f"filter(__all_{k}, x -> not ({CHECKS[k]}))") for k in KINDS})
    # only what the checks accept takes its place; what they refuse may hold several
    free = " and ".join(f"not {_meets(f'__{k}')}" for k in KINDS)
    docs = docs.withColumn("__starts", F.expr(_spans(STARTS, "true", text)))
    more = {k: f"concat({_spans(*MORE[k], text)}, {_windows(k, '__starts')})" if k in WINDOWS else _spans(*MORE[k], text) for k in KINDS}
    return docs.withColumns({f"__more_{k}": F.expr(f"filter({_once(more[k])}, x -> {free})") for k in KINDS})


@dataclass
class Redactor:
    """For each kind its trees as nested (feature, threshold, left, right) or leaves, and a
    threshold of the score; a kind without trees adds nothing to the base spans."""

    trees: dict[str, list[tuple[float, object]]] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, kind: str, c: str) -> str:
        def case(node) -> str:
            if not isinstance(node, tuple):
                return repr(float(node)) + "D"
            f, t, a, b = node
            return f"case when {c}.{FEATURES[f]} <= {float(t)!r}D then {case(a)} else {case(b)} end"

        total = " + ".join(f"{w!r}D * ({case(tree)})" for w, tree in self.trees[kind])
        return f"1 / (1 + exp(-2 * ({total})))"


def _tree(node) -> object:
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    return node.split().featureIndex(), node.split().threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Redactor:
    """Learns from all documents: spans that the base checks accept, and disguises of them,
    against spans they refuse and spoilt ones.  Examples alike in all features are one with
    a weight; a quarter of the documents calibrates the thresholds and teaches nothing else."""
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = _candidates(rows, "__text")
    ten = "right(regexp_replace(x.v, '[^0-9]', ''), 10)"
    hexes = [f"lower(hex(pmod(xxhash64(x.v, {i}), 65536)))" for i in range(8)]
    # the label may hang on the words before: "c.near"
    shown = {
        "card": [("x.v", 1), ("regexp_replace(x.v, '[ -]', '.')", 1), ("concat(substring(x.v, 1, length(x.v) - 1), cast((cast(right(x.v, 1) as int) + 1) % 10 as string))", 0), (r"regexp_replace(regexp_replace(x.v, '[^0-9]', ''), '([0-9]{2})(?=[0-9])', '$1 ')", 0)],
        "phone": [("x.v", 1), (r"regexp_replace(x.v, '^[+][0-9]+[ .-]*', '')", 1), ("regexp_replace(x.v, '[^0-9]', '')", 0), ("concat(x.v, ' ', 100 + x.s % 900)", 0), (r"regexp_replace(x.v, '[ .-]+[0-9]+$', '')", 0)]
        + [(f"regexp_replace({ten}, '^([0-9]{{{a}}})([0-9]{{{b}}})([0-9]+)$', '{shape}')", 1) for a, b, shape in ((2, 4, "$1 $2 $3"), (4, 3, "$1-$2-$3"), (5, 1, "$1 $2$3"), (4, 3, "($1) $2$3"))]
        + [(f"regexp_replace({ten}, '([0-9]{{2}})(?=[0-9])', '$1 ')", 1), (f"regexp_replace(right({ten}, 9), '([0-9]{{3}})(?=[0-9])', '$1 ')", "c.near"), (f"regexp_replace(right({ten}, 8), '([0-9]{{2}})(?=[0-9])', '$1 ')", "c.near"), (f"regexp_replace(right({ten}, 7), '^([0-9]{{3}})', '$1-')", "c.near"), ("concat(1900 + x.s % 130, '-', 1900 + x.e % 130)", 0)],
        "ip": [("x.v", 1), ("concat('9', x.v)", 0), (r"regexp_replace(x.v, '[.]', ':')", 1), (f"concat_ws(':', '2001', 'db8', {', '.join(hexes[:6])})", 1), (f"concat('2001:db8::', {hexes[0]}, ':', {hexes[1]})", 1), (f"concat('fe80::', concat_ws(':', {', '.join(hexes[:4])}))", 1), ("'2001:db8::1'", 1)]
        + [(f"concat_ws(':', {', '.join(f'right({h}, 2)' for h in hexes)})", 0), ("'add::bed'", 0), ("concat(substring('abcdef', 1 + x.s % 6, 1), '::', 1 + x.s % 9)", 0), ("'::'", 0), ("concat(substring('abcdef', 1 + x.s % 6, 1), '::')", 0)],
        "email": [("x.v", 1), ("replace(x.v, '@', ' [at] ')", 1), ("replace(x.v, '@', '')", 0), ("replace(replace(x.v, '.', ' (DOT) '), '@', ' (AT) ')", 1), ("replace(replace(x.v, '.', ' dot '), '@', ' at ')", 1), ("replace(x.v, '@', ' at ')", "c.near")],
    }
    sets = []
    for i, k in enumerate(KINDS):
        for v, label in shown[k]:
            sets.append(f"transform(transform(__{k}, x -> {_features(str(i), 'x').replace('x.v', f'({v})')}), c -> named_struct('label', {label}, 'c', c))")
        sets.append(f"transform(__no_{k}, x -> named_struct('label', 0, 'c', {_features(str(i), 'x')}))")
    shows = rows.select("__id", F.explode(F.expr(f"concat({', '.join(sets)})")).alias("r")).select(F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(4)).alias("fold"), F.col("r.label").cast("double").alias("label"), "r.c.*")
    shows = shows.groupBy("fold", "label", *FEATURES).agg(F.count("*").cast("double").alias("weight"))
    shows = stored(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(shows).select("fold", "label", "kind", "features", "weight"), "shows")
    redactor = Redactor()
    for i, k in enumerate(KINDS):
        learn = shows.where(f"kind = {i} and fold <> 0").coalesce(4)
        if len(learn.select("label").distinct().take(2)) < 2:
            continue
        model = GBTClassifier(maxIter=8, maxDepth=4, maxBins=32, seed=3, weightCol="weight").fit(learn)
        redactor.trees[k] = [(float(w), _tree(t.rootNode())) for w, t in zip(model.treeWeights, list(model._java_obj.trees()), strict=True)]
        held = model.transform(shows.where(f"kind = {i} and fold = 0")).select("label", "weight", F.round(_probability(), 2).alias("p"))
        good = n = 0
        ranked = [(r["p"], r["good"], r["n"]) for r in held.groupBy("p").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).orderBy(F.desc("p")).collect()]
        for j, (p, g, m) in enumerate(ranked):
            good, n = good + g, n + m
            if good / n >= PRECISION and p >= 0.5:  # half way to the next score that was seen
                redactor.thresholds[k] = max(0.5, (p + (ranked[j + 1][0] if j + 1 < len(ranked) else 0.0)) / 2)
    return redactor


def _probability() -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array("probability")[1]


def _found(docs: DataFrame, redactor: Redactor, text_col: str) -> DataFrame:
    """``docs`` with __base and __added: arrays of (kind, s, e)."""
    docs = _candidates(docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))), "__text")
    span = "named_struct('kind', {i}, 's', x.s, 'e', x.e)"
    base = ", ".join(f"transform(__{k}, x -> {span.format(i=i)})" for i, k in enumerate(KINDS))
    docs = docs.withColumn("__base", F.expr(f"concat({base})"))
    none = "cast(array() as array<struct<kind:int,s:int,e:int>>)"
    live = [(i, k) for i, k in enumerate(KINDS) if k in redactor.thresholds]
    if not live:
        return docs.withColumn("__added", F.expr(none))
    # scores that round to the same tenth count as equally likely
    ranked = lambda k: f"transform(array({redactor.score(k, 'c')}), p -> named_struct('odds', -round(p, 1), 'short', c.s - c.e, 's', c.s, 'kind', c.kind, 'e', c.e, 'p', p))[0]"
    sets = ", ".join(f"filter(transform(transform(__more_{k}, x -> {_features(str(i), 'x')}), c -> {ranked(k)}), r -> r.p >= {redactor.thresholds[k]!r}D)" for i, k in live)
    docs = docs.withColumn("__more", F.expr(f"array_sort(concat({sets}))"))
    # of proposals that overlap, the likelier stays, then the longer, then the earlier
    picked = f"aggregate(__more, {none}, (a, x) -> case when exists(a, y -> y.s < x.e and x.s < y.e) then a else concat(a, array({span.format(i='x.kind')})) end)"
    return docs.withColumn("__added", F.expr(f"array_sort({picked})"))


def _digest(spans: str) -> str:
    name = f"element_at(array({', '.join(map(repr, KINDS))}), x.kind + 1)"
    return f"array_join(transform({spans}, x -> concat({name}, ':', x.s, ':', x.e)), ',')"


def personal_data(docs: DataFrame, redactor: Redactor, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256,
    spans, n_added.  Null texts count as empty; texts are searched whole; rows that repeat
    an id are rows like any other; other columns are not read."""
    rows = _found(docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__raw")), redactor, "__raw")
    return rows.select(
        F.col("__doc").cast("bigint").alias("doc_id"),
        *(F.size(f"__{k}").cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(_digest("__base")), 256).alias("base_sha256"),
        F.expr(_digest("array_sort(concat(__base, __added))")).alias("spans"),
        F.size("__added").cast("bigint").alias("n_added"),
    )


def redacted(docs: DataFrame, redactor: Redactor) -> DataFrame:
    """``docs`` with every found span of text replaced by its kind in square brackets, and
    n_chars to match.  Spans that overlap go as one, under the kind of the first."""
    # the given columns stay together, so none of their names can clash
    rows = _found(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__raw")), redactor, "__raw").withColumn("__spans", F.expr("array_sort(transform(concat(__base, __added), x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"))
    kind = f"element_at(array({', '.join(repr(f'[{k.upper()}]') for k in KINDS)}), x.kind + 1)"
    cut = (
        "aggregate(__spans, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> "
        f"case when x.s >= a.at then named_struct('at', x.e, 'out', concat(a.out, array(substring(__text, a.at + 1, x.s - a.at), {kind}))) "
        "else named_struct('at', greatest(a.at, x.e), 'out', a.out) end, a -> concat(array_join(a.out, ''), substring(__text, a.at + 1)))"
    )
    rows = rows.withColumn("__new", F.expr(f"case when size(__spans) > 0 then {cut} else __raw end"))
    new = {"text": F.col("__new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.expr("case when size(__spans) > 0 then length(__new) else __row.n_chars end").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns))
