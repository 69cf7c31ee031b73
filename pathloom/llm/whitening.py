"""Whitening of integer vectors by the exact characteristic polynomial of their scatter.

1. Each entry c becomes the integer x = floor(1024 c) + 100000.  Tasks add up counts, sums
   and products of blocks exactly; Spark adds the tasks' sums.  The scatter n P - S S' is
   then a matrix of integers, n^2 times the covariance.
2. Its characteristic polynomial: modulo many 31-bit primes the matrix is brought to
   Hessenberg form and the polynomial read off by recurrence (a Spark job over the primes);
   Chinese remaindering gives the integer coefficients, whose size is bounded beforehand.
3. All roots are real, so the changes of sign in the coefficients of p(y + a) *count* the
   roots above a.  Bisection by that count isolates each root, multiple ones included, to
   many more bits than a double has.
4. Components: inverse iteration on the null space of (scatter - root) in decimals of high
   precision; equal roots get vectors at right angles to each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, getcontext, localcontext

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import tidied

SCALE, SHIFT = 1024, 100_000
#: Components, the largest first.
COMPONENTS = 8
#: Bits to which a root is isolated, relative to its size; digits of the inverse iteration.
ROOT_BITS, DIGITS = 120, 90
#: Vectors of a block: with entries below 2**20, sums of their products are exact doubles.
BLOCK = 4096
_SMALL = 1 << 20
_LIMB = 60
_LONG = (1 << 63) - 1


# --- 1. integers and exact sums


def usable(vector: str) -> F.Column:
    """The vector is there, and no entry is null or not finite."""
    return F.expr(f"`{vector}` is not null and forall(`{vector}`, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")


def dimension(vectors: DataFrame) -> int:
    """The length that most of the vectors have, the greater of equally frequent ones."""
    row = vectors.groupBy(F.size("__v").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    return row["d"] if row else 0


def integers(column: pa.Array, d: int) -> np.ndarray:
    """floor(1024 c) of each entry, as doubles (exact): one row per vector.  Less 100000 than
    x, which no covariance or deviation can tell."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, d)


def _bounded(y: np.ndarray) -> np.ndarray:
    """As Python integers; what no long holds, once shifted, becomes the nearest long, as in
    a cast."""
    whole = np.frompyfunc(lambda v: min(max(int(v), -_LONG - 1 - SHIFT), _LONG - SHIFT), 1, 1)
    return whole(y)


def products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums, and sums of products, of a block's entries, as Python integers."""
    if np.abs(y).max(initial=0) < _SMALL:
        parts = [y[a : a + BLOCK] for a in range(0, len(y), BLOCK)]
        total = sum((p.sum(axis=0).astype(np.int64).astype(object) for p in parts), np.zeros(y.shape[1], object))
        return total, sum(((p.T @ p).astype(np.int64).astype(object) for p in parts), np.zeros((y.shape[1],) * 2, object))
    whole = _bounded(y)
    return whole.sum(axis=0), whole.T @ whole


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and P over all vectors: d * d numbers, whatever the table's size."""
    last = d  # row and column of the sums, and of the count

    def add(batches):
        n, s, p = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = integers(batch.column(0), d)
            n += len(y)
            a, b = products(y)
            s += a
            p += b
        i, j = np.triu_indices(d)
        values = [*p[i, j], *s, n]
        rows = [*i, *([last] * d), last], [*j, *range(d), last]
        low = [v & ((1 << _LIMB) - 1) for v in values]
        high = [Decimal(v >> _LIMB) for v in values]
        yield pa.RecordBatch.from_pydict({"i": pa.array(rows[0], pa.int32()), "j": pa.array(rows[1], pa.int32()), "low": pa.array(map(Decimal, low), pa.decimal128(38, 0)), "high": pa.array(high, pa.decimal128(38, 0))})
        tidied()

    sums = vectors.select("__v").mapInArrow(add, "i int, j int, low decimal(38,0), high decimal(38,0)").groupBy("i", "j").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    n, s, p = 0, [0] * d, [[0] * d for _ in range(d)]
    for r in sums.collect():
        value = (int(r["high"]) << _LIMB) + int(r["low"])
        if r["i"] < last:
            p[r["i"]][r["j"]] = p[r["j"]][r["i"]] = value
        elif r["j"] < last:
            s[r["j"]] = value
        else:
            n = value
    return n, s, p


# --- 2. the characteristic polynomial


def primes(count: int) -> list[int]:
    """The greatest primes below 2**31, as many as asked for."""
    small = [p for p in range(3, 46341, 2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2))]
    out: list[int] = []
    top = 1 << 31
    while len(out) < count:
        width = 1 << 16
        low = top - width
        flags = np.ones(width, bool)
        flags[::2] = False  # low is even
        for q in small:
            flags[(-low) % q :: q] = False
        out += sorted((low + np.flatnonzero(flags)).tolist(), reverse=True)
        top = low
    return out[:count]


def _powers(base: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inverses modulo the primes: base ** (p - 2)."""
    out, square, e = np.ones_like(base), base % p, p - 2
    while e.any():
        out = np.where(e & 1, out * square % p, out)
        square = square * square % p
        e = e >> 1
    return out


def polynomials(matrices: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients (leading first) of det(y - A) modulo each prime, for a stack of matrices,
    each reduced modulo its own prime: similarity to Hessenberg form, then its recurrence."""
    a = matrices.copy()
    k, d = a.shape[0], a.shape[1]
    every, q, q2 = np.arange(k), p[:, None], p[:, None, None]
    for c in range(d - 2):
        pivot = c + 1 + np.argmax(a[:, c + 1 :, c] != 0, axis=1)
        for x in (lambda: (every, pivot), lambda: (every, slice(None), pivot)):
            there = x()
            here = (every, np.full(k, c + 1)) if len(there) == 2 else (every, slice(None), np.full(k, c + 1))
            held = a[there].copy()
            a[there] = a[here]
            a[here] = held
        factor = a[:, c + 2 :, c] * _powers(a[:, c + 1, c], p)[:, None] % q  # 0 ** (p - 2) is 0: nothing to clear
        a[:, c + 2 :, :] = (a[:, c + 2 :, :] - factor[:, :, None] * a[:, c + 1, None, :] % q2) % q2
        a[:, :, c + 1] = (a[:, :, c + 1] + (a[:, :, c + 2 :] * factor[:, None, :] % q2).sum(axis=2)) % q
    grown = np.zeros((d + 1, k, d + 1), np.int64)  # of leading blocks, the constant first
    grown[0, :, 0] = 1
    for m in range(1, d + 1):
        here = np.roll(grown[m - 1], 1, axis=1)
        here = (here - a[:, m - 1, m - 1, None] * grown[m - 1] % q) % q
        below = np.ones(k, np.int64)
        for i in range(m - 1, 0, -1):
            below = below * a[:, i, i - 1] % p
            here = (here - (a[:, i - 1, m - 1] * below % p)[:, None] * grown[i - 1] % q) % q
        grown[m] = here
    return grown[d][:, ::-1]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients (leading first) of the characteristic polynomial of a symmetric integer
    matrix without negative eigenvalues.

    The k-th is at most C(d, k) (trace / d)^k, so enough primes make it certain; each task
    reduces the matrix modulo a few of them."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bits = max((math.comb(d, k).bit_length() + k * max(trace.bit_length() - d.bit_length() + 1, 1) for k in range(d + 1)), default=1)
    moduli = primes((bits + 2) // 30 + 1)

    def reduce(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            for a in range(0, len(pdf), 16):
                p = pdf["p"].to_numpy(np.int64)[a : a + 16]
                stack = np.array([[[v % int(m) for v in row] for row in matrix] for m in p], np.int64).reshape(len(p), d, d)
                yield pd.DataFrame({"p": p, "c": list(polynomials(stack, p))})

    tasks = min(len(moduli), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame(pd.DataFrame({"p": moduli})).repartition(tasks, "p").mapInPandas(reduce, "p bigint, c array<bigint>").collect()
    whole = math.prod(moduli)
    out = [0] * (d + 1)
    for r in rows:
        rest = whole // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        for i, v in enumerate(r["c"]):
            out[i] += v * unit
    out = [v % whole for v in out]
    return [v - whole if 2 * v > whole else v for v in out]


# --- 3. roots


def roots_above(coefficients: list[int], m: int, s: int) -> int:
    """How many roots, all of them real, are greater than m / 2**s: the changes of sign in
    the coefficients of p((y + m) / 2**s)."""
    c = [v << (s * i) for i, v in enumerate(coefficients)] if s >= 0 else list(coefficients)
    m = m if s >= 0 else m << -s
    for end in range(len(c) - 1, 0, -1):
        for i in range(1, end + 1):
            c[i] += m * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(coefficients: list[int], count: int, top: int) -> list[tuple[int, int]]:
    """The ``count`` largest positive roots, the largest first, as (m, s): the root is in
    (m / 2**s, (m + 1) / 2**s], ROOT_BITS bits of it.  Equal roots give equal pairs.
    ``top`` is at least the largest root."""
    count = min(count, roots_above(coefficients, 0, 0))
    todo = [(0, 1, -top.bit_length(), 0, count)] if count else []  # (m, width, s, roots above, as many wanted)
    found: list[tuple[int, tuple[int, int]]] = []
    while todo:
        m, _, s, above, here = todo.pop()
        if m.bit_length() >= ROOT_BITS:
            found += [(above + i, (m, s)) for i in range(here)]
            continue
        m, s = 2 * m, s + 1
        upper = min(max(roots_above(coefficients, m + 1, s) - above, 0), here)
        if upper:
            todo.append((m + 1, 1, s, above, upper))
        if here - upper:
            todo.append((m, 1, s, above + upper, here - upper))
    return [r for _, r in sorted(found, key=lambda f: f[0])]


# --- 4. components


def _solver(matrix: list[list[int]], root: Decimal):
    """Elimination with pivots of (matrix - root), kept for several right sides."""
    d = len(matrix)
    a = np.array([[Decimal(v) for v in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= root
    order, factors = [], []
    for c in range(d):
        best = max(range(c, d), key=lambda r: abs(a[r, c]))
        a[[c, best]] = a[[best, c]]
        order.append(best)
        if not a[c, c]:
            a[c, c] = root.scaleb(-DIGITS)
        factor = a[c + 1 :, c] / a[c, c]
        a[c + 1 :, c:] -= factor[:, None] * a[c, c:]
        factors.append(factor)

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for c in range(d):
            b[[c, order[c]]] = b[[order[c], c]]
            b[c + 1 :] -= factors[c] * b[c]
        for c in range(d - 1, -1, -1):
            b[c] = (b[c] - (a[c, c + 1 :] * b[c + 1 :]).sum()) / a[c, c]
        return b

    return solve


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / max(map(abs, v))
    return v / (v * v).sum().sqrt()


def components_of(matrix: list[list[int]], roots: list[tuple[int, int]]) -> list[np.ndarray]:
    """A unit vector of decimals for each root, at right angles to those before it."""
    d = len(matrix)
    out: list[np.ndarray] = []
    solve, last = None, None
    for m, s in roots:
        if (m, s) != last:
            last, solve = (m, s), _solver(matrix, value_of(m, s))
        k = len(out)
        v = np.array([Decimal(((i * 7919 + k * 104729 + 1) % 1009) + 1) for i in range(d)], object)
        for _ in range(4):
            v = _unit(solve(_unit(v)))
            for u in out:  # of other roots, too: what rounding left of them
                v = v - u * (u * v).sum()
        out.append(_unit(v))
    return out


def value_of(m: int, s: int) -> Decimal:
    """The middle of a root's interval."""
    return (Decimal(2 * m + 1) / 2) * (Decimal(2) ** -s)


@dataclass
class Whitening:
    """n and S of floor(1024 c), the trace of the scatter, its largest roots, and what the
    centred vector is multiplied with: a row of doubles for each component."""

    n: int
    total: list[int]
    trace: int
    explained: list[float]
    maps: np.ndarray
    error: float = 0.0


def _prepared(rows: DataFrame, vector: str) -> DataFrame:
    return rows.where(usable(vector)).withColumn("__v", F.col(vector).cast("array<double>"))


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors of the most frequent length; None where there is
    no variance (no vectors, one, or equal ones)."""
    spark = rows.sparkSession
    vectors = _prepared(rows, vector).select("__v")
    d = dimension(vectors)
    if not d:
        return None
    vectors = vectors.where(F.size("__v") == d)
    n, s, p = scatter(vectors, d)
    matrix = [[n * p[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return None
    with localcontext(getcontext()) as context:
        context.prec = DIGITS
        roots = largest_roots(characteristic(spark, matrix), components, trace)
        units = components_of(matrix, roots)
        values = [value_of(*r) for r in roots]
        # e = root / n^2, so whitened = (x - S/n) . unit * n / sqrt(root)
        maps = np.array([[float(x * n / e.sqrt()) for x in u] for u, e in zip(units, values, strict=True)])
        out = Whitening(n, s, trace, [float(e / trace) for e in values], maps)
    out.error = _identity_error(vectors, out)
    return out


def centred(y: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n y - S of each entry, exactly: as long where that fits, else as Python integers; and
    (y - S / n) as doubles."""
    most = w.n * (int(np.abs(y).max(initial=0)) + 1) + max(map(abs, w.total), default=0)
    if most < 1 << 62:
        t = y.astype(np.int64) * w.n - np.array(w.total, np.int64)
        return t, t / w.n
    t = _bounded(y) * w.n - np.array(w.total, object)
    return t, (t / w.n).astype(np.float64)


def deviations(t: np.ndarray) -> list[Decimal | None]:
    """Sum of the squares of each row; null from 38 digits on."""
    if t.dtype != object and len(t) and t.shape[1] * int(np.abs(t).max()) ** 2 <= _LONG:
        return list(map(Decimal, (t * t).sum(axis=1).tolist()))
    if t.dtype != object and len(t) and int(np.abs(t).max()) < 1 << 52:
        high, low = t >> 26, t & ((1 << 26) - 1)
        parts = ((a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low)))
        return [Decimal((a << 52) + (b << 27) + c) for a, b, c in zip(*parts, strict=True)]
    sums = ((t.astype(object)) ** 2).sum(axis=1) if len(t) else []
    return [Decimal(v) if v < 10**38 else None for v in sums]


def _identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured
    over all of them."""
    d, k = w.maps.shape[1], len(w.maps)

    def add(batches):
        s, p = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            white = centred(integers(batch.column(0), d), w)[1] @ w.maps.T
            s += white.sum(axis=0)
            p += white.T @ white
        i, j = np.indices((k, k))
        rows = {"i": [*i.ravel(), *([k] * k)], "j": [*j.ravel(), *range(k)], "v": [*p.ravel(), *s]}
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.float64() if c == "v" else pa.int32()) for c, v in rows.items()})
        tidied()

    sums = {(r["i"], r["j"]): r["v"] for r in vectors.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max((abs(sums[i, j] / w.n - sums[k, i] * sums[k, j] / w.n**2 - (i == j)) for i in range(k) for j in range(k)), default=0.0)


def whitened(rows: DataFrame, w: Whitening | None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: id, component (from 1), n, deviation
    (decimal: sum over dimensions of (n x - S)^2, exact; null from 38 digits on), whitened,
    explained, identity_error.

    Vectors that are null, empty, or hold null, NaN or infinite entries take no part, nor do
    those of another length than the most frequent one.  Repeated rows and null ids are rows
    like any other.  Components without variance are left out, so a table without variance
    (or without rows) gives an empty table.  Entries beyond the range of a long become its
    ends.  Other columns, whatever their names, are not read.
    """
    kind = dict(rows.select(id_col).dtypes)[id_col]
    schema = f"__id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if w is None or not len(w.maps):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("__id", id_col)
    d, k = w.maps.shape[1], len(w.maps)

    def transform(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(a, BLOCK)
                t, y = centred(integers(batch.column(1), d), w)
                m = len(y)
                each = lambda values, kind: pa.array(np.tile(values, m), kind)
                deviation = pa.array(deviations(t), pa.decimal128(38, 0))
                at = pa.array(np.repeat(np.arange(m), k))
                columns = [batch.column(0).take(at), each(np.arange(1, k + 1), pa.int32()), pa.array(np.full(m * k, w.n), pa.int64()), deviation.take(at), pa.array((y @ w.maps.T).ravel()), each(w.explained, pa.float64()), pa.array(np.full(m * k, w.error))]
                yield pa.RecordBatch.from_arrays(columns, ["__id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        tidied()

    ready = _prepared(rows.select(F.col(id_col).alias("__id"), F.col(vector).alias("__w")), "__w").where(F.size("__v") == d)
    return ready.select("__id", "__v").mapInArrow(transform, schema).withColumnRenamed("__id", id_col)
