"""Whitening, source divergence and SentencePiece ids against plain versions."""

import math
import random
import re
from collections import Counter
from decimal import localcontext
from fractions import Fraction

import numpy as np
import pytest

from pathloom.llm import divergence as D
from pathloom.llm import sentencepieces as S
from pathloom.llm import whitening as W
from pathloom.llm.queries import QUERIES, pieces

SF = "/root/testdata/sf0.001"


# --- whitening


def plain_polynomial(a):
    """Faddeev and LeVerrier, in fractions."""
    d = len(a)
    c, m = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(sum(a[i][t] * m[t][i] for t in range(d)) for i in range(d)) / k)
    return [int(x) for x in c]


def test_characteristic_polynomial(spark):
    rnd = random.Random(3)
    for d, rank, size in ((1, 1, 9), (2, 1, 50), (4, 4, 1000), (6, 3, 10**9), (9, 9, 10**15), (5, 0, 1)):
        b = [[rnd.randint(-size, size) for _ in range(rank)] for _ in range(d)]
        a = [[sum(x * y for x, y in zip(p, q, strict=True)) for q in b] for p in b]
        assert W.characteristic(spark, a) == plain_polynomial(a)
    # entries that vanish modulo a prime, and no pivot below the diagonal
    p = W.primes(1)[0]
    for a in ([[p, 0, 0], [0, 2 * p, 0], [0, 0, 7]], [[2, 0, 1], [0, 3, 0], [1, 0, 2]], [[5 * p, p, 0, 1], [p, 3 * p, 0, 0], [0, 0, 1, 0], [1, 0, 0, p]]):
        assert W.characteristic(spark, a) == plain_polynomial(a)


def test_primes():
    found = W.primes(40)
    assert found[0] == 2**31 - 1 and found == sorted(set(found), reverse=True)
    assert all(all(p % q for q in range(2, math.isqrt(p) + 1)) for p in found[:3] + found[-2:])


def test_roots_and_components_of_equal_roots():
    # (y - 2)^3 (y - 5) y, roots counted with their multiplicity
    poly = np.poly([2, 2, 2, 5, 0]).round().astype(int).tolist()
    roots = W.largest_roots(poly, 8, 11)
    assert len(roots) == 4 and roots[1] == roots[2] == roots[3]
    assert [round(m / 2**s, 12) for m, s in roots] == [5, 2, 2, 2]
    near = [(10**12 + 1), 10**12, 10**12, 3]
    c = [1]
    for r in near:
        c = [x - r * y for x, y in zip([*c, 0], [0, *c], strict=True)]
    assert [m >> s if s > 0 else m << -s for m, s in W.largest_roots(c, 3, sum(near))] in ([10**12 + 1, 10**12, 10**12], [10**12, 10**12 - 1, 10**12 - 1])
    a = [[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 3, 2], [0, 0, 2, 3]]
    with localcontext() as context:
        context.prec = W.DIGITS
        units = W.components_of(a, W.largest_roots(np.poly([2, 2, 5, 1]).round().astype(int).tolist(), 4, 10))
    u = np.array([[float(x) for x in v] for v in units])
    assert np.abs(u @ u.T - np.eye(4)).max() < 1e-15
    assert np.abs(u @ np.array(a) - np.array([[5], [2], [2], [1]]) * u).max() < 1e-14


def plain_whitening(rows, d):
    keep = [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(Fraction(c) * 1024) + 100000 for c in v] for _, v in keep]
    n = len(x)
    s = [sum(r[k] for r in x) for k in range(d)]
    centred = np.array([[float(Fraction(n * r[k] - s[k], n)) for k in range(d)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in keep], n, [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x], centred @ v[:, ::-1] / np.sqrt(np.maximum(e[::-1], 1e-300)), e[::-1] / e.sum(), int((e > 1e-9 * e[-1]).sum())


@pytest.mark.parametrize("scale", [1.0, 3000.0, 1e7])
def test_whitening_is_plain(spark, scale):
    rnd = np.random.default_rng(5)
    d = 5
    rows = [(int(i), [float(x) for x in rnd.normal(size=d) * scale * np.arange(1, d + 1)]) for i in range(60)]
    rows += [rows[0], (7, [1.0, None, 0.0, 0.0, 0.0]), (8, [1.0, float("nan"), 0.0, 0.0, 0.0]), (9, [float("inf")] * d), (10, None), (11, []), (12, [1.0, 2.0]), (None, [0.0] * d)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id bigint, embedding array<double>, n string, component int").repartition(3)
    got = W.whitened(df, W.fit(df)).collect()
    ids, n, deviation, white, explained, rank = plain_whitening(rows, d)
    assert rank == 5 and len(got) == 5 * len(ids) and {r["n"] for r in got} == {n}
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in got) == sorted((str(i), x) for i, x in zip(ids, deviation, strict=True) for _ in range(5))
    for k in range(1, 6):
        mine = np.sort(np.abs([r["whitened"] for r in got if r["component"] == k]))
        assert np.allclose(mine, np.sort(np.abs(white[:, k - 1])), atol=1e-9)
        assert np.isclose(next(r["explained"] for r in got if r["component"] == k), explained[k - 1])
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_without_variance(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None), (2, [])]):
        df = spark.createDataFrame(rows, schema)
        out = W.whitened(df, W.fit(df))
        assert out.collect() == [] and out.columns[0] == "vec_id"
    # one direction only: one component, whatever the length of the vectors
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], schema)
    assert {r["component"] for r in W.whitened(df, W.fit(df)).collect()} == {1}
    # beyond a long: the nearest one, no crash
    df = spark.createDataFrame([(i, [i * 1e300, float(i)]) for i in range(4)], "vec_id bigint, embedding array<double>")
    got = W.whitened(df, W.fit(df)).collect()
    assert len(got) == 8 and all(math.isfinite(r["whitened"]) for r in got)


def test_whitening_query(spark):
    df = QUERIES["op11_whitening"](spark, SF)
    got = df.toPandas()
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, n, deviation, white, explained, _ = plain_whitening(rows, 64)
    assert len(got) == 8 * len(ids) and set(got["n"]) == {n}
    assert got["identity_error"].max() < 1e-9
    by = got.set_index(["component", "vec_id"])
    for k in range(1, 9):
        mine = by.loc[k].loc[ids]
        assert np.allclose(np.abs(mine["whitened"]), np.abs(white[:, k - 1]), atol=1e-8)
        assert np.isclose(mine["explained"].iloc[0], explained[k - 1], rtol=1e-10)
        assert mine["deviation"].tolist() == deviation


# --- divergence


def plain_audit(rows, least, top):
    rows = [tuple(v or "" for v in r) for r in rows]
    words = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = []
    for lang in {r[0] for r in rows}:
        docs = [(s, Counter(words(t))) for x, s, t in rows if x == lang]
        held = Counter(w for _, c in docs for w in c)
        kept = [w for w in held if held[w] >= least]
        count = {s: Counter() for s, _ in docs}
        for s, c in docs:
            count[s].update({w: c[w] for w in kept if w in c})
        every = sum(count.values(), Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(every)
        order = lambda items: sorted(items, key=lambda i: (-i[1], i[0].encode()))
        for s in count:
            pairs = order([(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in count if o != s])
            terms = order([(w, p[s][w] - q[w]) for w in kept if count[s][w] and p[s][w] > q[w]])[:top]
            out += [(lang, s, "pair", i, v, k) for k, (i, v) in enumerate(pairs, 1)] + [(lang, s, "term", i, v, k) for k, (i, v) in enumerate(terms, 1)]
    return sorted(out)


def test_audit_is_plain(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}x{chr(97 + i // 26)}" for i in range(60)] + ["É", "straße", "ABC", "梦", "ünï"]
    rows = []
    for i in range(400):
        text = " ".join(rnd.choice(words[: rnd.randrange(1, len(words))]) for _ in range(rnd.randrange(30)))
        rows.append((rnd.choice(["en", "de", None, ""]), rnd.choice([f"s{k}" for k in range(7)] + [None]), rnd.choice([text, text.upper(), text.replace(" ", "1,_\n"), None, "", "123 ..."])))
    rows += [("en", "hot", "Alpha beta beta")] * 200 + [("xx", "a", "rare words"), ("xx", "b", None), ("en", "empty", "")]
    rows += [("en", "long", "gamma delta " * 40_000)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "lang string, source string, text string, term string, rank int").repartition(5)
    for least, terms, sources in ((5, 8192, 128), (5, 7, 3), (1, 20, 2), (10**6, 10, 5)):
        monkeypatch.setattr(D, "SHARD_TERMS", terms)
        monkeypatch.setattr(D, "BLOCK_SOURCES", sources)
        assert sorted(map(tuple, D.audit(df, least, 4).collect())) == plain_audit(rows, least, 4)
    assert D.audit(df.limit(0)).collect() == []


def test_partial_counts_merge(spark, monkeypatch):
    """A task that lets go of its counts often counts the same."""
    import pyarrow as pa

    rows = {"lang": ["en", None] * 300, "source": ["a", "b", "c"] * 200, "text": ["One two", "two, TWO three\x00é", ""] * 200}
    batch = pa.RecordBatch.from_pydict(rows, pa.schema([(c, pa.string()) for c in rows]))
    total = lambda: sum((Counter({r[:3]: r[3] for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)}) for b in D._partial([batch, batch.slice(7, 90)])), Counter())
    want = total()
    monkeypatch.setattr(D, "HELD_ROWS", 5)
    monkeypatch.setattr(D, "BATCH_ROWS", 11)
    assert total() == want and want["en", "a", "one"] == 100 + 15


# --- SentencePiece


HOSTILE = ["", " ", "   ", "a", "▁", "▁▁ a▁b", "\0", "\n\t", "<s></s><unk><0x41>", "x" * 3000, " " * 3000, "ab" * 2000, "é" * 50, "梦想家 123", "😀😀 a😀", "  z", "Straße ﬁ", "á"]


def test_pieces_are_the_library(spark):
    mine = S.Pieces(pieces())
    rnd = random.Random(4)
    alphabet = " ▁  ab.,\n\0é梦ข😀12</s>" + "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(40))
    texts = HOSTILE + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(150))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0xD800), rnd.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(300)]
    want = mine.library.encode(texts, add_eos=True)
    assert [x.tolist() for x in mine.encode(texts)] == want
    # a worker that forgets, and parts of single texts
    assert [x.tolist() for t in texts[:200] for x in mine.encode([t])] == want[:200]


def test_pieces_forgotten(monkeypatch):
    mine = S.Pieces(pieces())
    monkeypatch.setattr(S, "REMEMBERED", 40)
    monkeypatch.setattr(S, "PART_CHARS", 100)
    texts = [f"word{i} some text {i * i}" for i in range(300)]
    assert [x.tolist() for x in mine.encode(texts)] == mine.library.encode(texts, add_eos=True)


def test_encoded_rows(spark):
    texts = [*HOSTILE, None, "long " * 60_000]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts * 2)], "doc_id bigint, text string, ids string, decoded int").repartition(3)
    got = S.encoded(df, pieces()).collect()
    mine = S.Pieces(pieces()).library
    want = [(i if i != 3 else None, tuple(x := mine.encode(t or "", add_eos=True)), mine.decode(x)) for i, t in enumerate(texts * 2)]
    assert sorted(((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got), key=repr) == sorted(want, key=repr)
    assert S.encoded(df.limit(0), pieces()).collect() == []


def test_pieces_query(spark):
    import hashlib

    library = S.Pieces(pieces()).library
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_sentencepieces"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]] or "", add_eos=True)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
