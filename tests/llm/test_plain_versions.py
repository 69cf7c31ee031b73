"""Operators beside plain versions of them: loops over turns, blocks and documents."""

import math
import random

import numpy as np

from pathloom.llm import html_blocks, ordinal, preferences
from pathloom.llm.queries import ORACLES, QUERIES


def plain_pairs(turns):
    """pair_id -> rejected_id, n_common, prompt, and of both sides the rest and what is learnt of it."""
    found = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [(role, text) for _, _, role, text in sorted(t)] for c, t in found.items()}
    render = lambda t: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in t)
    out = {}
    for c, chosen in said.items():
        beside = c + 1 if c % 2 == 0 else c - 1
        m = (c // 2) % (len(chosen) + 1)
        rejected = chosen[:m] + said.get(beside, [])[m:]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        sides = [(render(s[n:]), [x + "<|end|>\n" for r, x in s[n:] if r == "assistant"]) for s in (chosen, rejected)]
        out[c] = (beside if beside in said else None, n, render(chosen[:n]), *sides)
    return out


def test_branches_are_plain(spark):
    rnd = random.Random(7)
    turns = [(rnd.choice([None, *range(-12, 40)]), rnd.choice([None, 0, 1, 2, 3, 3]), rnd.choice([None, "", "user", "assistant"]), rnd.choice([None, "", "a", "b", "ü 😀", "x" * 5000])) for _ in range(240)]
    # copies of one conversation, one that begins another, a long one, ids beyond what a double holds
    for c in (100, 101, 102, 103, 104, 2**60 + 6, 2**60 + 7):
        turns += [(c, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(6 if c != 104 else 3)]
    turns += [(105, i, ("user", "assistant")[i % 2], f"t{i % 50}") for i in range(400)]
    rows = spark.createDataFrame([(*t, 1, "k") for t in turns], "conv_id long, turn long, role string, text string, x int, pair string")
    got = preferences.formatted(preferences.branched(rows)).collect()
    want = plain_pairs(turns)
    assert len(got) == len(want) and {r["n_common"] for r in got} > {0, 1, 2, 6}
    for r in got:
        beside, n, prompt, chosen, rejected = want[r["pair_id"]]
        assert (r["chosen_id"], r["rejected_id"], r["n_common"], r["prompt"]) == (r["pair_id"], beside, n, prompt)
        for (text, learnt), t, mask in ((chosen, r["chosen_text"], r["chosen_mask"]), (rejected, r["rejected_text"], r["rejected_mask"])):
            assert t == text and [t[a:b] for a, b in mask] == learnt
    assert preferences.formatted(preferences.branched(rows.where("false"))).count() == 0


def test_pairs_without_sides(spark):
    """Null and empty sides, sides that are alike, and one that goes on where the other ends."""
    side = "array<struct<turn:bigint,role:string,text:string>>"
    a, b = (0, "user", "q"), (1, "assistant", "w")
    rows = spark.createDataFrame([(1, 1, 2, None, None), (2, 1, 2, [], [a]), (3, 1, 2, [a, b], [a, b]), (4, 1, 2, [a, b], [(7, "user", "q")])], f"pair_id long, chosen_id long, rejected_id long, chosen {side}, rejected {side}")
    got = {r["pair_id"]: r for r in preferences.formatted(rows).collect()}
    assert [got[i]["n_common"] for i in (1, 2, 3, 4)] == [0, 0, 2, 1]
    assert (got[3]["chosen_text"], got[3]["rejected_text"], got[4]["rejected_text"]) == ("", "", "") and got[4]["chosen_text"] == "<|assistant|>\nw<|end|>\n"


def test_preferences_query_is_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view conversations as select * from '{d}/conversations.parquet'")
    want = duckdb.sql(ORACLES["op5_preferences"])
    got = QUERIES["op5_preferences"](spark, d)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall())) and got.columns == want.columns


def test_deep_paths_are_read_whole():
    deep = "<div>" * 60
    page = f"{deep}<article>{deep}<p>in{'</div>' * 3}<aside>{deep}<p>out</aside></article>{deep}<p>after"
    assert [(b.text, html_blocks.taught(b.path)) for b in html_blocks.blocks(page)] == [("in", 1), ("out", 0), ("after", 0)]
    # a name in the middle shows in the vector
    one, other = (html_blocks.blocks(f"{deep}<div class={name}>{deep}<p>x")[0] for name in ("zebra", "quagga"))
    assert (html_blocks.vectors([one]) != html_blocks.vectors([other])).any()
    assert len(html_blocks.blocks("<div>x " * 20_000)) == 20_000


def test_path_places_are_plain():
    import re
    import zlib

    steps = ["html", "body", "div post-content wide", "section", "article"]
    want = np.zeros(html_blocks.PATH_DIM)
    for step in steps[2:]:
        tag, *names = step.split()
        for name in [tag] + ["." + p for n in names for p in [n, *re.split("[-_]", n)]]:
            want[zlib.crc32(name.encode()) % html_blocks.PATH_DIM] = 1
    path = html_blocks.Path()
    for step in steps:
        path = path.under(step)
    assert (html_blocks.vectors([html_blocks.Block(path, "x", 0.0)])[0, : html_blocks.PATH_DIM] == want).all() and path.inside == 1


def plain_labels(model, x):
    """Probabilities of a page's blocks, number by number."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    n, states = model.hidden, {}
    for d in "fb":
        wx, wh, bias = model.p["x" + d], model.p["h" + d], model.p["c" + d]
        h, c, states[d] = [0.0] * n, [0.0] * n, {}
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = [bias[k] + sum(x[t][j] * wx[j][k] for j in range(len(x[t]))) + sum(h[j] * wh[j][k] for j in range(n)) for k in range(4 * n)]
            c = [sig(z[n + k]) * c[k] + sig(z[k]) * math.tanh(z[3 * n + k]) for k in range(n)]
            h = [sig(z[2 * n + k]) * math.tanh(c[k]) for k in range(n)]
            states[d][t] = h
    return [sig(model.p["ob"][0] + sum(s * w[0] for s, w in zip(states["f"][t] + states["b"][t], model.p["o"], strict=True))) for t in range(len(x))]


def test_labeller_is_plain():
    """Pages of unlike length in one batch label as each does alone; every gradient is the
    slope of the loss of the plain version."""
    rng = np.random.default_rng(4)
    model = html_blocks.Labeller(dims=3, hidden=2, seed=1)
    pages = [(rng.normal(size=(k, 3)), (rng.random(k) < 0.5).astype(float)) for k in (1, 5, 3)]
    x, mask, y = html_blocks.padded(pages)
    p = model.forward(x, mask)[0]
    for k, (a, _) in enumerate(pages):
        assert np.allclose(p[: len(a), k], plain_labels(model, a), atol=1e-12)
    assert [q.tolist() for q in model.labels([a for a, _ in pages])] == [[v >= 0.5 for v in plain_labels(model, a)] for a, _ in pages]

    def loss():
        return -sum(math.log(q if t else 1 - q) for a, b in pages for q, t in zip(plain_labels(model, a), b, strict=True)) / 9

    for name, g in model.gradients(x, mask, y).items():
        w = model.p[name]
        for at in np.ndindex(w.shape):
            w[at] += 1e-5
            up = loss()
            w[at] -= 2e-5
            down = loss()
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[at]) < 1e-7, (name, at)


def test_ordinal_reaches_the_plain_optimum():
    """Mean log likelihood against gradient ascent by differences over all six numbers."""
    rnd = np.random.default_rng(5)
    grade = rnd.integers(0, 3, 300)
    bucket = np.where(rnd.random(300) < 0.6, grade, rnd.integers(0, 4, 300))
    model = ordinal.train(np.arange(300), bucket, grade, 3, epochs=300, batch=300)

    def likelihood(v):
        total = 0.0
        for b, g in zip(bucket, grade, strict=True):
            tail = [1.0, *(1 / (1 + math.exp(t - v[b])) for t in v[4:]), 0.0]
            total += math.log(max(tail[g] - tail[g + 1], 1e-12))
        return total / len(grade)

    v = np.array([0.0, 0, 0, 0, -0.5, 0.5])
    for _ in range(150):
        slope = np.array([(likelihood(v + e) - likelihood(v - e)) / 2e-4 for e in 1e-4 * np.eye(6)])
        v = v + 4 * slope
    found = likelihood(np.concatenate((model.weight[:4], model.theta)))
    assert np.abs(slope).max() < 0.01 and likelihood(v) - 0.01 < found <= likelihood(v) + 0.001
    # tails of texts, by the same numbers
    texts = ["", None, "one two", "two, two three!"]
    model = ordinal.CumulativeLink(rnd.normal(size=ordinal.BUCKETS), np.array([-0.3, 0.4]))
    tails = model.tails(texts)
    assert np.allclose(tails[:2], 1 / (1 + np.exp(model.theta))) and (np.diff(tails, axis=1) < 0).all()
