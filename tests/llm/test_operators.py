"""Each operator against a plain version, on small and awkward inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pathloom.llm import fmindex, html_blocks, jaccard, licenses, ordinal, packing, permutation, pii, preferences, toxicity
from pathloom.llm.bytewords import NONSPACE, Words
from pathloom.llm.tokens import Encoder

AWKWARD = [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "One TWO"), (6, "word " * 3000), (7, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "é 🙂 日本 \0 x")]


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, uid string, n int")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_jaccard(spark):
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("abcdefghij") + str(rnd.randint(0, 50)) for _ in range(60)) for _ in range(6)]
    rows = list(AWKWARD)
    for i in range(120):
        words = base[i % 6].split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            words[rnd.randrange(len(words))] = "new" + str(rnd.random())
        rows.append((100 + i, " ".join(words)))
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(docs(spark, rows)).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    assert jaccard.jaccard_classes(docs(spark, [])).count() == 0


def test_jaccard_ids_null_or_repeated(spark):
    def text(name, first=0, n=60):
        return " ".join(f"{name}{k}" for k in range(first, first + n))

    # 5 and 6 link by way of a text without id only; 7 stands for two texts
    rows = [(6, text("a")), (None, text("a", 5)), (5, text("a", 10)), (7, text("x")), (7, text("y")), (8, text("x", 2)), (9, text("y", 2)), (3, text("y", 4))]
    rows += [(None, text("z")), (None, text("z")), (None, text("z", 1)), (None, None), (None, " ")]
    table = docs(spark, rows)
    got = sorted(map(str, ((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_classes(table).collect())))
    assert got == sorted(map(str, [(6, 5), (None, 5), (5, 5), (7, 7), (7, 3), (8, 7), (9, 3), (3, 3), *[(None, None)] * 5]))
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(table).collect()]
    named = {k for k in kept if k[0] is not None}
    assert named == {(5, text("a", 10)), (7, text("x")), (3, text("y", 4))}
    assert sorted((t or "")[:1] for i, t in kept if i is None) == ["", " ", "z"] and len(kept) == 6


def test_contamination(spark):
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, 14)))) for i in range(5)] + [(9, None)]
    rows = AWKWARD + [(50 + i, " ".join(rnd.choice(["a", "b", "c", "d", "é", "zz"]) for _ in range(80))) for i in range(30)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    found = {r["doc_id"]: r for r in fmindex.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for g, held in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    ids |= held
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    clean = fmindex.decontaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert fmindex.contamination(clean, spark.createDataFrame(items, "item_id long, text string")).where("contaminated").count() == 0


def test_tokens_and_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    enc = Encoder(P.path("byte_bpe_50k.json"))
    rnd = random.Random(3)
    parts = ["'s", "'", " ", "  ", "a", "be", "1", "!", "\n", "\t", "'ll", "é", "\xa0", "<|endoftext|>"]
    texts = [t or "" for _, t in AWKWARD] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(500)]
    assert [x.tolist() for x in enc.encode(texts)] == [enc.whole(t).tolist() + [0] for t in texts]
    rows = packing.pack_documents(docs(spark, AWKWARD + [(8, "a b c d e f g h")]), P.path("byte_bpe_50k.json"), capacity=64).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in AWKWARD:
        ids = np.array(enc.whole(t or "").tolist() + [0], "<u4")
        for r in by_doc[i]:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in by_doc[i]) == len(ids) * (2 if i == 8 else 1)
    for held in by_bin.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64


def test_first_fit_decreasing():
    rnd = random.Random(1)
    sizes = sorted((rnd.randint(1, 50) for _ in range(300)), reverse=True)
    bins, room = packing.Bins(len(sizes), 50), []
    for s in sizes:
        b = next((i for i, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(50)
        assert bins.place(s) == (b, 50 - room[b])
        room[b] -= s


def test_toxicity_and_grades(spark):
    rnd = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            words[rnd.randrange(40)] = rnd.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    table = docs(spark, rows + [(1000, None), (1001, "")])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scored(table, toxicity.fit(table, marks)).collect()
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    graded = ordinal.graded(table, ordinal.fit(table, marks.selectExpr("doc_id", "case when toxic = 1 then 0 else 1 + doc_id % 2 end as grade"), 3)).collect()
    low = [r["expected_grade"] for r in graded if r["doc_id"] < 600 and r["doc_id"] % 4 == 0]
    high = [r["expected_grade"] for r in graded if r["doc_id"] < 600 and r["doc_id"] % 4]
    assert np.mean(low) < np.mean(high)
    empty = toxicity.fit(table.where("false"), marks)
    assert toxicity.scored(table, empty).count() == 602


def test_pii_base_spans(spark):
    rows = AWKWARD + [(20, "a@b.co_x@y.com é🙂 +1 (724) 555-7058 1.2.3.4.5.6.7.8 999.1.1.1 4387 5130-3523 7269269 4387513035237269 +12 +1-2"), (21, "@@ a@ @b.c ++1 1..2.3.4 0001.02.3.255")]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(spark, rows), pii.Redactor()).collect()}

    def luhn(d):
        return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    for i, t in rows:
        t = t or ""
        spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                spans.append(("card", *m.span()))
        spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans), i


def made_private(n=400):
    """Texts with one or two of a card, a telephone number, an address and a mail address."""
    rnd = random.Random(8)

    def card():
        d = [rnd.randint(0, 9) for _ in range(15)]
        return "".join(map(str, [*d, next(c for c in range(10) if (c + sum(x if k % 2 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))) % 10 == 0)]))

    rows = []
    for i in range(n):
        found = [card(), f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", ".".join(str(rnd.randint(1, 255)) for _ in range(4)), f"{rnd.choice(('al', 'joe', 'ann.lee', f'max{i}', 'maximilian.long'))}@{rnd.choice(('x.io', 'site.com', 'a-place.org', 'some.where.net', f's{i}.eu'))}", str(rnd.randint(10**15, 10**16))]
        rows.append((i, f"words {found[i % 5]} and {rnd.choice('abcdefg')} then {found[(i + 1) % 5]} go"))
    return rows


def added(spark, redactor, texts):
    """What a redactor finds in each text, as (kind, value) in order."""
    out = pii.personal_data(docs(spark, list(enumerate(texts))), redactor).collect()
    found = {r["doc_id"]: sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)) for r in out}
    return [[(k, t[a:b]) for a, b, k in found[i]] for i, t in enumerate(texts)]


def test_pii_side_by_side(spark):
    redactor = pii.fit(docs(spark, made_private()))
    pairs = [
        [("card", "7536784127813050"), ("card", "4845168114407329")],
        [("", "2353820953013749"), ("card", "4550997810720808")],  # the first fails the check sum
        [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")],
        [("phone", "+1 (843) 555-7672"), ("ip", "170.106.47.218")],
    ]
    assert added(spark, redactor, [f"Des {a[1]} {b[1]} du" for a, b in pairs]) == [[x for x in p if x[0]] for p in pairs]
    (r,) = pii.personal_data(docs(spark, [(1, "Des 7536784127813050 4845168114407329 du")]), redactor).collect()
    assert (r["n_card"], r["n_added"], r["base_sha256"]) == (0, 2, hashlib.sha256(b"").hexdigest())


def test_pii_disguises(spark):
    redactor = pii.fit(docs(spark, made_private()))
    given = [
        ("email", "joe (AT) site (DOT) com"), ("email", "joe {AT} site.com"), ("email", "joe [At] site [Dot] com"), ("email", "joe at site dot com"),
        ("ip", "2001:db8::8a2e:7334"), ("ip", "fe80::1a2b:3c4d:5e6f:7a8b"), ("ip", "2001:db8:85a3:1319:8a2e:370:7348:1f2"),
        ("phone", "724-555-7058"), ("phone", "20 7946 0958"), ("phone", "01 42 68 53 00"), ("phone", "0171 555 934"),
    ]
    assert added(spark, redactor, [f"words {v} then" for _, v in given]) == [[x] for x in given]
    prose = ["std::vector and a::b", "the years 1990-1995 and 2024-01-15", "look at site.com then", "it was at noon (at] home"]
    assert added(spark, redactor, prose) == [[], [], [], []]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000 + i, [float(v) for v in x[0]]) for i in range(40)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16)]
    got = permutation.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect()
    good = {i: np.array(v) for i, v in rows if i < 2000}
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        want = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in want} & {i for _, i in mine})
        total += 5
    assert hits / total >= 0.9


def test_html():
    page = "<title>T</title><nav><ul><li><a>Home</a><li>x</ul></nav><article><h1>A &amp; B</h1><p><b>one<br>two<p>three<script>no</script></article><footer>f"
    found = html_blocks.blocks(page)
    assert [b.text for b in found] == ["T", "Home", "x", "A & B", "one two", "three", "f"]
    assert [html_blocks.taught(b.path) for b in found] == [0, 0, 0, 1, 1, 1, 0]
    assert html_blocks.blocks(None) == [] and html_blocks.blocks("<") != None  # noqa: E711
    model = html_blocks.Labeller(dims=3, hidden=2)
    x, mask, y = html_blocks.padded([(np.random.default_rng(0).normal(size=(4, 3)), np.array([0, 1, 1, 0.0])), (np.ones((2, 3)), np.ones(2))])
    g = model.gradients(x, mask, y)

    def loss():
        p = model.forward(x, mask)[0]
        return -(np.where(y > 0, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum()

    for name, w in model.p.items():
        at = np.unravel_index(0, w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6


def test_licences_of_mixed_layouts(spark):
    line, wrapped = "Released under the MIT License", "Licensed under the Apache License,\nVersion 2.0."
    both = "This work is licensed under the GNU General Public License, version 3.\n"
    rows = [(1, f"é x.\n{line}\nmore words\n\n{wrapped} y"), (2, f"{wrapped}\nwords\n{line}\nwords"), (3, f"{both}\n{both}{line}\nx. {wrapped}"), (4, both)]
    got = {r["doc_id"]: (r["licences"], r["sentences"], r["n_sentences"]) for r in licenses.licences(docs(spark, rows)).collect()}
    assert got == {
        1: ("Apache-2.0,MIT", "mit-short,apache-short", 2), 2: ("Apache-2.0,MIT", "apache-short,mit-short", 2),
        3: ("Apache-2.0,GPL-3.0,MIT", "gpl3-work,gpl3-work,mit-short,apache-short", 4), 4: ("GPL-3.0", "gpl3-work", 1),
    }


def test_licences_and_preferences(spark):
    text = "Foo. Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    got = {r["doc_id"]: r["licences"] for r in licenses.licences(docs(spark, AWKWARD + [(30, text), (31, "x\nReleased under the MIT License.\ny")])).collect()}
    assert got[30] == "BSD-2-Clause" and got[31] == "MIT" and got[1] == ""
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", None), (1, 0, "user", "hi"), (1, 1, "assistant", "longer"), (4, 0, "user", "alone")]
    rows = preferences.formatted(preferences.neighbours(preferences.conversations_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).collect()
    (r,) = rows
    assert (r["chosen_id"], r["n_common"], r["prompt"]) == (1, 1, "<|user|>\nhi<|end|>\n")
    assert [r["chosen_text"][a:b] for a, b in r["chosen_mask"]] == ["longer<|end|>\n"]


def thue_morse(n):
    """Two words of the letters a and b that a polynomial modulo 2 ** 64 takes for one."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    for n in (64, 256, 512, 2048):
        a, b = thue_morse(n)
        assert len(set(Words([a.encode(), b.encode()], NONSPACE).hash.tolist())) == 2
    rest = " one two three four five six seven eight nine ten"
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(docs(spark, [(1, a + rest), (2, b + rest), (3, "x " + rest)])).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
    P = pytest.importorskip("public_tokenizers")
    enc = Encoder(P.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in enc.encode([a, b, a])] == [enc.whole(t).tolist() + [0] for t in (a, b, a)]


def test_large_class_and_its_neighbours(spark, monkeypatch):
    """A class of many near copies, small classes that reach it by few of its members or
    not at all, and lists longer than the pivots; slices and blocks of a few sets."""
    monkeypatch.setattr(jaccard, "SLICE_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 700)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    rnd = random.Random(9)
    base = [f"t{i}" for i in range(70)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rnd.sample(range(70), rnd.choice([0, 1, 1, 2, 2, 3])):
            words[k] = f"n{rnd.random()}"
        rows.append((i, " ".join(words)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    label = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(docs(spark, rows)).collect()}
    assert got == label and 2 < len(set(label.values())) < 60


def test_shared_passages_make_no_lists(spark, monkeypatch):
    """Passages that twelve texts share, each in another part of the table: rare texts link
    by their own words, so no passage is posted, however many there are."""
    posted = {}

    def counted(df, name):
        out = stored(df, name)
        if name in ("postings", "met"):
            posted[name] = out.count()
        return out

    stored = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", counted)
    passage = lambda g: [f"p{g}-{k}" for k in range(40)]
    for groups in (20, 60):
        rows = [(1000 * part + g, " ".join([f"u{part}-{g}-{k}" for k in range(60)] + passage(g))) for part in range(12) for g in range(groups)]
        near = dict(rows)[3].split()
        rows.append((11999, " ".join(near[1:])))
        table = docs(spark, rows).repartitionByRange(12, "doc_id")
        got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_classes(table).collect()}
        assert got == {i: 3 if i == 11999 else i for i, _ in rows}
        assert posted == {"postings": 2, "met": 1}


def test_levels_are_counted_over_all_parts(spark):
    rows = [(i, f"own{i} b c d e " + ("often seen by many texts" if i < 40 else "seen by seven texts only" if i < 47 else "")) for i in range(60)]
    table = docs(spark, rows).repartitionByRange(12, "doc_id").select(jaccard.F.col("text").alias("__text"))
    levels = jaccard.shingle_levels(table, 5, len(rows))
    level = lambda text: [int(s[0] >> jaccard.np.uint64(jaccard._BITS)) for s in jaccard.shingle_sets([text], 5, levels)]
    assert level("often seen by many texts") == [2] and level("seen by seven texts only") == [0] and level("own1 b c d e") == [0]


def test_toxicity_of_pairs(spark):
    """Labels that hang on two terms together: no linear score can tell an exclusive or."""
    rnd = random.Random(5)
    rows, xor = [], {}
    for i in range(2000):
        words = [f"w{rnd.randrange(300)}" for _ in range(40)]
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words[rnd.randrange(20)] = "alpha" if a else words[0]
        words[20 + rnd.randrange(20)] = "beta" if b else words[0]
        rows.append((i, " ".join(words)))
        xor[i] = int(a != b)
    table = docs(spark, rows)
    model = toxicity.fit(table, spark.createDataFrame(list(xor.items()), "doc_id long, toxic int"))
    right = lambda m: np.mean([r["predicted"] == xor[r["doc_id"]] for r in toxicity.scored(table, m).where("held_out").collect()])
    assert right(model) > 0.95
    model.factor[:] = 0  # what is left is linear
    assert right(model) < 0.7
    kept = {r["doc_id"] for r in toxicity.without_toxic(table, model).collect()}
    assert kept == {r["doc_id"] for r in toxicity.scored(table, model).where("predicted = 0").collect()}


def test_html_markup_takes_one_pass():
    import time

    bad = ["<p>if i <n " + "word " * 200_000, "<a " + "x " * 500_000, "<" * 500_000, "<a '" * 200_000, "<!--" * 200_000, "<![CDATA[" * 100_000, "</b>x" * 100_000, "<p class=" + " " * 500_000, "&#" + "9" * 500_000]
    for page in bad:
        began = time.time()
        html_blocks.blocks(page)
        assert time.time() - began < 5, page[:20]
    text = lambda h: [b.text for b in html_blocks.blocks(h)]
    assert text("<p>a<!-- x -->b<textarea>q<p></textarea>c 3 < 4 <n x</p>z") == ["abc 3 < 4 <n x", "z"]
    assert text('<p class="x>y</p>z') == ["y", "z"] and text("&#99999999999; &#" + "0" * 5000 + "65;") == ["\ufffd A"]


def test_main_texts_of_other_layouts(spark):
    """Learnt on one layout, read on layouts with other containers; F1 over blocks."""
    rnd = random.Random(3)
    prose = lambda: (" ".join(rnd.choice(["stone", "river", "quite", "and", "the", "walks", "slowly", "under", "green", "light"]) for _ in range(rnd.randint(20, 60))) + ".").capitalize()

    def page(before, after, item):
        menu = "".join(f'<{item}><a href="/x">{w}</a></{item}>' for w in rnd.sample(["Home", "Products", "Team", "Jobs", "Press", "Login"], 4))
        body = [prose() for _ in range(rnd.randint(2, 6))]
        html = f"<html><head><title>t</title><script>no</script></head><body><div>{menu}</div>{before}" + "".join(f"<p>{b}</p>" for b in body) + f"{after}<div>{menu}<span>Copyright 2020</span></div></body></html>"
        return html, body

    known = [(i, "u", page("<article>", "</article>", "li")[0]) for i in range(120)]
    schema = "page_id long, url string, html string"
    model = html_blocks.fit(spark.createDataFrame(known, schema))
    other = [('<div class="wrap"><div class="text">', "</div></div>", "li"), ("<table><tr><td>", "</td></tr></table>", "li"), ('<div class="k9"><div id="zz">', "</div></div>", "div"), ("<dl><dd>", "</dd></dl>", "li")]
    rows, want = [], {}
    for i in range(80):
        html, want[i] = page(*other[i % 4])
        rows.append((i, "u", html))
    rows += [(100, "u", None), (101, None, ""), (102, "u", "<p>"), (102, "u", "<p>")]
    got = html_blocks.main_texts(spark.createDataFrame(rows, schema), model).collect()
    assert len(got) == 84 and all(r["n_chars"] == len(r["text"]) for r in got) and all(r["text"] == "" for r in got if r["page_id"] >= 100)
    found = [(r["page_id"], b) for r in got for b in r["text"].split("\n") if b]
    true = {(i, b) for i, body in want.items() for b in body}
    hit = sum(x in true for x in found)
    assert 2 * hit / (len(found) + len(true)) > 0.9


def test_ordinal_thresholds_and_tails():
    """Thresholds stay in order, tails fall with the grade, and the likelihood rises."""
    rnd = np.random.default_rng(2)
    grade = rnd.integers(0, 4, 800)
    owner = np.repeat(np.arange(800), 6)
    bucket = np.where(rnd.random(4800) < 0.5, grade[owner], rnd.integers(4, 60, 4800))
    model = ordinal.train(owner, bucket, grade, 4)
    assert (np.diff(model.theta) > 0).all()
    margin = np.bincount(owner, model.weight[bucket], 800) / np.sqrt(6)
    tails = 1 / (1 + np.exp(-(margin[:, None] - model.theta[None])))
    assert (np.diff(tails, axis=1) < 0).all()
    p = -np.diff(np.concatenate((np.ones((800, 1)), tails, np.zeros((800, 1))), 1), axis=1)
    share = np.bincount(grade) / 800
    assert np.log(p[np.arange(800), grade]).mean() > np.log(share[grade]).mean() + 0.3
    assert np.corrcoef(tails.sum(1), grade)[0, 1] > 0.8


def test_packing_deals_repeated_rows(spark):
    P = pytest.importorskip("public_tokenizers")
    rows = spark.createDataFrame([(None, None)] * 400, "doc_id long, text string")
    got = packing.pack_documents(rows, P.path("byte_bpe_50k.json"), group_docs=50).groupBy((packing.F.col("sequence_id") / (1 << 32)).cast("long").alias("g")).count().collect()
    assert sum(r["count"] for r in got) == 400 and len(got) == 8 and max(r["count"] for r in got) <= 100


def test_licences_subsumed_and_named(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    third = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [(1, bsd), (2, bsd + third), (3, bsd + third + "\n\nx.\n\n" + bsd), (4, bsd + third + "\nReleased under the MIT License\n"), (5, "This project is licensed under the MIT License. See it."), (6, "Distributed under the terms of the GNU Lesser General Public License v2.1."), (7, "It is available under the GNU Affero General Public License, version 3"), (8, "We walked under the trees.")]
    got = {r["doc_id"]: r["licences"] for r in licenses.licences(docs(spark, rows)).collect()}
    assert got == {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "BSD-2-Clause,BSD-3-Clause", 4: "BSD-3-Clause,MIT", 5: "MIT", 6: "LGPL-2.1", 7: "AGPL-3.0", 8: ""}


def test_preferences_share_turns(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "bye"), (1, 0, "assistant", "longer"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "r"), (3, 0, "user", "z"), (3, 1, "assistant", "b"), (3, 2, "user", "r"), (3, 3, "assistant", "c"), (8, 0, "user", "none")]
    rows = preferences.formatted(preferences.branched(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    got = {r["pair_id"]: r for r in rows}
    assert sorted(got) == [0, 1, 2, 3, 8] and [got[i]["rejected_id"] for i in (0, 1, 2, 3, 8)] == [1, 0, 3, 2, None]
    # all turns are kept, also those behind the last answer
    assert (got[0]["n_common"], got[0]["prompt"]) == (0, "") and got[0]["chosen_text"].endswith("bye<|end|>\n") and got[0]["rejected_text"] == "<|assistant|>\nlonger<|end|>\n"
    # a branch in the middle
    assert got[2]["n_common"] == 1 and got[2]["prompt"] == "<|user|>\nq<|end|>\n" and got[2]["rejected_text"].startswith("<|assistant|>\nb<|end|>\n<|user|>\nr")
    # without a neighbour the rejected side ends at the branch, without an answer nothing is learnt
    assert got[8]["n_common"] == 0 and got[8]["rejected_text"] == "" and got[8]["chosen_mask"] == []


def test_stages_keep_columns_and_clean_rows(spark):
    """Filtering and cutting operators return the given columns, whatever their names, and
    leave what they do not touch as it is."""
    rows = [(1, "mail a@b.co now", "k", 7), (2, "plain words", None, 99), (3, None, "z", None), (4, "", "z", 0)]
    given = spark.createDataFrame(rows, "doc_id long, text string, __text string, n_chars long").withColumn("__base", pii.F.lit(1))
    got = {r["doc_id"]: r for r in pii.redacted(given, pii.Redactor()).collect()}
    assert got[1]["text"] == "mail [EMAIL] now" and got[1]["n_chars"] == 16 and got[1]["__text"] == "k"
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"], got[3]["n_chars"]) == ("plain words", 99, None, None)
    items = spark.createDataFrame([(1, "mail a b co now")], "item_id long, text string")
    clean = fmindex.decontaminated(given, items)
    assert clean.columns == given.columns
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[1]["text"].strip(" @.") == "" and got[2]["n_chars"] == 99 and got[3]["n_chars"] is None and got[1]["__base"] == 1


def test_packing_worker_is_bounded(monkeypatch):
    import pyarrow as pa
    from pathloom.llm import tokens

    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokens, "REMEMBERED", 200)
    monkeypatch.setattr(tokens, "LEARNT", 16)
    path = P.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "_encoders", {})
    enc, asked = tokens.encoder(path), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, pieces, **options):
            asked.append(list(pieces))
            return self.inner.encode_batch_fast(pieces, **options)

        def encode(self, *given, **options):
            return self.inner.encode(*given, **options)

    enc.tokenizer = Counted(enc.tokenizer)
    texts = [f"common words here q{i}x{i * 7919} z{i * 31}" for i in range(600)]
    for first in range(0, 600, 10):
        part = texts[first : first + 10]
        assert [x.tolist() for x in enc.encode(part)] == [enc.whole(t).tolist() + [0] for t in part]
        assert len(enc.known) <= 200 and len(enc.pool) == enc.size.sum()
    # the tokenizer gets few pre-tokens at a time, and those met again and again but once
    assert max(map(len, asked)) <= 16 and sum(x.count(" common") for x in asked) == 0 and sum(x.count(" words") for x in asked) == 1
    batch = pa.RecordBatch.from_pydict({"pack": list(range(600)), "doc_id": list(range(600)), "text": texts[:599] + [None]})
    out = list(packing.cutter(path, 7, 4)([batch]))
    assert max(b.num_rows for b in out) < 600 * 3 and len(out) == -(-600 // packing.ENCODED_DOCS)
    rows = pa.Table.from_batches(out).to_pylist()
    assert [r["length"] for r in rows if r["doc_id"] == 599] == [1] and {r["doc_id"] for r in rows} == set(range(600))
    for r in rows:
        ids = np.append(enc.whole(texts[r["doc_id"]]) if r["doc_id"] < 599 else np.zeros(0), 0).astype("<u4")
        assert r["doc_tokens"] == len(ids) and r["pack"] == r["doc_id"] % 7
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
