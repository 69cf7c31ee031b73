"""Main text of web pages by a recurrent labeller of leaf blocks.

A page becomes the sequence of its leaf blocks (text between block-level tags).  A
bidirectional LSTM reads, for each block, hashed vectors of its tag path and its words and
a few measures, and labels every block as article or not with the whole page in view.  It
learns from pages whose own semantic tags say where the article is, and from layouts made
of those pages' blocks (sidebars, notices, forms, comments) that such tags do not cover.
Half of the made layouts give their containers names that tell nothing, so that the labeller
has to read lengths, links, words and neighbours.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the labeller learns from at most, about; dealt by a hash of page_id.
TRAIN_PAGES = 240
PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 96, 64, 6, 16

# Fixed sets of HTML: elements that hold no text, text that is none, and block elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea svg iframe".split())
BLOCK = set("address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
ENDS_P = BLOCK - set("button caption legend option tbody td th tr thead tfoot head html body title".split())
OUTSIDE_TAGS = set("nav footer aside form header head title button select".split())
OUTSIDE_NAMES = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|header|footer|cookie\w*|consent|notice|alert|comments?|replies|respond|share|social|related|recommend\w*|newsletter|subscribe|breadcrumbs?|login|search|widget|popup|modal)(?:$|[-_ ])")

# A tag's name, and what follows up to its end; without a way back, so no page takes more
# than a pass or two.  A quote that never closes leaves the plain form.
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_REST = re.compile(r"((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_REST = re.compile(r"([^<>]*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# References by numbers that no character has, and needless zeros.
_NO_CHARACTER = re.compile(r"&#(?=0*+[1-9][0-9]{7})[0-9]++;?")
_ZEROS = re.compile(r"&#0{8,}+")
_DIGIT = re.compile(r"\d")


def _unescaped(text: str) -> str:
    if "&#" in text:
        text = _ZEROS.sub("&#0", _NO_CHARACTER.sub("\ufffd", text))
    return _html.unescape(text)


def markup(page: str):
    """(text before, whether a tag closes, name, attributes) of each tag in order, and the
    text behind the last one with an empty name.  Comments, declarations and instructions
    vanish; a ``<`` that starts nothing of this is text."""
    begin = at = 0
    end_of = {}  # where to look on for marks that end comments and the like

    def find(mark: str, start: int) -> int:
        if end_of.get(mark, 0) >= 0 and end_of.get(mark, 0) < start:
            end_of[mark] = page.find(mark, start)
        return end_of.get(mark, 0)

    while (i := page.find("<", at)) >= 0:
        at = i + 1
        end, closes, name, rest = -1, "", "", ""
        marked = page.startswith(("!", "?"), at)
        if marked and page.startswith("<!--", i):
            end = find("-->", i + 4)
            end = end + 3 if end >= 0 else len(page)
        elif marked and page.startswith("<![CDATA[", i) and (end := find("]]>", i + 9)) >= 0:
            end += 3
        elif marked:
            end = find(">", i + 2)
            end += end >= 0
        elif m := _NAME.match(page, at):
            tail = _REST.match(page, m.end()) or _PLAIN_REST.match(page, m.end())
            if tail:
                end, closes, name, rest = tail.end(), m[1], m[2].lower(), tail[1]
        if end < 0:
            continue
        # text that goes on behind a comment comes in one piece with what follows
        got = yield page[begin:i], bool(closes), name, rest
        begin = at = end
        if got:  # an element whose content is no markup
            close = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
            begin = at = close.end() if close else len(page)
            yield None
    yield page[begin:], False, "", ""


@dataclass(frozen=True, slots=True)
class Path:
    """All open elements of a block, as much of them as is read: it costs the same however
    deep they lie."""

    places: int = 0  # one bit for each place of the path's vector
    inside: int = 0  # what semantic tags say, see taught()

    def under(self, step: str) -> Path:
        """With one more element: its tag, or its tag and names."""
        places, inside = _read(step)
        return Path(self.places | places, self.inside if inside is None else inside)


@dataclass
class Block:
    path: Path
    text: str
    linked: float  # share of its characters inside links


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order: references decoded, white space inside one turned
    into single spaces.  Unclosed and stray tags are borne; comments, scripts and styles
    hold no blocks; null and empty pages have none."""
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    is_open: Counter[str] = Counter()
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        if held:
            text = " ".join(_unescaped("".join([t for t, _ in held])).split())
            if text:
                size = sum(len(t) for t, _ in held)
                out.append(Block(stack[-1][1] if stack else Path(), text, sum(len(t) for t, a in held if a) / size))
            held.clear()

    def cut(i: int) -> None:
        for t, _ in stack[i:]:
            is_open[t] -= 1
        del stack[i:]

    def close(tag: str) -> None:
        if is_open[tag] > 0:
            i = len(stack) - 1
            while stack[i][0] != tag:
                i -= 1
            cut(i)

    tokens = markup(page or "")
    for text, closes, tag, rest in tokens:
        if text:
            held.append((text, is_open["a"] > 0))
        if not tag:
            continue
        if closes:
            if tag in BLOCK:
                flush()
            close(tag)
            continue
        if tag == "br":
            held.append((" ", False))
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P:
                close("p")
            alike = {"dt", "dd"} if tag in ("dt", "dd") else {tag}
            if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and any(is_open[t] > 0 for t in alike):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ("ul", "ol", "table", "dl", "select", "menu"):
                        break
                    if stack[i][0] in alike:
                        cut(i)
                        break
        if tag in VOID or rest.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            tokens.send(True)
            continue
        names = " ".join(" ".join(filter(None, g)) for g in _NAMES.findall(rest)).lower() if rest else ""
        stack.append((tag, (stack[-1][1] if stack else Path()).under(f"{tag} {names}".strip())))
        is_open[tag] += 1
    flush()
    return out


def taught(path: Path) -> int:
    """What semantic tags say of a block: 1 inside an article or main element with nothing
    in between that takes it out, 0 otherwise (pages without any 1 are not learnt from)."""
    return path.inside


@lru_cache(maxsize=1 << 12)
def _read(step: str) -> tuple[int, int | None]:
    """Where an open element shows in the vector (its tag, its names and their parts), and
    whether what it holds is the article's, is not, or is what it was."""
    tag, _, names = step.partition(" ")
    inside = 1 if tag in ("article", "main") else 0 if tag in OUTSIDE_TAGS or names and OUTSIDE_NAMES.search(names) else None
    places = 0
    if tag not in ("html", "body"):
        for name in (tag, *(f".{p}" for n in names.split() for p in {n, *re.split(r"[-_]", n)})):
            places |= 1 << zlib.crc32(name.encode()) % PATH_DIM
    return places, inside


def vectors(page: list[Block]) -> np.ndarray:
    n, k = len(page), PATH_DIM + WORD_DIM
    x = np.zeros((n, k + MEASURES), np.float32)
    if not n:
        return x
    places = b"".join(b.path.places.to_bytes(PATH_DIM // 8, "little") for b in page)
    x[:, :PATH_DIM] = np.unpackbits(np.frombuffer(places, np.uint8), bitorder="little").reshape(n, PATH_DIM)
    words = [b.text.lower().encode().split(b" ") for b in page]  # a block's one white space
    size = np.array([len(w) for w in words])
    place = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.int64, int(size.sum())) % WORD_DIM
    counts = np.bincount(np.repeat(np.arange(n) * WORD_DIM, size) + place, minlength=n * WORD_DIM).reshape(n, WORD_DIM)
    x[:, PATH_DIM:k] = counts / (np.sqrt(np.maximum(size, 1)) * 4)[:, None]
    chars = np.array([len(b.text) for b in page])
    x[:, k] = np.log1p(chars) / 8
    x[:, k + 1] = [b.linked for b in page]
    x[:, k + 2] = [b.text[-1] in ".!?…:\"'»)" for b in page]
    x[:, k + 3] = np.arange(n) / n
    x[:, k + 4] = np.arange(n)[::-1] / n
    x[:, k + 5] = np.array([len(_DIGIT.findall(b.text)) for b in page]) / chars
    return x


class Labeller:
    """A bidirectional LSTM with one logistic output for each block."""

    def __init__(self, dims: int = PATH_DIM + WORD_DIM + MEASURES, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.1, (dims, 4 * hidden))
            self.p["h" + d] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # remember at first
            self.p["c" + d] = bias
        self.p["o"] = rng.normal(0, 0.2, (2 * hidden, 1))
        self.p["ob"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """x: time, page, dims.  Padding leaves the state as it is."""
        n, h = self.hidden, np.zeros((x.shape[1], self.hidden))
        c, kept, out = np.zeros_like(h), [], np.zeros((*x.shape[:2], self.hidden))
        pre = x @ self.p["x" + d] + self.p["c" + d]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + h @ self.p["h" + d]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * n : (k + 1) * n], -30, 30))) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * n :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[t][:, None]
            kept.append((t, i, f, o, g, c, tc, h))
            c, h = np.where(m, c2, c), np.where(m, o * tc, h)
            out[t] = h
        return out, kept

    def forward(self, x: np.ndarray, mask: np.ndarray):
        f, kf = self._run(x, mask, "f")
        b, kb = self._run(x, mask, "b")
        both = np.concatenate((f, b), 2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["ob"], -30, 30)))[..., 0], both, kf, kb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        p, both, kf, kb = self.forward(x, mask)
        slope = np.where(mask, p - y, 0)[..., None] / mask.sum()
        g = {"o": np.tensordot(both, slope, ((0, 1), (0, 1))), "ob": slope.sum((0, 1))}
        back = slope @ self.p["o"].T
        n = self.hidden
        for d, kept, part in (("f", kf, back[..., :n]), ("b", kb, back[..., n:])):
            dz_all = np.zeros((*x.shape[:2], 4 * n))
            dh, dc = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
            gh = np.zeros_like(self.p["h" + d])
            for t, i, f, o, gg, c, tc, h in reversed(kept):
                m = mask[t][:, None]
                dht = dh + part[t]
                do = dht * tc
                dct = dc + dht * o * (1 - tc * tc)
                dz = np.concatenate((dct * gg * i * (1 - i), dct * c * f * (1 - f), do * o * (1 - o), dct * i * (1 - gg * gg)), 1) * m
                dz_all[t] = dz
                gh += h.T @ dz
                dh = np.where(m, dz @ self.p["h" + d].T, dht)
                dc = np.where(m, dct * f, dc)
            g["h" + d] = gh
            g["x" + d] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
            g["c" + d] = dz_all.sum((0, 1))
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 24, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the mean log loss of blocks."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            by_size = sorted(rng.permutation(len(pages)).tolist(), key=lambda i: len(pages[i][0]))
            groups = [by_size[a : a + batch] for a in range(0, len(by_size), batch)]
            for k in rng.permutation(len(groups)):
                x, mask, y = padded([pages[i] for i in groups[k]])
                step += 1
                for name, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)

    def labels(self, pages: list[np.ndarray], most: int = 8_000) -> list[np.ndarray]:
        """For each page a Boolean for each block; pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= most:
                end += 1
            group = order[at:end]
            x, mask, _ = padded([(pages[i], np.zeros(len(pages[i]))) for i in group])
            p = self.forward(x, mask)[0]
            for k, i in enumerate(group):
                out[i] = p[: len(pages[i]), k] >= 0.5
            at = end
        return out


def padded(pages: list[tuple[np.ndarray, np.ndarray]]):
    t = max(len(x) for x, _ in pages)
    x = np.zeros((t, len(pages), pages[0][0].shape[1]))
    mask, y = np.zeros((t, len(pages)), bool), np.zeros((t, len(pages)))
    for k, (a, b) in enumerate(pages):
        x[: len(a), k], mask[: len(a), k], y[: len(a), k] = a, True, b
    return x, mask, y


# Layouts for learning: where articles stand, and what else stands around or inside them.
ARTICLES = ["article", "main", "main|article", "div content", "div post-content", "section entry-content", "div main-content|div article-body", "div story"]
# Articles in containers whose names tell nothing.
PLAIN = ["div", "div|div", "div wrap|div text", "div c1|div c2", "section", "table|tbody|tr|td", "table|tr|td", "div row|div col", "div page|div inner|div", "center", "div box", "td"]
PLAIN_AROUND = ["div|ul|li", "div|div", "div row|div", "table|tr|td", "ul|li", "div|p", "div c3|ul|li", "div left|div", "td|ul|li"]
AROUND = ["nav|ul|li", "header", "header|nav|ul|li", "div header", "div menu|ul|li", "div breadcrumbs", "aside", "aside sidebar|div widget", "div sidebar|ul|li", "div ad", "div ads|p", "div advert", "div sponsored", "div cookie-notice|p", "div cookie-banner", "div notice|p", "div alert", "form", "form|label", "form search", "div login|form", "footer", "footer|p", "div footer|p", "div footer|ul|li", "section comments|div comment|p", "div comments|p", "div id-comments|ol|li", "ul comment-list|li comment|p", "div related|ul|li", "div newsletter|p", "div share", "div social|ul|li", "div popup|p"]
WITHIN = ["aside", "div ad", "div advert|p", "form", "div comments|p", "section comments|div comment|p", "div share", "div related|ul|li", "div newsletter|p", "div notice|p", "nav|ul|li", "footer", "header|p"]


def layouts(good: list[str], bad: list[str], n: int, seed: int = 9) -> list[tuple[list[Block], np.ndarray]]:
    """``n`` made pages of blocks whose texts come from real ones."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    out = []

    # a block's elements, text and share of links
    def other(place: str, root: list[str]) -> list[tuple]:
        path = root + place.split("|")
        # notices, comments and sidebars read like prose, menus and footers do not; where no
        # name tells them from the article, prose is the article's
        prose = not plain and rng.random() < (0.15 if path[-1] == "li" else 0.5)
        return [(tuple(path), pick(good if prose and good else bad), float(path[-1] == "li" and rng.random() < 0.8)) for _ in range(int(rng.integers(1, 5)))]

    for _ in range(n):
        plain = rng.random() < 0.5
        around = PLAIN_AROUND if plain else AROUND
        page: list[tuple] = []
        y: list[int] = []

        def add(found: list[tuple], label: int) -> None:
            page.extend(found)
            y.extend([label] * len(found))

        if rng.random() < 0.7:
            add([(("html", "head", "title"), pick(good), 0.0)], 0)
        for _ in range(int(rng.integers(0, 4))):
            add(other(pick(AROUND if rng.random() < 0.3 else around), ["html", "body"]), 0)
        root = ["html", "body", *pick(PLAIN if plain else ARTICLES).split("|")]
        if rng.random() < 0.7:
            add([((*root, pick(["h1", "h2"])), pick(good)[:60], 0.0)], 1)
        for _ in range(int(rng.integers(1, 8))):
            add([((*root, pick(["p", "p", "p", "p|b", "ul|li", "blockquote|p", "h2", "pre", "div"]).replace("|", "/")), pick(good), 0.0)], 1)
            if rng.random() < 0.12:
                add(other(pick(WITHIN), root), 0)
        for _ in range(int(rng.integers(0, 4))):
            add(other(pick(AROUND if rng.random() < 0.3 else around), ["html", "body"]), 0)
        # any names will do where names tell nothing
        name = {}
        made: list[Block] = []
        for steps, text, linked in page:
            steps = tuple(s for step in steps for s in step.split("/"))
            if plain:
                for step in steps[2:]:
                    word = "".join(map(chr, rng.integers(97, 123, int(rng.integers(1, 7)))))
                    name.setdefault(step, f"{step.split()[0]} {word}" if rng.random() < 0.5 else step)
                steps = steps[:2] + tuple(name[step] for step in steps[2:])
            made.append(Block(reduce(Path.under, steps, Path()), text, linked))
        out.append((made, np.array(y, float)))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Labeller:
    """Learns from at most about ``train_pages`` pages (twice that bound is kept by the
    limit), and four times as many made layouts of their blocks."""
    share = min(1.0, train_pages / max(1, pages.count()))
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.pmod(F.xxhash64("id", F.lit(21)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * train_pages)
    found = [blocks(r["html"]) for r in sorted(rows.collect(), key=lambda r: str(r["id"]))]
    own, good, bad = [], [], ["Home", "About", "Contact", "Log in", "Read more"]
    for page in found:
        y = np.array([taught(b.path) for b in page], float)
        if len(y) and y.any():
            own.append((page, y))
            good += [b.text for b, k in zip(page, y, strict=True) if k]
            bad += [b.text for b, k in zip(page, y, strict=True) if not k]
    model = Labeller()
    made = layouts(good or ["Some text of an article, long enough to read."], bad, 4 * train_pages)
    model.train([(vectors(p), y) for p, y in own + made])
    return model


def main_texts(pages: DataFrame, model: Labeller, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.  Pages without an article,
    null and empty ones have an empty text.  Whole pages are read; rows that repeat an id
    are rows like any other; other columns are not read."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def extract(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                found = [blocks(h if isinstance(h, str) else "") for h in part["html"]]
                keep = shared.value.labels([vectors(p) for p in found])
                text = ["\n".join(b.text for b, k in zip(p, y, strict=True) if k) for p, y in zip(found, keep, strict=True)]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(extract, "page_id bigint, url string, text string, n_chars bigint")
