"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between tags that begin or end a block. Each block becomes a vector of its tag path
(hashed tags, classes and ids, and groups of telling words in them), its shape, and its hashed words. A
bidirectional LSTM, written in numpy, reads the blocks of a page in order, so each decision depends on the whole
document, and labels every block as article or not.

The model is fitted on a bounded sample of pages whose own markup tells the article (``article``, ``main``), and on
variants of them in which containers are renamed and menus, notices, adverts, forms, sidebars and comments are put between and
inside. Fitting takes seconds; labelling runs in Arrow batches, page by page.
"""

from __future__ import annotations

import html as entities
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, lowest, rest
from .minhash import Powers, word_hashes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pages of the sample, their largest size in characters, and variants made of each.
TRAIN_PAGES, TRAIN_CHARS, VARIANTS, EPOCHS = 240, 20_000, 3, 8
HIDDEN, TAG_DIMS, WORD_DIMS = 16, 64, 32

# HTML elements by their part in the text, and telling words of class and id names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "p": ("p",)}
SCOPES = frozenset("ul ol dl table div article section main body td aside footer header nav form".split())
GROUPS = {
    "article": "article main content post entry story body text",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "header": "header masthead topbar top branding logo",
    "footer": "footer foot bottom copyright colophon contentinfo",
    "side": "aside sidebar side related recommended widget widgets more teaser complementary",
    "notice": "cookie cookies consent notice notices gdpr popup modal alert overlay newsletter subscribe paywall",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "form": "form login signin signup register search input button fieldset",
    "social": "share sharing social follow like tweet",
    "comment": "comment comments reply replies respond discussion disqus feedback reviews",
    "heading": "h1 h2 h3 h4 h5 h6",
    "list": "li ul ol dl",
    "table": "table tr td th",
}
_NOISE = ("menu", "header", "footer", "side", "notice", "advert", "form", "social", "comment")
_GROUP_OF = {word: k for k, words in enumerate(GROUPS.values()) for word in words.split()}

_TEXTLESS = "script style noscript template svg iframe textarea select title".split()
_DROP_BEGINS = re.compile(rf"<!--|<((?ai:{'|'.join(_TEXTLESS)}))\b")
_DROP_ENDS = {tag: re.compile(rf"</(?ai:{tag})\s*>") for tag in _TEXTLESS}
_BEGINS = re.compile(r"<[a-zA-Z/!?]")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

EXTRA = 7
#: Bits of a path: hashed tags and names, groups, and whether it leads through an element for the article.
WIDE = TAG_DIMS + len(GROUPS)
_INSIDE = 1 << WIDE
_NOISE_BITS = sum(1 << (TAG_DIMS + k) for k, name in enumerate(GROUPS) if name in _NOISE)
DIMS = WIDE + EXTRA + WORD_DIMS


# ---- blocks --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Path:
    """The elements around a block, inline ones left out: how many, and the bits of their names."""

    bits: int = 0
    depth: int = 0

    def open(self, tag: str, names: tuple[str, ...] = ()) -> Path:
        bits = self.bits | (_INSIDE if tag in ("article", "main") else 0)
        for token in (tag, *(f"{tag}.{n}" for n in names)):
            bits |= 1 << (zlib.crc32(token.encode("utf-8", "surrogatepass")) % TAG_DIMS)
        for word in (tag, *names):
            if word in _GROUP_OF:
                bits |= 1 << (TAG_DIMS + _GROUP_OF[word])
        return Path(bits, self.depth + 1)


def without_textless(html: str) -> str:
    """The page without comments, scripts, styles and the like; one that does not end reaches to the end of the page.

    Every search goes on behind the last or is the last of its kind, so the work grows with the length of the page.
    """
    kept: list[str] = []
    done = 0
    tags_end = html.rfind(">")
    for begin in _DROP_BEGINS.finditer(html):
        if begin.start() < done:
            continue
        if begin.group(1) is None:
            end = html.find("-->", begin.end())
            end = end + 3 if end >= 0 else len(html)
        elif begin.end() > tags_end:
            continue  # an unfinished tag
        else:
            found = _DROP_ENDS[begin.group(1).lower()].search(html, html.index(">", begin.end()) + 1)
            end = found.end() if found else len(html)
        kept.append(html[done : begin.start()])
        done = end
    kept.append(html[done:])
    return "".join(kept)


def blocks_of(html: str | None) -> list[tuple[str, Path, float]]:
    """(text, path, share of linked characters) of the leaf blocks in page order.

    Comments, scripts, styles and the like are no text, an unfinished tag at the end is none either. Character references
    are decoded, white space becomes one space. Elements that their siblings or parents end are ended as browsers do. The work
    grows with the length of the page, however deep its elements are nested.
    """
    if not html:
        return []
    html = without_textless(html)
    unfinished = _BEGINS.search(html, html.rfind(">") + 1)
    if unfinished:
        html = html[: unfinished.start()]
    out: list[tuple[str, Path, float]] = []
    stack: list[tuple[str, Path, bool]] = []  # open elements: tag, path up to here, inside a link
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is
    parts: list[str] = []
    linked = 0
    path, in_link = Path(), False

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((text, path, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def close(names: tuple[str, ...], scopes: frozenset[str]) -> None:
        nonlocal path, in_link
        at = max((places[n][-1] for n in names if places[n]), default=-1)
        if at < 0 or any(places[s] and places[s][-1] > at for s in scopes):
            return
        while len(stack) > at:
            places[stack.pop()[0]].pop()
        path, in_link = stack[-1][1:] if stack else (Path(), False)

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            flush()
        if m[1]:
            close((tag,), frozenset() if tag not in INLINE else SCOPES)
            continue
        if tag in CLOSES_P:
            close(("p",), SCOPES)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPES - set(SIBLINGS[tag]))
        if tag not in VOID and not m[3].endswith("/"):
            if tag not in INLINE:
                names = " ".join(a or b or c or "" for a, b, c in _NAMES.findall(m[3])) if "=" in m[3] else ""
                path = path.open(tag, tuple(w.lower() for w in _WORDS.findall(names)))
            in_link = in_link or tag == "a"
            places[tag].append(len(stack))
            stack.append((tag, path, in_link))
    parts.append(html[at:])
    flush()
    return out


def _path_vector(path: Path) -> np.ndarray:
    out = np.array([path.bits >> k & 1 for k in range(WIDE)], np.float32)
    out[:TAG_DIMS] *= 0.5
    return out


class Vectors:
    """Makes the vectors of the blocks of a page; those of paths are remembered, in bounded number."""

    def __init__(self, limit: int = 20_000):
        self.powers, self.paths, self.limit = Powers(), {}, limit

    def path(self, path: Path) -> np.ndarray:
        out = self.paths.get(path.bits)
        if out is None:
            if len(self.paths) >= self.limit:
                self.paths.clear()
            out = self.paths[path.bits] = _path_vector(path)
        return out

    def __call__(self, blocks: list[tuple[str, Path, float]]) -> np.ndarray:
        n = len(blocks)
        out = np.zeros((n, DIMS), np.float32)
        for k, (text, path, linked) in enumerate(blocks):
            out[k, :WIDE] = self.path(path)
            out[k, WIDE : WIDE + EXTRA] = (
                np.log1p(len(text)) / 8, linked, text[-1] in ".!?…»”\"", (k + 1) / n, k == 0, k == n - 1, path.depth / 8)
        texts = [t.encode("utf-8", "surrogatepass").lower() for t, _, _ in blocks]
        hashes = word_hashes(b" ".join(texts), self.powers) % np.uint64(WORD_DIMS)
        owner = np.repeat(np.arange(n), [len(t.split()) for t in texts])
        counts = np.bincount(owner * WORD_DIMS + hashes.astype(np.int64), minlength=n * WORD_DIMS).reshape(n, WORD_DIMS)
        norm = np.sqrt((counts**2).sum(1, keepdims=True))
        out[:, WIDE + EXTRA :] = counts / np.maximum(norm, 1)
        return out


# ---- the network ---------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BlockLabeller:
    """Weights of a bidirectional LSTM with one logistic output a block."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 5, hidden: int = HIDDEN) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        w = {"out": rng.normal(0, 0.3, 2 * hidden), "bias": np.zeros(1)}
        for d in ("f", "b"):
            w[f"x{d}"] = rng.normal(0, 0.15, (DIMS, 4 * hidden))
            w[f"h{d}"] = rng.normal(0, 0.15, (hidden, 4 * hidden))
            w[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])  # input, forget, output, cell
        return BlockLabeller({k: v.astype(np.float32) for k, v in w.items()})

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, fitting: bool = False) -> tuple[np.ndarray, list]:
        """States of one direction over (pages, blocks, dims); padding carries the state on. Steps are remembered for fitting only."""
        w, (n, t, _) = self.weights, x.shape
        size = len(w[f"h{d}"])
        gates = x.reshape(n * t, -1) @ w[f"x{d}"] + w[f"c{d}"]
        gates = gates.reshape(n, t, -1)
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        states, memory = np.zeros((n, t, size), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = gates[:, k] + h @ w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, j * size : (j + 1) * size]) for j in range(3))
            g = np.tanh(z[:, 3 * size :])
            cell = f * c + i * g
            squashed = np.tanh(cell)
            m = mask[:, k, None]
            if fitting:
                memory.append((k, h, c, i, f, o, g, squashed, m))
            c, h = m * cell + (1 - m) * c, m * o * squashed + (1 - m) * h
            states[:, k] = h
        return states, memory

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._pass(x, mask, d)[0] for d in "fb"], 2)
        return _sigmoid(states @ self.weights["out"] + self.weights["bias"])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        runs = {d: self._pass(x, mask, d, fitting=True) for d in "fb"}
        states = np.concatenate([runs[d][0] for d in "fb"], 2)
        error = (_sigmoid(states @ w["out"] + w["bias"]) - y) * mask / mask.sum()
        grad = {"out": np.einsum("nt,nth->h", error, states), "bias": error.sum(keepdims=True).reshape(1)}
        n, t, dims = x.shape
        for at, d in enumerate("fb"):
            size = len(w[f"h{d}"])
            dh_out = error[:, :, None] * w["out"][at * size : (at + 1) * size]
            dz_all = np.zeros((n, t, 4 * size), np.float32)
            dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
            gh = np.zeros_like(w[f"h{d}"])
            for k, h, c, i, f, o, g, squashed, m in reversed(runs[d][1]):
                dh = dh + dh_out[:, k]
                own, pass_on = dh * m, dh * (1 - m)
                cell = dc * m + own * o * (1 - squashed**2)
                dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), own * squashed * o * (1 - o), cell * i * (1 - g**2)], 1)
                dz_all[:, k] = dz
                gh += h.T @ dz
                dh, dc = pass_on + dz @ w[f"h{d}"].T, dc * (1 - m) + cell * f
            flat = dz_all.reshape(n * t, -1)
            grad |= {f"x{d}": x.reshape(n * t, dims).T @ flat, f"h{d}": gh, f"c{d}": flat.sum(0)}
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 5) -> None:
        """Adam on the cross entropy."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.weights.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = sorted(rng.permutation(len(pages)).tolist(), key=lambda k: len(pages[k][0]) // 16)
            chunks = [order[a : a + batch] for a in range(0, len(order), batch)]
            for c in rng.permutation(len(chunks)):
                x, mask = _padded([pages[k][0] for k in chunks[c]])
                y = np.zeros(mask.shape, np.float32)
                for row, k in enumerate(chunks[c]):
                    y[row, : len(pages[k][1])] = pages[k][1]
                step += 1
                for name, g in self.gradient(x, mask, y).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    move = rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
                    self.weights[name] = (self.weights[name] - move).astype(np.float32)

    def label(self, pages: list[np.ndarray], most: int = 4096) -> list[np.ndarray]:
        """Probabilities for the blocks of each page; pages of similar length go through the network together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            take = max(1, min(64, most // len(pages[order[-1]])))
            chunk, order = order[-take:], order[:-take]
            p = self.probabilities(*_padded([pages[k] for k in chunk]))
            for row, k in enumerate(chunk):
                out[k] = p[row, : len(pages[k])]
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), t, DIMS), np.float32), np.zeros((len(pages), t), np.float32)
    for k, p in enumerate(pages):
        x[k, : len(p)], mask[k, : len(p)] = p, 1
    return x, mask


# ---- fitting -------------------------------------------------------------------------------------------------

# Containers that variants of pages are built with.
ARTICLES = [("article", ()), ("main", ()), ("div", ("content",)), ("div", ("article", "body")), ("div", ("post", "content")),
            ("section", ("entry",)), ("div", ("main",)), ("div", ("story", "text")), ("section", ("post",))]
NOISE = [("nav", ()), ("div", ("menu",)), ("ul", ("navbar",)), ("div", ("breadcrumbs",)), ("header", ()), ("div", ("header",)),
         ("div", ("masthead",)), ("footer", ()), ("div", ("footer",)), ("div", ("copyright",)), ("aside", ()), ("div", ("sidebar",)),
         ("div", ("related",)), ("div", ("widget",)), ("div", ("cookie", "notice")), ("div", ("consent",)), ("div", ("newsletter",)),
         ("div", ("alert",)), ("div", ("notice",)), ("div", ("ad",)), ("div", ("ads",)), ("div", ("advert",)), ("div", ("sponsored",)),
         ("div", ("promo", "banner")), ("form", ()), ("form", ("search",)), ("div", ("login",)), ("div", ("share",)),
         ("section", ("comments",)), ("div", ("comment",)), ("ol", ("comment", "list")), ("div", ("comments", "area"))]
LEAVES = [("p", ()), ("p", ()), ("p", ()), ("li", ()), ("h2", ()), ("h3", ()), ("blockquote", ()), ("div", ())]
BODY = Path().open("html").open("body")


def own_label(path: Path) -> bool:
    """What the markup itself says: inside an article and inside nothing else that is named."""
    return bool(path.bits & _INSIDE) and not path.bits & _NOISE_BITS


def _variant(texts: list[str], rng: np.random.Generator) -> tuple[list[tuple[str, Path, float]], list[float]]:
    """A page of given texts: an article, and boilerplate around and inside it."""
    def some(k: int) -> list[str]:
        return [texts[j] for j in rng.integers(0, len(texts), k)]

    def noise(inside: Path) -> None:
        box = NOISE[rng.integers(len(NOISE))]
        links = float(rng.random() < 0.4)
        for text in some(int(rng.integers(1, 6))):
            if links or rng.random() < 0.4:
                text = " ".join(text.split()[: int(rng.integers(1, 12))])
            leaf = LEAVES[rng.integers(len(LEAVES))]
            within = inside.open(*box)
            blocks.append((text, within.open(*leaf) if rng.random() < 0.8 else within, links))
            labels.append(0.0)

    blocks: list[tuple[str, Path, float]] = []
    labels: list[float] = []
    outer = BODY.open("div", ("wrapper",)) if rng.random() < 0.3 else BODY
    box = outer.open(*ARTICLES[rng.integers(len(ARTICLES))])
    for _ in range(int(rng.integers(0, 4))):
        noise(outer)
    if rng.random() < 0.8:
        blocks.append((some(1)[0][:80].strip() or "x", box.open("h1"), 0.0))
        labels.append(1.0)
    for text in some(int(rng.integers(1, 14))):
        if rng.random() < 0.1:
            noise(box)
        blocks.append((text, box.open(*LEAVES[rng.integers(len(LEAVES))]), 0.0))
        labels.append(1.0)
    for _ in range(int(rng.integers(0, 4))):
        noise(outer if rng.random() < 0.8 else box)
    return blocks, labels


def fit_labeller(pages: list[str], variants: int = VARIANTS, seed: int = 5) -> BlockLabeller:
    """The labeller fitted on pages that name their article, and on variants with the same texts."""
    rng, vectors = np.random.default_rng(seed), Vectors()
    samples, texts = [], []
    for page in pages:
        blocks = blocks_of(page)
        labels = [float(own_label(path)) for _, path, _ in blocks]
        texts += [t for t, _, _ in blocks]
        if any(labels):
            samples.append((vectors(blocks), np.array(labels, np.float32)))
    texts = texts or ["a few words", "This is a sentence of a page.", "Another one follows it, and is longer than the first."]
    for _ in range(variants * max(len(pages), 40)):
        blocks, labels = _variant(texts, rng)
        samples.append((vectors(blocks), np.array(labels, np.float32)))
    model = BlockLabeller.fresh(seed)
    model.fit(samples)
    return model


def learn(pages: DataFrame, page_id: str = "page_id", html: str = "html", n: int = TRAIN_PAGES, chars: int = TRAIN_CHARS) -> BlockLabeller:
    """Fits on at most ``n`` pages of at most ``chars`` characters, chosen by a hash."""
    fitting = (
        pages.select(col(page_id).cast("string").alias("id"), col(html).alias("html")).where(F.length("html") <= chars)
        .select("html", F.xxhash64("id", "html").alias("hash"))
    )
    sample = lowest(fitting, F.col("hash"), fitting.count(), n).orderBy("hash", "html").limit(n).collect()
    return fit_labeller([r["html"] for r in sample])


# ---- the operator --------------------------------------------------------------------------------------------


def extract_text(pages: list[str | None], model: BlockLabeller, vectors: Vectors, threshold: float = 0.5) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    found = model.label([vectors(b) if b else np.zeros((0, DIMS), np.float32) for b in blocks])
    return ["\n".join(t for (t, _, _), p in zip(b, ps) if p >= threshold) for b, ps in zip(blocks, found)]


def extractor(model: BlockLabeller):
    """A UDF from html to main text."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = Vectors()
        for batch in batches:
            out: list[str] = []
            for lo in range(0, len(batch), 256):
                out += extract_text(batch.slice(lo, 256).to_pylist(), model, vectors)
            yield pa.array(out, pa.string())

    return extract


def extract_main_text(pages: DataFrame, model: BlockLabeller, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Every page with its main ``text`` and ``n_chars``, its code points.

    Blocks come in page order, one a line; white space inside a block is one space, character references are decoded. A null or empty page
    has an empty text, as has one without article. Pages are labelled one by one, so repeated rows agree and an empty table
    gives an empty result. The other columns of ``pages`` follow, but for those that clash.
    """
    extra = rest(pages, [page_id, "text", "n_chars"])
    done = pages.select(
        col(page_id).alias("_page"), extractor(model)(col(html)).alias("_text"), *(col(c).alias(f"_x{i}") for i, c in enumerate(extra)))
    return done.select(
        F.col("_page").alias(page_id), F.col("_text").alias("text"), F.length("_text").cast("bigint").alias("n_chars"),
        *(F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)))
