"""Main-text extraction with a recurrent block labeller.

A numpy bidirectional LSTM reads a page's leaf blocks in order. A block's vector holds the mean
of its tag-path embeddings (tags, class and id words, hashed), the mean of its hashed-word
embeddings and a few numbers (length, link share, place, punctuation). Each block is classified from
both hidden states, its own vector and the mean hidden state of the page.

There are no labelled pages, so training pages label themselves: blocks under containers whose
names say what they are (``nav``, ``footer``, ``class="comment"`` ...) are known, and pages get
such containers added around text of other pages, in place of
their own or next to them. The sample is bounded by ``SAMPLE`` pages and ``SAMPLE_CHARS`` characters in all, whatever the
length of a single page; a page's first ``TRAIN_BLOCKS`` blocks take part in training. Every page is labelled whole.

Memory follows the page at hand: pages are labelled in batches of at most ``CELLS`` padded blocks (a longer page alone),
no states are kept, and paths are sums along shared nodes.

Defined cases: a null or empty page has the empty text; pages of any length or depth are taken whole; a probability of exactly
one half counts as text; repeated rows repeat; an empty
table gives no rows; without training pages every block counts as text; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .html_blocks import Block, Path, blocks_of

SAMPLE = 200  # pages the labeller is trained on, at most
SAMPLE_CHARS = 8_000_000  # their characters in all, at most
TRAIN_BLOCKS = 2_000  # blocks of a page in training, at most
PATH_BUCKETS, WORD_BUCKETS = 4096, 2048
PATH_DIM, WORD_DIM, NUMBERS, HIDDEN = 16, 8, 7, 16
PAGES = 64  # pages labelled at once
CELLS = 16_384  # padded blocks labelled at once
BOILER_TAGS = ["nav", "footer", "aside", "form", "header", "menu", "dialog"]
BOILER_NAMES = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "menu", "navbar", "navigation",
                "breadcrumb", "sidebar", "widget", "footer", "header", "cookie", "consent", "notice", "gdpr", "popup",
                "modal", "newsletter", "subscribe", "signup", "login", "search", "comment", "comments", "reply", "replies",
                "respond", "share", "social", "related", "recommended", "copyright", "disclaimer", "alert", "toolbar"]
MAIN_TAGS = ["article", "main"]
MAIN_NAMES = ["content", "post", "entry", "article", "story", "main", "body", "text"]


def _bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % n


def known_labels(blocks: list[Block]) -> np.ndarray:
    """Per block 1 text, 0 boilerplate, NaN where the names say nothing."""
    told: dict = {None: (False, False)}

    def says(node: Path) -> tuple[bool, bool]:
        chain = []
        while node is not None and id(node) not in told:
            chain.append(node)
            node = node.parent
        out = told[None if node is None else id(node)]
        for x in reversed(chain):
            boiler = any(n in BOILER_TAGS or n.partition("=")[2] in BOILER_NAMES for n in x.names)
            inside = any(n in MAIN_TAGS or n.partition("=")[2] in MAIN_NAMES for n in x.names)
            out = told[id(x)] = (out[0] or boiler, out[1] or inside)
        return out

    marks = [says(b.node) for b in blocks]
    return np.array([0.0 if boiler else 1.0 if inside else np.nan for boiler, inside in marks])


def known_label(block: Block) -> float | None:
    """1 text, 0 boilerplate, None where the names say nothing."""
    label = known_labels([block])[0]
    return None if np.isnan(label) else float(label)


class Page:
    """Nodes, bags of hashed ids and numbers of a page's blocks.

    Nodes come parents first: ``parent`` (-1: none), ``level``, ``own`` ids; a block has its node, ``count`` names on its path
    (the last two again: the block's own tag matters most) and those ``last`` ids.
    """

    def __init__(self, blocks: list[Block], cache: dict):
        self.n = len(blocks)
        index: dict = {}
        self.parent, self.level, self.own = [], [], []
        totals, tails = [], []
        self.node, self.last, self.words, numbers, counts = [], [], [], [], []
        total = sum(len(b.text) for b in blocks) or 1
        seen = 0
        for i, b in enumerate(blocks):
            chain, node = [], b.node
            while node is not None and id(node) not in index:
                chain.append(node)
                node = node.parent
            up = -1 if node is None else index[id(node)]
            for x in reversed(chain):
                index[id(x)] = len(self.parent)
                self.own.append([hash_name(n, cache) for n in x.names])
                totals.append(len(x.names) + (totals[up] if up >= 0 else 0))
                tails.append(((*tails[up], *x.names) if up >= 0 and len(x.names) < 2 else x.names)[-2:])
                self.level.append(self.level[up] + 1 if up >= 0 else 0)
                self.parent.append(up)
                up = len(self.parent) - 1
            self.node.append(up)
            self.last.append([hash_name("last " + n, cache) for n in tails[up]] if up >= 0 else [0])
            depth = totals[up] if up >= 0 else 0
            counts.append(depth + len(self.last[-1]))
            w = b.text.lower().split()
            self.words.append(np.fromiter((hash_word(x, cache) for x in w), np.int64, len(w)))
            n = len(b.text)
            numbers.append((np.log1p(n) / 6, min(1.0, b.linked / n), i / self.n, seen / total,
                            sum(b.text.count(c) for c in ".,;:!?") / n * 10, min(depth, 100) / 10, n / total))
            seen += n
        self.numbers = np.array(numbers, np.float32).reshape(self.n, NUMBERS)
        self.count = np.array(counts, np.float32)


class Paths:
    """Path embeddings of some pages' blocks: the mean over the names, as sums from the roots down."""

    def __init__(self, pages: list[Page]):
        base = np.cumsum([0] + [len(p.parent) for p in pages])
        up = np.concatenate([np.array(p.parent, np.int64) + np.where(np.array(p.parent, np.int64) >= 0, b, 0) for p, b in zip(pages, base)])
        self.parent = np.where(up < 0, len(up), up)  # the row behind the last node is zero
        self.levels = np.array([x for p in pages for x in p.level], np.int64)
        own = [ids for p in pages for ids in p.own]
        self.sizes = np.array([len(x) for x in own], np.int64)
        self.ids = np.array([i for x in own for i in x], np.int64)
        node = np.concatenate([np.array(p.node, np.int64) + np.where(np.array(p.node, np.int64) >= 0, b, 0) for p, b in zip(pages, base)])
        self.node = np.where(node < 0, len(up), node)
        last = [x for p in pages for x in p.last]
        self.last_sizes = np.array([len(x) for x in last], np.int64)
        self.last = np.array([i for x in last for i in x], np.int64)
        self.count = np.concatenate([p.count for p in pages])[:, None]
        order = np.argsort(self.levels, kind="stable")
        cuts = np.flatnonzero(np.diff(self.levels[order])) + 1
        self.by_level = np.split(order, cuts) if len(order) else []

    def vectors(self, table: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(self.sizes) + 1, table.shape[1]), np.float32)
        if len(self.sizes):
            sums[:-1] = np.add.reduceat(table[self.ids], np.r_[0, np.cumsum(self.sizes)[:-1]], axis=0)
        for rows in self.by_level[1:]:
            sums[rows] += sums[self.parent[rows]]
        last = np.add.reduceat(table[self.last], np.r_[0, np.cumsum(self.last_sizes)[:-1]], axis=0)
        return (sums[self.node] + last) / self.count

    def gradient(self, table: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Gradient of the table from that of the vectors."""
        part = part / self.count
        sums = np.zeros((len(self.sizes) + 1, table.shape[1]))
        np.add.at(sums, self.node, part)
        for rows in reversed(self.by_level[1:]):
            np.add.at(sums, self.parent[rows], sums[rows])
        out = np.zeros_like(table)
        np.add.at(out, self.ids, np.repeat(sums[:-1], self.sizes, axis=0))
        np.add.at(out, self.last, np.repeat(part, self.last_sizes, axis=0))
        return out


def hash_name(name: str, cache: dict) -> int:
    key = ("path", name)
    h = cache.get(key)
    if h is None:
        h = cache[key] = _bucket(name, PATH_BUCKETS)
    return h


def hash_word(word: str, cache: dict) -> int:
    h = cache.get(word)
    if h is None:
        if len(cache) > 300_000:
            cache.clear()
        h = cache[word] = _bucket(word, WORD_BUCKETS)
    return h


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, two LSTM directions and a logistic output over blocks."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d = PATH_DIM + WORD_DIM + NUMBERS
        n = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        self.w = {"path": n(PATH_BUCKETS, PATH_DIM), "word": n(WORD_BUCKETS, WORD_DIM) * 0.3,
                  "out": n(4 * HIDDEN + d), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.w |= {f"x{side}": n(d, 4 * HIDDEN), f"h{side}": n(HIDDEN, 4 * HIDDEN),
                       f"b{side}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)}

    @staticmethod
    def _bags(table, bags):
        sizes = np.array([len(b) for b in bags])
        at = np.r_[0, np.cumsum(sizes)[:-1]]
        ids = np.concatenate(bags)
        return np.add.reduceat(table[ids], at, axis=0) / sizes[:, None], ids, sizes

    def inputs(self, pages: list[Page]):
        """(x [pages, blocks, d], mask, what the embedding gradients need)."""
        longest = max(p.n for p in pages)
        own = np.concatenate([np.arange(p.n) + i * longest for i, p in enumerate(pages)])
        paths = Paths(pages)
        pe = paths.vectors(self.w["path"])
        we, wid, wsz = self._bags(self.w["word"], [b for p in pages for b in p.words])
        x = np.zeros((len(pages) * longest, PATH_DIM + WORD_DIM + NUMBERS), np.float32)
        x[own] = np.hstack([pe, we, np.concatenate([p.numbers for p in pages])])
        mask = np.zeros(len(pages) * longest, np.float32)
        mask[own] = 1
        shape = (len(pages), longest)
        return x.reshape(*shape, -1), mask.reshape(shape), (own, paths, wid, wsz)

    def _lstm(self, x, mask, side, keep: bool):
        order = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
        h = c = np.zeros((len(x), HIDDEN), np.float32)
        states, xs = [], x @ self.w[f"x{side}"] + self.w[f"b{side}"]
        out = np.zeros((*mask.shape, HIDDEN), np.float32)
        for t in order:
            z = xs[:, t] + h @ self.w[f"h{side}"]
            i, f, o = np.split(_sigmoid(z[:, :3 * HIDDEN]), 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN:])
            m = mask[:, t, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:  # only training goes back through the states
                states.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * o * tc + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return out, states

    def forward(self, x, mask, keep: bool = False):
        hf, sf = self._lstm(x, mask, "f", keep)
        hb, sb = self._lstm(x, mask, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        size = np.maximum(mask.sum(1), 1)[:, None]
        mean = (h * mask[:, :, None]).sum(1) / size
        full = np.concatenate([h, np.broadcast_to(mean[:, None], h.shape), x], axis=2)
        return _sigmoid(full @ self.w["out"] + self.w["bias"]), (full, size, sf, sb)

    def gradients(self, pages, y, known):
        x, mask, (own, paths, wid, wsz) = self.inputs(pages)
        p, (full, size, sf, sb) = self.forward(x, mask, keep=True)
        g = dict.fromkeys(self.w)
        d = (p - y) * known / max(1.0, known.sum())
        g["out"], g["bias"] = np.einsum("bt,btk->k", d, full), np.array([d.sum()])
        df = d[:, :, None] * self.w["out"]
        k = 2 * HIDDEN
        dh = df[:, :, :k] + mask[:, :, None] * (df[:, :, k:2 * k].sum(1) / size)[:, None]
        dx = df[:, :, 2 * k:].copy()
        for side, states, part in (("f", sf, dh[:, :, :HIDDEN]), ("b", sb, dh[:, :, HIDDEN:])):
            wx, wh = self.w[f"x{side}"], self.w[f"h{side}"]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * HIDDEN)
            nh = nc = np.zeros((len(x), HIDDEN))
            for t, h, c, i, f, o, q, tc, m in reversed(states):
                a = part[:, t] + nh
                am = a * m
                dc = nc * m + am * o * (1 - tc ** 2)
                dz = np.hstack([dc * q * i * (1 - i), dc * c * f * (1 - f), am * tc * o * (1 - o), dc * i * (1 - q ** 2)])
                gx += x[:, t].T @ dz
                gh += h.T @ dz
                gb += dz.sum(0)
                dx[:, t] += dz @ wx.T
                nh = a * (1 - m) + dz @ wh.T
                nc = dc * f + nc * (1 - m)
            g[f"x{side}"], g[f"h{side}"], g[f"b{side}"] = gx, gh, gb
        flat = dx.reshape(-1, dx.shape[2])[own]
        g["path"] = paths.gradient(self.w["path"], flat[:, :PATH_DIM])
        g["word"] = np.zeros_like(self.w["word"])
        part = flat[:, PATH_DIM:PATH_DIM + WORD_DIM]
        np.add.at(g["word"], wid, np.repeat(part / wsz[:, None], wsz, axis=0))
        loss = -(known * np.log(np.where(y > 0.5, p, 1 - p) + 1e-7)).sum() / max(1.0, known.sum())
        return float(loss), g

    def train(self, pages: list[Page], labels: list[np.ndarray], epochs: int = 16, batch: int = 32, rate: float = 0.01, seed: int = 3):
        """Adam over the known blocks; NaN labels are context only."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros(v.shape) for k, v in self.w.items()}
        s = {k: np.zeros(v.shape) for k, v in self.w.items()}
        step, loss = 0, 0.0
        for _ in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                longest = max(pages[i].n for i in some)
                y = np.full((len(some), longest), np.nan)
                for j, i in enumerate(some):
                    y[j, :pages[i].n] = labels[i]
                known = ~np.isnan(y)
                loss, g = self.gradients([pages[i] for i in some], np.nan_to_num(y), known.astype(float))
                step += 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return loss

    def label(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of text for every block, pages of like length together."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p.n), key=lambda i: pages[i].n)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < PAGES and (end - at + 1) * pages[order[end]].n <= CELLS:
                end += 1
            some, at = order[at:end], end
            x, mask, _ = self.inputs([pages[i] for i in some])
            p, _ = self.forward(x, mask)
            for j, i in enumerate(some):
                out[i] = p[j, :pages[i].n]
        return out


_MAIN = re.compile(r"<(/?)article\b[^>]*>", re.I)


def varied(page: str, others: list[str], r: np.random.Generator) -> str:
    """The page with its main container renamed, lists, tables and the like added inside it, and
    known boilerplate containers added inside and outside."""
    main = str(r.choice(["article", "main", 'div class="post content"', 'div id="content"', 'section class="entry body"']))
    page = _MAIN.sub(lambda m: f"</{main.split()[0]}>" if m[1] else f"<{main}>", page)
    end = f"</{main.split()[0]}>"

    def extra():
        words = others[int(r.integers(0, len(others)))].split() or ["more"]
        n = int(r.choice([2, 5, 12, 30, 60]))
        start = int(r.integers(0, max(1, len(words) - n)))
        text = " ".join(words[start:start + n])
        if r.random() < 0.35:
            box = str(r.choice(BOILER_TAGS))
            head = f"<{box}>"
        else:
            box = str(r.choice(["div", "section", "ul", "p"]))
            head = f'<{box} {r.choice(["class", "id"])}="{r.choice(BOILER_NAMES)}">'
        inner = {0: text, 1: f"<p>{text}</p>", 2: f'<a href="/x">{text}</a>', 3: f"<h3>{text[:20]}</h3><p>{text}</p>",
                 4: f"<div>{text}</div><div>{text[::-1]}</div>"}[0 if box == "p" else int(r.integers(0, 5))]
        return f"{head}{inner}</{box}>"
    def inside():
        words = others[int(r.integers(0, len(others)))].split() or ["more"]
        n = int(r.choice([1, 3, 8, 25]))
        text = " ".join(words[:n])
        form = ["<ul><li>{0}</li><li>{1}</li></ul>", "<ol><li>{0}<li>{1}</ol>", "<h2>{0}</h2>", "<blockquote><p>{0}</p></blockquote>",
                "<table><tr><td>{0}</td><td>{1}</td></tr></table>", "<pre>{0}</pre>", "<p>{0}</p>", "<div>{0}</div>",
                "<figure><figcaption>{0}</figcaption></figure>", "<p>See <a href='/y'>{0}</a></p>", "<section><h3>{0}</h3><p>{1}</p></section>"]
        return str(r.choice(form)).format(text, " ".join(words[n:2 * n]) or text)
    for _ in range(int(r.integers(0, 4))):
        if end in page:
            head, tail = page.rsplit(end, 1)
            if r.random() < 0.5 and "</p>" in head:
                first, rest = head.rsplit("</p>", 1) if r.random() < 0.5 else head.split("</p>", 1)
                head = f"{first}</p>{inside()}{rest}"
            else:
                head += inside()
            page = head + end + tail
    for _ in range(int(r.integers(1, 6))):
        place = int(r.integers(0, 3))
        if place == 0 and "<body>" in page:
            page = page.replace("<body>", "<body>" + extra(), 1)
        elif end in page:
            head, tail = page.rsplit(end, 1)
            page = head + extra() + end + tail if place == 1 else head + end + extra() + tail
    return page


def sample_pages(pages: DataFrame, sample: int, chars: int) -> list[str]:
    """At most ``sample`` different pages of at most ``chars`` characters in all: those of low hashes that fit.

    Where no page fits, the first ``chars`` characters of the shortest of those looked at.
    """
    src = pages.select(F.col("html").cast("string").alias("html")).where("html <> ''").withColumn("key", F.xxhash64("html"))
    some = hashed_sample(src.select("key", F.length("html").alias("n")), F.col("key"), 4 * sample).collect()
    left, keys = chars, set()
    for key, n in sorted({(r["key"], r["n"]) for r in some}):
        if n <= left and len(keys) < sample:
            keys.add(key)
            left -= n
    if some and not keys:
        keys = {min(some, key=lambda r: (r["n"], r["key"]))["key"]}
    if not keys:
        return []
    rows = src.where(F.col("key").isin(sorted(keys))).select(F.substring("html", 1, chars).alias("html")).distinct().collect()
    return sorted(r["html"] for r in rows)


def train_labeller(pages: DataFrame, sample: int = SAMPLE, seed: int = 11, chars: int = SAMPLE_CHARS) -> Labeller | None:
    """Fit on a bounded sample of pages (``sample_pages``), each also varied."""
    rows = sample_pages(pages, sample, chars)
    if not rows:
        return None
    r, cache = np.random.default_rng(seed), {}
    texts = [b.text for row in rows for b in blocks_of(row)] or ["more"]
    made = rows + [varied(row, texts, r) for row in rows for _ in range(3)]
    parsed = [b for b in (blocks_of(h)[:TRAIN_BLOCKS] for h in made) if b]
    labels = [known_labels(blocks) for blocks in parsed]
    model = Labeller()
    model.train([Page(b, cache) for b in parsed], labels)
    return model


def _extract_task(model):
    def run(batches):
        cache: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                parsed = [blocks_of(h) for h in part.column(2).to_pylist()]
                if model is None:
                    keep = [np.ones(len(b)) for b in parsed]
                else:
                    keep = model.label([Page(b, cache) for b in parsed])
                texts = ["\n".join(b.text for b, k in zip(blocks, p) if k >= 0.5) for blocks, p in zip(parsed, keep)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])
    return run


def extract_text(pages: DataFrame, model: Labeller | None = None, sample: int = SAMPLE) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; a map over rows after training."""
    model = model or train_labeller(pages, sample)
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.col("html").cast("string").alias("html"))
    return src.mapInArrow(_extract_task(model), "page_id long, url string, text string, n_chars long")
