"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 400
# Fixed: elements that begin and end a block; elements without content; elements whose text is never shown.
BLOCKS = frozenset(
    "html head body title article section main nav header footer aside div p ul ol li dl dt dd table tr td th caption form fieldset "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption details summary address hr button select option label textarea dialog".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg title textarea select option button head".split())
ALIKE = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
# Fixed: words in a class, id or role that name what is not the article, used to label the training pages.
BESIDE = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored cookie consent notice popup modal newsletter subscribe sidebar related "
    "share social comment comments reply replies nav navbar navigation menu breadcrumb breadcrumbs footer header login form".split()
)
BESIDE_TAGS = frozenset("nav header footer aside form script style dialog".split())
ARTICLE = frozenset("article main".split())
WORD = re.compile(r"[^\W_]+")


class Leaves(HTMLParser):
    """The leaf blocks of a page in order: (ancestors, text, share of text in links), an ancestor being (tag, names)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset[str]]] = []
        self.blocks: list[tuple[tuple, str, float]] = []
        self.text: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            path = tuple(e for e in self.open if e[0] in BLOCKS or e[1] & BESIDE)
            if not any(tag in HIDDEN for tag, _ in self.open):
                self.blocks.append((path, text, min(1.0, self.linked / len(text))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
            for other in ALIKE.get(tag, "").split():
                self.close(other, within=("ul", "ol", "dl", "table", "tr", "select") if tag not in ("td", "th") else ("tr", "table"))
            if tag in BLOCKS:
                self.close("p", within=("div", "article", "section", "td", "li", "body", "blockquote"))
        elif tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            names = frozenset(w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in WORD.findall(v))
            if names & BESIDE:
                self.flush()
            self.open.append((tag, names))

    def close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return
            if self.open[at][0] in within:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in HIDDEN or any(t == tag and names & BESIDE for t, names in self.open):
            self.flush()
        self.close(tag)

    def handle_data(self, data):
        self.text.append(data)
        if any(tag == "a" for tag, _ in self.open):
            self.linked += len(data)


def leaves(html: str) -> list[tuple[tuple, str, float]]:
    parser = Leaves()
    parser.feed(html)
    parser.goahead(True)
    parser.flush()
    return parser.blocks


def label(path: tuple) -> int:
    """The training label of a block: inside an article and in nothing that stands beside it."""
    inside = any(tag in ARTICLE for tag, _ in path)
    return int(inside and not any(tag in BESIDE_TAGS or names & BESIDE for tag, names in path))


def features(blocks: list[tuple[tuple, str, float]]) -> list[list[str]]:
    """Ancestor tags and names, tag of the block, length, link share and punctuation of each block."""
    out = []
    for path, text, links in blocks:
        tags = {tag for tag, _ in path} - {"html", "body"}
        found = ["bias", "tag=" + (path[-1][0] if path else "none"), f"links={int(links * 4)}", f"words={min(6, len(text.split()).bit_length())}"]
        found += ["in=" + tag for tag in sorted(tags)]
        if not tags & ARTICLE:
            found.append("no article")
        beside = {tag for tag, _ in path} & BESIDE_TAGS or frozenset().union(*(names for _, names in path)) & BESIDE
        found.append("beside" if beside else "not beside")
        if text[-1] in ".!?…":
            found.append("sentence")
        out.append(found)
    return out


class Crf:
    """Two labels, weights per feature and label, and per pair of neighbouring labels."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step

    def scores(self, page: list[list[str]]) -> np.ndarray:
        return np.array([self.emit[[self.names[f] for f in block if f in self.names]].sum(axis=0) for block in page])

    def viterbi(self, page: list[list[str]]) -> list[int]:
        if not page:
            return []
        scores = self.scores(page)
        best, back = scores[0], []
        for s in scores[1:]:
            ways = best[:, None] + self.step
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + s
        path = [int(best.argmax())]
        for arrow in reversed(back):
            path.append(int(arrow[path[-1]]))
        return path[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 15, rate: float = 0.5, decay: float = 1e-4) -> Crf:
        """Gradient steps (Adagrad) on the log likelihood of each page, by the forward and backward sums."""
        names = {f: i for i, f in enumerate(sorted({f for page, _ in pages for block in page for f in block}))}
        self = cls(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
        sums = np.full((len(names), 2), 1e-2), np.full((2, 2), 1e-2)
        for _ in range(rounds):
            for page, gold in pages:
                s, n = self.scores(page), len(page)
                alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
                alpha[0] = s[0]
                for i in range(1, n):
                    alpha[i] = s[i] + np.logaddexp.reduce(alpha[i - 1][:, None] + self.step, axis=0)
                for i in range(n - 2, -1, -1):
                    beta[i] = np.logaddexp.reduce(self.step + s[i + 1] + beta[i + 1], axis=1)
                total = np.logaddexp.reduce(alpha[-1])
                error = np.eye(2)[gold] - np.exp(alpha + beta - total)
                grad, pair = np.zeros_like(self.emit), np.zeros((2, 2))
                for i, block in enumerate(page):
                    grad[[names[f] for f in block]] += error[i]
                    if i:
                        pair[gold[i - 1], gold[i]] += 1
                        pair -= np.exp(alpha[i - 1][:, None] + self.step + s[i] + beta[i] - total)
                for weight, g, seen in ((self.emit, grad, sums[0]), (self.step, pair, sums[1])):
                    g -= decay * weight
                    seen += g * g
                    weight += rate * g / np.sqrt(seen)
        return self


# Labelled pages of our own beside those of the corpus: notices, comments and sidebars inside the article, and pages without one.
OWN = (
    ("<body><header>Site name</header><div class='cookie'>We use cookies.</div><article><h1>A title</h1><p>Some text of the story, which goes on.</p>"
     "<aside>Read more</aside><p>And it ends here.</p><div class='comments'><p>Nice post, thanks.</p></div></article><footer>Imprint</footer></body>", None),
    ("<body><div id='menu'><a href='/'>Home</a></div><div class='content'><h1>A title</h1><p>The first part of the text, as it stands.</p>"
     "<p>The second part.</p></div><div class='sidebar'><p>Popular now.</p></div><form>Your mail <p>Sign up today.</p></form></body>", (0, 1, 1, 1, 0, 0, 0)),
    ("<body><p>Only a text without any frame.</p><p>It has two parts.</p></body>", (1, 1)),
)


def train(pages: DataFrame, sample: int = SAMPLE) -> Crf:
    """Fits on `OWN` and at most `sample` pages, those whose html hashes lowest, that hold an article element; their
    blocks are labelled by `label`. The bound is on training alone; every page is decoded."""
    rows = pages.where(F.col("html").contains("<article") & (F.length("html") < 200_000)).select("html")
    rows = rows.orderBy(F.xxhash64("html"), "html").limit(sample)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [leaves(html) for html in batch["html"]]
            yield pd.DataFrame({"page": [["\x1f".join(f) for f in features(b)] for b in found], "gold": [[label(p) for p, _, _ in b] for b in found]})

    table = rows.mapInPandas(parsed, "page array<string>, gold array<int>").toPandas()
    known = [([f.split("\x1f") for f in page], list(gold)) for page, gold in zip(table["page"], table["gold"]) if len(page)]
    for html, gold in OWN:
        blocks = leaves(html)
        known += [(features(blocks), list(gold) if gold else [label(p) for p, _, _ in blocks])] * 20
    return Crf.fit(known)


def extract(pages: DataFrame, crf: Crf) -> DataFrame:
    """page_id, url, text, n_chars for each row; null or empty html, or no block of the article, gives an empty text.

    Repeated rows count apart and other columns are ignored. Inside a block white space becomes one space; blocks of
    the article are joined by one space in page order.
    """

    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        def of(html: str) -> str:
            blocks = leaves(html)
            return " ".join(t for (_, t, _), y in zip(blocks, crf.viterbi(features(blocks))) if y)

        return batch.map(of)

    rows = pages.select("page_id", "url", text(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
