"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of block elements and runs of text (a run: inline content between block boundaries).  Each node
gets features of its subtree, attributes, depth and siblings; trees estimate the odds that it holds main text.  Decoding
picks the likeliest labels for the whole tree under the rule that what lies in a rejected node is rejected.  The trees
are trained on pages of invented layouts (:func:`training_page`), made from a seed, labelled as they are made.  Words in
attributes are hashed; what a word tells is learned from other such pages.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import bounded_batches, free, table, texts

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag: quotes count behind an equals sign only. Possessive throughout, so it never tries twice.
REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements of these groups are nodes; all others are inline. Each group is a feature.
GROUPS = {
    "article": "article", "main": "main", "section": "section", "div": "div center", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl menu", "item": "li dt dd", "nav": "nav", "header": "header", "footer": "footer address", "aside": "aside",
    "form": "form fieldset button label dialog select textarea option", "table": "table thead tbody tfoot tr td th caption", "quote": "blockquote pre figure figcaption details summary hr", "page": "html body frameset",
}
GROUP_OF = {t: g for g, ts in GROUPS.items() for t in ts.split()}
TEXT = "#text"
KINDS = [*GROUPS, TEXT]
KIND_AT = {k: i for i, k in enumerate(KINDS)}
#: Content of these is never text; without an end tag it is the rest of the page.
SKIPPED = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for n in ("script", "style", "template", "title")}
HEAD_END = re.compile(r"</head\s*+>|<(?=body\b)", re.I)
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track", "param"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Cells of the table of attribute words' odds, and the most that a word tells.
CELLS, MOST = 1 << 14, 4.0


def cell(word: str) -> int:
    """The place of an attribute word in the table, by a hash."""
    return zlib.crc32(word.lower().encode()) % CELLS


def tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, name in lower case, the rest, whether it is an end tag) of each tag; no name: a comment.

    Each character is looked at a bounded number of times: once a tag has no end that respects its quotes, those after it
    end at the next ``>``.  A caller may send the place to go on from.
    """
    at, strict = 0, True
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        mark = html[at : at + 1]
        if mark in ("!", "?"):
            end = html.find("-->", start + 2) + 3 if html.startswith("<!--", start) else html.find(">", at) + 1
            found = (start, end if end > at else len(html), "", "", False)
            if html.startswith("<!--", start) and end == 2:
                found = (start, len(html), "", "", False)
        else:
            closing = mark == "/"
            name = NAME.match(html, at + closing)
            if not name:
                continue
            if strict and (rest := REST.match(html, name.end())):
                end = rest.end()
            else:
                strict, end = False, html.find(">", name.end()) + 1
                if not end:
                    return
            found = (start, end, name[0].lower(), html[name.end() : end - 1], closing)
        at = max(found[1], (yield found) or 0)


class Page:
    """Nodes in page order: kind, parent, depth, hashed attribute words, and of runs their text and characters in links.

    Inline elements are read through.  Comments, scripts, styles, templates and the head are never text; the rest is left
    to the trees.
    """

    def __init__(self, html: str):
        self.kind, self.parent, self.depth, self.words, self.text, self.linked = ["page"], [-1], [0], [()], [""], [0]
        stack, names, open_ = [0], ["#root"], Counter()
        run: list[str] = []
        link, linked, at, headed = False, 0, 0, False

        def add(kind: str, words: tuple = (), text: str = "", links: int = 0) -> int:
            self.kind.append(kind), self.parent.append(stack[-1]), self.depth.append(len(stack)), self.words.append(words), self.text.append(text), self.linked.append(links)
            return len(self.kind) - 1

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(unescape("".join(run)).split())
                run.clear()
                if text:
                    add(TEXT, (), text, min(linked, len(text)))
            linked = 0

        def up() -> str:
            stack.pop()
            open_[names[-1]] -= 1
            return names.pop()

        found, jump = tags(html), None
        while True:
            try:
                start, end, name, rest, closing = found.send(jump)
            except StopIteration:
                break
            jump = None
            if piece := html[at:start]:
                run.append(piece)
                linked += link and len(piece.strip())
            at = end
            if closing:
                if name == "a":
                    link = False
                elif name in GROUP_OF and open_[name]:
                    flush()
                    link = False
                    while up() != name:
                        pass
            elif name in SKIPPED:
                close = SKIPPED[name].search(html, end)
                at = jump = close.end() if close else len(html)
                run.append(" ")
            elif name == "head" and not headed:
                headed = True  # the page may lack its end
                if close := HEAD_END.search(html, end):
                    at = jump = close.end() if close[0] != "<" else close.start()
            elif name == "br":
                run.append(" ")
            elif name == "a":
                link = True
            elif group := GROUP_OF.get(name):
                flush()
                link = False
                if names[-1] == "p":
                    up()
                for _ in range(2):
                    if names[-1] in CLOSES.get(name, ()):
                        up()
                words = tuple(cell(w) for x in ATTRIBUTE.finditer(rest) for w in WORD.findall(x[1] or x[2] or x[3] or ""))
                k = add(group, words)
                if name not in VOID:
                    stack.append(k), names.append(name)
                    open_[name] += 1
        run.append(html[at:])
        linked += link and len(html[at:].strip())
        flush()

    def features(self, odds: np.ndarray) -> np.ndarray:
        """A row a node; odds: what attribute words tell, by their cell."""
        n, up = len(self.kind), self.parent
        chars, linked = [len(t) for t in self.text], list(self.linked)
        stops = [t.count(".") + t.count(",") for t in self.text]
        runs, paragraphs, size = [k == TEXT for k in self.kind], [k == "p" for k in self.kind], [1] * n
        holds = [0] * n
        brothers, order = [0] * n, [0] * n
        told = [[float(odds[c]) for c in w] for w in self.words]
        low, high, sum_ = [min([0.0, *x]) for x in told], [max([0.0, *x]) for x in told], [sum(x) for x in told]
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = up[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            runs[p] += runs[i]
            paragraphs[p] += paragraphs[i]
            size[p] += size[i]
            brothers[p] += 1
            holds[p] |= holds[i] | (self.kind[i] in ("article", "main")) | (high[i] > 1)
        kinds = [KIND_AT[k] for k in self.kind]
        least, most, all_, inside, seen = list(low), list(high), list(sum_), [0] * n, [0] * n
        for i in range(1, n):
            p = up[i]
            least[i], most[i], all_[i] = min(least[i], least[p]), max(most[i], most[p]), all_[i] + all_[p]
            inside[i] = inside[p] | 1 << kinds[p]
            order[i] = seen[p]
            seen[p] += 1
        parent = np.maximum(np.array(up), 0)
        chars, linked, stops, runs, paragraphs, size, depth, order, holds = np.array([chars, linked, stops, runs, paragraphs, size, self.depth, order, holds], float)
        brothers = np.maximum(np.array(brothers, float)[parent], 1)
        inside = np.array(inside)[:, None] & (1 << np.arange(len(KINDS))) > 0
        total, around = max(1.0, chars[0]), np.maximum(chars[parent], 1)
        return np.concatenate([
            np.eye(len(KINDS))[kinds], inside, np.array([low, high, sum_, least, most, all_]).T,
            np.stack([np.log1p(chars), linked / np.maximum(chars, 1), stops / np.maximum(chars, 1), np.log1p(runs), np.log1p(paragraphs), size / np.maximum(chars, 1), chars / total, chars / around, depth, order, order / brothers, np.log1p(brothers), holds], 1),
        ], 1)

    def main_text(self, odds: np.ndarray) -> str:
        """Runs that stay when the labels of all nodes are chosen for most likelihood, under the rules that what lies in a
        rejected node is rejected, and that a kept element holds a kept run."""
        keep_p, drop_p = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
        n = len(odds)
        drop, best = list(drop_p), [0.0] * n  # best: of the children, each by itself
        gain, heir = [-np.inf] * n, [-1] * n  # of keeping the child that gains most, or loses least
        keep = [0.0] * n
        for i in range(n - 1, -1, -1):  # children come after their parents
            keep[i] = keep_p[i] if self.kind[i] == TEXT else keep_p[i] + best[i] + min(gain[i], 0.0)
            if i:
                p, more = self.parent[i], keep[i] - drop[i]
                best[p] += max(keep[i], drop[i])
                drop[p] += drop[i]
                if more >= gain[p]:
                    gain[p], heir[p] = more, i
        kept = [keep[0] >= drop[0] and keep[0] > -np.inf]
        for i in range(1, n):
            p = self.parent[i]
            kept.append(kept[p] and (keep[i] >= drop[i] or heir[p] == i and gain[p] < 0))
        return "\n".join(t for t, k in zip(self.text, kept, strict=True) if k and t)


#: Words that the invented pages draw attributes from, by the part of a page.
NAMES = {
    "main": "article content main post entry story text blog", "nav": "nav menu breadcrumb breadcrumbs navbar navigation toc pagination pager tabs links skip", "head": "header banner masthead branding logo top topbar hero",
    "foot": "footer copyright legal colophon bottom", "side": "sidebar aside related widget recommended trending popular rail more side", "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion promoted adsense",
    "notice": "cookie cookies consent gdpr notice newsletter subscribe subscription signup popup modal overlay paywall alert privacy message", "comment": "comment comments disqus reply replies respond discussion reader feedback", "share": "share social follow tags tag meta byline author", "form": "form search login register contact survey",
}


def training_page(rng: random.Random) -> str:
    """An invented page: words of the main text begin with x, all others with z."""
    def prose(mark: str, low: int, high: int, links: float = 0.0) -> str:
        words = []
        for _ in range(rng.randint(low, high)):
            w = mark + "".join(rng.choices("aeioulnrst", k=rng.randrange(1, 9)))
            w = f'<a href="/{w}">{w}</a>' if rng.random() < links else f"<b>{w}</b>" if rng.random() < 0.02 else w
            words.append(w + rng.choice(["", "", "", "", ",", ".", " |", "&amp;"]))
        return " ".join(words)

    def element(tag: str, content: str, names: str = "") -> str:
        if names and rng.random() < 0.85:
            word = rng.choice(names.split()) if rng.random() < 0.75 else "".join(rng.choices("bcdfgkmqvw", k=rng.randrange(2, 7)))
            word = rng.choice([word, f"{word}-box", f"site-{word}", f"{word} wide", f"{word}{rng.randrange(9)}"])
            return f'<{tag} {rng.choice(["class", "id"])}="{word}">{content}</{tag}>'
        return f"<{tag}>{content}</{tag}>"

    def block(kind: str) -> str:
        semantic = rng.random() < 0.6
        tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form"}.get(kind, "div") if semantic else "div"
        names = NAMES[kind] if not semantic or kind in ("ad", "notice", "comment", "share") or rng.random() < 0.5 else ""
        if kind == "nav":
            links = [f'<a href="/{k}">{prose("z", 1, 3)}</a>' for k in range(rng.randrange(2, 9))]
            body = "<ul><li>" + "</li><li>".join(links) + "</li></ul>" if rng.random() < 0.7 else " ".join(links)
        elif kind in ("comment", "side"):
            body = "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>"]).format(prose("z", 1, 40, rng.choice([0, 0.3, 1]))) for _ in range(rng.randrange(1, 6)))
        elif kind == "form":
            body = f'<label>{prose("z", 1, 4)}</label><input name="q"><button>{prose("z", 1, 2)}</button>' + (f'<p>{prose("z", 3, 20)}</p>' if rng.random() < 0.4 else "")
        else:
            body = prose("z", 1, 30, rng.choice([0, 0, 0.2]))
            body = rng.choice(["{}", "<p>{}</p>", "<span>{}</span>"]).format(body)
        return element(tag, body, names)

    parts, tiny = [], rng.random() < 0.2
    for _ in range(1 if tiny else rng.randrange(1, 14)):
        lead, long = 0 if tiny else rng.random(), rng.random()
        inner = prose("x", 1, 4) if lead < 0.15 else prose("x", 5, 160 if long < 0.5 else 40, rng.choice([0, 0, 0.05]))
        shape = rng.random()
        parts.append(f"<p>{inner}</p>" if shape < 0.66 else f"<p><b>{inner}<br>" if shape < 0.74 else f"<h2>{prose('x', 1, 8)}</h2><p>{inner}</p>" if shape < 0.82 else f"<ul><li>{inner}</li><li>{prose('x', 1, 12)}</li></ul>" if shape < 0.9 else f"<blockquote>{inner}</blockquote>" if shape < 0.93 else f"<figure><img src='/i.png'><figcaption>{prose('x', 3, 20)}</figcaption></figure>" if shape < 0.95 else f"<table><tr><td>{inner}</td><td>{prose('x', 1, 3)}</td></tr></table>")
    if rng.random() < 0.3:
        parts.insert(rng.randrange(len(parts) + 1), block(rng.choice(["ad", "share", "notice", "side", "form"])))
    title = f"<h1>{prose('x', 1, 4 if tiny else 12)}</h1>" if rng.random() < 0.8 else ""
    nested = rng.random()
    if nested < 0.15:
        cut = rng.randrange(len(parts) + 1)
        parts = ["<div>", *parts[:cut], "</div><div>", *parts[cut:], "</div>"]
    elif nested < 0.25:
        title, parts = f"<div>{title}</div>", ["<section>", *parts, "</section>"]
    body = title + "".join(parts)
    form = rng.random()
    if form < 0.6:
        core = element("article", body, NAMES["main"] if rng.random() < 0.3 else "") if form < 0.5 else element("main", body)
    else:
        core = element("div", body, NAMES["main"]) if form < 0.92 else f"<td>{body}</td>"
    if form < 0.3 and rng.random() < 0.3:
        core = f"<main>{core}</main>"
    if form >= 0.92:
        core = f"<table><tr>{f'<td>{block("nav")}</td>' if rng.random() < 0.7 else ''}{core}</tr></table>"
    around = lambda kinds, share: [block(k) for k in kinds if rng.random() < share]
    middle = core + "".join(around(["side", "comment"], 0.35))
    if rng.random() < 0.4:
        middle = element("div", middle, "container wrapper page layout grid row")
    page = [*around(["head"], 0.5), *around(["nav"], 0.8), *around(["notice", "ad", "ad", "form"], 0.4), middle, *around(["comment", "ad", "side", "notice", "form", "share"], 0.25), *around(["foot"], 0.85)]
    if rng.random() < 0.1:
        page.append(f"<p>{prose('z', 3, 12)}</p>")
    html = f"<!DOCTYPE html><html><head><title>{prose('z', 3, 9)}</title><style>p{{margin:0}}</style></head><body>" + "".join(page)
    return html + "</body></html>" if rng.random() < 0.85 else html


class Extractor:
    """The table of attribute words' odds and the trees."""

    def __init__(self, odds: np.ndarray, trees: Boosted):
        self.odds, self.trees = odds, trees

    def extract(self, pages: list[Page]) -> list[str]:
        x = [p.features(self.odds) for p in pages]
        found = np.split(self.trees.odds(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1]) if x else []
        return [p.main_text(o) for p, o in zip(pages, found, strict=True)]


def labelled(rng: random.Random) -> tuple[Page, np.ndarray]:
    """An invented page and whether each node is main: a run of main words, or an element around any of them."""
    page = Page(training_page(rng))
    good = np.array([len(re.findall(r"\bx", t)) for t in page.text], float)
    for i in range(len(good) - 1, 0, -1):
        good[page.parent[i]] += good[i]
    return page, good > 0


def word_odds(pages: list[tuple[Page, np.ndarray]]) -> np.ndarray:
    """By the cell of an attribute word: log odds that a node with it is main, above those of any node with words."""
    seen = np.zeros((2, CELLS))
    for page, good in pages:
        for w, g in zip(page.words, good, strict=True):
            for c in set(w):
                seen[int(g), c] += 1
    share = seen[1].sum() / seen.sum()
    odds = np.log((seen[1] + 2 * share) / (seen[0] + 2 * (1 - share))) - np.log(share / (1 - share))
    return np.clip(odds, -MOST, MOST)


@lru_cache(maxsize=2)
def trained(pages: int = 500, seed: int = 7) -> Extractor:
    """The words' odds from half as many invented pages, and trees over the nodes of others: what the trees see of words
    is what they will see on pages that the odds don't come from."""
    rng = random.Random(seed)
    odds = word_odds([labelled(rng) for _ in range(pages // 2)])
    some = [labelled(rng) for _ in range(pages)]
    return Extractor(odds, Boosted(np.concatenate([p.features(odds) for p, _ in some]), np.concatenate([y for _, y in some]).astype(float), trees=50))


def extract(html: str | None, model: Extractor) -> str:
    return model.extract([Page(html or "")])[0]


def main_texts(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages (columns ``keep``) with main_text.  Null or empty html, and pages without main text: empty.

    Long pages take time in proportion to their length, whatever is in them.  Repeated rows are extracted each; no rows:
    no rows.  Column names must differ from ``main_text``, which is made here.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trained())  # 50 small trees
    keep = list(pages.columns) if keep is None else keep
    schema = pages.select(*keep).schema.add("main_text", "string")
    given = free(pages.columns, "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array(shared.value.extract([Page(t) for t in texts(b, given)]), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=schema.fieldNames())

    return pages.select(*keep, F.col(html_col).alias(given)).mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    found = main_texts(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
