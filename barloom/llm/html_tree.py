"""Main text of web pages by sum-product message passing over the DOM tree.

Every element and text node has a hidden label, content or not.  Node potentials come from
tag, class and id words and the shape of the text; parent-child potentials from how often a
label follows the label of the parent.  Both are counted on labelled pages.  Messages
go up from the leaves and down from the root, so each node gets its exact marginal given the
whole page; text nodes above one half are the main text.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import ship, small_batches

ship(__name__)

# Fixed values of HTML: elements without an end tag; with raw text; that break the line;
# and start tags that end an open element (up to the nearest of the second set).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe xmp noembed noframes".split())
# Of these, an element without an end tag does not take the rest of the page; graphics end where a block starts.
LENIENT = frozenset("noscript template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_ITSELF = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
}
# A paragraph ends where a block starts; it cannot be reopened through these.
SHIELDS = frozenset("html body table td th caption button object".split())

# What a page is made of besides tags with a name; a tag's end is found apart.
OPENING = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
OTHER = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?/][^>]*>?|<[a-zA-Z][^<>]*\Z"
    r"|[^<]+|<",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# References to numbers beyond all characters.
BEYOND = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{7,});?")
NAME_PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
BLOCK_START = re.compile(rf"<(?:{'|'.join(sorted(BLOCK - {'title'}))})(?=[\s/>])", re.I)
# Attributes whose words tell what an element is for.
TELLING = ("class", "id", "role", "aria-label", "itemprop", "hidden")
#: Marks the main element of a labelled page ("1") and what is not main inside it ("0").
LABEL = "data-main"


@dataclass
class Tree:
    """Nodes in page order: ``tag`` is None for text; parents come before children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str | None] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)

    def add(self, parent: int, tag: str | None, attrs: str = "", text: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        return len(self.tag) - 1


class TagEnds:
    """Where tags end: at the first ``>`` outside quotes or, if all that follow are quoted, at the first one.

    A tag whose quotes never close would be read to the end of the page, and so would the next
    ones; the first such tag makes a table of all ends, from the back, that answers the others.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.at: list[int] | None = None
        self.ends: list[int] = []

    def after(self, start: int) -> int:
        """The position behind the tag whose attributes begin at ``start``; -1 if no ``>`` follows."""
        if start > self.last:
            return -1
        if self.at is None:
            if found := ATTRIBUTES.match(self.page, start):
                return found.end()
            self._list(start)
        i = bisect_left(self.at, start)
        end = self.ends[i] if i < len(self.at) else -1
        return end if end >= 0 else self.page.index(">", start) + 1

    def _list(self, start: int) -> None:
        marks = [(m.start(), m[0]) for m in re.finditer("[>\"']", self.page[start:])]
        self.at, self.ends = [start + i for i, _ in marks], [-1] * len(marks)
        follows: dict[str, int] = {}
        for i in range(len(marks) - 1, -1, -1):
            kind = marks[i][1]
            if kind == ">":
                self.ends[i] = self.at[i] + 1
            elif (close := follows.get(kind, len(marks))) + 1 < len(marks):
                self.ends[i] = self.ends[close + 1]
            follows[kind] = i


def parse(page: str) -> Tree:
    """A DOM tree of any text, in time linear in its length: unclosed, misnested and broken tags never fail."""
    tree = Tree()
    stack = [tree.add(-1, "#root")]
    # Where on the stack the open elements of a tag are.
    open_at: dict[str, list[int]] = {}
    tag_ends, seen = TagEnds(page), {}
    at, run, run_at = 0, [], 0

    def following(what: re.Pattern, start: int) -> tuple[int, int]:
        """Where ``what`` is found next; looked for once between two finds.  The end of the page if nowhere."""
        if seen.get(what, (-1, -1))[0] < start:
            found = what.search(page, start)
            seen[what] = found.span() if found else (len(page), len(page))
        return seen[what]

    def nearest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    def close_nearest(tags, stops) -> None:
        found = nearest(tags)
        if found > nearest(stops):
            while len(stack) > found:
                open_at[tree.tag[stack.pop()]].pop()

    while at < len(page):
        found = OPENING.match(page, at)
        end = tag_ends.after(found.end()) if found else -1
        if end < 0:
            piece = OTHER.match(page, at)[0]
            at += len(piece)
            if piece[0] != "<" or piece == "<":
                if tree.parent[-1] != stack[-1] or tree.tag[-1] is not None:
                    tree.text[run_at] = "".join(run)
                    run, run_at = [], tree.add(stack[-1], None)
                run.append(piece)
            continue
        tag, attrs, at = found["tag"].lower(), page[found.end() : end - 1], end
        if found["end"]:
            close_nearest({tag}, ())
            continue
        if tag in BLOCK:
            close_nearest({"p"}, SHIELDS)
        if tag in ENDS_ITSELF:
            close_nearest(*ENDS_ITSELF[tag])
        node = tree.add(stack[-1], tag, attrs)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            starts, ends = following(RAW_END[tag], at)
            block = following(BLOCK_START, at)[0] if tag == "svg" else len(page)
            if block < starts:
                at = block
            elif starts < len(page):
                at = ends
            elif tag not in LENIENT:
                at = len(page)
            continue
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(node)
    tree.text[run_at] = "".join(run)
    return tree


def unescape(text: str) -> str:
    """Decode character references; numbers beyond all characters give the replacement character."""
    return html.unescape(BEYOND.sub("\ufffd", text)) if "&" in text else text


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def features(tree: Tree, i: int, in_link: bool) -> list[str]:
    """What the node potentials look at."""
    tag = tree.tag[i]
    if tag is not None:
        out = [f"t:{tag}"]
        raw = tree.attrs[i]
        if "=" in raw or "hidden" in raw:
            named = attributes(raw)
            names = {w for a in TELLING if a in named for w in NAME_PART.findall(f"{named[a] or a}".lower())}
            out += [f"n:{w}" for w in sorted(names)]
        return out
    text = tree.text[i].strip()
    if not text:
        return []
    n = len(text.split(None, 40))
    size = 0 if n < 3 else 1 if n < 8 else 2 if n < 20 else 3
    return [f"w:{size}", f"e:{text[-1] in '.!?:;…'}", f"l:{in_link}"]


@dataclass
class Model:
    """Log-odds of features, parent-child potentials ``step[parent][child]`` and the root's log-odds."""

    odds: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    root: float

    def marginals(self, tree: Tree) -> list[float]:
        """Log-odds that each node is content, by one pass up and one down the tree."""
        n = len(tree.tag)
        link = [False] * n
        up = [0.0] * n  # own evidence and all messages from below
        odds = self.odds
        for i in range(n):
            if i:
                link[i] = link[tree.parent[i]] or tree.tag[i] == "a"
            up[i] = sum([odds.get(f, 0.0) for f in features(tree, i, link[i])])
        (p00, p01), (p10, p11) = self.step
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            r = math.exp(max(-40.0, min(40.0, up[i])))
            sent[i] = math.log((p10 + p11 * r) / (p00 + p01 * r))
            up[tree.parent[i]] += sent[i]
        both = up[:]
        both[0] += self.root
        for i in range(1, n):
            r = math.exp(max(-40.0, min(40.0, both[tree.parent[i]] - sent[i])))
            both[i] += math.log((p01 + p11 * r) / (p00 + p10 * r))
        return both


def labels_of(tree: Tree) -> list[int]:
    """Labels of a labelled page: 1 for nodes inside the marked element, up to what is marked 0."""
    out = [0] * len(tree.tag)
    for i in range(1, len(out)):
        out[i] = out[tree.parent[i]]
        if tree.tag[i] is not None and LABEL in tree.attrs[i]:
            out[i] = int(attributes(tree.attrs[i]).get(LABEL) == "1")
    return out


def _counts(page: str) -> Iterator[tuple[str, int]]:
    """(event, label) of every node of a labelled page."""
    tree = parse(page)
    label, link = labels_of(tree), [False] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        link[i] = link[tree.parent[i]] or tree.tag[i] == "a"
        yield f"s:{label[tree.parent[i]]}", label[i]
        for f in features(tree, i, link[i]):
            yield f, label[i]


def _slopes(pages: list[str], model: Model) -> dict[str, float]:
    """feature -> sum of label minus marginal over the nodes of labelled pages."""
    out: dict[str, float] = {}
    for page in pages:
        tree = parse(page)
        label, link = labels_of(tree), [False] * len(tree.tag)
        for i, score in enumerate(model.marginals(tree)):
            if i == 0:
                continue
            link[i] = link[tree.parent[i]] or tree.tag[i] == "a"
            gap = label[i] - 1 / (1 + math.exp(-max(-40.0, min(40.0, score))))
            for f in features(tree, i, link[i]):
                out[f] = out.get(f, 0.0) + gap
    return out


def fit(labelled: DataFrame, html_col: str = "html", rounds: int = 24, rate: float = 0.2, least: int = 2) -> Model:
    """Potentials from labelled pages: rows whose html marks its main element with ``data-main``.

    Parent-child potentials and the first node potentials are counted.  Each round then
    passes messages over all labelled pages and moves every node potential along the gap between
    labels and marginals (the slope of the likelihood), by steps of about ``rate``, so that
    features that go together are not counted twice.  Pages are read
    by Spark tasks; only sums per feature seen ``least`` times come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [pair for page in batch.column(0) for pair in _counts(page.as_py() or "")]
            names = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.int32()))]
            yield pa.RecordBatch.from_arrays(names, names=["event", "label"])

    pages = labelled.select(html_col)
    counted = pages.mapInArrow(count, "event string, label int").groupBy("event")
    rows = counted.agg(F.count(F.when(F.col("label") == 1, 1)).alias("one"), F.count("*").alias("all")).filter(
        F.col("all") >= least
    )
    seen = {r["event"]: (r["all"] - r["one"], r["one"]) for r in rows.collect()}
    totals: dict[str, list[float]] = {}
    for event, (zero, one) in seen.items():
        kind = totals.setdefault(event[0], [0.0, 0.0])
        kind[0] += zero
        kind[1] += one
    odds = {
        event: 0.5 * (math.log((one + 0.5) / (totals[event[0]][1] + 1)) - math.log((zero + 0.5) / (totals[event[0]][0] + 1)))
        for event, (zero, one) in seen.items()
        if event[0] != "s"
    }
    step = []
    for parent in (0, 1):
        zero, one = seen.get(f"s:{parent}", (0, 0))
        step.append(((zero + 0.5) / (zero + one + 1), (one + 0.5) / (zero + one + 1)))
    model = Model(odds, tuple(step), root=-4.0)
    mean, square = dict.fromkeys(odds, 0.0), dict.fromkeys(odds, 0.0)
    for turn in range(1, rounds + 1):
        gaps, n = _gaps(pages, model)
        moved = {}
        for event, old in model.odds.items():
            slope = (gaps.get(event, 0.0) - old / 4) / n
            mean[event] = 0.8 * mean[event] + 0.2 * slope
            square[event] = 0.95 * square[event] + 0.05 * slope * slope
            size = math.sqrt(square[event] / (1 - 0.95**turn)) + 1e-4
            moved[event] = old + rate * mean[event] / (1 - 0.8**turn) / size
        model = Model(moved, model.step, model.root)
    return model


def _gaps(pages: DataFrame, model: Model) -> tuple[dict[str, float], int]:
    """Sum of label minus marginal for every feature, and the number of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _slopes([page.as_py() or "" for page in batch.column(0)], model)
            found[""] = float(batch.num_rows)
            columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["event", "gap"])

    sums = pages.mapInArrow(run, "event string, gap double").groupBy("event").agg(F.sum("gap").alias("gap")).collect()
    found = {r["event"]: r["gap"] for r in sums}
    return found, int(found.pop("", 1) or 1)


def main_text(page: str | None, model: Model) -> str:
    """The content blocks in page order, joined by two line feeds; empty if there are none.

    References are decoded and white space inside a block becomes one space.
    """
    if not page:
        return ""
    tree = parse(page)
    score = model.marginals(tree)
    blocks, now = [], []
    # A block ends where a block element starts or ends, that is where the nearest
    # block ancestor of the text changes.
    home, last, breaks = [0] * len(tree.tag), None, 0
    for i in range(1, len(tree.tag)):
        tag, up = tree.tag[i], tree.parent[i]
        if tag in BLOCK:
            home[i] = i
            breaks += 1
            continue
        home[i] = home[up]
        if tag == "br":
            now.append(" ")
        if tag is not None or score[i] <= 0:
            continue
        if (home[i], breaks) != last:
            blocks.append(now)
            now, last = [], (home[i], breaks)
        now.append(tree.text[i])
    blocks.append(now)
    texts = (SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract(
    pages: DataFrame,
    model: Model | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of ``pages``.

    Without a model, one is fitted on ``training_pages``.  Null and empty html, and pages
    without content, give an empty text.  Text between tags is used whole.  Repeated rows are
    repeated; an empty table gives none.
    """
    spark = pages.sparkSession
    model = model or fit(training_pages(spark))
    small_batches(spark)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), model) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return found.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars")
    )


# --- labelled pages -------------------------------------------------------------------

# How page authors name the parts of a page.
MAIN_NAMES = "content main article post entry story post-content article-body entry-content main-content page-content text body-text".split()
BLOCK_NAMES = "paragraph lead intro section chapter".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav main-menu links pagination".split(),
    "header": "header masthead site-header top logo banner page-header".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "aside": "sidebar side aside widget related recommended popular more-stories related-posts".split(),
    "div-ad": "ad ads advert advertisement sponsored promo sponsor banner-ad adsense".split(),
    "div-notice": "notice cookie cookies consent cookie-banner gdpr alert popup modal overlay disclaimer newsletter-notice".split(),
    "form": "form search search-form login newsletter subscribe signup contact".split(),
    "comments": "comments comment comment-list reader-comments discussion replies responses disqus".split(),
    "share": "share social sharing social-links share-buttons tags meta byline".split(),
}


def _author(rng: random.Random) -> str:
    """One labelled page of a random layout."""

    def word() -> str:
        return "".join(rng.choice("aeioulnrstdhmckgpbfv") for _ in range(rng.randint(1, 9)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentence(low: int = 1, high: int = 22) -> str:
        return words(low, high).capitalize() + rng.choice(("." * 9 + "!?"))

    def prose(low: int = 1, high: int = 6) -> str:
        parts = [sentence() for _ in range(rng.randint(low, high))]
        if rng.random() < 0.25:
            parts[rng.randrange(len(parts))] = f'<{(t := rng.choice(("b", "i", "em", "strong")))}>{sentence(1, 5)}</{t}>'
        if rng.random() < 0.15:
            parts.append(f'<a href="/{word()}">{words(1, 4)}</a> {sentence(1, 6)}')
        if rng.random() < 0.2:
            parts.append(f"{words(1, 6)} {inline()} {sentence(1, 6)}")
        return " ".join(parts)

    def inline() -> str:
        kind = rng.choice(("math", "sub", "sup", "code", "span", "abbr", "time", "q", "cite", "object", "kbd", "small"))
        if kind == "math":
            signs = "".join(f"<{(t := rng.choice(('mi', 'mo', 'mn')))}>{rng.choice('abcxyz=+123')}</{t}>" for _ in range(rng.randint(2, 7)))
            return f"<math>{f'<mrow>{signs}</mrow>' if rng.random() < 0.5 else signs}</math>"
        return f"<{kind}>{rng.choice((word(), words(1, 6), str(rng.randint(1, 2000))))}</{kind}>"

    def attr(names: list[str], chance: float = 0.75) -> str:
        if rng.random() > chance:
            return ""
        return f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"'

    def links() -> str:
        items = "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(2, 8)))
        return f"<ul>{items}</ul>" if rng.random() < 0.8 else re.sub("</?li>", " ", items)

    def other(kind: str) -> str:
        names, label = OTHER_NAMES[kind], f' {LABEL}="0"'
        plain = kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        tag = kind if plain else rng.choice(("div", "div", "section"))
        named = attr(names, 0.4 if plain else 1.0) + label
        if kind == "nav":
            return f"<{tag}{named}>{links()}</{tag}>"
        if kind == "header":
            inner = f"<h1>{words(1, 4)}</h1>" if rng.random() < 0.4 else f"<a href='/'>{words(1, 3)}</a> {words(0, 6)}"
            return f"<{tag}{named}>{inner}{links() if rng.random() < 0.4 else ''}</{tag}>"
        if kind == "footer":
            return f"<{tag}{named}>&copy; {words(1, 3)}.{word()} &middot; {sentence(1, 8)}{links() if rng.random() < 0.4 else ''}</{tag}>"
        if kind == "aside":
            return f"<{tag}{named}><h3>{words(1, 3)}</h3>{rng.choice((links(), f'<p>{prose(1, 2)}</p>'))}</{tag}>"
        if kind == "form":
            tag = "form"
            return f"<{tag}{named}><label>{words(1, 3)}</label><input name='{word()}'><button>{words(1, 2)}</button></{tag}>"
        if kind == "comments":
            inner = "".join(
                f'<{(t := rng.choice(("div", "li", "article")))}{attr(names)}><b>{words(1, 2)}</b><p>{prose(1, 2)}</p></{t}>'
                for _ in range(rng.randint(1, 5))
            )
            return f"<{tag}{named}><h3>{words(1, 2)}</h3>{inner}</{tag}>"
        if kind == "share":
            return f"<{tag}{named}>{words(1, 6)} <a href='/{word()}'>{words(1, 2)}</a></{tag}>"
        return f"<{tag}{named}>{rng.choice((prose(1, 3), f'<p>{prose(1, 2)}</p>', words(1, 6)))}</{tag}>"

    def some(*kinds: str, chance: float = 0.6) -> str:
        return "".join(other(k) for k in kinds if rng.random() < chance)

    def block() -> str:
        kind = rng.random()
        if kind < 0.72:
            return f"<p{attr(BLOCK_NAMES, 0.1)}>{prose()}</p>"
        if kind < 0.80:
            return f"<p><b>{sentence(1, 12)}<br><p>{prose()}</p>"
        if kind < 0.88:
            return f"<{(t := rng.choice(('h2', 'h3')))}>{words(1, 8).capitalize()}</{t}>"
        if kind < 0.92:
            return f"<blockquote>{prose(1, 2)}</blockquote>"
        if kind < 0.96:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"
        return f"<table><tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr></table>"

    body = "".join(block() for _ in range(rng.randint(1, 14)))
    if rng.random() < 0.3:
        cut = other(rng.choice(("div-ad", "share", "aside", "form", "comments", "div-notice")))
        body = rng.choice((body + cut, cut + body, body + cut + "".join(block() for _ in range(rng.randint(0, 4)))))
    title = f"<h1>{words(2, 9).capitalize()}</h1>" if rng.random() < 0.8 else ""
    tag = rng.choice(("article", "article", "article", "main", "div", "div", "section"))
    main = f'<{tag}{attr(MAIN_NAMES, 0.3 if tag in ("article", "main") else 1.0)} {LABEL}="1">{title}{body}</{tag}>'
    if rng.random() < 0.3:
        main = f'<{rng.choice(("main", "div"))}{attr(["container", "wrapper", "page", "layout", "row"])}>{main}</div>'
    top = some("div-notice", chance=0.3) + some("header", "nav") + some("div-ad", "form", "aside", chance=0.3)
    low = some("div-ad", "share", "comments", "aside", "nav", "form", "div-notice", chance=0.3) + some("footer", chance=0.8)
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>{top}<!-- {word()} -->{main}{low}</body></html>"


def training_pages(spark: SparkSession, pages: int = 1000, seed: int = 5) -> DataFrame:
    """A bounded set of labelled pages (column html) of many layouts, the same on every run.

    Hand-made pages stand in for an annotated sample: no table of labelled pages is
    given.  Pass your own to ``fit``.
    """
    rng = random.Random(seed)
    return spark.createDataFrame([(_author(rng),) for _ in range(pages)], "html string")
