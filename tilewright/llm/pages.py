"""HTML extraction by a maximum-scoring subsequence: words score positive, tags negative, by labelled pages.

A page is one sequence of tokens, words and tags, read once from left to right with the open elements as
a stack; end tags that HTML lets authors leave out are implied. Elements score by their features (tag
name, words of class, id and role); a token is seen under the best and the worst element around it. One
linear scan (Kadane's) finds the contiguous region of the highest sum; its words outside elements of
other parts are the text. Three ways to score are tried until one finds text:

1. The page has elements known as content: words inside score positive, others ``BIAS``, tags a little.
2. It has none: words score the log-likelihood ratio of a word, tags that of a tag, between content and
   other parts of labelled pages; elements known as other parts count against their words, those whose
   names speak for both (``widget-content``) not at all. If the region has no more than ``CLEAR`` of the words, the
   page has no clear one and all of them are its text.
3. The same without names. What stands in menus, footers, forms and the like by tag is never text.

Weights are smoothed log-odds from labelled pages: fixed layouts of named parts (``labelled_pages``), and
pages of the table that have one article or main element, which labels its words as content and all
others as not (``learn_from_pages``; a bounded sample). So names that only one site uses are learned.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import read_table, renamed, restored, staged

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Elements whose content is not text of the page.
_RAW = frozenset("script style noscript template textarea select svg iframe object title".split())
#: Elements without an end tag.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand inside a line of text.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: The elements that a start tag ends if they are open, up to the element that holds them.
_ENDS = {**{t: ({"p"}, {"div", "li", "td", "th", "body", "article", "section", "blockquote"}) for t in (
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul").split()},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}), "th": ({"td", "th", "p"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
_NONE = ((), ())

#: Layouts of the labelled pages, as (tag, class) of a part.
_CONTENT = (("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("div", "article"), ("div", "entry text"), ("section", "story"), ("div", "main"))
_OTHER = (
    ("nav", ""), ("nav", "menu"), ("ul", "nav menu"), ("div", "navigation"), ("div", "navbar"), ("div", "breadcrumb"), ("div", "breadcrumbs"), ("div", "topbar"),
    ("header", ""), ("header", "header"), ("div", "header"), ("div", "masthead"), ("footer", ""), ("footer", "footer"), ("div", "footer"), ("div", "copyright"),
    ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "recommended"), ("div", "ad"), ("div", "ads"), ("div", "advert"),
    ("div", "advertisement"), ("div", "banner"), ("div", "promo"), ("div", "sponsor"), ("div", "sponsored"), ("div", "notice"), ("div", "cookie notice"), ("div", "cookies"),
    ("div", "consent"), ("div", "alert"), ("div", "popup"), ("div", "modal"), ("div", "share"), ("div", "social"), ("div", "subscribe"), ("div", "newsletter"),
    ("div", "signup"), ("div", "login"), ("form", ""), ("form", "search"), ("div", "search"), ("button", ""), ("section", "comments"), ("div", "comments"), ("div", "comment"),
    ("ol", "commentlist"), ("div", "replies"), ("div", "disqus"), ("div", "pagination"), ("div", "pager"), ("div", "tags"), ("dialog", ""), ("fieldset", ""), ("menu", ""))


def labelled_pages() -> list[list[tuple[list[tuple[str, str]], bool, int, int]]]:
    """Pages as parts: (elements around, whether it is content, words, tags)."""
    out = []
    for i, content in enumerate(_CONTENT * 4):
        inner = (("p", ""), ("h1", ""), ("p", ""), ("h2", ""), ("p", ""), ("li", ""), ("blockquote", ""), ("pre", ""), ("td", ""))
        page = [([("body", ""), content, x], True, 40 if x[0] == "p" else 8, 2) for x in inner]
        page.append(([("body", ""), content, ("p", ""), ("a", "")], True, 4, 2))
        page.append(([("body", ""), content, ("p", ""), ("b", "")], True, 4, 2))
        for k, other in enumerate(_OTHER):
            if (i + k) % 3:
                inside = [content] if k % 4 == 0 else []
                for x in ((("a", ""),) if k % 2 else (("li", ""), ("a", ""))), (("p", ""),), (("div", ""),):
                    page.append(([("body", ""), *inside, other, *x], False, 5, 4))
        out.append(page)
    return out


def _features(tag: str, names: str) -> tuple[str, ...]:
    return (f"<{tag}>", *sorted(set(_NAME.findall(names.lower()))))


#: Elements that all parts have, which tell nothing.
_PLAIN = frozenset(f"<{t}>" for t in "body html div section ul ol li p h1 h2 h3 h4 h5 h6 table tbody thead tr td th pre blockquote dl dt dd figure figcaption hr br".split())
LINK_ITEM = "<li><a>"
#: Score of a word that no known element is around, on a page with elements known as content.
BIAS = -0.5
#: Share of their scores that words and tags count with inside known other parts: those are left out of the text anyway and shall not cut an article in two.
INSIDE = 0.02
#: Share of a page's words that a region without known elements must exceed.
CLEAR = 0.5
#: Pages of a table that teach.
SAMPLE = 2000


class Weights:
    """Feature weights with the log-likelihood ratios of a word, a tag of a block and a tag inside a line."""

    def __init__(self, features: dict[str, float], word: float, block: float, inline: float):
        self.features, self.word, self.block, self.inline = features, word, block, inline
        self.scores = lru_cache(maxsize=50_000)(self._scores)

    def _scores(self, tag: str, names: str) -> tuple[float, float, float]:
        """Scores of an element by all names, by names that don't contradict each other, by its tag."""
        found = [self.features.get(f, 0.0) for f in _features(tag, names)]
        whole = sum(found)
        return whole, 0.0 if min(found) < 0 < max(found) else whole, found[0]


def learn_weights(counts: Counter, smoothing: float = 0.5, least: float = -4.0, most: float = 1.5) -> Weights:
    """Smoothed log-odds between least and most from counts of (feature, content) in words and of tokens.

    ``most`` is below -least, so that nothing makes up for the menu around it. Words score above and tags
    below zero whatever the pages say.
    """
    rate = math.log((counts["words", True] + smoothing) / (counts["words", False] + smoothing))
    features = {}
    for f in {f for f, _ in counts if f.startswith("<") or f.islower()} - _PLAIN - {"words", "blocks", "lines"}:
        odds = math.log((counts[f, True] + smoothing) / (counts[f, False] + smoothing)) - rate
        features[f] = max(least, min(most, odds))
    total = {c: sum(counts[k, c] + smoothing for k in ("words", "blocks", "lines")) for c in (True, False)}
    ratio = {k: math.log((counts[k, True] + smoothing) / total[True]) - math.log((counts[k, False] + smoothing) / total[False]) for k in ("words", "blocks", "lines")}
    return Weights(features, max(0.1, ratio["words"]), min(-0.1, ratio["blocks"]), min(0.0, ratio["lines"]))


def layout_counts() -> Counter:
    """Counts for ``learn_weights`` from the fixed layouts."""
    counts = Counter()
    for page in labelled_pages():
        for elements, content, words, tags in page:
            found = {f for tag, names in elements if tag not in _INLINE for f in _features(tag, names)}
            if [tag for tag, _ in elements[-2:]] == ["li", "a"]:
                found.add(LINK_ITEM)
            for f in found:
                counts[f.replace("words", "words.").replace("blocks", "blocks.").replace("lines", "lines."), content] += words
            counts["words", content] += words
            counts["blocks", content] += tags
    return counts


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return learn_weights(layout_counts())


def _tag_end(page: str, at: int, closed: dict[str, bool]) -> int:
    """End of the tag that is open at ``at``, with > inside quotes left out; len(page) if it has none.

    closed: remembers characters that the rest of the page does not have.
    """
    first = at
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        end = page.find(m[0], m.end()) if closed.get(m[0], True) else -1
        closed[m[0]] = end >= 0
        at = end + 1 if end >= 0 else m.end()
    # an odd quote hides the tag's end
    end = page.find(">", first) + 1 if closed.get(">", True) else 0
    closed[">"] = end > 0
    return end or len(page)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): "text" runs, "open", "close", "void" tags by lower-cased name; comments and raw elements are left out.

    Linear in the page: nothing is looked for again that the rest of the page does not have.
    """
    at, closed, lower = 0, {}, None
    for_text = 0
    while m := _OPEN.search(page, at):
        if m.start() > for_text:
            yield "text", page[for_text:m.start()], ""
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
        elif not m[2]:
            end = page.find(">", m.end())
            at = len(page) if end < 0 else end + 1
        else:
            at, tag = _tag_end(page, m.end(), closed), m[2].lower()
            names = page[m.end():at - 1]
            if m[1]:
                yield "close", tag, ""
            elif tag in _RAW and not names.endswith("/"):
                lower = page.lower() if lower is None and len(page.lower()) == len(page) else page if lower is None else lower
                end = lower.find(f"</{tag}", at)
                at = len(page) if end < 0 else _tag_end(page, end + 2, closed)
                yield "void", "br" if tag not in _INLINE else tag, ""
            else:
                yield "void" if tag in _VOID or names.endswith("/") else "open", tag, names
        for_text = at
    if for_text < len(page):
        yield "text", page[for_text:], ""


def _names(tag: str, attributes: str) -> str:
    """Words of class, id and role; those of html and body describe the site, not a part of it."""
    if not attributes or tag in ("html", "body"):
        return ""
    return " ".join(a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(attributes))


class Node:
    """State of an open element; elements that look alike under the same node share one."""

    __slots__ = ("state", "below")

    def __init__(self, state):
        self.state, self.below = state, {}


def walk(page: str, root, enter) -> Iterator[tuple[str, str, object, int]]:
    """(kind, value, state, depth): text runs and tags with the state and depth of the innermost open element.

    ``enter`` makes an element's state from its parent's state, tag, names and parent's tag; ``root`` is that above all.
    """
    top = node = Node(root)
    stack: list[tuple[str, Node]] = []
    open_: dict[str, int] = {}

    def leave(k: int) -> None:
        for tag, _ in stack[k:]:
            if open_[tag] == 1:
                del open_[tag]
            else:
                open_[tag] -= 1
        del stack[k:]

    for kind, value, attributes in tokens(page):
        if kind == "open":
            ends, holders = _ENDS.get(value, _NONE)
            if ends and not open_.keys().isdisjoint(ends):
                # lines and what else is ended go, up to the element that holds both
                k = n = len(stack)
                while k and stack[k - 1][0] in _INLINE:
                    k -= 1
                while k and stack[k - 1][0] in ends and stack[k - 1][0] not in holders:
                    k -= 1
                if k < n and stack[k][0] in ends:
                    leave(k)
                    node = stack[-1][1] if stack else top
                    yield "close", value, node.state, k
            names = _names(value, attributes) if attributes else ""
            parent = stack[-1][0] if value == "a" and stack else ""
            below = node.below.get((value, names, parent))
            if below is None:
                below = node.below[value, names, parent] = Node(enter(node.state, value, names, parent))
            node = below
            stack.append((value, node))
            open_[value] = open_.get(value, 0) + 1
        elif kind == "close" and value in open_:
            k = len(stack) - 1
            while stack[k][0] != value:
                k -= 1
            leave(k)
            node = stack[-1][1] if stack else top
        yield kind, value, node.state, len(stack)


def extract(page: str | None, weights: Weights | None = None) -> str:
    """Main text of a page; empty for null, empty or wordless pages. White space is what str.split splits on."""
    weights = weights or default_weights()
    none = (0.0, 0.0, 0.0)

    def enter(state, tag, names, parent):
        own = none if tag in _INLINE else weights.scores(tag, names)
        if tag == "a" and parent == "li":
            own = (min(0.0, weights.features.get(LINK_ITEM, 0.0)),) * 3
        if own == none:
            return state
        return tuple((max(hi, s), min(lo, s)) for (hi, lo), s in zip(state, own))

    # (text or None where a block begins or ends, words or 0, bounds of the elements around, depth)
    pieces, base = [], 0
    for kind, value, state, depth in walk(page or "", ((0.0, 0.0),) * 3, enter):
        if kind == "text":
            t = html.unescape(value)
            pieces.append((t, len(t.split()), state, depth))
        else:
            pieces.append(("" if value in _INLINE else None, 0, state, depth))
            if kind == "open" and value in ("html", "body"):
                base = max(base, depth)
    if any(n and s[0][0] > 0 and s[0][0] + s[0][1] + BIAS > 0 for _, n, s, _ in pieces):
        found = _best(pieces, lambda s: BIAS + s[0][0] + s[0][1], -0.05, -0.05)
        if found:
            return found
    for level in (1, 2):
        kept = sum(n for _, n, s, _ in pieces if s[level][1] >= 0)
        word = lambda s: weights.word + 4 * s[level][1]  # noqa: B023, E731
        found = _best(pieces, word, weights.block, weights.inline, base)
        if found and len(found.split()) <= CLEAR * kept:
            found = _best(pieces, word, 0.0, 0.0)
        if found:
            return found
    return ""


def _best(pieces: list, word, block: float, inline: float, base: int | None = None) -> str:
    """Words of positive score in the contiguous region of the highest sum; ties: the first, shortest region.

    With ``base`` the region is widened to the elements around it below that depth, as long as it has ``CLEAR`` of their words.
    """
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    scores: dict = {}
    for k, (text, n, state, _) in enumerate(pieces):
        if state not in scores:
            w = word(state)
            share = INSIDE if w <= 0 and min(lo for _, lo in state) < 0 else 1.0
            scores[state] = (w, w * share, block * share, inline * share)
        _, w, b, i = scores[state]
        if total <= 0:
            total, start = 0.0, k
        total += b if text is None else i if not text else n * w
        if total > best:
            best, best_range = total, (start, k + 1)
    a, z = best_range
    if base is not None and a < z:
        a, z = _widened(pieces, scores, a, z, base)
    out = "".join(" " if t is None else t if scores[s][0] > 0 or not n else " " for t, n, s, _ in pieces[a:z])
    return " ".join(out.split())


def _widened(pieces: list, scores: dict, a: int, z: int, base: int) -> tuple[int, int]:
    counted = lambda lo, hi: sum(n for _, n, s, _ in pieces[lo:hi] if scores[s][0] > 0)
    words, depth = counted(a, z), min(d for *_, d in pieces[a:z])
    x, y, around = a, z, words
    while depth > base:
        lo, hi = x, y
        while x and pieces[x - 1][3] >= depth:
            x -= 1
        while y < len(pieces) and pieces[y][3] >= depth:
            y += 1
        around += counted(x, lo) + counted(hi, y)
        if words < CLEAR * around:
            break
        a, z, words, depth = x, y, around, depth - 1
    return a, z


def page_counts(page: str) -> Counter:
    """Counts for ``learn_weights`` of a page that has one article or main element; empty for any other page."""
    counts = Counter()
    starts = 0

    def enter(state, tag, names, parent):
        features, content = state
        found = set() if tag in _INLINE else {f for f in _features(tag, names) if f not in _PLAIN}
        if tag == "a" and parent == "li":
            found.add(LINK_ITEM)
        return features | found if found - features else features, content or tag in ("article", "main")

    for kind, value, (features, content), _ in walk(page, (frozenset(), False), enter):
        if kind == "text":
            n = len(html.unescape(value).split())
            if n:
                counts["words", content] += n
                for f in features:
                    counts[f, content] += n
        else:
            starts += kind == "open" and value in ("article", "main")
            counts["lines" if value in _INLINE else "blocks", content] += 1
    return counts if starts == 1 and counts["words", True] else Counter()


def learn_from_pages(pages: DataFrame, *, column: str = "html", page_id: str = "page_id", sample: int = SAMPLE, least_pages: int = 5) -> Weights:
    """Weights from the fixed layouts and, as much again, from the pages of the ``sample`` ids with the smallest hashes.

    Features that fewer than ``least_pages`` pages have teach nothing. Null ids and null pages are left out;
    without a page that has one article or main element the layouts alone teach.
    """
    ids = pages.select(F.col(page_id).alias("_id")).where("_id is not null").distinct()
    ids = staged(ids.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(sample), "page-ids")
    chosen = pages.select(F.col(page_id).alias("_id"), F.col(column).alias("_page")).where("_page is not null").join(F.broadcast(ids), "_id").select("_page")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                got = page_counts(page)
                total.update(got)
                n.update(dict.fromkeys(got, 1))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([c for _, c in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64()), pa.array([n[k] for k in keys], pa.int64())],
                                         ["feature", "content", "words", "pages"])

    found = chosen.mapInArrow(count, "feature string, content boolean, words bigint, pages bigint").groupBy("feature", "content").agg(F.sum("words").alias("words"), F.sum("pages").alias("pages"))
    rows = found.where(F.col("pages") >= least_pages).orderBy("feature", "content").collect()
    counts = layout_counts()
    real = {r.content: r.words for r in rows if r.feature == "words"}
    if len(real) == 2:
        counts.update({(r.feature, r.content): r.words * counts["words", r.content] / real[r.content] for r in rows})
    return learn_weights(counts)


def extract_text(pages: DataFrame, *, column: str = "html", learned: Weights | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of the whole page.

    Null, empty and wordless pages give an empty text. A column named text is replaced; all others pass
    through. Repeated rows stay. A page is one row's work by nature, linear in its length.
    """
    rows, names = renamed(pages)
    html_at = pages.columns.index(column)
    learned = learned or default_weights()
    parts = learned.features, learned.word, learned.block, learned.inline
    kept = rows.withColumn("_text", F.lit("").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(*parts)
        for batch in batches:
            texts = [extract(x, weights) for x in batch.column(html_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "_text"])

    return rows.mapInArrow(run, kept.schema).select(*restored(names, ("text",)), F.col("_text").alias("text"))


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; weights are learned from at most SAMPLE of them."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, learned=learn_from_pages(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
