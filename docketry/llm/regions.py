"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of tokens: tags and words.  Words weigh by what surrounds
them, tags weigh against content; one linear scan finds the contiguous region of
the highest sum, and that region is the content.  The weights come from labelled
pages: those that name their own content by an article or main element, over a
sample of about ``SAMPLE_PAGES`` pages (the documented bound).  A kind of token
(running text, link, tag) weighs the smoothed log odds of being inside, and so
does each feature of the open elements: names that carry meaning and each word
of class, id and role.  So a class that no list knows counts against its words
if labelled pages hold it outside.  A word weighs the sum for its kind and
features, within ``MOST``.  Without labelled pages, ``PRIOR`` holds.

Tags in plenty can outweigh short words at the edge of the content, as in a list
or table of single words.  So a region that lies in one article or main element
goes on there, to both sides, over words that weigh for content.  The region may
have holes: elements that are no content by their name, or by a whole word of
class, id or role that says so (menus, headers, footers, sidebars, notices,
adverts, forms, comments), are left out of it, as are scripts, styles and
comments in the markup.  Of regions of equal sum the first is taken.

Cases: null html is empty and gives an empty text.  Markup that is cut off or
never closed is read as far as it goes.  Time and memory are in proportion to a
page, however deeply it nests.  Rows that repeat a page_id are read each; other
columns are not used.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 2_000
#: Weights without labelled pages: of a tag, of a word in running text, of one in a link, of a piece of an element that names itself no content.
PRIOR = {"tag": -1.0, "text": 1.0, "link": -1.0, "aside": -1.0}

#: A word weighs at most this, either way; a feature at most half of it.  Features seen in fewer words than FEW don't count.
MOST, FEW = 4.0, 20

# fixed values: element names and class words of the public HTML vocabulary
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea button".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ASIDE = frozenset("nav aside footer form menu dialog fieldset".split())
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related reply replies responses share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
_NAMED = frozenset("nav aside footer header form menu dialog fieldset p h1 h2 h3 h4 h5 h6 blockquote pre figure".split())
_CONTENT = frozenset(("article", "main"))
_CLOSED_BY = {"p": _BLOCKS - {"br"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"\S+")
_SPACE = re.compile(r"\s+")


def _words(attributes: str) -> list[str]:
    """The words of class, id and role."""
    return [x for m in _CLASS.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()]


def _is_aside(name: str, attributes: str, words: list[str], inside_content: bool) -> bool:
    if name in _ASIDE or (name == "header" and not inside_content):
        return True
    if "hidden" in attributes and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
        return True
    return name not in ("body", "html", "article", "main") and not _ASIDE_WORDS.isdisjoint(words)


def pieces(page: str, opened: Callable[[list[str]], None], closed: Callable[[list[str]], None]) -> Iterator[tuple[str, str, bool, int]]:
    """(kind, value, aside, content) of a page in order: kind is tag, break, text or link; content numbers the article or main element it stands in, 0 for none.

    ``opened`` and ``closed`` are told each element's features as it begins and ends, before the pieces that follow.
    """
    top = ("", False, False, 0, [])
    open_: list[tuple[str, bool, bool, int, list[str]]] = []  # name, aside, link, content, own features
    depth: Counter = Counter()  # open elements of each name, so that a closing tag without one costs nothing
    endless: set[str] = set()  # dropped elements without a closing tag from here on
    at, n, contents = 0, len(page), 0

    def close() -> str:
        name, _, _, _, own = open_.pop()
        depth[name] -= 1
        closed(own)
        return name

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        _, aside, link, content, _ = open_[-1] if open_ else top
        if not name:
            if m[0][0] != "<" or m[0] == "<":
                yield ("link" if link else "text"), html.unescape(m[0]), aside, content
            continue
        if m[1]:
            if depth[name]:
                while close() != name:
                    pass
        else:
            while open_ and name in _CLOSED_BY.get(open_[-1][0], ()):
                close()
            if name in _DROPPED:
                end = None
                if name not in endless and (not m[3].rstrip().endswith("/") or name in ("script", "style")):
                    end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                    if not end:
                        endless.add(name)
                if end:
                    at = end.end()
                elif name in ("script", "style"):
                    at = n
                yield "tag", name, aside, content
                continue
            if name not in _VOID and not m[3].rstrip().endswith("/"):
                _, aside, link, content, _ = open_[-1] if open_ else top
                words = _words(m[3])
                own = [name] if name in _NAMED else []
                if name not in ("html", "body", "article", "main"):
                    own += [f".{w}" for w in words]
                aside = aside or _is_aside(name, m[3], words, content > 0)
                if name in _CONTENT:
                    contents += 1
                    content = contents
                open_.append((name, aside, link or name == "a", content, own))
                depth[name] += 1
                opened(own)
        now = open_[-1] if open_ else top
        yield ("break" if name in _BLOCKS else "tag"), name, now[1], now[3]


def features(page: str) -> tuple[Counter, Counter]:
    """Tokens inside and outside of the labelled content by kind, and words by feature; both empty for an unlabelled page.

    A feature's words are those counted while it is open: a difference of running sums when it ends.
    """
    sides = (Counter(), Counter())  # outside, inside
    words = [0, 0]
    since: dict[str, tuple[int, int]] = {}
    active: Counter = Counter()

    def opened(own: list[str]) -> None:
        for f in own:
            active[f] += 1
            if active[f] == 1:
                since[f] = (words[0], words[1])

    def closed(own: list[str]) -> None:
        for f in own:
            active[f] -= 1
            if not active[f]:
                for side in (0, 1):
                    sides[side][f"of {f}"] += words[side] - since[f][side]

    for kind, value, _, content in pieces(page, opened, closed):
        side = 1 if content else 0
        count = len(_WORD.findall(value)) if kind in ("text", "link") else 1
        sides[side]["tag" if kind == "break" else kind] += count
        if kind in ("text", "link"):
            words[side] += count
    closed([f for f, times in active.items() for _ in range(times)])
    inside, outside = +sides[1], +sides[0]
    return (inside, outside) if inside else (Counter(), Counter())


def weights(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Log odds of each kind of token and each feature, smoothed; tags stay negative and plain words positive, as the scan needs."""
    found = dict(PRIOR)
    a, b = (sum(side.get(k, 0) for k in PRIOR) for side in (inside, outside))
    if a and b:
        odds = lambda k, n, m: math.log((inside.get(k, 0) + 1) / (n + len(PRIOR))) - math.log((outside.get(k, 0) + 1) / (m + len(PRIOR)))
        for kind in ("tag", "text", "link"):
            found[kind] = odds(kind, a, b)
        found["text"] = min(max(found["text"], 0.1), MOST / 2)
        found["tag"] = max(min(found["tag"], -0.1), -found["text"] / 2)  # a block of one word is worth the tags around it
        found["link"] = min(found["link"], found["text"])
        words_a, words_b = (side.get("text", 0) + side.get("link", 0) for side in (inside, outside))
        for k in {*inside, *outside}:
            if k.startswith("of ") and inside.get(k, 0) + outside.get(k, 0) >= FEW:
                found[k] = min(max(odds(k, words_a, words_b), -MOST / 2), MOST / 2)
    return found


def scan(run: list[tuple[str, str, bool, int, float]], tag: float, aside_word: float) -> tuple[int, int]:
    """Start and end of the region of the highest sum, of pieces whose last field is the weight of a word of theirs."""
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for i, (kind, value, aside, _, word) in enumerate(run):
        if kind in ("text", "link"):
            total += aside_word if aside else word * len(_WORD.findall(value))  # what is left out anyway parts no content
        else:
            total += tag
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best[0]:
            best = (total, start, i + 1)
    return best[1], best[2]


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The text of the region of the highest sum, blocks parted by line feeds."""
    marks = 0  # the sum of the open features, in millionths, so that it comes back to itself
    active: Counter = Counter()
    worth = {k[3:]: round(v * 1e6) for k, v in weight.items() if k.startswith("of ")}

    def opened(own: list[str]) -> None:
        nonlocal marks
        for f in own:
            active[f] += 1
            if active[f] == 1:
                marks += worth.get(f, 0)

    def closed(own: list[str]) -> None:
        nonlocal marks
        for f in own:
            active[f] -= 1
            if not active[f]:
                marks -= worth.get(f, 0)

    run = []
    for kind, value, aside, content in pieces(page or "", opened, closed):
        run.append((kind, value, aside, content, min(max(weight[kind] + marks / 1e6, -MOST), MOST) if kind in ("text", "link") else 0.0))
    start, end = scan(run, weight["tag"], weight["aside"])
    # the block in which the region starts and the one in which it ends are taken whole
    while start and run[start - 1][0] != "break":
        start -= 1
    while end < len(run) and run[end][0] != "break":
        end += 1
    told = [content for kind, value, aside, content, _ in run[start:end] if kind in ("text", "link") and not aside and not value.isspace()]
    if told and told[0] and told[0] == told[-1]:

        def goes_on(piece: tuple[str, str, bool, int, float]) -> bool:
            kind, value, aside, content, word = piece
            return content == told[0] and (kind not in ("text", "link") or aside or value.isspace() or word > 0)

        while start and goes_on(run[start - 1]):
            start -= 1
        while end < len(run) and goes_on(run[end]):
            end += 1
    blocks, block = [], []
    for kind, value, aside, _, _ in run[start:end]:
        if kind == "break":
            blocks.append("".join(block))
            block = []
        elif kind != "tag" and not aside:
            block.append(value)
    blocks.append("".join(block))
    return "\n".join(x for x in (_SPACE.sub(" ", b).strip() for b in blocks) if x)


def main_texts(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages(page_id, url, html)."""
    rate = min(1.0, sample / max(1, pages.count()))
    chosen = pages.where(F.pmod(F.xxhash64("html"), F.lit(1_000_003)) < rate * 1_000_003).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column("html"):
                a, b = features(page.as_py() or "")
                inside += a
                outside += b
        for k, x in (("inside", inside), ("outside", outside)):
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.string()), pa.array(list(x), pa.string()), pa.array(list(x.values()), pa.int64())], ["place", "kind", "n"])

    counts = chosen.mapInArrow(count, "place string, kind string, n long").groupBy("place", "kind").agg(F.sum("n").alias("n")).collect()
    weight = weights(*({r["kind"]: r["n"] for r in counts if r["place"] == p} for p in ("inside", "outside")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), weight) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
