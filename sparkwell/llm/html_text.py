"""Main text of web pages as a maximum-scoring stretch of words and tags.

A page is read as a line of events: words and tags.  Words score by the element that
holds them and by the signs (element names, words of class, id and role) of all elements
around them, tags score below zero, both by weights learned from pages that mark their
article.  The mark itself is no weight, only a border that is dear to cross, so pages are
read alike with and without marks.  One linear scan finds the contiguous stretch with the
greatest sum; a second one, over the negated sums of the stretch's blocks, finds the parts
inside it that are no text (an advert between two paragraphs).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import narrow_batches, tidy

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul""".split()
)
#: Elements of running text and the page itself; their names are no sign of what
#: part of the page they are.
PLAIN = frozenset(
    """html body article main div span p a b i u em strong small big sub sup font code pre blockquote h1 h2 h3 h4 h5 h6
    ul ol li dl dt dd table caption tbody thead tfoot tr td th br hr img figure figcaption details summary center abbr
    cite q s del ins mark time var kbd samp tt label picture""".split()
)
# Elements that the HTML standard sets apart from the main content, which
# count as -SIGN until pages say otherwise, and elements that are not shown as text.
APART = frozenset("nav aside footer form header dialog menu".split())
UNSEEN = frozenset("head noscript template button select datalist svg math canvas object audio video".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/><]*")
_STOP = re.compile(r"""[<>]|"[^"<]*"|'[^'<]*'|["']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_WORD = re.compile(r"[^a-z0-9]+")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
#: Elements that a start tag of the same kind, or of a block, ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = frozenset("a li td th h1 h2 h3 h4 h5 h6 p pre blockquote figcaption".split())

#: Of words of a kind never met, of tags never met, the best that a tag can have, the
#: bounds of words' and tags' weights, that of signs', and the border of a marked article.
WORD, TAG, MILD, LOWEST, HIGHEST, SIGN, BORDER = 0.5, -0.25, -0.01, -3.0, 3.0, 6.0, -20.0
#: The most that parts without text between two pieces of text cost the stretch; sum of
#: blocks below which they are cut out of it; least words that a learned weight rests on.
PART, INNER, LEAST = -2.0, -2.0, 20

#: An event: kind, words in it, text (None for tags), whether it ends a block, whether
#: it is in an article element, whether it is not shown, and the worth of its signs.
Event = tuple[str, int, str | None, bool, bool, bool, float]


def _unescaped(text: str) -> str:
    """Character references decoded; numbers beyond all characters give U+FFFD."""
    return html.unescape(_HUGE.sub("�", text)) if "&" in text else text


def signs(name: str, raw: str, inside: bool) -> tuple[set[str], bool]:
    """What may tell which part of the page an element is: its name and, with a dot
    before, the words of its class, id and role; and whether it is hidden.
    ``inside``: it is part of an article, whose own header belongs to it."""
    found = set() if name in PLAIN else {name}
    hidden = False
    if "=" in raw or "hidden" in raw.lower():
        a = {m[1].lower(): _unescaped(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))
        if name not in ("html", "body", "article", "main"):
            words = _NOT_WORD.split(f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".lower())
            found.update(f".{w}" for w in words if w and not w.isdigit())
    if inside:
        found -= {"header", ".header"}
    return found, hidden


def prior(sign: str) -> float:
    """The weight of a sign of which no page says anything."""
    return -SIGN if sign in APART else 0.0


class Parts:
    """Counts words in and out of articles under each sign, for learning."""

    def __init__(self) -> None:
        self.counts: dict[str, list[int]] = {}
        self.total = [0, 0]
        self._open: dict[str, list[int]] = {}

    def opened(self, found: set[str]) -> None:
        for s in found:
            depth = self._open.setdefault(s, [0, 0, 0])
            if not depth[0]:
                depth[1:] = self.total
            depth[0] += 1

    def closed(self, found: set[str]) -> None:
        for s in found:
            depth = self._open[s]
            depth[0] -= 1
            if not depth[0]:
                n = self.counts.setdefault(s, [0, 0])
                n[0] += self.total[0] - depth[1]
                n[1] += self.total[1] - depth[2]


def events(page: str, weights: dict[str, float] | None = None, parts: Parts | None = None) -> list[Event]:
    """The page as words and tags in order, in one pass.

    Hidden and ``UNSEEN`` elements are not shown.  Raw elements (scripts, styles) are
    tags without words.  A tag ends at the first
    ``>`` outside quotes, or, if quotes or the next ``<`` do not allow that, at
    the first ``>``; without any to come all else is text.  Elements that
    nothing closes end with the element around them.  Each step moves on, or
    takes off the stack what an earlier one put there, so time grows with the
    length of the page whatever it holds.
    """
    weights = weights or {}
    out: list[Event] = []
    # of each open element: name, kind of words, not shown, signs, worth of all signs
    stack: list[tuple[str, str, bool, set[str], float]] = []
    count: Counter[str] = Counter()
    articles, at, end = 0, 0, len(page)
    last = page.rfind(">")

    def add(what: str, n: int, text: str | None, ends: bool, cut: bool) -> None:
        out.append((what, n, text, ends, articles > 0, cut, stack[-1][4] if stack else 0.0))
        if parts:
            parts.total[articles <= 0 or cut] += n

    def is_cut() -> bool:
        return bool(stack) and stack[-1][2]

    def words(text: str) -> None:
        if text := _unescaped(text):
            add("word:" + (stack[-1][1] if stack else "other"), len(text.split()), text, False, is_cut())

    def close(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            name, _, _, found, _ = stack.pop()
            count[name] -= 1
            articles -= name in ("article", "main")
            if parts:
                parts.closed(found)

    held = 0  # where text not yet written begins
    while at < end:
        start = page.find("<", at)
        if start > last:  # no tag ends any more; an open comment may still begin
            start = page.find("<!--", start)
        if start < 0:
            break
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            words(page[held:start])
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = held = end if stop < 0 else stop + 3
            else:
                at = held = page.find(">", start) + 1
            continue
        m = _NAME.match(page, start + 1)
        if not m:
            at = start + 1
            continue
        words(page[held:start])
        stop = m.end()
        while True:
            found = _STOP.search(page, stop)
            if found is None or found[0] in ("<", '"', "'"):
                stop = page.find(">", m.end())
                break
            if found[0] == ">":
                stop = found.start()
                break
            stop = found.end()
        raw = page[m.end() : stop]
        at = held = stop + 1
        name = m[0].lower()
        if name[0] == "/":
            name = name[1:]
            cut = is_cut()
            if count[name] > 0:
                depth = len(stack)
                while stack[depth - 1][0] != name:
                    depth -= 1
                cut = stack[depth - 1][2]
                close(depth - 1)
            add("/" + name, 0, None, name in BLOCKS, cut)
            continue
        if name in _ENDS and stack and stack[-1][0] in _ENDS[name] or name in BLOCKS and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name in RAW:
            gone = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = held = gone.start() if gone else end
            add(name, 0, None, name in BLOCKS, True)
            continue
        here, hidden = signs(name, raw, articles > 0)
        cut = is_cut() or hidden or name in UNSEEN
        add(name, 0, " " if name == "br" else None, name in BLOCKS, cut)
        if name in VOID or raw.endswith("/") and name not in BLOCKS:
            continue
        kind = ("h" if name[0] == "h" else name) if name in _HOLDERS else stack[-1][1] if stack else "other"
        worth = (stack[-1][4] if stack else 0.0) + sum(weights.get(s, prior(s)) for s in sorted(here))
        stack.append((name, kind, cut, here, worth))
        count[name] += 1
        articles += name in ("article", "main")
        if parts:
            parts.opened(here)
    words(page[held:])
    close(0)
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous part with the greatest sum; the first and
    shortest of equals, empty if no sum is above zero."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def maximal_stretches(values: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring stretches (Ruzzo and Tompa, 1999): the best one, then the best
    of what is left on either side, and so on; in linear time."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before it, sum with it
    lower: list[int] = []  # of each, the last one before it with a smaller sum before it
    total = 0.0
    for i, x in enumerate(values):
        total += x
        if x <= 0:
            continue
        begin, before = i, total - x
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = lower[j]
            if j < 0 or found[j][3] >= total:
                break
            begin, before = found[j][0], found[j][2]
            del found[j:], lower[j:]
        found.append((begin, i + 1, before, total))
        lower.append(j)
    return [f[:2] for f in found]


def word_score(kind: str, worth: float, weights: dict[str, float]) -> float:
    return max(LOWEST, min(HIGHEST, weights.get(kind, WORD) + worth))


def scores(seen: list[Event], weights: dict[str, float]) -> list[float]:
    """A score for each event: words by kind and signs, tags by theirs, zero at most.

    What is not shown scores nothing.  Parts whose signs weigh against them cost
    ``PART`` at most until text comes again, so that an advert does not part an article.
    """
    out: list[float] = []
    left = PART
    for kind, n, _, _, _, cut, worth in seen:
        x = 0.0
        if kind.strip("/") in ("article", "main"):
            x = BORDER
        elif not cut:
            x = n * word_score(kind, worth, weights) if kind.startswith("word:") else min(MILD, weights.get("<" + kind, TAG))
            if worth < 0 and x < 0:
                x = max(x, left)
                left -= x
            elif x > 0:
                left = PART
        out.append(x)
    return out


def main_text(page: str, weights: dict[str, float], scan: bool = True, inner: bool = True) -> str:
    """Blocks of the best stretch, white space made one space, joined by one.  Without
    ``scan`` the stretch is the whole page, without ``inner`` nothing is cut out of it."""
    seen = events(page, weights)
    begin, end = best_stretch(scores(seen, weights)) if scan else (0, len(seen))
    blocks: list[list[str]] = [[]]
    worth = [0.0]
    for kind, n, text, ends, _, cut, signs_ in seen[begin:end]:
        if ends:
            blocks.append([])
            worth.append(0.0)
        if text and not cut:
            blocks[-1].append(text)
            worth[-1] += n * word_score(kind, signs_, weights)
    gone: set[int] = set()
    if inner:
        for i, j in maximal_stretches([-w for w in worth]):
            if sum(worth[i:j]) < INNER:
                gone.update(k for k in range(i, j) if worth[k] < 0)  # text between two adverts stays
    return " ".join(x for i, b in enumerate(blocks) if i not in gone and (x := " ".join("".join(b).split())))


def _odds(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    a, b = sum(r[1] for r in rows), sum(r[2] for r in rows)
    of = ((k, math.log((x + 1) / (a + len(rows))) - math.log((y + 1) / (b + len(rows)))) for k, x, y in rows)
    return {k: max(LOWEST, min(HIGHEST, w)) for k, w in of}


def weights_of(counts: list[tuple[str, int, int]]) -> dict[str, float]:
    """Weights from rows of a kind (``word:`` and a holder, ``<`` and a tag, or a
    sign), how much of it lies in articles, and how much outside.

    Words and tags have the log-odds of their kind; words that do not mostly
    lie outside have ``WORD`` at least.  A sign has the log-odds of the words under it.
    """
    tags = [r for r in counts if r[0].startswith("<")]
    held = [r for r in counts if r[0].startswith("word:")]
    out = _odds(tags) | {k: max(WORD, w) if a >= b else w for (k, a, b), w in zip(held, _odds(held).values(), strict=True)}
    for k, a, b in counts:
        if not k.startswith(("<", "word:")):
            out[k] = max(-SIGN, min(SIGN, math.log((a + 1) / (b + 1))))
    return out


def learn_weights(pages: DataFrame, most_pages: int = 2000) -> dict[str, float]:
    """Weights from pages that mark their article with an element of that name:
    the words in it are inside, all others outside.  The mark itself teaches nothing
    else, so the weights serve pages without marks.

    Of at most about ``most_pages`` pages, those with the smallest hashes.
    Kinds with fewer than ``LEAST`` words or tags are left out, which bounds
    what reaches the driver by the words of those pages.  Null pages and pages
    without a mark are passed over; no pages give no weights.
    """
    share = min(1.0, most_pages / max(1, pages.count()))
    chosen = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("html")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for page in batch.column(0).to_pylist():
                parts = Parts()
                seen = events(page or "", None, parts)
                if not any(x[4] and x[1] for x in seen):
                    continue
                for kind, words, _, _, article, cut, _ in seen:
                    if kind.startswith("word:"):
                        n[article][kind] += 0 if cut else words
                    elif not cut and kind.strip("/") not in ("article", "main"):
                        n[article]["<" + kind] += 1
                for sign, (a, b) in parts.counts.items():
                    n[1][sign] += a
                    n[0][sign] += b
        keys = sorted(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())],
            ["kind", "inside", "outside"],
        )

    sums = chosen.mapInArrow(tidy(counted), "kind string, inside long, outside long").groupBy("kind")
    rows = sums.agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).where(F.col("a") + F.col("b") >= LEAST).orderBy("kind")
    return weights_of([(r["kind"], r["a"], r["b"]) for r in rows.collect()])


def extract(pages: DataFrame, most_pages: int = 2000) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) of every row.

    Null and empty pages, and pages without words, have the empty text.
    Repeated rows give equal rows; rows without a ``page_id`` are read like
    others.  An empty table gives no rows.  Very long and broken pages are read
    in time that grows with their length.  Other columns are ignored.
    """
    narrow_batches(pages.sparkSession)
    weights = learn_weights(pages, most_pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "", weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(tidy(read), "page_id long, url string, text string, n_chars long")
