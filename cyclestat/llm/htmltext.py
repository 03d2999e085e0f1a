"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is read once into a sequence of text runs and tags.  A run of words scores a point
a word, a tag loses its cost; the contiguous stretch with the largest sum, found by one
linear scan, is the content.  Its text is cut into blocks at block-level tags, white space
in a block becomes one space, and blocks are joined by ``\\n\\n``.

Costs are learned from labelled pages, those that mark their content with one ``article``
or ``main`` element: a kind of tag (its name with its first class) costs
``log(1 + (outside + 1/2) / (inside + 1/2))``, counted over such elements outside and inside
of marked content.  A kind that was seen outside ``least`` times or more and never inside
content, nor around it, is furniture if it has a class: its elements leave the sequence with all they hold.  So do
elements that HTML defines or names for such uses (menus, headers and footers of the page,
forms, scripts, adverts, notices, reader comments).  A name counts if a class, id or role
consists of such words and of words of place (``sidebar``, ``site-footer``), not if it says something else as well
(``has-sidebar``, ``market-share``); such elements only cost more.  A named element or a form stays where it
holds a ``main``, or an ``article`` while no article would stay otherwise, or was learned to lie
around content; a form also where it holds most of the page's words; and where nothing would be left of a page,
names and forms are not used on it.

Where the best stretch lies for the most part in an ``article`` or ``main``, the content is the smallest such element as
a whole, so that a list at its end or a run of links in its middle does not cut it.

Broken markup: comments, tags and raw text that never end take the rest of the page; end tags
without a start are ignored; an end tag closes what is open inside its element.  A null or
empty page, or one without words, has the text "".  Of equal stretches the first and shortest is
taken.  Pages are independent of each other, repeated ones get equal texts; an empty table gives
none.  Pages are read whole, whatever their length.  ``text`` may not be the name of a column that is kept.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cyclestat.llm.common import in_task
from cyclestat.llm.textbytes import batches

# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("body head html td th tr tbody thead tfoot caption li dd dt".split())
_SELF_ENDING = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FURNITURE = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav aside footer button select option"
    " textarea input label dialog menu title".split()
)
_CONTENT = ("article", "main")
#: Words of a class, id or role that name furniture.
_NAMED = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments comentarios consent cookie cookies disqus footer"
    " hidden kommentare masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies"
    " respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)

#: Words of place and form, which may stand beside a word above in a name of furniture.
_PLACES = frozenset("site global top bottom left right inner outer box block area wrapper container list item items body primary secondary".split())
_NAMED_COST = 5.0

_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-zA-Z]+")


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """``(what, name, text)``: what is "text", "open" or "close"; text of an open tag is its attributes."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = _COMMENT_END.search(page, lt + 4)
            at = end.end() if end else n
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
        elif not page[lt + 1 : lt + 2].isalpha() and not (page[lt + 1 : lt + 2] == "/" and page[lt + 2 : lt + 3].isalpha()):
            if lt + 1 >= n or (page[lt + 1] == "/" and lt + 2 >= n):
                return  # cut off within a tag
            yield "text", "", "<"
            at = lt + 1
        else:
            tag = _TAG.match(page, lt)
            if tag:
                at, name, rest = tag.end(), tag[1].lower(), tag[2]
            else:
                end = page.find(">", lt)  # an open quote
                if end < 0:
                    return
                at, name, rest = end + 1, _TAG_NAME.match(page, lt)[1].lower(), ""
            if page[lt + 1] == "/":
                yield "close", name, ""
                continue
            yield "open", name, rest
            if name in _RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                yield "text", "", page[at : end.start() if end else n]
                at = end.start() if end else n


_FORM = re.compile("<form", re.I)
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")


def names_furniture(token: str) -> int:
    """2: the token names furniture as a whole; 1: a word of it does, beside others; 0: none."""
    words = _NAME.findall(token)
    if _NAMED.isdisjoint(words):
        return 0
    return 2 if all(w in _NAMED or w in _PLACES for w in words) else 1


def kind_of(name: str, attributes: str) -> tuple[str, int]:
    """Kind of a tag, and how its class, id or role name furniture (``names_furniture``)."""
    named, first = 0, ""
    for m in _ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        tokens = (m[2] or m[3] or m[4] or "").lower().split()
        named = max([named, *map(names_furniture, tokens)])
        if m[1].lower() == "class" and not first:
            first = " ".join(_NAME.findall(tokens[0])) if tokens else ""
    return (f"{name}.{first}" if first else name), named


class Walk:
    """Goes through a page with a stack of open elements."""

    def __init__(self) -> None:
        self.stack: list[list] = []  # name, kind, whether it is dropped, place in a list of the caller
        self.dropped = 0

    def close_to(self, depth: int) -> list[list]:
        gone = self.stack[depth:]
        del self.stack[depth:]
        self.dropped -= sum(e[2] for e in gone)
        return gone

    def implied(self, name: str) -> list[list]:
        """Elements that the start of ``name`` ends."""
        gone = []
        ends = _SELF_ENDING.get(name, ())
        while self.stack and (self.stack[-1][0] in ends or (self.stack[-1][0] == "p" and (name in _CLOSES_P or name in _SELF_ENDING))):
            gone += self.close_to(len(self.stack) - 1)
        if name in _CLOSES_P:  # a p further out, below inline elements
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    return gone + self.close_to(i)
                if self.stack[i][0] in _BLOCK:
                    break
        return gone

    def open(self, name: str, kind: str, drop: bool, extra=None) -> None:
        if name not in _VOID:
            self.stack.append([name, kind, drop, extra])
            self.dropped += drop

    def end(self, name: str) -> list[list]:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                return self.close_to(i)
        return []

    def inside(self, *names: str) -> bool:
        return any(e[0] in names for e in self.stack)


def is_furniture(walk: Walk, name: str, named: int, kept: bool = False) -> bool:
    """Whether HTML defines an element for such use, or its class, id or role names it so.  A form
    is, unless it is ``kept`` (a page's content may lie in one)."""
    if name == "header" and not walk.inside(*_CONTENT):
        return True
    if name == "form":
        return not kept
    return name in _FURNITURE or (named == 2 and name not in ("html", "body", *_CONTENT))


def surrounding(page: str) -> set[int]:
    """Places, among the page's start tags, of named elements and forms that hold its content's mark,
    and of forms that hold most of its words."""
    walk, at, held = Walk(), -1, {c: [] for c in _CONTENT}
    words, in_form = 0, Counter()
    counts = _FORM.search(page) is not None
    for what, name, text in scan(page):
        if what == "close":
            walk.end(name)
        elif what == "text":
            if counts and not walk.dropped:
                n = len(text.split())
                words += n
                in_form.update({e[3]: n for e in walk.stack if e[0] == "form"})
        elif what == "open":
            at += 1
            walk.implied(name)
            kind, named = kind_of(name, text)
            defined = is_furniture(walk, name, 0, kept=True)
            if not walk.dropped and (name == "main" or (name == "article" and not named)):
                held[name].append({e[3] for e in walk.stack if e[3] is not None})
            walk.open(name, kind, defined, at if not defined and is_furniture(walk, name, named) else None)
    articles = [] if set() in held["article"] else held["article"]
    return set().union(*held["main"], *articles, (f for f, n in in_form.items() if 2 * n > words))


def tag_counts(page: str) -> dict[str, tuple[int, int, int]] | None:
    """Elements per kind: inside the marked content, around it, elsewhere; furniture left out.

    None if the page is not labelled.
    """
    walk, counts, marks, at, kept = Walk(), Counter(), 0, -1, surrounding(page)
    for what, name, text in scan(page):
        if what == "close":
            walk.end(name)
        elif what == "open":
            at += 1
            walk.implied(name)
            kind, named = kind_of(name, text)
            drop, inside = is_furniture(walk, name, 0 if at in kept else named, at in kept), walk.inside(*_CONTENT)
            if name in _CONTENT and not inside and not walk.dropped:
                marks += 1
                for e in walk.stack:
                    if not e[3]["around"]:
                        e[3]["around"] = True
                        counts[e[1], "out"] -= 1
                        counts[e[1], "around"] += 1
                counts[kind, "around"] += 1
            elif not walk.dropped and (not drop or (named == 2 and not inside)):
                counts[kind, "in" if inside else "out"] += 1
            walk.open(name, kind, drop, {"around": inside or name in _CONTENT})
    if marks != 1:
        return None
    return {k: (counts[k, "in"], counts[k, "around"], counts[k, "out"]) for k in {k for k, _ in counts}}


class Extractor:
    """Costs and furniture of a fitted model, and the extraction."""

    def __init__(self, kinds: dict[str, tuple[int, int, int]], least: int) -> None:
        self.cost = {k: math.log1p((o + 0.5) / (i + a + 0.5)) for k, (i, a, o) in kinds.items()}
        self.furniture = {k for k, (i, a, o) in kinds.items() if o >= least and not i and not a and "." in k}
        self.around = {k for k, (i, a, o) in kinds.items() if a > o and "." in k}

    def price(self, name: str, kind: str, named: int = 0) -> float:
        cost = self.cost.get(kind, self.cost.get(name, 1.0))
        return max(cost, _NAMED_COST) if named and kind not in self.cost and name not in ("html", "body", *_CONTENT) else cost

    def sequence(self, page: str, names: bool = True) -> tuple[list[tuple[str, object]], list[tuple[int, int]]]:
        """Text runs ``("text", str)`` and tags ``("tag", (cost, ends a block))`` outside furniture,
        and where in them each ``article`` or ``main`` begins and ends.

        Without ``names``, what a class, id or role names costs more but is not furniture, nor are forms.
        """
        walk, out, at, spans = Walk(), [], -1, []
        kept = surrounding(page) if names else set()

        def ended(gone: list[list]) -> None:
            spans.extend((e[4], len(out)) for e in gone if len(e) > 4)

        def tag(name: str, kind: str, named: int) -> None:
            if not walk.dropped:
                out.append(("tag", (self.price(name, kind, named), name in _BLOCK, name == "br")))

        for what, name, text in scan(page):
            if what == "text":
                if not walk.dropped:
                    out.append(("text", html.unescape(text)))
            elif what == "open":
                at += 1
                ended(walk.implied(name))
                kind, named = kind_of(name, text)
                trusted = names and at not in kept and kind not in self.around
                drop = is_furniture(walk, name, named if trusted else 0, not names or at in kept) or (kind in self.furniture and (names or not named))
                if drop and not walk.dropped:
                    out.append(("tag", (0.0, name in _BLOCK, False)))
                elif not drop:
                    tag(name, kind, named)
                walk.open(name, kind, drop, 0 if drop else named)
                if name in _CONTENT and not walk.dropped:
                    walk.stack[-1].append(len(out))
            else:
                gone = walk.end(name)
                ended(gone)
                if gone:
                    tag(name, gone[0][1], gone[0][3])
        ended(walk.close_to(0))
        return out, spans

    def text(self, page: str | None) -> str:
        return self.best(*self.sequence(page or "")) or self.best(*self.sequence(page or "", names=False))

    def best(self, items: list[tuple[str, object]], spans: list[tuple[int, int]]) -> str:
        best, best_at, total, start = 0.0, (0, 0), 0.0, 0
        for i, (what, value) in enumerate(items):
            if total <= 0.0:
                total, start = 0.0, i
            total += len(value.split()) if what == "text" else -value[0]
            if total > best:
                best, best_at = total, (start, i + 1)
        best_at = _whole(items, best_at, spans)
        blocks, block = [], []
        for what, value in [*items[slice(*best_at)], ("tag", (0.0, True, False))]:
            if what == "text":
                block.append(value)
            elif value[1]:
                if words := "".join(block).split():
                    blocks.append(" ".join(words))
                block = []
            elif value[2]:
                block.append(" ")
        return "\n\n".join(blocks)


def _whole(items: list[tuple[str, object]], region: tuple[int, int], spans: list[tuple[int, int]]) -> tuple[int, int]:
    """The smallest ``article`` or ``main`` that holds most of the region's words, else the region."""
    if not spans:
        return region
    words = [0]
    for what, value in items:
        words.append(words[-1] + (len(value.split()) if what == "text" else 0))
    here = words[region[1]] - words[region[0]]
    shared = lambda a, b: words[max(a, min(b, region[1]))] - words[max(a, min(b, max(a, region[0])))]
    holders = [s for s in spans if 2 * shared(*s) > here]
    return min(holders, key=lambda s: words[s[1]] - words[s[0]]) if holders else region


# -- tasks ------------------------------------------------------------------------


def count_tags(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, "html"):
        total: dict[str, list[int]] = {}
        for page in batch.column("html").to_pylist():
            for kind, n in (tag_counts(page or "") or {}).items():
                own = total.setdefault(kind, [0, 0, 0])
                for i in range(3):
                    own[i] += n[i]
        columns = [pa.array(list(total), pa.string()), *(pa.array([v[i] for v in total.values()], pa.int64()) for i in range(3))]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "inside", "around", "outside"])


_fitted: dict[str, Extractor] = {}


def release() -> None:
    """Let go the fitted model."""
    _fitted.clear()


def extract_pages(source: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    name, kinds, least = model.value
    if name not in _fitted:
        _fitted.clear()
        _fitted[name] = Extractor(kinds, least)
    for batch in batches(source, "_html"):
        texts = [_fitted[name].text(page) for page in batch.column("_html").to_pylist()]
        kept = [c for c in batch.schema.names if c != "_html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])


# -- the operator -----------------------------------------------------------------


def fit(pages: DataFrame, html_col: str = "html", kinds: int = 20_000, least: int = 20):
    """A broadcast model from all labelled pages.

    The ``kinds`` most frequent kinds of tags are learned, which bounds what is broadcast; others
    cost as their name does.
    """
    counted = pages.select(F.col(html_col).alias("html")).mapInArrow(in_task("htmltext", "count_tags"), "kind string, inside long, around long, outside long")
    sums = counted.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("inside", "around", "outside")))
    top = sums.orderBy(F.desc(F.col("inside") + F.col("around") + F.col("outside")), "kind").limit(kinds).collect()
    table = {r["kind"]: (r["inside"], r["around"], r["outside"]) for r in top}
    return pages.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, table, least))


def extract(pages: DataFrame, model, keep: list[str], html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: the columns ``keep`` and ``text``."""
    if "text" in keep:
        raise ValueError("column text is made here; rename it first")
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(in_task("htmltext", "extract_pages", model), f"{types}, text string")
