"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of tags (and classes) from the root. For every
distinct path two ratios are formed: characters of text outside links per node on the path, and punctuation
marks per node. Both are smoothed over neighbouring paths in page order and fused, with the path's own characters, into one
weight (the root of their product); what markup says of a path (its elements are named as boilerplate, or lie in an article or
main element) scales the weight. Paths whose weight reaches ``share`` of the mean weight are content paths.

Selection is block by block:

* blocks on content paths are content;
* so is every other block of the region that the content paths span, down to the shortest: their lowest common
  ancestor, or the article and main elements where these hold most of the characters on content paths (of several articles the one that holds most,
  those of its own path, and others only with half as much on content paths). Where that ancestor is only the
  page's body, the region ends with the first and last content block, and blocks that are mostly links don't belong to it;
* and so are the headings right in front of the region;
* a block inside an element that markup calls boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
  reader comments, by tag, role, or the name that a class or id gives them) is content only if its path is one all the same, at a hundredth of its weight. Such a
  name doesn't hold for an element around the page's article, or around most of the content where no article is marked; inside an
  article the names of ordinary things (a search, a menu, a banner) hold only for elements that are mostly links or have controls; and a named
  inline element is part of its sentence: it goes only where it is all of its block.

White space inside a block becomes one space, blocks are joined by a line feed, character references
are decoded. Reading takes time in proportion to the page's size, also for unclosed quotes and deep nesting.

Edge cases: null and empty pages, and pages without content, give an empty text; unclosed elements
are closed as browsers do (a new paragraph ends the open one); a page that ends inside a comment, script or tag
loses only that; a bare ``<`` is text; pages of any length are read whole; repeated rows keep a row each; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import text_slices, texts_of

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"(?:(?<=[\s/\"'])|^)([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr img picture audio video object embed map area svg math canvas button".split()
)
_CONTROLS = frozenset("input button select textarea".split())
#: Elements that never hold article text.
_APART = frozenset("nav footer aside form select option fieldset dialog menu head script style noscript template iframe textarea title object".split())
#: Of these, elements that are never a layout wrapper.
_NEVER = frozenset("nav footer select option menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words that name boilerplate, as the last word of a class or id ("cookie-notice", "page-header").
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner banners cookie cookies"
    " consent gdpr notice notices notification notifications alert alerts sidebar sidebars aside menu menus nav navbar navigation breadcrumb"
    " breadcrumbs footer foot header masthead topbar toolbar comment comments discussion disqus replies reply respond share sharing social related"
    " recommended recommendations newsletter subscribe subscription signup popup modal overlay login form search widget pagination pager copyright"
    " skip response responses feedback reactions".split()
)
#: Of these, words that name ordinary things inside an article as well.
_ORDINARY = frozenset("search menu menus banner banners header head foot overlay skip form pager alert alerts reply respond response toolbar topbar promotion share".split())
#: Words for layout: a name in front of them is the element's own ("comment-list", "ad-container").
_LAYOUT = frozenset(
    "a area bar block body bottom box btn button buttons card cards center col column container content count entry feed footer group head header holder icon"
    " icons inner item items layer layout left level link links list main mobile module nav outer panel policy post posts row right section slot small space text the thread title"
    " toggle top unit view wrap wrapper zone".split()
)
#: Words that deny or only mention what follows ("no-sidebar", "page-with-menu").
_BESIDE = frozenset("has have no non not without with hide hides is".split())
#: Words that make a header the head of an article ("entry-header").
_ARTICLE = frozenset("entry post article story content title section chapter".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…、。，！？]")
#: An opening tag of the left side ends the open elements of these kinds, up to those walls.
_ENDS = {
    "li": ("li", {"li"}, {"ul", "ol", "menu"}),
    "term": ("dt dd", {"dt", "dd"}, {"dl"}),
    "row": ("tr", {"tr", "td", "th"}, {"table"}),
    "cell": ("td th", {"td", "th"}, {"tr", "table"}),
    "section": ("tbody tfoot", {"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ("option", {"option"}, {"select"}),
    "head": ("body", {"head"}, set()),
}
_ENDED_BY = {tag: i for i, (tags, _, _) in enumerate(_ENDS.values()) for tag in tags.split()}
_ROOMS = frozenset("html body div article section main table td th caption object".split())
#: What the markup's hints scale a path's weight by.
NAMED_APART, IN_ARTICLE = 0.01, 2.0


class _Node:
    """An open or closed element; what concerns its ancestors is carried down, so nothing walks up."""

    __slots__ = ("apart", "article", "controls", "depth", "ends", "flag", "flagged", "inline", "marked", "ordinary", "p", "parent", "path", "tag", "verbatim")

    def __init__(self, tag: str, parent: _Node | None, flagged: bool, path: int = 0, ordinary: bool = False):
        self.tag, self.parent, self.flagged, self.path = tag, parent, flagged, path
        self.depth = parent.depth + 1 if parent else 0
        #: Whether it, or an element around it, is named as boilerplate; the nearest such element.
        self.apart = flagged or (parent is not None and parent.apart)
        self.flag = self if flagged else parent.flag if parent else None
        #: Whether its name is one of ordinary things; whether it has controls of a form.
        self.ordinary, self.controls = ordinary, False
        #: Whether an article or main element holds it, itself included; the nearest article.
        self.marked = tag in ("article", "main") or (parent is not None and parent.marked)
        self.article = self if tag == "article" else parent.article if parent else None
        self.verbatim = tag in ("pre", "code") or (parent is not None and parent.verbatim)
        at = self.depth
        # Kinds of inline elements open around the place, the depth of the nearest open paragraph, and those
        # of the outermost open elements that tags of _ENDS end.
        self.inline = (parent.inline | {tag} if parent else frozenset({tag})) if tag in _INLINE else frozenset()
        self.p = at if tag == "p" else -1 if tag in _ROOMS or self.apart or parent is None else parent.p
        above = parent.ends if parent else (-1,) * len(_ENDS)
        self.ends = tuple(
            -1 if tag in walls else (at if was < 0 else was) if tag in kinds else was for was, (_, kinds, walls) in zip(above, _ENDS.values())
        )


class _Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, node: _Node, text: str, linked: int):
        #: ``linked``: characters inside links.
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> int:
        return self.node.path


def _words(value: str) -> list[str]:
    return [w for w in _SPLIT.split(_CAMEL.sub("-", value).lower()) if w and not w.isdigit()]


def names_boilerplate(token: str) -> bool:
    """Whether one class or id names an element as boilerplate."""
    words = _words(token)
    if not words or not _BESIDE.isdisjoint(words):
        return False
    if words[-1] in ("header", "head") and not _ARTICLE.isdisjoint(words[:-1]):
        return False
    return words[-1] in _NAMES or (words[0] in _NAMES and all(w in _LAYOUT or w in _NAMES for w in words[1:]))


def _ordinary(token: str) -> bool:
    """Whether the word that makes a name boilerplate is one of ordinary things."""
    words = _words(token)
    return (words[-1] if words[-1] in _NAMES else words[0]) in _ORDINARY


def _apart(tag: str, attrs: str, parent: _Node) -> tuple[bool, str, bool]:
    """(whether the element is named as boilerplate, its label in paths, whether only by names of ordinary things)."""
    label = tag
    named = tag in _APART or tag == "button" or (tag == "header" and not parent.marked)
    ordinary = False
    if attrs and tag in ("article", "main"):  # never boilerplate, whatever their names
        label += "".join(f".{m[2] or m[3] or m[4] or ''}" for m in _ATTR.finditer(attrs) if m[1].lower() == "class")
    elif attrs and tag not in ("html", "body"):
        bare = _ATTR.sub(" ", attrs).split() if "hidden" in attrs.lower() else ()
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                label += f".{value}" if name == "class" else ""
                hits = [] if named else [t for t in value.split() if names_boilerplate(t)]
                ordinary = ordinary or bool(hits) and all(map(_ordinary, hits))
                named = named or bool(hits)
            elif name == "role":
                named = named or value.strip().lower() in _ROLES
            elif name == "aria-hidden":
                named = named or value.strip().lower() == "true"
        named = named or any(x.strip("/").lower() == "hidden" for x in bare)
    return named, label, ordinary


def lost_blocks(found: list[_Block], most: float = 0.75) -> list[bool]:
    """Which blocks are inside flagged elements whose flags hold.

    Names of ordinary things hold inside an article only for elements that are mostly links or have controls. Another flag is spared, from
    the outside in, while no article or main element outside flags carries a part of the characters on content
    paths: first where the element holds such an element, else where it holds ``most`` of them.
    """
    if not any(b.node.apart for b in found):
        return [False] * len(found)
    sizes: dict[int, list[int]] = {}
    for b in found:
        if b.node.flag is not None:
            own = sizes.setdefault(id(b.node.flag), [0, 0])
            own[0] += len(b.text)
            own[1] += b.linked
    weights = path_weights(found)
    votes = [float(len(b.text) - b.linked) if b.path in weights else 0.0 for b in found]
    total = sum(votes)
    # Votes of each element, and those of them that lie in article and main elements; deepest elements first.
    share: dict[int, float] = {}
    inner: dict[int, float] = {}
    seen: dict[int, _Node] = {}
    for b, vote in zip(found, votes):
        share[id(b.node)] = share.get(id(b.node), 0.0) + vote
        inner[id(b.node)] = inner.get(id(b.node), 0.0) + (vote if b.node.marked else 0.0)
        at: _Node | None = b.node
        while at is not None and id(at) not in seen:
            seen[id(at)] = at
            at = at.parent
    ordered = sorted(seen.values(), key=lambda n: n.depth)
    for n in reversed(ordered):
        if n.parent is not None:
            for sums in (share, inner):
                sums[id(n.parent)] = sums.get(id(n.parent), 0.0) + sums.get(id(n), 0.0)
    # Flagged elements below each flagged one (0: below none), the nearest only.
    nearest: dict[int, int] = {}
    below: dict[int, list[_Node]] = {0: []}
    for n in ordered:
        nearest[id(n)] = 0 if n.parent is None else id(n.parent) if n.parent.flagged else nearest[id(n.parent)]
        if n.flagged:
            below.setdefault(nearest[id(n)], []).append(n)
    clear = sum(v for b, v in zip(found, votes) if b.node.marked and not b.node.apart)
    heap: list[tuple[float, float, int]] = []

    def offer(nodes: list[_Node]) -> None:
        for n in nodes:
            if n.tag not in _NEVER:
                held = 0.0 if n.parent is not None and n.parent.marked else inner.get(id(n), 0.0)
                heapq.heappush(heap, (-held, -share.get(id(n), 0.0), id(n)))

    offer(below[0])
    spared = {id(n) for n in ordered if n.flagged and n.ordinary and n.marked and not n.controls and 2 * sizes.get(id(n), (0, 0))[1] <= sizes.get(id(n), (0, 0))[0]}
    while heap and clear <= (1 - most) * total:
        held, own, key = heapq.heappop(heap)
        if not held and -own < most * total:
            break
        spared.add(key)
        under = below.get(key, [])
        clear += inner.get(key, 0.0) - sum(inner.get(id(n), 0.0) for n in under)
        offer(under)
    lost: dict[int, bool] = {}
    for n in ordered:
        lost[id(n)] = (n.flagged and id(n) not in spared) or (n.parent is not None and lost[id(n.parent)])
    return [lost[id(b.node)] for b in found]


def all_blocks(page: str) -> list[_Block]:
    """The page's blocks of text, in order."""
    root = _Node("", None, False)
    stack, out = [root], []
    text: list[str] = []
    linked = [0, 0]  # characters inside links of the block at hand, open links
    hushed = [0, 0]  # characters of the block at hand, those of them inside named inline elements
    named_inline: list[list] = []  # open ones: tag, open elements of that tag since, depth of the stack
    paths: dict[tuple[int, str], int] = {}
    count: dict[str, int] = {}

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                node = stack[-1]
                if hushed[0] and hushed[1] == hushed[0]:  # nothing but named inline elements
                    node = _Node("span", node, True, paths.setdefault((node.path, "span!"), len(paths) + 1))
                out.append(_Block(node, joined, min(linked[0], len(joined))))
        linked[0] = hushed[0] = hushed[1] = 0

    def say(piece: str) -> None:
        text.append(piece)
        if linked[1]:
            linked[0] += len(piece)
        if piece and not piece.isspace():
            hushed[0] += 1
            hushed[1] += bool(named_inline)

    def close(depth: int) -> None:
        flush()
        for node in stack[depth:]:
            count[node.tag] -= 1
        del stack[depth:]
        while named_inline and named_inline[-1][2] > len(stack):
            named_inline.pop()

    def push(tag: str, label: str, flagged: bool, ordinary: bool) -> None:
        above = stack[-1]
        path = paths.setdefault((above.path, label), len(paths) + 1)
        stack.append(_Node(tag, above, flagged or bool(named_inline), path, ordinary and not named_inline))
        count[tag] = count.get(tag, 0) + 1

    for kind, tag, attrs in _tokens(page):
        if kind == "text":
            say(attrs)
        elif tag in ("br", "wbr"):
            say(" " if tag == "br" else "")
        elif tag == "hr":
            flush()
        elif tag in _VOID or tag in _RAW:
            if tag in _CONTROLS and stack[-1].flag is not None:
                stack[-1].flag.controls = True
        elif tag in _INLINE and tag != "object":
            # Inline elements don't shape paths; named ones go with their block unless they are all of it.
            if tag == "a":
                linked[1] = int(kind == "open")
            if tag == "button" and stack[-1].flag is not None:
                stack[-1].flag.controls = True
            if attrs.rstrip().endswith("/"):
                continue
            if named_inline and named_inline[-1][0] == tag:
                named_inline[-1][1] += 1 if kind == "open" else -1
                if named_inline[-1][1] == 0:
                    named_inline.pop()
            elif kind == "open" and not stack[-1].verbatim and _apart(tag, attrs, stack[-1])[0]:
                named_inline.append([tag, 1, len(stack)])
        elif kind == "close":
            linked[1] = 0
            if count.get(tag, 0):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            else:
                flush()
        else:
            linked[1] = 0
            flush()
            if stack[-1].p >= 0:
                close(stack[-1].p)
            if tag in _ENDED_BY and stack[-1].ends[_ENDED_BY[tag]] >= 0:
                close(stack[-1].ends[_ENDED_BY[tag]])
            named, label, ordinary = _apart(tag, attrs, stack[-1])
            push(tag, label, named, ordinary)
    flush()
    return out


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", text), ("open", tag, attributes) and ("close", tag, ""), in one pass.

    A quote that no further one closes ends with its tag, at the next ``>``.
    """
    at, end = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", "", page[at:]
            return
        if begin > at:
            yield "text", "", page[at:begin]
        if page.startswith("<!--", begin):
            stop = re.compile("--!?>").search(page, begin + 4)
            at = stop.end() if stop else end
            continue
        if page.startswith("<![CDATA[", begin):
            stop = page.find("]]>", begin)
            yield "text", "", html.escape(page[begin + 9 : stop if stop >= 0 else end])
            at = stop + 3 if stop >= 0 else end
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            stop = page.find(">", begin)
            at = stop + 1 if stop >= 0 else end
            continue
        closing = page.startswith("/", begin + 1)
        name = _NAME.match(page, begin + 1 + closing)
        if name is None:
            yield "text", "", "<"
            at = begin + 1
            continue
        stop = name.end()
        while True:
            m = _STOP.search(page, stop)
            if m is None:
                stop = end
                break
            if m[0] == ">":
                stop = m.start()
                break
            if m.start() >= last[m[0]]:  # nothing closes this quote
                stop = page.find(">", m.end()) if last[">"] >= m.end() else end
                break
            stop = page.find(m[0], m.end()) + 1
        tag = name[0].lower()
        at = min(stop + 1, end)
        yield ("close", tag, "") if closing else ("open", tag, page[name.end() : stop])
        if tag in _RAW and not closing:
            ended = _raw_end(tag)(page, at)
            at = ended.start() if ended else end


def _raw_end(tag: str) -> Callable[..., re.Match[str] | None]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search


def path_weights(found: list[_Block], share: float = 0.75, lost: list[bool] | None = None) -> dict[int, float]:
    """The fused weight of each path that reaches the threshold; with ``lost`` blocks told, scaled by what markup says."""
    chars: dict[int, float] = {}
    marks: dict[int, float] = {}
    nodes: dict[int, int] = {}
    scale: dict[int, float] = {}
    for i, b in enumerate(found):
        bare = max(0, len(b.text) - b.linked)
        chars[b.path] = chars.get(b.path, 0) + bare
        marks[b.path] = marks.get(b.path, 0) + (len(_MARKS.findall(b.text)) if 2 * bare > len(b.text) else 0)
        nodes[b.path] = nodes.get(b.path, 0) + 1
        if lost is not None:
            scale[b.path] = (NAMED_APART if lost[i] else 1.0) * (IN_ARTICLE if b.node.marked else 1.0)
    paths = list(chars)
    own, points = ([x[p] / nodes[p] for p in paths] for x in (chars, marks))
    weights = [(o * x * (1 + y)) ** 0.5 * scale.get(p, 1.0) for p, o, x, y in zip(paths, own, _smooth(own), _smooth(points))]
    bar = min(share * sum(weights) / len(weights), max(weights))
    return {p: w for p, w in zip(paths, weights) if w >= bar}


def _smooth(values: list[float]) -> list[float]:
    """A three-point kernel over neighbours."""
    n = len(values)
    return [0.25 * values[max(i - 1, 0)] + 0.5 * values[i] + 0.25 * values[min(i + 1, n - 1)] for i in range(n)]


def content(found: list[_Block], most: float = 0.75) -> list[_Block]:
    """The blocks of the article, as the module's text says."""
    if not found:
        return []
    lost = lost_blocks(found, most)
    weights = path_weights(found, lost=lost)
    found = [b for b, gone in zip(found, lost) if not gone or b.path in weights]
    if not found:
        return []
    chosen = [b.path in weights for b in found]
    if not any(chosen):  # all content paths are boilerplate: what is left is weighed by itself
        weights = path_weights(found)
        chosen = [b.path in weights for b in found]
    votes = [max(1, len(b.text) - b.linked) if c else 0 for b, c in zip(found, chosen)]
    marked = [b.node.marked for b in found]
    if any(marked) and sum(v for v, m in zip(votes, marked) if m) >= most * sum(votes):
        keep = _articles(found, votes)
    else:
        titled = _with_headings(found, [c or b.node.tag == "h1" for b, c in zip(found, chosen)])
        home, inside = _region(found, titled)
        if home.tag in ("", "html", "body"):
            # Nothing but the page holds all of it: what lies around the content paths isn't content.
            first, last = titled.index(True), len(titled) - 1 - titled[::-1].index(True)
            keep = [c or (first < i < last and 2 * b.linked <= len(b.text)) for i, (b, c) in enumerate(zip(found, titled))]
        else:
            keep = inside
    return [b for b, k in zip(found, _with_headings(found, keep)) if k]


def _articles(found: list[_Block], votes: list[int]) -> list[bool]:
    """Blocks of main elements and of the articles that are the page's own: the one with most characters on content paths, those of its path, and such as have half as many.

    An article inside another is a part of it only where the outer one has no more of its own.
    """
    held: dict[int, int] = {}
    nodes: dict[int, _Node] = {}
    for b, v in zip(found, votes):
        if b.node.article is not None:
            nodes[id(b.node.article)] = b.node.article
            held[id(b.node.article)] = held.get(id(b.node.article), 0) + v
    if len(nodes) < 2:
        return [b.node.marked for b in found]
    best = max(held, key=lambda k: (held[k], -nodes[k].depth))
    own = {k for k, n in nodes.items() if n.path == nodes[best].path or 2 * held[k] >= held[best]}
    for k, n in nodes.items():
        outer = n.parent.article if n.parent is not None else None
        if outer is not None and k != best and held.get(id(outer), 0) >= held[k]:
            own.discard(k)
    return [b.node.marked and (b.node.article is None or id(b.node.article) in own) for b in found]


def _region(found: list[_Block], chosen: list[bool]) -> tuple[_Node, list[bool]]:
    """(the lowest common ancestor of the chosen blocks' elements, which blocks lie in it)."""
    seen: dict[int, _Node] = {}
    holding: dict[int, int] = {}
    for b, c in zip(found, chosen):
        holding[id(b.node)] = holding.get(id(b.node), 0) + c
        at: _Node | None = b.node
        while at is not None and id(at) not in seen:
            seen[id(at)] = at
            at = at.parent
    ordered = sorted(seen.values(), key=lambda n: n.depth)
    for n in reversed(ordered):
        if n.parent is not None:
            holding[id(n.parent)] = holding.get(id(n.parent), 0) + holding.get(id(n), 0)
    every = sum(chosen)
    home = [n for n in ordered if holding.get(id(n), 0) == every][-1]
    inside: dict[int, bool] = {}
    for n in ordered:
        inside[id(n)] = n is home or (n.parent is not None and inside[id(n.parent)])
    return home, [inside[id(b.node)] for b in found]


def _with_headings(found: list[_Block], keep: list[bool]) -> list[bool]:
    """Also keeps the headings right in front of the first kept block."""
    keep = list(keep)
    i = keep.index(True) - 1 if True in keep else -1
    while i >= 0 and found[i].node.tag in _HEADINGS:
        keep[i] = True
        i -= 1
    return keep


def extract(page: str) -> str:
    return "\n".join(b.text for b in content(all_blocks(page)))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(page_id, *keep, text, n_chars) for every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["page_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__html", 4 << 20):
                out = [extract(t.decode("utf-8", "replace")) for t in texts_of(part.column(len(names)))]
                arrays = [*(part.column(i) for i in range(len(names))), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "text", "n_chars"])

    cols = [F.col(id_col).alias("page_id"), *(F.col(c) for c in keep), F.col(html_col).alias("__html")]
    schema = ", ".join([f"page_id {kind}", *(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)])
    return pages.select(*cols).mapInArrow(run, schema + ", text string, n_chars bigint")
