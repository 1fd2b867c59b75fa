"""Markup for the web and for markdown: cleaning, rewriting and converting documents."""

from __future__ import annotations

import html
import posixpath
import re
from html.entities import html5

from pyspark.sql import Column, functions as F

from quire.functions.html import Node, parse, squeeze

# Names that decide what is removed or rewritten.
UNSAFE = (
    "script", "iframe", "object", "embed", "base", "noscript", "frame", "frameset", "applet", "meta", "link", "template", "portal",
    "animate", "animatemotion", "animatetransform", "set", "handler", "foreignobject",
)
UNWRAPPED = ("font", "center")
REMOVED = ("style", "class", "lang", "xml:lang")
URL_ATTRS = frozenset(
    "href src srcset action formaction data poster background longdesc usemap cite profile codebase values from to by".split()
)
SCHEMES = ("javascript:", "vbscript:", "data:text/html")
EXTERNAL = ("data:", "http:", "https:", "//", "#", "mailto:", "tel:", "ftp:", "file:", "blob:")
MEDIA = {
    "img": ("src", "srcset"), "source": ("src", "srcset"), "video": ("src", "poster"), "audio": ("src",), "track": ("src",),
    "object": ("data",), "embed": ("src",), "image": ("xlink:href", "href"), "use": ("xlink:href", "href"),
}
IMAGE_CLASS = "book-img"


def executable(url: str) -> bool:
    return "".join(c for c in url if not c.isspace() and ord(c) > 31).lower().startswith(SCHEMES)


def prefixed(document: str, url: str) -> str:
    """A relative URL as a path under content/."""
    if not url or url.strip().lower().startswith(EXTERNAL) or url.startswith("content/"):
        return url
    folder = posixpath.dirname(document)
    return "content/" + posixpath.normpath(f"{folder}/{url}" if folder else url)


def srcset(value: str) -> list[str]:
    """Candidates of a srcset; inside a data: URL only a comma before white space separates."""
    out, start = [], 0
    for m in re.finditer(",", value):
        inside = value[start : m.start()].lstrip().lower().startswith("data:")
        if not inside or value[m.end() : m.end() + 1].isspace():
            out.append(value[start : m.start()])
            start = m.end()
    return [*out, value[start:]] if start < len(value) else out


#: What may be a reference that was cut off, and what stands for its ampersand meanwhile: no text that Spark gives has a surrogate.
_CUT = re.compile(r"&(?=([b-z][a-z0-9]*)(?![A-Za-z0-9;]))")
_MARK = "\ud800"


def _kept_cut(m: re.Match) -> str:
    name = "&" + m[1]
    return _MARK if m[1] in html5 or html.unescape(name) == name else "&"


def cleaned(source: str, document: str | None = None) -> str:
    """A document without active content; with its path, its links and media point into the export.

    A reference that was cut off (``&quo``, or ``&quot`` without its semicolon) is text, and stays as it stands in the source. One that
    may be of ``&amp;`` is made whole, and so is any other ampersand.
    """
    root = parse(_CUT.sub(_kept_cut, source))
    for node in list(root.walk()):
        if node.parent is None:
            continue
        if node.local.lower() in UNSAFE:
            node.remove()
        elif node.tag in UNWRAPPED:
            node.unwrap()
    for node in root.walk():
        for name in list(node.attrs):
            local = name.rsplit(":", 1)[-1].lower()
            if name.lower().startswith("on") or name in REMOVED or (local in URL_ATTRS and executable(node.attrs[name])):
                del node.attrs[name]
        if node.tag == "img":
            node.attrs.setdefault("loading", "lazy")
            node.attrs.setdefault("decoding", "async")
            node.attrs["class"] = IMAGE_CLASS
        if document is not None:
            _rewrite(node, document)
    return root.inner().replace(_MARK, "&")


def _rewrite(node: Node, document: str) -> None:
    for name in MEDIA.get(node.local, ()):
        value = node.attrs.get(name)
        if value and name == "srcset":
            parts = [c.split(None, 1) for c in srcset(value) if c.strip()]
            node.attrs[name] = ", ".join(" ".join([prefixed(document, p[0].strip()), *p[1:]]) for p in parts)
        elif value:
            node.attrs[name] = prefixed(document, value)
    href = node.attrs.get("href")
    if node.tag == "a" and href and not href.lower().startswith(EXTERNAL):
        path, mark, fragment = href.partition("#")
        node.attrs["href"] = prefixed(document, path) + mark + fragment


def markdown(source: str, document: str = "", images: dict[str, str] | None = None) -> str:
    """Headings, paragraphs, lists, quotes, emphasis, links and images as markdown; lines aren't wrapped."""
    images = images or {}
    out: list[str] = []

    def inline(node: Node) -> str:
        parts = [node.text]
        for c in node.children:
            if c.tag == "br":
                parts.append("  \n")
            elif c.local in ("img", "image"):
                parts.append(_image(c, document, images))
            elif c.tag in ("em", "i", "cite") and c.content().strip():
                parts.append(f"_{inline(c).strip()}_")
            elif c.tag in ("strong", "b") and c.content().strip():
                parts.append(f"**{inline(c).strip()}**")
            elif c.tag == "code":
                parts.append(f"`{c.content()}`")
            elif c.tag == "a" and c.attrs.get("href") and c.content().strip():
                parts.append(f"[{inline(c).strip()}]({c.attrs['href']})")
            elif c.tag not in ("#comment", "script", "style", "head"):
                parts.append(inline(c))
            parts.append(c.tail)
        return "".join(parts)

    def line(text: str) -> str:
        return "  \n".join(squeeze(x) for x in text.split("  \n")).strip()

    def block(node: Node, indent: str = "") -> None:
        tag = node.tag
        if tag in ("#comment", "script", "style", "head"):
            return
        if re.fullmatch("h[1-6]", tag):
            out.append(f"{'#' * int(tag[1])} {line(inline(node))}")
        elif tag in ("ul", "ol"):
            rows = []
            for n, item in enumerate((c for c in node.children if c.tag == "li"), 1):
                nested = [c for c in item.children if c.tag in ("ul", "ol")]
                copy = item.copy()
                for c in [c for c in copy.children if c.tag in ("ul", "ol")]:
                    c.remove()
                rows.append(f"{indent}{f'{n}.' if tag == 'ol' else '*'} {line(inline(copy))}")
                for inner in nested:
                    mark = len(out)
                    block(inner, indent + "  ")
                    rows += out[mark:]
                    del out[mark:]
            out.append("\n".join(rows))
        elif tag == "blockquote":
            mark = len(out)
            children(node)
            quoted = "\n\n".join(out[mark:])
            del out[mark:]
            out.append("\n".join(f"> {x}".rstrip() for x in quoted.split("\n")))
        elif tag == "pre":
            out.append("\n".join(f"    {x}" for x in node.content().strip("\n").split("\n")))
        elif tag == "hr":
            out.append("* * *")
        elif tag == "table":
            rows = [[line(inline(c)) for c in r.children if c.tag in ("td", "th")] for r in node.walk() if r.tag == "tr"]
            if rows:
                out.append("\n".join([" | ".join(rows[0]), "|".join(["---"] * len(rows[0])), *(" | ".join(r) for r in rows[1:])]))
        elif tag == "p" or not any(c.tag in _STRUCTURE for c in node.walk() if c is not node):
            if text := line(inline(node)):
                out.append(text)
        else:
            children(node)

    def children(node: Node) -> None:
        loose = Node("span")
        loose.text = node.text

        def flush() -> None:
            nonlocal loose
            if text := line(inline(loose)):
                out.append(text)
            loose = Node("span")

        for c in node.children:
            if c.tag in _STRUCTURE or any(x.tag in _STRUCTURE for x in c.walk()):
                flush()
                block(c)
                loose.text = c.tail
            else:
                loose.children.append(c)
        flush()

    children(parse(source))
    return "\n\n".join(x for x in out if x)


_STRUCTURE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol blockquote pre hr table div section article body html header footer main nav aside figure".split())


def _image(node: Node, document: str, images: dict[str, str]) -> str:
    source = node.attrs.get("src") or node.attrs.get("href") or node.attrs.get("xlink:href") or ""
    path = posixpath.normpath(posixpath.join(posixpath.dirname(document), source)) if source else ""
    return f"![{node.attrs.get('alt', '')}]({'images/' + images[path] if path in images else source})"


#: The start page of a web export: its documents in a frame, beside it its contents as nested lists, or else the documents in their order.
INDEX = (
    """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>""",
    """</title><style>body { display: flex; margin: 0 } nav { width: 20em; height: 100vh; overflow: auto } iframe { flex: 1; border: 0; height: 100vh }</style></head>
<body><nav id="contents"></nav><iframe name="page" title="page"></iframe>
<script type="application/json" id="book">""",
    """</script>
<script>
const book = JSON.parse(document.getElementById("book").textContent);
const entries = book.toc && book.toc.length ? book.toc : (book.spine || []);
const open = [{level: 0, list: document.createElement("ul"), last: null}];
for (const entry of entries) {
  const level = entry.level || 0;
  while (open.length > 1 && open.at(-1).level > level) open.pop();
  if (open.at(-1).level < level && open.at(-1).last) {
    const list = document.createElement("ul");
    open.at(-1).last.append(list);
    open.push({level, list, last: null});
  }
  const item = document.createElement("li"), link = document.createElement("a");
  link.href = entry.href; link.target = "page"; link.textContent = entry.title || entry.href;
  item.append(link);
  open.at(-1).list.append(item);
  open.at(-1).last = item;
}
document.getElementById("contents").append(open[0].list);
if (book.spine && book.spine.length) document.querySelector("iframe").src = book.spine[0].href;
</script></body></html>
""",
)


def start_page(title: Column, json: Column) -> Column:
    """``json`` is made safe for a script element, as export.book_json does."""
    safe = title
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        safe = F.replace(safe, F.lit(mark), F.lit(name))
    return F.concat(F.lit(INDEX[0]), safe, F.lit(INDEX[1]), json, F.lit(INDEX[2]))
