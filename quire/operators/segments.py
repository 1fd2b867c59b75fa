"""Documents to ordered segments, and the Python operators on their markup.

One document gives many segments, so this is a partition-wise Python operator over Arrow batches;
everything after it is relational.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.html import BLOCKS, Node, Paths, parse, squeeze
from quire.functions.paths import resolved
from quire.functions.text import rekeyed_segment_id, stem

# The kinds of elements.
SIMPLE = ("p", "blockquote", "div", "h1", "h2", "h3", "h4", "h5", "h6")
ATOMIC = ("ul", "ol", "dl", "table", "figure")
NESTING = ("blockquote", "div")
PLAIN = ("span", "a", "font")
NOTE_HINTS = ("footnote", "endnote", "noteref", "fn", "note")
#: Characters of markup that a batch of results is made from.
SLICE = 4 << 20
#: Bytes of rows that a task's Python holds at a time, or one row if that is longer.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20

SCHEMA = (
    "book_id string, segment_id string, file_path string, xpath string, extract_mode string, source_content string,"
    " element_type string, spine_index int, order_in_file int"
)


def tidy_dots(text: str) -> str:
    """Spaced full stops as an ellipsis with one space behind it."""
    return re.sub(r"\.\.\.\s*(?=\S)", "... ", re.sub(r"\.\s+\.\s+\.(?:\s+\.)*", "...", text))


def bare_markup(node: Node) -> str:
    """Inner HTML without attributes (an image keeps its source) and without inline wrappers."""
    copy = node.copy()
    for n in list(copy.walk()):
        if n.tag == "#comment":
            continue
        source = next((n.attrs[k] for k in ("src", "href", "xlink:href") if n.attrs.get(k)), "") if n.local in ("img", "image") else ""
        n.attrs = {"src": source} if source else {}
        if n is not copy and n.tag in PLAIN:
            n.unwrap()
    return copy.inner().strip()


def own_text(node: Node) -> str:
    """The text of an element outside descendants of its own kind."""
    out = [node.text]
    for child in node.children:
        if child.tag not in (node.tag, "#comment"):
            stack = child.copy()
            for inner in list(stack.walk()):
                if inner.tag == node.tag and inner.parent is not None:
                    inner.remove()
            out.append(stack.content())
        out.append(child.tail)
    return "".join(out).strip()


def document_segments(source: str) -> Iterator[tuple[str, str, str, str]]:
    """(xpath, mode, content, element) of each segment of a document, in order."""
    paths = Paths(parse(source))
    for node in paths.root.walk():
        tag = node.local
        if tag not in SIMPLE and tag not in ATOMIC or any(a.local in ATOMIC for a in node.ancestors()):
            continue
        if tag in ATOMIC:
            mode, content = "html", bare_markup(node)
        else:
            if tag == "div" and any(c.local in BLOCKS for c in node.children):
                continue
            nested = tag in NESTING and any(n is not node and n.local == tag for n in node.walk())
            if nested and not own_text(node):
                continue
            mode, content = "text", tidy_dots(squeeze(node.content()))
        if content:
            yield paths.of(node), mode, content, tag


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about SLICE bytes of a text column each; a longer text is a slice of its own."""
    start = read = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if read and read + (n or 0) > SLICE:
            yield batch.slice(start, i - start)
            start = i
            read = 0
        read += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch, made into Python values one at a time."""
    cols = [batch.column(n) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in cols)


def in_batches(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``mapInArrow`` over batches of about BATCH_BYTES, whatever the table's size.

    Spark else fills batches of up to 64 MB, and a task's Python holds two at a time. It has no bound for a single plan: the session's is set.
    """
    rows.sparkSession.conf.set(BATCH, BATCH_BYTES)
    return rows.mapInArrow(run, schema)


def segment_documents(documents: DataFrame) -> DataFrame:
    """Segments of ``documents(book_id, file_path, spine_index, html)`` in SCHEMA; ids may still collide."""
    kinds = pa.schema([(n, pa.int32() if n in ("spine_index", "order_in_file") else pa.string()) for n in _names()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        read = 0
        for batch in batches:
            for book, path, spine, source in _columns(batch, "book_id", "file_path", "spine_index", "html"):
                name = path.rsplit("/", 1)[-1]
                name = name.rsplit(".", 1)[0] if "." in name[1:] else name
                for order, (xpath, mode, content, tag) in enumerate(document_segments(source or ""), 1):
                    ident = f"{name}-{hashlib.sha1(xpath.encode()).hexdigest()[:12]}"
                    out.append(
                        {"book_id": book, "segment_id": ident, "file_path": path, "xpath": xpath, "extract_mode": mode, "source_content": content,
                         "element_type": tag, "spine_index": spine, "order_in_file": order}
                    )
                read += len(source or "")
                if read >= SLICE:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)
                    out, read = [], 0
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    cols = documents.select("book_id", "file_path", F.col("spine_index").cast("int"), "html")
    return in_batches(cols, run, SCHEMA)


def _names() -> list[str]:
    return [part.split()[0] for part in SCHEMA.split(", ") for part in part.split(",") if part.strip()]


def unique_ids(segments: DataFrame) -> DataFrame:
    """Ids that several files of a book share are made from path and xpath; a collision that stays fails."""
    w = Window.partitionBy("book_id", "segment_id")
    shared = F.count("*").over(w) > 1
    new = rekeyed_segment_id(stem(F.col("file_path")), F.col("file_path"), F.col("xpath"))
    keyed = segments.withColumn("segment_id", F.when(shared, new).otherwise(F.col("segment_id")))
    again = F.count("*").over(w)
    return keyed.withColumn("segment_id", F.when(again > 1, F.raise_error(F.concat(F.lit("segment id occurs twice: "), "segment_id"))).otherwise(F.col("segment_id")))


# Speech: lists, notes


_STOPPED = re.compile(r"[.!?…]\s*\Z")


def with_list_stops(root: Node) -> None:
    """Every item of a list that says something ends in a stop: behind its own first text, else behind its last."""
    for item in (n for n in root.walk() if n.tag == "li" and n.content().strip()):
        said = (item, "text") if item.text.strip() else _last_text(item)
        if said is None:
            continue
        words = getattr(*said)
        if not _STOPPED.search(words if said == (item, "text") else item.content()):
            setattr(*said, words.rstrip() + ". ")


def _last_text(item: Node) -> tuple[Node, str] | None:
    """Where the last words inside an item stand."""
    for node in reversed(list(item.walk())[1:]):
        for place in ("tail", "text"):
            if node.tag != "#comment" and getattr(node, place).strip():
                return node, place
    return None


def note_reference(link: Node) -> bool:
    """Whether a link that holds a superscript or subscript points at a note."""
    kind, role = link.attrs.get("epub:type", "").lower(), link.attrs.get("role", "").lower()
    names = f"{link.attrs.get('class', '')} {link.attrs.get('id', '')}".lower()
    if "noteref" in kind or "doc-noteref" in role or any(h in names for h in NOTE_HINTS):
        return True
    return "href" not in link.attrs or "#" in link.attrs["href"]


def without_notes(root: Node) -> None:
    for link in list(root.walk()):
        if link.tag == "a" and link.parent is not None and any(c.tag in ("sup", "sub") for c in link.children) and note_reference(link):
            link.remove()


def note_definition(node: Node) -> bool:
    """Whether an element, or one around it, defines a note."""
    words = ("footnote", "endnote", "rearnote", "ftn", "fn", "note")
    for n in [node, *node.ancestors()]:
        kind = n.attrs.get("epub:type", "").lower()
        if any(h in kind for h in ("footnote", "endnote", "rearnote", "note")) or n.attrs.get("role", "").lower() in ("doc-footnote", "doc-endnote"):
            return True
        for value in (n.attrs.get("id", ""), n.attrs.get("class", "")):
            if any(re.sub(r"[0-9]+$", "", part) in words for part in re.split(r"[\s_\-]+", value.lower())):
                return True
    return False


def spoken_source(document: Paths, xpath: str, element: str) -> str | None:
    """What is read aloud of the element at a path of its document; null where it defines a note.

    Segments have lost the attributes that tell notes, so the document itself is read again.
    """
    node = document.find(xpath)
    if node is None:
        raise ValueError(f"no element at {xpath}")
    if note_definition(node):
        return None
    root = Node("#root")
    own = node.copy()
    own.parent, own.tail = root, ""
    root.children.append(own)
    if element in ("ul", "ol"):
        with_list_stops(root)
    without_notes(root)
    return squeeze(root.content())


def spoken(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """``segments`` with what is read aloud of each (``from_source``), notes left out; a document is parsed once.

    A document's paths are collected into its row; a document bounds them.
    """
    places = segments.groupBy("book_id", "file_path").agg(F.collect_list(F.struct("segment_id", "xpath", "element_type")).alias("places"))
    joined = places.join(documents.select("book_id", "file_path", "html"), ["book_id", "file_path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, source, found in _columns(batch, "book_id", "html", "places"):
                paths = Paths(parse(source or ""))
                texts = [spoken_source(paths, p["xpath"], p["element_type"]) for p in found]
                ids = [p["segment_id"] for p in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([book] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["book_id", "segment_id", "from_source"]
                )

    said = in_batches(joined.select("book_id", "html", "places"), run, "book_id string, segment_id string, from_source string")
    return segments.join(said, ["book_id", "segment_id"], "left")


def spoken_markup(content: str, element: str) -> str:
    """The text of an HTML segment as it is read aloud."""
    root = parse(content)
    if element in ("ul", "ol"):
        with_list_stops(root)
    without_notes(root)
    return squeeze(root.content())


def stripped(content: str) -> str:
    """A one-line preview without tags."""
    return squeeze(" ".join(s.strip() for s in parse(content).strings()))


def column_map(df: DataFrame, function: Callable[..., str | None], inputs: list[str], output: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (else all) of ``df`` with a text column made by a Python function of others; nulls give null.

    Results are made for about SLICE bytes of the first of ``inputs``, a text, at a time.
    """
    names = [c for c in (df.columns if keep is None else keep) if c != output]
    kinds = StructType([*(df.schema[c] for c in names), StructField(output, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _pieces(batch, inputs[0])):
            made = [None if any(v is None for v in row) else function(*row) for row in _columns(part, *inputs)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(made, pa.string())], names=[*names, output])

    found = in_batches(df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*names, *inputs]))), run, kinds)
    return found.select(*(F.col(f"`{c}`") for c in (dict.fromkeys([*df.columns, output]) if keep is None else [*names, output])))


# Injection


def injected(source: str, items: list[dict], mode: str = "bilingual") -> tuple[str, list[str]]:
    """(document with translations, ids whose place wasn't found).

    ``items``: segment_id, xpath, extract_mode, translation, order_in_file. They are applied from the last to the first, so that what
    is inside an element comes before it. ``bilingual`` puts the translation behind the original; ``translated_only`` replaces it.
    Elements that are put in join their parents at the end, so a document takes time in proportion to its size.
    """
    root, lost = parse(source), []
    paths, behind, parents = Paths(root), {}, {}
    for item in sorted(items, key=lambda x: -x["order_in_file"]):
        node = paths.find(item["xpath"])
        if node is None or node.parent is None:
            lost.append(item["segment_id"])
            continue
        target = node
        if mode == "bilingual":
            target = Node(node.tag, node.attrs, node.parent)
            target.tail, node.tail = node.tail, ""
            behind.setdefault(id(node), []).append(target)
            parents[id(node.parent)] = node.parent
            target.attrs.pop("id", None)
            node.attrs["data-lang"], target.attrs["data-lang"] = "original", "translation"
        else:
            target.attrs.pop("data-lang", None)
        target.children, target.text = [], ""
        if item["extract_mode"] == "html":
            made = parse(item["translation"])
            target.text, target.children = made.text, made.children
            for child in target.children:
                child.parent = target
        else:
            target.text = item["translation"]
    for parent in parents.values():
        parent.children = [x for child in parent.children for x in (child, *reversed(behind.get(id(child), ())))]
    return root.inner(), lost


def inject(documents: DataFrame, translations: DataFrame, mode: str = "bilingual") -> DataFrame:
    """(book_id, file_path, html, lost): documents with their translations.

    A document's translations are collected into its row; a document bounds them.
    """
    fields = ["segment_id", "xpath", "extract_mode", "translation", "order_in_file"]
    grouped = translations.groupBy("book_id", "file_path").agg(F.collect_list(F.struct(*fields)).alias("items"))
    joined = documents.select("book_id", "file_path", "html").join(grouped, ["book_id", "file_path"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in _pieces(batch, "html")):
            pages, lost = [], []
            for source, items in _columns(part, "html", "items"):
                page, missing = injected(source or "", items, mode) if items else (source, [])
                pages.append(page)
                lost.append(missing)
            yield pa.RecordBatch.from_arrays(
                [part.column("book_id"), part.column("file_path"), pa.array(pages, pa.string()), pa.array(lost, pa.list_(pa.string()))],
                names=["book_id", "file_path", "html", "lost"],
            )

    return in_batches(joined, run, "book_id string, file_path string, html string, lost array<string>")


def missing_documents(documents: DataFrame, translations: DataFrame) -> DataFrame:
    """(book_id, file_path, n): files that have translations but no document."""
    counted = translations.groupBy("book_id", "file_path").agg(F.count("*").alias("n"))
    return counted.join(documents.select("book_id", "file_path"), ["book_id", "file_path"], "left_anti")


def document_title(source: str) -> str | None:
    """The text of a document's first h1, else of its title element, if there is any."""
    found = {"h1": None, "title": None}
    for node in parse(source).walk():
        if node.local in found and not found[node.local]:
            found[node.local] = squeeze(node.content())
    return found["h1"] or found["title"] or None


def image_references(documents: DataFrame) -> DataFrame:
    """(book_id, spine_index, pos, file_path): images that ``documents(book_id, file_path, spine_index, html)`` show, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for book, path, spine, source in _columns(batch, "book_id", "file_path", "spine_index", "html"):
                shown = (n for n in parse(source or "").walk() if n.local in ("img", "image"))
                urls = (next((n.attrs[k] for k in ("src", "href", "xlink:href") if n.attrs.get(k)), None) for n in shown)
                out += [(book, spine, i, path, url) for i, url in enumerate(urls) if url]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["book_id", "spine_index", "pos", "document", "url"])

    cols = documents.select("book_id", "file_path", F.col("spine_index").cast("int"), "html")
    found = in_batches(cols, run, "book_id string, spine_index int, pos int, document string, url string")
    return found.select("book_id", "spine_index", "pos", resolved(F.col("document"), F.col("url")).alias("file_path")).where("file_path is not null")


def headings(translations: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(book_id, file_path, fragment, title): the translations of a file's headings.

    A null fragment stands for the file and has the last heading's. With the documents each heading
    that carries an id, or stands in an element that does, also stands for that fragment.
    """
    heads = translations.where(F.col("element_type").rlike("^h[1-4]$"))
    whole = heads.groupBy("book_id", "file_path").agg(F.max_by("translation", "order_in_file").alias("title"))
    whole = whole.select("book_id", "file_path", F.lit(None).cast("string").alias("fragment"), "title")
    if documents is None:
        return whole
    listed = heads.groupBy("book_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("order_in_file", "xpath", "translation"))).alias("heads"))
    joined = listed.join(documents.select("book_id", "file_path", "html"), ["book_id", "file_path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for book, path, source, found in _columns(batch, "book_id", "file_path", "html", "heads"):
                paths = Paths(parse(source or ""))
                named: dict[str, str] = {}
                for h in found:
                    node = paths.find(h["xpath"])
                    for ident in ids_of(node) if node is not None else ():
                        named.setdefault(ident, h["translation"])
                out += [(book, path, ident, title) for ident, title in named.items()]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["book_id", "file_path", "fragment", "title"])

    return whole.union(in_batches(joined, run, "book_id string, file_path string, fragment string, title string"))


def ids_of(node: Node) -> list[str]:
    """The ids of a heading, of what is inside it, and of elements around it that begin with it."""
    found = [n.attrs["id"] for n in node.walk() if n.attrs.get("id")]
    while node.parent is not None and node.parent.children[0] is node and not node.parent.text.strip():
        node = node.parent
        if node.attrs.get("id"):
            found.append(node.attrs["id"])
    return found
