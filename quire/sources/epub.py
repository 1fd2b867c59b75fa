"""E-books as a Spark data source, and their writing.

``spark.read.format("epub")`` gives a row for each archive member: (book_id, member, content). One
partition is one book, so a library reads in parallel. Where the folder can only be opened by Spark's
own readers, ``members`` does the same over a ``binaryFile`` scan.
"""

from __future__ import annotations

import codecs
import io
import os
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quire.operators.export import image_names

MAX_BYTES = 500 * 1024 * 1024
#: Bytes that the members of one book may have unpacked.
MOST_UNPACKED = 4 * MAX_BYTES
SCHEMA = "book_id string, member string, content binary"


def safe_member(name: str) -> bool:
    """Whether a member stays inside the folder it is written to."""
    return not (name.startswith(("/", "\\")) or name[1:2] == ":" or ".." in name.replace("\\", "/").split("/"))


def read_members(raw: bytes) -> list[tuple[str, bytes]]:
    """All members of an archive; every name is checked before any content is given."""
    return [m for part in member_parts(raw) for m in part]


def member_parts(raw: bytes, most: int = 64 << 20) -> Iterator[list[tuple[str, bytes]]]:
    """All members of an archive in lists of about ``most`` bytes; names and sizes are checked before any content is given."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        items = [i for i in archive.infolist() if not i.is_dir()]
        for i in items:
            if not safe_member(i.filename):
                raise ValueError(f"unsafe archive member: {i.filename}")
        if sum(i.file_size for i in items) > MOST_UNPACKED:
            raise ValueError(f"unpacks to more than {MOST_UNPACKED} bytes")
        out, size = [], 0
        for i in items:
            if out and size + i.file_size > most:
                yield out
                out, size = [], 0
            out.append((i.filename, archive.read(i)))
            size += i.file_size
        if out:
            yield out


@dataclass
class _Book(InputPartition):
    path: str


class EpubDataSource(DataSource):
    """Options: ``path`` (a file or folder that the driver and all executors mount), ``limit`` (books in order of their paths).

    For other stores there is ``members``.
    """

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _EpubReader(self.options)


class _EpubReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = max(0, int(options["limit"])) if "limit" in options else None

    def partitions(self) -> list[_Book]:
        if os.path.isfile(self.path):
            found = [self.path]
        elif os.path.isdir(self.path):
            found = sorted(os.path.join(d, f) for d, _, files in os.walk(self.path) for f in files if f.lower().endswith(".epub"))
        else:
            raise FileNotFoundError(self.path)
        return [_Book(p) for p in found[: self.limit]]

    def read(self, partition: _Book) -> Iterator[tuple[str, str, bytes]]:
        if os.path.getsize(partition.path) > MAX_BYTES:
            raise ValueError(f"larger than {MAX_BYTES} bytes: {partition.path}")
        with open(partition.path, "rb") as f:
            for name, content in read_members(f.read()):
                yield partition.path, name, content


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EpubDataSource)


def members(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's file readers; works on any store that Spark reads.

    A book over MAX_BYTES fails the read, as it does in the data source.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    large = F.raise_error(F.concat(F.lit(f"larger than {MAX_BYTES} bytes: "), "path")).cast("binary")
    files = files.select("path", F.when(F.col("length") > MAX_BYTES, large).otherwise(F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for rows in member_parts(batch.column(1)[i].as_py()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(rows)), pa.array([n for n, _ in rows]), pa.array([c for _, c in rows], pa.binary())],
                        names=["book_id", "member", "content"],
                    )

    return files.mapInArrow(run, SCHEMA)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def local_path(base: str, href: str) -> str:
    """The member that an href of a document in ``base`` names: escapes are read, a fragment stays."""
    path, mark, fragment = href.partition("#")
    return posixpath.normpath(posixpath.join(base, unquote(path))) + mark + fragment if path else ""


def ncx_entries(source: bytes, base: str) -> list[dict]:
    """The contents of an NCX document in ``base``, in their order."""
    toc: list[dict] = []

    def visit(e: ET.Element, level: int) -> None:
        for point in e:
            if _local(point.tag) == "navPoint":
                title = " ".join("".join(t.itertext()) for t in point if _local(t.tag) == "navLabel").strip()
                src = next((t.attrib.get("src", "") for t in point if _local(t.tag) == "content"), "")
                toc.append({"pos": len(toc), "level": level, "title": title, "href": local_path(base, src)})
                visit(point, level + 1)

    for e in ET.fromstring(source).iter():
        if _local(e.tag) == "navMap":
            visit(e, 0)
    return toc


def nav_entries(source: str, base: str) -> list[dict]:
    """The contents of a navigation document in ``base``: the items of its element of type toc, or of its first one."""
    from quire.functions.html import Node, parse, squeeze

    navs = [n for n in parse(source).walk() if n.local == "nav"]
    nav = next((n for n in navs if "toc" in n.attrs.get("epub:type", "").split()), navs[0] if navs else None)
    toc: list[dict] = []

    def visit(node: Node, level: int) -> None:
        for child in node.children:
            if child.local == "li":
                label = next((c for c in child.children if c.local in ("a", "span")), None)
                if label is not None:
                    href = local_path(base, label.attrs.get("href", ""))
                    toc.append({"pos": len(toc), "level": level, "title": squeeze(label.content()), "href": href})
                visit(child, level + 1)
            elif child.local in ("ol", "ul"):
                visit(child, level)

    if nav is not None:
        visit(nav, 0)
    return toc


def package_rows(parts: dict[str, bytes]) -> dict[str, list[dict]]:
    """Spine, manifest, contents and metadata of one book's small XML members, and the path of its navigation document."""
    container = ET.fromstring(parts["META-INF/container.xml"])
    opf = unquote(next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile"))
    base, root = posixpath.dirname(opf), ET.fromstring(parts[opf])
    manifest, spine, meta, ncx, nav = {}, [], [], None, None
    for e in root.iter():
        kind = _local(e.tag)
        if kind == "item":
            manifest[e.attrib["id"]] = (local_path(base, e.attrib["href"]), e.attrib.get("media-type", ""))
            if "nav" in e.attrib.get("properties", "").split():
                nav = manifest[e.attrib["id"]][0]
        elif kind == "itemref":
            spine.append((e.attrib["idref"], e.attrib.get("linear", "yes") == "yes"))
        elif kind == "spine":
            ncx = e.attrib.get("toc")
        elif kind in ("title", "creator", "publisher", "date", "language", "identifier") and (e.text or "").strip():
            meta.append({"key": kind, "value": e.text.strip()})
    toc_at = next((h for i, (h, t) in manifest.items() if i == ncx or t == "application/x-dtbncx+xml"), None)
    toc = ncx_entries(parts[toc_at], posixpath.dirname(toc_at)) if toc_at and toc_at in parts else []
    # The index counts every reference; those without a manifest item leave a gap.
    rows = [
        {"spine_index": i, "idref": r, "file_path": manifest[r][0], "media_type": manifest[r][1], "linear": linear}
        for i, (r, linear) in enumerate(spine)
        if r in manifest
    ]
    return {"spine": rows, "toc": toc, "metadata": meta, "manifest": [{"id": i, "file_path": h, "media_type": t} for i, (h, t) in manifest.items()], "nav": nav}


PACKAGE = (
    "book_id string, spine array<struct<spine_index:int,idref:string,file_path:string,media_type:string,linear:boolean>>,"
    " toc array<struct<pos:int,level:int,title:string,href:string>>, metadata array<struct<key:string,value:string>>,"
    " manifest array<struct<id:string,file_path:string,media_type:string>>"
)


def packages(found: DataFrame) -> DataFrame:
    """(book_id, spine, toc, metadata, manifest) of each book of ``members``; explode what is needed.

    A book without entries in an NCX document has those of its navigation document.
    """
    small = found.where(F.lower("member").rlike(r"(\.opf|\.ncx|/container\.xml)$"))
    grouped = small.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("member", "content"))).alias("parts"))
    text, number = pa.string(), pa.int32()
    lists = {
        "spine": [("spine_index", number), ("idref", text), ("file_path", text), ("media_type", text), ("linear", pa.bool_())],
        "toc": [("pos", number), ("level", number), ("title", text), ("href", text)],
        "metadata": [("key", text), ("value", text)],
        "manifest": [("id", text), ("file_path", text), ("media_type", text)],
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("book_id", text), *((k, pa.list_(pa.struct(v))) for k, v in lists.items()), ("nav", text)])
        for batch in batches:
            out = [{"book_id": b, **package_rows(dict(p))} for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def navigation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct(lists["toc"]))
        for batch in batches:
            tocs = [nav_entries(decoded(c), posixpath.dirname(n)) for n, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tocs, kind)], names=["book_id", "entries"])

    named = grouped.mapInArrow(run, PACKAGE + ", nav string")
    bare = named.where((F.size("toc") == 0) & F.col("nav").isNotNull()).select("book_id", F.col("nav").alias("member"))
    read = found.join(bare, ["book_id", "member"]).select("book_id", "member", "content")
    toc_kind = PACKAGE[PACKAGE.index(" toc ") + 5 : PACKAGE.index(", metadata")]
    entries = read.mapInArrow(navigation, f"book_id string, entries {toc_kind}")
    joined = named.join(entries, "book_id", "left")
    return joined.select("book_id", "spine", F.coalesce("entries", "toc").alias("toc"), "metadata", "manifest")


#: Byte-order marks, longer ones first.
MARKS = (
    (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"),
)
_DECLARED = (re.compile(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([\w.:-]+)"), re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I))


def encoding(content: bytes) -> str:
    """A document's encoding: of its byte-order mark, its XML declaration or its meta element; else UTF-8, or Windows-1252 where it isn't.

    Latin-1 is read as the Windows encoding that holds it, as browsers do. UTF-16 without a mark shows by its first character.
    """
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    if content[:4] in (b"<\0?\0", b"<\0!\0", b"<\0h\0"):
        return "utf-16-le"
    if content[:4] in (b"\0<\0?", b"\0<\0!", b"\0<\0h"):
        return "utf-16-be"
    for pattern in _DECLARED:
        m = pattern.search(content[:1024])
        if m:
            try:
                name = codecs.lookup(m[1].decode()).name
            except LookupError:
                continue
            # What declares two bytes a character in a declaration of one byte each can't be right.
            if not name.startswith(("utf-16", "utf-32")):
                return "cp1252" if name in ("iso8859-1", "ascii") else name
    try:
        content.decode("utf-8")
    except UnicodeDecodeError:
        return "cp1252"
    return "utf-8"


def decoded(content: bytes | None) -> str | None:
    """A document's text without its byte-order mark; bytes that its encoding doesn't have become replacement characters."""
    return None if content is None else content.decode(encoding(content), "replace").removeprefix("\ufeff")


def spine_documents(found: DataFrame, package: DataFrame) -> DataFrame:
    """(book_id, file_path, spine_index, linear, html) of the XHTML documents in the spine."""
    spine = package.select("book_id", F.explode("spine").alias("s")).select("book_id", "s.*").where(F.col("media_type").startswith("application/xhtml"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = pa.array(map(decoded, part.column(4).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], texts], names=["book_id", "file_path", "spine_index", "linear", "html"])

    held = found.select("book_id", F.col("member").alias("file_path"), "content")
    joined = spine.join(held, ["book_id", "file_path"]).select("book_id", "file_path", "spine_index", "linear", "content")
    return joined.mapInArrow(run, "book_id string, file_path string, spine_index int, linear boolean, html string")


def images(package: DataFrame) -> DataFrame:
    """(book_id, file_path, name, cover): images with names that are unique in a book."""
    items = package.select("book_id", F.posexplode("manifest").alias("pos", "m")).select("book_id", "pos", "m.*")
    found = items.where(F.col("media_type").startswith("image/") | F.lower("file_path").rlike(r"\.(png|jpe?g|gif|svg|webp|bmp)$"))
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("pos")) == 1
    marked = found.select("book_id", "file_path", (F.lower(F.substring_index("file_path", "/", -1)).rlike("cover|title") | first).alias("cover"))
    return image_names(found).join(marked, ["book_id", "file_path"])


def written(parts: list[tuple[str, bytes]], replaced: dict[str, bytes]) -> bytes:
    """An archive with replaced members; the mimetype comes first and uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in sorted(parts, key=lambda p: p[0] != "mimetype"):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(info, replaced.get(name, content))
    return out.getvalue()


#: Fixed value: the rules of a book that shows translations only.
ONLY_CSS = """
[data-lang="original"] { display: none !important; }
[data-lang="translation"] { display: block !important; }
"""


def retitled(ncx: bytes, base: str, titles: dict[tuple[str, str | None], str]) -> bytes:
    """A table of contents with new titles, by (file, fragment), else by (file, None); other entries stay."""
    space = "http://www.daisy.org/z3986/2005/ncx/"
    ET.register_namespace("", space)
    root = ET.fromstring(ncx)
    for point in root.iter(f"{{{space}}}navPoint"):
        src = next((e.attrib.get("src", "") for e in point if _local(e.tag) == "content"), "")
        path, _, fragment = src.partition("#")
        at = local_path(base, path)
        title = titles.get((at, fragment)) or titles.get((at, None))
        label = next((t for e in point if _local(e.tag) == "navLabel" for t in e if _local(t.tag) == "text"), None)
        if title and label is not None:
            label.text = title
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def book_members(found: DataFrame, replaced: DataFrame, titles: DataFrame | None = None, only: bool = False) -> DataFrame:
    """(book_id, member, content) with the documents of ``replaced(book_id, file_path, html)``, for ``sinks.write_archives``.

    ``titles(book_id, file_path, fragment, title)`` go into the contents of books that show translations ``only``, and ONLY_CSS once into
    the first style sheet. Members stay rows; a book's titles, no more than its headings, are brought together beside its contents.
    """
    new = replaced.select("book_id", F.col("file_path").alias("member"), F.encode("html", "UTF-8").alias("new"))
    joined = found.join(new, ["book_id", "member"], "left").select("book_id", "member", F.coalesce("new", "content").alias("content"))
    if not only:
        return joined
    low = F.lower("member")
    first = joined.where(low.endswith(".css")).groupBy("book_id").agg(F.min("member").alias("sheet"))
    rule, mark = F.lit(ONLY_CSS.encode()), F.lit(b'[data-lang="original"]')
    styled = joined.join(first, "book_id", "left")
    add = (F.col("member") == F.col("sheet")) & ~F.contains("content", mark)
    styled = styled.withColumn("content", F.when(add, F.concat("content", rule)).otherwise(F.col("content"))).select("book_id", "member", "content")
    if titles is None:
        return styled
    named = titles.groupBy("book_id").agg(F.collect_list(F.struct("file_path", "fragment", "title")).alias("titles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name, content, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                made.append(retitled(content, posixpath.dirname(name), {(t["file_path"], t["fragment"]): t["title"] for t in own}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["book_id", "member", "content"])

    contents = low.endswith(".ncx")
    listed = styled.where(contents).join(named, "book_id").select("book_id", "member", "content", "titles").mapInArrow(run, SCHEMA)
    other = styled.where(contents).join(named.select("book_id"), "book_id", "left_anti")
    return styled.where(~contents).union(listed).union(other)


def item(package: DataFrame, href: str) -> DataFrame:
    """The manifest items at a path; a book without one fails."""
    at = F.filter("manifest", lambda m: m["file_path"] == href)
    missing = F.raise_error(F.concat(F.lit(f"no {href} in "), "book_id"))
    return package.select("book_id", F.when(F.size(at) == 0, missing.cast("struct<id:string,file_path:string,media_type:string>")).otherwise(F.get(at, F.lit(0))).alias("m")).select("book_id", "m.*")


def image_files(found: DataFrame, package: DataFrame) -> DataFrame:
    """(book_id, path, content): every image under its unique name."""
    named = images(package).select("book_id", F.col("file_path").alias("member"), "name").distinct()
    return found.join(named, ["book_id", "member"]).select("book_id", F.concat(F.lit("images/"), "name").alias("path"), "content")
