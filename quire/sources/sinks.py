"""Exports as Spark sinks that take effect as a whole: named files, and archives that are streamed member by member.

Tasks write below a hidden folder of the job; its files move to their places when all tasks are done, so a job that fails leaves the
old export as it was. The moves are the driver's, a listing of each task's folder; contents never pass the driver.
"""

from __future__ import annotations

import contextlib
import os
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def store_of(folder: str):
    """(file system, path) of a folder or URI that the driver and all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def inside(path: str) -> str:
    """A relative path, if it stays inside the export's folder."""
    if not path or path.startswith(("/", "\\")) or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"outside the folder: {path}")
    return posixpath.normpath(path)


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: int


class _StagedWriter(DataSourceWriter):
    """Files below a folder of the task's own, moved when the job is committed."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.staging = f".staged-{uuid.uuid4().hex}"

    def files(self, rows: Iterator[Row], store, base: str) -> Iterator[str]:
        """Writes the task's files; gives each name when the file is complete."""
        raise NotImplementedError

    def write(self, iterator: Iterator[Row]) -> _Staged:
        store, base = store_of(self.folder)
        own = f"{self.staging}/{uuid.uuid4().hex}"  # another attempt has another folder
        return _Staged(own, sum(1 for _ in self.files(iterator, store, posixpath.join(base, own))))

    def commit(self, messages: list[_Staged | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.folder)
        moves, folders = {}, {base}
        for m in messages:
            if m is None or not m.files:
                continue
            own = posixpath.join(base, m.folder)
            for info in store.get_file_info(fs.FileSelector(own, recursive=True)):
                if info.type == fs.FileType.File:
                    final = posixpath.join(base, posixpath.relpath(info.path, own))
                    if final in moves:
                        raise ValueError(f"written twice: {posixpath.relpath(final, base)}")
                    moves[final] = info.path
                    folders.add(posixpath.dirname(final))
        for folder in sorted(folders):
            store.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: store.move(m[1], m[0]), moves.items()))
        self._clear()

    def abort(self, messages: list[_Staged | None]) -> None:
        """Nothing has moved. A task that is still being stopped may leave its hidden folder behind."""
        with contextlib.suppress(OSError):
            self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, base = store_of(self.folder)
        at = posixpath.join(base, self.staging)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)


class _FilesWriter(_StagedWriter):
    def files(self, rows: Iterator[Row], store, base: str) -> Iterator[str]:
        for row in rows:
            path = posixpath.join(base, inside(row["path"]))
            store.create_dir(posixpath.dirname(path), recursive=True)
            with store.open_output_stream(path, compression=None) as out:
                out.write(bytes(row["content"] or b""))
            yield path


class _ArchivesWriter(_StagedWriter):
    """Rows of an archive stand together; each member goes straight into its archive, whose directory is all that is kept."""

    def files(self, rows: Iterator[Row], store, base: str) -> Iterator[str]:
        current, out, archive = None, None, None

        def closed() -> str:
            archive.close()
            out.close()
            return current

        for row in rows:
            path = posixpath.join(base, inside(row["path"]))
            if path != current:
                if archive is not None:
                    yield closed()
                store.create_dir(posixpath.dirname(path), recursive=True)
                current, out = path, store.open_output_stream(path, compression=None)
                archive = zipfile.ZipFile(_Forward(out), "w", allowZip64=True)
            info = zipfile.ZipInfo(inside(row["member"]), (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED
            archive.writestr(info, bytes(row["content"] or b""))
        if archive is not None:
            yield closed()


class _Forward:
    """A stream that is only written forwards, as stores have it."""

    def __init__(self, out):
        self.out = out

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass


class FilesDataSource(DataSource):
    """Sink ``quire_files``: a file for each row of (path, content)."""

    writer_of = _FilesWriter

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return self.writer_of(self.options)


class ArchivesDataSource(FilesDataSource):
    """Sink ``quire_archives``: an archive for each path of (path, member, content); rows of a path have to stand together."""

    writer_of = _ArchivesWriter

    @classmethod
    def name(cls) -> str:
        return "quire_archives"

    def schema(self) -> str:
        return "path string, member string, content binary"


def register(spark: SparkSession) -> None:
    for source in (FilesDataSource, ArchivesDataSource, JoinedDataSource):
        spark.dataSource.register(source)


def write_files(rows: DataFrame, folder: str) -> None:
    """The files of ``rows(path, content)`` below a folder; all of them, or none if a task fails for good."""
    register(rows.sparkSession)
    rows.select("path", F.col("content").cast("binary").alias("content")).write.format("quire_files").mode("append").save(folder)


def write_archives(rows: DataFrame, folder: str) -> None:
    """The archives of ``rows(path, member, content)`` below a folder; mimetype is the first member, uncompressed.

    Members are sorted by Spark, which spills, and a task holds one of them at a time.
    """
    register(rows.sparkSession)
    order = (F.col("member") != "mimetype").alias("late")
    dealt = rows.select("path", "member", F.col("content").cast("binary").alias("content"), order).repartition("path").sortWithinPartitions("path", "late", "member")
    dealt.drop("late").write.format("quire_archives").mode("append").save(folder)


class _JoinedWriter(_StagedWriter):
    """Rows of a file stand together and in order; their contents follow each other in it."""

    def files(self, rows: Iterator[Row], store, base: str) -> Iterator[str]:
        current, out = None, None
        for row in rows:
            path = posixpath.join(base, inside(row["path"]))
            if path != current:
                if out is not None:
                    out.close()
                    yield current
                store.create_dir(posixpath.dirname(path), recursive=True)
                current, out = path, store.open_output_stream(path, compression=None)
            out.write(bytes(row["content"] or b""))
        if out is not None:
            out.close()
            yield current


class JoinedDataSource(FilesDataSource):
    """Sink ``quire_joined``: a file for each path of (path, nth, content), its contents one behind the other."""

    writer_of = _JoinedWriter

    @classmethod
    def name(cls) -> str:
        return "quire_joined"

    def schema(self) -> str:
        return "path string, nth bigint, content binary"


def write_joined(rows: DataFrame, folder: str) -> None:
    """The files of ``rows(path, nth, content)`` below a folder, each its rows' contents by ``nth``; a task holds one row at a time."""
    register(rows.sparkSession)
    dealt = rows.select("path", F.col("nth").cast("long").alias("nth"), F.col("content").cast("binary").alias("content"))
    dealt.repartition("path").sortWithinPartitions("path", "nth").write.format("quire_joined").mode("append").save(folder)
