"""Books as a data source: `spark.read.format("book")` gives their blocks, `df.write.format("book")` publishes files.

Reading: the folder's files are listed, small ones share a task, and a book above `split` bytes is split by its documents, so
that one large book isn't one task. Where that would make more than about TASKS tasks, so many bytes more make one, up to SPLIT
(or `split`, if larger): the driver opens no more books than there are tasks, however many there are. Writing: tasks put their books beside the published ones; the job's commit moves
them all, its abort leaves nothing. A book that the check finds damaged fails its task, and so the job.

The source runs in Python processes without a session, so it reaches files through Arrow's file systems: local ones, and
those of a URI that Arrow knows.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from folioflow.sources import archive as A

SUFFIX = ".epub"
#: Bytes of files for one task; a book above is split.
SPLIT = 32 << 20
#: Tasks that a folder is read by at least before any has more than `split` bytes: more would only cost their beginnings.
TASKS = 256


def file_name(book_id: str) -> str:
    return quote(book_id, safe="") + SUFFIX


def _files(path: str):
    """An Arrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Whole files, or some documents of one."""

    paths: list[str]
    documents: list[str] | None = None


class BookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        files, at = _files(self.path)
        found = sorted((i.path, i.size) for i in files.get_file_info(fs.FileSelector(at)) if i.is_file and i.path.endswith(SUFFIX))
        # what a task reads: no less than a share of all bytes, as long as that is less than SPLIT
        room = max(self.split, min(SPLIT, sum(n for _, n in found) // TASKS))
        parts, small, size = [], [], 0
        for path, n in found:
            if n > room and (documents := self._documents(files, path)):
                parts += [Part([path], [d]) for d in documents]
                continue
            if small and size + n > room:
                parts.append(Part(small))
                small, size = [], 0
            small.append(path)
            size += n
        return parts + [Part(small)] if small else parts or [Part([])]

    @staticmethod
    def _documents(files, path: str) -> list[str]:
        """A book's documents, from its directory and package alone."""
        with files.open_input_file(path) as f:
            book = A._tried(zipfile.ZipFile, f)
            return A._tried(A._reading_order, book, otherwise=[]) if book else []

    def read(self, partition: Part) -> Iterator:
        files, _ = _files(self.path)
        for path in partition.paths:
            name = unquote(path.rsplit("/", 1)[-1].removesuffix(SUFFIX))
            with files.open_input_file(path) as f:
                if partition.documents is None:
                    yield from A.batches(name, f.read())
                else:
                    yield from A.batches(name, f, partition.documents)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task that are to be published: where each is, and where it goes."""

    moves: list[tuple[str, str]]


class BookWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"
        # made here alone: a task that is still at work when the job is aborted finds no folder to write to
        files, at = _files(self.path)
        files.create_dir(f"{at}/{self.pending}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        files, at = _files(self.path)
        moves = []
        for book_id, content in rows:
            content = bytes(content)
            if problem := A._what_is_wrong(content):
                raise ValueError(f"{book_id}: {problem}")
            held = f"{at}/{self.pending}/{uuid.uuid4().hex}"
            with files.open_output_stream(held) as out:
                out.write(content)
            moves.append((held, f"{at}/{file_name(book_id)}"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = _files(self.path)
        moves = [m for message in messages if message for m in message.moves]
        names = [to for _, to in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two books of one name")
        if self.overwrite:
            from pyarrow import fs

            for old in files.get_file_info(fs.FileSelector(at)):
                if old.is_file and old.path.endswith(SUFFIX) and old.path not in names:
                    files.delete_file(old.path)
        for held, to in moves:
            files.move(held, to)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        files, at = _files(self.path)
        if files.get_file_info(f"{at}/{self.pending}").type != fs.FileType.NotFound:
            files.delete_dir(f"{at}/{self.pending}")


class BookSource(DataSource):
    """Blocks of books for reading (book_id, document, idx, text); book_id, content for writing."""

    @classmethod
    def name(cls) -> str:
        return "book"

    def schema(self) -> str:
        return "book_id string, document string, idx int, text string"

    def reader(self, schema) -> BookReader:
        return BookReader(self.options)

    def writer(self, schema, overwrite: bool) -> BookWriter:
        if [f.name for f in schema.fields] != ["book_id", "content"]:
            raise ValueError("books are written from book_id, content")
        return BookWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BookSource)
