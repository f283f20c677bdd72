"""A scan source of pages: spark.read.format("factspark_pages").load(folder), or readStream over files that arrive.

A file is a document, its pages are rows of PAGES. The folder is listed once, files are packed into partitions by their bytes, and each task reads and parses only its own
files. Filters on document_id (the file's name) and pdf_page_number are taken by the source: a file that no filter admits is not opened, a page that none admits is not returned. A batch of a
stream holds all files that came since the last one; its offset is the modification time and name of the last file read, so a restarted query goes on where it stopped; names with other endings, hidden files and
folders whose name begins with _ or . are passed over.

Options: suffix (.txt) and bytes (of files in a partition, 64 MB). Files are opened through a path that all executors see, such as a mounted
store; where only Spark's own readers reach it, `files.read_uploads` and `files.parse_pages` give the same pages. A file that can't be read or parsed gives one row with page 0 and the error as its text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .files import Parser, text_parser

PAGES = "document_id string, pdf_page_number int, raw_text string, bytes long"
NAME = "factspark_pages"
COMPARED = {EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v}


@dataclass
class Files(InputPartition):
    """Paths with their bytes."""

    files: list[tuple[str, int]]


def local_path(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"{NAME} reads mounted folders, not {parsed.scheme}:")
    return unquote(parsed.path) if parsed.scheme else path


def listed(folder: str, suffix: str) -> list[tuple[int, str, int]]:
    """(modification time, path, bytes) of all files below a folder, oldest first."""
    out = []
    for root, folders, names in os.walk(folder):
        folders[:] = [f for f in folders if f[0] not in "._"]
        for name in names:
            if name.endswith(suffix) and name[0] not in "._":
                path = os.path.join(root, name)
                status = os.stat(path)
                out.append((status.st_mtime_ns, path, status.st_size))
    return sorted(out)


def document_of(path: str) -> str:
    return os.path.basename(path)


def packed(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in partitions of so many bytes; a larger file has one for itself. Without files there is one empty partition, as Spark takes none for unknown."""
    out, room = [], 0
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if not out or size > room:
            out.append(Files([]))
            room = most
        out[-1].files.append((path, size))
        room -= size
    return out or [Files([])]


class Pages:
    """What both readers share."""

    def __init__(self, options: dict, parser: Parser):
        self.folder, self.parser = local_path(options["path"]), parser
        self.suffix, self.most = options.get("suffix", ".txt"), int(options.get("bytes", 64 << 20))
        if self.most < 1:
            raise ValueError("the option bytes is at least 1")
        self.taken: list[tuple[str, type, object]] = []

    def admits(self, column: str, value: object) -> bool:
        return all(COMPARED[kind](value, limit) for name, kind, limit in self.taken if name == column)

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.files:
            try:
                with open(path, "rb") as file:
                    pages = [(i, page["raw_text"]) for i, page in enumerate(self.parser(file.read()), 1)]
            except Exception as error:  # one broken file must not end the scan; it is told in its row
                pages = [(0, f"{type(error).__name__}: {error}"[:500])]
            yield from ((document_of(path), number, text, size) for number, text in pages if self.admits("pdf_page_number", number))


class PageReader(Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if type(f) in COMPARED and len(f.attribute) == 1 else None
            if name in ("document_id", "pdf_page_number"):
                self.taken.append((name, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        return packed([(path, size) for _, path, size in listed(self.folder, self.suffix) if self.admits("document_id", document_of(path))], self.most)


class PageStream(Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self.after(self.initialOffset())
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def after(self, start: dict) -> list[tuple[int, str, int]]:
        return [f for f in listed(self.folder, self.suffix) if (f[0], f[1]) > (start["time"], start["path"])]

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return packed([(path, size) for time, path, size in self.after(start) if (time, path) <= (end["time"], end["path"])], self.most)


def register(spark: SparkSession, name: str = NAME, parser: Parser = text_parser) -> None:
    """Registers the source in a session; spark.sql.python.filterPushdown.enabled must be on for a scan to skip files, and is set here."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError("a source's name is letters, digits and _")

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PAGES

        def reader(self, schema) -> PageReader:
            return PageReader(self.options, parser)

        def streamReader(self, schema) -> PageStream:
            return PageStream(self.options, parser)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
