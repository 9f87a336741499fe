"""Workbooks as a data source: ``spark.read.format("workbook").load(folder)``.

``spark.dataSource.register(WorkbookSource)`` makes it known to a session. Every sheet is a partition of its
own, consecutive files are one where there are many, and a filter on ``sheet_name`` leaves the other sheets unread (with
``spark.sql.python.filterPushdown.enabled``). Columns are those of parsed files: rows, then a record per sheet, or an
error record where a sheet or a whole file cannot be read.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .files import PARSED_SCHEMA
from .workbook import _context, _sheet_records, _sheets

# Files whose lists of sheets the driver fetches at a time, and at most; of more files the tasks that read them do.
LISTED_AT_ONCE, LISTED = 32, 256
# Partitions of more files, and the bytes after which one is full however many there are.
PARTITIONS, PARTITION_BYTES = 256, 16 << 20
# Sheets up to this size are parsed once and held; larger ones twice.
HELD_BYTES = 1 << 20


def open_folder(path: str):
    """The file system of a folder and the folder's path in it; any that Arrow knows (local, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if path.startswith("file:") else path)


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: tuple[int, str, str] | None  # position, name, member; none where the file cannot be read
    error: str | None = None


@dataclass
class FilesPartition(InputPartition):
    paths: list[str]


class WorkbookReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sheet_name",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self) -> list[SheetPartition]:
        """A partition per sheet. Only names are fetched here: the directory of each archive and its list of sheets.

        Of more than ``LISTED`` files nothing but names and sizes is looked at: consecutive files are a partition.
        """
        from pyarrow import fs

        system, folder = open_folder(self.folder)
        files = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and f.path.lower().endswith(".xlsx"))
        if len(files) > LISTED:
            full = min(PARTITION_BYTES, sum(size for _, size in files) / PARTITIONS)
            groups, held = [], full
            for path, size in files:
                if held >= full:
                    groups.append([])
                    held = 0
                groups[-1].append(path)
                held += size
            return [FilesPartition(g) for g in groups]
        with ThreadPoolExecutor(LISTED_AT_ONCE) as pool:
            return [p for found in pool.map(lambda f: self._listed(system, f[0]), files) for p in found]

    def _listed(self, system, path: str) -> list[SheetPartition]:
        """The sheets of a file that are wanted."""
        try:
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                return [SheetPartition(path, s) for s in _sheets(archive) if self.wanted is None or s[1] in self.wanted]
        except Exception as e:  # noqa: BLE001 - any unreadable file is reported, not fatal
            return [SheetPartition(path, None, f"Failed to read file: {e}")] if self.wanted is None else []

    def read(self, partition: SheetPartition | FilesPartition) -> Iterator[tuple]:
        system, _ = open_folder(self.folder)
        files = [[partition]] if isinstance(partition, SheetPartition) else (self._listed(system, path) for path in partition.paths)
        for sheets in files:
            if sheets and sheets[0].sheet is None:
                yield (sheets[0].path, None, None, None, None, None, None, sheets[0].error)
            elif sheets:
                yield from self._rows(system, sheets)

    def _rows(self, system, sheets: list[SheetPartition]) -> Iterator[tuple]:
        """The rows of sheets of one file that can be read to their end.

        A large sheet is first read only to find that out, so no more than ``HELD_BYTES`` of a sheet are held.
        """
        path = sheets[0].path
        with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            try:
                context = _context(archive)
            except Exception as e:  # noqa: BLE001
                for part in sheets:
                    yield (path, part.sheet[1], part.sheet[0], None, None, None, None, f"Failed to read sheet: {e}")
                return
            for part in sheets:
                records = lambda: _sheet_records(archive, path, part.sheet, context)  # noqa: B023, E731
                small = part.sheet[2] in archive.NameToInfo and archive.getinfo(part.sheet[2]).file_size <= HELD_BYTES
                held = list(records()) if small else None
                if small:
                    end = held.pop()
                else:
                    for end in records():
                        pass
                if end[7] is None:
                    for record in held if small else records():
                        if record[3] is not None:
                            yield record
                yield end


class WorkbookSource(DataSource):
    """Options: ``path``, the folder of the workbooks."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return PARSED_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])
