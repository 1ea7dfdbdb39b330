"""Zip files as a data source of Spark: one archive is read by many tasks, filters on members reach the reader, writes commit.

    zip_source.register(spark)
    spark.read.format("zip").load(folder).where("member LIKE 'run/%'")
    rows.write.format("zip").mode("append").save(folder)

Paths are of local disks or of stores that Arrow opens by their URI (hdfs, s3, gs); archives.read_zip() takes all that Spark reads.
"""

from __future__ import annotations

import posixpath
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "archive string, member string, size long, content binary"
#: Bytes of archives that one task reads, about; a larger archive is cut between members.
SPLIT_BYTES = 32 << 20
#: Members of one written archive at most: its directory is in memory while it is written or read, about 1 kB a member.
MOST_MEMBERS = 20_000


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it have filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipSource)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Members(InputPartition):
    """Archives of one task; of the only one of a large archive, the members by their place in its directory."""

    archives: list[str]
    places: tuple[int, int] | None = None


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ZipWriter:
        if overwrite:
            raise ValueError("zip files are only added: use mode('append')")
        return ZipWriter(self.options, schema.fieldNames())


class ZipReader(DataSourceReader):
    """Rows (archive, member, size, content) of the zip files of a folder, or of one zip file. Folders in archives are no members.

    Equality, IN and LIKE 'prefix%' on member are answered from an archive's directory: other members' bytes are not read.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.names: set[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("member",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            elif isinstance(f, StringStartsWith) and f.attribute == ("member",):
                self.prefixes.append(f.value)
            else:
                yield f

    def _wanted(self, info: zipfile.ZipInfo) -> bool:
        name = info.filename
        return not info.is_dir() and (self.names is None or name in self.names) and all(name.startswith(p) for p in self.prefixes)

    def partitions(self) -> list[InputPartition]:
        """Small archives go together to a task, unopened; the directory of one larger than a split is read here to cut it."""
        store, path = _opened(self.path)
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else sorted((f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.extension == "zip" and "/_" not in f.path[len(path) :]), key=lambda f: f.path)
        out, some, size = [], [], 0
        for f in files:
            if f.size > self.split:
                out += [Members([f.path], p) for p in self._cuts(store, f.path)]
                continue
            if some and size + f.size > self.split:
                out.append(Members(some))
                some, size = [], 0
            some.append(f.path)
            size += f.size
        if some:
            out.append(Members(some))
        return out or [Members([])]

    def _cuts(self, store: fs.FileSystem, path: str) -> Iterator[tuple[int, int]]:
        with store.open_input_file(path) as file, zipfile.ZipFile(file) as z:
            first, size = 0, 0
            members = z.infolist()
            for i, info in enumerate(members):
                size += info.compress_size if self._wanted(info) else 0
                if size >= self.split:
                    yield first, i + 1
                    first, size = i + 1, 0
            if size:
                yield first, len(members)

    def read(self, partition: Members) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        for path in partition.archives:
            with store.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                first, end = partition.places or (0, None)
                for info in z.infolist()[first:end]:
                    if self._wanted(info):
                        yield posixpath.basename(path), info.filename, info.file_size, z.read(info)


@dataclass
class Written(WriterCommitMessage):
    aside: str
    names: list[str]


class ZipWriter(DataSourceWriter):
    """Each task's rows (member, content, ...) become zip files, which appear in the folder when all tasks have ended.

    A zip file ends with the row that brings it to membersPerFile members or splitBytes bytes, so that a task holds no more of
    its directory, and its readers need not cut it.
    """

    def __init__(self, options: dict, columns: list[str]):
        if missing := {"member", "content"} - set(columns):
            raise ValueError(f"rows to write as zip files need {sorted(missing)}")
        self.path, self.job = options["path"], uuid.uuid4().hex
        self.members, self.split = int(options.get("membersPerFile", MOST_MEMBERS)), int(options.get("splitBytes", SPLIT_BYTES))

    def write(self, rows: Iterator) -> Written:
        store, folder = _opened(self.path)
        aside, names = f"{folder}/_aside-{self.job}", []
        row = next(rows, None)
        if row is not None:
            store.create_dir(aside)
        while row is not None:
            names.append(f"part-{uuid.uuid4().hex}.zip")
            with store.open_output_stream(f"{aside}/{names[-1]}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                while row is not None:
                    z.writestr(zipfile.ZipInfo(row["member"]), bytes(row["content"] or b""), zipfile.ZIP_DEFLATED)
                    row = next(rows, None)
                    if len(z.filelist) >= self.members or out.tell() >= self.split:
                        break
        return Written(aside, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.path)
        for m in messages:
            for name in m.names if m is not None else ():
                store.move(f"{m.aside}/{name}", f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = _opened(self.path)
        if store.get_file_info(f"{folder}/_aside-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_aside-{self.job}")
