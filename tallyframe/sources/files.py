"""Folders of files as a data source: a writer that commits whole jobs, a reader with a partition for each folder and filters on names."""

from __future__ import annotations

import io
import re
import tarfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT = "tallyframe_files"
SCHEMA = "filename string, bytes long, modified timestamp, content binary, error string, path string"
COMMITTED = "committed.txt"
#: The archive that holds a task's files where they are stored packed.
PACKED = "files.tar.gz"

#: Names that a file may have: no folders, nothing hidden.
NAME = re.compile(r"[^./\\\x00][^/\\\x00]*")


def opened(path: str):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _children(fs, folder: str) -> list:
    from pyarrow.fs import FileSelector

    return sorted(fs.get_file_info(FileSelector(folder, allow_not_found=True)), key=lambda f: f.base_name)


def _is_file(fs, path: str) -> bool:
    from pyarrow.fs import FileType

    return fs.get_file_info(path).type == FileType.File


def _is_folder(info) -> bool:
    from pyarrow.fs import FileType

    return info.type == FileType.Directory


@contextmanager
def _single(fs, folder: str) -> Iterator:
    def put(name: str, content: bytes) -> None:
        with fs.open_output_stream(f"{folder}/{name}") as out:
            out.write(content)

    yield put


@contextmanager
def _packing(fs, folder: str) -> Iterator:
    """Files go one after the other into one compressed archive: many small ones take neither a block of the disk nor a name in the folder each."""
    with fs.open_output_stream(f"{folder}/{PACKED}", compression=None) as out, tarfile.open(fileobj=out, mode="w|gz", compresslevel=6, format=tarfile.PAX_FORMAT) as tar:

        def put(name: str, content: bytes) -> None:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(content), int(time.time())
            tar.addfile(info, io.BytesIO(content))

        yield put


@dataclass
class Written(WriterCommitMessage):
    task: str
    files: int


class FileWriter(DataSourceWriter):
    """A job's files lie in job=<id>/task=<id>/, packed ones in one archive there; the job's mark, written last, names the tasks that count, and without it readers see none of them."""

    def __init__(self, path: str, packed: bool = False):
        self.path, self.packed, self.job = path, packed, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        fs, root = opened(self.path)
        task, n = uuid.uuid4().hex, 0
        folder = f"{root}/job={self.job}/task={task}"
        try:
            fs.create_dir(folder, recursive=True)
            with (_packing if self.packed else _single)(fs, folder) as put:
                for row in rows:
                    if row["filename"] is None or not NAME.fullmatch(row["filename"]):
                        raise ValueError(f"not a file name: {row['filename']!r}")
                    if row["content"] is not None:
                        put(row["filename"], bytes(row["content"]))
                        n += 1
        except BaseException:
            fs.delete_dir(folder)
            raise
        return Written(task, n)

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        fs.create_dir(f"{root}/job={self.job}", recursive=True)
        with fs.open_output_stream(f"{root}/job={self.job}/{COMMITTED}") as out:
            out.write("".join(f"{m.task}\n" for m in messages if m is not None and m.files).encode())

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, root = opened(self.path)
        folder = f"{root}/job={self.job}"
        if fs.get_file_info(folder).type != FileType.NotFound:
            fs.delete_dir(folder)


@dataclass
class Folder(InputPartition):
    path: str
    ours: bool = False


class FileReader(DataSourceReader):
    """One partition for each task's folder of a committed job; of a folder that wasn't written here, one for itself and each folder in it, whose archives are files like others."""

    def __init__(self, path: str, contents: bool):
        self.path, self.contents, self.names = path, contents, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("filename",):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = these if self.names is None else self.names & these
            else:
                yield f

    def partitions(self) -> list[Folder]:
        fs, root = opened(self.path)
        inside = [f for f in _children(fs, root) if _is_folder(f)]
        jobs = [f for f in inside if f.base_name.startswith("job=")]
        if not jobs:
            return [Folder(p) for p in [root, *[f.path for f in inside if not f.base_name.startswith(("_", "."))]]]
        out = []
        for job in jobs:
            if any(f.base_name == COMMITTED for f in _children(fs, job.path)):
                with fs.open_input_stream(f"{job.path}/{COMMITTED}") as mark:
                    out += [Folder(f"{job.path}/task={t}", True) for t in mark.read().decode().split()]
        return out or [Folder(f"{root}/none")]

    def read(self, partition: Folder) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        if partition.ours and _is_file(fs, f"{partition.path}/{PACKED}"):
            yield from self._unpacked(fs, f"{partition.path}/{PACKED}")
            return
        for info in _children(fs, partition.path):
            if _is_folder(info) or info.base_name.startswith((".", "_")) or not self._wanted(info.base_name):
                continue
            content = error = None
            if self.contents:
                try:
                    with fs.open_input_stream(info.path) as f:
                        content = f.read()
                except OSError as e:
                    error = f"unreadable: {type(e).__name__}"
            yield info.base_name, info.size, info.mtime, content, error, info.path

    def _wanted(self, name: str) -> bool:
        return self.names is None or name in self.names

    def _unpacked(self, fs, path: str) -> Iterator[tuple]:
        """An archive is read from its start to its end, a file at a time; one that is cut off fails the job, as its files can't be listed."""
        with fs.open_input_stream(path, compression=None) as source, tarfile.open(fileobj=source, mode="r|gz") as tar:
            for info in tar:
                tar.members.clear()  # else the archive keeps what it passed
                if self._wanted(info.name) and not info.name.startswith("_"):
                    content = tar.extractfile(info).read() if self.contents else None
                    yield info.name, info.size, datetime.fromtimestamp(info.mtime, timezone.utc), content, None, f"{path}/{info.name}"


class Files(DataSource):
    """Options: path; contents (default true): false lists names, sizes and times without opening a file; packed (default false): a task's files go into one archive."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"], self.options.get("contents", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are only added; delete() takes them away")
        return FileWriter(self.options["path"], self.options.get("packed", "false").lower() == "true")


def _register(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Files)
    return spark


def store(files: DataFrame, path: str, packed: bool = False) -> None:
    """files (filename, content): all of them are there afterwards, or none. Null contents are no files; a name with a folder in it fails the job.

    packed: for many small files that are read together and never deleted singly; each task writes one archive of its own.
    """
    _register(files.sparkSession)
    # the writer takes rows by the source's schema
    rows = files.select("filename", F.length("content").cast("long").alias("bytes"), F.lit(None).cast("timestamp").alias("modified"), F.col("content").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("path"))
    rows.write.format(FORMAT).option("path", path).option("packed", str(packed).lower()).mode("append").save()


def stored(spark: SparkSession, path: str, contents: bool = False) -> DataFrame:
    """Every file of the folder with SCHEMA's columns; a name stored more than once appears as often."""
    return _register(spark).read.format(FORMAT).option("path", path).option("contents", str(contents).lower()).load()


def latest(files: DataFrame) -> DataFrame:
    """Of files stored under one name the last, of equal times that of the greatest path."""
    rest = [c for c in files.columns if c != "filename"]
    return files.groupBy("filename").agg(F.max_by(F.struct(*rest), F.struct("modified", "path")).alias("_f")).select("filename", "_f.*")


def delete(spark: SparkSession, path: str, names: DataFrame) -> None:
    """Files of names (filename), each time they were stored, are deleted in tasks; those that aren't there are no error, those in an archive are."""
    found = stored(spark, path).join(names.select("filename").distinct(), "filename", "left_semi").select("path")

    def remove(rows: Iterator) -> None:
        fs, _ = opened(path)
        for row in rows:
            if f"/{PACKED}/" in row["path"]:
                raise ValueError(f"packed files aren't deleted singly: {row['path']}")
            try:
                fs.delete_file(row["path"])
            except FileNotFoundError:
                pass  # a task that ran before took it

    found.foreachPartition(remove)
