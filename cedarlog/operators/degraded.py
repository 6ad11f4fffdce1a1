"""Degrade files: what could not be stored goes to text files, one for each trace and time, through Spark's writer protocol.

Tasks write into a folder of the job's own; the driver moves all files to their names when every task has ended, and deletes
the folder when the job fails, so that readers see whole files or none. Paths may lie on any file system that pyarrow opens.
A task notes its files in a list beside them, and the driver reads these lists piece by piece: it never holds all names.
One folder takes no more names than its file system's index (about 7 million of these on ext4), so files can be dealt over folders.
"""

from __future__ import annotations

import errno
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .sinks import UUID

FORMAT = "cedarlog_degraded"
ROWS = "file string, line string, size bigint"
#: Files that are moved between two looks at a list, and bytes that are read at once.
MOVES, PIECE = 10_000, 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task, beside which lies the list of its files: a JSON line for each."""

    own: str


def _store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer(DataSourceWriter):
    """Rows come sorted by file. A file that would exceed ``most`` bytes goes on in another one, numbered .1, .2 and so on.
    ``names``: a folder that gets the tasks' lists when all files are in their places, or nothing. ``folders``: how many
    folders the files are dealt over, or 0; then rows come sorted by folder and file."""

    def __init__(self, path: str, most: int, names: str, folders: int = 0):
        self.path, self.most, self.names, self.folders, self.job = path.rstrip("/"), most, names.rstrip("/"), folders, uuid.uuid4().hex

    @property
    def temporary(self) -> str:
        return f"{self.path}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = _store(self.temporary)
        own = uuid.uuid4().hex  # of this attempt, so that a second one of the task cannot mix with it
        store.create_dir(f"{root}/{own}", recursive=False)  # fails once the job is given up and its folder is gone
        name, size, part, folder, place, out = None, 0, 0, "", None, None
        names = store.open_output_stream(self._list(root, own), compression="gzip")

        def end() -> None:
            if out is not None:
                out.close()
                if store.type_name == "local":
                    os.chmod(place, 0o600)

        try:
            for row in iterator:
                data = (row.line or "").encode("utf-8", "replace") + b"\n"
                if row.file != name:
                    name, part, size = row.file, 0, 0
                    fresh = True
                    if self.folders and folder != (to := f"{zlib.crc32(name.encode()) % self.folders:03x}/"):
                        folder = to
                        store.create_dir(f"{root}/{own}/{folder}", recursive=False)
                else:
                    fresh = bool(self.most > 0 and size and size + len(data) > self.most)
                    part += fresh
                if fresh:
                    end()
                    file = f"{folder}{name}.{part}.log" if part else f"{folder}{name}.log"
                    place = f"{root}/{own}/{file}"
                    out, size = store.open_output_stream(place), 0
                    names.write(json.dumps({"file": file}).encode() + b"\n")
                out.write(data)
                size += len(data)
            end()
            names.close()
        except BaseException:
            if out is not None:
                out.close()
            names.close()
            if store.get_file_info(f"{root}/{own}").type != fs.FileType.NotFound:
                store.delete_dir(f"{root}/{own}")
            raise
        return Written(own)

    @staticmethod
    def _list(root: str, own: str) -> str:
        return f"{root}/{own}.json.gz"

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        temporary, done = _store(self.temporary)[1], [m.own for m in messages if m]
        with ThreadPoolExecutor(8) as pool:
            for own in done:
                if self.folders and store.type_name == "local":
                    _move_folders(f"{temporary}/{own}", root)
                else:
                    self._move_files(store, own, temporary, root, pool)
        if self.names:
            kept, folder = _store(self.names)
            kept.create_dir(folder, recursive=True)
            for own in done:
                fs.copy_files(self._list(temporary, own), self._list(folder, own), source_filesystem=store, destination_filesystem=kept)
        self._drop()

    def _move_files(self, store, own: str, temporary: str, root: str, pool: ThreadPoolExecutor) -> None:
        local, last = store.type_name == "local", ""
        put = os.replace if local else store.move
        move = lambda file: put(f"{temporary}/{own}/{file}", f"{root}/{file}")
        with store.open_input_stream(self._list(temporary, own), compression="gzip") as stream:
            files = (json.loads(line)["file"] for line in _lines(stream))
            while some := list(islice(files, MOVES)):
                for folder in dict.fromkeys(os.path.dirname(x) for x in some):
                    if folder != last:
                        store.create_dir(f"{root}/{folder}", recursive=True)
                        last = folder
                for _ in map(move, some) if local else pool.map(move, some):
                    pass

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        store, root = _store(self.temporary)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


def _move_folders(source: str, target: str) -> None:
    """A folder that is not there yet moves whole; into others, files move one by one."""
    for folder in os.listdir(source):
        try:
            os.rename(f"{source}/{folder}", f"{target}/{folder}")
        except OSError as e:
            if e.errno not in (errno.ENOTEMPTY, errno.EEXIST):
                raise
            for file in os.listdir(f"{source}/{folder}"):
                os.replace(f"{source}/{folder}/{file}", f"{target}/{folder}/{file}")


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while piece := stream.read(PIECE):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole


class DegradedFiles(DataSource):
    """Options: path, bytes (most of a file, 0 for no limit), names (a folder for the lists of files) and folders (0: none)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("degrade files are only added")
        writer = Writer(self.options["path"], int(self.options.get("bytes", 0)), self.options.get("names", ""), int(self.options.get("folders", 0)))
        store, root = _store(writer.temporary)
        store.create_dir(root, recursive=True)
        return writer


def file_of(trace: str = "trace_id", at_ms: str = "ts_ms"):
    """<trace>_<ms>; a trace id that is no UUID is hashed, as it becomes a file's name."""
    safe = F.when(F.col(trace).rlike(UUID), F.col(trace)).otherwise(F.substring(F.sha2(F.coalesce(F.col(trace), F.lit("")), 256), 1, 32))
    return F.concat(safe, F.lit("_"), F.coalesce(F.col(at_ms).cast("string"), F.lit("0")))


def write_degraded(records: DataFrame, path: str, most_bytes: int = 0, line: str = "content", order: str = "seq", names: str = "", folders: int = 0) -> None:
    """Lines of ``records`` to files under ``path``, in order; only ever all of them or none.

    A null line is an empty one; a single line above ``most_bytes`` is a file of its own; an empty table adds no file; a file
    of the same name from an earlier call is replaced, so a call that is repeated changes nothing. Records of one trace
    and time are written by one task, line by line, without being held. ``names``: see ``read_degraded``. ``folders``: files lie
    in so many folders under ``path``, by the CRC-32 of their names; one folder alone is full at some million files."""
    spark: SparkSession = records.sparkSession
    spark.dataSource.register(DegradedFiles)
    rows = records.select(file_of().alias("file"), F.col(line).cast("string").alias("line"), F.col(order).cast("long").alias("size"))
    by = [F.crc32("file") % folders] if folders else []
    write = rows.repartition(*(by or ["file"])).sortWithinPartitions(*by, "file", "size").write.format(FORMAT).mode("append")
    write.option("path", path).option("bytes", most_bytes).option("names", names).option("folders", folders).save()


def _measure(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        for batch in batches:
            out = []
            for name in batch["file"]:
                size = lines = 0
                with store.open_input_stream(f"{root}/{name}") as stream:
                    while piece := stream.read(PIECE):
                        size, lines = size + len(piece), lines + piece.count(b"\n")
                out.append((name.rsplit("/", 1)[-1], size, lines))
            yield pd.DataFrame(out, columns=["file", "size", "lines"])

    return run


def read_degraded(spark: SparkSession, path: str, names: str) -> DataFrame:
    """(file, size, lines) of the files under ``path`` that the lists in ``names`` hold, from their bytes.

    There are about as many files as records, more than a driver can list: tasks take the names from the lists that
    ``write_degraded`` left, and read the files by pieces."""
    files = spark.read.schema("file string").json(names).repartition(4 * spark.sparkContext.defaultParallelism)
    return files.mapInPandas(_measure(path.rstrip("/")), "file string, size long, lines long")
