"""A sink of one file for each row, committed in two phases, and what of a set of files has changed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


FORMAT = "quillgrid_files"
#: Renames at once when a job is committed.
RENAMES = 16


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Staged(WriterCommitMessage):
    """What a task hands over: its folder and how many files lie in it; names stay in the store."""

    folder: str
    files: int


class FileWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own; commit moves the files of the attempts that count, abort removes all."""

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _stage(self) -> str:
        return f"{self.path}/_staged-{self.job}"

    def write(self, rows: Iterator[Row]) -> Staged:
        store, top = _store(self._stage())
        folder, n = f"{top}/{uuid.uuid4().hex}", 0
        store.create_dir(folder, recursive=True)
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name in (".", ".."):
                raise ValueError(f"not the name of a file: {name!r}")
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(bytes(row["content"] or b""))
            n += 1
        return Staged(folder, n)

    def commit(self, messages: Sequence[Staged | None]) -> None:
        from pyarrow.fs import FileSelector

        store, top = _store(self._stage())
        target = top.rsplit("/", 1)[0]
        with ThreadPoolExecutor(RENAMES) as pool:
            for m in messages:
                if m is None or not m.files:
                    continue
                found = store.get_file_info(FileSelector(m.folder))
                if len(found) != m.files:
                    raise OSError(f"{m.folder} holds {len(found)} files of {m.files}: two rows had the same name")
                list(pool.map(lambda f: store.move(f.path, f"{target}/{f.base_name}"), found))
        self._clear()

    def abort(self, messages: Sequence[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        store, top = _store(self._stage())
        if store.get_file_info(top).type != FileType.NotFound:
            store.delete_dir(top)


class FileSink(DataSource):
    """df.write.format("quillgrid_files").mode("append").save(folder) of rows (name string, content binary); the folder is one that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added or replaced by name: use mode append")
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows of files have name and content")
        return FileWriter(self.options["path"])


def digests(files: DataFrame) -> DataFrame:
    """(name, sha256) of files (name, content): what a manifest keeps of them."""
    return files.select("name", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("sha256"))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that a manifest (name, sha256) lacks or has with other content: the only ones to write."""
    told = files.withColumn("sha256", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    return told.join(manifest.select("name", "sha256").distinct(), ["name", "sha256"], "left_anti").drop("sha256")


def save(files: DataFrame, folder: str) -> None:
    """One file for each row (name, content) in ``folder``, those of the same name replaced.

    A task that is run again leaves no second file and a job that fails none. A driver that dies while files are
    moved leaves some of them, each whole; saving again replaces these.
    """
    spark = files.sparkSession
    spark.dataSource.register(FileSink)
    files.select("name", "content").write.format(FORMAT).mode("append").save(folder)

