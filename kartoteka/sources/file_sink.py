"""A sink of whole files: rows of (name, content) become files of one folder when the job commits, and none of them before.

Tasks write into a staging folder of their own attempt; the commit moves what the attempts that count have written, task by
task, and an abort removes the staging. So an action writes once however often tasks run, a failed one leaves nothing, and the
driver holds the names of one task's files at a time. A file of the same name is replaced; of several rows with one name in a
job the last task's counts.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Moves at once when a job commits.
MOVES = 16
SCHEMA = "name string, content binary"


@dataclass
class Written(WriterCommitMessage):
    """A task attempt's folder and how many files it wrote there."""

    folder: str
    files: int


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _opened(self.folder)
        own, n, made = f"{base}/{self.staging}/{uuid.uuid4().hex}", 0, set()
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                name = name.as_py()
                if not name or posixpath.normpath(name) != name or name.startswith(("/", "..", "_staging-")):
                    raise ValueError(f"not a file name within the folder: {name!r}")
                at = posixpath.dirname(f"{own}/{name}")
                if at not in made:
                    fs.create_dir(at, recursive=True)
                    made.add(at)
                with fs.open_output_stream(f"{own}/{name}") as f:
                    f.write(content.as_buffer())
                n += 1
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as stores

        fs, base = _opened(self.folder)
        fs.create_dir(base, recursive=True)

        def moved(at: str, name: str) -> None:
            to = f"{base}/{name}"
            if "/" in name:
                fs.create_dir(posixpath.dirname(to), recursive=True)
            if fs.get_file_info(to).type != stores.FileType.NotFound:
                fs.delete_file(to)
            fs.move(f"{at}/{name}", to)

        with ThreadPoolExecutor(MOVES) as pool:
            for m in messages:
                if m is None or not m.files:
                    continue
                names = [x.path[len(m.folder) + 1 :] for x in fs.get_file_info(stores.FileSelector(m.folder, recursive=True)) if x.is_file]
                list(pool.map(lambda name, at=m.folder: moved(at, name), names))
        self._cleared(fs, base)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _opened(self.folder)
        self._cleared(fs, base)

    def _cleared(self, fs, base: str) -> None:
        from pyarrow import fs as stores

        at = f"{base}/{self.staging}"
        if fs.get_file_info(at).type != stores.FileType.NotFound:
            fs.delete_dir(at)


class NamedFiles(DataSource):
    """The format named_files, with the option path: a folder that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are added to a folder or replaced by name: use the mode append")
        return FileWriter(self.options["path"])


def write(files: DataFrame, folder: str) -> None:
    """Writes rows of (name, content) as files of the folder."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").mode("append").option("path", folder).save()
