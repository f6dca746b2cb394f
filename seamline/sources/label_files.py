"""Label text files (``<split>/<stem>.txt``) as a Spark data source, read and written by the executors.

A file holds one line for each mark; a clean image has a file of 0 bytes. Files are reached through pyarrow's file
systems, so folders may be local (shared) ones or those of an object store or HDFS that pyarrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from seamline.session import shuffle_partitions

FORMAT, DONE = "label_files", "_SUCCESS"
#: Files in a task of a read, and files and characters in a batch.
TASK_FILES, BATCH_FILES, BATCH_CHARACTERS = 2_000, 500, 4 << 20


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder.rstrip("/")
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").strip("/")
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Written(WriterCommitMessage):
    files: int
    lines: int


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_Files]:
        """The label files of every split, some for each task; only names are listed here."""
        system, root = _located(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".txt") and "/" in f.path.removeprefix(root).strip("/"))
        return [_Files(names[k : k + TASK_FILES]) for k in range(0, len(names), TASK_FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = _located(self.folder)
        rows: list[tuple[str, str, str]] = []
        size = 0
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                content = file.read().decode("utf-8", "replace")
            split, name = path.split("/")[-2:]
            rows.append((split, name.removesuffix(".txt"), content))
            size += len(content)
            if len(rows) >= BATCH_FILES or size >= BATCH_CHARACTERS:
                yield self._batch(rows)
                rows, size = [], 0
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.record_batch([pa.array(c, pa.string()) for c in columns], names=["split", "stem", "content"])


class _Writer(DataSourceArrowWriter):
    """Rows come with the lines of a file in order, all in one task. A file gets its name when it is complete, so a
    task that is run again puts the same file in the same place; the folder is marked when every task is through."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder = folder
        system, root = _located(folder)
        if overwrite and system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir_contents(root)
        elif system.get_file_info(f"{root}/{DONE}").type == fs.FileType.File:
            raise ValueError(f"{folder} already holds label files; write with overwrite")
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _located(self.folder)
        attempt, made = uuid.uuid4().hex, set()
        now, file, files, lines = None, None, 0, 0

        def close() -> None:
            if file is not None:
                file.close()
                system.move(f"{root}/{now[0]}/.{now[1]}.{attempt}", f"{root}/{now[0]}/{now[1]}.txt")

        for batch in iterator:
            for split, stem, line in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (split, stem) != now:
                    close()
                    if split not in made:
                        system.create_dir(f"{root}/{split}", recursive=True)
                        made.add(split)
                    now, files = (split, stem), files + 1
                    file = system.open_output_stream(f"{root}/{split}/.{stem}.{attempt}")
                if line is not None:
                    file.write(f"{line}\n".encode())
                    lines += 1
        close()
        return _Written(files, lines)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _located(self.folder)
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{root}/{DONE}") as file:
            file.write(f"{sum(m.files for m in done)} files, {sum(m.lines for m in done)} lines\n".encode())

    def abort(self, messages: list[_Written | None]) -> None:
        """Without its mark the folder counts as unfinished; the next write replaces what is there."""


class LabelFiles(DataSource):
    """Format ``label_files``. Read: (split, stem, content), one row a file. Written: (split, stem, line_no, line)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "split string, stem string, content string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def read_label_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One row per label file below ``folder``: split, stem and whole content; files of 0 bytes have empty content."""
    spark.dataSource.register(LabelFiles)
    return spark.read.format(FORMAT).load(folder)


def write_label_folder(lines: DataFrame, images: DataFrame, folder: str) -> None:
    """A file ``<split>/<stem>.txt`` for every image: its ``lines`` (split, stem, line_no, line) in order, or 0 bytes.

    A line of no characters is written as such, so a blank file is not a clean one. A file is written by one task,
    line by line: it may be of any size. Lines of images that ``images`` (split, stem) does not have are written too.
    Repeated images count once. Null names are an error; null lines are left out.
    """
    lines.sparkSession.dataSource.register(LabelFiles)
    key = ["split", "stem"]
    named = [F.coalesce(F.col(c), F.raise_error(F.lit(f"a label file without {c}")).cast("string")).alias(c) for c in key]
    empty = images.select(*named).distinct().select(*key, F.lit(0).alias("line_no"), F.lit(None).cast("string").alias("line"))
    rows = lines.where("line IS NOT NULL").select(*named, F.col("line_no").cast("int").alias("line_no"), "line").unionByName(empty)
    spread = rows.repartition(shuffle_partitions(lines.sparkSession), *key).sortWithinPartitions(*key, "line_no")
    spread.write.format(FORMAT).mode("overwrite").save(folder)
