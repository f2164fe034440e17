"""One Markdown file per page, written by Spark tasks and committed as a whole.

``MarkdownFiles`` is a Python data source: ``df.write.format("markdown_files")`` takes
(file_name, text) rows.  A task writes into a folder of its own attempt and reports it;
only the commit, on the driver, lists the reported folders in a manifest.  A task that runs twice, or a
job that fails, leaves folders that no manifest names: appends are neither doubled
nor half-read.  ``mode("overwrite")`` starts a new list.

Reading deals the committed folders to tasks, which list them themselves: the driver
holds a row per folder and none per file.

The path may be on any file system that pyarrow and Spark both reach.  A name that
occurs twice in one write is two files in two folders, or one (the last) in one folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "markdown_files"
MANIFESTS = "_manifests"
TASK_FILES, BATCH_BYTES = 10_000, 2 << 20  # at most, of a reading task and (but for the last file) of a batch it passes on


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class MarkdownFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file_name string, text string"

    def writer(self, schema, overwrite: bool) -> MarkdownWriter:
        return MarkdownWriter(self.options["path"].rstrip("/"), overwrite)

    def reader(self, schema) -> MarkdownReader:
        path = self.options["path"].rstrip("/")
        return MarkdownReader(path, json.loads(self.options["folders"]) if "folders" in self.options else _committed(path))


class MarkdownWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = _open(self.path)
        folder, n = f"{self.job}-{uuid.uuid4().hex}", 0  # new for every attempt
        where.create_dir(f"{root}/{folder}", recursive=True)
        for batch in iterator:
            for name, text in zip(batch.column("file_name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                with where.open_output_stream(f"{root}/{folder}/{name}") as out:
                    out.write((text or "").encode())
                n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = _open(self.path)
        done = [m for m in messages if m is not None]
        where.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        old = [f.path for f in where.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}"))] if self.overwrite else []
        with where.open_output_stream(f"{root}/{MANIFESTS}/{self.job}.json") as out:
            out.write(json.dumps({m.folder: m.files for m in done if m.files}).encode())
        for path in old:
            where.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = _open(self.path)
        for m in messages:
            if m is not None:
                where.delete_dir(f"{root}/{m.folder}")


@dataclass
class Stretch(InputPartition):
    """Files ``start`` to ``end`` of a folder in the order of their names; to the last without ``end``."""

    folder: str
    start: int
    end: int | None


class MarkdownReader(DataSourceReader):
    def __init__(self, path: str, folders: dict[str, int]):
        self.path, self.folders = path, folders

    def partitions(self) -> list[Stretch]:
        return [Stretch(folder, i, i + TASK_FILES if i + TASK_FILES < files else None)
                for folder, files in sorted(self.folders.items()) for i in range(0, max(1, files), TASK_FILES)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        where, root = _open(self.path)
        names = sorted(f.base_name for f in where.get_file_info(fs.FileSelector(f"{root}/{partition.folder}")) if f.type == fs.FileType.File)
        shown, texts, size = [], [], 0
        for name in names[partition.start: partition.end]:
            if name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"):
                continue  # Spark's readers take these for hidden files
            with where.open_input_stream(f"{root}/{partition.folder}/{name}") as f:
                text = f.read()
            if not text:
                continue
            shown.append(name.replace("+", " "))
            texts.append(text)
            size += len(text)
            if size >= BATCH_BYTES:
                yield _batch(shown, texts)
                shown, texts, size = [], [], 0
        if shown:
            yield _batch(shown, texts)


def _batch(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["file_name", "text"])


def write_markdown(pages: DataFrame, path: str, mode: str = "append") -> None:
    """``pages`` (file_name, text) as files under ``path``."""
    pages.sparkSession.dataSource.register(MarkdownFiles)
    pages.select("file_name", "text").write.format(NAME).mode(mode).save(path)


def _committed(path: str) -> dict[str, int]:
    where, root = _open(path)
    out: dict[str, int] = {}
    for info in where.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)):
        with where.open_input_stream(info.path) as f:
            out |= json.loads(f.read())
    return out


def committed(spark: SparkSession, path: str) -> dict[str, int]:
    """Folders that were committed, with their numbers of files: one per task that wrote."""
    return _committed(path.rstrip("/"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of all files committed by now; an empty file has no row, a plus sign in a name reads as a blank."""
    folders = committed(spark, path)
    if not folders:
        return spark.createDataFrame([], "file_name string, text string")
    spark.dataSource.register(MarkdownFiles)
    return spark.read.format(NAME).option("folders", json.dumps(folders)).load(path)
