"""TFRecord folders as a Spark data source: spark.read.format("tfrecord"), df.write.format("tfrecord").

Options: path (a folder, of a store that pyarrow opens), feature_dtype and label_dtype (float32), chunk (10 000 records a file),
compress (true). What is written has the columns feature and label, arrays of numbers. Tasks write to a folder of their
job, which the driver makes and ends, beside the others; files get their names when all tasks have succeeded, so that neither a failed
job nor a task that ran twice leaves a record behind.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.taskcontext import TaskContext

from sequor.sources.tfrecord import encode_rows, example_batches, frames, opened

SCHEMA = "path string, rec_no long, feature array<double>, feature_shape array<long>, label array<double>, label_shape array<long>"
ENDS = (".tfr", ".tfr.gz")
#: A file in the job's folder while the job runs.
OPEN = "_open"
#: Records that are encoded and summed together.
TOGETHER = 4096
#: Bytes of files that a task reads, about; packed records grow to tens of times as many.
READ, READ_PACKED = 64 << 20, 2 << 20


def shards(folder: str) -> list[tuple[str, int]]:
    """path and size of the folder's shards, by name."""
    store, at = opened(folder)
    return sorted((f.path, f.size) for f in store.get_file_info(FileSelector(at, allow_not_found=True)) if f.type == FileType.File and f.path.endswith(ENDS))


class TFRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        missing = {"feature", "label"} - set(schema.names)
        if missing:
            raise ValueError(f"tfrecord needs the columns feature and label; missing: {', '.join(sorted(missing))}")
        return Writer(dict(self.options), overwrite)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    """One task for files of about READ bytes together, READ_PACKED of packed ones; a file is read as a stream."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.kinds = options.get("feature_dtype", "float32"), options.get("label_dtype", "float32")

    def partitions(self) -> list[Files]:
        out, held = [], 2.0
        for path, size in shards(self.folder):
            share = size / (READ_PACKED if path.endswith(".gz") else READ)
            if held + share > 1:
                out.append(Files([]))
                held = 0.0
            out[-1].paths.append(path)
            held += share
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.folder)
        for path in partition.paths:
            with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as f:
                yield from example_batches(path, f, *self.kinds)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    parts: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.kinds = options.get("feature_dtype", "float32"), options.get("label_dtype", "float32")
        self.chunk, self.compress = int(options.get("chunk", 10_000)), options.get("compress", "true").lower() == "true"
        self.job = f"_job-{uuid.uuid4().hex}"
        store, at = opened(self.folder)
        store.create_dir(f"{at}/{self.job}", recursive=True)
        store.open_output_stream(f"{at}/{self.job}/{OPEN}", compression=None).close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = opened(self.folder)
        part, attempt, parts = TaskContext.get().partitionId(), uuid.uuid4().hex, []
        out = packed = None
        room = 0
        try:
            for b in iterator:
                lo = 0
                while lo < b.num_rows:
                    if not room:
                        self._check(store, at)
                        parts.append(f"{at}/{self.job}/{part:05d}-{len(parts):05d}-{attempt}")
                        out = store.open_output_stream(parts[-1], compression=None)
                        packed = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") if self.compress else out
                        room = self.chunk
                    now = b.slice(lo, min(room, TOGETHER))
                    packed.write(frames(encode_rows(_rows(now.column("feature")), _rows(now.column("label")), *self.kinds)))
                    room, lo = room - now.num_rows, lo + now.num_rows
                    if not room:
                        _close(packed, out)
                        out = None
        finally:
            if out is not None:
                _close(packed, out)
        try:
            self._check(store, at)
        except RuntimeError:
            for p in parts:
                if store.get_file_info(p).type == FileType.File:
                    store.delete_file(p)
            raise
        return Written(part, parts)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.folder)
        old = [p for p, _ in shards(self.folder)]
        new = [p for m in sorted((m for m in messages if m), key=lambda m: m.partition) for p in m.parts]
        first = 0
        if self.overwrite:
            for p in old:
                store.delete_file(p)
        elif old:
            first = 1 + max(int(p.rsplit("/", 1)[1].split("-", 1)[1].split(".")[0]) for p in old)
        for k, p in enumerate(new, first):
            store.move(p, f"{at}/shard-{k:05d}.tfr{'.gz' if self.compress else ''}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _check(self, store: FileSystem, at: str) -> None:
        """A task of a job that has failed must not begin a file, nor make the job's folder anew."""
        if store.get_file_info(f"{at}/{self.job}/{OPEN}").type != FileType.File:
            raise RuntimeError("the job has ended")

    def _clear(self) -> None:
        """Without OPEN no task begins another file; those that are begun may need a second try."""
        store, at = opened(self.folder)
        folder = f"{at}/{self.job}"
        if store.get_file_info(f"{folder}/{OPEN}").type == FileType.File:
            store.delete_file(f"{folder}/{OPEN}")
        for more in (True, True, False):
            try:
                if store.get_file_info(folder).type == FileType.Directory:
                    store.delete_dir(folder)
            except OSError:
                if not more:
                    raise


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of arrays of numbers, or of arrays of such."""
    if not pa.types.is_list(column.type) or pa.types.is_nested(column.type.value_type) or column.null_count or column.flatten().null_count:
        return [np.array(v) for v in column.to_pylist()]
    flat, length = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    return np.split(flat, np.cumsum(length)[:-1])


def _close(packed, out) -> None:
    if packed is not out:
        packed.close()
    out.close()


def register(spark: SparkSession) -> None:
    """Make format("tfrecord") known to a session."""
    spark.dataSource.register(TFRecordSource)
