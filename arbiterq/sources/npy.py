"""Dense matrices in .npy files as a Spark data source: read in runs of rows, by any range of them, and written with commit and abort.

``spark.dataSource.register(Npy)``, then ``spark.read.format("npy").load(path)`` gives (ordinal, h): the place of each row from 0 over the files of a
folder by name (or of one file), and its numbers. Options ``start`` and ``end``, and with the option ``pushdown`` filters on ordinal (it needs
spark.sql.python.filterPushdown.enabled), choose rows before anything is read; a task reads one run of ``cells`` numbers at most. Writing takes one column of
vectors, of one length; a task writes files of ``cells`` numbers at most under hidden names, which the driver renames once all tasks are done.
Paths are URIs that pyarrow's file systems reach from every executor.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

CELLS = 4_000_000


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{os.path.abspath(path)}")


@dataclass
class Matrix:
    """One file: its rows' places, where they begin in it, and their shape."""

    path: str
    first: int
    rows: int
    width: int
    offset: int
    kind: str


def headers(path: str) -> list[Matrix]:
    """The matrices of a file or folder; only headers are read."""
    files, top = store(path)
    info = files.get_file_info(top)
    names = [top] if info.type == fs.FileType.File else sorted(f.path for f in files.get_file_info(fs.FileSelector(top)) if f.base_name.endswith(".npy") and f.base_name[0] not in "._")
    out, first = [], 0
    for name in names:
        with files.open_input_file(name) as f:
            version = np.lib.format.read_magic(f)
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if by_column or len(shape) != 2:
                raise ValueError(f"{name}: a matrix in row order is needed")
            out.append(Matrix(name, first, shape[0], shape[1], f.tell(), kind.str))
        first += shape[0]
    return out


@dataclass
class Run(InputPartition):
    """Rows [start, end) of a matrix, counted in its file."""

    matrix: Matrix
    start: int
    end: int

    def __init__(self, matrix: Matrix, start: int, end: int) -> None:
        super().__init__(None)
        self.matrix, self.start, self.end = matrix, start, end


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.cells = options["path"], int(options.get("cells", CELLS))
        self.start, self.end = int(options.get("start", 0)), int(options["end"]) if "end" in options else None

    def partitions(self) -> list[Run]:
        out = []
        for m in headers(self.path):
            lo, hi = max(0, self.start - m.first), m.rows if self.end is None else min(m.rows, self.end - m.first)
            step = max(1, self.cells // max(1, m.width))
            out += [Run(m, at, min(hi, at + step)) for at in range(lo, hi, step)]
        return out or [Run(Matrix("", 0, 0, 0, 0, "<f4"), 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        m = run.matrix
        if run.end <= run.start:
            return
        size = m.width * np.dtype(m.kind).itemsize
        with store(self.path)[0].open_input_file(m.path) as f:
            x = np.frombuffer(f.read_at((run.end - run.start) * size, m.offset + run.start * size), m.kind).astype(np.float32)
        ends = pa.array(np.arange(run.end - run.start + 1) * m.width, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.first + run.start, m.first + run.end)), pa.ListArray.from_arrays(ends, pa.array(x))], ["ordinal", "h"])


class Pushed(Reader):
    """Takes filters on ordinal as bounds of the range. Spark wants it only where push-down is switched on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("ordinal",) or not isinstance(getattr(f, "value", None), int) or type(f) not in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, f.value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                end = f.value + (not isinstance(f, LessThan))
                self.end = end if self.end is None else min(self.end, end)


@dataclass
class Written(WriterCommitMessage):
    task: int
    names: list[str] = field(default_factory=list)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.cells, self.overwrite, self.run = options["path"], int(options.get("cells", CELLS)), overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, top = store(self.path)
        files.create_dir(top)
        done, held = Written(TaskContext.get().partitionId()), []

        def put() -> None:
            raw, name = io.BytesIO(), f"_{self.run}-{uuid.uuid4().hex}.npy"
            np.save(raw, np.concatenate(held))
            with files.open_output_stream(f"{top}/{name}") as out:
                out.write(raw.getvalue())
            done.names.append(name)
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0)
            if x.null_count or x.flatten().null_count or len(set(x.value_lengths().to_pylist())) != 1:
                raise ValueError("vectors of one length, without nulls, are needed")
            held.append(x.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1))
            if sum(a.size for a in held) >= self.cells:
                put()
        if held:
            put()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files, top = store(self.path)
        files.create_dir(top)
        old = [f.path for f in files.get_file_info(fs.FileSelector(top)) if f.base_name.endswith(".npy") and f.base_name[0] not in "._"]
        if self.overwrite:
            for path in old:
                files.delete_file(path)
        at = 0 if self.overwrite else len(old)
        for message in sorted((m for m in messages if m), key=lambda m: m.task):
            for name in message.names:
                files.move(f"{top}/{name}", f"{top}/part-{at:08d}.npy")
                at += 1

    def abort(self, messages: list[Written | None]) -> None:
        """Deletes the run's hidden files. A task that is still stopping may leave one behind; readers never see it."""
        files, top = store(self.path)
        if files.get_file_info(top).type == fs.FileType.Directory:  # a task that failed has no message, but its files have the run's name
            for f in files.get_file_info(fs.FileSelector(top)):
                if f.base_name.startswith(f"_{self.run}-"):
                    files.delete_file(f.path)


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "ordinal bigint, h array<float>"

    def reader(self, schema: StructType) -> Reader:
        return Pushed(self.options) if self.options.get("pushdown") == "true" else Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)
