"""Arrays in .npy files as a Spark source and sink.

Reading: a file's header is parsed once, where the read is planned, and its rows become byte ranges for many
tasks; a task reads its range in chunks. The options ``from``, ``to`` and ``limit`` choose the ranges, so that other
rows are never read. (Filters on ``index`` aren't pushed: Spark keeps a Python source's pushed filters for later
uses of the same frame.) A chunk is read again by reading its range again; no file stays open between tasks.

Writing: a task writes files of bounded size, and the commit names them in order in ``_tensors.json``; files of
lost or failed attempts are in no commit and are not read. ``write_array`` puts numbered rows into one file
instead: tasks write their rows at their own offsets of a file that was made for the planned number of rows, and the
commit trims it to the rows that came. That file equals ``numpy.save`` of the same array byte by byte.

Paths are opened with pyarrow's file systems (local and shared folders, hdfs, s3, gs). One file at offsets needs a
file system that can write in place: a shared folder.
"""

from __future__ import annotations

import io
import json
import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.numbering import numbered
from ..session import shared_path, with_workers

FORMAT = "tensor"
COMMIT = "_tensors.json"
#: Bytes of values that a task reads (a partition), that it holds at once (a chunk), and of a written file.
PARTITION_BYTES, CHUNK_BYTES, FILE_BYTES = 64 << 20, 4 << 20, 64 << 20
_KINDS = {"f": {4: "float", 8: "double"}, "i": {1: "tinyint", 2: "smallint", 4: "int", 8: "bigint"}, "u": {1: "smallint"}}


@dataclass
class Header:
    shape: tuple[int, ...]
    dtype: np.dtype
    size: int  # of the header, in bytes

    @property
    def rows(self) -> int:
        return self.shape[0]

    @property
    def row_values(self) -> int:
        return math.prod(self.shape[1:])

    @property
    def row_bytes(self) -> int:
        return self.row_values * self.dtype.itemsize

    @property
    def element(self) -> str:
        kind = _KINDS.get(self.dtype.kind, {}).get(self.dtype.itemsize)
        if kind is None:
            raise ValueError(f"arrays of {self.dtype} have no column type")
        return kind


def header_bytes(shape: tuple[int, ...], dtype: np.dtype) -> bytes:
    """What ``numpy.save`` writes before the values."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": tuple(shape)})
    return out.getvalue()


def parse_header(start: bytes, name: str) -> Header:
    f = io.BytesIO(start)
    try:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    except (ValueError, struct.error) as e:
        raise ValueError(f"{name} has no array header: {e}") from None
    if not shape:
        raise ValueError(f"{name} holds one value, no rows")
    if fortran and len(shape) > 1:
        raise ValueError(f"{name} is stored by columns; its rows aren't ranges of bytes")
    return Header(shape, dtype, f.tell())


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    """Rows ``first`` to ``first + rows`` of a file; ``index`` is the first one's number in the whole read."""

    def __init__(self, path: str, file: str, header: Header, first: int, rows: int, index: int):
        super().__init__(0)
        self.path, self.file, self.header, self.first, self.rows, self.index = path, file, header, first, rows, index


def plan(path: str, low: int = 0, high: int | None = None, partition_bytes: int = PARTITION_BYTES) -> tuple[list[Range], Header | None]:
    """Ranges of rows ``low`` to ``high`` of a file, of what a commit names, or of a folder's .npy files by name."""
    store, root = _open(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        files = [root]
    else:
        commit = store.get_file_info(f"{root}/{COMMIT}")
        if commit.type == fs.FileType.File:
            with store.open_input_file(commit.path) as f:
                files = [f"{root}/{x['file']}" for x in json.loads(f.read())["files"]]
        else:
            files = sorted(i.path for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".npy"))
    out, at, kind = [], 0, None
    for file in files:
        with store.open_input_file(file) as f:
            head, size = parse_header(f.read_at(min(f.size(), 1 << 16), 0), file), f.size()
        if size < head.size + head.rows * head.row_bytes:
            raise ValueError(f"{file} ends after {max(size - head.size, 0) // max(head.row_bytes, 1)} of its {head.rows} rows")
        if kind and (kind.shape[1:], kind.dtype) != (head.shape[1:], head.dtype):
            raise ValueError(f"{file} holds rows of {head.shape[1:]} {head.dtype}, others {kind.shape[1:]} {kind.dtype}")
        kind = kind or head
        first, last = max(low - at, 0), head.rows if high is None else min(head.rows, high - at)
        step = max(1, partition_bytes // max(head.row_bytes, 1))
        out += [Range(path, file, head, a, min(step, last - a), at + a) for a in range(first, last, step)]
        at += head.rows
        if high is not None and at >= high:
            break
    return out, kind


class TensorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.low = int(options.get("from", 0))
        self.high = min((int(options[k]) + (self.low if k == "limit" else 0) for k in ("to", "limit") if k in options), default=None)
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.chunk_bytes = int(options.get("chunkbytes", CHUNK_BYTES))

    def partitions(self):
        return plan(self.path, self.low, self.high, self.partition_bytes)[0] or [Range(self.path, "", Header((0, 1), np.dtype("float32"), 0), 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        yield from chunks(part, self.chunk_bytes)


def chunks(part: Range, chunk_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """A range's rows, a bounded number of bytes at a time; can be called again for the same rows."""
    if not part.rows:
        return
    head, step = part.header, max(1, chunk_bytes // max(part.header.row_bytes, 1))
    store, _ = _open(part.path)
    with store.open_input_file(part.file) as f:
        for a in range(part.first, part.first + part.rows, step):
            n = min(step, part.first + part.rows - a)
            raw = f.read_at(n * head.row_bytes, head.size + a * head.row_bytes)
            values = np.frombuffer(raw, head.dtype)
            values = values.astype(np.int16) if head.dtype.kind == "u" else values.astype(head.dtype.newbyteorder("="), copy=False)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * head.row_values)
            index = pa.array(np.arange(part.index + a - part.first, part.index + a - part.first + n))
            yield pa.RecordBatch.from_arrays([index, pa.ListArray.from_arrays(offsets, pa.array(values))], names=["index", "values"])


@dataclass
class Written(WriterCommitMessage):
    task: int
    files: list[tuple[str, int]]


class TensorWriter(DataSourceArrowWriter):
    """Files of whole rows below a folder, committed together."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.shape = tuple(int(x) for x in options.get("shape", "").split(",") if x)
        self.dtype = np.dtype(options.get("dtype", "float32"))
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        if not self.shape:
            raise ValueError("the option shape gives a row's shape, as in 64,64,6")

    def write(self, batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        size, files, held, held_rows = math.prod(self.shape), [], [], 0
        most = max(1, self.file_bytes // max(size * self.dtype.itemsize, 1))

        def flush(rows: np.ndarray):
            name = f"part-{task:05d}-{len(files):04d}-{uuid.uuid4().hex}.npy"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(header_bytes((len(rows), *self.shape), self.dtype))
                f.write(np.ascontiguousarray(rows).tobytes())
            files.append((name, len(rows)))

        for batch in batches:
            rows = row_matrix(batch.column("values"), size, self.dtype)
            while len(rows):
                some = rows[: most - held_rows]
                held.append(some)
                held_rows += len(some)
                rows = rows[len(some) :]
                if held_rows == most:
                    flush(np.concatenate(held))
                    held, held_rows = [], 0
        if held_rows:
            flush(np.concatenate(held))
        return Written(task, files)

    def commit(self, messages):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        fresh = [{"file": f, "rows": n} for m in sorted((m for m in messages if m), key=lambda m: m.task) for f, n in m.files]
        old = []
        if store.get_file_info(f"{root}/{COMMIT}").type == fs.FileType.File:
            with store.open_input_file(f"{root}/{COMMIT}") as f:
                old = json.loads(f.read())["files"]
        kept = [] if self.overwrite else old
        if kept:
            with store.open_input_file(f"{root}/{kept[0]['file']}") as f:
                head = parse_header(f.read_at(min(f.size(), 1 << 16), 0), kept[0]["file"])
            if (head.shape[1:], head.dtype) != (self.shape, self.dtype):
                self.abort(messages)
                raise ValueError(f"rows of {self.shape} {self.dtype} don't join rows of {head.shape[1:]} {head.dtype}")
        if not fresh and not kept:  # rows of no file still have a shape
            name = f"part-none-{uuid.uuid4().hex}.npy"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(header_bytes((0, *self.shape), self.dtype))
            fresh = [{"file": name, "rows": 0}]
        staged = f"{root}/_{uuid.uuid4().hex}.json"
        with store.open_output_stream(staged) as f:
            f.write(json.dumps({"files": kept + fresh}).encode())
        store.move(staged, f"{root}/{COMMIT}")  # what was read before, or all that is new
        for x in [] if kept else old:
            store.delete_file(f"{root}/{x['file']}")

    def abort(self, messages):
        store, root = _open(self.path)
        for m in messages:
            for f, _ in m.files if m else []:
                store.delete_file(f"{root}/{f}")


def row_matrix(values: pa.Array, size: int, dtype: np.dtype) -> np.ndarray:
    """Lists of ``size`` values as rows; another length or a null fails."""
    if values.null_count:
        raise ValueError("a row without values")
    lengths = np.asarray(values.value_lengths())
    if len(lengths) and (lengths != size).any():
        raise ValueError(f"a row of {int(lengths[lengths != size][0])} values, not {size}")
    flat = values.flatten()
    if flat.null_count:
        raise ValueError("a value is null")
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(values), size)


class TensorSource(DataSource):
    """``spark.read.format("tensor").load(path)``: index, values. Options: from, to, limit, partitionBytes, chunkBytes.
    ``df.write.format("tensor")`` with the options shape, dtype, fileBytes: the column ``values``."""

    @classmethod
    def name(cls):
        return FORMAT

    def _plain(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self):
        kind = plan(self._plain()["path"])[1]
        return f"index bigint, values array<{kind.element if kind else 'float'}>"

    def reader(self, schema: StructType) -> TensorReader:
        return TensorReader(self._plain())

    def writer(self, schema: StructType, overwrite: bool) -> TensorWriter:
        if "values" not in schema.names:
            raise ValueError("a tensor is written from a column named values")
        return TensorWriter(self._plain(), overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the source and sink known to a session."""
    with_workers(spark)
    spark.dataSource.register(TensorSource)
    return spark


def read_tensors(spark: SparkSession, path: str, **options) -> DataFrame:
    """index, values of all rows, in files' order."""
    return register(spark).read.format(FORMAT).options(**options).load(path)


def write_tensors(rows: DataFrame, path: str, shape: tuple[int, ...], dtype: str = "float32", mode: str = "overwrite", **options) -> None:
    """The column ``values`` as files below ``path``; rows keep their partitions' order."""
    register(rows.sparkSession)
    rows.select("values").write.format(FORMAT).mode(mode).options(shape=",".join(map(str, shape)), dtype=dtype, **options).save(path)


def write_array(rows: DataFrame, path: str, shape: tuple[int, ...], *order, dtype: str = "float32", planned: int | None = None) -> int:
    """The column ``values`` in ``order`` as one .npy file on a shared folder; rows that it has.

    The file is made for ``planned`` rows (all that come, where that is unset) and trimmed to those that came; more
    than planned is an error, and nothing is then left at ``path``. Every row's place is known before it is written,
    so an attempt that runs twice writes the same bytes at the same place.
    """
    spark, kind = with_workers(rows.sparkSession), np.dtype(dtype)
    store, target = _open(path)
    if not isinstance(store, fs.LocalFileSystem):
        raise ValueError(f"{path} can't be written in place; write_tensors writes files for any store")
    placed = numbered(rows.select("values", *[F.col(c) if isinstance(c, str) else c for c in order if isinstance(c, str)]), *order)
    size, row_bytes = math.prod(shape), math.prod(shape) * kind.itemsize
    n = placed.count()
    if planned is not None and n > planned:
        raise ValueError(f"{n} rows for an array of {planned}")
    made_for = n if planned is None else planned
    head = header_bytes((made_for, *shape), kind)
    own = f"{target}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(own) or ".", exist_ok=True)
    with open(own, "wb") as f:
        f.write(head)
        f.truncate(len(head) + made_for * row_bytes)
    start = len(head)

    def put(batches):
        with open(own, "r+b") as f:
            for batch in batches:
                values, place = row_matrix(batch.column("values"), size, kind), batch.column("place").to_numpy()
                turn = np.argsort(place, kind="stable")
                breaks = np.flatnonzero(np.diff(place[turn]) != 1) + 1
                for run in np.split(turn, breaks):
                    if len(run):
                        f.seek(start + int(place[run[0]]) * row_bytes)
                        f.write(np.ascontiguousarray(values[run]).tobytes())
                f.flush()
                os.fsync(f.fileno())
                yield pa.RecordBatch.from_arrays([pa.array([len(place)], pa.int64())], names=["n"])

    try:
        came = placed.select("values", "place").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if came != n:
            raise RuntimeError(f"{came} of {n} rows were written")
        final = header_bytes((n, *shape), kind)
        if len(final) != len(head):  # a header of another length would move every row
            raise RuntimeError("the trimmed array's header has another length")
        with open(own, "r+b") as f:
            f.write(final)
            f.truncate(len(final) + n * row_bytes)
        os.replace(own, target)
    except BaseException:
        if os.path.exists(own):
            os.remove(own)
        raise
    return n


def through_files(rows: DataFrame, shape: tuple[int, ...], *order, **options) -> DataFrame:
    """Rows written to the shared folder in ``order`` and read back: index, values."""
    spark = rows.sparkSession
    path = shared_path(spark, "tensors")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    write_tensors(ranged, path, shape, **options)
    return read_tensors(spark, path)
