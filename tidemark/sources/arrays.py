"""Arrays in NumPy's file format as a Spark source and sink: rows of matrices by ranges, with digests."""

from __future__ import annotations

import hashlib
import io
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows that one partition reads, unless the option ``rows`` says otherwise, and rows of an Arrow batch.
RANGE, BATCH = 65_536, 4096


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def header(path: str) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, column order, kind and the place of the first cell; raises for anything that isn't a matrix or vector of numbers."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        try:
            version = np.lib.format.read_magic(f)
            read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version]
            shape, by_column, kind = read(f)
        except (ValueError, KeyError) as e:
            raise ValueError(f"{path} is no array file: {e}") from e
        at, size = f.tell(), f.size()
    if kind.kind not in "iuf" or len(shape) not in (1, 2):
        raise ValueError(f"{path} holds {kind} of shape {shape}; a matrix of numbers is needed")
    if size != at + kind.itemsize * int(np.prod(shape, dtype=np.int64)):
        raise ValueError(f"{path} has {size} bytes, not what its header says")
    return shape, by_column, kind, at


def read_rows(path: str, start: int, stop: int) -> np.ndarray:
    """Rows [start, stop) of the array; of other bytes nothing is read, whichever way its cells are laid."""
    shape, by_column, kind, at = header(path)
    n, width = shape[0], shape[1] if len(shape) == 2 else 1
    system, name = _open(path)
    with system.open_input_file(name) as f:
        def span(first, count):
            f.seek(at + first * kind.itemsize)
            return np.frombuffer(f.read(count * kind.itemsize), kind)

        if by_column and len(shape) == 2:
            return np.column_stack([span(c * n + start, stop - start) for c in range(width)]) if width else np.zeros((stop - start, 0), kind)
        return span(start * width, (stop - start) * width).reshape(stop - start, width)


def digest(path: str) -> str:
    """SHA-256 of the cells row by row, as little-endian numbers of their kind: the same for both layouts."""
    shape, _, kind, _ = header(path)
    h = hashlib.sha256()
    for start in range(0, shape[0], RANGE):
        h.update(np.ascontiguousarray(read_rows(path, start, min(shape[0], start + RANGE)).astype(kind.newbyteorder("<"))).tobytes())
    return h.hexdigest()


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], rows: int):
        self.paths, self.rows = paths, rows

    def partitions(self):
        return [_Range(p, s, min(n, s + self.rows)) for p in self.paths for n in [header(p)[0][0]] for s in range(0, n, self.rows)] or [_Range("", 0, 0)]

    def read(self, part):
        for start in range(part.start, part.stop, BATCH):
            got = read_rows(part.path, start, min(part.stop, start + BATCH)).astype(float)
            n, width = got.shape
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width or 1, dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(np.arange(start, start + n)), values], names=["file", "row", "values"])


class ArraySource(DataSource):
    """``spark.read.format("npy").option("rows", n).load(path)``: file, row, values (as doubles) of one array file or of all in a folder, in the order of their names."""

    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "file string, row long, values array<double>"

    def reader(self, schema):
        path = self.options["path"]
        system, name = _open(path)
        found = [path]
        if system.get_file_info(name).type == fs.FileType.Directory:
            found = sorted(f"{path.rstrip('/')}/{i.base_name}" for i in system.get_file_info(fs.FileSelector(name)) if i.base_name.endswith(".npy"))
        return _Reader(found, int(self.options.get("rows", RANGE)))


def read_arrays(spark: SparkSession, path: str, rows: int = RANGE) -> DataFrame:
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy").option("rows", str(rows)).load(path)


def write_arrays(df: DataFrame, path: str, key: str, values: str, kind: str = "<f8") -> list[tuple[str, int, str]]:
    """Rows with arrays of equal length as array files below ``path``, one for each partition's rows in the order of ``key``: (file, rows, digest) of each, by name.

    A file is named by its task's try and moved into place when it is whole; files of tries that didn't count are removed. Arrays of different lengths raise."""
    token = uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        got = [x for b in batches for x in b.column(1).to_pylist()]
        if not got:
            return
        if len({len(x) for x in got}) > 1:
            raise ValueError("arrays of different lengths")
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{token}-{task.taskAttemptId()}.npy"
        cells, out = np.array(got, kind), io.BytesIO()
        np.save(out, cells)
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/.{name}") as f:
            f.write(out.getvalue())
        system.move(f"{folder}/.{name}", f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(cells)], pa.int64()), pa.array([hashlib.sha256(cells.tobytes()).hexdigest()])], names=["file", "rows", "sha256"])

    made = sorted(tuple(r) for r in df.select(key, values).sortWithinPartitions(key).select(key, values).mapInArrow(run, "file string, rows long, sha256 string").collect())  # a row per partition
    system, folder = _open(path)
    system.create_dir(folder, recursive=True)
    for i in system.get_file_info(fs.FileSelector(folder)):
        if token in i.base_name and i.base_name not in {m[0] for m in made}:
            system.delete_file(i.path)
    return made
