"""Matrices with names: folders of numpy files, read in ranges of rows.

A folder holds for each part a matrix (``.npy``, or ``.npz`` with one array, by numpy's name for it ``arr_0``) and a text file ``.names``
with one name a row. Matrices that are stored as they are (not compressed) are read by offset, so that one large file is read by many tasks.
"""

from __future__ import annotations

import io
import math
import sys
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Numpy's name for an array that was saved without one.
ARRAY = "arr_0"


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _header(f: io.IOBase) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](f)


def layout(path: str) -> tuple[tuple[int, ...], np.dtype, int | None]:
    """A matrix file's shape, type and first byte of data: None where rows can't be reached by offset."""
    where, name = _file(path)
    with where.open_input_file(name) as raw:
        if not name.endswith(".npz"):
            shape, by_column, kind = _header(raw)
            return shape, kind, None if by_column else raw.tell()
        with zipfile.ZipFile(raw) as z:
            entry = z.getinfo(f"{ARRAY}.npy")
            with z.open(entry) as inner:
                shape, by_column, kind = _header(inner)
                head = inner.tell()
        if entry.compress_type != zipfile.ZIP_STORED or by_column:
            return shape, kind, None
        raw.seek(entry.header_offset + 26)  # where a local header holds the lengths of its name and of what follows it
        lengths = np.frombuffer(raw.read(4), dtype="<u2")
        return shape, kind, entry.header_offset + 30 + int(lengths.sum()) + head


def rows_of(path: str, low: int, high: int) -> np.ndarray:
    """Rows ``low`` up to ``high`` of a matrix file."""
    (_, width), kind, offset = layout(path)
    where, name = _file(path)
    with where.open_input_file(name) as raw:
        if offset is not None:
            size = width * kind.itemsize
            return np.frombuffer(raw.read_at((high - low) * size, offset + low * size), dtype=kind).reshape(-1, width)
        whole = np.load(io.BytesIO(raw.read()), allow_pickle=False)
        return (whole[ARRAY] if name.endswith(".npz") else whole)[low:high]


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", 100_000))
        if self.rows < 1:
            raise ValueError("rows must be at least 1")

    def partitions(self) -> list[Range]:
        where, name = _file(self.path)
        info = where.get_file_info(name)
        found = where.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else "file://"
        out = []
        for f in sorted(found, key=lambda x: x.path):
            if f.path.endswith((".npy", ".npz")):
                path = prefix + f.path
                shape, _, offset = layout(path)
                if len(shape) != 2:
                    raise ValueError(f"not a matrix: {path}")
                step = self.rows if offset is not None else max(1, shape[0])
                out += [Range(path, low, min(shape[0], low + step)) for low in range(0, shape[0], step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        for low in range(part.low, part.high, 4096):
            m = rows_of(part.path, low, min(part.high, low + 4096)).astype(np.float64)
            n, width = m.shape
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(m.ravel()))
            file = part.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.arange(low, low + n)), vectors], names=["file", "at", "embedding"])


class MatrixSource(DataSource):
    """Rows of numpy matrices: file, at (the row's place in it) and embedding. Options: path, rows (a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "numpy_matrix"

    def schema(self) -> str:
        return "file string, at long, embedding array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)


def read_matrix(spark: SparkSession, path: str, rows: int = 100_000, subset: DataFrame | None = None) -> DataFrame:
    """(name, embedding) of the matrices in a folder, names joined by place; those of ``subset`` (name) only, if given.

    A task reads at most ``rows`` rows. A matrix row without a name, or a name without a row, is an error.
    """
    spark.dataSource.register(MatrixSource)
    vectors = spark.read.format(MatrixSource.name()).options(path=path, rows=str(rows)).load()
    lines = spark.read.option("pathGlobFilter", "*.names").text(path, wholetext=True)
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)\.names$", 1)
    names = lines.select(file.alias("file"), F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("at", "name")).where("name <> ''")
    both = vectors.join(names, ["file", "at"], "full")
    lost = F.raise_error(F.concat(F.lit("names and rows don't match in "), F.col("file"))).cast("string")
    both = both.select(F.when(F.col("name").isNull() | F.col("embedding").isNull(), lost).otherwise(F.col("name")).alias("name"), "embedding")
    return both if subset is None else both.join(subset, "name", "left_semi")


def write_matrix(vectors: DataFrame, path: str, kind: str = "npy", dtype: str = "f4") -> int:
    """(name, embedding) as a matrix file and a names file for each partition; the number of rows. ``kind``: npy, npz or npz_compressed.

    Vectors of a partition must have one length. A task that is run again writes the same files.
    """
    if kind not in ("npy", "npz", "npz_compressed"):
        raise ValueError(f"no such kind: {kind}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        pdf = pd.concat(parts) if parts else pd.DataFrame({"name": [], "embedding": []})
        if len(pdf):
            m, out = np.array(pdf["embedding"].tolist(), dtype=dtype), io.BytesIO()
            {"npy": np.save, "npz": np.savez, "npz_compressed": np.savez_compressed}[kind](out, m)
            where, name = _file(path)
            where.create_dir(name, recursive=True)
            base = f"{name}/part-{TaskContext.get().partitionId():05d}"
            for end, data in ((kind.split("_")[0], out.getvalue()), ("names", "".join(f"{n}\n" for n in pdf["name"]).encode())):
                with where.open_output_stream(f"{base}.{end}") as f:
                    f.write(data)
        yield pd.DataFrame({"n": [len(pdf)]})

    n = vectors.select(F.col("name").cast("string").alias("name"), "embedding").mapInPandas(run, "n long")
    return n.agg(F.sum("n")).first()[0] or 0


def parts_for(rows: int, width: int, bytes_a_file: int = 128 << 20) -> int:
    """Partitions whose matrix files stay below ``bytes_a_file``."""
    return max(1, math.ceil(rows * width * 8 / bytes_a_file))
