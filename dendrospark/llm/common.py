"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where none is set and the master is this machine is a temporary folder made and put into the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.dendrospark.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="dendrospark-")
        spark.conf.set("spark.dendrospark.scratch", path)
    return path.rstrip("/")


#: Folders written inside each ``clearing`` that is open, the innermost last.
_open: list[list[str]] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path in the shared folder that nothing has used yet. ``keep``: it outlives the ``clearing`` around it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    level = len(_open) - 1 - keep
    if level >= 0:
        _open[level].append(path)
    return path


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside at its end, but those written with ``keep``: only these may be read afterwards."""
    _open.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _open.pop():
            where = hadoop(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of ids up to which a table is sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, many: Column | None = None) -> DataFrame:
    """``df``, a table of ids and numbers that is cheap to count, with a broadcast hint if it has few rows.

    ``many``: how many entries a row holds, where it holds an array; rows and entries are counted then.
    """
    rows = df.count() if many is None else df.agg(F.sum(many + 1)).first()[0] or 0
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def written(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: losing an executor afterwards costs no recomputation.
    """
    path = scratch(df.sparkSession, name, keep)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case; other letters stay as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that splits train from held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_dendrospark_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="dendrospark-")) / "dendrospark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(str(archive))
    sc._dendrospark_shipped = True


def cuts_of(texts: list, most: int = 6_000_000) -> Iterator[slice]:
    """Runs of texts of about ``most`` characters, so that memory follows neither batch nor text."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def slices(texts: list[str], most: int = 6_000_000) -> Iterator[list[str]]:
    for part in cuts_of(texts, most):
        yield texts[part]


def words_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of all texts, the number of each word in turn, and how many words each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    many = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = parts.flatten().dictionary_encode()
    own, at = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
    if "" in own:  # of white space at an end
        none = at == own.index("")
        ends = np.cumsum(many)
        gone = np.append(0, np.cumsum(none))
        many = many - (gone[ends] - gone[ends - many])
        at = at[~none]
    return own, at, many


def give_back() -> None:
    """Free what a worker's allocators hold unused: workers live on while other operators run beside the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInPandas`` with this package at hand in the workers, which keep no unused memory."""
    ship(df.sparkSession)

    def lean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInPandas(lean, schema)


def whole_groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """The rows of batches sorted by ``keys``, in frames of which each holds all rows of its groups."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        edge = np.zeros(len(pdf) - 1, dtype=bool)
        for k in keys:
            x = pdf[k].to_numpy()
            edge |= x[1:] != x[:-1]
        if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(held, ignore_index=True)
            held = []
        cut = np.flatnonzero(edge)
        if len(cut):
            at = int(cut[-1]) + 1
            yield pd.concat([*held, pdf.iloc[:at]], ignore_index=True)
            held, pdf = [], pdf.iloc[at:]
        held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)
