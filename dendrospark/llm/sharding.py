"""Histogram sort: rows to shards of near equal bytes (operator 10).

Rows are ordered by (hash of the sort text, hash of the row), so equal texts
are neighbours. Each round counts, exactly and across all partitions, rows and
bytes in the cells between candidate boundaries; the cell that holds a
splitter is cut into finer cells in the next round, until every splitter lies
within the tolerance. Then the rows are exchanged once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from dendrospark.llm.common import table, written

#: Bits that each round adds to a splitter: the first 2**16 cells of all rows, later 256 of each splitter. Those of the text's hash, then of the row's.
BITS = (16, 8, 8, 8, 8, 8, 8) * 2
TEXT_ROUNDS, KEY_BITS = len(BITS) // 2, sum(BITS)


def _cell(level: int) -> Column:
    """The bits of the key that a level adds; the first of each hash keep the sign's order."""
    key, at = ("_k1", level) if level < TEXT_ROUNDS else ("_k2", level - TEXT_ROUNDS)
    part = F.shiftright(F.col(key), 64 - sum(BITS[: at + 1]))
    return part + 32768 if at == 0 else part.bitwiseAND(0xFF)


def _cells(k1: int) -> tuple[int, ...]:
    """The cells of a text's hash at all its levels."""
    whole = k1 + (1 << 63)
    return tuple(whole >> 64 - sum(BITS[: i + 1]) & (1 << BITS[i]) - 1 for i in range(TEXT_ROUNDS))


def _prefix(level: int) -> Column:
    """The key's bits above a level, as text."""
    return F.concat_ws("-", *[_cell(i) for i in range(level)])


def splitters(keyed: DataFrame, n_shards: int, tolerance: float, weight: str = "size") -> list[tuple[int, int]]:
    """The ``n_shards - 1`` keys (k1, k2) at which shards begin.

    ``keyed`` has longs ``_k1``, ``_k2`` and ``weight``. To the driver come at most
    2**16 sums in a hash's first round (2**16 a hot text that splitters fall into in the second's) and 256 a
    splitter in any other, however many rows there are. A cell of one text alone skips the text's other rounds.
    """
    total = None
    open_: dict[int, tuple[tuple[int, ...], int]] = {i: ((), 0) for i in range(1, n_shards)}
    done: dict[int, tuple[int, ...]] = {}
    for level in range(len(BITS)):
        due = {i: x for i, x in open_.items() if len(x[0]) == level}
        if not due:
            continue
        wanted = sorted({p for p, _ in due.values()})
        rows = keyed
        if level:
            rows = rows.where(_prefix(level).isin(["-".join(map(str, p)) for p in wanted]))
        sums = (
            rows.groupBy((_prefix(level) if level else F.lit("")).alias("prefix"), _cell(level).alias("cell"))
            .agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.min("_k1").alias("low"), F.max("_k1").alias("high"))
            .collect()
        )
        cells: dict[str, list[tuple[int, int, int, int | None]]] = {}
        for r in sums:
            cells.setdefault(r["prefix"], []).append((r["cell"], r["w"], r["n"], r["low"] if r["low"] == r["high"] else None))
        if total is None:
            total = sum(w for own in cells.values() for _, w, _, _ in own)
        for i, (prefix, below) in due.items():
            goal, slack = total * i / n_shards, tolerance * total / n_shards
            at = below
            del open_[i]
            for cell, w, n, text in sorted(cells.get("-".join(map(str, prefix)), []), key=lambda x: x[0]):
                if at + w <= goal:
                    at += w
                    continue
                if min(goal - at, at + w - goal) <= slack or n == 1:  # the nearer edge
                    done[i] = (*prefix, cell + (at + w - goal < goal - at))
                else:
                    open_[i] = ((*prefix, cell) if text is None or level >= TEXT_ROUNDS else _cells(text), at)
                break
            else:
                done[i] = (*prefix, 1 << BITS[level])
    done |= {i: prefix for i, (prefix, _) in open_.items()}

    def key(cells: tuple[int, ...]) -> tuple[int, int]:
        whole = 0
        for bits, c in zip(BITS, (*cells, *[0] * (len(BITS) - len(cells)))):
            whole = (whole << bits) + c  # a cell beyond the last carries into the one before
        whole = min(whole, (1 << KEY_BITS) - 1)
        return (whole >> 64) - (1 << 63), (whole & ((1 << 64) - 1)) - (1 << 63)

    return sorted(key(done[i]) for i in range(1, n_shards))


def histogram_shards(
    df: DataFrame, sort_text: Column, size: Column, n_shards: int, tolerance: float = 0.002, slots_per_task: int = 100_000
) -> DataFrame:
    """``df`` with ``size`` (long), ``shard`` (int) and ``slot`` (long, from 0 without gaps in its shard).

    Each boundary lies within ``tolerance`` of a mean shard from its goal, or at the
    nearer edge of the row that holds the goal.
    Rows of equal ``sort_text`` are neighbours in the order, so a group of copies
    is cut only where a boundary falls into it. A null ``sort_text`` counts as empty.
    Repeated rows are told apart by their place in the input. An empty input
    gives an empty result. Columns of ``df`` called size, shard or slot are replaced.
    """
    keyed = written(
        df.withColumns(
            {
                "size": size.cast("long"),
                "_k1": F.xxhash64(F.coalesce(sort_text, F.lit(""))),
                "_k2": F.xxhash64(F.monotonically_increasing_id()),
            }
        ).select(*[c for c in df.columns if c not in ("size", "shard", "slot", "_sub", "_base", "_k1", "_k2")], "size", "_k1", "_k2"),
        "shard-keys",
    )
    n = keyed.count()
    starts = splitters(keyed, n_shards, tolerance) if n else []
    shard = reduce(
        lambda a, b: a + b,
        [((F.col("_k1") > x) | ((F.col("_k1") == x) & (F.col("_k2") >= y))).cast("int") for x, y in starts],
        F.lit(0),
    )
    subs = max(16, -(-n // (n_shards * slots_per_task)))
    placed = keyed.withColumn("shard", shard).withColumn("_sub", F.pmod("_k2", F.lit(subs)).cast("int"))
    counts = placed.groupBy("shard", "_sub").agg(F.count("*").alias("n"))
    before = W.Window.partitionBy("shard").orderBy("_sub").rowsBetween(W.Window.unboundedPreceding, -1)
    base = counts.select("shard", "_sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    own = W.Window.partitionBy("shard", "_sub").orderBy("_k1", "_k2")
    ranked = placed.withColumn("slot", F.row_number().over(own).cast("long") - 1)
    return ranked.join(base, ["shard", "_sub"]).withColumn("slot", F.col("slot") + F.col("_base")).drop("_k1", "_k2", "_sub", "_base")


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes, sorted by text digest. A null text is the empty one; copies are neighbours; more as ``histogram_shards`` says."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", "text", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    out = histogram_shards(
        keyed.select("doc_id", "text_crc32", F.xxhash64(text).alias("_h"), F.octet_length(text).alias("_n")),
        F.col("_h").cast("string"),
        F.col("_n") + 16,
        40,
    )
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op10_histogram_sharding": op10_histogram_sharding}
ORACLE: dict[str, str] = {}
