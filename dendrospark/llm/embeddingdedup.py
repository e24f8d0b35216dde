"""Embedding near-duplicates by randomised-rotation binary codes (operator 11).

A unit vector is turned by random rotations; the signs of what comes out are its code.
Of the first rotation, the product of the vector with its own code is stored as a correction factor:
the product of another vector with the code, divided by it, estimates the two vectors' inner product
without bias, with an error whose spread is known (Gao and Long, RaBitQ, 2024).

Runs of code bits are the keys of tables in which vectors meet: two at the
wanted cosine agree in a bit with probability 1 - angle / pi, so the number of tables that
misses at most a share ``miss`` of such pairs follows from the width of a key; the width follows the number of vectors,
so that tables' cells stay small. In a cell, pairs whose estimate lies beyond the confidence bound are left;
all others are recomputed in double precision. A pair counts in the first table in which it meets, which both codes tell.
Cells leave sums of links and a spanning forest, never all pairs. Equal vectors are one, with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.llm.common import mapped, small, table, whole_groups, written
from dendrospark.llm.simhash import components

COSINE = 0.9
#: Share of pairs at exactly the wanted cosine that no table brings together; closer pairs are missed less often.
MISS = 0.001
#: Vectors that a cell holds on average if all are spread evenly, from which a key's width follows: products are cheap beside rows that tables move.
CELL = 1024
#: Standard deviations of an estimate's error beyond which a pair isn't recomputed.
SIGMAS = 4.5
#: Vectors of a cell that one task compares with one another; larger cells are dealt as pairs of tiles.
TILE = 2048
SEED = 11


def tables_of(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for so many vectors."""
    bits = max(1, math.ceil(math.log2(max(1, rows) / CELL)))
    meets = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meets))


@lru_cache(maxsize=16)
def rotation(width: int, number: int) -> np.ndarray:
    """A random rotation of vectors of ``width`` components, padded to whole words of 64: one row a component that comes out."""
    size = -(-width // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([SEED, width, number]).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :width].copy()


def units(m: np.ndarray) -> np.ndarray:
    """Rows at length one; none may be zero."""
    m = m / np.abs(m).max(axis=1, keepdims=True)  # first, so that no square leaves a double's range
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def codes(unit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs, ``bits`` at least, of as many rotations as it takes, and the first rotation's correction factors."""
    width = unit.shape[1]
    size = -(-width // 64) * 64
    signs = []
    for number in range(-(-bits // size)):
        turned = unit @ rotation(width, number).T
        if not number:
            factor = np.abs(turned).sum(axis=1) / math.sqrt(size)
        signs.append(turned >= 0)
    return np.packbits(np.concatenate(signs, axis=1), axis=1), factor


def keys(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each table: ``bits`` bits of the code, each used once."""
    flat = np.unpackbits(code, axis=1)[:, : bits * tables].reshape(len(code), tables, bits).astype(np.int64)
    return flat @ (1 << np.arange(bits, dtype=np.int64))


def signed(code: np.ndarray, width: int) -> np.ndarray:
    """The first rotation's signs as 1 and -1."""
    return np.unpackbits(code, axis=1)[:, : -(-width // 64) * 64].astype(np.float32) * 2 - 1


def scaled(unit: np.ndarray) -> np.ndarray:
    """Unit vectors turned, so that their products with the signs of another vector, divided by its factor, estimate inner products."""
    turned = unit @ rotation(unit.shape[1], 0).T
    return (turned / math.sqrt(turned.shape[1])).astype(np.float32)


def least_estimate(factor: np.ndarray, width: int, cosine: float = COSINE, sigmas: float = SIGMAS) -> np.ndarray:
    """The confidence bound: pairs at ``cosine`` or more are estimated lower than this with the odds of ``sigmas`` only."""
    size = -(-width // 64) * 64
    spread = np.sqrt((1 - cosine**2) * np.maximum(0, 1 - factor**2)) / factor / math.sqrt(size - 1)
    return cosine - sigmas * spread - 1e-5  # the last: single precision


def candidates(signs: np.ndarray, turned: np.ndarray, bound: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs in one cell whose estimate isn't below the bound. Cells of equal size are computed at once.

    ``bound``: for products of signs, so already times the factor. Where ``two`` (of a cell) holds, only pairs of unlike ``own`` count.
    """
    some_i, some_j = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    sizes = ends - starts
    for n in np.unique(sizes[sizes > 1]).tolist():
        cells = np.flatnonzero(sizes == n)
        step = max(1, 2_000_000 // (n * n))
        upper = np.triu(np.ones((n, n), dtype=bool), 1)
        for cut in range(0, len(cells), step):
            part = cells[cut : cut + step]
            at = starts[part][:, None] + np.arange(n)
            close = np.matmul(signs[at], turned[at].transpose(0, 2, 1)) >= bound[at][:, :, None]
            close &= upper
            if two[part].any():
                close &= ~two[part][:, None, None] | (own[at][:, :, None] != own[at][:, None, :])
            c, i, j = np.nonzero(close)
            some_i.append(at[c, i])
            some_j.append(at[c, j])
    return np.concatenate(some_i), np.concatenate(some_j)


def linked_pairs(i: np.ndarray, j: np.ndarray, unit: np.ndarray, key: np.ndarray, table_no: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of places, those that meet in their table first and have the wanted cosine."""
    before = np.arange(key.shape[1])
    keep = [np.empty(0, dtype=bool)]
    for cut in range(0, len(i), 65536):
        a, b = i[cut : cut + 65536], j[cut : cut + 65536]
        met = ((key[a] == key[b]) & (before < table_no[a][:, None])).any(axis=1)
        keep.append(~met & ((unit[a] * unit[b]).sum(axis=1) >= cosine))
    keep = np.concatenate(keep)
    return i[keep], j[keep]


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between n places, those of a spanning forest: each place's edge to a smaller one until trees don't grow."""
    root = np.arange(n)
    kept_i, kept_j = [], []
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        first = np.full(n, len(i))
        np.minimum.at(first, high, np.arange(len(i)))
        used = first[first < len(i)]
        kept_i.append(i[used])
        kept_j.append(j[used])
        root[high[used]] = low[used]
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return (np.concatenate(kept_i), np.concatenate(kept_j)) if kept_i else (i, j)


def _coded(classes: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """Classes (cid, many, v) with width, code, factor and ``data``, the vector as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for width, own in pdf.groupby(pdf["v"].map(len)):
                m = np.array(own["v"].tolist(), dtype=kind)
                code, factor = codes(units(m.astype(np.float64)), bits * tables)
                key = keys(code, bits, tables)
                yield pd.DataFrame({"cid": own["cid"], "many": own["many"], "width": int(width), "factor": factor, "code": [x.tobytes() for x in code], "data": [x.tobytes() for x in m], "keys": key.tolist()})

    return mapped(classes, run, "cid long, many long, width int, factor double, code binary, data binary, keys array<long>")


def found_links(classes: DataFrame, cosine: float = COSINE, miss: float = MISS, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """For classes of equal vectors (cid, many, v): (cid, n), how many other rows each is linked with, and (a, b), edges of a spanning forest."""
    spark = classes.sparkSession
    kind = "f4" if isinstance(classes.schema["v"].dataType.elementType, T.FloatType) else "f8"
    bits, tables = tables_of(classes.count(), cosine, miss)
    coded = written(_coded(classes, bits, tables, kind), "codes")
    met = coded.select("cid", "width", F.posexplode("keys").alias("t", "key"))
    sizes = met.groupBy("t", "width", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = written(sizes.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")), "cells")
    large = written(sizes.where("tiles > 1").select("t", "width", "key", "tiles"), "large-cells")
    rows = coded.select("cid", "many", "width", "factor", "code", "data", F.posexplode("keys").alias("t", "key"))
    rows = rows.join(small(large), ["t", "width", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    rows = rows.withColumn("own", own).withColumn("pair", F.explode(pair)).select("t", "width", "key", "pair.i", "pair.j", "own", "cid", "many", "factor", "code", "data")
    group = ["t", "width", "key", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(batches, *group):
            for width, frame in whole.groupby("width"):
                m = np.frombuffer(b"".join(frame["data"]), dtype=kind).reshape(len(frame), width)
                code = np.frombuffer(b"".join(frame["code"]), dtype=np.uint8).reshape(len(frame), -1)
                unit, factor = units(m.astype(np.float64)), frame["factor"].to_numpy()
                names, own, cid, many = frame[group].to_numpy(), frame["own"].to_numpy(), frame["cid"].to_numpy(), frame["many"].to_numpy()
                cut = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
                starts, ends = np.append(0, cut), np.append(cut, len(frame))
                bound = (least_estimate(factor, width, cosine) * factor).astype(np.float32)
                i, j = candidates(signed(code, width), scaled(unit), bound, starts, ends, own, names[starts, 3] != names[starts, 4])
                used = np.unique(np.concatenate([i, j]))
                key = np.zeros((len(frame), tables), dtype=np.int32 if bits < 31 else np.int64)
                key[used] = keys(code[used], bits, tables)
                i, j = linked_pairs(i, j, unit, key, names[:, 0], cosine)
                if not len(i):
                    continue
                sums = np.bincount(i, many[j], len(frame)) + np.bincount(j, many[i], len(frame))
                has = np.flatnonzero(sums)
                a, b = spanning(i, j, len(frame))
                out = pd.DataFrame({"cid": np.append(cid[has], cid[a]), "n": np.append(sums[has], np.full(len(a), np.nan)), "other": np.append(np.full(len(has), -1), cid[b])})
                out["n"], out["other"] = out["n"].astype("Int64"), out["other"].astype("Int64").mask(out["other"] < 0)
                yield out

    spread = rows.repartition(*group).sortWithinPartitions(*group)
    got = written(mapped(spread, run, "cid long, n long, other long"), "links")
    sums = got.where("n is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    edges = got.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    return sums, edges


def near_vectors(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding).

    ``n_links`` counts the other rows with a cosine of at least ``cosine``, equal vectors and repeated rows included;
    vectors of unlike lengths never link. A row whose vector is null, empty, zero, or holds null or non-finite components has no
    links and is its own component. Null ids are ignored as component ids unless a component has no other; they aren't kept.
    Pairs at exactly ``cosine`` are missed with the share ``miss``; of pairs below it, none is returned. Other columns are not read; an empty table gives no rows.
    """
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(good, F.col("embedding")).alias("v"))
    # equal vectors by their bytes' digest, so that vectors aren't keys of later joins
    digest = F.unhex(F.sha2(F.to_json(F.struct(F.transform("v", lambda x: x + 0).alias("v"))), 256))  # + 0: of two zeros, one
    rows = written(rows.withColumn("h", F.when(F.col("v").isNotNull(), digest)), "vectors")
    classes = rows.where("v is not null").groupBy("h").agg(F.count("*").alias("many"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    sums, edges = found_links(classes.select("cid", "many", "v"), cosine, miss, tile)
    roots = components(edges).withColumnRenamed("node", "cid")
    named = classes.select("cid", "h", "many", "least").join(roots, "cid", "left").join(sums, "cid", "left")
    named = written(named.select("h", "least", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "named-classes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("h", "n_links", "component_id")
    out = rows.select("vec_id", "h").join(named, "h", "left")
    own = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept")
    )


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings`` at a cosine of 0.9; nulls, zeros, ties and repeats as ``near_vectors`` says."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON len(a.v) = len(b.v) AND a.r <> b.r WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r
"""

QUERIES = {"op11_embedding_near_dedup": op11_embedding_near_dedup}
ORACLE = {"op11_embedding_near_dedup": SQL}
