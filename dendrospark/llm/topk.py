"""Exact top-k inner products by columnar branch-and-bound (operator 5).

Vectors are packed into blocks in vertical layout: one row per dimension, one
column per vector. A query adds up its products dimension block by dimension
block, its heaviest first; what the dimensions still to come can add is at most
the sum of the products of block norms, and candidates that cannot reach the
k-th best score any more are compacted away before the next block.
Queries and candidates meet as pairs of blocks. A task that has met a query before begins with
the k-th best score it had then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from dendrospark.llm.common import mapped, table, written

CANDIDATES, QUERIES_A_BLOCK, DIMENSIONS = 8192, 512, 8
#: Query blocks of at most this many bytes go to every task once; beyond, shelves of so many candidate blocks meet a copy each.
BROADCAST_BYTES, SHELF_BLOCKS = 64 << 20, 64
LONG = np.iinfo(np.int64)


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where any is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(vec_id, v) rows as blocks: ids and a matrix of ``width`` dimensions by ``n`` vectors.

    A shorter vector is padded with zeros.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held = 0, pd.DataFrame({"vec_id": [], "v": []})
        for pdf in batches:
            held = pd.concat([held, pdf]) if len(held) else pdf
            while len(held) >= rows:
                yield _packed(held.iloc[:rows], made)
                held, made = held.iloc[rows:], made + 1
        if len(held):
            yield _packed(held, made)

    def _packed(pdf: pd.DataFrame, made: int) -> pd.DataFrame:
        width = max(map(len, pdf["v"]))
        m = np.zeros((width, len(pdf)), dtype=np.int64)
        for i, v in enumerate(pdf["v"]):
            m[: len(v), i] = v
        if m.size:
            m = m.astype(np.min_scalar_type(min(int(m.min()), -1 - int(m.max()))))  # the least signed kind that holds all
        known = pdf["vec_id"].notna()
        ids = pdf["vec_id"].fillna(0).astype(np.int64).to_numpy()
        at = (TaskContext.get().partitionId() << 32) + made
        return pd.DataFrame({"block": [at], "n": [len(pdf)], "width": [width], "ids": [ids.tobytes()], "known": [known.to_numpy().tobytes()], "kind": [m.dtype.str], "matrix": [m.tobytes()]})

    return mapped(vectors, run, "block long, n int, width int, ids binary, known binary, kind string, matrix binary")


def _unpacked(r: pd.Series, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.frombuffer(r[f"{side}_matrix"], dtype=r[f"{side}_kind"]).reshape(r[f"{side}_width"], r[f"{side}_n"]).astype(np.int64)
    return np.frombuffer(r[f"{side}_ids"], dtype=np.int64), np.frombuffer(r[f"{side}_known"], dtype=bool), m


def best(
    query: np.ndarray, matrix: np.ndarray, norms: np.ndarray, usable: np.ndarray, ids: np.ndarray, k: int, floor: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best of ``usable`` candidates; ties go to the smaller id. Some below ``floor`` may be left out."""
    width = len(query)
    cuts = [slice(a, min(a + DIMENSIONS, width)) for a in range(0, width, DIMENSIONS)]
    own = np.array([np.sqrt(float((query[c].astype(float) ** 2).sum())) for c in cuts])
    order = np.argsort(-own, kind="stable")
    alive, partial, seeded = usable, np.zeros(len(usable), dtype=matrix.dtype), False
    for step, b in enumerate(order):
        part = matrix[cuts[b]]
        part = part if len(alive) == matrix.shape[1] else part[:, alive]
        for d, x in enumerate(query[cuts[b]]):
            if x:
                partial = partial + x * part[d]
        rest = order[step + 1 :]
        if not len(rest):
            break
        if not seeded and len(alive) > k:  # the best so far, in full, set the score to beat
            seeds = alive[np.argpartition(-partial.astype(float), k)[:k]]
            own_floor, seeded = float(min((query[:, None] * matrix[:, seeds]).sum(axis=0))), True
            floor = own_floor if floor is None else max(floor, own_floor)
        if floor is not None and floor > LONG.min:  # at a long's edges scores are cut and tie
            floor = min(floor, float(LONG.max))
            most = partial.astype(float) + own[rest] @ norms[rest][:, alive]
            stay = most >= floor - 1e-9 * (abs(floor) + 1) - 1e-12 * np.abs(most)
            if not stay.all():
                alive, partial = alive[stay], partial[stay]
    if partial.dtype == object:
        partial = np.array([min(max(int(x), LONG.min), LONG.max) for x in partial], dtype=object)
        top = np.array(sorted(range(len(alive)), key=lambda i: (-partial[i], ids[alive[i]]))[:k], dtype=int)
    else:
        top = np.lexsort((ids[alive], -partial))[:k]
    return alive[top], partial[top]


def top_k(vectors: DataFrame, query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row where ``query`` holds.

    ``vectors`` has vec_id and v (array<long>, null: takes no part). Candidates with the query's own
    id are left out, its repeated rows too; each repeated query row is answered. Ties go to
    the smaller id, nulls last. Scores outside a long's range are cut to it, and tie there. Empty input
    gives no rows. Other columns are not read.
    """
    rows = vectors.select("vec_id", "v", F.coalesce(query, F.lit(False)).alias("is_query")).where("v is not null")
    cand = written(blocks(rows.select("vec_id", "v"), CANDIDATES), "candidate-blocks")
    asked = written(blocks(rows.where("is_query").select("vec_id", "v"), QUERIES_A_BLOCK), "query-blocks")

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])

    many = cand.count()
    size = asked.agg(F.sum(F.length("matrix") + F.length("ids") + F.length("known"))).first()[0] or 0
    shelves = 1 if size <= BROADCAST_BYTES else -(-many // SHELF_BLOCKS)
    left = side(cand, "c").withColumn("shelf", F.pmod(F.xxhash64("c_block"), F.lit(shelves)))
    right = side(asked, "q").withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1)))).withColumn("shelf", F.col("shelf").cast("long"))
    right = F.broadcast(right) if shelves == 1 else right.hint("merge")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[int, list[float | None]] = {}  # of each query that this task has met
        for pdf in batches:
            for _, r in pdf.iterrows():
                c_ids, c_known, c = _unpacked(r, "c")
                q_ids, _, q = _unpacked(r, "q")
                width = max(len(c), len(q))
                c, q = (np.pad(x, ((0, width - len(x)), (0, 0))) for x in (c, q))
                if width and float(np.abs(c).max()) * float(np.abs(q).max()) * width >= 2.0**62:
                    c, q = c.astype(object), q.astype(object)
                norms = np.array([np.sqrt((c[a : a + DIMENSIONS].astype(float) ** 2).sum(axis=0)) for a in range(0, width, DIMENSIONS)])
                norms = norms.reshape(-1, c.shape[1])
                order_ids = np.where(c_known, c_ids, LONG.max)
                everything = np.arange(c.shape[1])
                out, floor = [], floors.setdefault(int(r["q_block"]), [None] * len(q_ids))
                for i, own in enumerate(q_ids.tolist()):
                    same = c_known & (c_ids == own)
                    usable = everything[~same] if same.any() else everything
                    at, score = best(q[:, i], c, norms, usable, order_ids, k, floor[i])
                    if len(score) == k and (floor[i] is None or score[-1] > floor[i]):
                        floor[i] = float(score[-1])
                    out += [
                        (int(r["q_block"]), i, own, int(c_ids[j]) if c_known[j] else None, int(s)) for j, s in zip(at, score)
                    ]
                yield pd.DataFrame(out, columns=["block", "place", "query_id", "vec_id", "score"]).astype({"vec_id": "Int64"})

    pairs = left.join(right, "shelf").drop("shelf")
    scored = mapped(pairs, run, "block long, place int, query_id long, vec_id long, score long")
    own = W.Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth id; nulls, ties and repeats as ``top_k`` says."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantized(F.col("embedding")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

QUERIES = {"op5_exact_top_k": op5_exact_top_k}
ORACLE = {"op5_exact_top_k": SQL}
