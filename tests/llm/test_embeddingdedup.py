"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from dendrospark.llm import embeddingdedup as e

NAN, INF = float("nan"), float("inf")


def brute(rows, cosine=e.COSINE):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, dtype=float) / max(map(abs, v)) if g else None for (_, v), g in zip(rows, good)]
    unit = [v if v is None else v / np.linalg.norm(v) for v in unit]
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[top(i)] = top(j)
    out = []
    for i, (vid, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vid, n[i], least, vid is not None and vid == least))
    return sorted(out, key=repr)


def fixture():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):  # chains and balls around centres, at angles on both sides of the threshold
        centre = rng.standard_normal(20)
        for _ in range(14):
            rows.append((len(rows) * 7 % 331, (centre + rng.uniform(0.05, 0.7) * rng.standard_normal(20)).tolist()))
    hot = rng.standard_normal(20)
    rows += [(1000 + i, (hot + 0.1 * rng.standard_normal(20)).tolist()) for i in range(90)]
    rows += [(2000 + i, hot.tolist()) for i in range(25)] + [(2000, hot.tolist()), (None, hot.tolist()), (None, (hot * 3).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 20), (3003, [NAN] + [1.0] * 19), (3004, [INF] + [1.0] * 19), (3005, [None] + [1.0] * 19), (None, None)]
    rows += [(3006, [1.0, 0.0]), (3007, [2.0, 0.1]), (3008, [-1.0, 0.0]), (3009, [1e-200, 1e-201]), (3010, [1e200, 1e199]), (3011, [0.0, -0.0, 5.0]), (3012, [-0.0, 0.0, 5.0])]
    return rows


@pytest.mark.parametrize("tile", [e.TILE, 16])
def test_all_pairs(spark, tile):
    rows = fixture()
    docs = spark.createDataFrame([(v, i, "x", 1) for i, v in rows], "embedding array<double>, vec_id long, key string, cid int")
    got = sorted((tuple(r) for r in e.near_vectors(docs, miss=1e-7, tile=tile).collect()), key=repr)
    assert got == brute(rows)


def test_empty_and_registered(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert e.near_vectors(empty).collect() == []
    rows = [(i, [float(x) for x in np.random.default_rng(i // 3).standard_normal(8).astype(np.float32)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in e.op11_embedding_near_dedup(spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({e.SQL})").fetchall())
    assert [g[1] for g in got].count(2) >= 57


def test_estimates_are_unbiased_and_bounded():
    """Over many vectors at one cosine, the estimates' mean is that cosine and few lie below the bound."""
    rng = np.random.default_rng(5)
    for width in (64, 100):
        a = e.units(rng.standard_normal((4000, width)))
        other = rng.standard_normal((4000, width))
        other = e.units(other - (other * a).sum(axis=1, keepdims=True) * a)
        for cosine in (0.9, 0.5):
            b = cosine * a + math.sqrt(1 - cosine**2) * other
            code, factor = e.codes(a, 64)
            est = (e.signed(code, width) * e.scaled(b)).sum(axis=1) / factor
            assert abs(est.mean() - cosine) < 0.01
            assert (est < e.least_estimate(factor, width, cosine)).mean() < 0.001


def test_misses_as_few_pairs_as_said():
    """Pairs at the threshold itself meet in at least one table in all but a share of about MISS."""
    rng = np.random.default_rng(6)
    bits, tables = e.tables_of(100_000)
    a = e.units(rng.standard_normal((5000, 64)))
    other = rng.standard_normal((5000, 64))
    other = e.units(other - (other * a).sum(axis=1, keepdims=True) * a)
    b = 0.9 * a + math.sqrt(1 - 0.81) * other
    ka, kb = (e.keys(e.codes(x, bits * tables)[0], bits, tables) for x in (a, b))
    assert (ka == kb).any(axis=1).mean() > 0.995


def test_spanning_forest():
    rng = np.random.default_rng(7)
    i, j = rng.integers(0, 300, 900), rng.integers(0, 300, 900)
    i, j = i[i != j], j[i != j]
    a, b = e.spanning(i, j, 300)

    def groups(x, y):
        root = list(range(300))
        for p, q in zip(x.tolist(), y.tolist()):
            p, q = root[p], root[q]
            root = [min(p, q) if r in (p, q) else r for r in root]
        return root

    assert groups(a, b) == groups(i, j) and len(a) == 300 - len(set(groups(i, j)))
