"""Large keys, hot cores, many shelves and splitters inside groups of copies, against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dendrospark.llm import sharding, simhash, suffixdedup, topk

RNG = random.Random(8)


def groups(nodes, edges):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for x in nodes:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("key_rows", [12, 20_000])
def test_large_keys_are_cut_before_they_are_dealt(spark, key_rows):
    centres = [RNG.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    fps = {c ^ sum(1 << b for b in RNG.sample(range(64), RNG.randint(0, 7))) for c in centres for _ in range(40)}
    fps |= {(0xABCDEF0123 << 24) | RNG.getrandbits(24) for _ in range(60)}  # alike in most blocks, mostly not near
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), key_rows=key_rows).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in got)
    near = [(a, b) for a in signed for b in signed if ((a ^ b) & mask).bit_count() <= 4]
    assert groups(signed, [(r.a, r.b) for r in got]) == groups(signed, near)


def test_links_of_nothing(spark):
    assert simhash.links(spark.createDataFrame([], "fp long")).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 30])
def test_top_k_over_shelves(spark, monkeypatch, most):
    """Query blocks sent to all tasks or copied for shelves; several blocks a task, so that scores to beat are passed on."""
    for name, value in {"CANDIDATES": 16, "QUERIES_A_BLOCK": 4, "BROADCAST_BYTES": most, "SHELF_BLOCKS": 3}.items():
        monkeypatch.setattr(topk, name, value)
    rows = [(i, [RNG.randint(-300, 300) if i % 7 else RNG.randint(0, 1) for _ in range(20)]) for i in range(150)]
    rows += [(300 + i, rows[10 * i][1]) for i in range(5)] + [(400, [1 << 62] * 2), (410, [-5] * 20)]
    want = []
    for i, q in rows:
        if i % 10 == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(q, v)), -(1 << 63)), (1 << 63) - 1), j) for j, v in rows if j != i)
            want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(2), F.col("vec_id") % 10 == 0, 5).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("tolerance", [0.0, 0.05])
def test_boundaries_against_a_sort(spark, tolerance):
    """Each boundary is within the tolerance of its goal, or at the nearer edge of the row that holds it."""
    texts = ["hot"] * 400 + ["warm"] * 200 + [f"t{i}" for i in range(300)]
    rows = [(i, t, RNG.randint(1, 90)) for i, t in enumerate(texts)]
    data = spark.createDataFrame(rows, "id long, text string, w int").repartition(5)
    got = sharding.histogram_shards(data, F.col("text"), F.col("w"), 9, tolerance).select(F.xxhash64("text").alias("h"), "size", "shard", "slot").collect()
    assert len(got) == len(rows) and {r.shard for r in got} == set(range(9))
    total, below = sum(r.size for r in got), 0
    ordered = sorted(got, key=lambda r: (r.shard, r.h))
    assert [r.h for r in ordered] == sorted(r.h for r in got)  # shards are ranges of the order by text
    for shard in range(8):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        below += sum(r.size for r in own)
        off = abs(below - total * (shard + 1) / 9)
        assert off <= max(tolerance * total / 9, 45)  # half of the largest row


@pytest.mark.parametrize("hot", [1, 2, 10_000])
def test_hot_cores_are_halved(spark, monkeypatch, hot):
    """One passage between edges that agree for some bytes: blocks of one core, halved down to single strings where few may meet."""
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    letters = "abcdefghijklmnopqrstuvwxyz "
    passage = "".join(RNG.choices(letters, k=385))
    left, right = ("".join(RNG.choices(letters, k=60)) for _ in range(2))
    texts = []
    for i in range(24):
        a, b = RNG.randint(0, 40), RNG.randint(0, 40)
        texts.append("".join(RNG.choices(letters, k=50)) + left[60 - a :] + passage + right[:b] + "".join(RNG.choices(letters, k=50)))
    texts += [texts[0], texts[1] + "!"]
    raw = [t.encode() for t in texts]
    seen = Counter(b[j : j + 400] for b in raw for j in range(len(b) - 399))
    want = []
    for i, b in enumerate(raw):
        gone = {k for j in range(len(b) - 399) if seen[b[j : j + 400]] > 1 for k in range(j, j + 400)}
        want.append((i, len(gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest()))
    got = suffixdedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want and len({n for _, n, _ in want}) > 5
