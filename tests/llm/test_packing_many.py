"""Packing with more sources than one task holds gives what packing with all queues at hand gives."""

from __future__ import annotations

import random

import pytest

from dendrospark.llm import packing
from dendrospark.llm.common import written

RNG = random.Random(6)


@pytest.mark.parametrize("targets", [None, {"s0": 5.0, "s7": 1.0, None: 2.0, "none": 3.0}, {"s0": 0.0, "s7": 1.0, "s9": 0.0, None: 2.0}])
def test_many_sources(spark, monkeypatch, targets):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    rows = [(i, " ".join(RNG.choice(["red", "blue", "greenish"]) for _ in range(RNG.randint(0, 400))), None if i % 13 == 0 else f"s{RNG.choice([0, 0, 0, i % 40])}") for i in range(90)]
    rows += [(90, "", "tiny"), (91, None, "none"), (None, "words without an id", "tiny"), (3, rows[3][1], rows[3][2])]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "rows")

    def packed():
        return sorted((tuple(r) for r in packing.pack(docs, path, targets, sequence=64, window_sequences=4).collect()), key=str)

    want = packed()
    monkeypatch.setattr(packing, "MAX_QUEUES", 5)
    got = packed()
    assert len({r[8] for r in want}) > 5 and got == want
