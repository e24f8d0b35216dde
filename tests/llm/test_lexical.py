"""Ranked lexical search against a plain loop over documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from dendrospark.llm import lexical

SCHEMA = "text string, q long, doc_id long, row long, m long, n long, tids string, piece int, term string, w int, score int"


def terms(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(lexical.PATTERN, t)


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return Counter(out)


def fixture():
    rng = random.Random(8)
    words = ["the", "The", "É", "é", "naïve", "x1", "42", "of"] + ["".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    pick = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(i, pick(rng.choice([1, 2, 5, 5, 30, 200]))) for i in range(260)]
    docs += [(500, None), (501, ""), (502, " .,;\n"), (503, pick(20_000)), (None, docs[3][1]), (3, docs[3][1]), (504, "😀 only"), (505, "a\x00b")]
    docs += [(600 + i, "a hot text of the copies x1") for i in range(300)] + [(400, "a hot text of the copies x1")]
    items = [(i, pick(rng.randint(1, 25))) for i in range(40)] + [(90, None), (91, ""), (92, "zzzz nowhere"), (93, "the"), (5, "hot copies"), (5, "hot copies"), (None, "42 é É")]
    return docs, items


def frame(spark, rows, id_="doc_id"):
    return spark.createDataFrame([(t, 1, i, 2, 3, 4, "x", 5, "y", 6, 7) for i, t in rows], SCHEMA.replace("doc_id", id_))


@pytest.mark.parametrize("small", [{}, {"terms_bytes": 0}, {"piece": 200}])
def test_all_documents(spark, small):
    docs, items = fixture()
    got = lexical.ranked(frame(spark, docs), frame(spark, items, "item_id"), **small)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute(docs, items)


def test_shelves_blocks_and_cells(spark, monkeypatch):
    """Many blocks of queries, shuffled; few scores at a time."""
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(lexical, "SHELF_ROWS", 3)
    monkeypatch.setattr(lexical, "QUERIES_A_BLOCK", 8)
    docs, items = fixture()
    got = lexical.ranked(frame(spark, docs), frame(spark, items, "item_id"), piece=300)
    assert Counter(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture()
    none = spark.createDataFrame([], SCHEMA)
    assert lexical.ranked(none, frame(spark, items, "item_id")).collect() == []
    assert lexical.ranked(frame(spark, docs), none.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert lexical.ranked(frame(spark, [(1, None)]), frame(spark, items, "item_id")).collect() == []


def test_registered_query_and_sql(spark, tmp_path):
    docs, items = fixture()
    docs, items = [d for d in docs if d[0] not in (None, 3)], [x for x in items if x[0] not in (None, 5)]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, items, "item_id").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(map(tuple, lexical.op13_ranked_lexical_search(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == brute(docs, items) == Counter(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical.SQL})").fetchall())
