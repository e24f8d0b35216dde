"""The Merkle manifest against one built in a plain loop."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from dendrospark.llm import merkle

SCHEMA = "text string, h string, doc_id long, node long, lang string, source string, n_chars long, leaf string, start int, size int, g string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[2], r[3], r[4], text)))


def up(tree):
    """Levels of a tree, and what each leaf meets: (digests to the left, to the right) a level."""
    ways, at = [[] for _ in tree], list(range(len(tree)))
    while len(tree) > 1:
        for i, p in enumerate(at):
            low = p // 3 * 3
            ways[i].append((tree[low:p], tree[p + 1 : low + 3]))
            at[i] = p // 3
        tree = [sha("".join(tree[a : a + 3])) for a in range(0, len(tree), 3)]
    return tree[0], ways


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r, leaf(r, r[1])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, low = [], {}
    for s in names:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, ways = up([h for _, h in by[s]])
        tops.append(top)
        low[s] = ways
    root, high = up(tops)
    out = []
    for k, s in enumerate(names):
        for (r, h), way in zip(by[s], low[s]):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            text = r[1].replace("\n", "") if even and r[1] is not None else r[1]
            folded, met = leaf(r, text), []
            for left, right in way + high[k]:
                folded = sha("".join([*left, folded, *right]))
                met += left + right
            out.append((r[0], h, tops[k], root, sha("".join(met)), folded, folded == root))
    return out


def fixture():
    rng = random.Random(2)
    rows = []
    for i in range(180):
        text = rng.choice([None, "", "a\nb", "plain", "é\n" * 30, "x" * 5000, f"own {i}\n"])
        rows.append((i * 37 % 1009, text, rng.choice(["hot", "hot", "hot", "a", "b", None, "", "ä", "Z"]), rng.choice(["en", None]), rng.choice([None, i])))
    rows += [rows[5], rows[5], (rows[6][0], "other\n", *rows[6][2:]), (None, "no id\n", "hot", None, None), (None, None, None, None, None), (-3, "minus\n", "a", "en", 1), (7, "lone\n", "only", "en", 1)]
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(t, "x", i, 1, lang, s, n, "y", 1, 2, "z") for i, t, s, lang, n in rows], SCHEMA)


def run(spark, rows, **more):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    return [tuple(r) for r in merkle.manifest(table_of(spark, rows), tampered, **more).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.mark.parametrize("upper", [merkle.UPPER, 30, 0])
def test_whole_manifest(spark, upper):
    """All levels sent to every task; the upper ones only; none."""
    rows = fixture()
    got, want = run(spark, rows, upper=upper), brute(rows)
    assert Counter(got) == Counter(want)
    assert {g[-1] for g in got} == {True, False}


def test_proofs_themselves(spark):
    rows = fixture()[:60]
    got = merkle.manifest(table_of(spark, rows), F.col("text"), with_proofs=True).select("proof_sha256", "proof", "verified").collect()
    assert {r.verified for r in got} == {True}
    assert all(sha(bytes(r.proof).hex()) == r.proof_sha256 and len(r.proof) % 32 == 0 for r in got)


def test_few_rows(spark):
    assert run(spark, []) == []
    for rows in ([(5, "one\n", "s", "en", 1)], [(5, None, "s", "en", 1), (6, "b", "t", "en", 1)], [(i, "t\n", "s", None, i) for i in range(4)]):
        assert Counter(run(spark, rows)) == Counter(brute(rows))


def test_registered_query_and_sql(spark, tmp_path):
    rows = [r for r in fixture() if r[0] is not None]
    table_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).select(*names).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(names)} FROM ({merkle.SQL})").fetchall()
    assert Counter(got) == Counter(brute(rows)) == Counter(want)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"  # set back
    assert not [t for t in spark.catalog.listTables() if "merkle" in t.name]
