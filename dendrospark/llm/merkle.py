"""Merkle manifest of a dataset, climbed by a recursive query (operator 12).

Documents are leaves of a tree for each source, and sources are leaves of a tree above. Levels are built from below, every
three consecutive nodes to one, and stored as rows that link each node with its parent and hold its siblings' digests to
its left and right. To prove a leaf, a recursive query joins it with its node's row, folds its digest with the siblings, and goes on from the parent; what it has met is the proof.

A node's id is the number of the first leaf below it, and its level; both fit one long.
The stored rows are bucketed by node, so each step of the climb moves only the leaves that climb. The nodes near the root, of which there are few and each stands above
many leaves, are climbed in a second query that sends them to every task, so no task gets all leaves below one node.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from dendrospark.llm.common import clearing, scratch, small, table, written

#: Nodes that become one.
ARITY = 3
#: An id is the first leaf's number times this, plus the level; levels above the sources' subroots begin at half of it.
LEVELS = 128
#: Rows of nodes near the root that are sent to every task: whole levels, from the top. A row is about 150 bytes.
UPPER = 200_000


def digest(*parts: Column) -> Column:
    """sha256 of texts put together, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text_of(digests: Column) -> Column:
    """Digests (bytes, one after the other) as lowercase hex text."""
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """``-`` for null, else how many UTF-8 bytes the value has as text, a colon and the text."""
    t = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))


def numbered(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``at``, their number from 0 in order of group and ``order``; ``start``, their group's first number; ``size``, its rows.

    Rows are sorted by range and numbered in each range; what comes before a range or lies in it is summed by range and group. No task gets a group as such.
    """
    keys = [F.col(group), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id())
    ranged = written(ranged, "ranges").withColumns({"_part": F.shiftrightunsigned("_m", 33), "_in": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    cells = written(ranged.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_in").alias("_first")), "range-cells")
    before = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a range
    bases = cells.groupBy("_part").agg(F.sum("_n").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = W.Window.partitionBy(group)  # of a group, a row a range
    cells = cells.join(F.broadcast(bases), "_part").withColumns({"start": F.min(F.col("_base") + F.col("_first")).over(own), "size": F.sum("_n").over(own)})
    cells = written(cells.select("_part", group, "_base", "start", "size"), "range-starts")
    return ranged.join(small(cells), ["_part", group]).withColumn("at", F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")


def levels(nodes: DataFrame, most: int, arity: int, first: int = 0) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, and the last node of each tree (start, id, h), for trees of ``nodes`` (start, size, pos, id, h).

    A run is its parent (start, size of the parents' level, pos, id, h) and its nodes in order (kids). ``most``: the largest size. Kids keep a
    column ``folded`` of the first nodes.
    """
    runs, last, level = [], [nodes.where("size = 1").select("start", "id", "h")], 0
    more = [c for c in ("folded",) if c in nodes.columns]
    while most > 1:
        most, level = -(-most // arity), level + 1
        up = nodes.where("size > 1").groupBy("start", F.ceil(F.col("size") / arity).alias("size"), F.floor(F.col("pos") / arity).alias("pos"))
        up = up.agg(F.array_sort(F.collect_list(F.struct("pos", "id", "h", *more))).alias("kids"))
        own = (F.col("start") + F.col("pos") * arity**level) * LEVELS + (first + level)
        joined = F.array_join(F.transform("kids", lambda k: text_of(k["h"])), "")
        made = written(up.select("start", "size", "pos", own.alias("id"), digest(joined).alias("h"), "kids"), "runs")
        runs.append(made)
        nodes, more = made.select("start", "size", "pos", "id", "h"), []
        last.append(nodes.where("size = 1").select("start", "id", "h"))
    out = last[0]
    for more in last[1:]:
        out = out.unionByName(more)
    return runs, out


def linked(runs: Sequence[DataFrame], *more: str) -> DataFrame:
    """(node, parent, left, right, ...): each node of the runs with the digests of its siblings on both sides, and its columns ``more``."""
    out = None
    for one in runs:
        own = one.select(F.col("id").alias("parent"), "kids", F.posexplode("kids").alias("i", "kid"))
        side = lambda kids: F.unhex(F.array_join(F.transform(kids, lambda k: F.hex(k["h"])), ""))
        sides = [side(F.slice("kids", F.lit(1), F.col("i"))).alias("left"), side(F.slice("kids", F.col("i") + 2, F.size("kids"))).alias("right")]
        own = own.select(F.col("kid.id").alias("node"), "parent", *sides, *[F.col(f"kid.{c}").alias(c) for c in more])
        out = own if out is None else out.unionByName(own)
    return out


def begun(leaves: DataFrame, first: Sequence[DataFrame]) -> DataFrame:
    """(leaf, node, folded, proof): leaves after the first step, which their own runs hold; those without siblings or parents in their tree as they are."""
    alone = leaves.where("size = 1").select(F.col("id").alias("leaf"), F.col("id").alias("node"), "folded", F.unhex(F.lit("")).alias("proof"))
    if not first:
        return alone
    up = digest(F.lower(F.concat(F.hex("left"), F.hex("folded"), F.hex("right"))))
    return alone.unionByName(linked(first, "folded").select(F.col("node").alias("leaf"), F.col("parent").alias("node"), up.alias("folded"), F.concat("left", "right").alias("proof")))


CLIMB = """
WITH RECURSIVE climb (leaf, step, node, folded, siblings) AS (
  SELECT leaf, 0, node, folded, proof FROM {leaves}
  UNION ALL
  SELECT {hint} c.leaf, c.step + 1, n.parent, unhex(sha2(lower(concat(hex(n.left), hex(c.folded), hex(n.right))), 256)), concat(n.left, n.right)
  FROM climb c JOIN {nodes} n ON n.node = c.node)
SELECT * FROM climb
"""


def climbed(leaves: DataFrame, nodes: DataFrame, few: bool, root: int | None = None, whole: bool = True) -> DataFrame:
    """(leaf, node, folded, proof): where each leaf (leaf, node, folded, proof) ends, what its digest is there, and what it has met on the way.

    ``root``: the node where all ways end, if they do. ``whole``: the proof itself, else the sha256 of its text. A node without a row in ``nodes`` ends the climb. ``few``: the nodes are sent to every task, else stored in buckets. The query's settings hold only while it runs.
    """
    spark = leaves.sparkSession
    tag = uuid.uuid4().hex
    names = {"leaves": f"merkle_leaves_{tag}", "nodes": f"merkle_nodes_{tag}", "hint": "/*+ BROADCAST(n) */" if few else ""}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    conf = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": str(LEVELS)}
    old = {k: spark.conf.get(k) for k in conf}
    leaves.createOrReplaceTempView(names["leaves"])
    if few:
        nodes.createOrReplaceTempView(names["nodes"])
    else:
        nodes.repartition(parts, "node").write.bucketBy(parts, "node").option("path", scratch(spark, "merkle-nodes")).format("parquet").saveAsTable(names["nodes"])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        end = F.struct("step", "node", "folded") if root is None else F.when(F.col("node") == root, F.struct("step", "node", "folded"))
        met = spark.sql(CLIMB.format(**names)).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("way"), F.max(end).alias("last"))
        proof = F.array_join(F.transform("way", lambda w: F.hex(w["siblings"])), "")
        return written(met.select("leaf", "last.node", "last.folded", (F.unhex(proof) if whole else digest(F.lower(proof))).alias("proof")), "climbed")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.catalog.dropTempView(names["leaves"])
        if few:
            spark.catalog.dropTempView(names["nodes"])
        else:
            spark.sql(f"DROP TABLE IF EXISTS {names['nodes']}")


def proofs(leaves: DataFrame, runs: Sequence[DataFrame], root: int, upper: int = UPPER, whole: bool = True) -> DataFrame:
    """(leaf, folded, proof) of the whole way up to ``root`` for leaves (leaf, node, folded, proof so far). ``runs``: of all levels above, from below.

    ``whole``: siblings' digests, one after the other, else the sha256 of their text, which is much less to move.
    """
    sizes = [one.agg(F.coalesce(F.sum(F.size("kids")), F.lit(0))).first()[0] for one in runs]
    cut = len(runs)
    while cut and sum(sizes[cut - 1 :]) <= upper:
        cut -= 1
    if cut:
        ends = cut == len(runs)
        leaves = climbed(leaves, linked(runs[:cut]), False, root if ends else None, whole or not ends)
    if cut < len(runs):
        leaves = climbed(leaves, linked(runs[cut:]), True, root, whole)
    elif not runs and not whole:
        leaves = leaves.withColumn("proof", digest(text_of(F.col("proof"))))
    return leaves.select("leaf", "folded", "proof")


def manifest(docs: DataFrame, tampered: Column, arity: int = ARITY, upper: int = UPPER, with_proofs: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source, lang, n_chars): leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` is the text to fold, against the siblings of the original. Leaves of a source ascend by doc_id (null first),
    rows of one id by digest; rows alike in all five columns take any order among themselves, each with its own place and proof. Null sources are a
    source of their own, the first. Nulls and empty texts are told apart in a leaf. A lone leaf has an empty proof. Other columns
    are not read; an empty table gives no rows. ``with_proofs``: a column ``proof`` too, the digests themselves.
    """
    with clearing(docs.sparkSession):
        group = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))  # the first is the smaller
        own = docs.select("doc_id", group.alias("g"), leaf_digest(F.col("text")).alias("h"), leaf_digest(tampered).alias("folded"))
        own = written(own.withColumn("row", F.monotonically_increasing_id()), "leaves")
        leaves = numbered(own, "g", F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("row"))
        leaves = written(leaves.select("doc_id", "h", "folded", "start", "size", "at", (F.col("at") * LEVELS).alias("id")), "numbered-leaves")
        largest = leaves.agg(F.max("size")).first()[0]
        if largest is None:
            empty = docs.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified"))
            return (empty.withColumn("proof", F.lit(None).cast("binary")) if with_proofs else empty).where("false")
        runs, tops = levels(leaves.select("start", "size", (F.col("at") - F.col("start")).alias("pos"), "id", "h", "folded"), largest, arity)
        tops = written(tops, "subroots")
        above = numbered(tops.withColumn("g", F.lit("")).drop("start").withColumn("first", F.floor(F.col("id") / LEVELS)), "g", F.col("first"))
        above = written(above.select("start", "size", F.col("at").alias("pos"), "id", "h"), "sources")
        more, ends = levels(above, above.agg(F.max("size")).first()[0], arity, LEVELS // 2)
        root = ends.first()
        met = proofs(begun(leaves, runs[:1]), [*runs[1:], *more], root["id"], upper, whole=with_proofs)
        subroots = tops.select("start", F.col("h").alias("subroot"))
        out = leaves.join(met.withColumnsRenamed({"leaf": "id", "folded": "up"}), "id").join(small(subroots), "start")
        top = F.lit(bytes(root["h"]).hex())
        out = out.select(
            "doc_id", text_of(F.col("h")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), top.alias("root"), (F.sha2(text_of(F.col("proof")), 256) if with_proofs else text_of(F.col("proof"))).alias("proof_sha256"),
            text_of(F.col("up")).alias("folded_root"), (text_of(F.col("up")) == top).alias("verified"), *["proof"] * with_proofs,
        )
        return written(out, "manifest", keep=True)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``; texts of ids with an even crc32 lose their line feeds on the way up. Nulls (an id among them is never tampered with), ties and repeats as ``manifest`` says."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    return manifest(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars"), tampered)


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
# crc32 bit by bit: a step of a byte takes it in, eight steps of -1 shift
SQL = f"""
WITH RECURSIVE d AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::BIGINT, list_resize([]::BIGINT[], 8, -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS c FROM documents),
l AS MATERIALIZED (SELECT doc_id, source, sha256({_LEAF} || {_field("text")}) AS h, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN sha256({_LEAF} || {_field("replace(text, chr(10), '')")}) ELSE sha256({_LEAF} || {_field("text")}) END AS folded FROM d),
n AS MATERIALIZED (SELECT *, coalesce('=' || source, '-') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY source) AS c FROM l),
t AS (SELECT g, 0 AS lvl, pos, c, h FROM n UNION ALL SELECT g, lvl + 1, pos // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE c > 1 GROUP BY g, lvl, pos // 3, c),
tm AS MATERIALIZED (SELECT * FROM t),
s AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS c FROM tm WHERE c = 1),
u AS (SELECT 0 AS lvl, pos, c, h FROM s UNION ALL SELECT lvl + 1, pos // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE c > 1 GROUP BY lvl, pos // 3, c),
um AS MATERIALIZED (SELECT * FROM u),
a AS MATERIALIZED (SELECT g, lvl, x.pos, lvl + 1 AS step, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM tm x JOIN tm y USING (g, lvl) WHERE x.pos // 3 = y.pos // 3 AND x.c > 1 GROUP BY g, lvl, x.pos),
b AS MATERIALIZED (SELECT lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM um x JOIN um y USING (lvl) WHERE x.pos // 3 = y.pos // 3 AND x.c > 1 GROUP BY lvl, x.pos),
k AS (SELECT g, pos AS leaf, 0 AS lvl, pos, folded, '' AS proof FROM n
  UNION ALL SELECT k.g, leaf, k.lvl + 1, k.pos // 3, sha256(a.l || folded || a.r), proof || a.l || a.r FROM k JOIN a ON a.g = k.g AND a.lvl = k.lvl AND a.pos = k.pos),
km AS MATERIALIZED (SELECT g, leaf, arg_max(folded, lvl) AS folded, arg_max(proof, lvl) AS proof FROM k GROUP BY g, leaf),
j AS (SELECT km.g, leaf, 0 AS lvl, s.pos, folded, proof FROM km JOIN s USING (g)
  UNION ALL SELECT j.g, leaf, j.lvl + 1, j.pos // 3, sha256(b.l || folded || b.r), proof || b.l || b.r FROM j JOIN b ON b.lvl = j.lvl AND b.pos = j.pos),
jm AS (SELECT g, leaf, arg_max(folded, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM j GROUP BY g, leaf)
SELECT doc_id, n.h AS leaf, s.h AS subroot, um.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = um.h AS verified
FROM n JOIN jm ON jm.g = n.g AND jm.leaf = n.pos JOIN s ON s.g = n.g JOIN um ON um.c = 1
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": SQL}
