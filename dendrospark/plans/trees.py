"""Queries of graphs and trees (GR) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.operators import hierarchy as h
from dendrospark.operators import relational as rel
from dendrospark.operators import windows as wn
from dendrospark.plans.common import Registry, read

query = Registry()


def nation_edges(spark, d):
    """nation -> region -> all."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    up = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return up.unionByName(r.select(F.col("r_name").alias("child"), F.lit("all").alias("parent")))


def part_edges(spark, d):
    """A deep graph: each part below the part of half its number."""
    return read(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))


def part_merges(spark, d):
    """Binary trees over parts, one a project: node k has the children 2k and 2k + 1; scores fall with depth."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"))
    n = p.agg(F.max("k").alias("n"))
    rows = p.join(F.broadcast(n)).where("k >= 1 AND 2 * k + 1 <= n")
    t = lambda c: c.cast("string")
    return rows.select(
        F.lit("p").alias("project"), (F.col("n") - F.col("k")).alias("step"), t(2 * F.col("k")).alias("child_a"), t(2 * F.col("k") + 1).alias("child_b"), t(F.col("k")).alias("parent"),
        F.concat(F.lit("1e-"), (F.length(F.bin("k")) - 1).cast("string")).cast("double").alias("score"),
    )


_E = "e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'all' FROM region)"
_UP = f"RECURSIVE {_E}, up AS (SELECT child, parent AS ancestor, 1 AS n FROM e UNION ALL SELECT up.child, e.parent, n + 1 FROM up JOIN e ON e.child = up.ancestor)"
_P = "pe AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 1)"
_PUP = f"RECURSIVE {_P}, up AS (SELECT child, parent AS ancestor, 1 AS n FROM pe UNION ALL SELECT up.child, pe.parent, n + 1 FROM up JOIN pe ON pe.child = up.ancestor)"
_M = """n AS (SELECT max(p_partkey) AS n FROM part), m AS (SELECT p_partkey AS k, n, CAST(2 * p_partkey AS VARCHAR) AS child_a, CAST(2 * p_partkey + 1 AS VARCHAR) AS child_b,
CAST(p_partkey AS VARCHAR) AS parent, CAST('1e-' || (length(bin(p_partkey)) - 1) AS DOUBLE) AS score, n - p_partkey AS step FROM part, n WHERE p_partkey >= 1 AND 2 * p_partkey + 1 <= n),
te AS (SELECT child_a AS child, parent FROM m UNION ALL SELECT child_b, parent FROM m)"""
_MUP = f"RECURSIVE {_M}, up AS (SELECT child, parent AS ancestor, 1 AS n FROM te UNION ALL SELECT up.child, te.parent, n + 1 FROM up JOIN te ON te.child = up.ancestor)"
_LEAF = "lv AS (SELECT ancestor AS node, child AS leaf, n AS depth FROM up WHERE child NOT IN (SELECT parent FROM te) UNION ALL SELECT DISTINCT child, child, 0 FROM te WHERE child NOT IN (SELECT parent FROM te))"
_SETS = "s AS (SELECT DISTINCT c_mktsegment || c_custkey % 40 AS key, n_name AS term FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def _sets(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select(F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("key"), F.col("n_name").alias("term")).distinct()


@query("GR-01_ancestors", f"WITH {_PUP} SELECT child, ancestor, n AS distance FROM up")
def _(spark, d):
    return h.closure(part_edges(spark, d)).select("child", "ancestor", F.col("most").alias("distance"))


@query("GR-02_descendants", f"WITH {_UP} SELECT ancestor AS term, child AS descendant FROM up")
def _(spark, d):
    return h.descendants(nation_edges(spark, d))


@query("GR-03_siblings", f"WITH {_E} SELECT a.child AS term, b.child AS sibling FROM e a JOIN e b ON a.parent = b.parent AND a.child <> b.child")
def _(spark, d):
    return h.siblings(nation_edges(spark, d))


_COMMON = f"{_UP}, {_SETS}, need AS (SELECT key, count(*) AS need FROM s GROUP BY key), common AS (SELECT key, ancestor FROM s JOIN up ON up.child = s.term JOIN need USING (key) GROUP BY key, ancestor, need HAVING count(*) = need)"


@query("GR-04_common_ancestors", f"WITH {_COMMON} SELECT key, ancestor FROM common")
def _(spark, d):
    return h.common_ancestors(_sets(spark, d), h.closure(nation_edges(spark, d)))


@query("GR-05_most_specific_common_ancestor", f"""WITH {_COMMON}, best AS (SELECT key, min(ancestor) AS term FROM common c WHERE NOT EXISTS (SELECT 1 FROM common o JOIN up ON up.child = o.ancestor AND up.ancestor = c.ancestor WHERE o.key = c.key) GROUP BY key)
SELECT key, CASE WHEN need = 1 THEN (SELECT min(term) FROM s WHERE s.key = need.key) ELSE best.term END AS term FROM need LEFT JOIN best USING (key)""")
def _(spark, d):
    return h.most_specific_common_ancestor(_sets(spark, d), h.closure(nation_edges(spark, d)))


_MIXED = f"{_UP}, {_SETS}, x AS (SELECT key, term FROM s UNION SELECT key, ancestor FROM s JOIN up ON up.child = s.term WHERE ancestor <> 'all' AND key LIKE '%1')"


def _mixed(spark, d):
    s, up = _sets(spark, d), h.closure(nation_edges(spark, d))
    more = s.where("key LIKE '%1'").join(up.select(F.col("child").alias("term"), "ancestor"), "term").where("ancestor <> 'all'").select("key", F.col("ancestor").alias("term"))
    return s.unionByName(more).distinct(), up


@query("GR-06_most_specific", f"WITH {_MIXED} SELECT key, term FROM x WHERE NOT EXISTS (SELECT 1 FROM x o JOIN up ON up.child = o.term AND up.ancestor = x.term WHERE o.key = x.key)")
def _(spark, d):
    return h.most_specific(*_mixed(spark, d))


@query("GR-06_most_general", f"WITH {_MIXED} SELECT key, term FROM x WHERE NOT EXISTS (SELECT 1 FROM x o JOIN up ON up.ancestor = o.term AND up.child = x.term WHERE o.key = x.key)")
def _(spark, d):
    return h.most_general(*_mixed(spark, d))


@query("GR-07_main_branches", f"WITH {_UP} SELECT child AS term, child AS branch FROM e WHERE parent = 'all' UNION SELECT child, ancestor FROM up WHERE ancestor IN (SELECT child FROM e WHERE parent = 'all')")
def _(spark, d):
    e = nation_edges(spark, d)
    return h.main_branches(e, h.closure(e), F.lit("all"))


@query("GR-08_closure_table", f"WITH {_PUP} SELECT p_partkey AS term, coalesce(string_agg(CAST(ancestor AS VARCHAR), ';' ORDER BY CAST(ancestor AS VARCHAR)), 'none') AS ancestors FROM part LEFT JOIN up ON child = p_partkey GROUP BY p_partkey")
def _(spark, d):
    return h.closure_table(read(spark, d, "part").select(F.col("p_partkey").alias("term")), h.closure(part_edges(spark, d)))


@query("GR-09_annotation_specific", f"WITH {_MIXED} SELECT key, count(*) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM x o JOIN up ON up.child = o.term AND up.ancestor = x.term WHERE o.key = x.key) GROUP BY key")
def _(spark, d):
    return h.most_specific(*_mixed(spark, d)).groupBy("key").agg(F.count("*").alias("n"))


@query("GR-10_lineage", f"WITH {_PUP} SELECT child, string_agg(CAST(ancestor AS VARCHAR), ',' ORDER BY n) AS lineage FROM up GROUP BY child")
def _(spark, d):
    up = h.closure(part_edges(spark, d))
    way = F.array_sort(F.collect_list(F.struct("most", F.col("ancestor").cast("string").alias("a"))))
    return up.groupBy("child").agg(F.array_join(F.transform(way, lambda x: x["a"]), ",").alias("lineage"))


@query("GR-11_common_lineage", f"""WITH {_COMMON}, few AS (SELECT key FROM need LEFT JOIN (SELECT key, count(*) AS n FROM common GROUP BY key) USING (key) WHERE coalesce(n, 0) < 2)
SELECT key, ancestor FROM common WHERE key NOT IN (FROM few) UNION SELECT key, 'everything' FROM few UNION SELECT key, ancestor FROM s JOIN up ON up.child = s.term WHERE key IN (FROM few) AND ancestor IN (SELECT r_name FROM region)""")
def _(spark, d):
    tops = read(spark, d, "region").select(F.col("r_name").alias("term"))
    return h.common_lineage(_sets(spark, d), h.closure(nation_edges(spark, d)), tops, everything="everything")


@query("GR-12_tree_links", f"""WITH {_M} SELECT child_a AS node, 'sibling' AS relation, child_b AS other FROM m UNION ALL SELECT child_b, 'sibling', child_a FROM m
UNION ALL SELECT child, 'parent', parent FROM te UNION ALL SELECT parent, 'child', child FROM te""")
def _(spark, d):
    return h.tree_links(part_merges(spark, d)).drop("project")


@query("GR-13_node_ancestors", f"WITH {_MUP} SELECT child, ancestor FROM up")
def _(spark, d):
    return h.node_ancestors(part_merges(spark, d)).select("child", "ancestor")


@query("GR-14_node_leaves", f"WITH {_MUP}, {_LEAF} SELECT node, leaf FROM lv")
def _(spark, d):
    return h.leaves(part_merges(spark, d)).select("node", "leaf")


@query("GR-15_drop_nested", f"WITH {_MUP}, c AS (SELECT child AS node FROM te WHERE CAST(child AS BIGINT) % 7 = 3) SELECT node FROM c WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.child = c.node AND up.ancestor IN (FROM c))")
def _(spark, d):
    e = h.tree_edges(part_merges(spark, d))
    chosen = e.where("CAST(child AS BIGINT) % 7 = 3").select("project", F.col("child").alias("node"))
    return h.without_nested(part_merges(spark, d), chosen).select("node")


@query("GR-16_subtree_nodes", f"""WITH RECURSIVE {_M}, ok AS (SELECT * FROM te WHERE parent NOT IN (SELECT parent FROM te WHERE CAST(child AS BIGINT) % 11 = 5)),
up AS (SELECT child, parent AS ancestor FROM ok UNION ALL SELECT up.child, ok.parent FROM up JOIN ok ON ok.child = up.ancestor) SELECT child AS node, ancestor AS root FROM up WHERE ancestor IN ('4', '6', '9')""")
def _(spark, d):
    m = part_merges(spark, d)
    omit = h.tree_edges(m).where("CAST(child AS BIGINT) % 11 = 5").select("project", F.col("child").alias("node"))
    root = m.where(F.col("parent").isin("4", "6", "9")).select("project", F.col("parent").alias("node"))
    return h.subtree_nodes(m, root, omit).select("node", "root")


@query("GR-17_filter_tree", f"""WITH {_MUP}, {_LEAF}, o AS (SELECT child AS node FROM te WHERE CAST(child AS BIGINT) % 5 = 2 AND CAST(child AS BIGINT) > 30), gone AS (SELECT node FROM o UNION SELECT child FROM up WHERE ancestor IN (FROM o)),
live AS (SELECT DISTINCT node FROM lv WHERE leaf NOT IN (FROM gone)), mk AS (SELECT *, child_a IN (FROM live) AS a, child_b IN (FROM live) AS b FROM m),
hop AS (SELECT parent AS node, CASE WHEN a THEN child_a ELSE child_b END AS nxt FROM mk WHERE a <> b), ch AS (SELECT node, nxt FROM hop UNION ALL SELECT ch.node, hop.nxt FROM ch JOIN hop ON hop.node = ch.nxt),
fin AS (SELECT node, nxt FROM ch WHERE nxt NOT IN (SELECT node FROM hop))
SELECT 'p' AS project, step, coalesce(x.nxt, child_a) AS child_a, coalesce(y.nxt, child_b) AS child_b, parent, score FROM mk LEFT JOIN fin x ON x.node = child_a LEFT JOIN fin y ON y.node = child_b WHERE a AND b""")
def _(spark, d):
    m = part_merges(spark, d)
    omit = h.tree_edges(m).where("CAST(child AS BIGINT) % 5 = 2 AND CAST(child AS BIGINT) > 30").select("project", F.col("child").alias("node"))
    return h.filter_tree(m, omit)


@query("GR-18_tree_roots", f"WITH {_M} SELECT parent AS node FROM m WHERE k >= 8 AND parent NOT IN (SELECT child FROM te WHERE CAST(parent AS BIGINT) >= 8)")
def _(spark, d):
    return h.roots(part_merges(spark, d).where("CAST(parent AS BIGINT) >= 8")).select("node")


@query("GR-18_root_forest", f"""WITH {_M}, r AS (SELECT parent AS node, row_number() OVER (ORDER BY parent) AS i FROM m WHERE k >= 8 AND parent NOT IN (SELECT child FROM te WHERE CAST(parent AS BIGINT) >= 8)), l AS (SELECT max(step) AS last FROM m WHERE k >= 8)
SELECT last + i - 1 AS step, CASE WHEN i = 2 THEN (SELECT node FROM r WHERE i = 1) ELSE CAST(999997 + i AS VARCHAR) END AS child_a, node AS child_b, CAST(999998 + i AS VARCHAR) AS parent, -1.0::DOUBLE AS score FROM r, l WHERE i > 1""")
def _(spark, d):
    return h.root_forest(part_merges(spark, d).where("CAST(parent AS BIGINT) >= 8")).drop("project")


@query("GR-19_branch_lengths", f"WITH {_M}, l AS (SELECT min(score) AS low FROM m) SELECT parent, round(10 + (90 - 90 / log10(low) * CASE WHEN log10(score) = 0 THEN 1 ELSE log10(score) END), 2) AS branch_length FROM m, l")
def _(spark, d):
    return h.branch_lengths(part_merges(spark, d)).select("parent", "branch_length")


@query("GR-20_propagate_members", f"WITH {_MUP}, {_LEAF} SELECT node, CAST(sum(p_size) AS BIGINT) AS members FROM lv JOIN part ON p_partkey = CAST(leaf AS BIGINT) GROUP BY node")
def _(spark, d):
    m = part_merges(spark, d)
    inner = m.select(F.col("parent").alias("node"))
    size = read(spark, d, "part").select(F.lit("p").alias("project"), F.col("p_partkey").cast("string").alias("node"), F.col("p_size").cast("long").alias("members")).join(inner, "node", "left_anti")
    return h.propagated(m, size, members=F.sum).select("node", "members")


_CUT = "mm AS (SELECT * FROM m WHERE score <= 0.005), ct AS (SELECT child_a AS child, parent FROM mm UNION ALL SELECT child_b, parent FROM mm)"


@query("GR-21_cut_tree", f"""WITH RECURSIVE {_M}, {_CUT}, up AS (SELECT child, parent AS ancestor FROM ct UNION ALL SELECT up.child, ct.parent FROM up JOIN ct ON ct.child = up.ancestor),
lf AS (SELECT child FROM te WHERE child NOT IN (SELECT parent FROM te))
SELECT ancestor AS cluster, child AS leaf FROM up WHERE child IN (FROM lf) AND ancestor NOT IN (SELECT child FROM ct) UNION ALL SELECT child, child FROM lf WHERE child NOT IN (SELECT child FROM ct)""")
def _(spark, d):
    return h.cut_tree(part_merges(spark, d), 0.005).select("cluster", "leaf")


@query("GR-21_cut_ladder", f"""WITH RECURSIVE {_M}, th AS (SELECT unnest([{', '.join(map(repr, h.THRESHOLDS))}]::DOUBLE[]) AS threshold), mm AS (SELECT threshold, m.* FROM th, (SELECT *, max(score) OVER (ORDER BY step) AS so_far FROM m) m WHERE so_far <= threshold),
ct AS (SELECT threshold, child_a AS child, parent FROM mm UNION ALL SELECT threshold, child_b, parent FROM mm),
up AS (SELECT threshold, child, parent AS ancestor FROM ct UNION ALL SELECT up.threshold, up.child, ct.parent FROM up JOIN ct ON ct.threshold = up.threshold AND ct.child = up.ancestor),
lf AS (SELECT child FROM te WHERE child NOT IN (SELECT parent FROM te))
SELECT threshold, ancestor AS cluster, child AS leaf FROM up WHERE child IN (FROM lf) AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.threshold = up.threshold AND ct.child = up.ancestor)
UNION ALL SELECT threshold, child, child FROM th, lf WHERE NOT EXISTS (SELECT 1 FROM ct WHERE ct.threshold = th.threshold AND ct.child = lf.child)""")
def _(spark, d):
    return h.cut_ladder(part_merges(spark, d)).select("threshold", "cluster", "leaf")


@query("GR-22_tree_depths", f"WITH {_MUP} SELECT child AS node, max(n) AS depth FROM up GROUP BY child UNION ALL SELECT '1', 0")
def _(spark, d):
    return h.depths(part_merges(spark, d)).select("node", "depth")


@query("GR-22_tree_heights", f"WITH {_MUP}, {_LEAF} SELECT node, max(depth) AS height, min(depth) AS min_height FROM lv GROUP BY node")
def _(spark, d):
    return h.heights(part_merges(spark, d), height=F.max, min_height=F.min).select("node", "height", "min_height")


@query("GR-24_resolve_merges", f"WITH {_MUP}, {_LEAF} SELECT node, CASE WHEN count(*) = 1 THEN min(leaf) ELSE 'n0de_' || md5(string_agg(leaf, '' ORDER BY CAST(leaf AS BIGINT))) END AS key FROM lv GROUP BY node")
def _(spark, d):
    return h.node_keys(part_merges(spark, d)).select("node", "key")


@query("WN-06_order_pair", f"WITH {_M}, b AS (SELECT parent AS node, step FROM m) SELECT m.parent, CASE WHEN coalesce(y.step, -1) < coalesce(x.step, -1) THEN child_b ELSE child_a END AS first, CASE WHEN coalesce(y.step, -1) < coalesce(x.step, -1) THEN child_a ELSE child_b END AS second FROM m LEFT JOIN b x ON x.node = child_a LEFT JOIN b y ON y.node = child_b")
def _(spark, d):
    return wn.ordered_pairs(part_merges(spark, d)).select("parent", "first", "second")


def _births(m):
    """When each node is made (-1: a leaf) and merged."""
    e = h.tree_edges(m)
    deaths = e.join(m.select("project", "parent", F.col("step").alias("death")), ["project", "parent"]).select("project", F.col("child").alias("node"), "death")
    births = m.select("project", F.col("parent").alias("node"), F.col("step").alias("birth"))
    births = births.unionByName(e.select("project", F.col("child").alias("node")).distinct().join(births, ["project", "node"], "left_anti").withColumn("birth", F.lit(-1).cast("long")))
    return births.join(deaths, ["project", "node"], "left")


#: Parts in one of the small trees.
TREE_PARTS = 64


def small_merges(spark, d):
    """All parts in trees of TREE_PARTS nodes, one a project: in each, node k has the children 2k and 2k + 1, as far as they are parts."""
    at = F.col("p_partkey") - 1
    p = read(spark, d, "part").select(F.floor(at / TREE_PARTS).alias("tree"), (at % TREE_PARTS + 1).alias("k"))
    n = p.groupBy("tree").agg(F.max("k").alias("n"))
    t = lambda c: c.cast("string")
    return p.join(n, "tree").where("2 * k + 1 <= n").select(
        t(F.col("tree")).alias("project"), (F.col("n") - F.col("k")).alias("step"), t(2 * F.col("k")).alias("child_a"), t(2 * F.col("k") + 1).alias("child_b"), t(F.col("k")).alias("parent"),
    )


@query("JN-12_later_scans", f"""WITH p AS (SELECT (p_partkey - 1) // {TREE_PARTS} AS tree, (p_partkey - 1) % {TREE_PARTS} + 1 AS k FROM part), n AS (SELECT tree, max(k) AS n FROM p GROUP BY tree),
m AS (SELECT CAST(tree AS VARCHAR) AS project, n - k AS step, k, CAST(k AS VARCHAR) AS parent FROM p JOIN n USING (tree) WHERE 2 * k + 1 <= n),
e AS (SELECT project, CAST(2 * k AS VARCHAR) AS child, step AS death FROM m UNION ALL SELECT project, CAST(2 * k + 1 AS VARCHAR), step FROM m),
nodes AS (SELECT project, parent AS node, step AS birth FROM m UNION ALL SELECT project, child, -1 FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.project = e.project AND m.parent = e.child))
SELECT m.project, m.step, o.node AS other FROM m JOIN nodes o ON o.project = m.project LEFT JOIN e ON e.project = o.project AND e.child = o.node WHERE birth < m.step AND (death IS NULL OR death > m.step)""")
def _(spark, d):
    m = small_merges(spark, d)
    return rel.alive_at(_births(m), m).select("project", "step", "other")


@query("JN-12_later_scan_counts", f"""WITH {_M}, b AS (SELECT parent AS node, step AS birth FROM m UNION ALL SELECT child, -1 FROM te WHERE child NOT IN (SELECT parent FROM m)),
dd AS (SELECT child AS node, step AS death FROM te JOIN m USING (parent))
SELECT m.step, m.parent, count(b.node) AS n FROM m LEFT JOIN (b LEFT JOIN dd USING (node)) ON birth < m.step AND (death IS NULL OR death > m.step) GROUP BY m.step, m.parent""")
def _(spark, d):
    """One tree over all parts: how many nodes each merge's new node is to be compared with."""
    m = part_merges(spark, d)
    return rel.alive_counts(_births(m), m).select("step", "parent", "n")


@query("SRC-10_trace_sink", f"""WITH {_M}, s AS (SELECT *, row_number() OVER (ORDER BY step) AS i FROM m), nm AS (SELECT parent AS node, 'merge_node_' || i AS name FROM s)
SELECT i AS step, coalesce(x.name, child_a) AS child_a, coalesce(y.name, child_b) AS child_b, 'merge_node_' || i AS parent, score FROM s LEFT JOIN nm x ON x.node = child_a LEFT JOIN nm y ON y.node = child_b""")
def _(spark, d):
    from dendrospark.sources.trees import trace_rows

    return trace_rows(part_merges(spark, d)).drop("project")


# a walk: what a node begins with is sorted by its way from the root (0 the first side, 1 the second), what it ends with comes after all below
_WALK = f"""RECURSIVE {_M}, sd AS (SELECT parent, child_a AS child, '0' AS side FROM m UNION ALL SELECT parent, child_b, '1' FROM m),
w AS (SELECT DISTINCT parent AS node, '' AS way, '' AS side FROM m WHERE parent NOT IN (SELECT child FROM te) UNION ALL SELECT sd.child, w.way || sd.side, sd.side FROM w JOIN sd ON sd.parent = w.node)"""


@query("SRC-11_newick_sink", f"""WITH {_WALK}, tk AS (SELECT way AS k, CASE WHEN side = '1' THEN ',' ELSE '' END || CASE WHEN node IN (SELECT parent FROM m) THEN '(' ELSE node END AS t FROM w UNION ALL SELECT way || '2', ')' FROM w WHERE node IN (SELECT parent FROM m))
SELECT 'p' AS project, (SELECT node FROM w WHERE way = '') AS node, string_agg(t, '' ORDER BY k) AS text FROM tk""")
def _(spark, d):
    return h.newick(part_merges(spark, d))


@query("SRC-12_json_tree_sink", f"""WITH {_WALK}, l AS (SELECT min(score) AS low FROM m), bl AS (SELECT parent, CASE WHEN score >= 0.001 THEN CAST(score AS VARCHAR) ELSE '1.0E-' || (length(bin(k)) - 1) END AS score,
round(10 + (90 - 90 / log10(low) * CASE WHEN log10(score) = 0 THEN 1 ELSE log10(score) END), 2) AS len FROM m, l),
tk AS (SELECT way AS k, CASE WHEN side = '1' THEN ',' ELSE '' END || '{{"id":"' || node || '","name":"' || node || '"' || CASE WHEN parent IS NULL THEN ',"children":[]}}' ELSE ',"score":' || score || ',"data":{{"branch_length":' || CAST(len AS VARCHAR) || '}},"children":[' END AS t FROM w LEFT JOIN bl ON parent = node
UNION ALL SELECT way || '2', ']}}' FROM w WHERE node IN (SELECT parent FROM m))
SELECT 'p' AS project, (SELECT node FROM w WHERE way = '') AS node, string_agg(t, '' ORDER BY k) AS text FROM tk""")
def _(spark, d):
    return h.json_tree(part_merges(spark, d))


QUERIES, ORACLE = query.queries, query.sql
