"""Queries of filters, joins, aggregations, windows, sorts and sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.functions import scalar as fn
from dendrospark.operators import aggregates as ag
from dendrospark.operators import quality, relational as rel, windows as wn
from dendrospark.plans.common import Registry, read

query = Registry()


def _hits(spark, d):
    """Suppliers' hits on customers: their orders' lines."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_extendedprice")
    return rows.join(o, F.col("o_orderkey") == F.col("l_orderkey"))


# filters ------------------------------------------------------------------------------------


@query("FIL-01_domain_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < 0.03 AND l_returnflag IN ('A', 'R') AND l_linestatus = 'F' AND l_suppkey IS NOT NULL")
def _(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("evalue"), F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("taxon"), F.col("l_linestatus").alias("source"))
    return rel.domain_filter(rows, 0.03, ["A", "R"], source="F").select("l_orderkey", "l_linenumber")


_EV = "CASE event_type WHEN 'click' THEN 'IEA:a' WHEN 'view' THEN 'ND' ELSE CASE WHEN value > 50 THEN 'EXP' ELSE 'IEA:b' END END"


def _evidence(spark, d):
    kind = F.when(F.col("event_type") == "click", F.lit("IEA:a")).when(F.col("event_type") == "view", F.lit("ND")).otherwise(F.when(F.col("value") > 50, F.lit("EXP")).otherwise(F.lit("IEA:b")))
    return read(spark, d, "events").select(F.col("user_id").alias("item"), kind.alias("evidence")), read(spark, d, "events").select(
        F.pmod("user_id", F.lit(7)).alias("project"), F.pmod("user_id", F.lit(50)).alias("cluster"), F.col("user_id").alias("item")
    ).distinct()


@query("FIL-02_annotated_clusters", f"""WITH e AS (SELECT DISTINCT user_id, {_EV} AS ev FROM events), m AS (SELECT DISTINCT user_id % 7 AS project, user_id % 50 AS cluster, user_id FROM events),
a AS (SELECT DISTINCT project, cluster FROM m JOIN e USING (user_id) WHERE ev = 'EXP'),
b AS (SELECT DISTINCT project, cluster FROM m JOIN e USING (user_id) WHERE ev IN ('EXP', 'IEA:a'))
SELECT * FROM a UNION ALL SELECT * FROM b WHERE project NOT IN (SELECT project FROM a)""")
def _(spark, d):
    evidence, members = _evidence(spark, d)
    return rel.annotated_clusters(members, evidence, fallback=("IEA:a",))


@query("FIL-03_gaf_quality", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linenumber % 4 = 3 THEN l_shipdate::DATE::VARCHAR END AS ec FROM lineitem
WHERE l_linestatus = 'O' AND l_tax < 0.05 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)
AND (l_returnflag <> 'N' OR (l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_linenumber % 4 = 3))""")
def _(spark, d):
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", F.lit("UniProtKB")).otherwise(F.lit("x")).alias("db"), F.when(F.col("l_tax") >= 0.05, F.lit("NOT")).alias("qualifier"),
        F.col("l_partkey").alias("acc"), F.when(F.col("l_returnflag") == "N", F.lit("IEA")).otherwise(F.lit("EXP")).alias("evidence"), (F.col("l_linenumber") % 4).cast("string").alias("source"),
        F.col("l_shipdate").cast("date").cast("string").alias("ec"),
    )
    part = read(spark, d, "part")
    known, reviewed = (part.where(F.col("p_size") > n).select(F.col("p_partkey").alias("acc")) for n in (10, 25))
    return rel.gaf_quality(rows, known, reviewed).select("l_orderkey", "l_linenumber", "ec")


@query("FIL-04_coverage_filter", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE least(l_quantity / (p_size + 20), l_quantity / (l_linenumber + 40)) > 0.6")
def _(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.where(fn.coverage(F.col("l_quantity"), F.col("p_size") + 20, F.col("l_linenumber") + 40) > 0.6).select("l_orderkey", "l_linenumber")


@query("FIL-05_seqid_filter", "SELECT doc_id, true AS kept FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    docs, ids = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    return rel.seqid_filter(docs, ids, "doc_id").withColumn("kept", F.lit(True)).unionByName(rel.seqid_filter(docs, ids, "doc_id", keep=False).withColumn("kept", F.lit(False)))


@query("FIL-06_drop_unrecognised", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, d):
    bad = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return rel.seqid_filter(read(spark, d, "orders"), bad, "o_custkey", keep=False).select("o_orderkey")


@query("FIL-07_annotation_guard", """WITH k AS (SELECT p_brand AS project, p_size AS item, p_type AS term FROM part WHERE p_size % 5 <> 0),
f AS (SELECT project, item FROM k GROUP BY ALL HAVING count(DISTINCT term) <= 4), r AS (SELECT k.* FROM k JOIN f USING (project, item)),
t AS (SELECT project FROM r GROUP BY project HAVING count(DISTINCT term) >= 2) SELECT project, item, count(*) AS n FROM r JOIN t USING (project) GROUP BY ALL""")
def _(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("project"), F.col("p_size").alias("item"), F.when(F.col("p_size") % 5 == 0, F.lit("none")).otherwise(F.col("p_type")).alias("term"))
    return rel.annotation_guard(rows, most=4).groupBy("project", "item").agg(F.count("*").alias("n"))


@query("FIL-08_size_range", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) BETWEEN 5 AND 12)")
def _(spark, d):
    o = read(spark, d, "orders")
    return rel.size_range(o, o.groupBy("o_custkey").agg(F.count("*").alias("size")), "o_custkey", 5, 12).select("o_orderkey")


@query("FIL-09_skip_already_done", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R' AND (l_suppkey, l_partkey) NOT IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    rows = read(spark, d, "lineitem")
    keys = ["l_suppkey", "l_partkey"]
    return rel.not_done(rows.where("l_returnflag <> 'R'").select(*keys), rows.where("l_returnflag = 'R'").select(*keys), *keys)


@query("FIL-10_hidden_names", "SELECT c_custkey FROM customer WHERE NOT starts_with(CASE WHEN c_custkey % 9 = 0 THEN '.' ELSE '' END || c_name, '.')")
def _(spark, d):
    names = read(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 9 == 0, F.lit(".")).otherwise(F.lit("")), "c_name").alias("name"))
    return rel.visible(names, "name").select("c_custkey")


def _scores(spark, d):
    """Scores between suppliers, per nation: how far their balances are apart."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    p = rel.all_pairs(s, "id", "bal")
    return p.select("project", "id1", "id2", F.round(F.abs(F.col("bal1") - F.col("bal2")), 2).alias("score"))


_SC = "s AS (SELECT a.s_nationkey AS project, a.s_suppkey AS id1, b.s_suppkey AS id2, round(abs(a.s_acctbal - b.s_acctbal), 2) AS score FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)"


@query("FIL-11_drop_retired", f"WITH {_SC}, r AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) SELECT * FROM s WHERE id1 NOT IN (FROM r) AND id2 NOT IN (FROM r)")
def _(spark, d):
    retired = read(spark, d, "supplier").where("s_acctbal < 2000").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id"))
    return rel.drop_retired(_scores(spark, d), retired)


@query("FIL-12_reference_domains", "WITH c AS (SELECT conv_id, string_agg(role, '-' ORDER BY turn, role) AS mda FROM conversations GROUP BY conv_id) SELECT conv_id, turn FROM conversations JOIN c USING (conv_id) WHERE mda LIKE 'user-assistant-user%'")
def _(spark, d):
    conv = read(spark, d, "conversations")
    mda = ag.composition(conv, "conv_id", "turn", "role").where(F.col("mda").startswith("user-assistant-user"))
    return conv.join(mda, "conv_id", "left_semi").select("conv_id", "turn")


@query("FIL-13_scores_within", f"WITH {_SC}, l AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT * FROM s WHERE score <= 500 AND id1 IN (FROM l) AND id2 IN (FROM l)")
def _(spark, d):
    live = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id"))
    return rel.scores_within(_scores(spark, d), live, 500).select("project", "id1", "id2", "score")


@query("FIL-14_drop_failed", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus <> 'P') AS good, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders GROUP BY ALL")
def _(spark, d):
    rows = read(spark, d, "orders").withColumn("_error", F.when(F.col("o_orderstatus") == "P", F.lit(1)))
    good, failed = rel.split_failed(rows)
    both = good.select("o_orderpriority", F.lit(1).alias("g"), F.lit(0).alias("f")).unionByName(failed.select("o_orderpriority", F.lit(0).alias("g"), F.lit(1).alias("f")))
    return both.groupBy("o_orderpriority").agg(F.sum("g").alias("good"), F.sum("f").alias("failed"))


# joins --------------------------------------------------------------------------------------


@query("JN-01_domains_with_sequence", "SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity < 5")
def _(spark, d):
    rows = read(spark, d, "lineitem").where("l_quantity < 5")
    rows = rel.with_details(rows, (read(spark, d, "part"), "p_partkey", "l_partkey"), (read(spark, d, "supplier"), "s_suppkey", "l_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("JN-02_member_family_lookup", "SELECT DISTINCT s_name || '/' || l_linenumber AS member, p_brand || '-ff-' || p_size AS family FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def _(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(read(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.select(fn.domain_id(F.col("s_name"), F.col("l_linenumber").cast("string")).alias("member"), fn.family_id(F.col("p_brand"), F.col("p_size")).alias("family")).distinct()


@query("JN-03_map_clusters", "SELECT s_suppkey, n_name AS cluster FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(spark, d):
    mapping = read(spark, d, "nation").select(F.col("n_nationkey").alias("old"), F.col("n_name").alias("new"))
    return rel.mapped_ids(read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cluster")), mapping, "cluster").select("s_suppkey", "cluster")


@query("JN-04_first_accession", "SELECT c_custkey, min(o_orderkey) AS first FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    return rel.first_matches(read(spark, d, "customer"), read(spark, d, "orders"), "c_custkey", "o_custkey", "o_orderkey")[0]


@query("JN-05_id_mapping", "SELECT o_orderkey, c_name, n_name, length(c_name) AS len FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    seqs = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = rel.id_mapping(read(spark, d, "orders"), seqs, "o_orderkey", (read(spark, d, "customer"), "c_custkey", "o_custkey"), (read(spark, d, "nation"), "n_nationkey", "c_nationkey"))
    return rows.select("o_orderkey", "c_name", "n_name", F.length("c_name").cast("long").alias("len"))


@query("JN-06_accession_terms_join", "SELECT DISTINCT o_custkey, l_returnflag AS term FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(spark, d):
    return rel.joined_terms(read(spark, d, "orders"), read(spark, d, "lineitem"), "l_orderkey", "o_orderkey", "o_custkey", "l_returnflag")


@query("JN-07_all_pairs", "SELECT a.s_nationkey AS project, a.s_suppkey AS id1, b.s_suppkey AS id2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <= b.s_suppkey")
def _(spark, d):
    return rel.all_pairs(read(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id")), "id", with_self=True)


_HITS = "h AS (SELECT l_suppkey AS id1, o_custkey % 100 + 1 AS id2, min(l_discount) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 GROUP BY ALL)"


def _directed(spark, d):
    return _hits(spark, d).where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("id1"), (F.col("o_custkey") % 100 + 1).alias("id2")).agg(F.min("l_discount").alias("value"))


@query("JN-08_triangle_complete", f"""WITH {_HITS}, p AS (SELECT a.s_suppkey AS id1, b.s_suppkey AS id2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <= b.s_suppkey)
SELECT p.id1, p.id2, CASE WHEN p.id1 = p.id2 THEN 0 ELSE coalesce(f.value, r.value, 0.02) END AS dist FROM p LEFT JOIN h f ON f.id1 = p.id1 AND f.id2 = p.id2 LEFT JOIN h r ON r.id1 = p.id2 AND r.id2 = p.id1""")
def _(spark, d):
    pairs = rel.all_pairs(read(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id")), "id", with_self=True)
    return rel.triangle_complete(pairs.select("id1", "id2"), _directed(spark, d))


@query("JN-09_reverse_fill", f"""WITH {_HITS}, p AS (SELECT a.s_suppkey AS id1, b.s_suppkey AS id2 FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT p.id1, p.id2, coalesce(f.value, r.value, 100000000.0) AS score FROM p LEFT JOIN h f ON f.id1 = p.id1 AND f.id2 = p.id2 LEFT JOIN h r ON r.id1 = p.id2 AND r.id2 = p.id1""")
def _(spark, d):
    pairs = rel.all_pairs(read(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id")), "id")
    return rel.triangle_complete(pairs.select("id1", "id2"), _directed(spark, d), fn.REALLY_BAD, "score")


@query("JN-10_refill_members", "SELECT DISTINCT a.l_orderkey AS node, b.l_suppkey AS item FROM (SELECT l_orderkey, l_suppkey % 50 AS c FROM lineitem WHERE l_quantity = 50) a JOIN (SELECT DISTINCT l_suppkey, l_suppkey % 50 AS c FROM lineitem) b USING (c)")
def _(spark, d):
    rows = read(spark, d, "lineitem")
    members = rows.select(F.col("l_suppkey").alias("item"), (F.col("l_suppkey") % 50).alias("cluster")).distinct()
    return rel.refill_members(rows.where("l_quantity = 50").select(F.col("l_orderkey").alias("node"), F.col("l_suppkey").alias("item")), members)


@query("JN-11_reduce_to_centres", "SELECT p_partkey, replace(p_name, 'a', '') AS seq FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand, p_type)")
def _(spark, d):
    part = read(spark, d, "part")
    centres = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("p_partkey"))
    return part.join(centres, "p_partkey", "left_semi").select("p_partkey", fn.ungap(F.translate("p_name", "a", "-")).alias("seq"))


@query("JN-13_score_compare", """WITH a AS (SELECT least(l_suppkey, l_partkey) AS id1, greatest(l_suppkey, l_partkey) AS id2, arg_max(l_discount, (l_orderkey, l_linenumber)) AS s FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
b AS (SELECT least(l_suppkey, l_partkey) AS id1, greatest(l_suppkey, l_partkey) AS id2, arg_max(l_discount, (l_orderkey, l_linenumber)) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT id1, id2, coalesce(a.s, 0) AS score_a, coalesce(b.s, 0) AS score_b FROM a FULL JOIN b USING (id1, id2)""")
def _(spark, d):
    rows = read(spark, d, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("id1"), F.col("l_partkey").alias("id2"), F.col("l_discount").alias("score"), F.struct("l_orderkey", "l_linenumber").alias("ord"))
    return rel.score_compare(rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'"))


@query("JN-14_score_triples", f"""WITH {_SC}, n AS (SELECT id1, id2, score FROM s WHERE score < 800), t AS (SELECT * FROM n UNION ALL SELECT id2, id1, score FROM n)
SELECT x.id1 AS a, x.id2 AS b, y.id2 AS c, x.score AS ab, y.score AS bc, z.score AS ac FROM t x JOIN t y ON y.id1 = x.id2 AND y.id2 <> x.id1 JOIN t z ON z.id1 = x.id1 AND z.id2 = y.id2""")
def _(spark, d):
    return rel.score_triples(_scores(spark, d).where("score < 800"))


@query("JN-15_pair_lookup", f"WITH {_SC} SELECT p.id1, p.id2, score FROM (SELECT DISTINCT l_suppkey AS id1, o_custkey % 100 + 1 AS id2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey) p LEFT JOIN s ON s.id1 = least(p.id1, p.id2) AND s.id2 = greatest(p.id1, p.id2)")
def _(spark, d):
    pairs = _hits(spark, d).select(F.col("l_suppkey").alias("id1"), (F.col("o_custkey") % 100 + 1).alias("id2")).distinct()
    return rel.pair_lookup(pairs, _scores(spark, d))


@query("JN-16_annotate_proteins", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 40 = 1)")
def _(spark, d):
    rows = read(spark, d, "lineitem")
    return rel.of_annotated(rows, rows.where("l_partkey % 40 = 1"), "l_orderkey").select("l_orderkey", "l_linenumber")


@query("JN-17_cluster_ec", "SELECT source, d.doc_id, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def _(spark, d):
    return rel.cluster_annotations(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id", "source", "doc_id", "quality")


@query("JN-18_in_list_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, d):
    ids = read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return rel.in_list(read(spark, d, "part"), ids, "p_partkey").select("p_partkey", "p_name")


# aggregations -------------------------------------------------------------------------------


@query("AG-01_best_hit", "SELECT l_suppkey, l_partkey, min(l_discount) AS score FROM lineitem GROUP BY ALL")
def _(spark, d):
    return ag.best_hit(read(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.col("l_discount").alias("score")), "l_suppkey", "l_partkey")


@query("AG-02_mean_linkage_scan", f"""WITH {_SC}, m AS (SELECT s_nationkey AS project, s_suppkey % 4 AS c, s_suppkey AS id FROM supplier)
SELECT s.project, least(a.c, b.c) AS id1, greatest(a.c, b.c) AS id2, round(avg(score), 6) AS score FROM s JOIN m a ON a.id = id1 JOIN m b ON b.id = id2 WHERE a.c <> b.c GROUP BY ALL""")
def _(spark, d):
    members = read(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), (F.col("s_suppkey") % 4).alias("cluster"), F.col("s_suppkey").alias("id"))
    return ag.mean_linkage(members, _scores(spark, d).withColumnRenamed("score", "dist")).select("project", "id1", "id2", F.round("score", 6).alias("score"))


@query("AG-03_nearest_per_id", f"""WITH {_SC}, t AS (SELECT project, id1 AS id, id2 AS partner, score FROM s UNION ALL SELECT project, id2, id1, score FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, partner) AS r FROM t)
SELECT s_nationkey AS project, s_suppkey AS id, partner, coalesce(score, CAST('inf' AS DOUBLE)) AS score FROM supplier LEFT JOIN (FROM b WHERE r = 1) ON id = s_suppkey""")
def _(spark, d):
    ids = read(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), F.col("s_suppkey").alias("id"))
    return ag.nearest(_scores(spark, d), ids)


@query("AG-04_global_nearest", f"WITH {_SC} SELECT project, id1, id2, score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score, id1, id2) AS r FROM s) WHERE r = 1")
def _(spark, d):
    return ag.global_nearest(_scores(spark, d))


@query("AG-05_cluster_sizes", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def _(spark, d):
    return ag.cluster_sizes(read(spark, d, "documents"), "source")


_MDA = "c AS (SELECT conv_id, string_agg(role, '-' ORDER BY turn, role) AS mda, count(*) AS domains FROM conversations GROUP BY conv_id)"


@query("AG-06_mda_summary", f"WITH {_MDA} SELECT mda, count(*) AS proteins, CAST(sum(domains) AS BIGINT) AS domains FROM c GROUP BY mda")
def _(spark, d):
    conv = read(spark, d, "conversations")
    rows = ag.composition(conv, "conv_id", "turn", "role").join(conv.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")
    return rows.groupBy("mda").agg(F.count("*").alias("proteins"), F.sum("n").alias("domains"))


@query("AG-07_domain_length_stats", "SELECT role, round(avg(length(text)), 6) AS mean, min(length(text)) AS least, max(length(text)) AS most FROM conversations GROUP BY role")
def _(spark, d):
    n = F.length("text").cast("long")
    return ag.length_stats(read(spark, d, "conversations"), "role", n)


@query("AG-08_ec_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, d):
    return ag.code_counts(read(spark, d, "documents"), "source", "lang")


@query("AG-09_term_counts", "SELECT event_type AS term, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return ag.term_counts(read(spark, d, "events").select("user_id", F.col("event_type").alias("term")), "user_id", "term")


@query("AG-10_term_counts_with_ancestors", """WITH t AS (SELECT DISTINCT c_custkey, n_name AS term, r_name AS up FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT term, count(*) AS n FROM (SELECT c_custkey, term FROM t UNION SELECT c_custkey, up FROM t UNION SELECT c_custkey, 'all' FROM t) GROUP BY term""")
def _(spark, d):
    from dendrospark.operators.hierarchy import closure
    from dendrospark.plans.trees import nation_edges

    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("term"))
    return ag.term_counts_with_ancestors(rows, closure(nation_edges(spark, d)), "c_custkey", "term")


@query("AG-11_annotation_histogram", "SELECT terms, count(*) AS n FROM (SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS terms FROM events GROUP BY user_id) GROUP BY terms")
def _(spark, d):
    return ag.collected(read(spark, d, "events"), "user_id", "event_type", "terms").groupBy("terms").agg(F.count("*").alias("n"))


def _partition(spark, d):
    clusters = read(spark, d, "documents").select(F.col("source").alias("cluster"), F.col("doc_id").alias("item"))
    classes = read(spark, d, "labels").select(F.col("quality").alias("class"), F.col("doc_id").alias("item"))
    return clusters, classes


_Q = """c AS (SELECT source AS cluster, doc_id AS item FROM documents), r AS (SELECT quality AS class, doc_id AS item FROM labels),
k AS (SELECT cluster, class, count(*) AS n FROM c JOIN r USING (item) GROUP BY ALL), t AS (SELECT count(*) AS t FROM r),
ca AS (SELECT cluster, count(*) AS n FROM c GROUP BY ALL), ra AS (SELECT class, count(*) AS n FROM r GROUP BY ALL)"""


@query("AG-12_purity", f"WITH {_Q} SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 9) AS purity FROM (SELECT cluster, count(*) AS n FROM k GROUP BY cluster)")
def _(spark, d):
    return quality.purity(*_partition(spark, d)).select(F.round("purity", 9).alias("purity"))


@query("AG-13_edit_distance", f"WITH {_Q} SELECT 2 * (SELECT count(*) FROM k) - (SELECT count(*) FROM ca) - (SELECT count(*) FROM ra) AS edit_distance")
def _(spark, d):
    return quality.edit_distance(*_partition(spark, d))


@query("AG-14_entropy", f"WITH {_Q} SELECT round(sum(n / t * ln(n / t)), 6) AS entropy FROM ca, t")
def _(spark, d):
    return quality.entropy(*_partition(spark, d)).select(F.round("entropy", 6).alias("entropy"))


@query("AG-15_mutual_information", f"WITH {_Q} SELECT round(sum(n / t * ln(n / t)), 6) AS mutual_information FROM k, t")
def _(spark, d):
    return quality.mutual_information(*_partition(spark, d)).select(F.round("mutual_information", 6).alias("mutual_information"))


_VI = "(SELECT sum(n / t * ln(n / t)) FROM ca, t) + (SELECT sum(n / t * ln(n / t)) FROM ra, t) - 2 * (SELECT sum(n / t * ln(n / t)) FROM k, t)"


@query("AG-16_variation_of_information", f"WITH {_Q} SELECT round({_VI}, 6) AS vi")
def _(spark, d):
    return quality.variation_of_information(*_partition(spark, d)).select(F.round("vi", 6).alias("vi"))


@query("AG-17_performance", f"""WITH {_Q}, p AS (SELECT avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT cluster, count(*) AS n FROM k GROUP BY cluster)),
e AS (SELECT 2 * (SELECT count(*) FROM k) - (SELECT count(*) FROM ca) - (SELECT count(*) FROM ra) AS e,
 2 * (SELECT count(*) FROM r) - (SELECT count(DISTINCT item) FROM c) - (SELECT count(*) FROM ra) AS e0),
v AS (SELECT {_VI} AS v, (SELECT count(DISTINCT item) / t * ln(1.0 / t) FROM c, t GROUP BY t) + (SELECT sum(n / t * ln(n / t)) FROM ra, t) - 2 * (SELECT ln(1.0 / t) FROM t) AS v0)
SELECT round((2 * p * 100 + 100 - 100.0 * e / e0 + 100 - 100 * v / v0) / 4, 4) AS performance FROM p, e, v""")
def _(spark, d):
    return quality.performance(*_partition(spark, d)).select(F.round("performance", 4).alias("performance"))


@query("AG-18_ec_reference_partition", "SELECT term AS class, user_id AS item FROM (SELECT DISTINCT event_type AS term, user_id FROM events)")
def _(spark, d):
    rows = ag.collected(read(spark, d, "events"), "user_id", "event_type", "terms")
    return rows.select(F.explode(fn.text_terms(F.col("terms"))).alias("class"), F.col("user_id").alias("item"))


@query("AG-19_geometric_mean_score", "SELECT l_suppkey, round(exp(avg(ln(greatest(l_discount, 1e-300)))), 9) AS score FROM lineitem WHERE l_discount > 0 GROUP BY l_suppkey")
def _(spark, d):
    return read(spark, d, "lineitem").where("l_discount > 0").groupBy("l_suppkey").agg(F.round(ag.geometric_mean(F.col("l_discount")), 9).alias("score"))


@query("AG-20_collect_annotations", "SELECT l_orderkey, coalesce(string_agg(DISTINCT CASE WHEN l_quantity > 10 THEN l_returnflag END, ';' ORDER BY CASE WHEN l_quantity > 10 THEN l_returnflag END), 'none') AS terms FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("t"))
    return ag.collected(rows, "l_orderkey", "t", "terms")


@query("AG-21_distinct_families", "SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 20")
def _(spark, d):
    return ag.distinct_families(read(spark, d, "part").where("p_size > 20"), "p_brand", "p_type")


@query("AG-22_first_accession_per_domain", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS acc FROM lineitem GROUP BY ALL")
def _(spark, d):
    return ag.first_accessions(read(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey")


@query("AG-23_annotation_load", """WITH t AS (SELECT DISTINCT c_custkey AS key, c_mktsegment, n_name AS term FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name NOT LIKE '%1'),
x AS (SELECT key, term FROM t UNION SELECT key, r_name FROM t JOIN nation ON n_name = term JOIN region ON r_regionkey = n_regionkey)
SELECT key, string_agg(term, ';' ORDER BY term) AS terms FROM x WHERE term IN (SELECT n_name FROM nation) GROUP BY key""")
def _(spark, d):
    from dendrospark.operators.hierarchy import closure, most_specific
    from dendrospark.plans.trees import nation_edges

    up = closure(nation_edges(spark, d))
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).where(~F.col("n_name").endswith("1")).select(F.col("c_custkey").alias("key"), F.col("n_name").alias("term")).distinct()
    regions = rows.join(up.select(F.col("child").alias("term"), "ancestor"), "term").where("ancestor <> 'all'").select("key", F.col("ancestor").alias("term"))
    return ag.collected(most_specific(rows.unionByName(regions).distinct(), up), "key", "term", "terms")


@query("AG-24_annotation_transfer", """WITH t AS (SELECT DISTINCT l_orderkey AS item, l_linenumber AS term FROM lineitem), c AS (SELECT o_orderkey AS item, o_orderpriority AS code FROM orders WHERE o_orderstatus = 'P'),
seen AS (SELECT DISTINCT code, term FROM c JOIN t USING (item) WHERE term <= 3), need AS (SELECT code, count(*) AS need FROM seen GROUP BY code),
has AS (SELECT item, code, count(*) AS has FROM t JOIN seen USING (term) GROUP BY ALL)
SELECT item, code FROM has JOIN need USING (code) WHERE has = need UNION SELECT item, code FROM c""")
def _(spark, d):
    terms = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("term"))
    codes = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("code"))
    return ag.annotation_transfer(terms, codes, terms.where("term <= 3").select("term").distinct())[1]


@query("AG-25_cluster_length_mean", "SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean FROM documents GROUP BY source")
def _(spark, d):
    return ag.length_mean(read(spark, d, "documents"), "source", F.length("text"))


@query("AG-26_domain_count", "SELECT count(*) AS n FROM conversations")
def _(spark, d):
    return ag.row_count(read(spark, d, "conversations"))


# windows ------------------------------------------------------------------------------------


@query("WN-01_renumber_clusters", "SELECT n_nationkey, c_custkey, 'working_' || (row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) + 100) AS working_id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return wn.renumber(rows, "n_nationkey", [F.col("c_custkey")], offset=100)


@query("WN-02_partition_projects", """WITH s AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), m AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY n) AS m FROM s),
l AS (SELECT p_type, n, row_number() OVER (ORDER BY n DESC, p_type) AS project FROM s WHERE n >= 20)
SELECT p_type, n, CAST(project AS INTEGER) AS project FROM l UNION ALL SELECT p_type, n, CAST((SELECT count(*) FROM l) + 1 AS INTEGER) FROM s WHERE n < 20""")
def _(spark, d):
    return wn.partition_projects(read(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n")), "p_type", "n", 20)


# of runs of places where the list begins, one after the other at its length, every second is taken; roles don't repeat in the list, so no two overlap
@query("WN-03_merge_mda_run", """WITH r AS (SELECT conv_id AS protein, turn * 20 AS start, turn * 20 + 15 AS stop, role AS family, lead(role) OVER w AS nf, lead(turn) OVER w * 20 AS ns, lead(turn) OVER w * 20 + 15 AS np FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
f AS (SELECT *, family = 'user' AND coalesce(nf, '') = 'assistant' AS fits FROM r), g AS (SELECT *, lag(fits, 1, false) OVER (PARTITION BY protein ORDER BY start, family) AS tail FROM f)
SELECT protein, CASE WHEN fits THEN 'user-assistant' ELSE family END AS family, CASE WHEN fits THEN CASE WHEN ns - stop <= 10 THEN start || '-' || np ELSE start || '-' || stop || '_' || ns || '-' || np END ELSE start || '-' || stop END AS segments FROM g WHERE fits OR NOT tail""")
def _(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("protein"), (F.col("turn") * 20).alias("start"), (F.col("turn") * 20 + 15).alias("stop"), F.col("role").alias("family"))
    return wn.merge_runs(rows, ["user", "assistant"]).select("protein", "family", fn.render_segments(F.col("segments")).alias("segments"))


@query("WN-04_running_cut", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity)) WHERE m <= 30")
def _(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("score"))
    return wn.running_cut(rows.withColumnsRenamed({"l_orderkey": "project", "l_linenumber": "step"}), 30).select(F.col("project").alias("l_orderkey"), F.col("step").alias("l_linenumber"))


@query("WN-05_chunk_rows", "SELECT c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 7) AS BIGINT) AS chunk FROM customer")
def _(spark, d):
    return wn.chunks(read(spark, d, "customer").select("c_nationkey", "c_custkey"), 7, "c_nationkey", [F.col("c_custkey")]).select("c_custkey", "chunk")


# sorts and samples --------------------------------------------------------------------------


@query("SO-01_sort_scores", f"WITH {_SC} SELECT * FROM s WHERE score <= 100 UNION ALL SELECT * FROM s WHERE score > 5000")
def _(spark, d):
    return rel.sorted_scores(_scores(spark, d), 100, 5000)


@query("SO-02_natural_sort", "SELECT p_brand, string_agg('b' || p_partkey, ',' ORDER BY p_partkey) AS ids FROM part GROUP BY p_brand")
def _(spark, d):
    names = F.collect_list(F.concat(F.lit("b"), F.col("p_partkey").cast("string")))
    return read(spark, d, "part").groupBy("p_brand").agg(F.array_join(fn.natural_sorted(names), ",").alias("ids"))


@query("SO-03_row_limit", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def _(spark, d):
    return rel.row_limit(read(spark, d, "orders"), 500, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey")


@query("SO-04_sample_pairs", f"WITH {_SC} SELECT id1, id2 FROM s ORDER BY md5(id1 || ':' || id2), id1, id2 LIMIT (SELECT greatest(10, count(*) // 10) FROM s)")
def _(spark, d):
    pairs = _scores(spark, d).select("id1", "id2")
    rows = rel.sample_count(pairs.count(), 0.1, low=10)
    return rel.sample_pairs(pairs, rows, F.md5(F.concat_ws(":", F.col("id1").cast("string"), F.col("id2").cast("string")).cast("binary")))


@query("SO-05_sample_pairs_by_centres", """WITH c AS (SELECT c_nationkey AS project, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
m AS (SELECT *, r <= greatest(10, n // 100) AS centre FROM c) SELECT a.project, a.id AS id1, b.id AS id2 FROM m a JOIN m b ON a.project = b.project AND a.centre AND NOT b.centre""")
def _(spark, d):
    ids = read(spark, d, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("id"))
    return rel.centre_pairs(ids, F.md5(F.col("id").cast("string").cast("binary"))).select("project", "id1", "id2")


@query("SO-06_shuffle", "SELECT c_custkey, md5(c_custkey::VARCHAR || '7') AS place FROM customer")
def _(spark, d):
    return rel.shuffled(read(spark, d, "customer").select("c_custkey"), "c_custkey", 7)


@query("SO-07_merge_cap", f"WITH {_SC} SELECT project, id1, id2, score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score, id1, id2) AS r FROM s) WHERE r <= 3")
def _(spark, d):
    return rel.first_rows(_scores(spark, d), 3, F.col("score"), F.col("id1"), F.col("id2"))


@query("SO-08_value_sorted", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, d):
    return rel.value_sorted(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


# sets ---------------------------------------------------------------------------------------


@query("ST-01_union_distinct", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'")
def _(spark, d):
    rows = read(spark, d, "lineitem")
    return rel.union_distinct(*[rows.where(x).select("l_partkey", "l_suppkey") for x in ("l_returnflag = 'A'", "l_linestatus = 'F'")])


@query("ST-02_union_all", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def _(spark, d):
    return rel.union_all(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), read(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("ST-03_override_union", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    extra = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return rel.override_union(read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), extra, "k")


@query("ST-04_upsert_domains", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    old = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return rel.upsert(old, read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), "k")


@query("ST-05_pool_mappings", "SELECT n, count(*) AS size FROM (SELECT c_nationkey AS n, c_custkey AS k FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier) GROUP BY n")
def _(spark, d):
    a = read(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("k"))
    return rel.pool_mappings(a, read(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("k"))).groupBy("n").agg(F.count("*").alias("size"))


QUERIES, ORACLE = query.queries, query.sql
