"""Queries of sources and sinks (SRC): each writes rows of the driver's tables as a file format and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dendrospark.functions import scalar as fn
from dendrospark.operators import aggregates as ag
from dendrospark.operators.storage import new_path
from dendrospark.plans.common import Registry, read
from dendrospark.plans.trees import ORACLE as TREES
from dendrospark.sources import jdbc
from dendrospark.sources import matrix as mx
from dendrospark.sources import text as src
from dendrospark.sources import trees as tr

query = Registry()
TRACE = TREES["SRC-10_trace_sink"]


def _records(spark, d):
    return read(spark, d, "part").select(
        F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("seq_id"), F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" "), "p_type", F.lit(";")).alias("description"), F.upper(F.regexp_replace("p_name", r"\s", "")).alias("sequence")
    )


_REC = "SELECT p_brand || '/' || p_partkey AS seq_id, trim('size ' || p_size || ' ' || p_type || ';') AS description, upper(regexp_replace(p_name, '\\s', '', 'g')) AS sequence FROM part"


@query("SRC-01_fasta_scan", _REC)
def _(spark, d):
    path = new_path(spark, "fasta")
    src.write_fasta(_records(spark, d), path)
    return src.read_fasta(spark, path).drop("file")


@query("SRC-02_fasta_to_csv", f"SELECT seq_id AS label, sequence FROM ({_REC})")
def _(spark, d):
    path = new_path(spark, "csv")
    src.fasta_to_csv(_records(spark, d), path)
    return spark.read.schema("label string, sequence string").option("header", True).csv(path)


@query("SRC-03_pfam_normalise", f"SELECT split_part(seq_id, '/', 1) AS acc, split_part(seq_id, '/', 2) AS bounds, replace(regexp_extract(description, '(\\S+)$', 1), ';', '') AS family FROM ({_REC})")
def _(spark, d):
    path = new_path(spark, "fasta")
    src.write_fasta(_records(spark, d), path)
    return src.pfam_rows(src.read_fasta(spark, path)).drop("sequence")


@query("SRC-04_clstr_scan", "SELECT CAST(s_nationkey AS VARCHAR) AS cluster, 's' || s_suppkey AS member, s_suppkey = min(s_suppkey) OVER (PARTITION BY s_nationkey) AS is_center FROM supplier")
def _(spark, d):
    s = read(spark, d, "supplier")
    members = F.array_sort(F.collect_list("s_suppkey"))
    line = lambda k, i: F.concat(i.cast("string"), F.lit("\t100aa, >s"), k.cast("string"), F.lit("... "), F.when(i == 0, F.lit("*")).otherwise(F.lit("at 95%")))
    rows = s.groupBy("s_nationkey").agg(F.concat(F.lit(">Cluster "), F.first("s_nationkey").cast("string"), F.lit("\n"), F.array_join(F.transform(members, line), "\n")).alias("value"))
    path = new_path(spark, "clusters")
    rows.select("value").write.text(path)
    return src.read_clusters(spark, path)


@query("SRC-05_score_scan", "SELECT CAST(l_suppkey AS VARCHAR) AS id1, CAST(l_partkey AS VARCHAR) AS id2, min(l_discount) AS score FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id1"), F.col("l_partkey").alias("id2")).agg(F.min("l_discount").alias("score"))
    path = new_path(spark, "scores")
    src.write_scores(rows, path)
    return src.read_scores(spark, path)


@query("SRC-06_score_sink", "SELECT CAST(l_suppkey AS VARCHAR) AS id1, CAST(l_orderkey AS VARCHAR) AS id2, min(l_tax) AS score FROM lineitem GROUP BY ALL")
def _(spark, d):
    """Scores in folders by half, read back by a path with a wildcard."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id1"), F.col("l_orderkey").alias("id2")).agg(F.min("l_tax").alias("score"))
    path = new_path(spark, "scores")
    for half in (0, 1):
        src.write_scores(rows.where(F.col("id2") % 2 == half), f"{path}/half{half}")
    return src.read_scores(spark, f"{path}/half*")


@query("SRC-07_profile_hits_scan", "SELECT 'c' || o_custkey % 40 AS query, replace(o_orderpriority, ' ', '_') AS match, min(o_orderkey / 8.0) AS evalue FROM orders GROUP BY ALL")
def _(spark, d):
    """A customer's reports have about 65,536 hits each, so that no task or row holds all of them."""
    o = read(spark, d, "orders")
    part = F.pmod(F.xxhash64("o_orderkey"), F.lit(o.count() // (40 * 65536) + 1)).alias("part")
    o = o.select((F.col("o_custkey") % 40).alias("q"), part, F.replace("o_orderpriority", F.lit(" "), F.lit("_")).alias("p"), (F.col("o_orderkey") / F.lit(8.0)).alias("e"))
    line = F.concat_ws(" ", F.lit("1"), "p", F.lit("99.9"), F.col("e").cast("string"), F.lit("0 1 2 3 4-5 6-7 (8)"))
    around = {0: F.concat(F.lit("Query         c"), F.col("q").cast("string")), 1: F.lit(""), 2: F.lit(" No Hit Prob"), 4: F.lit(""), 5: F.lit("No 1")}
    ends = F.inline(F.array(*[F.struct(F.lit(i).alias("at"), x.alias("value")) for i, x in around.items()]))
    rows = o.select("q", "part", F.lit(3).alias("at"), line.alias("value")).unionByName(o.select("q", "part").distinct().select("q", "part", ends))
    path = new_path(spark, "hits")
    rows.repartition("q", "part").sortWithinPartitions("q", "part", "at").select("q", "part", "value").write.partitionBy("q", "part").text(path)
    return src.read_profile_hits(spark, path)


@query("SRC-08_compass_report_scan", "SELECT 's' || s_suppkey AS id1, 'n' || s_nationkey AS id2, s_suppkey / 8.0 AS evalue FROM supplier WHERE s_suppkey % 5 <> 0")
def _(spark, d):
    s = read(spark, d, "supplier")
    e = F.when(F.col("s_suppkey") % 5 != 0, F.concat(F.lit("Evalue = "), (F.col("s_suppkey") / F.lit(8.0)).cast("string"))).otherwise(F.lit("** not found **"))
    path = new_path(spark, "compass")
    s.select(F.concat(F.lit("Ali1: s"), F.col("s_suppkey").cast("string"), F.lit(" Ali2: n"), F.col("s_nationkey").cast("string"), F.lit("\n"), e).alias("value")).write.text(path)
    return src.read_compass(spark, path)


@query("SRC-09_trace_scan", TRACE)
def _(spark, d):
    from dendrospark.plans.trees import part_merges

    path = new_path(spark, "traces")
    tr.write_traces(part_merges(spark, d), path)
    return tr.read_traces(spark, path).drop("project")


@query("SRC-13_distance_scan", "SELECT least(l_suppkey, l_partkey) AS id1, greatest(l_suppkey, l_partkey) AS id2, min(l_tax) AS dist FROM lineitem GROUP BY ALL")
def _(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("id1"), F.col("l_partkey").alias("id2"), F.col("l_tax").alias("score"))
    path = new_path(spark, "distances")
    src.write_scores(rows, path, sep=" ")
    got = src.read_scores(spark, path)
    a, b = fn.canonical_pair(F.col("id1").cast("long"), F.col("id2").cast("long"))
    return got.groupBy(a.alias("id1"), b.alias("id2")).agg(F.min("score").alias("dist"))


@query("SRC-14_embedding_scan", "SELECT vec_id AS id, len(embedding) AS n FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def _(spark, d):
    names = read(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    return src.embedding_subset(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), names).select("id", F.size("embedding").cast("long").alias("n"))


def _matrix(kind):
    def plan(spark, d):
        """All vectors as matrices with names, read in ranges of 100 rows; those of large parts."""
        path = new_path(spark, "matrix")
        vectors = read(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"), "embedding")
        mx.write_matrix(vectors.repartition(3, "name"), path, kind)
        names = read(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("name"))
        return mx.read_matrix(spark, path, 100, names).select("name", F.posexplode("embedding").alias("at", "value"))

    return plan


_MATRIX = """SELECT 'v' || vec_id AS name, CAST(i - 1 AS INTEGER) AS at, CAST(embedding[i] AS DOUBLE) AS value
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part WHERE p_size > 25))"""
query("SRC-14_matrix_scan", _MATRIX)(_matrix("npy"))
query("SRC-14_archive_scan", _MATRIX)(_matrix("npz"))


@query("SRC-15_alignment_hits_scan", "SELECT 's' || l_suppkey AS query, 'p' || l_partkey AS target, CAST(l_quantity AS INTEGER) AS alnlen, l_extendedprice AS bits FROM lineitem WHERE l_linenumber = 2")
def _(spark, d):
    rows = read(spark, d, "lineitem").where("l_linenumber = 2")
    t = lambda c: F.col(c).cast("string")
    cols = [F.concat(F.lit("s"), t("l_suppkey")), F.concat(F.lit("p"), t("l_partkey")), F.lit(100), F.lit(90), F.col("l_quantity").cast("int"), F.col("l_extendedprice")]
    path = new_path(spark, "hits")
    rows.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).write.csv(path, sep="\t")
    return src.read_hits(spark, path).select("query", "target", "alnlen", "bits")


@query("SRC-16_gaf_scan", "SELECT 'A' || o_orderkey AS acc, CASE WHEN o_orderstatus = 'P' THEN 'NOT' END AS qualifier, o_orderpriority AS term, CAST(o_custkey AS VARCHAR) AS taxon FROM orders")
def _(spark, d):
    o = read(spark, d, "orders")
    cols = {i: F.lit("x") for i in range(13)} | {0: F.lit("UniProtKB"), 1: F.concat(F.lit("A"), F.col("o_orderkey").cast("string")), 3: F.when(F.col("o_orderstatus") == "P", F.lit("NOT")), 4: F.col("o_orderpriority"), 12: F.col("o_custkey").cast("string")}
    path = new_path(spark, "gaf")
    o.select(*[c.alias(f"c{i}") for i, c in cols.items()]).write.csv(path, sep="\t", header=True)
    return src.read_gaf(spark, path).select("acc", "qualifier", "term", "taxon")


@query("SRC-17_obo_scan", "SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 6 <> 5")
def _(spark, d):
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    old = F.when(F.col("n_nationkey") % 6 == 5, F.lit("<is_obsolete>1</is_obsolete>")).otherwise(F.lit(""))
    x = F.concat(F.lit("<term>\n<id>"), "n_name", F.lit("</id><name>"), "n_name", F.lit("</name><namespace>molecular_function</namespace>"), F.lit("<is_a>"), "r_name", F.lit("</is_a>"), old, F.lit("</term>"))
    path = new_path(spark, "obo")
    rows.select(x.alias("value")).write.text(path)
    return src.read_obo(spark, path)[1]


@query("SRC-18_taxonomy_scan", "SELECT p_partkey AS taxon, p_name AS name, p_partkey // 2 AS parent FROM part WHERE p_size > 3 UNION ALL SELECT -1, 'all', NULL")
def _(spark, d):
    p = read(spark, d, "part")
    cols = [F.lit("x")] * 10
    cols[0], cols[2], cols[9] = F.col("p_partkey").cast("string"), F.col("p_name"), F.when(F.col("p_size") > 3, F.floor(F.col("p_partkey") / 2).cast("string"))
    path = new_path(spark, "taxonomy")
    p.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).write.csv(path, sep="\t")
    return src.read_taxonomy(spark, path)


@query("SRC-19_keyed_list_scan", "SELECT CAST(user_id AS VARCHAR) AS key, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS terms FROM events GROUP BY user_id")
def _(spark, d):
    rows = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.collect_set("event_type").alias("values"))
    path = new_path(spark, "lists")
    src.write_keyed_lists(rows, path)
    return src.read_keyed_lists(spark, path).select("key", fn.terms_text(F.col("values")).alias("terms"))


@query("SRC-20_jdbc_source", """SELECT p_partkey, p_brand, p_size, p_retailprice FROM part WHERE p_size < 30 AND p_brand <> 'it''s' AND p_retailprice > 1000""")
def _(spark, d):
    """Parts in a database of this process; a parameterised select, read in eight ranges of the key, with a filter pushed down."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = f"jdbc:derby:memory:parts{uuid.uuid4().hex}"
    own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    jdbc.write_table(read(spark, d, "part"), f"{url};create=true", "parts", "p_name VARCHAR(200), p_brand VARCHAR(40), p_type VARCHAR(60)", **own)
    chosen = jdbc.select('SELECT "p_partkey", "p_brand", "p_size", "p_retailprice" FROM parts WHERE "p_size" < :most AND "p_brand" <> :brand', most=30, brand="it's")
    return jdbc.read_query(spark, url, chosen, "p_partkey", **own).where("p_retailprice > 1000")


@query("SRC-21_id_list_scan", "SELECT 'C' || c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0")
def _(spark, d):
    line = F.concat(F.when(F.col("c_custkey") % 4 == 0, F.lit("# ")).otherwise(F.lit(" ")), F.lit("C"), F.col("c_custkey").cast("string"), F.lit(" more"))
    path = new_path(spark, "ids")
    read(spark, d, "customer").select(line.alias("value")).write.text(path)
    return src.read_id_list(spark, path)


@query("SRC-22_cluster_sink", "SELECT s_nationkey AS project, count(*) AS n FROM supplier GROUP BY ALL")
def _(spark, d):
    path = new_path(spark, "projects")
    src.write_clusters(read(spark, d, "supplier").select(F.col("s_nationkey").alias("project"), "s_suppkey"), path, "project")
    return spark.read.parquet(path).groupBy("project").agg(F.count("*").alias("n"))


@query("SRC-23_ec_counts_json_sink", """SELECT source, '{"cluster_name":"' || source || '","ec_codes":{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}}' AS json FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source""")
def _(spark, d):
    return src.ec_counts_json(read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")), "source", "lang")


@query("SRC-24_compressed_input", "SELECT c_custkey AS k, c_name AS name FROM customer")
def _(spark, d):
    path = new_path(spark, "gz")
    read(spark, d, "customer").select("c_custkey", "c_name").write.option("compression", "gzip").csv(path, sep="\t")
    return src.read_rows(spark, path, "k long, name string")


@query("SRC-25_node_seqs_sink", f"""WITH RECURSIVE m AS (SELECT p_partkey AS k FROM part WHERE p_partkey >= 1 AND 2 * p_partkey + 1 <= (SELECT max(p_partkey) FROM part)), e AS (SELECT 2 * k AS child, k AS parent FROM m UNION ALL SELECT 2 * k + 1, k FROM m),
up AS (SELECT child, parent AS node FROM e UNION ALL SELECT up.child, e.parent FROM up JOIN e ON e.child = up.node)
SELECT node, seq_id FROM up JOIN (SELECT p_partkey, p_brand || '/' || p_partkey AS seq_id FROM part) ON p_partkey = child WHERE node IN (4, 5, 6) AND child NOT IN (SELECT k FROM m)""")
def _(spark, d):
    from dendrospark.operators.hierarchy import leaves
    from dendrospark.plans.trees import part_merges

    own = leaves(part_merges(spark, d)).where(F.col("node").isin("4", "5", "6"))
    rows = _records(spark, d).withColumn("leaf", fn.id_tail(F.col("seq_id"))).join(own, "leaf").select("node", "seq_id", "description", "sequence")
    path = new_path(spark, "nodes")
    src.write_fasta(rows, path, "node")
    return src.read_fasta(spark, path, folders=("node",)).select(F.col("node").cast("long").alias("node"), "seq_id")


@query("SRC-26_term_names_scan", "SELECT n_name AS term, CAST(n_nationkey AS VARCHAR) AS name, CASE n_nationkey % 3 WHEN 0 THEN 'F' ELSE 'C' END AS type FROM nation WHERE n_nationkey % 3 <> 1")
def _(spark, d):
    n = read(spark, d, "nation")
    kind = F.when(F.col("n_nationkey") % 3 == 0, F.lit("F")).when(F.col("n_nationkey") % 3 == 1, F.lit("P")).otherwise(F.lit("C"))
    path = new_path(spark, "terms")
    src.write_term_names(n.select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("name"), kind.alias("type")), path)
    return src.read_term_names(spark, path, "^[FC]$")


@query("FN-15_term_type_filter", """SELECT o_custkey, count(*) FILTER (WHERE t IN ('1-URGENT', '2-HIGH')) AS valid, count(*) FILTER (WHERE t = '3-MEDIUM') AS invalid FROM (SELECT DISTINCT o_custkey, o_orderpriority AS t FROM orders) GROUP BY o_custkey HAVING count(*) FILTER (WHERE t IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) > 0""")
def _(spark, d):
    """Terms of wanted types, split by a deny list; others are dropped."""
    terms = read(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("term")).distinct()
    known = read(spark, d, "orders").select(F.col("o_orderpriority").alias("term")).distinct().withColumn("type", F.when(F.substring("term", 1, 1).isin("1", "2", "3"), F.lit("F")).otherwise(F.lit("P")))
    return ag.filter_terms(terms, known, "o_custkey", "^F$", ["3-MEDIUM"])


QUERIES, ORACLE = query.queries, query.sql
