"""Queries of the scalar functions (FN) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dendrospark.functions import scalar as fn
from dendrospark.plans.common import Registry, read

query = Registry()

_SEGS = """SELECT l_orderkey, string_agg(CAST(s AS VARCHAR) || '-' || CAST(s + n AS VARCHAR), '_' ORDER BY s, n) AS segs
  FROM (SELECT l_orderkey, l_linenumber * 20 AS s, CAST(l_quantity AS INTEGER) AS n FROM lineitem) GROUP BY l_orderkey"""


def _segments(spark, d):
    """Segments of each order, from its lines."""
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", F.struct((F.col("l_linenumber") * 20).alias("start"), (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("int")).alias("stop")).alias("s")
    )
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("segs"))


@query("FN-01_split_header", """SELECT c_custkey, split_part(split_part(h, ' ', 1), '/', 1) AS acc, split_part(split_part(h, ' ', 1), '/', 2) AS bounds
FROM (SELECT c_custkey, replace(c_name, '#', '') || '/' || c_custkey || '-' || (c_custkey + 9) || ' ' || c_mktsegment AS h FROM customer)""")
def _(spark, d):
    h = F.concat(F.replace("c_name", F.lit("#"), F.lit("")), F.lit("/"), F.col("c_custkey").cast("string"), F.lit("-"), (F.col("c_custkey") + 9).cast("string"), F.lit(" "), F.col("c_mktsegment"))
    return read(spark, d, "customer").select("c_custkey", fn.trunc_header(h).alias("acc"), F.get(fn.split_header(h), F.lit(1)).alias("bounds"))


@query("FN-02_parse_segments", f"""SELECT l_orderkey, CAST(split_part(x, '-', 1) AS INTEGER) AS start, CAST(split_part(x, '-', 2) AS INTEGER) AS stop
FROM (SELECT l_orderkey, unnest(string_split(segs, '_')) AS x FROM ({_SEGS}))""")
def _(spark, d):
    text = _segments(spark, d).select("l_orderkey", fn.render_segments(F.col("segs")).alias("t"))
    return text.select("l_orderkey", F.inline(fn.parse_segments(F.col("t"))))


@query("FN-03_render_segments", _SEGS)
def _(spark, d):
    return _segments(spark, d).select("l_orderkey", fn.render_segments(F.col("segs")).alias("segs"))


@query("FN-04_merge_segments", """WITH s AS (SELECT l_orderkey, l_linenumber * 20 AS a, l_linenumber * 20 + CAST(l_quantity AS INTEGER) AS b FROM lineitem),
o AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o),
m AS (SELECT l_orderkey, grp, min(a) AS a, max(b) AS b FROM g GROUP BY ALL)
SELECT l_orderkey, string_agg(a || '-' || b, '_' ORDER BY a) AS merged FROM m GROUP BY l_orderkey""")
def _(spark, d):
    return _segments(spark, d).select("l_orderkey", fn.render_segments(fn.merge_segments(F.col("segs"))).alias("merged"))


@query("FN-05_chop_sequence", """SELECT o_orderkey, substr(t, 2, 4) || substr(t, 8, 3) AS chopped
FROM (SELECT o_orderkey, o_orderpriority || o_orderstatus || CAST(o_custkey AS VARCHAR) || 'xxxxxxxx' AS t FROM orders)""")
def _(spark, d):
    t = F.concat("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"), F.lit("xxxxxxxx"))
    return read(spark, d, "orders").select("o_orderkey", fn.chop_sequence(t, fn.parse_segments(F.lit("2-5_8-10"))).alias("chopped"))


@query("FN-06_segment_bounds", """SELECT l_orderkey, min(a) AS start, arg_max(b, (a, b)) AS stop FROM
(SELECT l_orderkey, l_linenumber * 20 AS a, l_linenumber * 20 + CAST(l_quantity AS INTEGER) AS b FROM lineitem) GROUP BY l_orderkey""")
def _(spark, d):
    return _segments(spark, d).select("l_orderkey", fn.segment_start(F.col("segs")).alias("start"), fn.segment_stop(F.col("segs")).alias("stop"))


@query("FN-07_cluster_key", """SELECT p_brand, CASE WHEN count(*) = 1 THEN any_value(CAST(p_partkey AS VARCHAR))
ELSE 'n0de_' || md5(string_agg(CAST(p_partkey AS VARCHAR), '' ORDER BY p_partkey)) END AS key FROM part GROUP BY p_brand""")
def _(spark, d):
    ids = F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string"))
    return read(spark, d, "part").groupBy("p_brand").agg(ids.alias("ids")).select("p_brand", fn.cluster_key(F.col("ids")).alias("key"))


@query("FN-08_natural_key", """SELECT name, row_number() OVER (ORDER BY o, h, t, n, name) AS place FROM (SELECT DISTINCT name,
CASE WHEN regexp_full_match(name, '[^0-9]*[0-9]+[^0-9]*') THEN 0 ELSE 1 END AS o,
CASE WHEN regexp_full_match(name, '[^0-9]*[0-9]+[^0-9]*') THEN regexp_extract(name, '^([^0-9]*)', 1) ELSE name END AS h,
CASE WHEN regexp_full_match(name, '[^0-9]*[0-9]+[^0-9]*') THEN regexp_extract(name, '([^0-9]*)$', 1) ELSE '' END AS t,
CASE WHEN regexp_full_match(name, '[^0-9]*[0-9]+[^0-9]*') THEN CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT) END AS n
FROM (SELECT lower(o_orderstatus) || '_' || o_custkey AS name FROM orders UNION ALL SELECT o_orderpriority FROM orders))""")
def _(spark, d):
    from dendrospark.operators.windows import dense_rank_over_all

    o = read(spark, d, "orders")
    names = o.select(F.concat_ws("_", F.lower("o_orderstatus"), F.col("o_custkey").cast("string")).alias("name")).union(o.select("o_orderpriority")).distinct()
    return dense_rank_over_all(names, [fn.natural_key(F.col("name"))], "place").select("name", "place")


@query("FN-09_combine_members", """SELECT o_custkey, string_agg('c' || k, ',' ORDER BY k) AS simple, string_agg('c' || k, ',' ORDER BY s DESC, k) AS tree
FROM (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS s FROM orders) GROUP BY o_custkey""")
def _(spark, d):
    own = lambda x: F.transform(F.array_sort(F.collect_list(F.when(x, F.col("o_orderkey")))), lambda k: F.concat(F.lit("c"), k.cast("string")))
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(own(F.col("o_orderstatus") == "O").alias("a"), own(F.col("o_orderstatus") != "O").alias("b"))
    join = lambda how: F.array_join(fn.combine_members(F.col("a"), F.col("b"), how), ",")
    return rows.select("o_custkey", join("simple").alias("simple"), join("tree").alias("tree"))


@query("FN-10_score_window", """SELECT l_orderkey, l_linenumber, CAST('1e' || CAST(CAST(ceil(log10(s) / 10) AS INT) * 10 AS VARCHAR) AS DOUBLE) AS ceiling,
CAST('1e' || CAST(CAST(floor(log10(s) / 10) AS INT) * 10 AS VARCHAR) AS DOUBLE) AS floor
FROM (SELECT l_orderkey, l_linenumber, (l_discount + 0.001) / pow(l_extendedprice, 4) AS s FROM lineitem)""")
def _(spark, d):
    s = (F.col("l_discount") + 0.001) / F.pow("l_extendedprice", F.lit(4))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.score_window(s).alias("ceiling"), fn.score_window(s, up=False).alias("floor"))


@query("FN-11_score_clamp", """SELECT l_orderkey, l_linenumber, greatest(CASE WHEN l_tax = 0 THEN 0 ELSE l_discount END, 1e-300) AS clamped,
CASE WHEN l_tax = 0 THEN 100000000.0 ELSE l_discount END AS written FROM lineitem""")
def _(spark, d):
    zero = F.when(F.col("l_tax") == 0, F.lit(0.0)).otherwise(F.col("l_discount"))
    lost = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_discount"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.score_clamp(zero).alias("clamped"), fn.score_out(lost).alias("written"))


@query("FN-12_log10_nonzero", "SELECT p_partkey, round(CASE WHEN p_size = 1 THEN 1 ELSE log10(p_size) END, 9) AS x FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(fn.log10_nonzero(F.col("p_size").cast("double")), 9).alias("x"))


@query("FN-13_ec_normalise", """WITH e AS (SELECT l_orderkey, l_linenumber % 3 + 1 || '.' || l_suppkey % 7 || '.' ||
  CASE WHEN l_partkey % 5 = 0 THEN '-' ELSE CAST(l_partkey % 5 AS VARCHAR) END || CASE WHEN l_partkey % 4 = 0 THEN '' ELSE '.' || l_partkey % 4 END AS ec FROM lineitem),
n AS (SELECT l_orderkey, count(DISTINCT ec) AS n FROM e GROUP BY ALL)
SELECT l_orderkey, coalesce(string_agg(DISTINCT ec, ';' ORDER BY ec) FILTER (WHERE n <= 3 AND len(string_split(ec, '.')) >= 4 AND NOT contains(ec, '-')), '') AS ecs
FROM e JOIN n USING (l_orderkey) GROUP BY l_orderkey""")
def _(spark, d):
    t = lambda c: c.cast("string")
    p = F.col("l_partkey")
    ec = F.concat(
        F.concat_ws(".", t(F.col("l_linenumber") % 3 + 1), t(F.col("l_suppkey") % 7), F.when(p % 5 == 0, F.lit("-")).otherwise(t(p % 5))),
        F.when(p % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("."), t(p % 4))),
    )
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(ec).alias("ecs"))
    return rows.select("l_orderkey", fn.terms_text(fn.ec_normalise(F.col("ecs"), most=3)).alias("ecs"))


@query("FN-14_term_list_codec", "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS terms, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def _(spark, d):
    rows = read(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t")).select("user_id", fn.terms_text(F.col("t")).alias("terms"))
    return rows.select("user_id", "terms", F.size(fn.text_terms(F.col("terms"))).cast("long").alias("n"))


@query("FN-16_mda_string", """SELECT conv_id, string_agg(coalesce(role, 'unknown'), '-' ORDER BY turn, role) AS mda FROM conversations GROUP BY conv_id""")
def _(spark, d):
    from dendrospark.operators.aggregates import composition

    return composition(read(spark, d, "conversations"), "conv_id", "turn", "role", "mda")


@query("FN-17_hypergeom_pmf", """WITH c AS (SELECT p_type, p_brand, count(*) AS i FROM part GROUP BY ALL), t AS (SELECT p_type, count(*) AS draws FROM part GROUP BY ALL),
b AS (SELECT p_brand, count(*) AS m FROM part GROUP BY ALL), n AS (SELECT count(*) AS n FROM part)
SELECT p_type, p_brand, round(exp(lgamma(m+1)-lgamma(i+1)-lgamma(m-i+1) + lgamma(n-m+1)-lgamma(draws-i+1)-lgamma(n-m-draws+i+1) - lgamma(n+1)+lgamma(draws+1)+lgamma(n-draws+1)), 5) AS p
FROM c JOIN t USING (p_type) JOIN b USING (p_brand), n""")
def _(spark, d):
    part = read(spark, d, "part")
    n = part.agg(F.count("*").alias("n"))
    both = part.groupBy("p_type", "p_brand").agg(F.count("*").alias("i"))
    both = both.join(part.groupBy("p_type").agg(F.count("*").alias("draws")), "p_type").join(part.groupBy("p_brand").agg(F.count("*").alias("m")), "p_brand")
    both = both.join(F.broadcast(n))  # one row
    c = {x: F.col(x).cast("double") for x in ("i", "draws", "m", "n")}
    return both.select("p_type", "p_brand", F.round(fn.hypergeom_pmf(c["m"], c["n"] - c["m"], c["draws"], c["i"]), 5).alias("p"))


@query("FN-18_gap_percentage", """SELECT p_brand, round(100.0 * sum(length(s) - length(replace(replace(s, '-', ''), '.', ''))) / sum(length(s)), 1) AS gaps
FROM (SELECT p_brand, translate(p_name, 'ae', '-.') AS s FROM part) GROUP BY p_brand""")
def _(spark, d):
    s = F.translate("p_name", "ae", "-.")
    return read(spark, d, "part").groupBy("p_brand").agg(F.round(100.0 * F.sum(fn.gap_letters(s)) / F.sum(F.length(s)), 1).alias("gaps"))


@query("FN-19_ungap", "SELECT p_partkey, replace(translate(p_name, 'ae', '--'), '-', '') AS s FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", fn.ungap(F.translate("p_name", "ae", "--")).alias("s"))


@query("FN-20_domain_id_build", """SELECT p_partkey, md5(p_name) || '/' || '1-' || p_size || '_' || (p_size + 5) || '-' || (p_size + 9) AS domain,
'1-' || p_size || '_' || (p_size + 5) || '-' || (p_size + 9) AS tail, p_brand || '-ff-' || p_size AS family FROM part""")
def _(spark, d):
    size = lambda n: (F.col("p_size") + n).cast("string")
    segs = F.concat(F.lit("1-"), size(0), F.lit(","), size(5), F.lit("-"), size(9))
    dom = fn.domain_id(F.md5(F.col("p_name").cast("binary")), segs)
    return read(spark, d, "part").select("p_partkey", dom.alias("domain"), fn.id_tail(dom).alias("tail"), fn.family_id(F.col("p_brand"), F.col("p_size")).alias("family"))


@query("FN-21_hierarchy_prefix", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber || '.' || CAST(l_quantity AS INTEGER) || '.' || l_suppkey LIKE '2.10.%'""")
def _(spark, d):
    node = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string"))
    return read(spark, d, "lineitem").where(fn.hierarchy_match(node, "2.10")).select("l_orderkey", "l_linenumber")


@query("FN-22_canonical_pair", "SELECT least(l_partkey, l_suppkey) AS id1, greatest(l_partkey, l_suppkey) AS id2, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    a, b = fn.canonical_pair(F.col("l_partkey"), F.col("l_suppkey"))
    return read(spark, d, "lineitem").groupBy(a.alias("id1"), b.alias("id2")).agg(F.count("*").alias("n"))


@query("FN-23_overlap_coverage", """SELECT l_orderkey, l_linenumber, round(100.0 * l_quantity / greatest(p_size + 50, l_linenumber + 50), 6) AS overlap,
round(least(l_quantity / (p_size + 50), l_quantity / (l_linenumber + 50)), 6) AS coverage FROM lineitem JOIN part ON p_partkey = l_partkey""")
def _(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    a, x, y = F.col("l_quantity"), F.col("p_size") + 50, F.col("l_linenumber") + 50
    return rows.select("l_orderkey", "l_linenumber", F.round(fn.overlap_percent(a, x, y), 6).alias("overlap"), F.round(fn.coverage(a, x, y), 6).alias("coverage"))


@query("FN-24_euclidean_distance", """SELECT a.vec_id AS id1, b.vec_id AS id2, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))), 6) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, d):
    e = read(spark, d, "embeddings")
    a, b = (e.select(F.col("vec_id").alias(f"id{i}"), F.col("embedding").alias(f"v{i}")) for i in (1, 2))
    return a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", F.round(fn.euclidean(F.col("v1"), F.col("v2")), 6).alias("dist"))


@query("FN-25_inverse_bits", """WITH h AS (SELECT l_suppkey AS q, l_partkey % 100 + 1 AS t, max(l_extendedprice) AS bits FROM lineitem GROUP BY ALL)
SELECT f.q, f.t, round(CASE WHEN f.q = f.t THEN 0 ELSE coalesce(1 / CASE WHEN f.bits > 40000 THEN f.bits END, 1 / r.bits, 0.02) END, 9) AS dist
FROM h f LEFT JOIN h r ON r.q = f.t AND r.t = f.q""")
def _(spark, d):
    h = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("q"), (F.col("l_partkey") % 100 + 1).alias("t")).agg(F.max("l_extendedprice").alias("bits"))
    r = h.select(F.col("q").alias("t"), F.col("t").alias("q"), F.col("bits").alias("rev"))
    dist = fn.inverse_bits(F.when(F.col("bits") > 40000, F.col("bits")), F.col("rev"), F.col("q") == F.col("t"))
    return h.join(r, ["q", "t"], "left").select("q", "t", F.round(dist, 9).alias("dist"))


@query("FN-26_protein_name_clean", r"""SELECT p_partkey, substr(trim(regexp_replace(name, '^(protein|possible|predicted|probable|putative)', '', 'i')), 1, 50) || ' -like domain' AS name
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'putative ' WHEN 1 THEN 'Novel ' ELSE '' END || p_name AS name FROM part)
WHERE NOT regexp_matches(name, '(\:|\_|\||--|-like|conserved|superfamily|domain|containing|expressed|clone|bifunct|trifunct|fragment|isoform|chromosome|genomic|partially|confirmed|similar|predicted protein|putative unchara|^unchara|unknown|novel|homolog)', 'i')
AND trim(regexp_replace(name, '^(protein|possible|predicted|probable|putative)', '', 'i')) <> ''""")
def _(spark, d):
    kind = F.when(F.col("p_size") % 3 == 0, F.lit("putative ")).when(F.col("p_size") % 3 == 1, F.lit("Novel ")).otherwise(F.lit(""))
    return read(spark, d, "part").select("p_partkey", fn.clean_name(F.concat(kind, F.col("p_name"))).alias("name")).where("name is not null")


@query("FN-27_score_rounding", "SELECT o_orderkey, CAST(printf('%.2e', o_totalprice) AS DOUBLE) AS score, round(o_totalprice / 7, 2) AS branch FROM orders")
def _(spark, d):
    return read(spark, d, "orders").select("o_orderkey", fn.three_digits(F.col("o_totalprice")).alias("score"), F.round(F.col("o_totalprice") / 7, 2).alias("branch"))


@query("FN-28_array_set_ops", """WITH s AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS a, list_distinct(list(l_linestatus || 'x')) AS x,
  list_distinct(list(CASE WHEN l_quantity > 25 THEN l_returnflag ELSE 'R' END)) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(list_filter(a, lambda v: NOT list_contains(b, v))) = 0 AS subset, array_to_string(list_sort(list_intersect(a, b)), ',') AS common,
array_to_string(list_sort(list_concat(list_filter(a, lambda v: NOT list_contains(b, v)), list_filter(b, lambda v: NOT list_contains(a, v)))), ',') AS single,
array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both FROM s""")
def _(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("a"), F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise(F.lit("R"))).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    text = lambda x: F.array_join(x, ",")
    return rows.select("l_orderkey", fn.is_subset(a, b).alias("subset"), text(F.array_sort(F.array_intersect(a, b))).alias("common"), text(fn.exclusive(a, b)).alias("single"), text(fn.sorted_union(a, b)).alias("both"))


@query("FN-29_mean_pool", """SELECT label, i AS dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL""")
def _(spark, d):
    from dendrospark.operators.aggregates import mean_pool

    pooled = mean_pool(read(spark, d, "embeddings"), "label", "embedding", "v")
    return pooled.select("label", F.posexplode("v").alias("dim", "mean")).select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"))


@query("FN-30_length_spread", "SELECT p_brand, round(100.0 * max(length(p_name)) / min(length(p_name)), 6) AS spread FROM part GROUP BY p_brand")
def _(spark, d):
    from dendrospark.operators.aggregates import length_spread

    n = F.length("p_name")
    return length_spread(read(spark, d, "part"), "p_brand", n)


QUERIES, ORACLE = query.queries, query.sql
