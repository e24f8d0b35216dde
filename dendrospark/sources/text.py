"""Text formats as DataFrames: sequences, cluster listings, scores, hits, annotations and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dendrospark.functions import scalar as fn
from dendrospark.operators.storage import kept


def _stem() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)


def read_fasta(spark: SparkSession, path: str, order: bool = False, folders: tuple[str, ...] = ()) -> DataFrame:
    """file, seq_id (the header's first word), description, sequence (its lines joined). A record begins with ``>`` at a line's start.

    ``order``: a column ``at`` too, by which the records of a file sort as they stand in it. ``folders``: columns by which ``write_fasta`` parted the records.
    """
    rows = spark.read.option("lineSep", "\n>").text(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("n"))
    rows = rows.select(F.regexp_replace("value", r"^\s*>", "").alias("value"), _stem().alias("file"), *folders, *[at.alias("at")] * order).where(F.trim("value") != "")
    head = F.regexp_replace(F.regexp_extract("value", r"^([^\r\n]*)", 1), r"\s+$", "")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "")
    seq_id = F.regexp_extract(head, r"^(\S*)", 1)
    return rows.select("file", seq_id.alias("seq_id"), F.regexp_replace(head, r"^\S*\s*", "").alias("description"), body.alias("sequence"), *folders, *["at"] * order)


def last_records(records: DataFrame) -> DataFrame:
    """Of records with equal seq_id (read with ``order``), the last."""
    own = F.max_by(F.struct("file", "description", "sequence"), "at").alias("r")
    return records.groupBy("seq_id").agg(own).select("r.file", "seq_id", "r.description", "r.sequence")


def write_fasta(rows: DataFrame, path: str, *partition: str) -> None:
    """Records of seq_id, description (may be null) and sequence; a folder for each value of ``partition``."""
    head = F.concat(F.lit(">"), "seq_id", F.coalesce(F.concat(F.lit(" "), F.when(F.col("description") != "", F.col("description"))), F.lit("")))
    out = rows.select(*partition, F.concat(head, F.lit("\n"), "sequence").alias("value")).write
    (out.partitionBy(*partition) if partition else out).text(path)


def fasta_to_csv(records: DataFrame, path: str) -> None:
    records.select(F.col("seq_id").alias("label"), "sequence").write.option("header", True).csv(path)


def pfam_rows(records: DataFrame) -> DataFrame:
    """acc, bounds, family of headers ``acc/bounds ... family;``"""
    family = F.regexp_replace(F.regexp_extract("description", r"(\S+)$", 1), ";", "")
    return records.select(fn.trunc_header(F.col("seq_id")).alias("acc"), fn.id_tail(F.col("seq_id")).alias("bounds"), family.alias("family"), "sequence")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster, member, is_center of a listing of ``>Cluster`` blocks with numbered members, ``*`` on the centre."""
    blocks = spark.read.option("lineSep", ">Cluster ").text(path).where(F.trim("value") != "")
    lines = blocks.select(F.substring_index("value", "\n", 1).alias("cluster"), F.explode(F.split("value", "\n")).alias("line"))
    member = F.regexp_replace(F.regexp_extract("line", r">(\S+)", 1), r"\.+$", "")
    return lines.select("cluster", member.alias("member"), F.col("line").rlike(r"\*\s*$").alias("is_center")).where("member <> ''")


SCORES = T.StructType([T.StructField("id1", T.StringType()), T.StructField("id2", T.StringType()), T.StructField("score", T.DoubleType())])


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Triples apart by white space of any kind; a line that isn't one is an error, and so is an empty or missing file. ``path`` may hold wildcards.

    The part files that a job writes into a folder are one file in this: a partition without rows leaves an empty one.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    met = store.globStatus(where)
    if not met:
        raise ValueError(f"no scores at {path}")
    names = []
    for top in met:
        folder = top.isDirectory()
        files = [f for f in (store.listStatus(top.getPath()) if folder else [top]) if not f.isDirectory() and f.getPath().getName()[0] not in "_."]
        parts = [f for f in files if folder and f.getPath().getName().startswith("part-")]
        some = any(f.getLen() for f in parts)
        names += [str(f.getPath()) for f in files if f.getLen() == 0 and not (some and f in parts)]
    if names:
        raise ValueError(f"no scores in {names}")
    c = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    number = F.try_element_at(c, F.lit(3)).try_cast("double")
    good = (F.size(c) == 3) & number.isNotNull()
    wrong = F.raise_error(F.concat(F.lit("not a score: "), F.col("value")))
    return spark.read.text(path).select(F.when(good, c[0]).otherwise(wrong.cast("string")).alias("id1"), c[1].alias("id2"), F.when(good, number).otherwise(wrong.cast("double")).alias("score"))


def missing_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """The expected pairs (id1, id2) that have no score, in either order."""
    have = scores.select(F.least("id1", "id2").alias("_a"), F.greatest("id1", "id2").alias("_b"))
    return pairs.join(have, (F.least("id1", "id2") == F.col("_a")) & (F.greatest("id1", "id2") == F.col("_b")), "left_anti")


def write_scores(scores: DataFrame, path: str, sep: str = "\t") -> None:
    scores.select("id1", "id2", "score").write.csv(path, sep=sep)


def read_profile_hits(spark: SparkSession, path: str) -> DataFrame:
    """query, match, evalue of search reports: eleven columns from the line ``No Hit`` to a blank one; best e-value of each pair.

    A report is read by lines, by as many tasks as its size asks for: where its block begins and ends are two least places of its lines.
    """
    lines = spark.read.text(path).withColumns({"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start"), "m": F.monotonically_increasing_id()})
    lines = kept(lines.select("file", F.struct("start", "m").alias("at"), "value"), "lines")
    name = F.regexp_extract("value", r"^Query\s+(\S+)", 1)
    begins, blank = F.col("value").rlike(r"^\s*No Hit"), ~F.col("value").rlike(r"\S")
    heads = lines.where(F.col("value").rlike(r"^Query\s+\S") | begins).groupBy("file")
    heads = kept(heads.agg(F.min_by(name, F.when(name != "", F.col("at"))).alias("query"), F.min(F.when(begins, F.col("at"))).alias("begin")).where("begin IS NOT NULL"), "heads")
    after = lines.where(blank).join(heads, "file").where(F.col("at") > F.col("begin"))
    blocks = kept(heads.join(after.groupBy("file").agg(F.min("at").alias("end")), "file", "left"), "blocks")
    rows = lines.where(~blank).join(blocks, "file").where((F.col("at") > F.col("begin")) & (F.col("end").isNull() | (F.col("at") < F.col("end"))))
    c = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    good = F.when(F.size(c) >= 11, c).otherwise(F.raise_error(F.concat(F.lit("not a hit: "), F.col("value"))).cast("array<string>"))
    hits = rows.select(F.coalesce("query", F.lit("")).alias("query"), good.alias("c")).select("query", F.col("c")[1].alias("match"), F.col("c")[3].cast("double").alias("evalue"))
    return hits.groupBy("query", "match").agg(F.min("evalue").alias("evalue"))


def read_compass(spark: SparkSession, path: str) -> DataFrame:
    """id1, id2, evalue of two-line records; those not found are dropped."""
    rows = spark.read.option("lineSep", "Ali1:").text(path).where(F.trim("value") != "")
    e = F.regexp_extract("value", r"Evalue\s*=\s*(\S+)", 1)
    return rows.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("id1"), F.regexp_extract("value", r"Ali2:\s*(\S+)", 1).alias("id2"), F.when(e != "", e.cast("double")).alias("evalue")).where("evalue is not null")


HITS = {
    "structure": "query string, target string, qlen int, tlen int, alnlen int, bits double",
    "blast": "query string, target string, identity double, alnlen int, evalue double, bits double",
}


def read_hits(spark: SparkSession, path: str, kind: str = "structure", header_lines: str = "#") -> DataFrame:
    return spark.read.option("mode", "FAILFAST").schema(HITS[kind]).csv(path, sep="\t", comment=header_lines)


def read_gaf(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Association rows by position; ``!`` begins a comment. ``header``: the first line that isn't a comment is dropped in each file, as a row of names."""
    rows = spark.read.schema(", ".join(f"_c{i} string" for i in range(17))).csv(path, sep="\t", comment="!", header=header, enforceSchema=True)
    names = {0: "db", 1: "acc", 3: "qualifier", 4: "term", 5: "source", 6: "evidence", 7: "ec", 9: "name", 12: "taxon"}
    return rows.select(*[F.col(f"_c{i}").alias(n) for i, n in names.items() if f"_c{i}" in rows.columns])


def read_obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """terms (term, name, type F, P or C) and edges (child, parent) of OBO-XML; an obsolete term has neither name nor parents."""
    rows = spark.read.option("lineSep", "<term>").text(path).where(F.col("value").contains("</term>"))
    own = rows.select(
        F.regexp_extract("value", r"<id>([^<]+)</id>", 1).alias("term"),
        F.regexp_extract("value", r"<name>([^<]+)</name>", 1).alias("name"),
        F.upper(F.regexp_extract("value", r"<namespace>[^<]*_([fpc])", 1)).alias("type"),
        F.regexp_extract_all("value", F.lit(r"<is_a>([^<]+)</is_a>"), 1).alias("parents"),
        F.col("value").contains("<is_obsolete>1</is_obsolete>").alias("obsolete"),
    )
    terms = own.select("term", F.when(~F.col("obsolete"), F.col("name")).alias("name"), "type")
    return terms, own.where("not obsolete").select(F.col("term").alias("child"), F.explode("parents").alias("parent"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """taxon, name, parent; short rows and the header are skipped; -1 is everything."""
    rows = spark.read.csv(path, sep="\t")
    rows = rows.where(F.col("_c0").rlike(r"^\d+$") & F.col("_c9").isNotNull()).select(F.col("_c0").cast("long").alias("taxon"), F.col("_c2").alias("name"), F.col("_c9").cast("long").alias("parent"))
    return rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("taxon"), F.lit("all").alias("name"), F.lit(None).cast("long").alias("parent")))


def read_keyed_lists(spark: SparkSession, path: str, sep: str = "\t", inner: str = ";") -> DataFrame:
    """key and its sorted distinct values over all of its lines."""
    rows = spark.read.text(path).select(F.split("value", sep).alias("c")).where(F.size("c") >= 2)
    return rows.select(F.col("c")[0].alias("key"), F.explode(F.split(F.col("c")[1], inner)).alias("v")).groupBy("key").agg(F.array_sort(F.collect_set("v")).alias("values"))


def write_keyed_lists(rows: DataFrame, path: str, sep: str = "\t", inner: str = ";") -> None:
    rows.select(F.concat_ws(sep, "key", F.array_join("values", inner)).alias("value")).write.text(path)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """The first word of each line; ``#`` lines are comments, other lines without a word are an error."""
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    word = F.regexp_extract("value", r"(\w+)", 1)
    return rows.select(F.when(word != "", word).otherwise(F.raise_error(F.concat(F.lit("no id: "), F.col("value"))).cast("string")).alias("id"))


def embedding_subset(vectors: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Vectors (id, embedding), those of ``names`` (id) only if given: joined by id, never by place."""
    return vectors if names is None else vectors.join(names, "id", "left_semi")


def ec_counts_json(counts: DataFrame, cluster: str, ec: str) -> DataFrame:
    """One JSON text a cluster: its name and its ECs with their counts, in natural order."""
    parts = F.array_sort(F.collect_list(F.struct(fn.natural_key(F.col(ec)).alias("k"), F.col("n"))))
    entries = F.map_from_entries(F.transform(parts, lambda p: F.struct(p["k"]["name"], p["n"])))
    return counts.groupBy(cluster).agg(F.to_json(F.struct(F.first(cluster).alias("cluster_name"), entries.alias("ec_codes"))).alias("json"))


def write_clusters(rows: DataFrame, path: str, key: str, mode: str = "errorifexists", kind: str = "parquet") -> None:
    """A folder for each value of ``key``; ``mode``: append, overwrite or errorifexists."""
    rows.write.partitionBy(key).mode(mode).format(kind).save(path)


def read_rows(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """Separated rows of plain or compressed files (by their names' endings)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path, sep=sep)


def write_term_names(terms: DataFrame, path: str) -> None:
    terms.select("term", "name", "type").write.csv(path, sep="\t")


def read_term_names(spark: SparkSession, path: str, types: str = ".") -> DataFrame:
    """term, name, type of the terms whose type matches ``types``; ``!`` begins a comment."""
    return spark.read.schema("term string, name string, type string").csv(path, sep="\t", comment="!").where(F.col("type").rlike(types))
