"""Benchmark decontamination by a prefix-filtered set join (operator 6).

A window is ``window`` consecutive item words, as a set of shingles. Containing
it means containing all its shingles, so the necessary prefix of a window is
its one rarest shingle, by its count over all documents. Documents are joined on
those shingles; the shingle's place in the window bounds where the window must
begin and end in the document; the words there are then compared exactly.
All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from dendrospark.llm.common import lower_ascii, table, written

WINDOW, SHINGLE = 10, 3
#: Rows of prefix tokens up to which they are sent to every task; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def words_text(text: Column) -> Column:
    """Words in lower case, space-joined; '' where there are none."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def _words(joined: str) -> Column:
    return F.when(F.col(joined) == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def _shingle(words: str, at: Column, n: int) -> Column:
    """Hash of ``n`` words from ``at``; past the end, of fewer."""
    return F.xxhash64(*[F.get(F.col(words), at + i) for i in range(n)])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """Distinct windows: wid, their words, and one row per shingle (place ``t`` in the window)."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_text(F.col("text")).alias("joined"))
    words = words.select("item_id", _words("joined").alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window)))
    cut = words.select("item_id", "w", at.alias("at")).select("item_id", F.slice("w", F.col("at") + 1, window).alias("win"))
    return cut.distinct().withColumn("m", F.size("win"))


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    Items of fewer than ``window`` words are one window of their own length; null or
    wordless texts and items have none. Repeated rows give repeated results;
    a null item_id is the text ''. An empty table of items hits nothing.
    Other columns are not read.
    """
    base = docs.select("doc_id", words_text(F.col("text")).alias("joined"))
    base = written(
        base.select(
            "doc_id", "joined", F.size(_words("joined")).cast("long").alias("n_words"), F.xxhash64("joined").alias("h1"), F.md5("joined").alias("h2")
        ),
        "doc-words",
    )
    wins = written(item_windows(items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit(""))), window, shingle), "item-windows")
    # a window of fewer words than a shingle is hashed with what follows missing, so it gets shingles of its own length
    lengths = [r[0] for r in wins.select(F.least("m", F.lit(shingle)).alias("k")).distinct().collect()]  # at most `shingle` values
    shingled = None
    for k in sorted(lengths):
        own = wins.where(F.least("m", F.lit(shingle)) == k)
        own = own.select(
            "win", "m", F.explode(F.sequence(F.lit(0), F.col("m") - k)).alias("t")
        ).withColumn("token", _shingle("win", F.col("t"), k)).withColumn("k", F.lit(k))
        own = own.distinct()
        shingled = own if shingled is None else shingled.unionByName(own)
    empty_id = F.sha2(F.lit(""), 256)
    if shingled is None:
        return base.select(
            "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty_id.alias("items_sha256"), F.lit(False).alias("contaminated")
        )
    shingled = written(shingled, "item-shingles")
    tokens = shingled.select("token", "k").distinct()
    n_tokens = tokens.count()

    def occurrences(picked: DataFrame) -> DataFrame:
        """Document places whose shingle is among ``picked`` (token, k, ...), with the document's words ``w`` from place ``low`` on.

        Where both sides are shuffled, these are only the words that a window over the place can hold.
        """
        at = base.select("h1", "h2", "n_words", _words("joined").alias("w"))
        out = None
        for k in sorted(lengths):
            places = at.where(F.col("n_words") >= k).select("*", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("p"))
            places = places.withColumn("token", _shingle("w", F.col("p"), k)).withColumn("low", F.lit(0))
            if n_tokens > BROADCAST_ROWS:
                places = places.withColumn("low", F.greatest(F.lit(0), F.col("p") - (window - 1)))
                places = places.withColumn("w", F.slice("w", F.col("low") + 1, 2 * window - 1))
            got = places.join(_small(picked.where(F.col("k") == k).drop("k"), n_tokens), "token")
            out = got if out is None else out.unionByName(got)
        return out

    df_of = occurrences(tokens).groupBy("token").agg(F.count("*").alias("df"))
    ranked = shingled.join(df_of, "token")  # a shingle that no document has rules its windows out
    n_in = W.Window.partitionBy("win")
    full = shingled.groupBy("win").agg(F.countDistinct("token").alias("all_tokens"))
    rare = W.Window.partitionBy("win").orderBy("df", "token", "t")
    prefix = (
        ranked.withColumn("r", F.row_number().over(rare))
        .withColumn("have", F.size(F.collect_set("token").over(n_in)))
        .where("r = 1")
        .join(full, "win")
        .where("have = all_tokens")
        .select("token", "k", "t", "m", "win")
    )
    prefix = written(prefix, "item-prefixes")
    n_tokens = prefix.count()
    start = F.col("p") - F.col("t")
    inside = (start >= 0) & (start + F.col("m") <= F.col("n_words"))  # positional and length bounds
    hits = (
        occurrences(prefix)
        .where(inside)
        .where(F.slice("w", start - F.col("low") + 1, F.col("m")) == F.col("win"))
        .select("h1", "h2", start.alias("s"), (start + F.col("m")).alias("e"), "win")
        .distinct()
    )
    hits = written(hits, "hits")
    key = ["h1", "h2"]  # of the text: copies have the same hits
    before = W.Window.partitionBy(*key).orderBy("s", "e").rowsBetween(W.Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("s"), F.coalesce(F.max("e").over(before), F.lit(0)))
    covered = (
        hits.select(*key, "s", "e")
        .distinct()
        .withColumn("fresh", F.greatest(F.lit(0), F.col("e") - reach))
        .groupBy(*key)
        .agg(F.sum("fresh").cast("long").alias("n_hit"))
    )
    named = (
        hits.join(wins.select("win", "item_id"), "win")
        .select(*key, "item_id")
        .distinct()
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
        .select(*key, F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    return base.drop("joined").join(covered.join(named, key), key, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", empty_id).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words; nulls, wordless rows and repeats as ``contamination`` says."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Words, windows and hits by brute force over the shingle places.
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS m,
    array_to_string(w[s + 1 : s + least(len(w), 10)], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT rid, s, m, array_to_string(w[s + 1 : s + m], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(0, len(w) - m + 1)) AS s FROM d, lens WHERE len(w) >= m)),
hit AS (SELECT DISTINCT rid, s, dw.m AS m, item_id FROM dw JOIN bw USING (win)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS p FROM hit) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE = {"op6_decontamination": SQL}
