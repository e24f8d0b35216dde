"""Columns made of columns: headers, segments, ids, scores and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:int,stop:int>>"
#: Stand-ins for a missing score, each applied only where rows leave the library.
REALLY_BAD, MISSING_MEAN, SCORE_FLOOR = 100_000_000.0, 1e10, 1e-300


# headers and ids ------------------------------------------------------------------------


def split_header(header: Column) -> Column:
    """The parts, between slashes, of a header's first word."""
    return F.split(F.substring_index(header, " ", 1), "/")


def trunc_header(header: Column) -> Column:
    return F.get(split_header(header), F.lit(0))


def domain_id(accession: Column, segments: Column) -> Column:
    return F.concat(accession, F.lit("/"), F.translate(segments, ",", "_"))


def id_tail(name: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(name, "/", -1)


def family_id(family: Column, number: Column) -> Column:
    return F.concat(family, F.lit("-ff-"), number.cast("string"))


def cluster_key(members: Column, kind: str = "n0de") -> Column:
    """One member: its own id. More: a digest of all ids in their order. None: an error."""
    many = F.concat(F.lit(f"{kind}_"), F.md5(F.array_join(members, "").cast("binary")))
    return (
        F.when(F.size(members) == 1, F.get(members, F.lit(0)))
        .when(F.size(members) > 1, many)
        .otherwise(F.raise_error(F.lit("a cluster needs a member")).cast("string"))
    )


def natural_key(name: Column) -> Column:
    """Sorts ids with a single run of digits by prefix, suffix and number, and before all others."""
    one = name.rlike(r"^\D*\d+\D*$")
    number = F.regexp_extract(name, r"(\d+)", 1).cast("decimal(38,0)")
    return F.struct(
        (~one).cast("int").alias("other"),
        F.when(one, F.regexp_extract(name, r"^(\D*)", 1)).otherwise(name).alias("head"),
        F.when(one, F.regexp_extract(name, r"(\D*)$", 1)).otherwise(F.lit("")).alias("tail"),
        F.when(one, number).alias("number"),
        name.alias("name"),
    )


def natural_sorted(names: Column) -> Column:
    return F.transform(F.array_sort(F.transform(names, natural_key)), lambda k: k["name"])


def combine_members(a: Column, b: Column, ordering: str = "simple") -> Column:
    """``tree``: those of a, then those of b. ``simple``: all in natural order."""
    both = F.concat(a, b)
    return both if ordering == "tree" else natural_sorted(both)


def hierarchy_match(node: Column, prefix: str) -> Column:
    """Nodes at or below a dotted prefix of one to four numbers."""
    import re

    if not re.fullmatch(r"\d+(\.\d+){0,3}", prefix):
        raise ValueError(f"not a hierarchy node: {prefix}")
    return (node == prefix) | node.startswith(prefix + ".")


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


# segments -------------------------------------------------------------------------------


def parse_segments(text: Column) -> Column:
    """``10-20_30-40`` (or with commas) as an array of structs; anything else is an error."""
    good = text.rlike(r"^\d+-\d+([,_]\d+-\d+)*$")
    parts = F.transform(
        F.split(text, "[,_]"),
        lambda s: F.struct(
            F.substring_index(s, "-", 1).cast("int").alias("start"), F.substring_index(s, "-", -1).cast("int").alias("stop")
        ),
    )
    return F.when(text.isNull() | good, parts).otherwise(F.raise_error(F.concat(F.lit("not segments: "), text)).cast(SEGMENTS))


def render_segments(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: F.concat_ws("-", s["start"], s["stop"])), "_")


def merge_segments(segments: Column, max_gap: int = 10) -> Column:
    """Sorted by start; neighbours that are less than ``max_gap`` apart become one."""

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        near = (F.size(done) > 0) & (s["start"] - last["stop"] < max_gap)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(near, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    first = F.slice(F.array_sort(segments), 1, 1)
    rest = F.slice(F.array_sort(segments), F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.when(F.size(segments) > 0, F.aggregate(rest, first, add)).otherwise(segments)


def chop_sequence(sequence: Column, segments: Column) -> Column:
    """The segments' letters (1-based, both ends in), joined; an error if the sequence is too short for them."""
    size = F.aggregate(segments, F.lit(0), lambda n, s: n + s["stop"] - s["start"] + 1)
    cut = F.array_join(F.transform(segments, lambda s: F.substring(sequence, s["start"], s["stop"] - s["start"] + 1)), "")
    return F.when(F.length(cut) == size, cut).otherwise(F.raise_error(F.lit("segments reach beyond the sequence")).cast("string"))


def segment_start(segments: Column) -> Column:
    return F.get(segments, F.lit(0))["start"]


def segment_stop(segments: Column) -> Column:
    return F.get(segments, F.size(segments) - 1)["stop"]


# scores ---------------------------------------------------------------------------------


def score_window(score: Column, up: bool = True, base: int = 10) -> Column:
    """The ceiling (or floor) power of 10**base of a score; null for scores that are not positive."""
    power = F.log10(score) / base
    whole = (F.ceil(power) if up else F.floor(power)) * base
    return F.when(score > 0, F.concat(F.lit("1e"), whole.cast("string")).cast("double"))


def score_clamp(score: Column) -> Column:
    return F.greatest(score, F.lit(SCORE_FLOOR))


def score_out(score: Column) -> Column:
    """As written to a tree file: what is missing or infinite is very bad."""
    return F.when(score.isNull() | (score == float("inf")), F.lit(REALLY_BAD)).otherwise(score)


def log10_nonzero(x: Column) -> Column:
    """log10, with 1 in place of 0, for use as a divisor."""
    return F.when(F.log10(x) == 0, F.lit(1.0)).otherwise(F.log10(x))


def three_digits(score: Column) -> Column:
    """Rounded to three digits as C's ``%.2e`` does: by the number's exact binary value, halves to the even digit (the JVM's formats round halves of printed digits)."""

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        return pd.Series([float(f"{v:.2e}") for v in x.tolist()], dtype="float64")

    return F.when(score.isNotNull(), rounded(score.cast("double")))


def overlap_percent(aligned: Column, len1: Column, len2: Column) -> Column:
    return 100.0 * aligned / F.greatest(len1, len2)


def coverage(aligned: Column, query_len: Column, target_len: Column) -> Column:
    return F.least(aligned / query_len, aligned / target_len)


def inverse_bits(forward: Column, reverse: Column, same: Column, missing: float = 0.02) -> Column:
    """A distance from bit scores: 0 to itself, else from the hit, else from the reverse hit."""
    return F.when(same, F.lit(0.0)).otherwise(F.coalesce(1.0 / forward, 1.0 / reverse, F.lit(missing)))


# The coefficients of Lanczos' series for the gamma function with six terms and g = 5, as published (Lanczos 1964; Numerical Recipes, section 6.1).
_LANCZOS = (76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5)


def log_gamma(x: Column) -> Column:
    """Lanczos' six-term series."""
    series = F.lit(1.000000000190015)
    for i, c in enumerate(_LANCZOS):
        series = series + F.lit(c) / (x + (i + 1))
    t = x + 5.5
    return (x + 0.5) * F.log(t) - t + F.log(F.lit(2.5066282746310005) * series / x)


def _log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def hypergeom_pmf(marked: Column, others: Column, draws: Column, hits: Column) -> Column:
    """Chance of ``hits`` marked among ``draws`` from ``marked + others``; 0 where that can't be."""
    possible = (hits >= 0) & (hits <= marked) & (hits <= draws) & (draws - hits <= others)
    p = F.exp(_log_choose(marked, hits) + _log_choose(others, draws - hits) - _log_choose(marked + others, draws))
    return F.when(possible, p).otherwise(F.lit(0.0))


# sequences ------------------------------------------------------------------------------


def ungap(sequence: Column) -> Column:
    return F.replace(sequence, F.lit("-"), F.lit(""))


def gap_letters(sequence: Column) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, "-.", ""))


#: Names with one of these are not used; of names that begin with one, the rest is.
NAME_EXCLUDE = (
    r"(?i)(\:|\_|\||--|-like|conserved|superfamily|domain|containing|expressed|clone|bifunct|trifunct|fragment|isoform|chromosome|genomic|"
    r"partially|confirmed|similar|predicted protein|putative unchara|^unchara|unknown|novel|homolog)"
)
NAME_TRUNCATE = r"(?i)^(protein|possible|predicted|probable|putative)"
NAME_LENGTH, NAME_SUFFIX = 50, " -like domain"


def clean_name(name: Column) -> Column:
    """A family's name from a protein's, or null."""
    cut = F.substring(F.trim(F.regexp_replace(name, NAME_TRUNCATE, "")), 1, NAME_LENGTH)
    return F.when(~name.rlike(NAME_EXCLUDE) & (cut != ""), F.concat(cut, F.lit(NAME_SUFFIX)))


# terms ----------------------------------------------------------------------------------


def ec_normalise(ecs: Column, most: int = 1, least_digits: int = 4, most_digits: int = 4, forbidden: str = "-") -> Column:
    """Sorted EC numbers: none if there are too many, without short or open ones, cut to ``most_digits``."""
    kept = F.filter(ecs, lambda e: (F.size(F.split(e, r"\.")) >= least_digits) & ~F.contains(e, F.lit(forbidden)))
    cut = F.array_sort(F.array_distinct(F.transform(kept, lambda e: F.array_join(F.slice(F.split(e, r"\."), 1, most_digits), "."))))
    return F.when(F.size(ecs) <= most, cut).otherwise(F.array().cast("array<string>"))


def terms_text(terms: Column) -> Column:
    return F.array_join(terms, ";")


def text_terms(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ";"))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def sorted_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def exclusive(a: Column, b: Column) -> Column:
    """In one of them only."""
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


# vectors --------------------------------------------------------------------------------


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))

