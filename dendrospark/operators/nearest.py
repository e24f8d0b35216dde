"""Geometric-mean linkage with a pseudo count: one merge at a time, with a table of each cluster's nearest that merges keep up to date.

That linkage isn't reducible: a merge can bring clusters closer than any two were, so merges of a project can't be made side by side. Projects are; one of at most
ITEMS clusters is one task's matrix, and a merge computes again only the rows whose nearest was merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Clusters of a project that one task holds, as matrices of this size squared (about 100 MB).
ITEMS = 2048


def split_by_size(links: DataFrame, sizes: DataFrame, items: int = ITEMS) -> tuple[DataFrame, DataFrame]:
    """``links`` of the projects with at most ``items`` of ``sizes`` (project, id), and of the others."""
    large = sizes.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") > items).select("project")
    return links.join(large, "project", "left_anti"), links.join(large, "project", "left_semi")


def one_at_a_time(links: DataFrame, pseudo: int, missing: float, threshold: float | None = None) -> DataFrame:
    """The merges (project, id1, id2, score, round) of ``links`` (project, id1, id2, t, n): sums of logs and numbers of scored member pairs.

    Of equal scores the smaller (id1, id2) merges first; a cluster is known by its smallest leaf. Clusters without a scored member pair never merge. All links of a project are one task's.
    """
    log_missing, most = float(np.log10(missing)), np.inf if threshold is None else threshold

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*pdf["id1"].tolist(), *pdf["id2"].tolist()})
        place = {x: i for i, x in enumerate(ids)}
        n = len(ids)
        total, many, size = np.zeros((n, n)), np.zeros((n, n), dtype=np.int32), np.ones(n)
        i, j = (pdf[c].map(place).to_numpy() for c in ("id1", "id2"))
        for a, b in ((i, j), (j, i)):
            np.add.at(total, (a, b), pdf["t"].to_numpy())
            np.add.at(many, (a, b), pdf["n"].to_numpy())

        def scores(k: int) -> np.ndarray:
            pairs = size[k] * size
            with np.errstate(over="ignore"):
                return np.where(many[k] > 0, np.power(10.0, (total[k] + (pairs - many[k]) * log_missing) / (pairs + pseudo)), np.inf)

        score = np.array([scores(k) for k in range(n)])
        score[np.tril_indices(n)] = np.inf  # a pair stands in the row of its smaller place
        nearest = score.argmin(axis=1)
        best, out = score[np.arange(n), nearest], []
        while True:
            a = int(best.argmin())
            b, x = int(nearest[a]), float(best[a])
            if not x < np.inf or x > most:
                break
            out.append((ids[a], ids[b], x, len(out)))
            total[a] += total[b]
            many[a] += many[b]
            total[:, a], many[:, a] = total[a], many[a]
            size[a] += size[b]
            many[b], many[:, b], many[a, a] = 0, 0, 0
            score[b], score[:, b], best[b] = np.inf, np.inf, np.inf
            own = scores(a)
            score[a, a + 1 :], score[:a, a] = own[a + 1 :], own[:a]
            again = np.flatnonzero((nearest == a) | (nearest == b))
            again = np.append(again[best[again] < np.inf], a)
            nearest[again] = score[again].argmin(axis=1)
            best[again] = score[again, nearest[again]]
            low = score[:, a]
            nearer = (low < best) | ((low == best) & (a < nearest) & (low < np.inf))
            nearest[nearer], best[nearer] = a, low[nearer]
        return pd.DataFrame(out, columns=["id1", "id2", "score", "round"]).assign(project=[pdf["project"].iloc[0]] * len(out))[["project", "id1", "id2", "score", "round"]]

    schema = links.select("project", "id1", "id2", F.lit(0.0).alias("score"), F.lit(0).alias("round")).schema
    return links.select("project", "id1", "id2", "t", "n").groupBy("project").applyInPandas(merged, schema)
