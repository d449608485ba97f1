"""A Gaussian copula: rows whose numeric columns keep their distributions and how they go together.

Fitting: each column's normal scores, by the ranks of its distinct values, and their correlations in one aggregate. Drawing: normal
numbers by hashes of the row number, times the correlations' Cholesky factor, then through each column's quantiles: a projection of
a range of numbers, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import finite, hash_u01
from ..functions.tables import melt, quantiles, running_sums
from ..sources.scratch import kept
from .encode import probit

#: Quantiles of a column that values are drawn between.
GRID = [i / 100 for i in range(101)]


@dataclass
class Copula:
    """columns, the lower factor of their scores' correlations, and their quantiles."""

    columns: list[str]
    factor: np.ndarray
    grids: dict[str, list[float]]


#: Distinct values of a column whose scores are broadcast, rows of a task where there are more, and the share of a column, 1 / OFTEN,
#: above which one value's rows are too many for a task.
FEW, TASK_ROWS, OFTEN = 100_000, 1_000_000, 1_000


def normal_scores(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, z0, z1, ...): each column's normal scores, null where it has no number. One pass of ranks serves all columns.

    Rows look their scores up where they are. Only where a column has many values do rows go to their value, in tasks of a bounded number
    of rows; the values that stand often, of which there are few, are looked up in place there too."""
    long = melt(df, cols, convert=finite).where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    middle = F.try_divide(F.col("n_before") + F.col("n") / 2.0, F.col("n_all"))
    ranks = kept(running_sums(counts, ["n"], ["column"], ["value"]).select("column", "value", "n", "n_all", probit(middle).alias("z")), "ranks")
    sizes = {r["column"]: r for r in ranks.groupBy("column").agg(F.count("*").alias("values"), F.max("n_all").alias("n")).collect()}  # a row a column
    rows = df.select(F.col(f"`{key}`").alias("__key"), *[finite(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(cols)])
    for i, c in enumerate(cols):
        own = ranks.where(F.col("column") == c).select(F.col("value").alias(f"v{i}"), F.col("z").alias(f"z{i}"), (F.col("n") * OFTEN > F.col("n_all")).alias("often"))
        if c not in sizes or sizes[c]["values"] <= FEW:
            rows = rows.join(F.broadcast(own.drop("often")), f"v{i}", "left")
            continue
        rows = kept(rows.join(F.broadcast(own.where("often").drop("often")), f"v{i}", "left"), "scores")
        done = F.col(f"z{i}").isNotNull() | F.col(f"v{i}").isNull()
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes[c]["n"] // TASK_ROWS))
        rest, scores = rows.where(~done).drop(f"z{i}").repartition(n, f"v{i}"), own.where("NOT often").drop("often").repartition(n, f"v{i}")
        rows = rows.where(done).unionByName(rest.join(scores.hint("merge"), f"v{i}"))
    return rows.select(F.col("__key").alias(key), *[f"z{i}" for i in range(len(cols))])


def correlations(scores: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The matrix of correlations of columns, each over the rows that have both; 0 where one doesn't vary. One aggregate."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i)]
    both = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a))
    out = np.eye(len(names))
    if pairs:
        got = scores.agg(*[F.corr(both(names[i], names[j]), both(names[j], names[i])).alias(f"r{i}_{j}") for i, j in pairs]).first()
        for i, j in pairs:
            r = got[f"r{i}_{j}"]
            out[i, j] = out[j, i] = 0.0 if r is None or r != r else r
    return out


def factor(matrix: np.ndarray, least: float = 1e-9) -> np.ndarray:
    """The lower Cholesky factor of a matrix of correlations; one that isn't positive (pairs over different rows) is mended first."""
    if len(matrix) and np.linalg.eigvalsh(matrix).min() < least:
        values, vectors = np.linalg.eigh(matrix)
        matrix = vectors @ np.diag(np.maximum(values, least)) @ vectors.T
        d = np.sqrt(np.diag(matrix))
        matrix = matrix / d[:, None] / d[None]
    return np.linalg.cholesky(matrix)


def normals(n: int, id_: Column, seed: int) -> list[Column]:
    """n independent normal numbers for each id, each by two uniform ones."""
    u = lambda i: hash_u01(seed + i, id_)
    return [F.sqrt(-2 * F.ln(F.greatest(u(2 * i), F.lit(1e-12)))) * F.cos(u(2 * i + 1) * 6.283185307179586) for i in range(n)]


def projected(rows: DataFrame, lower: np.ndarray, seed: int, id_: str = "id") -> DataFrame:
    """rows with z0, z1, ...: normal numbers that go together as the factor says."""
    k = len(lower)
    free = rows.withColumns({f"__e{i}": e for i, e in enumerate(normals(k, F.col(id_), seed))})
    mixed = {}
    for i in range(k):
        z = F.lit(float(lower[i][0])) * F.col("__e0")
        for j in range(1, i + 1):
            z = z + F.lit(float(lower[i][j])) * F.col(f"__e{j}")
        mixed[f"z{i}"] = z
    return free.withColumns(mixed).drop(*[f"__e{i}" for i in range(k)])


#: Coefficients of the normal share's approximation (Zelen and Severo), right to 7.5e-8. Fixed values.
_SHARE = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def share(z: Column) -> Column:
    """The share of a normal distribution below z, in built-in functions."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(_SHARE[4])
    for c in _SHARE[3::-1]:
        poly = poly * t + F.lit(c)
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly * t
    return F.when(z > 0, 1 - tail).otherwise(tail)


def at_share(grid: Sequence[float], u: Column) -> Column:
    """The value at a share, between two of evenly spaced quantiles in proportion."""
    values, last = F.array(*[F.lit(float(v)) for v in grid]), len(grid) - 1
    i = F.least(F.floor(u * last).cast("int"), F.lit(last - 1))
    low, high = F.get(values, i), F.get(values, i + 1)
    return low + (high - low) * (u * last - i)


def fit_copula(df: DataFrame, key: str, cols: Sequence[str]) -> Copula:
    """Columns without any number are left out."""
    found = quantiles(melt(df, cols, convert=finite), ["column"], GRID).collect()  # a row a column
    grids = {r["column"]: list(r["quantiles"]) for r in found}
    cols = [c for c in cols if c in grids]
    lower = factor(correlations(normal_scores(df, key, cols), [f"z{i}" for i in range(len(cols))])) if cols else np.zeros((0, 0))
    return Copula(cols, lower, grids)


def copula_rows(spark: SparkSession, fitted: Copula, n: int, seed: int) -> DataFrame:
    """(id, *columns): n rows."""
    z = projected(spark.range(n), fitted.factor, seed)
    return z.select("id", *[at_share(fitted.grids[c], share(F.col(f"z{i}"))).alias(c) for i, c in enumerate(fitted.columns)])
