"""Mixtures of normals with a Dirichlet-process prior, by variational Bayes: how many modes a column has follows from its values.

Weights come from broken sticks: mode k takes a share a / (a + b) of what the modes before it left. Each round is one aggregate over all
columns: how much each mode answers for each value, under the expectations of its logarithms, and the sums that follow. Values are
counted first, so that a value stands once. The posteriors, a few numbers a mode, are worked out in the driver."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite
from ..functions.tables import melt
from ..sources.scratch import kept
from .encode import mixture_start

#: Modes of a column at most, the weight below which a mode is left out, and the prior of the sticks: fixed values of the method.
MODES, LEAST, STICK = 10, 0.005, 0.001
#: Rounds after which a fit that hasn't settled is given up with a warning, as in the reference.
ROUNDS = 1000
_PARAMS = "column string, mode int, weight double, mean double, std double"


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of ln gamma, for positive x: steps up to 10, then its series."""
    x, down = np.array(x, dtype=float), np.zeros_like(np.asarray(x, dtype=float))
    while (low := x < 10).any():
        down, x = np.where(low, down + 1 / x, down), np.where(low, x + 1, x)
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - down


@dataclass
class Posterior:
    """Of one column's modes: sticks a and b, means with their precision, and variances with their degrees of freedom."""

    a: np.ndarray
    b: np.ndarray
    precision: np.ndarray
    mean: np.ndarray
    freedom: np.ndarray
    variance: np.ndarray

    def weights(self) -> np.ndarray:
        left = np.concatenate([[1.0], np.cumprod(self.b / (self.a + self.b))[:-1]])
        w = self.a / (self.a + self.b) * left
        return w / w.sum()

    def offsets(self) -> np.ndarray:
        """What stands before -(x - mean)**2 / (2 variance) in the expected logarithm of a mode's share, but for a common number."""
        both = digamma(self.a + self.b)
        stick = digamma(self.a) - both + np.concatenate([[0.0], np.cumsum(digamma(self.b) - both)[:-1]])
        spread = math.log(2) + digamma(self.freedom / 2) - np.log(self.freedom) - np.log(self.variance)
        return stick + 0.5 * (spread - 1 / self.precision)


def posterior(n: np.ndarray, x: np.ndarray, xx: np.ndarray, mean: float, variance: float, stick: float = STICK) -> Posterior:
    """From each mode's sums of shares, of shares times values and times squares; mean and variance: the column's, as prior."""
    n = n + 1e-9
    m = np.where(n > 1e-6, x / n, mean)
    s = np.maximum(xx / n - m * m, 0.0) + 1e-6 * variance
    after = np.concatenate([np.cumsum(n[::-1])[-2::-1], [0.0]])
    spread = (variance + n * s + n / (1 + n) * (m - mean) ** 2) / (1 + n)
    return Posterior(1 + n, stick + after, 1 + n, (mean + n * m) / (1 + n), 1 + n, spread)


def counted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n): finite values and how often they stand."""
    return melt(df, cols, convert=finite).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def priors(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """Each column's mean and sample variance."""
    sums = counts.groupBy("column").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("m"))
    gaps = counts.join(F.broadcast(sums.select("column", "m", F.col("n").alias("all"))), "column")  # a row a column
    got = gaps.groupBy("column").agg(F.first("m").alias("m"), (F.sum(F.col("n") * F.pow(F.col("value") - F.col("m"), F.lit(2.0))) / F.greatest(F.first("all") - 1, F.lit(1))).alias("v"))
    return {r["column"]: (r["m"], r["v"] or 1.0) for r in got.collect()}


def dp_round(counts: DataFrame, now: dict[str, Posterior], prior: dict[str, tuple[float, float]]) -> dict[str, Posterior]:
    """One round for all columns. Values are taken from the column's mean, so that squares don't cancel."""
    if not now:
        return {}
    modes = {c: (float(prior[c][0]), p.offsets(), p.mean, 2 * p.variance) for c, p in now.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums of each mode's shares, of shares times values and times squares; a plan as small as this is made fast, and there
        are hundreds of rounds."""
        own: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column("column").dictionary_encode()
            value, n = b.column("value").to_numpy(), b.column("n").to_numpy()
            for i, c in enumerate(names.dictionary.to_pylist()):
                if c in modes:
                    here = np.flatnonzero(names.indices.to_numpy() == i) if len(names.dictionary) > 1 else slice(None)
                    middle, offset, mean, twice = modes[c]
                    log = offset - (value[here, None] - mean) ** 2 / twice
                    share = np.exp(log - log.max(axis=1, keepdims=True))
                    share *= (n[here] / share.sum(axis=1))[:, None]
                    x = value[here] - middle
                    own[c] = own.get(c, 0.0) + np.stack([share.sum(axis=0), x @ share, (x * x) @ share])
        for c, got in own.items():
            k = got.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([c] * k, pa.string()), pa.array(range(k), pa.int32()), *map(pa.array, got)], names=["column", "mode", "n", "x", "xx"])

    parts = counts.select("column", "value", "n").mapInArrow(sums, "column string, mode int, n double, x double, xx double")
    got = {(r["column"], r["mode"]): r for r in parts.groupBy("column", "mode").agg(*[F.sum(q).alias(q) for q in ("n", "x", "xx")]).collect()}
    out = {}
    for c, p in now.items():
        n, x, xx = (np.array([got[c, i][q] for i in range(len(p.a))]) for q in ("n", "x", "xx"))
        out[c] = posterior(n, x, xx, 0.0, prior[c][1])
        out[c].mean = out[c].mean + prior[c][0]
    return out


def modes_table(spark, now: dict[str, Posterior], least: float = LEAST) -> DataFrame:
    """(column, mode, weight, mean, std) of the modes with more weight than `least`, which share their weight anew, by their means."""
    rows = []
    for c, p in sorted(now.items()):
        w = p.weights()
        stay = sorted((m, v, x) for m, v, x in zip(p.mean, p.variance, w, strict=True) if x > least)
        total = sum(x for _, _, x in stay)
        rows += [(c, i, float(x / total), float(m), float(math.sqrt(v))) for i, (m, v, x) in enumerate(stay)]
    return spark.createDataFrame(rows, _PARAMS)


def fit_modes(df: DataFrame, cols: Sequence[str], modes: int = MODES, rounds: int = ROUNDS, epsilon: float = 1e-3, least: float = LEAST) -> DataFrame:
    """(column, mode, weight, mean, std): rounds until no mode that counts moves by more than epsilon of its deviation and no weight by
    more than epsilon. A column without numbers has no modes."""
    counts = kept(counted(df, cols), "counts")
    prior = priors(counts)
    spark = df.sparkSession
    now: dict[str, Posterior] = {}
    for c in prior:
        start = sorted((r["mode"], r["mean"], r["std"]) for r in mixture_start(df, [c], modes).collect())
        n = np.full(len(start), 1.0 / len(start)) * 10
        mean, std = np.array([m for _, m, _ in start]), np.maximum([s for _, _, s in start], 1e-6 * math.sqrt(prior[c][1]))
        now[c] = Posterior(1 + n, STICK + np.concatenate([np.cumsum(n[::-1])[-2::-1], [0.0]]), 1 + n, mean, 1 + n, std * std)
    for _ in range(rounds if now else 0):
        new = dp_round(counts, now, prior)
        moved = 0.0
        for c, p in new.items():
            old, w = now[c].weights(), p.weights()
            stay = np.maximum(old, w) > least
            moved = max(moved, np.abs(w - old).max(), (np.abs(p.mean - now[c].mean) / np.sqrt(p.variance))[stay].max(initial=0.0))
        now = new
        if moved < epsilon:
            break
    else:
        if now:
            warnings.warn(f"the modes of {sorted(now)} have not settled in {rounds} rounds", stacklevel=2)
    return modes_table(spark, now, least)
