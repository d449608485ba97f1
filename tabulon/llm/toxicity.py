"""A toxicity score by a factorization machine over hashed terms.

Terms are lower-cased words without outer punctuation, and their beginnings, hashed into a fixed number of inputs; none is chosen
or left out by what it tells alone. Each term of a text has the same value, and the values of a text have length 1. The machine
adds up a weight for each term and the products of their short vectors for each pair of terms, so that an insult beside a mention
of a group can weigh more than the two apart. It is fitted on a bounded sample of the distinct labelled texts, each of which counts
as often as it is labelled; a part of the sample is left out of the fit and sets how sums become scores.

Defined results: null and blank texts score like any text without terms; without labels of both classes every score is 0;
repeated rows repeat; a row labelled twice counts twice; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_small, keep, labels, texts
from .quality import fold

THRESHOLD = 0.7
#: Inputs of the machine (a power of two), texts of either class that it is fitted on (the bound of the sample), factors of a term.
INPUTS, SAMPLE, FACTORS = 1 << 18, 15_000, 8
#: Passes over the sample, and steps at least; step size and decay of the weights.
PASSES, LEAST_STEPS, RATE, DECAY = 8, 300, 0.5, 1e-4
#: Texts in a step, and the share of the sample that sets the scale of scores.
BATCH, APART = 512, 0.2
#: Besides words, their first so many bytes are terms.
BEGINNINGS = (4, 5)
EDGES = re.compile(rb"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$")


class Terms:
    """Inputs of the words of texts and of their beginnings; a task's memory of words starts anew when it is full."""

    def __init__(self, inputs: int = INPUTS, most: int = 300_000):
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.inputs, self.most = inputs, most

    def __call__(self, text: bytes) -> np.ndarray:
        words = set(text.lower().split())
        if len(self.known) > self.most:
            self.known.clear()
        for w in words.difference(self.known):
            w0 = EDGES.sub(b"", w)
            terms = {w0, *(w0[:n] + b" " for n in BEGINNINGS if len(w0) > n)}
            self.known[w] = tuple(xxhash.xxh64_intdigest(t, 7) % self.inputs for t in terms)
        found = set(chain.from_iterable(map(self.known.__getitem__, words)))
        return np.sort(np.fromiter(found, np.int32, len(found)))


def sums(rows: list[np.ndarray], bias: float, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, ...]:
    """The machine's sum for each row, and what its gradient needs: inputs, their rows, values and vectors, and the rows' vectors.

    The sum over pairs is half of the squared sum less the sum of squares."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    take = np.concatenate([*rows, np.zeros(0, np.int32)])
    row = np.repeat(np.arange(len(rows)), sizes)
    value = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)[row]
    v = factors[take] * value[:, None]
    total = np.zeros((len(rows), factors.shape[1]), dtype=np.float32)
    if len(take):
        some = np.flatnonzero(sizes)
        total[some] = np.add.reduceat(v, (np.cumsum(sizes) - sizes)[some])
    z = bias + np.bincount(row, weights[take] * value, minlength=len(rows)) + 0.5 * ((total**2).sum(axis=1) - np.bincount(row, (v**2).sum(axis=1), minlength=len(rows)))
    return z, take, row, value, v, total


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def sums(self, rows: list[np.ndarray]) -> np.ndarray:
        return sums(rows, self.bias, self.weights, self.factors)[0]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return logistic(self.slope * self.sums(rows) + self.shift)


def balanced(y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A weight for each text, in proportion to how often it is labelled; both classes weigh alike."""
    share = [max(times[y == c].sum(), 1e-9) for c in (0, 1)]
    return (0.5 * times / np.where(y == 1, share[1], share[0]) * len(y)).astype(np.float32)


def train(rows: list[np.ndarray], y: np.ndarray, times: np.ndarray, inputs: int = INPUTS, factors: int = FACTORS) -> Machine:
    """Mini-batch descent on the logistic loss with a step size for each weight; only the inputs of a batch change."""
    rng = np.random.default_rng(5)
    bias, w, v = 0.0, np.zeros(inputs, np.float32), rng.normal(0, 0.01, (inputs, factors)).astype(np.float32)
    past_b, past_w, past_v = 1e-8, np.full(inputs, 1e-8, np.float32), np.full((inputs, factors), 1e-8, np.float32)
    weight = balanced(y, times)
    steps = -(-len(rows) // BATCH)
    for _ in range(max(PASSES, -(-LEAST_STEPS // max(1, steps)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            z, take, row, value, own, total = sums([rows[i] for i in pick], bias, w, v)
            error = (weight[pick] * (logistic(z) - y[pick]) / len(pick)).astype(np.float32)
            by_term = np.argsort(take, kind="stable")
            some, first = np.unique(take[by_term], return_index=True)
            slope = error[row] * value
            if len(some):
                dw = np.add.reduceat(slope[by_term], first) + DECAY * w[some]
                dv = np.add.reduceat((slope[:, None] * (total[row] - own))[by_term], first) + DECAY * v[some]
                past_w[some] += dw**2
                past_v[some] += dv**2
                w[some] -= RATE * dw / np.sqrt(past_w[some])
                v[some] -= RATE * dv / np.sqrt(past_v[some])
            db = float(error.sum())
            past_b += db * db
            bias -= RATE * db / past_b**0.5
    return Machine(bias, w, v)


def scaled(machine: Machine, rows: list[np.ndarray], y: np.ndarray, times: np.ndarray) -> Machine:
    """The machine with the slope and shift that suit texts which it was not fitted on."""
    if len(set(y.tolist())) < 2:
        return machine
    z = machine.sums(rows)
    middle, spread = z.mean(), z.std() + 1e-9
    u, weight, a, b = (z - middle) / spread, balanced(y, times), 1.0, 0.0
    for _ in range(500):
        g = weight * (logistic(a * u + b) - y)
        a, b = a - 0.5 * ((g * u).mean() + 1e-3 * a), b - 0.5 * g.mean()
    return Machine(machine.bias, machine.weights, machine.factors, float(a / spread), float(b - a * middle / spread))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """rows: distinct (text, label, times). What comes to the driver is bounded by the sample."""
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    share = {k: min(1.0, sample / n) for k, n in totals.items()}
    chance = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_003)) / 1_000_003
    picked = rows.where(chance <= F.when(F.col("label") == 1, share[1]).otherwise(share[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms()
        for batch in batches:
            found = [of(text).tobytes() for text in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], names=["terms", "label", "times"])

    got = sorted((bytes(r["terms"]), r["label"], r["times"]) for r in picked.select("text", "label", "times").mapInArrow(run, "terms binary, label int, times long").collect())
    found = [np.frombuffer(g[0], dtype=np.int32) for g in got]
    y, times = np.array([g[1] for g in got]), np.array([g[2] for g in got], dtype=float)
    apart = np.array([xxhash.xxh64_intdigest(g[0], 1) % 1000 < APART * 1000 for g in got])
    if len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    part = lambda some: ([found[i] for i in np.flatnonzero(some)], y[some], times[some])
    return scaled(train(*part(~apart)), *part(apart))


def score_table(docs: DataFrame, marks: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) for every row."""
    marked = marks.select(F.col(key), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text")).where(~fold(F.col(key), 3, 1)).transform(lambda t: join_small(t, marked, [key], limit=1_000_000, copies=1))
    machine = fit(keep(rows.groupBy("text", "label").agg(F.count("*").alias("times")), "toxicity-train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Terms()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                score = machine.scores([of(x) for x in texts(part.column(1))]) if machine else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=[key, "score"])

    scored = docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")
    return scored.select(key, fold(F.col(key), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_table(documents(spark, sf_dir), labels(spark, sf_dir))
