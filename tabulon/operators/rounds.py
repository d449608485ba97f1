"""Fitting in rounds by client: each client trains on its own rows from the common state, and the replies are merged.

A round is one grouped-map job: the state goes to the tasks, each client's rows meet what the client stored in the round before, and
a reply, numbers by name, comes back with the client's rows as weight. Replies are merged position by position in the order of
the clients, so that two runs agree to the last bit. A client with too many rows for one task is fitted by aggregates over its rows
instead, where the method has them. What comes to the driver is the state alone."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, number
from ..functions.tables import melt, quantiles
from ..sources.scratch import kept
from ..streaming.monitor import EarlyStop
from .encode import mixture_start

State = dict[str, np.ndarray]
#: Rows of a client that one task takes, and numbers that a state has at most.
MOST_ROWS, MOST_NUMBERS = 1_000_000, 1_000_000
_REPLY = "client_id int, n long, kind string, param string, values array<double>"


@dataclass(frozen=True)
class Method:
    """local(rows, state, storage) gives the reply and what the client keeps for the next round. large(df, state), if given, gives replies
    of large clients from aggregates: (client_id, n, param, pos, value). A state's arrays are flat."""

    local: Callable[[pd.DataFrame, State, State], tuple[State, State]]
    large: Callable[[DataFrame, State], DataFrame] | None = None


@dataclass
class Fit:
    """state: what the last round gave; rounds: how many there were; values: (round, value) of the stop metric where it was evaluated."""

    state: State
    rounds: int = 0
    values: list[tuple[int, float | None]] = field(default_factory=list)


def merged(replies: DataFrame) -> DataFrame:
    """(param, pos, value): means of (client_id, n, param, pos, value) weighted by n, added up in the order of the clients."""
    each = F.array_sort(F.collect_list(F.struct("client_id", F.col("n").cast("double").alias("w"), "value")))
    total = lambda c: F.aggregate("each", F.lit(0.0), lambda a, x: a + c(x))
    rows = replies.where("n > 0").groupBy("param", "pos").agg(each.alias("each"))
    return rows.select("param", "pos", (total(lambda x: x["w"] * x["value"]) / total(lambda x: x["w"])).alias("value"))


def _state(table: DataFrame) -> State:
    rows = table.orderBy("param", "pos").limit(MOST_NUMBERS + 1).collect()
    if len(rows) > MOST_NUMBERS:
        raise ValueError(f"a state has {MOST_NUMBERS} numbers at most")
    out: dict[str, list[float]] = {}
    for r in rows:
        out.setdefault(r["param"], []).append(r["value"])
    return {p: np.array(v) for p, v in out.items()}


def one_round(df: DataFrame, method: Method, state: State, storage: DataFrame | None = None, most_rows: int = MOST_ROWS) -> tuple[State, DataFrame]:
    """The merged state after a round, and the clients' storage: (client_id, param, values). df has client_id."""
    spark = df.sparkSession
    storage = spark.createDataFrame([], "client_id int, param string, values array<double>") if storage is None else storage
    df = df.withColumn("client_id", F.col("client_id").cast("int")).where("client_id IS NOT NULL")
    sizes = df.groupBy("client_id").agg(F.count("*").alias("n"))
    large = [r["client_id"] for r in sizes.where(F.col("n") > most_rows).collect()]  # each has over most_rows rows, so they are few
    if large and method.large is None:
        raise ValueError(f"clients with over {most_rows} rows: {large[:5]}")

    names = [c for c in df.columns if c != "client_id"]

    def train(key: tuple, rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=["client_id", "n", "kind", "param", "values"])
        own = {p: np.array(v, dtype=float) for p, v in zip(stored["param"], stored["values"], strict=True)}
        rows = rows.drop(columns="client_id").sort_values(names, ignore_index=True)  # rows come in any order, sums shall not differ
        reply, keep = method.local(rows, state, own)
        out = [(key[0], len(rows), kind, p, np.asarray(v, dtype=float).tolist()) for kind, part in (("reply", reply), ("storage", keep)) for p, v in part.items()]
        return pd.DataFrame(out, columns=["client_id", "n", "kind", "param", "values"])

    small = df.where(~F.col("client_id").isin(large)) if large else df
    got = kept(small.groupBy("client_id").cogroup(storage.groupBy("client_id")).applyInPandas(train, _REPLY), "replies")
    replies = got.where("kind = 'reply'").select("client_id", "n", "param", F.posexplode("values").alias("pos", "value"))
    if large:
        replies = replies.unionByName(method.large(df.where(F.col("client_id").isin(large)), state).select("client_id", "n", "param", "pos", "value"))
    return _state(merged(replies)), got.where("kind = 'storage'").select("client_id", "param", "values")


def fit_clients(df: DataFrame, method: Method, start: State, rounds: int, *, evaluate: Callable[[State], float | None] | None = None, stop: EarlyStop | None = None, first: int = 1, every: int = 1, most_rows: int = MOST_ROWS) -> Fit:
    """Rounds until there are enough, or until stop says so. evaluate: the stop metric of a state, taken from round `first` on, every so
    many rounds, but not in the last one."""
    fit, storage = Fit(start), None
    for n in range(1, rounds + 1):
        fit.state, storage = one_round(df, method, fit.state, storage, most_rows)
        fit.rounds = n
        if evaluate is not None and n != rounds and n >= first and (n - first) % every == 0:
            value = evaluate(fit.state)
            fit.values.append((n, value))
            if stop is not None and stop.see(value):
                break
    return fit


# ---- methods


def marginal_method(numeric: Sequence[str], grid: Sequence[float]) -> Method:
    """Each client's exact quantiles, in one round; a column that a client lacks is left out of its reply."""

    def local(rows: pd.DataFrame, state: State, storage: State) -> tuple[State, State]:
        out = {}
        for c in numeric:
            v = pd.to_numeric(rows[c], errors="coerce").dropna().to_numpy(dtype=float)
            if len(v):
                out[f"grid.{c}"] = np.quantile(v, grid)
        return out, {}

    def large(df: DataFrame, state: State) -> DataFrame:
        long = melt(df, numeric, ["client_id"], convert=number).where("value IS NOT NULL")
        counts = df.groupBy("client_id").agg(F.count("*").alias("n"))
        points = quantiles(long, ["client_id", "column"], grid).join(counts, "client_id")
        return points.select("client_id", "n", F.concat(F.lit("grid."), "column").alias("param"), F.posexplode("quantiles").alias("pos", "value"))

    return Method(local, large)


def _log_density(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(weight, 1e-300)) - np.log(std) - 0.5 * ((x[:, None] - mean) / std) ** 2


def mixture_method(columns: Sequence[str], steps: int = 3, least: float = 1e-3, by_sums: bool = False) -> Method:
    """A mixture of normals for each column: a client takes some steps of expectation and maximisation from the common mixture. least: the
    deviation that a mode keeps at least, of the common one. by_sums: clients too large for a task take their steps by aggregates,
    which agree with theirs but for the last digits; they store nothing."""

    def local(rows: pd.DataFrame, state: State, storage: State) -> tuple[State, State]:
        out, seen = {}, {}
        for c in columns:
            x = pd.to_numeric(rows[c], errors="coerce").to_numpy(dtype=float)
            x = x[np.isfinite(x)]
            w, m, s = (state[f"{p}.{c}"].copy() for p in ("weight", "mean", "std"))
            floor = least * s
            for _ in range(steps if len(x) else 0):
                d = _log_density(x, w, m, s)
                r = np.exp(d - d.max(axis=1, keepdims=True))
                r /= r.sum(axis=1, keepdims=True)
                n = r.sum(axis=0) + 1e-9
                w, m = n / n.sum(), (r.T @ x + 1e-9 * m) / n
                s = np.maximum(np.sqrt(np.maximum((r * (x[:, None] - m) ** 2).sum(axis=0) / n, 0)), floor)
            out |= {f"weight.{c}": w, f"mean.{c}": m, f"std.{c}": s}
            seen[f"rounds.{c}"] = storage.get(f"rounds.{c}", np.zeros(1)) + 1
        return out, seen

    def large(df: DataFrame, state: State) -> DataFrame:
        sizes = df.groupBy("client_id").agg(F.count("*").alias("n"))
        found = mixture_steps(melt(df, columns, ["client_id"], convert=finite).where("value IS NOT NULL"), [r["client_id"] for r in sizes.collect()], state, columns, steps, least)
        rows = [(c, f"{p}.{name}", i, float(x)) for (c, name), now in found.items() for p, values in zip(("weight", "mean", "std"), now, strict=True) for i, x in enumerate(values)]
        return df.sparkSession.createDataFrame(rows, "client_id int, param string, pos int, value double").join(sizes, "client_id")

    return Method(local, large if by_sums else None)


def mixture_steps(long: DataFrame, clients: Sequence[int], state: State, columns: Sequence[str], steps: int, least: float) -> dict[tuple[int, str], tuple[np.ndarray, ...]]:
    """Weights, means and deviations of each of some few clients' columns after the steps of mixture_method, each one aggregate over
    all of them. long: (client_id, column, value), whose equal values are counted first."""
    counts = kept(long.groupBy("client_id", "column", "value").agg(F.count("*").alias("k")), "counts")
    now = {(c, name): tuple(state[f"{p}.{name}"].copy() for p in ("weight", "mean", "std")) for c in clients for name in columns}
    width = max((len(w) for w, _, _ in now.values()), default=0)
    # a mode that a column doesn't have is far below all others and takes nothing
    fields = ", ".join(f"o{i} double, m{i} double, s{i} double" for i in range(width))
    terms = [F.col(f"o{i}") - 0.5 * F.pow((F.col("value") - F.col(f"m{i}")) / F.col(f"s{i}"), F.lit(2.0)) for i in range(width)]
    for _ in range(steps):
        rows = [(c, name, *[float(x) for o, m, s in [(math.log(max(w, 1e-300)) - math.log(s), m, s) for w, m, s in zip(*p, strict=True)] + [(-1e300, 0.0, 1.0)] * (width - len(p[0])) for x in (o, m, s)]) for (c, name), p in now.items()]
        table = counts.sparkSession.createDataFrame(rows, f"client_id int, column string, {fields}")  # a row a client and column
        each = counts.join(F.broadcast(table), ["client_id", "column"]).withColumns({f"d{i}": t for i, t in enumerate(terms)})
        top = F.greatest(*[F.col(f"d{i}") for i in range(width)]) if width > 1 else F.col("d0")
        each = each.withColumn("top", top).withColumns({f"e{i}": F.exp(F.col(f"d{i}") - F.col("top")) for i in range(width)})
        each = each.withColumn("total", reduce(Column.__add__, [F.col(f"e{i}") for i in range(width)])).withColumns({f"r{i}": F.col(f"e{i}") / F.col("total") * F.col("k") for i in range(width)})
        # taken from the mode's mean, so that squares don't cancel
        gap = lambda i: F.col("value") - F.col(f"m{i}")
        sums = [F.sum(x).alias(f"{p}{i}") for i in range(width) for p, x in (("n", F.col(f"r{i}")), ("x", F.col(f"r{i}") * gap(i)), ("xx", F.col(f"r{i}") * gap(i) * gap(i)))]
        for r in each.groupBy("client_id", "column").agg(*sums).collect():
            w, m, s = now[r["client_id"], r["column"]]
            n, x, xx = (np.array([r[f"{p}{i}"] for i in range(len(w))]) for p in ("n", "x", "xx"))
            n, floor = n + 1e-9, least * state[f"std.{r['column']}"]
            step = x / n
            spread = np.maximum(xx / n - 2 * step * x / n + step * step * (n - 1e-9) / n, 0)
            now[r["client_id"], r["column"]] = n / n.sum(), m + step, np.maximum(np.sqrt(spread), floor)
    return now


def mixture_state(df: DataFrame, columns: Sequence[str], modes: int) -> State:
    """Where the rounds of mixture_method start: means at even quantiles of all rows."""
    out: dict[str, list] = {}
    for r in mixture_start(df, columns, modes).orderBy("column", "mode").collect():
        for p in ("weight", "mean", "std"):
            out.setdefault(f"{p}.{r['column']}", []).append(r[p])
    return {p: np.array(v) for p, v in out.items()}


def log_likelihood(df: DataFrame, columns: Sequence[str]) -> Callable[[State], float | None]:
    """The mean log density of rows under a mixture state, over columns: a stop metric of which more is better. One aggregate."""

    def evaluate(state: State) -> float | None:
        sums = []
        for c in columns:
            modes = [F.lit(float(w)) / F.lit(float(s)) * F.exp(-0.5 * F.pow((number(F.col(f"`{c}`")) - F.lit(float(m))) / F.lit(float(s)), F.lit(2.0))) for w, m, s in zip(state[f"weight.{c}"], state[f"mean.{c}"], state[f"std.{c}"], strict=True)]
            total = modes[0]
            for d in modes[1:]:
                total = total + d
            sums.append(F.avg(F.ln(total + 1e-300)))
        got = [x for x in df.agg(*sums).first() if x is not None]
        return sum(got) / len(got) if got else None

    return evaluate


def mixture_params(df: DataFrame, state: Mapping[str, np.ndarray], columns: Sequence[str]) -> DataFrame:
    """(column, mode, weight, mean, std) of a mixture state."""
    rows = [(c, i, float(w), float(m), float(s)) for c in columns for i, (w, m, s) in enumerate(zip(state[f"weight.{c}"], state[f"mean.{c}"], state[f"std.{c}"], strict=True))]
    return df.sparkSession.createDataFrame(rows, "column string, mode int, weight double, mean double, std double")
