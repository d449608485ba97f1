"""Rounds by client, mixtures with a Dirichlet-process prior, the copula, draws from many categories."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions.exprs import hash_u01
from tabulon.functions.schema import ColumnSchema, TableSchema
from tabulon.functions.tables import as_of, cut_at
from tabulon.operators import bayes, copula, rounds, split, synth
from tabulon.plans import queries
from tabulon.streaming.monitor import EarlyStop

GRID = [i / 4 for i in range(5)]


def clients(spark, n=900, seed=1, k=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i % k), float(rng.choice([-6.0, 0.0, 7.0]) + rng.normal(0, 0.5)), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "client_id int, x double, y double")


def same(a, b):
    return a.keys() == b.keys() and all(np.array_equal(a[p], b[p]) for p in a)


def test_marginals_by_client_merge_by_rows_and_repeat(spark):
    df = clients(spark).where("client_id < 2 OR x > 0")
    method = rounds.marginal_method(["x", "y"], GRID)
    fit = rounds.fit_clients(df, method, {}, 1)
    parts = {c: g for c, g in df.toPandas().groupby("client_id")}
    n = sum(map(len, parts.values()))
    for c in ("x", "y"):
        want = sum(np.quantile(g[c], GRID) * len(g) for g in parts.values()) / n
        assert np.allclose(fit.state[f"grid.{c}"], want, rtol=1e-12)
    assert same(fit.state, rounds.fit_clients(df.repartition(7), method, {}, 1).state)


def test_large_clients_go_by_aggregates(spark):
    df = clients(spark)
    method = rounds.marginal_method(["x"], GRID)
    whole, _ = rounds.one_round(df, method, {})
    large, _ = rounds.one_round(df, method, {}, most_rows=10)
    assert np.allclose(whole["grid.x"], large["grid.x"], rtol=1e-12)
    with pytest.raises(ValueError, match="clients with over"):
        rounds.one_round(df, rounds.mixture_method(["x"]), rounds.mixture_state(df, ["x"], 3), most_rows=10)


def test_large_clients_take_the_mixture_s_steps(spark):
    df = clients(spark).withColumn("y", F.when(F.col("client_id") != 1, F.round("y", 1)))
    start = rounds.mixture_state(df, ["x"], 3) | rounds.mixture_state(df, ["y"], 2)
    df = df.union(spark.createDataFrame([(2, float("nan"), float("inf"))], "client_id int, x double, y double"))
    method = rounds.mixture_method(["x", "y"], by_sums=True)
    small = rounds.fit_clients(df, method, start, 2).state
    for most in (0, 300):  # all clients go by aggregates, or one
        large = rounds.fit_clients(df, method, start, 2, most_rows=most).state
        assert large.keys() == small.keys() and all(np.allclose(large[p], small[p], rtol=1e-7, atol=1e-9) for p in small)


def test_rounds_of_local_training(spark):
    df = clients(spark)
    start, method, score = rounds.mixture_state(df, ["x"], 3), rounds.mixture_method(["x"]), rounds.log_likelihood(df, ["x"])
    fit = rounds.fit_clients(df, method, start, 12, evaluate=score, stop=EarlyStop(1e-3, 2, higher=True))
    assert fit.rounds < 12 and [n for n, _ in fit.values] == list(range(1, fit.rounds + 1))
    assert np.allclose(np.sort(fit.state["mean.x"]), [-6, 0, 7], atol=0.2) and abs(fit.state["weight.x"].sum() - 1) < 1e-9
    assert score(fit.state) > score(start)
    again = rounds.fit_clients(df.repartition(5), method, start, fit.rounds)
    assert same(fit.state, again.state)


def test_clients_keep_what_they_store(spark):
    df = clients(spark, 30)

    def local(rows, state, storage):
        turns = storage.get("turns", np.zeros(1)) + 1
        return {"turns": turns, "sum": state.get("sum", np.zeros(1)) + [len(rows)]}, {"turns": turns}

    fit = rounds.fit_clients(df, rounds.Method(local), {}, 3)
    assert fit.state["turns"].tolist() == [3.0] and fit.state["sum"].tolist() == [30.0]
    assert rounds.fit_clients(df.limit(0), rounds.Method(local), {"a": np.zeros(1)}, 1).state == {}


def test_evaluation_follows_the_cadence_and_stops(spark):
    df = clients(spark, 30)
    method = rounds.Method(lambda rows, state, storage: ({"n": np.ones(1)}, {}))
    fit = rounds.fit_clients(df, method, {}, 6, evaluate=lambda s: float("nan"), first=2, every=2)
    assert [n for n, _ in fit.values] == [2, 4]
    assert rounds.fit_clients(df, method, {}, 6, evaluate=lambda s: 1.0, stop=EarlyStop(0, 1, higher=True)).rounds == 2


def test_digamma():
    euler = 0.5772156649015329
    assert np.allclose(bayes.digamma(np.array([1.0, 2.0, 0.5, 30.0])), [-euler, 1 - euler, -euler - 2 * math.log(2), math.log(30) - 1 / 60 - 1 / (12 * 900)], atol=1e-6)
    x = np.array([0.03, 1.7, 12.0])
    assert np.allclose(bayes.digamma(x + 1) - bayes.digamma(x), 1 / x, rtol=1e-10)


def test_three_modes_stay_three(spark):
    df = clients(spark, 1500)
    got = bayes.fit_modes(df, ["x", "y"]).toPandas()
    x = got[got["column"] == "x"]
    assert len(x) == 3 and np.allclose(x["mean"], [-6, 0, 7], atol=0.2) and np.allclose(x["std"], 0.5, atol=0.2)
    assert abs(x["weight"].sum() - 1) < 1e-9 and (x["weight"] > 0.25).all()
    assert 1 <= len(got[got["column"] == "y"]) <= 10
    assert bayes.fit_modes(df.withColumn("x", F.lit(None).cast("double")), ["x"]).count() == 0
    assert bayes.fit_modes(df.withColumn("x", F.lit(4.0)), ["x"]).toPandas()["mean"].round(3).tolist().count(4.0) >= 1


def test_the_query_fits_until_modes_settle(spark, monkeypatch):
    """The rounds of the query, each worked out here, go on until modes stay where they are; a fit that has too few says so."""
    d, seen = "/root/testdata/sf0.001", []
    v = spark.read.parquet(f"{d}/orders.parquet").toPandas()["o_totalprice"].to_numpy()

    def plain_round(counts, now, prior):
        p, x = now["o_totalprice"], v - v.mean()
        logs = p.offsets() - (v[:, None] - p.mean) ** 2 / (2 * p.variance)
        r = np.exp(logs - logs.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        seen.append(bayes.posterior(r.sum(axis=0), x @ r, (x * x) @ r, 0.0, v.var(ddof=1)))
        seen[-1].mean = seen[-1].mean + v.mean()
        return {"o_totalprice": seen[-1]}

    monkeypatch.setattr(bayes, "dp_round", plain_round)
    got = queries.QUERIES["fit_modes"](spark, d).orderBy("mode").toPandas()
    old, new = seen[-2:]
    stay = np.maximum(old.weights(), new.weights()) > bayes.LEAST
    assert np.abs(new.weights() - old.weights()).max() < 1e-3 and (np.abs(new.mean - old.mean) / np.sqrt(new.variance))[stay].max() < 1e-3
    assert len(got) == (new.weights() > bayes.LEAST).sum() and np.allclose(got["mean"], np.sort(new.mean[new.weights() > bayes.LEAST]))
    with pytest.warns(UserWarning, match="not settled"):
        bayes.fit_modes(spark.read.parquet(f"{d}/orders.parquet"), ["o_totalprice"], rounds=2)


def test_dp_round_is_that_of_numpy(spark):
    rng = np.random.default_rng(4)
    v = np.round(np.concatenate([rng.normal(100, 1, 200), rng.normal(104, 1, 100)]), 1)
    counts = bayes.counted(spark.createDataFrame([(float(a),) for a in v], "x double"), ["x"])
    prior = bayes.priors(counts)
    assert np.allclose(prior["x"], (v.mean(), v.var(ddof=1)))
    n = np.array([100.0, 120.0, 80.0])
    now = bayes.Posterior(1 + n, 0.001 + np.array([200.0, 80.0, 0.0]), 1 + n, np.array([99.0, 102.0, 105.0]), 1 + n, np.array([1.0, 2.0, 1.0]))
    logs = now.offsets() - (v[:, None] - now.mean) ** 2 / (2 * now.variance)
    r = np.exp(logs - logs.max(axis=1, keepdims=True))
    r /= r.sum(axis=1, keepdims=True)
    nk = r.sum(axis=0)
    xk = r.T @ v / nk
    sk = (r * (v[:, None] - xk) ** 2).sum(axis=0) / nk
    got = bayes.dp_round(counts, {"x": now}, prior)["x"]
    m0, v0 = v.mean(), v.var(ddof=1)
    assert np.allclose(got.a, 1 + nk) and np.allclose(got.b, 0.001 + np.array([nk[1] + nk[2], nk[2], 0]), atol=1e-6)
    assert np.allclose(got.mean, (m0 + nk * xk) / (1 + nk)) and np.allclose(got.variance, (v0 + nk * sk + nk / (1 + nk) * (xk - m0) ** 2) / (1 + nk), rtol=1e-4)


def ranks(a):
    return pd.DataFrame(a).rank().corr().to_numpy()


def test_normal_scores_of_many_values_and_of_a_frequent_one(spark, monkeypatch):
    rows = [(i, float(i % 7 and i), float(i % 3) if i % 5 else None, None) for i in range(700)] + [(700, float("nan"), float("inf"), None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    by_id = lambda t: {r["id"]: tuple(r)[1:] for r in t.collect()}
    few = by_id(copula.normal_scores(df, "id", ["a", "b", "c"]))
    monkeypatch.setattr(copula, "FEW", 2)
    monkeypatch.setattr(copula, "OFTEN", 20)
    monkeypatch.setattr(copula, "TASK_ROWS", 100)
    assert by_id(copula.normal_scores(df, "id", ["a", "b", "c"])) == few and len(few) == 701
    a = pd.DataFrame(rows)[1]
    ranks = (a.rank() - 0.5) / a.notna().sum()
    assert all(abs(few[i][0] - NormalDist().inv_cdf(ranks[i])) < 1e-12 for i in range(700))
    assert few[700] == (None, None, None) and few[5][1] is None and few[1][1] is not None


def test_copula_keeps_rank_correlations_and_distributions(spark):
    rng = np.random.default_rng(5)
    z = rng.multivariate_normal([0, 0, 0], [[1, 0.8, -0.5], [0.8, 1, -0.2], [-0.5, -0.2, 1]], 4000)
    data = np.column_stack([np.exp(z[:, 0]), z[:, 1] ** 3, np.round(z[:, 2], 1)])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id long, a double, b double, c double")
    fitted = copula.fit_copula(df, "id", ["a", "b", "c"])
    got = copula.copula_rows(spark, fitted, 6000, 9).toPandas()[["a", "b", "c"]].to_numpy()
    assert np.abs(ranks(got) - ranks(data)).max() < 0.03
    assert np.allclose(np.quantile(got, [0.1, 0.5, 0.9], axis=0), np.quantile(data, [0.1, 0.5, 0.9], axis=0), rtol=0.12, atol=0.12)
    assert copula.copula_rows(spark, fitted, 50, 9).collect() == copula.copula_rows(spark, fitted, 50, 9).repartition(3).orderBy("id").collect()


def test_copula_mends_what_is_no_correlation():
    bad = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    lower = copula.factor(bad)
    assert np.allclose(np.diag(lower @ lower.T), 1) and np.allclose(np.triu(lower, 1), 0)


def test_normal_share(spark):
    from statistics import NormalDist

    got = spark.createDataFrame([(x / 10,) for x in range(-60, 61)], "z double").select("z", copula.share(F.col("z")).alias("p")).collect()
    assert max(abs(r["p"] - NormalDist().cdf(r["z"])) for r in got) < 1e-7


SCHEMA = TableSchema((ColumnSchema("x", "continuous"), ColumnSchema("n", "integer"), ColumnSchema("c", "categorical")))


@pytest.mark.parametrize("name", ["copula", "mixture_by_client"])
def test_synthesizers_of_rounds_and_copula(spark, name):
    df = clients(spark, 300).withColumns({"n": F.round("y").cast("long"), "c": F.when(F.col("x") > 0, "p").otherwise("q")})
    s = synth.SYNTHESIZERS[name]
    state = s.fit(df.select("client_id", "x", "n", "c"), SCHEMA)
    got = s.sample(state, SCHEMA, 40, 3)
    assert got.count() == 40 and got.dtypes == [("x", "double"), ("n", "bigint"), ("c", "string")] and got.na.drop().count() == 40


def test_as_of(spark):
    rng = np.random.default_rng(6)
    marks = sorted({(int(rng.integers(3)), round(float(rng.random()), 2)) for _ in range(150)})
    asked = [(i, int(rng.integers(4)), round(float(rng.random()), 2)) for i in range(600)]
    m = spark.createDataFrame([(k, a, f"{k}:{a}") for k, a in marks], "k int, at double, name string")
    a = spark.createDataFrame(asked, "id int, k int, at double")
    got = {r["id"]: r["name"] for r in as_of(m, a, ["k"], "at", ["name"]).collect()}
    want = {i: next((f"{k2}:{a2}" for k2, a2 in reversed(marks) if k2 == k and a2 <= at), None) for i, k, at in asked}
    assert got == want


def test_cut_at_counts_reached_ranks(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(100)], "k int, v int")
    got = df.select("k", "v", cut_at(df, [F.col("v"), F.col("k")], [0, 10, 10, 99, 500]).alias("c")).collect()
    order = {k: i for i, (v, k) in enumerate(sorted((r["v"], r["k"]) for r in got))}
    assert all(r["c"] == sum(order[r["k"]] >= x for x in (0, 10, 10, 99, 500)) for r in got)


def test_draws_by_ranges_are_those_by_arrays(spark):
    w = spark.createDataFrame([("a", f"{i:04d}", float(1 + i % 7)) for i in range(500)] + [("b", "only", 2.0), ("a", "never", 0.0)], "column string, category string, weight double")
    asked = spark.range(3000).select("id", F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("column"), hash_u01(1, F.col("id")).alias("u"))
    few, many = split.draw(asked, w, few=10_000), split.draw(asked, w, few=10)
    assert sorted(map(tuple, few.select("id", "category").collect())) == sorted(map(tuple, many.select("id", "category").collect()))
    assert many.where("category = 'never'").count() == 0


def test_draws_from_millions_of_categories(spark):
    n = 5_000_000
    w = spark.range(n).select(F.lit("a").alias("column"), F.lpad(F.col("id").cast("string"), 8, "0").alias("category"), F.lit(1.0).alias("weight"))
    asked = spark.range(1000).select("id", F.lit("a").alias("column"), hash_u01(2, F.col("id")).alias("u"))
    got = split.draw(asked, w)
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "BroadcastExchange" not in plan.split("Physical Plan")[-1]
    assert all(int(r["category"]) == min(n - 1, math.floor(r["u"] * n)) or abs(int(r["category"]) - r["u"] * n) < 1e-3 for r in got.collect())


def test_rows_without_client_or_label_stay(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2, None if i % 5 == 0 else "ab"[i % 2]) for i in range(80)], "k int, client_id int, label string")
    got = split.client_split(df, "k", 0.25, 1)
    assert got.count() == 80 and {(r["client_id"], r["split"]): r["count"] for r in got.groupBy("client_id", "split").count().collect()} == {(None, "test"): 5, (None, "train"): 15, (0, "test"): 5, (0, "train"): 15, (1, "test"): 10, (1, "train"): 30}
    assert split.part_pathological(df.drop("client_id"), 3, "label", "k", 1).count() == 80
    assert split.part_shard(df.drop("client_id"), 2, "label", "k", 1).count() == 80
    assert split.part_dirichlet(df.drop("client_id"), 2, "label", "k", 1, least=1).count() == 80


def test_clients_against_one_distribution(spark):
    from tabulon.functions.tables import cdf
    from tabulon.operators import fidelity

    rng = np.random.default_rng(9)
    real = [(int(k), c, round(float(rng.normal(k, 1 + k)), int(rng.integers(0, 3)))) for k in range(6) for c in "ab" for _ in range(int(rng.integers(1, 60)))]
    real += [(7, "a", 1.0), (8, "a", -99.0), (9, "a", 99.0), (10, "b", None)]
    syn = [(c, round(float(rng.normal(2, 3)), 1)) for c in "ab" for _ in range(80)] + [("a", None)]
    r, s = spark.createDataFrame(real, "k int, column string, value double"), spark.createDataFrame(syn, "column string, value double")
    got = {(x["k"], x["column"]): (x["ks"], x["wasserstein"]) for x in fidelity.distances_to_one(r, s, ["k"]).collect()}
    both = cdf(r, s.join(r.select("k").distinct()), ["k", "column"]).where("f_real IS NOT NULL")
    gap = F.abs(F.col("f_real") - F.col("f_syn"))
    want = {(x["k"], x["column"]): (x["ks"], x["w"]) for x in both.groupBy("k", "column").agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next") - F.col("value"))).alias("w")).collect()}
    assert got.keys() == want.keys() and len(got) == 15
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in got), [(k, got[k], want[k]) for k in got if not np.allclose(got[k], want[k])]
