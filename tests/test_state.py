"""Client state, encoders, generators, monitoring, report, registration."""

import dataclasses
import hashlib
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.schema import ColumnSchema, TableSchema
from tabulon.operators import encode, federate, fidelity, learn, privacy, split, synth
from tabulon.plans import suite
from tabulon.streaming import monitor


def test_fedavg(spark):
    params = spark.createDataFrame([(0, "w", 0, 1.0), (1, "w", 0, 4.0)], "client_id int, param string, pos int, value double")
    counts = spark.createDataFrame([(0, 1), (1, 2)], "client_id int, n long")
    assert federate.fedavg(params, counts).first()["value"] == 3.0 and federate.fedavg(params, counts, weighted=False).first()["value"] == 2.5
    with pytest.raises(Exception, match="add up to nothing"):
        federate.fedavg(params, counts.withColumn("n", F.lit(0))).collect()


def test_similarity(spark):
    df = spark.createDataFrame([(i % 3, "ab"[i % 2] if i % 3 < 2 else "a", float(i)) for i in range(90)], "client_id int, c string, x double")
    counts = df.groupBy("client_id").agg(F.count("*").alias("n"))
    js = {r["client_id"]: r["distance"] for r in federate.js_distance(federate.client_profiles(df, ["c"]), counts).collect()}
    assert math.isclose(js[0], js[1], abs_tol=1e-9) and js[2] > js[0]
    w = {r["client_id"]: r["weight"] for r in federate.similarity_weights(federate.similarity(federate.js_distance(federate.client_profiles(df, ["c"]), counts)), counts).collect()}
    assert math.isclose(sum(w.values()), 1.0) and w[2] < w[0]
    zero = spark.createDataFrame([(0, 0.0), (1, 0.0)], "client_id int, s double")
    assert {r["client_id"]: r["weight"] for r in federate.similarity_weights(zero, spark.createDataFrame([(0, 1), (1, 3)], "client_id int, n long")).collect()} == {0: 0.25, 1: 0.75}
    assert federate.client_wasserstein(df, ["x"], "x").count() == 3


def test_encoders(spark):
    df = spark.createDataFrame([(i, float(i % 7), "abc"[i % 3]) for i in range(70)], "id int, x double, c string")
    low, high = encode.minmax(df, ["x"])["x"]
    back = df.select("x", encode.unscale(encode.scale(F.col("x"), low, high), low, high).alias("y"))
    assert back.where(F.abs(F.col("x") - F.col("y")) > 1e-12).count() == 0
    assert spark.range(1).select(encode.scale(F.lit(5.0), 5.0, 5.0)).first()[0] == 0
    assert [tuple(r) for r in encode.label_codes(df, "c").orderBy("code").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert [r[0] for r in spark.createDataFrame([(0.25,), (0.75,), (2.0,), (-1.0,)], "u double").select(encode.code_of_unit(F.col("u"), 3)).collect()] == [0, 2, 2, 0]
    u = encode.quantile_uniform(df, "x").agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < u[0] < 0.1 and 0.9 < u[1] < 1 and math.isclose(u[2], 0.5, abs_tol=1e-9)
    z = spark.createDataFrame([(0.5,), (0.9,)], "u double").select(encode.probit(F.col("u"))).collect()
    assert math.isclose(z[0][0], 0, abs_tol=1e-9) and math.isclose(z[1][0], NormalDist().inv_cdf(0.9))


def test_modes_round_trip(spark):
    modes = F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(m).alias("mean"), F.lit(s).alias("std")) for w, m, s in ((0.5, 0.0, 1.0), (0.5, 50.0, 2.0))])
    df = spark.createDataFrame([(0.5,), (51.0,), (-1.0,)], "x double").select("x", encode.mode_normalized(F.col("x"), modes, F.lit(0.5)).alias("e"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: (i == F.col("e.mode")).cast("double"))
    for r in df.select("x", "e.mode", encode.mode_denormalized(F.col("e.value"), hot, modes).alias("y")).collect():
        assert math.isclose(r["x"], r["y"], abs_tol=1e-9) and r["mode"] == int(r["x"] > 25)


KINDS = {"continuous": "a", "integer": "b", "categorical": "c", "binary": "d"}


@pytest.mark.parametrize("kinds", [["categorical", "binary"], ["continuous", "integer"], list(KINDS)])
def test_generators(spark, kinds):
    schema = TableSchema(tuple(ColumnSchema(KINDS[k], k) for k in kinds))
    rows = synth.constant_rows(spark, schema, 5).drop("id")
    assert synth.check_sample(rows, schema, 5).distinct().count() == 1
    with pytest.raises(ValueError, match="rows instead"):
        synth.check_sample(rows, schema, 6)
    with pytest.raises(ValueError, match="columns differ"):
        synth.check_sample(rows.withColumn("more", F.lit(1)), schema, 5)


def test_marginals_and_mixture(spark):
    df = spark.range(600).select((F.col("id") % 3).cast("int").alias("client_id"), (F.when(F.col("id") % 2 == 0, 0.0).otherwise(100.0) + F.col("id") % 7).alias("x"), F.when(F.col("id") % 4 == 0, "u").otherwise("v").alias("c"))
    grids, shares = synth.fit_marginals(df, ["x"], ["c"])
    got = synth.marginal_rows(grids, shares, 1000, 1)
    assert got.count() == 2000 and 0.15 < got.where("category = 'u'").count() / 1000 < 0.35
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, synth.marginal_rows(grids, shares, 1000, 1).collect()), key=repr)
    params = synth.fit_mixture(df, ["x"], modes=2, rounds=10)
    assert [round(r["mean"]) for r in params.orderBy("mean").collect()] == [3, 103]
    values = [r["value"] for r in synth.mixture_rows(params, 800, 2).collect()]
    assert 0.4 < sum(v > 50 for v in values) / 800 < 0.6
    assert synth.uniform_rows(df, ["x"], 50, 3).where("x < 0 OR x > 106").count() == 0


def stops(spark, values, patience=2, epsilon=0.1, higher=True):
    rows = [("r", i + 1, v) for i, v in enumerate(values)]
    return monitor.early_stop(spark.createDataFrame(rows, "run_id string, round long, value double"), epsilon, patience, higher).first()["stop_round"]


def test_early_stop(spark):
    nan = float("nan")
    assert stops(spark, [1.0, 2.0, 2.05, 2.06]) == 4 and stops(spark, [1.0, 2.0, 3.0]) is None
    assert stops(spark, [3.0, 2.0, 1.95, 1.0, 1.0, 1.0], higher=False) == 6
    assert stops(spark, [1.0, None, nan, 1.0, None, 1.0]) == 6  # missing values leave patience alone
    assert stops(spark, [1.0, nan, nan, nan, nan, nan, 5.0]) == 6
    assert [r[0] for r in spark.range(1, 10).where(monitor.evaluate_at(F.col("id"), F.lit(9), 3, 2)).collect()] == [3, 5, 7]


def test_streams(spark, tmp_path):
    rows = [("a", 1.0, "request", 5), ("a", 3.5, "reply", 7), ("a", 4.0, "round", 0), ("b", 0.0, "configure", 9)]
    events = spark.createDataFrame(rows, "run_id string, s double, type string, byte_count long").withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")
    events.write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    monitor.stream_totals(stream(), str(tmp_path / "totals")).awaitTermination()
    batch = sorted(map(tuple, monitor.run_totals(events).collect()))
    assert sorted(map(tuple, monitor.latest_totals(spark, str(tmp_path / "totals")).collect())) == batch == [("a", 3.0, 5, 7, 1), ("b", 0.0, 0, 0, 0)]
    heard = []

    def fails(batch, n):
        raise RuntimeError

    monitor.subscribe(stream(), ["request"], fails, str(tmp_path / "c1")).awaitTermination()
    monitor.subscribe(stream(), ["request", "reply"], lambda b, n: heard.append(b.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(heard) == 2


def scored_tables(spark):
    df = spark.range(400).select("id", ((F.col("id") * 37 % 101) / 7.0).alias("x"), (F.col("id") % 10).cast("double").alias("w"), (F.col("id") * 13 % 2).cast("int").alias("y"), (F.col("id") % 3).cast("string").alias("Stage 1.s"))
    schema = TableSchema((ColumnSchema("x", "continuous"), ColumnSchema("w", "continuous"), ColumnSchema("y", "binary"), ColumnSchema("Stage 1.s", "categorical")))
    cut = split.holdout_split(df, "id", 0.3, 1)
    own = split.client_split(split.part_iid(split.all_train(cut).drop("split"), 2, "id", 1), "id", 0.3, 2)
    runs = spark.createDataFrame([("a", 1, "request", 5), ("a", 4, "reply", 7), ("a", 5, "round", 0)], "run_id string, s long, type string, byte_count long").withColumn("ts", F.timestamp_seconds("s"))
    seconds = spark.createDataFrame([(0, 2.0), (1, 2.0)], "client_id int, value double")
    return df, suite.Context(schema, split.all_train(own).drop("split"), cut.where("split = 'holdout'").drop("split"), df.drop("id"), "id", "y", ("Stage 1.s",), test=own.where("split = 'test'").drop("split"), runs=runs, seconds=seconds)


def test_report_as_a_query_is_small(spark):
    """What is left of a report is a union of what its evaluators found, however many they are."""
    ctx = scored_tables(spark)[1]
    plan = suite.report(ctx, ["fidelity"], by_client=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1 and plan.count("Relation") == 5


def test_both_reports_score_by_the_same_models(spark, monkeypatch):
    """A report of the whole and one by client over the same tables fit each model once, and score each row once."""
    ctx, fits, plain = scored_tables(spark)[1].written(), [], learn._plain
    monkeypatch.setattr(learn, "_plain", lambda model, s: (fits.append(1), plain(model, s))[1])
    for by_client in (False, True):
        assert suite.report(ctx, ["utility", "fairness"], by_client=by_client).where("key = 'utility.tstr_auc' AND value IS NOT NULL").count() == 1
    assert len(fits) == 2
    fitted = ctx.models["fit_for", tuple(ctx.columns(ctx.syn).columns), "y", ()]
    assert "UDF" not in learn.task_scores(fitted, ctx.columns(ctx.holdout), "y")._jdf.queryExecution().optimizedPlan().toString()
    assert not dataclasses.replace(ctx, syn=ctx.syn.limit(0)).models


def test_values_that_are_equal_meet_whatever_the_mean(spark):
    """Sums of doubles differ in the last bit from one run to the next. Here a synthetic table's mean differs with each reading, far more."""
    chance = F.udf(lambda i: random.random(), "double").asNondeterministic()
    real = spark.range(9000).select((F.col("id") % 2).alias("client_id"), F.lit("x").alias("column"), (F.col("id") % 9 / 100).alias("value"))
    syn = real.select("column", "value").where(chance("value") < 0.7)
    assert all(r["ks"] < 0.05 for r in fidelity.distances(real, syn, ["client_id"]).collect())


def test_distances_are_worked_out_once(spark):
    """The probe's scores read its distances three times."""
    df = spark.range(50).select("id", (F.col("id") * 7 % 11).cast("double").alias("x"))
    plan = privacy.membership_scores(privacy.nearest_distances(df.withColumn("label", F.lit(1)), df, ["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan


def test_report_and_registration(spark):
    df, ctx = scored_tables(spark)
    for by_client in (False, True):
        got = suite.report(ctx, by_client=by_client)
        assert suite.check_keys(got, ["fidelity", "utility", "privacy", "fairness"], ctx.sensitive).count() == 0
        values = {r["key"]: r["value"] for r in got.collect()}
        assert (values["fidelity.corr_fro_diff"] is None) == by_client
        assert (values["privacy.exact_row_match_rate_train"] is None) != by_client
        assert (values["privacy.mia_accuracy"] is None) == by_client and values["privacy.mia_auc"] is not None
        assert values["privacy.aia_accuracy.stage_s"] is not None and "fairness.demographic_parity_diff.stage_s" in values
        assert [values[f"scalability.{k}"] for k in ("wall_clock_seconds", "bytes_sent", "rounds_to_converge", "local_train_seconds_mean")] == ([4.0, 5.0, 1.0, 2.0] if by_client else [None] * 4)
        assert all(v is None or math.isfinite(v) for v in values.values())
    rows = lambda c: c.syn.agg(F.lit("fidelity.rows").alias("key"), F.count("*").cast("double").alias("value"))
    suite.register_evaluator("rows", suite.Evaluator("fidelity", ("fidelity.rows",), rows, rows))
    try:
        assert suite.single(ctx, "fidelity.rows").first()["value"] == 400
        with pytest.raises(ValueError, match="taken"):
            suite.register_evaluator("other", suite.Evaluator("fidelity", ("fidelity.rows",), rows, rows))
        with pytest.raises(ValueError, match="taken"):
            suite.register_evaluator("other", suite.Evaluator("utility", ("utility.tstr_auc",), rows, rows))
    finally:
        del suite.EVALUATORS["rows"]
    with pytest.raises(ValueError, match="on its own"):
        suite.single(ctx, "scalability.bytes_sent")
    suite.register_partitioner("halves", lambda df, clients, seed=0: df.withColumn("client_id", (F.col("id") % clients).cast("int")))
    assert suite.PARTITIONERS["halves"](df, 2).select("client_id").distinct().count() == 2


def test_one_evaluator_runs_for_one_metric(spark, monkeypatch):
    _, ctx = scored_tables(spark)
    ran = []
    for name, e in suite.BUILT_IN.items():
        monkeypatch.setitem(suite.BUILT_IN, name, suite.Evaluator(e.category, e.keys, lambda c, n=name, e=e: (ran.append(n), e.whole(c))[1], e.federated, e.stops))
    assert suite.single(ctx, "fidelity.categorical_tv_mean").count() == 1 and ran == ["categories"]


def test_stop_metrics(spark):
    assert suite.stop_metric("utility.tstr_auc") is True and suite.stop_metric("fidelity.ks_mean") is False
    assert suite.stop_metric("fidelity.ks_mean", higher=True) is True and suite.stop_metric("privacy.aia_auc.s_x", ["S x"]) is False
    for key, among in (("fidelity.none", tuple(suite.BUILT_IN)), ("scalability.bytes_sent", ("fidelity",)), ("privacy.exact_row_match_any", ("privacy",)), ("utility.tstr_auc", ("fidelity",)), ("privacy.aia_auc.s", ("privacy",))):
        with pytest.raises(ValueError, match=r"no evaluator|can't stop"):
            suite.stop_metric(key, categories=among)


def test_federated_values_are_the_clients_on_their_test_rows(spark):
    """Each client scored by hand on its own rows held out, then weighted by their number."""
    _, ctx = scored_tables(spark)
    got = {r["key"]: r["value"] for r in suite.report(ctx, ["utility", "privacy"], by_client=True).collect()}
    with pytest.raises(ValueError, match="test rows"):
        suite.report(dataclasses.replace(ctx, test=None), ["utility"], by_client=True)
    auc, hits = [], []
    for c in (0, 1):
        test, train = (t.where(F.col("client_id") == c).toPandas() for t in (ctx.test, ctx.train))
        one = learn.tstr(ctx.columns(ctx.syn), ctx.columns(ctx.test.where(F.col("client_id") == c)), ctx.schema, "y").first()
        assert one["n"] == len(test)
        auc.append((one["tstr_auc"], len(test)))
        syn = ctx.syn.select("x", "w").toPandas().to_numpy()
        low, width = syn.min(axis=0), np.ptp(syn, axis=0)
        k = min(len(train), len(test))
        first = lambda t, k=k: np.array([r[1:] for r in sorted((u01(46, i), x, w) for i, x, w in zip(t["id"], t["x"], t["w"], strict=True))[:k]])
        far = lambda a, low=low, width=width, syn=syn: np.array([np.sqrt((((p - low) / width - (syn - low) / width) ** 2).sum(axis=1).min()) for p in a])
        m, o = -far(first(train)), -far(first(test))
        hits.append((np.mean((m[:, None] > o) + 0.5 * (m[:, None] == o)), k))
    mean = lambda xs: sum(v * n for v, n in xs) / sum(n for _, n in xs)
    assert math.isclose(got["utility.tstr_auc"], mean(auc), rel_tol=1e-9) and math.isclose(got["privacy.mia_auc"], mean(hits), rel_tol=1e-9)


def u01(seed, key):
    return int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:8], 16) / 2**32


def test_synthesizers(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("int").alias("client_id"), (F.col("id") * 1.5).alias("x"), (F.col("id") % 40).alias("n"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("c"))
    schema = TableSchema((ColumnSchema("x", "continuous"), ColumnSchema("c", "binary"), ColumnSchema("n", "integer")))
    for name, s in synth.SYNTHESIZERS.items():
        got = s.sample(s.fit(df, schema), schema, 50, 3)
        assert got.columns == ["x", "c", "n"] and got.count() == 50 and dict(got.dtypes)["n"] == "bigint"
        if name != "constant":
            r = got.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count_distinct("c").alias("c")).first()
            assert -300 < r["a"] < r["b"] < 900 and r["c"] == 2
    with pytest.raises(ValueError, match="columns differ"):
        synth.check_sample(df, schema, 300)
