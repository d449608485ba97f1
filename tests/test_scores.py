"""Known answers of the evaluators, and: the clients' exact merges equal the whole."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.schema import ColumnSchema, TableSchema
from tabulon.functions.tables import melt
from tabulon.operators import fidelity, learn, privacy, scores, split


def frame(spark, xs, name="x"):
    return spark.createDataFrame([(float(x) if x is not None else None,) for x in xs], f"{name} double")


def gaps(real, syn, cols=("x",)):
    m = lambda df: fidelity.moments(fidelity.numbers(df, cols))
    return tuple(fidelity.moment_gaps(m(real), m(syn)).first())


def test_moments(spark):
    a = frame(spark, range(1, 13))
    assert gaps(a, a) == (0, 0) and gaps(a, frame(spark, range(4, 16))) == (3, 0)
    assert gaps(frame(spark, [1, 2, None, float("nan")]), frame(spark, [1.5]))[0] == 0
    assert gaps(a, frame(spark, [2]))[1] is None


def test_distances(spark):
    one = lambda a, b: fidelity.distances(melt(a, ["x"]), melt(b, ["x"])).first()
    a, b = frame(spark, range(100)), frame(spark, range(1, 101))
    assert math.isclose(one(a, b)["wasserstein"], 1.0) and one(a, a)["ks"] == 0
    rng = np.random.default_rng(1)
    assert one(frame(spark, rng.normal(size=500)), frame(spark, rng.normal(100, 1, 500)))["ks"] > 0.99
    assert one(frame(spark, [1, 1]), frame(spark, [1, 1]))["t_stat"] is None


def test_total_variation(spark):
    tv = lambda a, b: fidelity.total_variation(*[fidelity.category_counts(spark.createDataFrame([(x,) for x in s], "c string"), ["c"]) for s in (a, b)]).first()["tv"]
    assert tv("AABB", "AAAA") == 0.5 and tv("AAA", "BBB") == 1 and tv(["A", None], [None, "A"]) == 0


def test_correlation(spark):
    a = spark.range(50).select(F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    gap = lambda s, cols=("a", "b"): fidelity.correlation_gap(a, s, list(cols)).first()[0]
    assert math.isclose(gap(a.withColumn("b", -F.col("a"))), 2 * math.sqrt(2)) and gap(a) == 0
    assert gap(a.withColumn("b", F.lit(1.0))) is None


@pytest.mark.parametrize("part", [split.part_iid, split.part_linear, split.part_exponential])
def test_exact_merges_equal_the_whole(spark, part):
    df = spark.range(600).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") % 5).cast("string").alias("c"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") * 7 % 3 == 0).cast("int").alias("pred"), (F.col("id") % 4).cast("string").alias("group"))
    df = part(df, 4, "id", 1)
    whole = fidelity.moments(fidelity.numbers(df, ["x"])).first()
    merged = fidelity.merge_moments(fidelity.moments(fidelity.numbers(df, ["x"], ["client_id"]), ["client_id"])).first()
    assert all(math.isclose(whole[k], merged[k], rel_tol=1e-9) for k in ("n", "mean", "m2"))
    counts = lambda d: sorted(map(tuple, d.select("column", "category", "n").collect()))
    assert counts(fidelity.category_counts(df, ["c"])) == counts(fidelity.merge_counts(fidelity.category_counts(df, ["c"], ["client_id"])))
    cells = lambda d: sorted(map(tuple, d.select("group", "tp", "fp", "tn", "fn").collect()))
    assert cells(scores.confusion(df, [])) == cells(scores.merge_confusion(scores.confusion(df, least=0)))


def test_auc(spark):
    auc = lambda rows: scores.roc_auc(spark.createDataFrame(rows, "score double, label int")).first()[0]
    assert auc([(0.1, 0), (0.9, 1)]) == 1 and auc([(0.5, 0), (0.5, 1)]) == 0.5 and auc([(0.5, 1)]) is None
    assert auc([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 1)]) == 0.875


def test_overlap(spark):
    rows = [(i % 2, i, f"v{i}", i / 3) for i in range(100)]
    train = spark.createDataFrame(rows, "client_id int, a int, b string, c double")
    rate = lambda syn: privacy.overlap_rates(train, syn, ["a", "b", "c"], ["a", "b"]).first()
    same = train.drop("client_id")
    assert rate(same)["exact_row_match_rate_train"] == 1 and rate(same)["partial_match_any"] == 1
    far = same.withColumn("a", F.col("a") + 1000)
    assert rate(far)["exact_row_match_rate_train"] == 0 and rate(far)["exact_row_match_any"] == 0
    half = same.union(far)
    assert rate(half)["exact_row_match_rate_train"] == 0.5
    assert privacy.overlap_rates(train.union(train.withColumn("client_id", F.lit(5))), same, ["a", "b", "c"], ["a"]).first()[0] == 2


def test_overlap_is_of_equal_doubles(spark):
    train = spark.createDataFrame([(0, 1.0, "a"), (0, 5.1, "b"), (0, 0.0, "c"), (0, float("nan"), "d"), (0, 8.0, "e")], "client_id int, x double, t string")
    syn = spark.createDataFrame([(1.0 + 1e-10, "a"), (5.1, "b"), (5.1 + 1e-15, "b"), (-0.0, "c"), (None, "d")], "x double, t string")
    assert {(r["top"], r["matches"]) for r in privacy.partial_overlaps(train, syn, ["x"]).collect()} == {(1, 3), (2, 3), (3, 3)}
    assert [r["matches"] for r in privacy.overlap(train, syn, ["x", "t"]).collect()] == [3]
    assert privacy.distinct_ratios(train.withColumn("x", F.lit(2.0) + F.monotonically_increasing_id() % 2 * 1e-10), ["x"]).first()["ratio"] > 0.2


def test_membership(spark):
    rng = np.random.default_rng(2)
    table = lambda n, at: spark.createDataFrame([(at + i, *map(float, r)) for i, r in enumerate(rng.random((n, 4)))], "k int, a double, b double, c double, d double")
    members, others, rest = table(200, 0), table(200, 1000), table(400, 5000)
    cols = ["a", "b", "c", "d"]
    mia = lambda syn: privacy.membership_scores(privacy.nearest_distances(privacy.probe(members, others, "k"), syn, cols)).first()
    memorized = mia(members.union(rest).select(*cols))
    assert memorized["mia_auc"] > 0.7 and memorized["mia_advantage"] > 0
    assert 0.35 < mia(rest.select(*cols))["mia_auc"] < 0.65
    assert privacy.membership_scores(privacy.nearest_distances(privacy.probe(members.limit(0), others, "k"), rest, cols)).first()["mia_auc"] is None


def table_of(spark, n, seed, noise=0.3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    rows = [(float(t * 2 - 1 + rng.normal(0, noise)), "uv"[int(rng.random() < 0.5)], int(t), float(3 * t + 1 + rng.normal(0, 0.01)), "lmn"[int(rng.integers(0, 3))]) for t in y]
    return spark.createDataFrame(rows, "x double, c string, y int, z double, m string").withColumn("client_id", (F.col("x") > 0).cast("int"))


SCHEMA = TableSchema((ColumnSchema("x", "continuous"), ColumnSchema("c", "categorical"), ColumnSchema("y", "binary"), ColumnSchema("z", "continuous"), ColumnSchema("m", "categorical")))


def test_tstr_and_inference(spark):
    syn, real = table_of(spark, 300, 1), table_of(spark, 200, 2)
    got = learn.tstr(syn.drop("z"), real, SCHEMA, "y").first()
    assert got["tstr_auc"] > 0.95 and got["tstr_accuracy"] is None and got["n"] == 200
    assert learn.tstr(syn, real, SCHEMA, "z").first()["tstr_rmse"] < 0.1
    assert learn.tstr(syn.withColumn("y", F.lit(1)), real, SCHEMA, "y").first()["tstr_auc"] is None
    three = learn.attribute_inference(syn, real, SCHEMA, "m", "c").first()
    assert three["aia_auc"] is None and 0.15 < three["aia_accuracy"] < 0.55
    two = learn.attribute_inference(syn, real, SCHEMA, "y", "c").first()
    assert two["aia_auc"] > 0.95 and two["aia_accuracy"] > 0.95


def test_regressions_have_the_stated_penalty(spark):
    df = table_of(spark, 120, 3)
    fitted = learn.fit_ridge(df.select("x", "z"), SCHEMA, "z")
    x = np.array([r["x"] for r in df.collect()])
    z = np.array([r["z"] for r in df.collect()])
    s = (x - x.mean()) / x.std()
    w = (s @ (z - z.mean())) / (s @ s + 1.0)
    assert math.isclose(fitted.model.coefficients[0], w, rel_tol=1e-6)
    fitted = learn.fit_classifier(df.select("x", "y"), SCHEMA, "y")
    y = np.array([r["y"] for r in df.collect()])
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * s + b)))
        g = np.array([(s * (p - y)).sum() + a, (p - y).sum()])
        h = np.array([[(s * s * p * (1 - p)).sum() + 1, (s * p * (1 - p)).sum()], [(s * p * (1 - p)).sum(), (p * (1 - p)).sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    assert math.isclose(fitted.model.coefficients[0], a, rel_tol=1e-5)


def test_fairness(spark):
    rng = np.random.default_rng(4)
    rows = [(float(rng.normal(3 if g else -3, 0.5)), str(g), g) for g in (0, 1) for _ in range(80)]
    df = spark.createDataFrame(rows, "f double, s string, y int")
    schema = TableSchema((ColumnSchema("f", "continuous"), ColumnSchema("s", "binary"), ColumnSchema("y", "binary")))
    gaps_ = scores.fairness_gaps(learn.fairness_cells(df, df, schema, "s", "y")).first()
    assert gaps_["demographic_parity_diff"] > 0.3
    assert scores.confusion(df.select(F.col("y").alias("label"), F.col("y").alias("pred"), F.col("s").alias("group")).limit(20), []).count() == 0
