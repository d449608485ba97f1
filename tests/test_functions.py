"""Schema kinds, cleaning, row numbers, keys."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tabulon.functions import exprs, schema, tables
from tabulon.operators import clean, encode, metrics
from tabulon.sources import tables as io


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, 20.5 + i, i % 2, "abcd"[i % 4]) for i in range(12)]
    return spark.createDataFrame(rows, "id int, age double, label int, cat string")


def test_kinds(spark, frame):
    assert {c.name: c.kind for c in schema.infer_schema(frame).columns} == {"id": "integer", "age": "continuous", "label": "binary", "cat": "categorical"}
    holes = frame.withColumn("id", F.when(F.col("id") != 3, F.col("id"))).withColumn("none", F.lit(None).cast("double")).withColumn("ph.ecog", F.col("id"))
    kinds = {c.name: c.kind for c in schema.infer_schema(holes).columns}
    assert kinds["id"] == "continuous" and kinds["none"] == "binary" and kinds["ph.ecog"] == "continuous"
    with pytest.raises(ValueError, match="nested"):
        schema.infer_schema(frame.withColumn("m", F.array("id")))


def test_schema_file(spark, frame, tmp_path):
    s = schema.infer_schema(frame)
    (tmp_path / "s.json").write_text(schema.to_json(s))
    assert schema.load_or_infer(spark, str(tmp_path / "s.json"), frame) == s
    assert s.numeric_columns(frame.drop("age")) == ["id"] and s.nominal_columns(frame) == ["label", "cat"]
    for key in ("schema_format", "schema_format_version"):
        with pytest.raises(ValueError, match="unknown schema"):
            schema.from_json(json.dumps(json.loads(schema.to_json(s)) | {key: "other"}))
    assert s.tagged(frame).schema["age"].metadata == {"kind": "continuous"}
    with pytest.raises(ValueError, match="missing: nope"):
        schema.require_columns(frame, "id", "nope")


def test_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, float("inf")), (None, 2.0)], "k int, x double")
    assert tuple(clean.missing_counts(df).first()) == (5, 2, 3)
    assert clean.drop_missing(df).count() == 2
    assert [r["k"] for r in clean.sanitize_numeric(df, ["x"]).collect()] == [1, None]
    texts = spark.createDataFrame([("1.5",), ("x",), (None,)], "x string")
    assert clean.sanitize_numeric(texts, ["x"]).count() == 1
    assert clean.non_constant(df.where("k = 1"), df, ["x"]) == []


def test_prefixes(spark):
    df = spark.createDataFrame([("a",), (None,)], "c string")
    there = clean.add_prefixes(df, ["c"])
    assert [r[0] for r in there.collect()] == ["c_a", "c_nan"]
    assert [r[0] for r in clean.remove_prefixes(there, ["c"]).collect()] == ["a", None]


def test_row_index(spark):
    df = spark.range(500).withColumn("x", (F.col("id") * 7919 % 100).cast("double")).withColumn("g", F.col("id") % 3)
    got = tables.row_index(df, [F.col("x"), F.col("id")]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(500))
    assert [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)
    by = tables.row_index(df, [F.col("x"), F.col("id")], ["g"]).collect()
    for g in range(3):
        mine = sorted((r for r in by if r["g"] == g), key=lambda r: r["idx"])
        assert [r["idx"] for r in mine] == list(range(len(mine))) and [(r["x"], r["id"]) for r in mine] == sorted((r["x"], r["id"]) for r in mine)


def test_csv_and_sinks(spark, frame, tmp_path):
    io.write_csv(frame, str(tmp_path / "t"))
    assert sorted(map(tuple, io.load_csv(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, frame.collect()))
    m = spark.createDataFrame([("a", "k", float("nan")), ("a", "l", 1.5)], "mode string, key string, value double")
    io.write_metrics(m, str(tmp_path / "m"))
    assert {r["key"]: r["value"] for r in spark.read.json(str(tmp_path / "m")).collect()} == {"k": None, "l": 1.5}
    with pytest.raises(Exception, match="infinite"):
        io.write_metrics(m.withColumn("value", F.lit(float("inf"))), str(tmp_path / "n"))
    io.write_run(spark, str(tmp_path / "runs"), "r1", {"rounds": "3"}, schema.infer_schema(frame), ["x"])
    with pytest.raises(Exception, match="(?i)exists"):
        io.write_run(spark, str(tmp_path / "runs"), "r1", {}, schema.infer_schema(frame), [])


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (float("nan"), 9.0), (None, 9.0), (50.0, 0.0), (50.0, -1.0), (50.0, None)], "v double, w double")
    assert df.agg(exprs.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 2.5
    assert df.where("1 = 0").agg(exprs.weighted_mean(F.col("v"), F.col("w"))).first()[0] is None


def test_keys(spark):
    got = spark.createDataFrame([("Ph.Ecog 2",), ("x1",)], "k string").select(exprs.normalized_key(F.col("k"))).collect()
    assert [r[0] for r in got] == ["ph_ecog_", "x_"]
    with pytest.raises(ValueError, match="one key"):
        metrics.declared(["fairness"], ["x1", "x2"])
    assert metrics.declared(["fairness"], ["Sex"])[0] == "fairness.demographic_parity_diff.sex"
    a, b = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in ("ab", "bc"))
    assert sorted(map(tuple, metrics.key_differences(a, b).collect())) == [("a", "undeclared"), ("c", "missing")]
    merged = metrics.merge_metrics(a.withColumn("value", F.lit(1.0)), b.withColumn("value", F.lit(2.0)))
    assert {r["key"]: r["value"] for r in merged.collect()} == {"a": 1.0, "b": 2.0, "c": 2.0}
    assert metrics.direction("utility.tstr_auc") and metrics.direction("utility.tstr_rmse") is False and metrics.direction("scalability.bytes_sent") is None


def test_hash_is_uniform(spark):
    u = [r[0] for r in spark.range(4000).select(exprs.hash_u01(1, F.col("id"))).collect()]
    assert 0 <= min(u) and max(u) < 1 and math.isclose(sum(u) / len(u), 0.5, abs_tol=0.02)


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 500).cast("double").alias("v"), F.lit(2).alias("n")).groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = tables.running_sums(df, ["n"], ["g"], ["v"], following=True).collect()
    for g in range(3):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["v"])
        before = 0
        for r, after in zip(mine, [*mine[1:], None], strict=True):
            assert (r["n_before"], r["n_all"], r["next"]) == (before, sum(x["n"] for x in mine), after["v"] if after else None)
            before += r["n"]


def test_quantiles(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 9, 2)] + [("b", 3.0), ("b", None)]
    got = dict(tables.quantiles(spark.createDataFrame(rows, "k string, value double"), ["k"], [0, 0.25, 0.5, 0.6, 1]).collect())
    assert got == {"a": [1.0, 1.0, 2.0, pytest.approx(3.2), 9.0], "b": [3.0] * 5}


def test_schema_file(spark, frame, tmp_path):
    path = str(tmp_path / "schema")
    made = io.write_schema(frame, path)
    assert schema.load_or_infer(spark, path, frame) == made
    with pytest.raises(Exception, match=r"(?i)already exists"):
        io.write_schema(frame, path)
    assert io.write_schema(frame, path, overwrite=True) == made


def test_quantile_transform_and_its_inverse(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6])], "id long, x double")
    ranked = encode.quantile_uniform(df, "x")
    back = encode.uniform_quantile(ranked.drop("x"), ranked, "u", "x").orderBy("id").collect()
    assert [r["value"] for r in back] == [3, 1, 4, 1, 5, 9, 2, 6]
    asked = spark.createDataFrame([(0, -1.0), (1, 2.0), (2, None), (3, 0.5)], "id long, u double")
    got = {r["id"]: r["value"] for r in encode.uniform_quantile(asked, ranked, "u", "x").collect()}
    assert got == {0: 1.0, 1: 9.0, 2: None, 3: pytest.approx(3.5)}
    z = ranked.select("u", encode.normal_share(encode.probit("u")).alias("v"))
    assert all(abs(r["v"] - min(max(r["u"], 1e-7), 1 - 1e-7)) < 1e-9 for r in z.collect())
