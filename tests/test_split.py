"""Splits and client partitioners: sizes, skew, every row once."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import split


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(1000).select("id", F.col("id").cast("double").alias("value"), (F.col("id") % 3).cast("string").alias("label")).cache()


def sizes(df):
    got = {r["client_id"]: r["count"] for r in df.groupBy("client_id").count().collect()}
    return [got.get(i, 0) for i in range(max(got) + 1)]


def test_holdout(spark, pool):
    got = split.holdout_split(pool.limit(997), "id", 0.2, 1)
    assert got.where("split = 'holdout'").count() == math.ceil(0.2 * 997) and got.select("id").distinct().count() == 997
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, split.holdout_split(pool.limit(997).repartition(7), "id", 0.2, 1).collect()))


def test_client_split_sorts_little(spark, monkeypatch):
    """Of 20,000 rows only those of the hash ranges that the cuts fall into are put in order, and the split is that of all keys in order."""
    df = spark.range(20000).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("int")).alias("client_id")).cache()
    put, index = [], split.row_index
    monkeypatch.setattr(split, "row_index", lambda rows, *a, **k: (put.append(rows.count()), index(rows, *a, **k))[1])
    got = {r["id"]: r["split"] for r in split.client_split(df, "id", 0.2, 7).collect()}
    assert len(got) == 20000 and put and sum(put) < 200
    order = df.select("client_id", split.hash_u01(7, F.col("id")).alias("u"), "id").collect()
    for client in (None, 1, 2, 3):
        ids = [r["id"] for r in sorted((r for r in order if r["client_id"] == client), key=lambda r: (r["u"], r["id"]))]
        assert [got[i] for i in ids] == ["test"] * 1000 + ["train"] * 4000


def test_client_split(pool):
    got = split.client_split(split.part_linear(pool, 3, "id", 1), "id", 0.25, 2)
    for r in got.groupBy("client_id").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == math.ceil(0.25 * r["n"])
    assert split.all_train(got).count() == got.where("split = 'train'").count()


def test_sized(pool):
    assert max(sizes(split.part_iid(pool, 7, "id", 1))) - min(sizes(split.part_iid(pool, 7, "id", 1))) <= 1
    for part in (split.part_linear, split.part_square, split.part_exponential):
        got = sizes(part(pool, 4, "id", 1))
        assert sum(got) == 1000 and got == sorted(got) and min(got) > 0


def test_dirichlet(pool):
    got = split.part_dirichlet(pool, 4, "label", "id", 3, alpha=0.5)
    assert sum(sizes(got)) == 1000 and min(sizes(got)) >= 10 and got.select("id").distinct().count() == 1000
    with pytest.raises(ValueError, match="no draw"):
        split.part_dirichlet(pool.limit(20), 4, "label", "id", 3, tries=1)


def labels_by_client(df):
    out = defaultdict(set)
    for r in df.select("client_id", "label").distinct().collect():
        out[r["client_id"]].add(r["label"])
    return out


def test_pathological(pool):
    got = split.part_pathological(pool, 3, "label", "id", 3, classes_each=2)
    assert sum(sizes(got)) == 1000 and min(sizes(got)) > 0 and all(len(x) <= 2 for x in labels_by_client(got).values())


def test_shard(pool):
    got = split.part_shard(pool, 5, "label", "id", 3, shards_each=1)
    assert sum(sizes(got)) == 1000 and any(len(x) < 3 for x in labels_by_client(got).values())


def test_continuous(pool):
    got = split.part_continuous(pool, 4, "value", "id", 3, strictness=0.9)
    means = [r[0] for r in got.groupBy("client_id").agg(F.avg("value")).orderBy("client_id").select("avg(value)").collect()]
    assert sum(sizes(got)) == 1000 and means == sorted(means) and means[-1] - means[0] > 300


def test_samples(pool):
    assert split.sample_rows(pool, "id", 37, 5).count() == 37 and split.sample_rows(pool, "id", 5000, 5).count() == 1000
    got = split.balanced_resample(pool, "id", ["label"], 300, 9).collect()
    assert len(got) == 300 and all(str(r["id"] % 3) == r["category"] for r in got)
    w = {r["category"]: r["weight"] for r in split.category_weights(pool, ["label"]).collect()}
    assert math.isclose(sum(w.values()), 1.0)


def test_class_owners():
    classes = list("abcd")
    assert split.class_owners(classes, 3, 2) == {"a": [0, 2], "b": [0, 2], "c": [1], "d": [1]}
    for mode in ("random", "first-deterministic"):
        owners = split.class_owners(classes, 6, 2, mode, seed=3)
        assert sorted(i for o in owners.values() for i in o) == sorted([*range(6)] * 2) and all(len(o) == len(set(o)) for o in owners.values())
        assert owners == split.class_owners(classes, 6, 2, mode, seed=3)
    assert all(i in split.class_owners(classes, 6, 2, "first-deterministic", 3)[classes[i % 4]] for i in range(6))
    with pytest.raises(ValueError, match="mode"):
        split.class_owners(classes, 2, 1, "other")


def test_shares_that_balance_themselves():
    counts = {c: 1000 for c in "abcdef"}
    size = lambda shares: np.sum([np.array(s) * 1000 for s in shares.values()], axis=0)
    plain, even = split.dirichlet_shares(counts, 4, 0.1, 5), split.dirichlet_shares(counts, 4, 0.1, 5, self_balancing=True)
    assert all(np.isclose(sum(s), 1) for s in [*plain.values(), *even.values()])
    assert np.ptp(size(even)) < np.ptp(size(plain))


def test_shards_of_a_size(spark):
    df = spark.range(95).withColumn("c", F.col("id") % 2)
    sizes = lambda **k: sorted(r["count"] for r in split.part_shard(df, 3, "c", "id", 1, **k).groupBy("client_id").count().collect())
    assert sizes(shards_each=None, shard_size=10) == [30, 30, 30]
    assert sum(sizes(shards_each=None, shard_size=10, keep_incomplete=True)) == 95
    assert sizes(shards_each=2, shard_size=10) == [20, 20, 20]
    with pytest.raises(ValueError, match="too few"):
        sizes(shards_each=4, shard_size=10)
