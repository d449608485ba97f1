"""Aggregation of client state: means of parameters by rows, and by how alike each client's data are to the whole."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import category, number
from ..functions.tables import melt, row_index
from .fidelity import distances_to_one


def weighted_params(params: DataFrame, weights: DataFrame) -> DataFrame:
    """(param, pos, value): mean over clients. params: (client_id, param, pos, value); weights: (client_id, weight), one row a
    client. Raises where the weights don't add up to more than nothing."""
    got = params.join(weights, "client_id").groupBy("param", "pos").agg(F.sum(F.col("value") * F.col("weight")).alias("total"), F.sum("weight").alias("weights"))
    bad = F.raise_error("the clients' weights add up to nothing").cast("double")
    return got.select("param", "pos", F.when(F.col("weights") > 0, F.col("total") / F.col("weights")).otherwise(bad).alias("value"))


def fedavg(params: DataFrame, counts: DataFrame, weighted: bool = True) -> DataFrame:
    """counts: (client_id, n)."""
    return weighted_params(params, counts.select("client_id", F.col("n").cast("double").alias("weight") if weighted else F.lit(1.0).alias("weight")))


def client_profiles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(client_id, column, category, n, share)."""
    counts = melt(df, cols, ["client_id"], convert=category).groupBy("client_id", "column", F.col("value").alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("client_id", "column")))


def js_distance(profiles: DataFrame, counts: DataFrame) -> DataFrame:
    """(client_id, column, distance): root of the Jensen-Shannon divergence of a client's shares from the mean of all clients,
    weighted by their rows."""
    # categories that a client lacks add what the mean has there, times ln 2; their sum follows from the shares it has
    have = profiles.select("client_id", "column", "category", F.col("share").alias("p")).join(counts.select("client_id", F.col("n").alias("rows")), "client_id")
    total = counts.agg(F.sum("n").alias("all"))
    q = have.groupBy("column", "category").agg(F.sum(F.col("p") * F.col("rows")).alias("q")).crossJoin(F.broadcast(total)).select("column", "category", (F.col("q") / F.col("all")).alias("q"))
    both = have.join(q, ["column", "category"]).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda x: F.sum(F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / F.col("m"))).otherwise(0.0))
    lacks = (1 - F.sum("q")) * F.lit(math.log(2))
    return both.groupBy("client_id", "column").agg(F.sqrt(F.greatest(F.lit(0.0), (part("p") + part("q") + lacks) / 2)).alias("distance"))


def client_wasserstein(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """(client_id, column, distance): one-dimensional distance of a client's numbers from a pooled sample, which has of each
    client the first floor(rows * share of all rows) rows in the order of the key."""
    counts = df.groupBy("client_id").agg(F.count("*").alias("n"))
    total = counts.withColumn("take", F.floor(F.col("n") * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("long"))
    first = row_index(df, [F.col(key)], ["client_id"], "rn").join(total, "client_id").where(F.col("rn") < F.col("take"))
    long = melt(df, cols, ["client_id"], convert=number)
    return distances_to_one(long, melt(first, cols, convert=number), ["client_id"]).select("client_id", "column", F.coalesce("wasserstein", F.lit(0.0)).alias("distance"))


def similarity(distances: DataFrame) -> DataFrame:
    """(client_id, s): distances as shares over the clients of each column (alike where all are 0), summed over columns."""
    by = Window.partitionBy("column")
    share = F.when(F.sum("distance").over(by) > 0, F.col("distance") / F.sum("distance").over(by)).otherwise(F.lit(1.0) / F.count("*").over(by))
    return distances.withColumn("d", share).groupBy("client_id").agg(F.sum("d").alias("s"))


def similarity_weights(s: DataFrame, counts: DataFrame) -> DataFrame:
    """(client_id, weight): softmax over clients of (1 - share of s) times the share of rows; by rows alone where all s are 0."""
    every = Window.partitionBy()  # one row a client
    both = s.join(counts, "client_id").withColumns({"all": F.sum("s").over(every), "rows": F.col("n") / F.sum("n").over(every)})
    z = (1 - F.try_divide(F.col("s"), F.col("all"))) * F.col("rows")
    both = both.withColumn("z", z).withColumn("e", F.exp(F.col("z") - F.max("z").over(every)))
    return both.select("client_id", F.when(F.count("*").over(every) == 1, 1.0).when(F.col("all") > 0, F.col("e") / F.sum("e").over(every)).otherwise(F.col("rows")).alias("weight"))
