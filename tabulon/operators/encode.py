"""Encoders of columns and their inverses. Fitting is an aggregate, transforming a projection or a join with a small table."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import prefixed
from ..functions.tables import as_of, in_ranges, melt, quantiles, row_index, running_sums
from ..sources.scratch import kept


def minmax(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    got = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    return {c: (float(got[f"a{i}"]), float(got[f"b{i}"])) for i, c in enumerate(cols)}


def scale(c: Column, low: float, high: float) -> Column:
    return (c - F.lit(low)) / F.lit(high - low) if high > low else (c - F.lit(low)) * 0.0


def unscale(c: Column, low: float, high: float) -> Column:
    return c * F.lit(high - low) + F.lit(low)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values as text, in order, from 0."""
    values = df.select(F.col(f"`{column}`").cast("string").alias("value")).where("value IS NOT NULL").distinct()
    return row_index(values, [F.col("value")], name="code").withColumn("code", F.col("code").cast("int"))


def unit_code(code: Column, n: int) -> Column:
    return code / F.lit(float(max(1, n - 1)))


def code_of_unit(u: Column, n: int) -> Column:
    """Half to even, as the codes' writer rounds; clipped to the codes."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.bround(u * (n - 1), 0).cast("int")))


def shared_vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(value, code): one code for each prefixed category of all columns."""
    values = df.select(F.explode(F.array(*[prefixed(c) for c in cols])).alias("value")).distinct()
    return row_index(values, [F.col("value")], name="code").withColumn("code", F.col("code").cast("int"))


def quantile_uniform(df: DataFrame, column: str) -> DataFrame:
    """df with u: the middle rank of a value among all, as a share. Distinct values are counted, and only these are in order."""
    counts = df.groupBy(F.col(f"`{column}`").alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL")
    ranks = running_sums(counts, ["n"], [], ["v"]).select("v", F.try_divide(F.col("n_before") + (F.col("n") - 1) / 2.0, F.col("n_all") - 1.0).alias("u"))
    return df.join(ranks, F.col(f"`{column}`") == F.col("v"), "left").drop("v")


def uniform_quantile(df: DataFrame, ranked: DataFrame, u: str, column: str, name: str = "value") -> DataFrame:
    """The inverse of quantile_uniform: df with the value whose share is that of column u, between two shares in proportion;
    beyond the ends the least or the greatest value. ranked: what quantile_uniform gave for the fitted table, with (column, u)."""
    known = ranked.where(f"`{u}` IS NOT NULL").groupBy(F.col(f"`{column}`").cast("double").alias("__v")).agg(F.min(u).alias("__u"))
    asked = df.withColumn("__row", F.monotonically_increasing_id())
    asked = kept(asked, "asked")
    points = known.select("__u", "__v", F.lit(None).cast("long").alias("__row")).union(asked.select(F.col(f"`{u}`").cast("double"), F.lit(None).cast("double"), "__row"))
    rows = in_ranges(points.where("__u IS NOT NULL").withColumn("__own", F.when(F.col("__v").isNotNull(), F.struct("__u", "__v"))), [], ["__u"])
    ends = rows.groupBy("__part").agg(F.max("__own").alias("__low"), F.min("__own").alias("__high"))
    parts = Window.orderBy("__part")  # a row a range
    ends = ends.select("__part", F.max("__low").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("__low"), F.min("__high").over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("__high"))
    own = Window.partitionBy("__part").orderBy("__u")
    low = F.max("__own").over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.min("__own").over(own.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = rows.withColumns({"__a": low, "__b": high}).where("__row IS NOT NULL").join(ends, "__part")
    a, b = F.coalesce("__a", "__low", "__b", "__high"), F.coalesce("__b", "__high", "__a", "__low")
    share = F.when(b["__u"] > a["__u"], (F.col("__u") - a["__u"]) / (b["__u"] - a["__u"])).otherwise(0.0)
    value = a["__v"] + (b["__v"] - a["__v"]) * share
    return asked.join(found.select("__row", value.alias(name)), "__row", "left").drop("__row")


@F.pandas_udf(T.DoubleType())
def normal_share(z: pd.Series) -> pd.Series:
    """The share below a normal number: what takes probit back."""
    return z.map(NormalDist().cdf, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def probit(u: pd.Series) -> pd.Series:
    """The normal quantile of a share, clipped off the ends."""
    inv = NormalDist().inv_cdf
    return u.clip(1e-7, 1 - 1e-7).map(inv, na_action="ignore")


def mode_normalized(x: Column, modes: Column, u: Column) -> Column:
    """modes: array of structs (weight, mean, std). A mode is drawn by its responsibility for x with u; returns a struct (value, mode):
    clip((x - mean) / (4 std), +-0.99) and the mode's place from 0."""
    density = F.transform(modes, lambda m: m["weight"] / m["std"] * F.exp(-0.5 * F.pow((x - m["mean"]) / m["std"], F.lit(2.0))) + 1e-6)
    total = F.aggregate(density, F.lit(0.0), lambda a, b: a + b)
    upto = F.transform(density, lambda d, i: F.aggregate(F.slice(density, F.lit(1), i + 1), F.lit(0.0), lambda a, b: a + b) / total)
    mode = F.least(F.size(F.filter(upto, lambda c: c <= u)), F.size(modes) - 1)
    chosen = F.element_at(modes, mode + 1)
    value = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), (x - chosen["mean"]) / (chosen["std"] * 4)))
    return F.struct(value.alias("value"), mode.alias("mode"))


def mode_denormalized(value: Column, scores: Column, modes: Column) -> Column:
    """The value in the mode with the largest score."""
    at = F.element_at(modes, F.array_position(scores, F.array_max(scores)).cast("int"))
    return at["mean"] + at["std"] * 4 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def category_order(df: DataFrame, column: str) -> DataFrame:
    """(value, place): categories by falling count, ties by value, from 0."""
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return row_index(counts, [-F.col("n"), F.col("value")], name="place").select("value", F.col("place").cast("int").alias("place"))


def one_hot(place: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == place).cast("int"))


def nearest_code(vocabulary: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: (id, column, value). Each value gets the code of its own column next to it, of two as near the lesser: (id, column, value,
    code). Values and codes meet in ranges of both, so a column may have any number of codes."""
    codes = vocabulary.select("column", F.col("code").cast("double").alias("value"), "code", F.lit(1).cast("long").alias("__one"))
    marks = running_sums(codes, ["__one"], ["column"], ["value"], following=True).select("column", "value", "code", F.col("next").alias("__next"))
    ends = codes.groupBy("column").agg(F.min("code").alias("__first"))  # a row a column
    found = as_of(marks, rows.select("id", "column", F.col("value").cast("double").alias("value")), ["column"], "value", ["code", "__next"]).join(F.broadcast(ends), "column")
    upper = F.col("__next") - F.col("value") < F.col("value") - F.col("code")
    code = F.when(F.col("code").isNull(), F.col("__first")).when(upper, F.col("__next").cast("int")).otherwise(F.col("code"))
    return found.select("id", "column", "value", code.cast(vocabulary.schema["code"].dataType).alias("code"))


def mixture_start(df: DataFrame, cols: Sequence[str], modes: int) -> DataFrame:
    """(column, mode, weight, mean, std): a mixture's start, its means at even quantiles."""
    from ..functions.exprs import number

    shares = [(i + 0.5) / modes for i in range(modes)]
    long = melt(df, cols, convert=number).where("value IS NOT NULL")
    got = quantiles(long, ["column"], shares).withColumnRenamed("quantiles", "q").join(long.groupBy("column").agg(F.stddev_pop("value").alias("s")), "column")
    return got.select("column", F.posexplode("q").alias("mode", "mean"), F.greatest("s", F.lit(1e-6)).alias("s")).select("column", "mode", F.lit(1.0 / modes).alias("weight"), "mean", (F.col("s") / modes + 1e-6).alias("std"))


def responsibilities(long: DataFrame, params: DataFrame) -> DataFrame:
    """long: (*keys, column, value). (*, mode, r): how much each mode of a column answers for a value; params is a small table."""
    array = params.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("mode", "weight", "mean", "std"))).alias("modes"))
    density = F.transform("modes", lambda m: m["weight"] / m["std"] * F.exp(-0.5 * F.pow((F.col("value") - m["mean"]) / m["std"], F.lit(2.0))) + 1e-12)
    both = long.join(F.broadcast(array), "column").withColumn("d", density)
    both = both.withColumn("t", F.aggregate("d", F.lit(0.0), lambda a, b: a + b))
    return both.select(*long.columns, F.posexplode("d").alias("mode", "x"), "t").withColumn("r", F.col("x") / F.col("t")).drop("x", "t")
