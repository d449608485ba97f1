"""Fidelity of a synthetic table: moments, distributions, categories, correlations; whole, and by client with merges.

Inputs are melted tables (keys, column, value), so that one job serves all columns. A synthetic table is taken once, not once
a client: clients' values look it up. Moments and categories merge exactly; the rest is a mean weighted by rows and only approximates the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import category, finite, number, weighted_mean
from ..functions.tables import as_of, cdf, melt, running_sums
from ..sources.scratch import kept
from .clean import non_constant, sanitize_numeric


def moments(melted: DataFrame, keys: Sequence[str] = (), whole_too: bool = False) -> DataFrame:
    """(*keys, column, n, mean, m2): count, mean and sum of squared deviations. whole_too: also over all keys, which are null there,
    in the same pass."""
    by = [*keys, "column"]
    groups = melted.groupingSets([[F.col(c) for c in by], [F.col("column")]], *by) if whole_too else melted.groupBy(*by)
    return groups.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))


def merge_moments(partial: DataFrame) -> DataFrame:
    """Moments of all clients together, exactly, from theirs: (column, n, mean, m2)."""
    whole = partial.where("n > 0").groupBy("column").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("m2").alias("inner"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"))
    between = F.greatest(F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    return whole.select("column", "n", "mean", (F.col("inner") + between).alias("m2"))


def moment_gaps(real: DataFrame, syn: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, mean_abs_diff, std_abs_diff): mean over columns of the gaps of means and of sample deviations."""
    std = lambda p: F.when(F.col(f"{p}.n") >= 2, F.sqrt(F.col(f"{p}.m2") / (F.col(f"{p}.n") - 1)))
    both = real.alias("r").join(syn.alias("s"), F.col("r.column") == F.col("s.column"))
    rows = both.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.abs(F.col("r.mean") - F.col("s.mean")).alias("m"), F.abs(std("r") - std("s")).alias("d"))
    return rows.groupBy(*keys).agg(F.avg("m").alias("mean_abs_diff"), F.avg("d").alias("std_abs_diff"))


def distances(real: DataFrame, syn: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, column, ks, wasserstein, t_stat) of sanitized melted tables; syn without keys is compared with each of them."""
    keys = list(keys)
    if keys:
        gaps = kept(distances_to_one(real, syn, keys), "distances")  # else its plan is made anew with each stage of the rest
    else:
        both = cdf(real, syn, ["column"])
        gap = F.abs(F.col("f_real") - F.col("f_syn"))
        gaps = both.groupBy("column").agg(F.max(gap).alias("ks"), F.sum(gap * (F.col("next") - F.col("value"))).alias("wasserstein"))
    part = lambda df, p, by: df.groupBy(*by).agg(F.count("value").alias(f"n_{p}"), F.avg("value").alias(f"mean_{p}"), F.var_samp("value").alias(f"var_{p}"))
    t = part(real, "r", [*keys, "column"]).join(F.broadcast(part(syn, "s", ["column"])), "column")  # a row a column
    stat = F.try_divide(F.abs(F.col("mean_r") - F.col("mean_s")), F.sqrt(F.col("var_r") / F.col("n_r") + F.col("var_s") / F.col("n_s")))
    return gaps.join(t.select(*keys, "column", stat.alias("t_stat")), [*keys, "column"])


def distances_to_one(real: DataFrame, syn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, column, ks, wasserstein): each key's distribution against the one of syn. real: (*keys, column, value); syn: (column, value).

    The synthetic values are counted and put in order once. Each distinct value of a key then looks up what lies at or before it, and
    where the synthetic share crosses the key's own, in joins by ranges; syn isn't copied for the keys. Between two values of a key
    its share is constant, so the gap is largest at an end, and the area between is that of the synthetic share's integral."""
    keys = list(keys)
    # a row a column; sums of values near zero keep their digits. Written, as a mean that is worked out again may differ in its last bit,
    # and then no value of a key would be equal to a synthetic one
    base = kept(syn.groupBy("column").agg(F.avg("value").alias("base")), "base")
    near = lambda df: df.where("value IS NOT NULL").join(F.broadcast(base), "column").withColumn("value", F.col("value") - F.col("base")).drop("base")
    counts = near(syn).groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("m", F.col("n") * F.col("value"))
    order = running_sums(counts, ["n", "m"], ["column"], ["value"])
    marks = order.select("column", "value", F.col("value").alias("mark"), F.col("n_before").alias("low"), (F.col("n_before") + F.col("n")).alias("high"), F.col("m_before").alias("low_sum"), (F.col("m_before") + F.col("m")).alias("high_sum"), F.col("n_all").alias("s_all"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("s_all"), F.sum("m").alias("s_sum"))
    own = running_sums(near(real).groupBy(*keys, "column", "value").agg(F.count("*").alias("n")), ["n"], [*keys, "column"], ["value"], following=True)
    own = own.select(*keys, "column", "value", "next", (F.col("n_before") / F.col("n_all")).alias("before"), ((F.col("n_before") + F.col("n")) / F.col("n_all")).alias("share"), (F.col("n_before") == 0).alias("first"))
    here = as_of(marks, own, ["column"], "value", ["mark", "low", "high", "high_sum"])
    crossing = marks.select("column", (F.col("low") / F.col("s_all")).alias("share"), F.col("mark").alias("x"), F.col("low").alias("x_low"), F.col("low_sum").alias("x_sum"))
    rows = as_of(crossing, here, ["column"], "share", ["x", "x_low", "x_sum"]).join(F.broadcast(totals), "column")

    v, nxt, c, all_ = F.col("value"), F.col("next"), F.col("share"), F.col("s_all")
    upto = F.coalesce(F.col("high"), F.lit(0)) / all_
    below = F.when(F.col("mark") == v, F.col("low") / all_).otherwise(upto)
    area = v * upto - F.coalesce(F.col("high_sum"), F.lit(0.0)) / all_  # of the synthetic share, up to the value
    ks = F.greatest(F.abs(c - upto), F.abs(F.col("before") - below))
    # the interval before a value: where the share stayed below the key's, its area counts the other way
    left = F.when(F.col("first") | (below > F.col("before")), area).otherwise(-area)
    tail = (F.col("s_sum") - F.coalesce(F.col("high_sum"), F.lit(0.0))) / all_ - v * (1 - upto)
    x = F.col("x")
    inside = F.when(x >= nxt, c * (nxt - v)).when(x <= v, c * (v - nxt) - 2 * area).otherwise(c * (2 * x - v - nxt) - 2 * (x * F.col("x_low") - F.col("x_sum")) / all_)
    right = F.when(nxt.isNull(), tail).otherwise(area + inside)
    return rows.groupBy(*keys, "column").agg(F.max(ks).alias("ks"), F.greatest(F.sum(left + right), F.lit(0.0)).alias("wasserstein"))


def distance_means(real: DataFrame, syn: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, ks_mean, wasserstein_mean, t_stat_mean_abs, n): over columns, after rows with odd numbers are dropped."""
    r = sanitize_numeric(real.select(*keys, *cols), cols)
    got = distances(melt(r, cols, keys), melt(sanitize_numeric(syn.select(*cols), cols), cols), keys)
    means = got.groupBy(*keys).agg(F.avg("ks").alias("ks_mean"), F.avg("wasserstein").alias("wasserstein_mean"), F.avg("t_stat").alias("t_stat_mean_abs"))
    counts = r.groupBy(*keys).agg(F.count("*").alias("n"))
    return means.join(counts, list(keys)) if keys else means.crossJoin(F.broadcast(counts))


def distance_means_federated(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Weighted by each client's rows; approximates the whole."""
    by = distance_means(real, syn, cols, ["client_id"])
    return by.agg(*[weighted_mean(F.col(c), F.col("n")).alias(c) for c in ("ks_mean", "wasserstein_mean", "t_stat_mean_abs")])


def category_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), whole_too: bool = False) -> DataFrame:
    """(*keys, column, category, n). whole_too: also over all keys, which are null there, in the same pass."""
    long, by = melt(df, cols, keys, convert=category).withColumnRenamed("value", "category"), [*keys, "column", "category"]
    groups = long.groupingSets([[F.col(c) for c in by], [F.col("column"), F.col("category")]], *by) if whole_too else long.groupBy(*by)
    return groups.agg(F.count("*").alias("n"))


def total_variation(real: DataFrame, syn: DataFrame) -> DataFrame:
    """(column, tv): half the summed gaps of category shares. real, syn: (column, category, n)."""
    share = lambda df, p: df.join(df.groupBy("column").agg(F.sum("n").alias("all")), "column").select("column", "category", (F.col("n") / F.col("all")).alias(p))
    both = share(real, "p").join(share(syn, "q"), ["column", "category"], "full_outer")
    return both.groupBy("column").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) * 0.5).alias("tv"))


def merge_counts(partial: DataFrame) -> DataFrame:
    """Category counts of all clients together, exactly."""
    return partial.groupBy("column", "category").agg(F.sum("n").alias("n"))


def correlation_gap(real: DataFrame, syn: DataFrame, cols: Sequence[str]) -> DataFrame:
    """corr_fro_diff: Frobenius norm of the difference of the correlation matrices over columns that vary in both tables;
    null for fewer than two. One aggregate of each table."""
    cols = non_constant(real, syn, cols)
    spark = real.sparkSession
    if len(cols) < 2:
        return spark.range(1).select(F.lit(None).cast("double").alias("corr_fro_diff"))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]

    def corrs(df: DataFrame, p: str) -> DataFrame:
        d = df.select(*[finite(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
        return d.agg(*[F.corr(F.when(F.col(f"c{j}").isNotNull(), F.col(f"c{i}")), F.when(F.col(f"c{i}").isNotNull(), F.col(f"c{j}"))).alias(f"{p}{i}_{j}") for i, j in pairs])

    total = sum((F.coalesce(F.pow(F.col(f"r{i}_{j}") - F.col(f"s{i}_{j}"), F.lit(2.0)), F.lit(0.0)) for i, j in pairs), F.lit(0.0))
    return corrs(real, "r").crossJoin(F.broadcast(corrs(syn, "s"))).select(F.sqrt(total * 2).alias("corr_fro_diff"))


def numbers(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Melted numbers, with missing ones left out column by column."""
    return melt(df, cols, keys, convert=number).where("value IS NOT NULL")
