"""Column expressions that the operators share. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    """NaN counts as missing: one NaN would turn an average into NaN."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """A double, or null for what is no number, NaN or infinite."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def number(c: Column) -> Column:
    """A double, or null for what is no number or NaN; infinities stay."""
    return null_if_nan(c.try_cast("double"))


def hash_u01(seed: int, key: Column) -> Column:
    """A uniform number in [0, 1) from a seed and a key, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value times weight over the sum of weights, without missing values and weights that aren't positive."""
    v, w = null_if_nan(value), null_if_nan(weight)
    ok = v.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def normalized_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z_]+", "_")


def category(c: Column) -> Column:
    """A value as a category; missing is one of its own."""
    return F.coalesce(c.cast("string"), F.lit("__NA__"))


def prefixed(name: str) -> Column:
    """A category with its column's name before it."""
    return F.concat(F.lit(f"{name}_"), F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan")))


def canonical(name: str, kind: str) -> Column:
    """A value as text that is equal for equal values of either table. kind: double (to eight places), exact (a double to its last bit),
    integer, boolean or string."""
    c = F.col(f"`{name}`")
    if kind == "exact":
        return F.coalesce((null_if_nan(c) + 0.0).cast("string"), F.lit("__NaN__"))  # adding 0 makes both zeros one
    if kind == "double":
        d = null_if_nan(c)
        return F.when(d.isNotNull(), F.format_string("%.8f", d)).otherwise("__NaN__")  # format_string writes a null out
    if kind == "boolean":
        return F.coalesce(c.cast("int").cast("string"), F.lit("__NaN__"))
    if kind == "integer":
        return F.coalesce(c.cast("string"), F.lit("__NaN__"))
    return F.coalesce(F.trim(c.cast("string")), F.lit("__NaN__"))
