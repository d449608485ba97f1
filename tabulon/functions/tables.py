"""Table shapes that the operators share: melting, global row numbers, running sums, cumulative distributions, quantiles.

Whatever needs an order is cut into ranges of that order, as many as there are shuffle partitions, and written. A range is a
task of its own; what lies before it comes from the ranges' sums, of which there are few. So no task holds a whole column,
class or client, however large that is."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .exprs import number


def melt(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = (), convert=number) -> DataFrame:
    """One row for each value of the columns: (*ids, column, value). One job then serves all columns."""
    if not cols:  # the type is that of what convert makes
        kind = df.select(convert(F.lit(None).cast("string"))).schema[0].dataType
        return df.limit(0).select(*ids, F.lit("").alias("column"), F.lit(None).cast(kind).alias("value"))
    wide = df.select(*ids, *(convert(F.col(f"`{c}`")).alias(f"__{i}") for i, c in enumerate(cols)))
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("value")) for i, c in enumerate(cols)])
    return wide.select(*ids, F.explode(parts).alias("m")).select(*ids, "m.column", "m.value")


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with __part, written: ranges of (keys, order), each in its own task. Rows that are equal in these are in one range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, sums: Sequence[str], keys: Sequence[str], order: Sequence[str], following: bool = False) -> DataFrame:
    """df with, for each of `sums`, c_before and c_all: its sum over the rows before, in the order, and over all rows, within keys.
    following: also next, the first of the order columns in the row after. A null key is a key of its own."""
    keys, first = list(keys), order[0]
    rows = in_ranges(df, keys, order)
    at = [*keys, "__part"]
    parts = rows.groupBy(*at).agg(*[F.sum(c).alias(f"__{c}") for c in sums], F.min(first).alias("__first"))
    ahead = Window.partitionBy(*keys).orderBy("__part")  # at most one row a range and key
    before, all_ = ahead.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    parts = parts.select(*[F.col(f"`{c}`").alias(f"__at{i}") for i, c in enumerate(at)], F.lead("__first").over(ahead).alias("__next"), *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_before") for c in sums], *[F.sum(f"__{c}").over(all_).alias(f"{c}_all") for c in sums])
    inside = Window.partitionBy(*at).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = {f"__{c}_here": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums} | ({"__after": F.lead(first).over(inside)} if following else {})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__at{i}")) for i, c in enumerate(at)]
    joined = rows.withColumns(out).join(parts, same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__{c}_before") + F.col(f"__{c}_here")).alias(f"{c}_before") for c in sums], *[f"{c}_all" for c in sums], *([F.coalesce("__after", "__next").alias("next")] if following else []))


def cut_at(df: DataFrame, order: Sequence[Column], ranks: Sequence[int]) -> Column:
    """How many of the given row numbers of an order each row of df has reached: a column for df. Only the order's columns are sorted, and
    as many of their rows as there are ranks are looked at; df itself isn't moved. The order must tell rows apart."""
    names = [f"__k{i}" for i in range(len(order))]
    narrow = df.select(*[c.alias(n) for n, c in zip(names, order, strict=True)])
    wanted = Counter(int(r) for r in ranks)
    if not wanted:
        return F.lit(0)
    found = row_index(narrow, [F.col(n) for n in names]).where(F.col("idx").isin(list(wanted))).collect()  # a row a rank
    mark = lambda r: F.struct(*[F.lit(r[n]).cast(narrow.schema[n].dataType).alias(n) for n in names])
    marks = [mark(r) for r in found for _ in range(wanted[r["idx"]])]  # a rank beyond the end is reached by no row
    place = F.struct(*[c.alias(n) for n, c in zip(names, order, strict=True)])
    return F.size(F.filter(F.array(*marks), lambda m: m <= place)).cast("int") if marks else F.lit(0)


def as_of(marks: DataFrame, asked: DataFrame, keys: Sequence[str], at: str, carry: Sequence[str]) -> DataFrame:
    """asked with the carry columns of the last mark at or before it, null before the first. marks: (*keys, at, *carry), of which none
    stand at one place; asked: (*keys, at, ...). Both are cut into the same ranges; a range's first rows get what the ranges before
    it end with. Rows with a null key or place are left out."""
    keys = list(keys)
    named = [F.col(f"`{k}`") for k in keys]
    own = F.struct(F.col(f"`{at}`").alias("__at"), *[F.col(f"`{c}`") for c in carry])
    rows = marks.select(*named, F.col(f"`{at}`").alias("__at"), own.alias("__own"), F.lit(None).cast(asked.schema).alias("__row"))
    rows = rows.unionByName(asked.select(*named, F.col(f"`{at}`").alias("__at"), F.lit(None).cast(rows.schema["__own"].dataType).alias("__own"), F.struct(*[F.col(f"`{c}`") for c in asked.columns]).alias("__row")))
    rows = in_ranges(rows.where("__at IS NOT NULL"), keys, ["__at"])
    ends = rows.groupBy(*keys, "__part").agg(F.max("__own").alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and key
    ends = ends.select(*keys, "__part", F.max("__last").over(before).alias("__before"))
    upto = Window.partitionBy(*keys, "__part").orderBy("__at", F.col("__own").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__here", F.last("__own", ignorenulls=True).over(upto)).where("__row IS NOT NULL").join(ends, [*keys, "__part"])
    last = F.coalesce("__here", "__before")
    return found.select("__row.*", *[last[c].alias(c) for c in carry])


def row_index(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """A 0-based row number in a total order, within keys or over the whole table."""
    places = {f"__o{i}": c for i, c in enumerate(order)}
    numbered = running_sums(df.withColumns(places | {"__one": F.lit(1).cast("long")}), ["__one"], keys, list(places))
    return numbered.withColumnRenamed("__one_before", name).drop("__one", "__one_all", *places)


def cdf(real: DataFrame, syn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, value, f_real, f_syn, next): both cumulative distributions at each distinct value, and the value after it.

    real, syn: (*keys, value). Values are counted first, so that the ordered part handles distinct values only."""
    keys = list(keys)
    both = real.select(*keys, "value", F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(syn.select(*keys, "value", F.lit(0).alias("r"), F.lit(1).alias("s")))
    counts = both.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    ordered = running_sums(counts, ["r", "s"], keys, ["value"], following=True)
    share = lambda c: F.try_divide(F.col(c) + F.col(f"{c}_before"), F.col(f"{c}_all"))
    return ordered.select(*keys, "value", share("r").alias("f_real"), share("s").alias("f_syn"), "next")


def quantiles(long: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(*keys, quantiles): exact quantiles of (*keys, value), between two values in proportion; only distinct values are put in
    order."""
    counts = long.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("n"))
    rows = running_sums(counts, ["n"], keys, ["value"])
    found = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("n_all") - 1)
        at = lambda k: F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col("value")))
        low, high = at(F.floor(place)), at(F.ceil(place))
        rest = F.max(place - F.floor(place))
        found.append(low + (high - low) * rest)
    return rows.groupBy(*keys).agg(F.array(*found).alias("quantiles"))
