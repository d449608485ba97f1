"""Mix sources to target weights by weighted fair queueing.

Every row gets, within its source and in a shuffled order, a virtual finish time: the words of its source so
far, over its source's target. All rows of all sources are sorted by that time over the whole cluster, and the
mix is cut where its total budget is reached, so that each source ends near its target. A row may come again
in later rounds through its source (`rounds` in all), each time further along the virtual clock.

Defined results: rows of size 0 (null or blank texts) take nothing; an empty table gives an empty table;
a null source is a source of its own, the last; repeated rows count each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, join_small, keep

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
ROUNDS = 2
SEED = 17
#: Rows of a source that one task sorts; a source has as many slices as it needs.
SLICE = 2048


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffled(key: Column, seed: int) -> Column:
    """60 bits that place a row in the shuffled order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, rounds: int) -> DataFrame:
    """One row a source: its size, rows and target. Targets share `share` of all sizes by weight; none exceeds
    `rounds` times its source, and what is cut off goes to the others by weight (the water level is found in
    closed form over the sources in the order in which they fill up)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(rounds)) * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    target = F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap"))
    return per.select("source", "source_size", "source_rows", target.alias("target"), "budget")


def mix(docs: DataFrame, size: Column, *, key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Rows of `docs` as (key, size, source_size, target, taken, copies): how much of each the mix takes."""
    spark = docs.sparkSession
    sized = keep(docs.select(F.col(key), F.col(source).alias("source"), size.alias("size"), shuffled(F.col(key), seed).alias("place")), "mix-sized")
    targets = keep(source_targets(sized, weights, share, rounds), "mix-targets")
    named = lambda df: df.withColumns({"source_null": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    rows = join_small(named(sized), named(targets), ["source_null", "source"], F.col("place"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("source_rows") / F.lit(SLICE)))
    rows = rows.withColumn("slice", F.floor(F.col("place") / F.lit(float(1 << 60)) * slices))
    at = ["source_null", "source", "slice"]
    within = Window.partitionBy(*at).orderBy("place", "size", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*at[:2]).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slice_sizes = rows.groupBy(*at).agg(F.sum("size").alias("slice_size"))
    offsets = slice_sizes.select(*at, F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("offset"))
    rows = rows.withColumn("so_far", F.sum("size").over(within)).join(offsets, at).withColumn("so_far", F.col("so_far") + F.col("offset"))
    rows = keep(rows.select(key, "size", "source_size", "target", "budget", "place", "so_far"), "mix-rows")

    def finish(round_: Column) -> Column:
        return (round_ * F.col("source_size") + F.col("so_far")).cast("double") / F.col("target")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["finish", "place", "size", key]
    queued = rows.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("finish", finish(F.col("round")))
    queue = keep(queued.select(*order, "budget").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "mix-queue")
    # The queue's parts are ranges of the global order; at most n sums come here, and only the part with the cut is sorted further.
    sums = sorted((r["part"], r["total"], r["budget"]) for r in queue.groupBy("part").agg(F.sum("size").alias("total"), F.max("budget").alias("budget")).collect())
    ahead_of, cut_part = 0, None
    for part, total, budget in sums:
        cut_part = part
        if ahead_of + total >= budget:
            break
        ahead_of += total
    if cut_part is None:
        return rows.select(key, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"))
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = queue.where(F.col("part") == cut_part).withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)) + ahead_of)
    cut = last.where(F.col("before") < F.col("budget")).agg(F.max(F.struct(*order)).alias("cut")).first()["cut"]

    def in_mix(round_: int) -> Column:
        done = F.struct(finish(F.lit(round_)).alias("finish"), "place", "size", key)
        limit = F.struct(*[F.lit(cut[c]).cast(rows.schema[c].dataType if c != "finish" else "double").alias(c) for c in order])
        return ((F.col("size") > 0) & (F.col("target") > 0) & (done <= limit)).cast("int")

    copies = sum((in_mix(r) for r in range(1, rounds)), in_mix(0))
    rows = rows.withColumn("copies", F.coalesce(F.when(F.col("target") > 0, copies), F.lit(0)))
    return rows.select(key, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(docs: str = "documents") -> str:
    """DuckDB text of the mix over `docs`: doc_id, size, source_size, target, taken, copies."""
    return rf"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM {docs}),
    per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sized GROUP BY source),
    weighed AS (SELECT *, list_extract([5.0, 2.0, 1.0], ((rn - 1) % 3 + 1)::INT)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM per),
    filled AS (
      SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_after
      FROM weighed),
    levelled AS (SELECT *, (budget - cap_before) / weight_after AS lv FROM filled),
    leveled AS (SELECT *, max(CASE WHEN lv <= cap / weight THEN lv END) OVER () AS level FROM levelled),
    targets AS (SELECT source, source_size, coalesce(least(cap, weight * level), cap) AS target, budget FROM leveled),
    placed AS (
      SELECT s.doc_id, s.size, s.place, t.source_size, t.target, t.budget,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY place, size, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
    queue AS (
      SELECT *, (r * source_size + so_far)::DOUBLE / target AS finish FROM placed, (VALUES (0), (1)) v(r) WHERE size > 0 AND target > 0),
    mixed AS (
      SELECT *, coalesce(sum(size) OVER (ORDER BY finish, place, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < budget AS inside FROM queue),
    counted AS (SELECT doc_id, size, so_far, place, target, count(*) AS copies FROM mixed WHERE inside GROUP BY ALL)
    SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(c.copies, 0))::BIGINT AS taken, coalesce(c.copies, 0)::INT AS copies
    FROM placed p LEFT JOIN counted c ON p.doc_id IS NOT DISTINCT FROM c.doc_id AND p.size = c.size AND p.so_far = c.so_far AND p.place = c.place AND p.target = c.target
    """


ORACLE = "SELECT doc_id, size, source_size, target, taken FROM (" + mix_sql() + ")"
