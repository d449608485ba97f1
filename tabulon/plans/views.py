"""Stand-in tables over the given ones, as DataFrames and as DuckDB SQL: real and synthetic rows, clients, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NOM = ["l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def real(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber <= 4").withColumn("client_id", (F.col("l_suppkey") % 3).cast("int"))


def syn(spark, d):
    return table(spark, d, "lineitem").where("l_linenumber > 4")


def orders(spark, d):
    return table(spark, d, "orders").withColumn("client_id", (F.col("o_custkey") % 3).cast("int"))


def copied(spark, d):
    """Orders of which a quarter are unchanged and the others have another price."""
    return orders(spark, d).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 0.5))


def nulled(spark, d):
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, F.lit(None).cast("double")).when(k % 11 == 0, float("nan")).when(k % 13 == 0, float("inf")).otherwise(F.col("o_totalprice"))
    return orders(spark, d).withColumn("o_totalprice", price)


def scored(spark, d):
    t = table(spark, d, "lineitem")
    score = F.round(F.col("l_discount") + F.col("l_tax"), 4)
    return t.select(score.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (score > 0.08).cast("int").alias("pred"), F.col("l_linestatus").alias("group"), (F.col("l_suppkey") % 3).cast("int").alias("client_id"))


def run_events(spark, d):
    """Run events from the event table: clicks are requests, views replies, purchases finished rounds."""
    kind = F.when(F.col("event_type") == "click", "request").when(F.col("event_type") == "view", "reply").when(F.col("event_type") == "purchase", "round").otherwise(F.col("event_type"))
    return table(spark, d, "events").select((F.col("user_id") % 5).alias("run_id"), "ts", "event_id", kind.alias("type"), F.floor("value").cast("long").alias("byte_count"), (F.col("user_id") % 3).cast("int").alias("client_id"), "value")


def params(spark, d):
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 3).cast("int").alias("client_id"), F.lit("w").alias("param"), F.posexplode("embedding").alias("pos", "value")).groupBy("client_id", "param", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))


def param_counts(spark, d):
    return table(spark, d, "embeddings").groupBy((F.col("vec_id") % 3).cast("int").alias("client_id")).agg(F.count("*").alias("n"))


SQL = {
    "real": "SELECT *, (l_suppkey % 3)::INT AS client_id FROM lineitem WHERE l_linenumber <= 4",
    "syn": "SELECT * FROM lineitem WHERE l_linenumber > 4",
    "ord": "SELECT *, (o_custkey % 3)::INT AS client_id FROM orders",
    "copied": "SELECT * REPLACE (CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE o_totalprice + 0.5 END AS o_totalprice), (o_custkey % 3)::INT AS client_id FROM orders",
    "nulled": "SELECT * REPLACE (CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 13 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS o_totalprice), (o_custkey % 3)::INT AS client_id FROM orders",
    "scored": "SELECT round(l_discount + l_tax, 4) AS score, (l_returnflag = 'R')::INT AS label, (round(l_discount + l_tax, 4) > 0.08)::INT AS pred, l_linestatus AS \"group\", (l_suppkey % 3)::INT AS client_id FROM lineitem",
    "runs": "SELECT user_id % 5 AS run_id, ts, event_id, CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'reply' WHEN 'purchase' THEN 'round' ELSE event_type END AS type, floor(value)::BIGINT AS byte_count, (user_id % 3)::INT AS client_id, value FROM events",
    "params": "SELECT client_id, 'w' AS param, pos, avg(v::DOUBLE) AS value FROM (SELECT (vec_id % 3)::INT AS client_id, unnest(embedding) AS v, (generate_subscripts(embedding, 1) - 1)::INT AS pos FROM embeddings) GROUP BY ALL",
    "counts": "SELECT (vec_id % 3)::INT AS client_id, count(*) AS n FROM embeddings GROUP BY ALL",
}


def with_(*names: str, more: str = "") -> str:
    """A WITH clause of these views, and more of them."""
    parts = [f"{n} AS ({SQL[n]})" for n in names] + ([more] if more else [])
    return "WITH " + ", ".join(parts) + " "


def unpivot(source: str, cols, ids: str = "") -> str:
    ids = f"{ids}, " if ids else ""
    return " UNION ALL ".join(f"SELECT {ids}'{c}' AS \"column\", {c} AS value FROM {source}" for c in cols)


def u01(seed: int, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}|' || ({key})::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE)"
