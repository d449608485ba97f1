"""Reading tables and writing results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import TableSchema, infer_schema, to_json


def load_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV table with a header; empty cells are missing. Types are inferred unless given (then the file is read once)."""
    reader = spark.read.option("header", True).option("nullValue", "").option("nanValue", "NaN")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def load_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A table of any format that Spark reads; told by the ending where no format is given."""
    format = format or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    return load_csv(spark, path) if format == "csv" and not options else spark.read.format(format).options(**options).load(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("errorifexists").csv(path)


def write_partitions(df: DataFrame, path: str) -> None:
    """A table with client_id and split, in a folder for each split and client of it. A client's rows go to one task, so that it has few
    files, but those of a large client to as many as their size asks for."""
    df.hint("rebalance", "split", "client_id").write.partitionBy("split", "client_id").mode("errorifexists").parquet(path)


def load_partition(spark: SparkSession, path: str, client: int, split: str) -> DataFrame:
    """One client's rows of one split; only their folder is read. Raises for a split that isn't there; an unknown client has no rows."""
    if split not in ("train", "test"):
        raise ValueError(f"unknown split {split!r}")
    return spark.read.parquet(path).where((F.col("split") == split) & (F.col("client_id") == client)).drop("split", "client_id")


def sink_ready(metrics: DataFrame) -> DataFrame:
    """Metrics as they are written: NaN as null; an infinite value stops the job."""
    value = F.nanvl("value", F.lit(None).cast("double"))
    bad = F.raise_error(F.concat(F.lit("infinite metric: "), F.col("key")))
    return metrics.withColumn("value", F.when(F.abs(value) == float("inf"), bad.cast("double")).otherwise(value))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """JSON lines, a folder for each mode, nulls written out."""
    sink_ready(metrics).write.option("ignoreNullFields", False).partitionBy("mode").mode("errorifexists").json(path)


def run_id(synthesizer: str, dataset: str, stamp: str) -> str:
    return f"{stamp}-{synthesizer}-{dataset}-{uuid.uuid4().hex[:8]}"


def write_schema(df: DataFrame, path: str, overwrite: bool = False) -> TableSchema:
    """Infer the kinds of a table's columns and write them as a schema file for people to look over. A file that is there stays
    unless overwrite is set: it may have been corrected by hand."""
    schema = infer_schema(df)
    text = df.sparkSession.createDataFrame([(to_json(schema),)], "value string")
    text.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)
    return schema


def write_run(spark: SparkSession, path: str, run: str, config: dict[str, str], schema: TableSchema, components: list[str]) -> None:
    """One row for a run: its settings, schema and components. A run id is written once."""
    row = spark.createDataFrame([(run, config, to_json(schema), components)], "run_id string, config map<string,string>, schema string, components array<string>")
    row.write.mode("errorifexists").json(f"{path}/run_id={run}")
