"""Synthetic rows from statistical models, fitted whole or by client and drawn on a range of row numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import hash_u01, number
from ..functions.schema import ColumnSchema, TableSchema
from ..functions.tables import melt, quantiles
from ..sources.scratch import kept
from ..streaming.monitor import EarlyStop
from .encode import mixture_start, responsibilities
from . import copula, rounds
from .split import FEW, category_weights, draw


def row_count(configured: int | None, holdout: DataFrame) -> int:
    """The configured number of rows, else as many as the holdout has."""
    return configured if configured is not None else holdout.count()


def constant_rows(spark, schema: TableSchema, n: int) -> DataFrame:
    """The same row n times: 0.0, 0, 'unknown' or 'no', by kind."""
    fill = {"continuous": F.lit(0.0), "integer": F.lit(0).cast("long"), "categorical": F.lit("unknown"), "binary": F.lit("no")}
    return spark.range(n).select("id", *[fill[c.kind].alias(c.name) for c in schema.columns])


def uniform_rows(df: DataFrame, cols: Sequence[str], n: int, seed: int) -> DataFrame:
    """Numbers spread evenly over each column's range."""
    got = df.agg(*[F.min(number(F.col(c))).alias(f"a{i}") for i, c in enumerate(cols)], *[F.max(number(F.col(c))).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    return df.sparkSession.range(n).select("id", *[(F.lit(got[f"a{i}"]) + hash_u01(seed + i, F.col("id")) * F.lit(got[f"b{i}"] - got[f"a{i}"])).alias(c) for i, c in enumerate(cols)])


GRID = [i / 20 for i in range(21)]


def fit_marginals(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(column, grid) of quantiles, merged over clients by their rows, and (column, category, n, weight)."""
    long = melt(df, numeric, ["client_id"], convert=number).where("value IS NOT NULL")
    counts = long.groupBy("client_id", "column").agg(F.count("*").alias("n"))
    by_client = quantiles(long, ["client_id", "column"], GRID).withColumnRenamed("quantiles", "grid").join(counts, ["client_id", "column"])
    points = by_client.select("column", "n", F.posexplode("grid").alias("pos", "value"))
    merged = points.groupBy("column", "pos").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"))
    grids = merged.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("grid"))
    return grids, category_weights(df, nominal, log=False)


def marginal_rows(grids: DataFrame, shares: DataFrame, n: int, seed: int, few: int = FEW) -> DataFrame:
    """(id, column, number, category): each column drawn from its own distribution; pivot by column for a wide table. Column
    seeds come from the columns' names."""
    spark = grids.sparkSession
    ids = spark.range(n)
    u = lambda: hash_u01(seed, F.concat_ws("|", F.col("column"), F.col("id").cast("string")))
    num = ids.crossJoin(F.broadcast(grids)).withColumn("at", u() * (len(GRID) - 1)).withColumn("i", F.least(F.floor("at").cast("int"), F.lit(len(GRID) - 2)))
    low, high = F.element_at("grid", F.col("i") + 1), F.element_at("grid", F.col("i") + 2)
    num = num.select("id", "column", (low + (high - low) * (F.col("at") - F.col("i"))).alias("number"), F.lit(None).cast("string").alias("category"))
    asked = ids.crossJoin(F.broadcast(shares.select("column").distinct())).withColumn("u", u())  # a row a column
    cat = draw(asked, shares, few=few).select("id", "column", F.lit(None).cast("double").alias("number"), "category")
    return num.union(cat)


def mixture_round(df: DataFrame, cols: Sequence[str], params: DataFrame) -> DataFrame:
    """One round: each client's sums for every mode, merged over clients into new parameters (column, mode, weight, mean, std)."""
    long = melt(df, cols, ["client_id"], convert=number).where("value IS NOT NULL")
    r = responsibilities(long, params)
    local = r.groupBy("client_id", "column", "mode").agg(F.sum("r").alias("n"), F.sum(F.col("r") * F.col("value")).alias("x"), F.sum(F.col("r") * F.col("value") * F.col("value")).alias("xx"))
    whole = local.groupBy("column", "mode").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx"))
    mean = F.col("x") / F.col("n")
    return whole.select("column", "mode", (F.col("n") / F.sum("n").over(Window.partitionBy("column"))).alias("weight"), mean.alias("mean"), F.sqrt(F.greatest(F.col("xx") / F.col("n") - mean * mean, F.lit(1e-12))).alias("std"))


def fit_mixture(df: DataFrame, cols: Sequence[str], modes: int = 5, rounds: int = 20, epsilon: float = 1e-3, least: float = 0.005) -> DataFrame:
    """Rounds until no mean moves by more than epsilon of its deviation; modes of little weight are left out. A round's
    parameters (columns times modes) are carried as rows of a small local table, so plans do not grow with the rounds."""
    spark = df.sparkSession
    df = df.select("client_id", *cols).persist()
    params = mixture_start(df, cols, modes)
    schema = "column string, mode int, weight double, mean double, std double"
    now = {(r["column"], r["mode"]): r for r in params.collect()}
    for _ in range(rounds):
        table = spark.createDataFrame([tuple(r) for r in now.values()], schema)
        new = {(r["column"], r["mode"]): r for r in mixture_round(df, cols, table).collect()}
        moved = max((abs(new[k]["mean"] - now[k]["mean"]) / now[k]["std"] for k in new if k in now), default=0.0)
        now = new
        if moved < epsilon:
            break
    df.unpersist()
    return spark.createDataFrame([tuple(r) for r in now.values() if r["weight"] > least], schema)


def mixture_rows(params: DataFrame, n: int, seed: int) -> DataFrame:
    """(id, column, value): a mode by its weight, then a normal number of it (by two uniform ones)."""
    total = F.sum("weight").over(Window.partitionBy("column"))
    upto = F.sum("weight").over(Window.partitionBy("column").orderBy("mode").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    table = params.select("column", (upto / total).alias("c"), "mean", "std").groupBy("column").agg(F.array_sort(F.collect_list(F.struct("c", "mean", "std"))).alias("t"))
    ids = params.sparkSession.range(n).crossJoin(F.broadcast(table))
    u = lambda i: hash_u01(seed + i, F.concat_ws("|", F.col("column"), F.col("id").cast("string")))
    mode = F.element_at("t", F.least(F.size(F.filter("t", lambda m: m["c"] <= u(0))) + 1, F.size("t")))
    z = F.sqrt(-2 * F.ln(F.greatest(u(1), F.lit(1e-12)))) * F.cos(u(2) * 6.283185307179586)
    return ids.select("id", "column", mode.alias("m"), z.alias("z")).select("id", "column", (F.col("m.mean") + F.col("m.std") * F.col("z")).alias("value"))


def check_sample(sample: DataFrame, schema: TableSchema, n: int) -> DataFrame:
    """The sample itself; raises if its columns differ from the schema's or it hasn't exactly n rows."""
    want = {c.name for c in schema.columns}
    if set(sample.columns) != want:
        raise ValueError(f"columns differ: {sorted(set(sample.columns) ^ want)}")
    if (got := sample.count()) != n or not n:
        raise ValueError(f"{got} rows instead of {n}")
    return sample


@dataclass(frozen=True)
class Synthesizer:
    """fit(df, schema) is a state, a dict of small tables and numbers, of a table with client_id, whose clients are merged in it;
    draw(state, schema, n, seed) has the schema's columns and n rows."""

    fit: Callable[[DataFrame, TableSchema], dict]
    draw: Callable[[dict, TableSchema, int, int], DataFrame]

    def sample(self, state: dict, schema: TableSchema, n: int, seed: int) -> DataFrame:
        """n rows of the schema's columns; raises where the drawing gives something else."""
        return check_sample(self.draw(state, schema, n, seed).select(*[F.col(f"`{c.name}`") for c in schema.columns]), schema, n)


def _columns(schema: TableSchema) -> tuple[list[str], list[str]]:
    numeric = [c.name for c in schema.columns if c.kind in ("continuous", "integer")]
    return numeric, [c.name for c in schema.columns if c.name not in numeric]


def _typed(c: ColumnSchema, value: Column) -> Column:
    return (F.round(value).cast("long") if c.kind == "integer" else value).alias(c.name)


def _wide(schema: TableSchema, number: DataFrame, text: DataFrame | None) -> DataFrame:
    """number: (id, column, value); text: (id, column, value). A row an id."""
    numeric, nominal = _columns(schema)
    rows = number.select("id", "column", F.col("value").cast("double").alias("x"), F.lit(None).cast("string").alias("s"))
    if text is not None:
        rows = rows.union(text.select("id", "column", F.lit(None).cast("double"), "value"))
    pick = lambda name, c: F.max(F.when(F.col("column") == name, F.col(c)))
    got = rows.groupBy("id").agg(*[pick(n, "x").alias(f"x{i}") for i, n in enumerate(numeric)], *[pick(n, "s").alias(f"s{i}") for i, n in enumerate(nominal)])
    return got.select(*[_typed(c, F.col(f"x{numeric.index(c.name)}" if c.name in numeric else f"s{nominal.index(c.name)}")) for c in schema.columns])


def _categories(shares: DataFrame, n: int, seed: int) -> DataFrame:
    none = shares.sparkSession.createDataFrame([], "column string, grid array<double>")
    return marginal_rows(none, shares, n, seed).select("id", "column", F.col("category").alias("value"))


def _fit_marginal(df: DataFrame, schema: TableSchema) -> dict:
    grids, shares = fit_marginals(df, *_columns(schema))
    return {"grids": grids, "shares": shares}


def _draw_marginal(state: dict, schema: TableSchema, n: int, seed: int) -> DataFrame:
    rows = marginal_rows(state["grids"], state["shares"], n, seed)
    return _wide(schema, rows.where("number IS NOT NULL").select("id", "column", F.col("number").alias("value")), rows.where("category IS NOT NULL").select("id", "column", F.col("category").alias("value")))


def _fit_mixture(df: DataFrame, schema: TableSchema) -> dict:
    numeric, nominal = _columns(schema)
    return {"modes": fit_mixture(df, numeric), "shares": category_weights(df, nominal, log=False)}


def _draw_mixture(state: dict, schema: TableSchema, n: int, seed: int) -> DataFrame:
    return _wide(schema, mixture_rows(state["modes"], n, seed), _categories(state["shares"], n, seed))


def _fit_by_client(df: DataFrame, schema: TableSchema, modes: int = 5, most: int = 20) -> dict:
    """A mixture for each numeric column by rounds of local training, until the rows' density gains little."""
    numeric, nominal = _columns(schema)
    stop = EarlyStop(epsilon=1e-3, patience=2, higher=True)
    fit = rounds.fit_clients(df, rounds.mixture_method(numeric), rounds.mixture_state(df, numeric, modes), most, evaluate=rounds.log_likelihood(df, numeric), stop=stop)
    return {"modes": rounds.mixture_params(df, fit.state, [c for c in numeric if f"mean.{c}" in fit.state]), "shares": category_weights(df, nominal, log=False)}


def _fit_copula(df: DataFrame, schema: TableSchema) -> dict:
    numeric, nominal = _columns(schema)
    rows = kept(df.select(*[F.col(f"`{c}`") for c in numeric]).withColumn("__row", F.monotonically_increasing_id()), "rows")
    return {"spark": df.sparkSession, "copula": copula.fit_copula(rows, "__row", numeric), "shares": category_weights(df, nominal, log=False)}


def _draw_copula(state: dict, schema: TableSchema, n: int, seed: int) -> DataFrame:
    fitted = state["copula"]
    rows = copula.copula_rows(state["spark"], fitted, n, seed)
    return _wide(schema, melt(rows, fitted.columns, ["id"]), _categories(state["shares"], n, seed))


def _draw_uniform(state: dict, schema: TableSchema, n: int, seed: int) -> DataFrame:
    numeric, _ = _columns(schema)
    rows = uniform_rows(state["rows"], numeric, n, seed)
    return _wide(schema, melt(rows, numeric, ["id"]), _categories(state["shares"], n, seed))


SYNTHESIZERS = {
    "constant": Synthesizer(lambda df, schema: {"spark": df.sparkSession}, lambda state, schema, n, seed: constant_rows(state["spark"], schema, n)),
    "uniform": Synthesizer(lambda df, schema: {"rows": df, "shares": category_weights(df, _columns(schema)[1], log=False)}, _draw_uniform),
    "marginal": Synthesizer(_fit_marginal, _draw_marginal),
    "mixture": Synthesizer(_fit_mixture, _draw_mixture),
    "mixture_by_client": Synthesizer(_fit_by_client, _draw_mixture),
    "copula": Synthesizer(_fit_copula, _draw_copula),
}
