"""Splits, samples and client partitioners. Chance comes from hashes of a row key, so that every result repeats."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import category, hash_u01
from ..functions.tables import as_of, cut_at, melt, row_index, running_sums
from ..sources.scratch import kept


def holdout_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """split: 'holdout' for exactly ceil(share * n) rows by their hash, else 'train'. key: a column that tells rows apart."""
    reached = cut_at(df, [hash_u01(seed, F.col(key)), F.col(key)], [math.ceil(share * df.count())])
    return df.withColumn("split", F.when(reached > 0, "train").otherwise("holdout"))


#: Ranges of the hash whose rows are counted to find a client's cut.
RANGES = 1024


def client_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """split: 'test' for ceil(share * n) rows of each client, else 'train'. Rows without a client are split like those of one. Rows are counted
    by ranges of their hash, and only the keys of the range that a client's cut falls into are sorted; a row meets its client's cut,
    of which there is one a client."""
    u = hash_u01(seed, F.col(key))
    place, part = F.struct(u.alias("u"), F.col(key).alias("k")), F.floor(u * RANGES)
    counts = df.groupBy(F.col("client_id").alias("__client"), part.alias("__range")).agg(F.count("*").alias("__n"))
    own = Window.partitionBy("__client")  # RANGES rows a client at most
    before = F.coalesce(F.sum("__n").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.ceil(F.lit(share) * F.sum("__n").over(own)) - before
    wanted = counts.withColumn("__rank", rank).where((F.col("__rank") >= 0) & (F.col("__rank") < F.col("__n")))
    wanted = kept(wanted.select("__client", "__range", "__rank"), "ranges")  # a row a client
    rows = df.select(F.col("client_id").alias("__c"), part.alias("__p"), place.alias("__cut"))
    near = rows.join(wanted, F.col("__c").eqNullSafe(F.col("__client")) & F.col("__p").eqNullSafe(F.col("__range")))
    numbered = row_index(near.select("__client", "__rank", "__cut"), [F.col("__cut")], ["__client"])
    cuts = kept(numbered.where(F.col("idx") == F.col("__rank")).select("__client", "__cut"), "cuts")
    found = df.join(cuts, F.col("client_id").eqNullSafe(F.col("__client")), "left")
    return found.withColumn("split", F.when(place >= F.col("__cut"), "train").otherwise("test")).drop("__client", "__cut")


def all_train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Exactly k rows (or all there are), the first by their hash."""
    return df.withColumn("u", hash_u01(seed, F.col(key))).orderBy("u", key).limit(k).drop("u")


def category_weights(df: DataFrame, cols: Sequence[str], log: bool = True) -> DataFrame:
    """(column, category, n, weight): ln(n + 1), or n, as a share of its column."""
    counts = melt(df, cols, convert=category).groupBy("column", F.col("value").alias("category")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("w", F.ln(F.col("n") + 1.0) if log else F.col("n").cast("double"))
    totals = counts.groupBy("column").agg(F.sum("w").alias("all"))  # a row a column
    return counts.join(F.broadcast(totals), "column").select("column", "category", "n", (F.col("w") / F.col("all")).alias("weight"))


#: Categories of all columns up to which they are sent to each task as one array a column.
FEW = 200


def draw(asked: DataFrame, weights: DataFrame, carry: Sequence[str] = ("category",), few: int = FEW) -> DataFrame:
    """asked with the carry columns of the category that each row draws. asked: (..., column, u), u from 0 to below 1; weights: (column,
    category, weight, ...). The categories of a column stand in order, each as long as its weight, and u falls into one.

    Where there are more than `few` categories (they are counted first), the draws are joined with the categories' bounds in ranges of
    both: no row, task or array holds a column's categories."""
    bounds = weights.where("weight > 0").select("column", "weight", "category", *[c for c in carry if c != "category"])
    if bounds.limit(few + 1).count() <= few:
        upto = Window.partitionBy("column").orderBy("category").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        table = bounds.withColumn("c", F.sum("weight").over(upto)).withColumn("c", F.col("c") / F.sum("weight").over(Window.partitionBy("column")))
        table = table.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("c", *carry))).alias("__t"))
        found = F.element_at("__t", F.least(F.size(F.filter("__t", lambda x: x["c"] <= F.col("u"))) + 1, F.size("__t")))
        return asked.join(F.broadcast(table), "column").withColumn("__t", found).select(*[f"`{c}`" for c in asked.columns], *[F.col("__t")[c].alias(c) for c in carry])
    placed = running_sums(bounds, ["weight"], ["column"], ["category"]).withColumn("u", F.col("weight_before") / F.col("weight_all"))
    return as_of(placed.select("column", "u", *carry), asked, ["column"], "u", carry)


def balanced_resample(df: DataFrame, key: str, cols: Sequence[str], n: int, seed: int, few: int = FEW) -> DataFrame:
    """(slot, column, category, key): for each of n slots a column by chance, a category of it by log-frequency, and a row with
    that category by chance. Rows are numbered within their category, and slots join them by number."""
    spark = df.sparkSession
    names = F.array(*map(F.lit, cols))
    weights = category_weights(df, cols)
    slots = spark.range(n).select(F.col("id").alias("slot"), hash_u01(seed, F.col("id")).alias("u1"), hash_u01(seed + 1, F.col("id")).alias("u"), hash_u01(seed + 2, F.col("id")).alias("u3"))
    slots = slots.withColumn("column", F.element_at(names, F.floor(F.col("u1") * len(cols)).cast("int") + 1)).drop("u1")
    slots = draw(slots, weights, ["category", "n"], few).select("slot", "column", "category", F.floor(F.col("u3") * F.col("n")).cast("long").alias("number"))
    rows = melt(df, cols, [key], convert=category).withColumnRenamed("value", "category").withColumn("h", hash_u01(seed + 3, F.col(key)))
    numbered = row_index(rows, [F.col("h"), F.col(key)], ["column", "category"], "number")
    return slots.join(numbered.select("column", "category", "number", key), ["column", "category", "number"]).select("slot", "column", "category", key)


# ---- client partitioners: df -> df with client_id


def _dealt(df: DataFrame, order: Sequence[Column], bounds: Sequence[int]) -> DataFrame:
    """df with client_id, by blocks of an order; bounds: where each block but the last ends."""
    return df.withColumn("client_id", cut_at(df, order, bounds))


def equal_blocks(n: int, clients: int) -> list[int]:
    """Ends of contiguous blocks whose sizes differ by one at most, larger ones first."""
    sizes = [n // clients + (i < n % clients) for i in range(clients)]
    return np.cumsum(sizes)[:-1].tolist()


def sized_blocks(n: int, weights: Sequence[float]) -> list[int]:
    """Ends of blocks of floor(n * weight share) rows; the last one takes the rest."""
    total = sum(weights)
    return np.cumsum([int(n * w / total) for w in weights])[:-1].tolist()


def part_iid(df: DataFrame, clients: int, key: str, seed: int) -> DataFrame:
    return _dealt(df, [hash_u01(seed, F.col(key)), F.col(key)], equal_blocks(df.count(), clients))


def part_sized(df: DataFrame, clients: int, key: str, seed: int, size: Callable[[int], float]) -> DataFrame:
    """Clients with sizes in proportion to size(i)."""
    return _dealt(df, [hash_u01(seed, F.col(key)), F.col(key)], sized_blocks(df.count(), [size(i) for i in range(clients)]))


def part_linear(df, clients, key, seed):
    return part_sized(df, clients, key, seed, lambda i: i + 1)


def part_square(df, clients, key, seed):
    return part_sized(df, clients, key, seed, lambda i: (i + 1) ** 2)


def part_exponential(df, clients, key, seed):
    return part_sized(df, clients, key, seed, math.exp)


def part_proportions(df: DataFrame, label: str, key: str, seed: int, proportions: dict[str, Sequence[float]]) -> DataFrame:
    """Rows of each class dealt in blocks by that class's proportions over the clients; those without a class are the class '__NA__'. A
    class without proportions is left out."""
    numbered = row_index(df.withColumn("__u", hash_u01(seed, F.col(key))), [F.col("__u"), F.col(key)], [label])
    spark = df.sparkSession
    counts = df.groupBy(category(F.col(label)).alias("__class")).agg(F.count("*").alias("__n"))
    cut = spark.createDataFrame([(k, np.cumsum(np.array(p) / sum(p))[:-1].tolist()) for k, p in proportions.items()], "__class string, __cut array<double>")
    rows = numbered.withColumn("__class", category(F.col(label))).join(counts.join(cut, "__class"), "__class")
    return rows.withColumn("client_id", F.size(F.filter("__cut", lambda c: F.floor(c * F.col("__n")) <= F.col("idx"))).cast("int")).drop("idx", "__n", "__cut", "__class", "__u")


def dirichlet_shares(counts: dict[str, int], clients: int, alpha: float, seed: int, self_balancing: bool = False) -> dict[str, list[float]]:
    """Each class's proportions over the clients. self_balancing: a client that has its even share of all rows already gets
    nothing of the classes that follow."""
    rng = np.random.default_rng(seed)
    even, have, out = sum(counts.values()) / clients, np.zeros(clients), {}
    for c in sorted(counts):
        share = rng.dirichlet([alpha] * clients)
        if self_balancing and (share * (have < even)).sum() > 0:
            share = share * (have < even)
            share = share / share.sum()
        have += np.floor(share * counts[c])
        out[c] = share.tolist()
    return out


def part_dirichlet(df: DataFrame, clients: int, label: str, key: str, seed: int, alpha: float = 0.5, least: int = 10, tries: int = 20, self_balancing: bool = False) -> DataFrame:
    """Label skew: each class's proportions come from a Dirichlet distribution; drawn anew until no client has fewer rows than
    `least`. Only one number a class comes to the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(category(F.col(label))).agg(F.count("*")).collect()}
    for t in range(tries):
        out = part_proportions(df, label, key, seed, dirichlet_shares(counts, clients, alpha, seed + t, self_balancing))
        sizes = [r["count"] for r in out.groupBy("client_id").count().collect()]
        if len(sizes) == clients and min(sizes) >= least:
            return out
    raise ValueError(f"no draw gave every client {least} rows")


#: How classes come to their owners.
MODES = ("deterministic", "random", "first-deterministic")


def class_owners(classes: Sequence[str], clients: int, each: int, mode: str = "deterministic", seed: int = 0) -> dict[str, list[int]]:
    """The clients of each class: in turn; by chance; or the first class of each client in turn and its others by chance."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    rng, n = np.random.default_rng(seed), len(classes)
    owners: dict[str, list[int]] = {c: [] for c in classes}
    for i in range(clients):
        if mode == "deterministic":
            mine = [(i * each + j) % n for j in range(min(each, n))]
        else:
            fixed = [i % n] if mode == "first-deterministic" else []
            others = [j for j in range(n) if j not in fixed]
            mine = fixed + rng.permutation(others)[: min(each, n) - len(fixed)].tolist()
        for j in mine:
            owners[classes[j]].append(i)
    return owners


def part_pathological(df: DataFrame, clients: int, label: str, key: str, seed: int, classes_each: int = 2, mode: str = "deterministic") -> DataFrame:
    """Each client owns `classes_each` classes; a class's rows are dealt to its owners in equal blocks, and a class that nobody
    owns is left out."""
    owners = class_owners(sorted(r[0] for r in df.select(category(F.col(label))).distinct().collect()), clients, classes_each, mode, seed)
    numbered = row_index(df.withColumn("__u", hash_u01(seed, F.col(key))), [F.col("__u"), F.col(key)], [label])
    counts = df.groupBy(category(F.col(label)).alias("__class")).agg(F.count("*").alias("__n"))
    table = df.sparkSession.createDataFrame([(c, o) for c, o in owners.items() if o], "__class string, __owners array<int>")
    rows = numbered.withColumn("__class", category(F.col(label))).join(counts.join(table, "__class"), "__class")
    turn = F.floor(F.col("idx") * F.size("__owners") / F.col("__n")).cast("int")
    return rows.withColumn("client_id", F.element_at("__owners", turn + 1)).drop("idx", "__n", "__owners", "__class", "__u")


def part_shard(df: DataFrame, clients: int, label: str, key: str, seed: int, shards_each: int | None = 2, shard_size: int | None = None, keep_incomplete: bool = False) -> DataFrame:
    """Rows sorted by label and cut into shards of one size, which are dealt by hash: `shards_each` to each client, of a size
    that uses all rows unless shard_size is given; with shards_each=None all shards of shard_size in turn. The last shard, if it
    is smaller than shard_size, is left out unless keep_incomplete; rows of shards that nobody gets are left out."""
    n = df.count()
    if shard_size is None:
        if shards_each is None:
            raise ValueError("give shards_each or shard_size")
        total, size = clients * shards_each, max(1, math.ceil(n / (clients * shards_each)))
    else:
        size, total = shard_size, math.ceil(n / shard_size) if keep_incomplete else n // shard_size
        if shards_each is not None and total < clients * shards_each:
            raise ValueError(f"{total} shards are too few for {clients} clients")
    dealt = total if shards_each is None else clients * shards_each
    numbered = row_index(df, [F.col(label), F.col(key)], name="__idx").withColumn("__shard", F.floor(F.col("__idx") / size).cast("long"))
    spark = df.sparkSession
    shards = spark.range(total).select(F.col("id").alias("__shard"), hash_u01(seed, F.col("id")).alias("__u"))
    deal = row_index(shards, [F.col("__u"), F.col("__shard")], name="__turn").where(F.col("__turn") < dealt).select("__shard", "__turn")
    return numbered.join(deal, "__shard").withColumn("client_id", (F.col("__turn") % clients).cast("int")).drop("__idx", "__shard", "__turn")


def part_continuous(df: DataFrame, clients: int, column: str, key: str, seed: int, strictness: float = 0.5) -> DataFrame:
    """Skew by a number: rows ranked by strictness * z-score + (1 - strictness) * noise, and cut into equal blocks."""
    s = df.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"), F.count("*").alias("n")).first()
    z = (F.col(column) - F.lit(s["m"])) / F.lit(s["s"] or 1.0)
    score = F.lit(strictness) * z + F.lit(1 - strictness) * (hash_u01(seed, F.col(key)) * 2 - 1)
    return _dealt(df, [F.round(score, 9), F.col(key)], equal_blocks(s["n"], clients))
