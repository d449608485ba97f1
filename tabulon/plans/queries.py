"""The registered queries: each runs an operator over the given tables. ORACLE_SQLS has the same in DuckDB SQL where SQL can say it.

Numbers are rounded to 6 places on both sides, as sums in another order differ in the last bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import schema as sch
from ..functions.exprs import hash_u01, normalized_key, weighted_mean
from ..functions.tables import melt
from ..operators import bayes, clean, copula, encode, federate, fidelity, learn, metrics, privacy, rounds, scores, split, synth
from ..sources import tables as io
from ..sources.scratch import scratch_path
from ..streaming import monitor
from . import suite
from .views import NOM, NUM, copied, nulled, orders, param_counts, params, real, run_events, scored, syn, table, u01, unpivot, with_

QUERIES: dict = {}
ORACLE_SQLS: dict[str, str] = {}
CLIENTS = 3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQLS[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`") + 0.0, places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# ---- sources and sinks


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def scan_csv(spark, d):
    path = scratch_path(spark, "csv")
    io.write_csv(table(spark, d, "supplier"), path)
    return io.load_csv(spark, path, table(spark, d, "supplier").schema)


_KIND = "CASE WHEN nd <= 2 THEN 'binary' WHEN nd <= 10 THEN 'categorical' WHEN ty = 'integer' AND nn = 0 THEN 'integer' WHEN ty <> 'other' THEN 'continuous' ELSE 'categorical' END"
_LINE_TYPES = {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "other", "l_linestatus": "other"}


@query(f'SELECT "column", {_KIND} AS kind FROM (' + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS ty, count(DISTINCT {c}) AS nd, count(*) - count({c}) AS nn FROM lineitem" for c, t in _LINE_TYPES.items()) + ")")
def infer_schema(spark, d):
    return sch.infer_kinds(table(spark, d, "lineitem").select(*_LINE_TYPES))


_MOM = f"rm AS (SELECT \"column\", count(value) AS n, avg(value) AS m, stddev_samp(value) AS s FROM ({unpivot('real', NUM)}) GROUP BY 1), sm AS (SELECT \"column\", count(value) AS n, avg(value) AS m, stddev_samp(value) AS s FROM ({unpivot('syn', NUM)}) GROUP BY 1)"


def _gaps(spark, d):
    return fidelity.moment_gaps(fidelity.moments(fidelity.numbers(real(spark, d), NUM)), fidelity.moments(fidelity.numbers(syn(spark, d), NUM)))


@query(with_("real", "syn", more=_MOM) + "SELECT 'global' AS mode, 'fidelity.mean_abs_diff' AS key, round(avg(abs(rm.m - sm.m)), 6) AS value FROM rm JOIN sm USING (\"column\") UNION ALL SELECT 'global', 'fidelity.std_abs_diff', round(avg(abs(rm.s - sm.s)), 6) FROM rm JOIN sm USING (\"column\")")
def metrics_sink(spark, d):
    path = scratch_path(spark, "metrics")
    io.write_metrics(metrics.as_metrics(_gaps(spark, d), "fidelity").withColumn("mode", F.lit("global")), path)
    return rounded(spark.read.schema("key string, value double, mode string").json(path).select("mode", "key", "value"))


# ---- cleaning


@query(with_("nulled") + "SELECT count(*) AS n_rows, count(*) FILTER (o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)) AS n_kept, count(*) FILTER (o_totalprice IS NULL OR isnan(o_totalprice)) AS n_dropped FROM nulled")
def dropna_count(spark, d):
    return clean.missing_counts(nulled(spark, d))


@query(with_("nulled") + "SELECT count(*) AS n_rows, count(*) FILTER (o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)) AS n_kept, count(*) FILTER (o_totalprice IS NULL OR isnan(o_totalprice)) AS n_dropped, round(sum(o_custkey) FILTER (o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)), 0)::BIGINT AS keys_kept FROM nulled")
def dropna_observed(spark, d):
    kept, seen = clean.drop_missing_counted(nulled(spark, d))
    keys = kept.agg(F.sum("o_custkey")).first()[0]
    got = seen.get
    return spark.createDataFrame([(got["n_rows"], got["n_kept"], got["n_dropped"], keys)], "n_rows long, n_kept long, n_dropped long, keys_kept long")


@query(with_("nulled") + "SELECT o_orderkey, o_totalprice FROM nulled WHERE isfinite(o_totalprice)")
def sanitize_numeric(spark, d):
    return clean.sanitize_numeric(nulled(spark, d), ["o_totalprice", "o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, 'seg_' || coalesce(CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment END, 'nan') AS seg FROM customer")
def cat_prefix(spark, d):
    t = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("seg"))
    return clean.add_prefixes(t, ["seg"])


# ---- splits and samples

_RN = f"SELECT o_orderkey, client_id, o_orderstatus, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY {u01(42, 'o_orderkey')}, o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM ord"


@query(with_("ord", more=f"r AS ({_RN})") + "SELECT o_orderkey, CASE WHEN idx < ceil(0.2 * n) THEN 'holdout' ELSE 'train' END AS split FROM r")
def holdout_split(spark, d):
    return split.holdout_split(orders(spark, d), "o_orderkey", 0.2, 42).select("o_orderkey", "split")


_CS = f"r AS (SELECT o_orderkey, client_id, row_number() OVER (PARTITION BY client_id ORDER BY {u01(43, 'o_orderkey')}, o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY client_id) AS n FROM ord)"


@query(with_("ord", more=_CS) + "SELECT o_orderkey, client_id, CASE WHEN idx < ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r")
def client_split(spark, d):
    return split.client_split(orders(spark, d), "o_orderkey", 0.2, 43).select("o_orderkey", "client_id", "split")


@query(with_("ord", more=_CS) + "SELECT o_orderkey FROM r WHERE client_id = 1 AND idx < ceil(0.2::DOUBLE * n)")
def load_partition(spark, d):
    path = scratch_path(spark, "partitions")
    io.write_partitions(split.client_split(orders(spark, d), "o_orderkey", 0.2, 43).select("o_orderkey", "client_id", "split"), path)
    return io.load_partition(spark, path, 1, "test")


@query(with_("ord", more=_CS) + "SELECT o_orderkey, client_id FROM r WHERE idx >= ceil(0.2::DOUBLE * n)")
def all_train(spark, d):
    return split.all_train(split.client_split(orders(spark, d), "o_orderkey", 0.2, 43)).select("o_orderkey", "client_id")


@query(f"SELECT o_orderkey FROM orders ORDER BY {u01(44, 'o_orderkey')}, o_orderkey LIMIT 1000")
def sample_k(spark, d):
    return split.sample_rows(table(spark, d, "orders"), "o_orderkey", 1000, 44).select("o_orderkey")


_LF = "lf AS (SELECT \"column\", coalesce(value, '__NA__') AS category, count(*) AS n FROM (" + unpivot("lineitem", NOM) + ") GROUP BY ALL)"


@query("WITH " + _LF + " SELECT \"column\", category, n, round(ln(n + 1) / sum(ln(n + 1)) OVER (PARTITION BY \"column\"), 6) AS weight FROM lf")
def log_freq_weights(spark, d):
    return rounded(split.category_weights(table(spark, d, "lineitem"), NOM))


@query(f"WITH w AS (SELECT l_returnflag AS category, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), c AS (SELECT category, sum(n / (SELECT sum(n) FROM w)) OVER (ORDER BY category) AS c FROM w), o AS (SELECT o_orderkey, {u01(45, 'o_orderkey')} AS u FROM orders) SELECT o_orderkey, coalesce(min(category) FILTER (c > u), max(category)) AS category FROM o CROSS JOIN c GROUP BY o_orderkey")
def sample_category(spark, d):
    w = split.category_weights(table(spark, d, "lineitem"), ["l_returnflag"], log=False)
    asked = table(spark, d, "orders").select("o_orderkey", F.lit("l_returnflag").alias("column"), hash_u01(45, F.col("o_orderkey")).alias("u"))
    return split.draw(asked, w).select("o_orderkey", "category")


@query(f"WITH w AS (SELECT l_partkey::VARCHAR AS category, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT category, sum(n) OVER (ORDER BY category)::DOUBLE / sum(n) OVER () AS c FROM w), o AS (SELECT o_orderkey, {u01(47, 'o_orderkey')} AS u FROM orders) SELECT o_orderkey, w.category FROM (SELECT o_orderkey, (SELECT min(c) FROM c WHERE c > u) AS c FROM o) JOIN c AS w USING (c)")
def sample_wide_category(spark, d):
    w = split.category_weights(table(spark, d, "lineitem"), ["l_partkey"], log=False)
    asked = table(spark, d, "orders").select("o_orderkey", F.lit("l_partkey").alias("column"), hash_u01(47, F.col("o_orderkey")).alias("u"))
    return split.draw(asked, w).select("o_orderkey", "category")


_BAL = f"""WITH lf AS (SELECT "column", coalesce(value, '__NA__') AS category, count(*) AS n FROM ({unpivot('orders', ['o_orderstatus', 'o_orderpriority'])}) GROUP BY ALL),
w AS (SELECT *, ln(n + 1.0::DOUBLE) / sum(ln(n + 1.0::DOUBLE)) OVER (PARTITION BY "column") AS w FROM lf), c AS (SELECT *, sum(w) OVER (PARTITION BY "column" ORDER BY category) AS c, row_number() OVER (PARTITION BY "column" ORDER BY category DESC) AS last FROM w),
s AS (SELECT c_custkey AS slot, {u01(50, 'c_custkey')} AS u1, {u01(51, 'c_custkey')} AS u2, {u01(52, 'c_custkey')} AS u3 FROM (SELECT row_number() OVER () - 1 AS c_custkey FROM customer)),
p AS (SELECT slot, u3, c."column", c.category, c.n, row_number() OVER (PARTITION BY slot ORDER BY c.c, c.category) AS k FROM s JOIN c ON c."column" = ['o_orderstatus', 'o_orderpriority'][(floor(u1 * 2) + 1)::INT] WHERE c.c > u2 OR c.last = 1),
r AS (SELECT o_orderkey, "column", value AS category, row_number() OVER (PARTITION BY "column", value ORDER BY {u01(53, 'o_orderkey')}, o_orderkey) - 1 AS number FROM ({unpivot('orders', ['o_orderstatus', 'o_orderpriority'], 'o_orderkey')}))
SELECT slot, p."column", p.category, o_orderkey FROM p JOIN r ON p.k = 1 AND p."column" = r."column" AND p.category = r.category AND floor(u3 * n)::BIGINT = number"""


@query(_BAL)
def balanced_resample(spark, d):
    n = table(spark, d, "customer").count()
    return split.balanced_resample(table(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], n, 50)


def _bounds_sql(weights: str) -> str:
    """Clients by block sizes of floor(n * w / sum), from SQL weights of the clients 0, 1, ..."""
    ws = weights.split(";")
    total = " + ".join(ws)
    ends, acc = [], []
    for w in ws[:-1]:
        acc.append(f"floor(n * ({w}) / ({total}))")
        ends.append(" + ".join(acc))
    return "(" + " + ".join(f"(idx >= {e})::INT" for e in ends) + ")::INT"


def _equal_sql(n: int = CLIENTS) -> str:
    return "(" + " + ".join(f"(idx >= {i + 1} * (n // {n}) + least(n % {n}, {i + 1}))::INT" for i in range(n - 1)) + ")::INT"


@query(with_("ord", more=f"r AS ({_RN})") + f"SELECT o_orderkey, {_equal_sql()} AS client_id FROM r")
def part_iid(spark, d):
    return split.part_iid(orders(spark, d), CLIENTS, "o_orderkey", 42).select("o_orderkey", "client_id")


@query(with_("ord", more=f"r AS ({_RN})") + f"SELECT o_orderkey, {_bounds_sql('1.0::DOUBLE;2.0::DOUBLE;3.0::DOUBLE')} AS client_id FROM r")
def part_linear(spark, d):
    return split.part_linear(orders(spark, d), CLIENTS, "o_orderkey", 42).select("o_orderkey", "client_id")


@query(with_("ord", more=f"r AS ({_RN})") + f"SELECT o_orderkey, {_bounds_sql('1.0::DOUBLE;4.0::DOUBLE;9.0::DOUBLE')} AS client_id FROM r")
def part_square(spark, d):
    return split.part_square(orders(spark, d), CLIENTS, "o_orderkey", 42).select("o_orderkey", "client_id")


@query(with_("ord", more=f"r AS ({_RN})") + f"SELECT o_orderkey, {_bounds_sql('1.0::DOUBLE;exp(1.0::DOUBLE);exp(2.0::DOUBLE)')} AS client_id FROM r")
def part_exponential(spark, d):
    return split.part_exponential(orders(spark, d), CLIENTS, "o_orderkey", 42).select("o_orderkey", "client_id")


#: The proportions that seed 7 draws for the three order states.
_DRAWN = (lambda rng: {c: rng.dirichlet([0.5] * CLIENTS).tolist() for c in ("F", "O", "P")})(np.random.default_rng(7))
_CLASS = f"SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY {{0}} ORDER BY {u01(42, 'o_orderkey')}, o_orderkey) - 1 AS idx, count(*) OVER (PARTITION BY {{0}}) AS n FROM orders"


@query(f"WITH r AS ({_CLASS.format('o_orderstatus')}) SELECT o_orderkey, CASE o_orderstatus " + " ".join(f"WHEN '{c}' THEN " + " + ".join(f"(idx >= floor({x!r}::DOUBLE * n))::INT" for x in np.cumsum(np.array(p) / sum(p))[:-1].tolist()) for c, p in _DRAWN.items()) + " END AS client_id FROM r")
def part_dirichlet(spark, d):
    return split.part_proportions(orders(spark, d).drop("client_id"), "o_orderstatus", "o_orderkey", 42, _DRAWN).select("o_orderkey", "client_id")


@query(f"WITH cl AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS c, count(*) OVER () AS m FROM (SELECT DISTINCT o_orderpriority FROM orders)), ow AS (SELECT o_orderpriority, list(i ORDER BY i, j) AS owners FROM cl, range({CLIENTS}) a(i), range(2) b(j) WHERE (i * 2 + j) % m = c GROUP BY 1), r AS ({_CLASS.format('o_orderpriority')}) SELECT o_orderkey, owners[floor(idx * len(owners) / n)::INT + 1]::INT AS client_id FROM r JOIN ow USING (o_orderpriority)")
def part_pathological(spark, d):
    return split.part_pathological(orders(spark, d).drop("client_id"), CLIENTS, "o_orderpriority", "o_orderkey", 42).select("o_orderkey", "client_id")


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders), deal AS (SELECT s, row_number() OVER (ORDER BY {u01(42, 's')}, s) - 1 AS turn FROM range({2 * CLIENTS}) t(s)) SELECT o_orderkey, (turn % {CLIENTS})::INT AS client_id FROM r JOIN deal ON s = floor(idx / ceil(n / {2 * CLIENTS}.0::DOUBLE))")
def part_shard(spark, d):
    return split.part_shard(orders(spark, d).drop("client_id"), CLIENTS, "o_orderstatus", "o_orderkey", 42).select("o_orderkey", "client_id")


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS idx FROM orders), s AS (SELECT range AS s FROM range((SELECT floor(count(*) / 100)::BIGINT FROM orders))), deal AS (SELECT s, row_number() OVER (ORDER BY {u01(42, 's')}, s) - 1 AS turn FROM s) SELECT o_orderkey, (turn % {CLIENTS})::INT AS client_id FROM r JOIN deal ON s = floor(idx / 100)")
def part_shard_sized(spark, d):
    return split.part_shard(orders(spark, d).drop("client_id"), CLIENTS, "o_orderstatus", "o_orderkey", 42, shards_each=None, shard_size=100).select("o_orderkey", "client_id")


@query(f"WITH z AS (SELECT o_orderkey, round(0.5::DOUBLE * ((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()) + 0.5::DOUBLE * ({u01(42, 'o_orderkey')} * 2 - 1), 9) AS sc FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY sc, o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM z) SELECT o_orderkey, {_equal_sql()} AS client_id FROM r")
def part_continuous(spark, d):
    return split.part_continuous(orders(spark, d).drop("client_id"), CLIENTS, "o_totalprice", "o_orderkey", 42).select("o_orderkey", "client_id")


# ---- fidelity


@query(with_("real", "syn", more=_MOM) + "SELECT round(avg(abs(rm.m - sm.m)), 6) AS mean_abs_diff FROM rm JOIN sm USING (\"column\")")
def mean_abs_diff(spark, d):
    return rounded(_gaps(spark, d).select("mean_abs_diff"))


@query(with_("real", "syn", more=_MOM) + "SELECT round(avg(abs(rm.s - sm.s)), 6) AS std_abs_diff FROM rm JOIN sm USING (\"column\")")
def std_abs_diff(spark, d):
    return rounded(_gaps(spark, d).select("std_abs_diff"))


def _std(df):
    return rounded(df.withColumn("std", F.sqrt(F.col("m2") / F.col("n"))).drop("m2"))


@query(with_("real") + f"SELECT client_id, \"column\", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ({unpivot('real', NUM, 'client_id')}) GROUP BY ALL")
def moments_partial(spark, d):
    return _std(fidelity.moments(fidelity.numbers(real(spark, d), NUM, ["client_id"]), ["client_id"]))


@query(with_("real") + f"SELECT \"column\", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ({unpivot('real', NUM)}) GROUP BY ALL")
def moments_merged(spark, d):
    return _std(fidelity.merge_moments(fidelity.moments(fidelity.numbers(real(spark, d), NUM, ["client_id"]), ["client_id"])))


@query(with_("real") + f"SELECT client_id, \"column\", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM ({unpivot('real', NUM, 'client_id')}) GROUP BY GROUPING SETS ((client_id, \"column\"), (\"column\"))")
def moments_grouping_sets(spark, d):
    return _std(fidelity.moments(fidelity.numbers(real(spark, d), NUM, ["client_id"]), ["client_id"], whole_too=True))


def _cdf_sql(rsrc: str, ssrc: str, keys: str) -> str:
    return f"b AS (SELECT {keys}, value, sum(r) AS r, sum(s) AS s FROM (SELECT {keys}, value, 1 AS r, 0 AS s FROM ({rsrc}) UNION ALL SELECT {keys}, value, 0, 1 FROM ({ssrc})) GROUP BY ALL), f AS (SELECT {keys}, value, (sum(r) OVER w)::DOUBLE / sum(r) OVER (PARTITION BY {keys}) AS fr, (sum(s) OVER w)::DOUBLE / sum(s) OVER (PARTITION BY {keys}) AS fs, lead(value) OVER w AS nx FROM b WINDOW w AS (PARTITION BY {keys} ORDER BY value))"


_DIST = _cdf_sql(unpivot("real", NUM), unpivot("syn", NUM), '"column"')


def _dist(spark, d):
    return fidelity.distances(melt(clean.sanitize_numeric(real(spark, d).select(*NUM), NUM), NUM), melt(clean.sanitize_numeric(syn(spark, d).select(*NUM), NUM), NUM))


@query(with_("real", "syn", more=_DIST) + 'SELECT "column", round(max(abs(fr - fs)), 6) AS ks FROM f GROUP BY 1')
def ks_stat(spark, d):
    return rounded(_dist(spark, d).select("column", "ks"))


@query(with_("real", "syn", more=_DIST) + 'SELECT "column", round(sum(abs(fr - fs) * (nx - value)), 6) AS wasserstein FROM f GROUP BY 1')
def wasserstein(spark, d):
    return rounded(_dist(spark, d).select("column", "wasserstein"))


@query(with_("real", "syn", more=_MOM) + 'SELECT "column", round(abs(rm.m - sm.m) / sqrt(rm.s * rm.s / rm.n + sm.s * sm.s / sm.n), 6) AS t_stat FROM rm JOIN sm USING ("column")')
def welch_t(spark, d):
    return rounded(_dist(spark, d).select("column", "t_stat"))


_FED = _cdf_sql(unpivot("real", NUM, "client_id"), unpivot("(SELECT * FROM syn CROSS JOIN (SELECT DISTINCT client_id FROM real))", NUM, "client_id"), 'client_id, "column"')


@query(
    with_("real", "syn", more=_FED) + f""", k AS (SELECT client_id, "column", max(abs(fr - fs)) AS ks, sum(abs(fr - fs) * (nx - value)) AS w FROM f GROUP BY ALL),
    rc AS (SELECT client_id, "column", count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ({unpivot('real', NUM, 'client_id')}) GROUP BY ALL), sc AS (SELECT "column", count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ({unpivot('syn', NUM)}) GROUP BY ALL),
    t AS (SELECT client_id, "column", rc.n, abs(rc.m - sc.m) / sqrt(rc.v / rc.n + sc.v / sc.n) AS t FROM rc JOIN sc USING ("column")),
    c AS (SELECT client_id, avg(ks) AS ks, avg(w) AS w, avg(t) AS t, max(n) AS n FROM k JOIN t USING (client_id, "column") GROUP BY 1)
    SELECT round(sum(ks * n) / sum(n), 6) AS ks_mean, round(sum(w * n) / sum(n), 6) AS wasserstein_mean, round(sum(t * n) / sum(n), 6) AS t_stat_mean_abs FROM c"""
)
def dist_similarity_federated(spark, d):
    return rounded(fidelity.distance_means_federated(real(spark, d), syn(spark, d), NUM))


_TV = f"p AS (SELECT \"column\", value, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY \"column\") AS p FROM ({unpivot('real', NOM)}) GROUP BY \"column\", value), q AS (SELECT \"column\", value, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY \"column\") AS q FROM ({unpivot('syn', NOM)}) GROUP BY \"column\", value)"
_TV_SQL = with_("real", "syn", more=_TV) + 'SELECT "column", round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS tv FROM p FULL JOIN q USING ("column", value) GROUP BY 1'


@query(_TV_SQL)
def categorical_tv(spark, d):
    return rounded(fidelity.total_variation(fidelity.category_counts(real(spark, d), NOM), fidelity.category_counts(syn(spark, d), NOM)))


@query(_TV_SQL)
def categorical_tv_federated(spark, d):
    return rounded(fidelity.total_variation(fidelity.merge_counts(fidelity.category_counts(real(spark, d), NOM, ["client_id"])), fidelity.category_counts(syn(spark, d), NOM)))


@query(with_("real") + f"SELECT client_id, \"column\", coalesce(value, '__NA__') AS category, count(*) AS n FROM ({unpivot('real', NOM, 'client_id')}) GROUP BY GROUPING SETS ((client_id, \"column\", value), (\"column\", value))")
def category_counts_grouping_sets(spark, d):
    return fidelity.category_counts(real(spark, d), NOM, ["client_id"], whole_too=True)


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]


@query(with_("real", "syn") + "SELECT round(sqrt(2 * (" + " + ".join(f"pow(r{i} - s{i}, 2)" for i in range(len(_PAIRS))) + ")), 6) AS corr_fro_diff FROM (SELECT " + ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM real), (SELECT " + ", ".join(f"corr({a}, {b}) AS s{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM syn)")
def corr_fro_diff(spark, d):
    return rounded(fidelity.correlation_gap(real(spark, d), syn(spark, d), NUM))


# ---- scores, utility, fairness


@query(f"SELECT \"column\", round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM ({unpivot('lineitem', NUM)}) GROUP BY 1")
def preprocess_stats(spark, d):
    return rounded(learn.preprocess_stats(table(spark, d, "lineitem"), NUM))


@query(with_("scored") + "SELECT round(sum(p * (below + 0.5 * n)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc FROM (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY 1))")
def roc_auc(spark, d):
    return rounded(scores.roc_auc(scored(spark, d)))


@query(with_("scored") + "SELECT client_id, round(avg((pred = label)::INT), 6) AS accuracy FROM scored GROUP BY 1")
def accuracy(spark, d):
    return rounded(scores.accuracy(scored(spark, d), ["client_id"]))


@query(with_("scored") + "SELECT client_id, round(sqrt(avg(pow(label - score, 2))), 6) AS rmse FROM scored GROUP BY 1")
def rmse(spark, d):
    return rounded(scores.rmse(scored(spark, d), ["client_id"], pred="score"))


_SCHEMA = sch.TableSchema(tuple([*(sch.ColumnSchema(c, "continuous") for c in NUM), sch.ColumnSchema("l_returnflag", "categorical"), sch.ColumnSchema("l_linestatus", "binary")]))
_MODEL = [*NUM, *NOM]


@query()
def tstr(spark, d):
    r, s = real(spark, d).select(*_MODEL), syn(spark, d).select(*_MODEL)
    parts = [learn.tstr(s, r, _SCHEMA, t).withColumn("target", F.lit(t)) for t in ("l_returnflag", "l_linestatus", "l_extendedprice")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def tstr_federated(spark, d):
    got = learn.tstr(syn(spark, d).select(*_MODEL), real(spark, d).select("client_id", *_MODEL), _SCHEMA, "l_linestatus", ["client_id"])
    return learn.merge_by_rows(got, ["tstr_auc", "tstr_accuracy", "tstr_rmse"])


@query()
def aia(spark, d):
    return learn.attribute_inference(syn(spark, d).select(*_MODEL), real(spark, d).select(*_MODEL), _SCHEMA, "l_linestatus", "l_returnflag")


@query()
def aia_federated(spark, d):
    got = learn.attribute_inference(syn(spark, d).select(*_MODEL), real(spark, d).select("client_id", *_MODEL), _SCHEMA, "l_extendedprice", "l_returnflag", ["client_id"])
    return learn.merge_by_rows(got, ["aia_auc", "aia_accuracy", "aia_rmse"])


_CELLS = 'cells AS (SELECT client_id, "group", count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM scored GROUP BY ALL HAVING count(*) >= 30)'
_RATES = 'rates AS (SELECT (tp + fp)::DOUBLE / (tp + fp + tn + fn) AS pr, tp::DOUBLE / nullif(tp + fn, 0) AS tpr, fp::DOUBLE / nullif(fp + tn, 0) AS fpr FROM (SELECT "group", sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM cells GROUP BY 1 HAVING sum(tp + fp + tn + fn) >= 30))'


def _fair(spark, d):
    return scores.fairness_gaps(scores.merge_confusion(scores.confusion(scored(spark, d))))


@query(with_("scored", more=_CELLS) + "SELECT * FROM cells")
def group_confusion(spark, d):
    return scores.confusion(scored(spark, d))


@query(with_("scored", more=_CELLS.replace("GROUP BY ALL", 'GROUP BY GROUPING SETS ((client_id, "group"), ("group"))')) + "SELECT * FROM cells")
def confusion_grouping_sets(spark, d):
    return scores.confusion(scored(spark, d), whole_too=True)


@query(with_("scored", more=_CELLS + ", " + _RATES) + "SELECT round(max(pr) - min(pr), 6) AS demographic_parity_diff FROM rates")
def demographic_parity(spark, d):
    return rounded(_fair(spark, d).select("demographic_parity_diff"))


@query(with_("scored", more=_CELLS + ", " + _RATES) + "SELECT round(max(tpr) - min(tpr), 6) AS equal_opportunity_diff FROM rates")
def equal_opportunity(spark, d):
    return rounded(_fair(spark, d).select("equal_opportunity_diff"))


@query(with_("scored", more=_CELLS + ", " + _RATES) + "SELECT round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds_diff FROM rates")
def equalized_odds(spark, d):
    return rounded(_fair(spark, d).select("equalized_odds_diff"))


@query(with_("scored", more=_CELLS + ", " + _RATES) + "SELECT round(max(pr) - min(pr), 6) AS demographic_parity_diff, round(max(tpr) - min(tpr), 6) AS equal_opportunity_diff, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds_diff FROM rates")
def fairness_federated(spark, d):
    return rounded(_fair(spark, d))


@query()
def fairness(spark, d):
    binary = lambda t: t.select(*NUM, "l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("late"))
    schema = sch.TableSchema((*_SCHEMA.columns[:5], sch.ColumnSchema("late", "binary")))
    return scores.fairness_gaps(learn.fairness_cells(binary(syn(spark, d)), binary(real(spark, d)), schema, "l_returnflag", "late"))


# ---- privacy

_CANON = "coalesce(o_custkey::VARCHAR, '__NaN__') || '|' || coalesce(trim(o_orderpriority), '__NaN__') || '|' || coalesce(trim(o_orderstatus), '__NaN__') || '|' || CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN '__NaN__' WHEN isinf(o_totalprice) THEN 'Infinity' ELSE printf('%.8f', o_totalprice) END"
_KEYS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_SIX = ["o_orderstatus", "o_orderpriority", "o_totalprice"]


@query(with_("nulled") + f"SELECT o_orderkey, {_CANON} AS row FROM nulled")
def canonical_row(spark, d):
    t = nulled(spark, d)
    return t.select("o_orderkey", privacy.canonical_row(privacy.canonical_kinds(t), _KEYS).alias("row"))


@query(with_("nulled") + f"SELECT o_orderkey, md5({_CANON}) AS h FROM nulled")
def row_md5(spark, d):
    t = nulled(spark, d)
    return t.select("o_orderkey", privacy.row_hash(privacy.canonical_kinds(t), _KEYS).alias("h"))


@query(with_("ord", "copied") + "SELECT client_id, coalesce(sum(n), 0)::BIGINT AS matches FROM (SELECT DISTINCT client_id, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM ord) LEFT JOIN (SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority, count(*) AS n FROM copied GROUP BY ALL) USING (o_custkey, o_orderstatus, o_totalprice, o_orderpriority) GROUP BY 1")
def exact_overlap(spark, d):
    return privacy.overlap(orders(spark, d), copied(spark, d), _KEYS)


# distinct ratios of price > priority > state in any client, so the prefixes are the same for all of them
_TOP = [(1, ["o_totalprice"]), (2, ["o_totalprice", "o_orderpriority"]), (3, ["o_totalprice", "o_orderpriority", "o_orderstatus"])]
_PART = " UNION ALL ".join(f"SELECT client_id, {k} AS top, coalesce(sum(n), 0)::BIGINT AS matches FROM (SELECT DISTINCT client_id, {', '.join(c)} FROM ord) LEFT JOIN (SELECT {', '.join(c)}, count(*) AS n FROM copied GROUP BY ALL) USING ({', '.join(c)}) GROUP BY 1" for k, c in _TOP)


@query(with_("ord", "copied") + _PART)
def partial_overlap_topk(spark, d):
    return privacy.partial_overlaps(orders(spark, d), copied(spark, d), _SIX)


@query(with_("ord", "copied", more=f"e AS ({ORACLE_SQLS['exact_overlap'].split('AS client_id FROM orders) ', 2)[-1]}), p AS ({_PART})") + "SELECT round((SELECT sum(matches) FROM e)::DOUBLE / n, 6) AS exact_row_match_rate_train, ((SELECT sum(matches) FROM e) > 0)::INT::DOUBLE AS exact_row_match_any, " + ", ".join(f"round((SELECT sum(matches) FROM p WHERE top = {k})::DOUBLE / n, 6) AS partial_match_rate_top{k}" for k in (1, 2, 3)) + ", ((SELECT sum(matches) FROM p) > 0)::INT::DOUBLE AS partial_match_any FROM (SELECT count(*) AS n FROM copied)")
def overlap_rates(spark, d):
    return rounded(privacy.overlap_rates(orders(spark, d), copied(spark, d), _KEYS, _SIX))


def _probe_sql(k: int) -> str:
    part = lambda label: f"(SELECT '{label}-' || o_orderkey::VARCHAR AS id, {label} AS label, o_totalprice::DOUBLE AS a, o_custkey::DOUBLE AS b FROM orders WHERE o_orderkey % 3 = {1 - label} ORDER BY {u01(46, 'o_orderkey')}, o_orderkey LIMIT {k})"
    return f"q AS ({part(1)} UNION ALL {part(0)}), s AS (SELECT o_totalprice::DOUBLE AS a, o_custkey::DOUBLE AS b FROM orders WHERE o_orderkey % 3 = 2), r AS (SELECT min(a) AS a0, max(a) - min(a) AS aw, min(b) AS b0, max(b) - min(b) AS bw FROM s), nn AS (SELECT id, label, sqrt(min(pow((q.a - s.a) / aw, 2) + pow((q.b - s.b) / bw, 2))) AS distance FROM q, s, r GROUP BY ALL)"


def _nearest(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    third = lambda i: o.where(F.col("o_orderkey") % 3 == i)
    return privacy.nearest_distances(privacy.probe(third(0), third(1), "o_orderkey"), third(2), ["o_totalprice", "o_custkey"])


@query("WITH " + _probe_sql(1000) + " SELECT id, label, round(distance, 6) AS distance FROM nn")
def mia_nn_distance(spark, d):
    return rounded(_nearest(spark, d))


_MIA = "md AS (SELECT quantile_cont(-distance, 0.5) AS md FROM nn), au AS (SELECT sum(p * (below + 0.5 * n)) / (sum(p)::DOUBLE * sum(n)) AS auc FROM (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT -distance AS s, sum(label) AS p, sum(1 - label) AS n FROM nn GROUP BY 1)))"


@query("WITH " + _probe_sql(1000) + ", " + _MIA + " SELECT round((SELECT auc FROM au), 4) AS mia_auc, round(avg(((-distance > md)::INT = label)::INT), 4) AS mia_accuracy, round(avg((-distance > md)::INT) FILTER (label = 1) - avg((-distance > md)::INT) FILTER (label = 0), 4) AS mia_advantage FROM nn, md")
def mia_scores(spark, d):
    return rounded(privacy.membership_scores(_nearest(spark, d)), 4)


_MIA_BY = f"""WITH p AS (SELECT o_orderkey, (o_custkey % 3)::INT AS client_id, (o_orderkey % 3 = 0)::INT AS label, o_totalprice::DOUBLE AS a, o_custkey::DOUBLE AS b, row_number() OVER (PARTITION BY o_custkey % 3, o_orderkey % 3 ORDER BY {u01(46, 'o_orderkey')}, o_orderkey) AS rn FROM orders WHERE o_orderkey % 3 < 2),
k AS (SELECT client_id, least(1000, count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS k FROM p GROUP BY 1), q AS (SELECT p.* FROM p JOIN k USING (client_id) WHERE rn <= k),
s AS (SELECT o_totalprice::DOUBLE AS a, o_custkey::DOUBLE AS b FROM orders WHERE o_orderkey % 3 = 2), r AS (SELECT min(a) AS aw0, max(a) - min(a) AS aw, max(b) - min(b) AS bw FROM s),
nn AS (SELECT client_id, o_orderkey, label, -sqrt(min(pow((q.a - s.a) / aw, 2) + pow((q.b - s.b) / bw, 2))) AS sc FROM q, s, r GROUP BY ALL),
g AS (SELECT client_id, sc, sum(label) AS p, sum(1 - label) AS n FROM nn GROUP BY ALL), au AS (SELECT client_id, sum(p * (below + 0.5 * n)) / (sum(p)::DOUBLE * sum(n)) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY client_id ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) GROUP BY 1)
"""


@query(_MIA_BY + "SELECT client_id, k, round(auc, 4) AS mia_auc FROM au JOIN k USING (client_id)")
def mia_by_client(spark, d):
    return rounded(_mia_by_client(spark, d).select("client_id", "k", "mia_auc"), 4)


@query(_MIA_BY + "SELECT round(sum(auc * k) / sum(k), 4) AS mia_auc FROM au JOIN k USING (client_id)")
def mia_federated(spark, d):
    return rounded(privacy.membership_federated(_mia_by_client(spark, d)), 4)


def _mia_by_client(spark, d):
    o = orders(spark, d).select("o_orderkey", "client_id", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    third = lambda i: o.where(F.col("o_orderkey") % 3 == i)
    return privacy.membership_by_client(third(0), third(1), third(2), "o_orderkey", ["o_totalprice", "o_custkey"])


# ---- runs and metrics plumbing

_RUNS = "SELECT run_id, round(epoch(max(ts) - min(ts)), 3) AS wall_clock_seconds, sum(CASE WHEN type = 'request' THEN byte_count ELSE 0 END)::BIGINT AS bytes_sent, sum(CASE WHEN type = 'reply' THEN byte_count ELSE 0 END)::BIGINT AS bytes_received, count(*) FILTER (type = 'round') AS rounds FROM runs GROUP BY 1"


@query(with_("runs") + _RUNS)
def run_scalability(spark, d):
    return rounded(monitor.run_totals(run_events(spark, d)), 3)


@query(with_("runs") + _RUNS)
def stream_scalability(spark, d):
    source = spark.read.parquet(f"{d}/events.parquet").schema
    folder = f"{d}/events.parquet"
    path = scratch_path(spark, "events")
    spark.read.parquet(folder).write.parquet(path)
    stream = spark.readStream.schema(source).parquet(path)
    kind = F.when(F.col("event_type") == "click", "request").when(F.col("event_type") == "view", "reply").when(F.col("event_type") == "purchase", "round").otherwise(F.col("event_type"))
    events = stream.select((F.col("user_id") % 5).alias("run_id"), "ts", kind.alias("type"), F.floor("value").cast("long").alias("byte_count"))
    totals = scratch_path(spark, "totals")
    monitor.stream_totals(events, totals, scratch_path(spark, "stream")).awaitTermination()
    return rounded(monitor.latest_totals(spark, totals), 3)


@query(with_("runs") + "SELECT event_id, run_id, type FROM runs WHERE type IN ('request', 'reply')")
def event_filter(spark, d):
    return monitor.only(run_events(spark, d), ["request", "reply"]).select("event_id", "run_id", "type")


@query(with_("runs") + "SELECT run_id, round(sum(s * n) / sum(n), 6) AS value FROM (SELECT run_id, client_id, sum(value) / count(*) FILTER (type = 'round') AS s, count(*) AS n FROM runs GROUP BY ALL) GROUP BY 1")
def train_seconds_mean(spark, d):
    by = run_events(spark, d).groupBy("run_id", "client_id").agg(F.try_divide(F.sum("value"), F.count_if(F.col("type") == "round")).alias("value"), F.count("*").alias("weight"))
    return rounded(metrics.weighted_means(by, ["run_id"]))


@query(with_("nulled") + "SELECT round(sum(o_totalprice * w) FILTER (o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) AND w > 0) / sum(w) FILTER (o_totalprice IS NOT NULL AND NOT isnan(o_totalprice) AND w > 0), 4) AS value FROM (SELECT CASE WHEN isinf(o_totalprice) THEN NULL ELSE o_totalprice END AS o_totalprice, (o_custkey % 5)::DOUBLE AS w FROM nulled)")
def weighted_mean_(spark, d):
    t = nulled(spark, d).withColumn("v", F.when(F.abs("o_totalprice") != float("inf"), F.col("o_totalprice")))
    return rounded(t.agg(weighted_mean(F.col("v"), (F.col("o_custkey") % 5).cast("double")).alias("value")), 4)


QUERIES["weighted_mean"], ORACLE_SQLS["weighted_mean"] = QUERIES.pop("weighted_mean_"), ORACLE_SQLS.pop("weighted_mean_")


@query(with_("real") + f"SELECT \"column\" AS key, round(sum(m * n) / sum(n), 6) AS value FROM (SELECT client_id, \"column\", avg(value) AS m, count(*) AS n FROM ({unpivot('real', NUM, 'client_id')}) GROUP BY ALL) GROUP BY 1")
def weighted_mean_metrics(spark, d):
    m = fidelity.moments(fidelity.numbers(real(spark, d), NUM, ["client_id"]), ["client_id"])
    return rounded(metrics.weighted_means(m.select(F.col("column").alias("key"), F.col("mean").alias("value"), F.col("n").alias("weight"))))


@query("SELECT DISTINCT regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z_]+', '_', 'g') AS key FROM part")
def normalize_key(spark, d):
    return table(spark, d, "part").select(normalized_key(F.concat_ws(" ", "p_name", "p_brand")).alias("key")).distinct()


@query("SELECT 'fairness.' || m || '.' || trim(regexp_replace(lower(n_name), '[^a-z_]+', '_', 'g')) AS key, count(*) AS n FROM nation, customer, (VALUES ('demographic_parity_diff'), ('equal_opportunity_diff'), ('equalized_odds_diff')) t(m) WHERE c_nationkey = n_nationkey GROUP BY 1")
def metric_keys(spark, d):
    specs = F.array(*[F.lit(k.removesuffix(".{}")) for k in metrics.SPECS["fairness"]])
    rows = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_name", F.explode(specs).alias("metric"))
    return rows.select(F.concat_ws(".", F.lit("fairness"), "metric", normalized_key(F.col("n_name"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT c_custkey AS k FROM customer) SELECT k::VARCHAR AS key, 'undeclared' AS problem FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k::VARCHAR, 'missing' FROM b WHERE k NOT IN (SELECT k FROM a)")
def key_check(spark, d):
    emitted = table(spark, d, "orders").where(F.col("o_orderkey") % 2 == 0).select(F.col("o_custkey").cast("string").alias("key"))
    return metrics.key_differences(emitted, table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key")))


@query(with_("real") + f"SELECT \"column\" AS key, round(CASE WHEN \"column\" IN ('l_tax', 'l_discount') THEN max(value) ELSE avg(value) END, 6) AS value FROM ({unpivot('real', NUM)}) GROUP BY 1")
def merged_metrics(spark, d):
    long = fidelity.numbers(real(spark, d), NUM)
    low = long.groupBy(F.col("column").alias("key")).agg(F.avg("value").alias("value"))
    return rounded(metrics.merge_metrics(low, long.where(F.col("column").isin("l_tax", "l_discount")).groupBy(F.col("column").alias("key")).agg(F.max("value").alias("value"))))


_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_LATE = "SELECT *, (l_linestatus = 'F')::INT AS late FROM lineitem"
#: What clients train on: the first lines of orders, less a fifth of each client's rows, which it holds out.
_TRAIN = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {u01(43, _KEY)}, {_KEY}) - 1 AS idx, count(*) OVER (PARTITION BY client_id) AS n_rows FROM (SELECT *, (l_suppkey % 3)::INT AS client_id FROM ({_LATE}) WHERE l_linenumber < 4)) WHERE idx >= ceil(0.2::DOUBLE * n_rows)"
_FLAGS = ["l_returnflag", "late"]
_MEANS = """SELECT 'fidelity.mean_abs_diff' AS key, avg(abs(rm.m - sm.m)) AS value FROM rm JOIN sm USING ("column") UNION ALL SELECT 'fidelity.std_abs_diff', avg(abs(rm.s - sm.s)) FROM rm JOIN sm USING ("column")"""
_TVS = _TV.replace(unpivot("real", NOM), unpivot("real", _FLAGS)).replace(unpivot("syn", NOM), unpivot("syn", _FLAGS))
_TV_MEAN = "SELECT 'fidelity.categorical_tv_mean', avg(tv) FROM (" + 'SELECT "column", 0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))) AS tv FROM p FULL JOIN q USING ("column", value) GROUP BY 1)'
_NO_RUN = " UNION ALL ".join(f"SELECT 'scalability.{k}', NULL" for k in metrics.SPECS["scalability"])
_GLOBAL_FID = (
    f"WITH real AS (SELECT * FROM ({_LATE}) WHERE l_linenumber = 4), syn AS (SELECT * FROM ({_LATE}) WHERE l_linenumber > 4), {_MOM}, {_DIST}, {_TVS}, k AS (SELECT \"column\", max(abs(fr - fs)) AS ks, sum(abs(fr - fs) * (nx - value)) AS w FROM f GROUP BY 1) {_MEANS} "
    + "UNION ALL SELECT 'fidelity.ks_mean', avg(ks) FROM k UNION ALL SELECT 'fidelity.wasserstein_mean', avg(w) FROM k UNION ALL SELECT 'fidelity.t_stat_mean_abs', avg(abs(rm.m - sm.m) / sqrt(rm.s * rm.s / rm.n + sm.s * sm.s / sm.n)) FROM rm JOIN sm USING (\"column\") "
    + f"UNION ALL {_TV_MEAN} UNION ALL SELECT 'fidelity.corr_fro_diff', sqrt(2 * (" + " + ".join(f"pow(r{i} - s{i}, 2)" for i in range(len(_PAIRS))) + ")) FROM (SELECT " + ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM real), (SELECT " + ", ".join(f"corr({a}, {b}) AS s{i}" for i, (a, b) in enumerate(_PAIRS)) + f" FROM syn) UNION ALL {_NO_RUN}"
)
_FED_FID = (
    f"WITH real AS ({_TRAIN}), syn AS (SELECT * FROM ({_LATE}) WHERE l_linenumber > 4), {_MOM}, {_FED}, {_TVS}, k AS (SELECT client_id, \"column\", max(abs(fr - fs)) AS ks, sum(abs(fr - fs) * (nx - value)) AS w FROM f GROUP BY ALL), "
    + f"rc AS (SELECT client_id, \"column\", count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM ({unpivot('real', NUM, 'client_id')}) GROUP BY ALL), t AS (SELECT client_id, \"column\", rc.n, abs(rc.m - sm.m) / sqrt(rc.v / rc.n + sm.s * sm.s / sm.n) AS t FROM rc JOIN sm USING (\"column\")), "
    + f"c AS (SELECT client_id, avg(ks) AS ks, avg(w) AS w, avg(t) AS t, max(n) AS n FROM k JOIN t USING (client_id, \"column\") GROUP BY 1) {_MEANS} UNION ALL SELECT 'fidelity.ks_mean', sum(ks * n) / sum(n) FROM c UNION ALL SELECT 'fidelity.wasserstein_mean', sum(w * n) / sum(n) FROM c UNION ALL SELECT 'fidelity.t_stat_mean_abs', sum(t * n) / sum(n) FROM c "
    + f"UNION ALL {_TV_MEAN} UNION ALL SELECT 'fidelity.corr_fro_diff', NULL UNION ALL {_NO_RUN}"
)


def _context(spark, d) -> suite.Context:
    t = table(spark, d, "lineitem").withColumn("late", (F.col("l_linestatus") == "F").cast("int")).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    cols = [*NUM, "l_returnflag", "late"]
    schema = sch.TableSchema((*_SCHEMA.columns[:5], sch.ColumnSchema("late", "binary")))
    own = t.where("l_linenumber < 4").select("key", (F.col("l_suppkey") % 3).cast("int").alias("client_id"), *cols)
    own = split.client_split(own, "key", 0.2, 43)
    return suite.Context(
        schema=schema, key="key", target="late", sensitive=("l_returnflag",), syn=t.where("l_linenumber > 4").select(*cols), holdout=t.where("l_linenumber = 4").select("key", *cols),
        train=split.all_train(own).drop("split"), test=own.where("split = 'test'").drop("split"),
    )


def _both(spark, d, *categories: str) -> DataFrame:
    ctx = _context(spark, d).written()
    return suite.report(ctx, categories).unionByName(suite.report(ctx, categories, by_client=True))


@query(f"SELECT 'global' AS mode, key, round(value::DOUBLE, 6) AS value FROM ({_GLOBAL_FID}) UNION ALL SELECT 'federated', key, round(value::DOUBLE, 6) FROM ({_FED_FID})")
def report_fidelity(spark, d):
    return rounded(_both(spark, d, "fidelity"))


@query()
def full_report(spark, d):
    return _both(spark, d, *metrics.SPECS)


# ---- aggregation of client state


@query(with_("params", "counts") + "SELECT param, pos, round(sum(value * n) / sum(n), 6) AS value FROM params JOIN counts USING (client_id) GROUP BY ALL")
def fedavg(spark, d):
    return rounded(federate.fedavg(params(spark, d), param_counts(spark, d)))


_PROF = f"pr AS (SELECT client_id, \"column\", coalesce(value, '__NA__') AS category, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY client_id, \"column\") AS share FROM ({unpivot('ord', ['o_orderstatus', 'o_orderpriority'], 'client_id')}) GROUP BY client_id, \"column\", value), ct AS (SELECT client_id, count(*) AS n FROM ord GROUP BY 1)"
_JS = 'de AS (SELECT c.client_id, x."column", x.category, c.n AS rows, coalesce(pr.share, 0) AS p FROM (SELECT DISTINCT "column", category FROM pr) x CROSS JOIN ct c LEFT JOIN pr ON pr.client_id = c.client_id AND pr."column" = x."column" AND pr.category = x.category), q AS (SELECT "column", category, sum(p * rows) / sum(rows) AS q FROM de GROUP BY ALL), js AS (SELECT client_id, "column", sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2)) AS distance FROM de JOIN q USING ("column", category) GROUP BY ALL)'
_SIM = 'si AS (SELECT client_id, sum(CASE WHEN t > 0 THEN distance / t ELSE 1.0 / k END) AS s FROM (SELECT *, sum(distance) OVER (PARTITION BY "column") AS t, count(*) OVER (PARTITION BY "column") AS k FROM js) GROUP BY 1), zz AS (SELECT client_id, (1 - s / sum(s) OVER ()) * (n / sum(n) OVER ()) AS z FROM si JOIN ct USING (client_id)), wt AS (SELECT client_id, exp(z - max(z) OVER ()) / sum(exp(z - (SELECT max(z) FROM zz))) OVER () AS weight FROM zz)'
_CATS = ["o_orderstatus", "o_orderpriority"]


def _profiles(spark, d):
    return federate.client_profiles(orders(spark, d), _CATS)


def _client_rows(spark, d):
    return orders(spark, d).groupBy("client_id").agg(F.count("*").alias("n"))


def _weights(spark, d):
    return federate.similarity_weights(federate.similarity(federate.js_distance(_profiles(spark, d), _client_rows(spark, d))), _client_rows(spark, d))


@query(with_("ord", more=_PROF) + 'SELECT client_id, "column", category, n, round(share, 6) AS share FROM pr')
def client_profiles(spark, d):
    return rounded(_profiles(spark, d))


@query(with_("ord", more=_PROF + ", " + _JS) + 'SELECT client_id, "column", round(distance, 6) AS distance FROM js')
def js_distance(spark, d):
    return rounded(federate.js_distance(_profiles(spark, d), _client_rows(spark, d)))


_CW = "tk AS (SELECT client_id, n, floor(n * n / sum(n) OVER ())::BIGINT AS take FROM (SELECT client_id, count(*) AS n FROM ord GROUP BY 1)), fp AS (SELECT o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY o_orderkey) AS rn FROM ord) JOIN tk USING (client_id) WHERE rn <= take), "
_CW += _cdf_sql("SELECT client_id, o_totalprice AS value FROM ord", "SELECT client_id, value FROM fp CROSS JOIN tk", "client_id")


@query(with_("ord", more=_CW) + "SELECT client_id, 'o_totalprice' AS \"column\", round(sum(abs(fr - fs) * (nx - value)), 6) AS distance FROM f GROUP BY 1")
def client_wasserstein(spark, d):
    return rounded(federate.client_wasserstein(orders(spark, d), ["o_totalprice"], "o_orderkey"))


@query(with_("ord", more=_PROF + ", " + _JS + ", " + _SIM) + "SELECT client_id, round(weight, 6) AS weight FROM wt")
def similarity_weights(spark, d):
    return rounded(_weights(spark, d))


@query(with_("ord", "params", more=_PROF + ", " + _JS + ", " + _SIM) + "SELECT param, pos, round(sum(value * weight) / sum(weight), 6) AS value FROM params JOIN wt USING (client_id) GROUP BY ALL")
def similarity_fedavg(spark, d):
    return rounded(federate.weighted_params(params(spark, d), _weights(spark, d)))


# ---- encoders


@query("SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS scaled FROM orders")
def minmax_scale(spark, d):
    o = table(spark, d, "orders")
    return rounded(o.select("o_orderkey", encode.scale(F.col("o_totalprice"), *encode.minmax(o, ["o_totalprice"])["o_totalprice"]).alias("scaled")))


@query("SELECT o_orderkey, code FROM orders JOIN (SELECT o_orderpriority, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)) USING (o_orderpriority)")
def label_encode(spark, d):
    o = table(spark, d, "orders")
    return o.join(encode.label_codes(o, "o_orderpriority"), F.col("o_orderpriority") == F.col("value")).select("o_orderkey", "code")


@query(f"WITH c AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS l FROM orders) SELECT o_orderkey, l[1 + least(len(l) - 1, greatest(0, round_even({u01(60, 'o_orderkey')} * (len(l) - 1), 0)))::INT] AS value FROM orders, c")
def label_decode(spark, d):
    o = table(spark, d, "orders")
    codes = encode.label_codes(o, "o_orderpriority")
    n = codes.count()
    return o.withColumn("code", encode.code_of_unit(hash_u01(60, F.col("o_orderkey")), n)).join(codes, "code").select("o_orderkey", "value")


@query("SELECT value, (row_number() OVER (ORDER BY value) - 1)::INT AS code FROM (SELECT 'o_orderstatus_' || o_orderstatus AS value FROM orders UNION SELECT 'o_orderpriority_' || o_orderpriority FROM orders)")
def shared_vocab(spark, d):
    return encode.shared_vocabulary(table(spark, d, "orders"), _CATS)


@query("WITH c AS (SELECT o_totalprice AS v, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT v, (coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n - 1) / 2.0) / (sum(n) OVER () - 1.0) AS u FROM c) SELECT o_orderkey, round(u, 6) AS u FROM orders JOIN r ON v = o_totalprice")
def quantile_uniform(spark, d):
    return rounded(encode.quantile_uniform(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "u"))


#: A mixture for order prices: weight, mean, deviation. An input of the two queries below.
_MODES = [(0.3, 100000.0, 40000.0), (0.5, 250000.0, 60000.0), (0.2, 420000.0, 50000.0)]


def _modes():
    return F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(m).alias("mean"), F.lit(s).alias("std")) for w, m, s in _MODES])


_DENS = [f"({w} / {s} * exp(-0.5 * pow((o_totalprice - {m}) / {s}, 2.0)) + 1e-6)" for w, m, s in _MODES]
_MN = f"WITH x AS (SELECT o_orderkey, o_totalprice, {u01(61, 'o_orderkey')} AS u, {_DENS[0]}::DOUBLE AS d0, {_DENS[1]}::DOUBLE AS d1, {_DENS[2]}::DOUBLE AS d2 FROM orders), y AS (SELECT *, ((d0 / (d0 + d1 + d2) <= u)::INT + ((d0 + d1) / (d0 + d1 + d2) <= u)::INT)::INT AS mode FROM x) "


@query(_MN + "SELECT o_orderkey, mode, round(greatest(-0.99, least(0.99, (o_totalprice - [100000.0::DOUBLE, 250000.0, 420000.0][mode + 1]) / (4 * [40000.0::DOUBLE, 60000.0, 50000.0][mode + 1]))), 11)::DOUBLE AS value FROM y")
def mode_normalize(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", encode.mode_normalized(F.col("o_totalprice"), _modes(), hash_u01(61, F.col("o_orderkey"))).alias("e"))
    return rounded(t.select("o_orderkey", "e.mode", "e.value"), 11)


@query(_MN + "SELECT o_orderkey, round([100000.0, 250000.0, 420000.0][mode + 1] + 4 * [40000.0, 60000.0, 50000.0][mode + 1] * greatest(-0.99, least(0.99, (o_totalprice - [100000.0::DOUBLE, 250000.0, 420000.0][mode + 1]) / (4 * [40000.0::DOUBLE, 60000.0, 50000.0][mode + 1]))), 4)::DOUBLE AS value FROM y")
def mode_denormalize(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", encode.mode_normalized(F.col("o_totalprice"), _modes(), hash_u01(61, F.col("o_orderkey"))).alias("e"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (i == F.col("e.mode")).cast("double"))
    return rounded(t.select("o_orderkey", encode.mode_denormalized(F.col("e.value"), hot, _modes()).alias("value")), 4)


@query("WITH p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS place FROM orders GROUP BY 1) SELECT o_orderkey, array_to_string(list_transform(range((SELECT count(*) FROM p)), lambda i: (i = place)::INT), '') AS hot FROM orders JOIN p USING (o_orderpriority)")
def one_hot(spark, d):
    o = table(spark, d, "orders")
    places = encode.category_order(o, "o_orderpriority")
    n = places.count()
    return o.join(places, F.col("o_orderpriority") == F.col("value")).select("o_orderkey", F.array_join(encode.one_hot(F.col("place"), n), "").alias("hot"))


@query(f"WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT 'o_orderstatus_' || o_orderstatus AS value FROM orders UNION SELECT 'o_orderpriority_' || o_orderpriority FROM orders)), c AS (SELECT code FROM v WHERE value LIKE 'o_orderstatus%'), x AS (SELECT o_orderkey AS id, {u01(62, 'o_orderkey')} * 10 AS value FROM orders) SELECT id, arg_min(code, (abs(code - value), code))::INT AS code FROM x, c GROUP BY id")
def nearest_code(spark, d):
    o = table(spark, d, "orders")
    vocabulary = encode.shared_vocabulary(o, _CATS).withColumn("column", F.when(F.col("value").startswith("o_orderstatus_"), "o_orderstatus").otherwise("o_orderpriority")).drop("value")
    rows = o.select(F.col("o_orderkey").alias("id"), F.lit("o_orderstatus").alias("column"), (hash_u01(62, F.col("o_orderkey")) * 10).alias("value"))
    return encode.nearest_code(vocabulary, rows).select("id", "code")


# ---- generators; the number of rows is that of a table, as of a holdout


@query("SELECT row_number() OVER () - 1 AS id, 0.0::DOUBLE AS l_quantity, 0.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 'unknown' AS l_returnflag, 'no' AS l_linestatus FROM orders")
def gen_constant(spark, d):
    return synth.constant_rows(spark, _SCHEMA, synth.row_count(None, table(spark, d, "orders")))


@query(f"SELECT id, round(a + {u01(70, 'id')} * w, 6) AS o_totalprice FROM (SELECT row_number() OVER () - 1 AS id FROM orders), (SELECT min(o_totalprice) AS a, max(o_totalprice) - min(o_totalprice) AS w FROM orders)")
def gen_uniform(spark, d):
    o = table(spark, d, "orders")
    return rounded(synth.uniform_rows(o, ["o_totalprice"], synth.row_count(None, o), 70))


_G = f"g AS (SELECT pos, sum(value * n) / sum(n) AS value FROM (SELECT client_id, n, unnest(grid) AS value, generate_subscripts(grid, 1) - 1 AS pos FROM (SELECT client_id, count(*) AS n, quantile_cont(o_totalprice, [{', '.join(map(str, synth.GRID))}]) AS grid FROM ord GROUP BY 1)) GROUP BY pos)"
_GM = f"i AS (SELECT row_number() OVER () - 1 AS id FROM orders), n AS (SELECT id, {u01(71, chr(39) + 'o_totalprice|' + chr(39) + ' || id')} * 20 AS pl FROM i), k AS (SELECT id, pl, least(floor(pl), 19)::INT AS j FROM n), cw AS (SELECT o_orderstatus AS category, count(*)::DOUBLE AS n FROM orders GROUP BY 1), cc AS (SELECT category, sum(n / (SELECT sum(n) FROM cw)) OVER (ORDER BY category) AS c FROM cw), cu AS (SELECT id, {u01(71, chr(39) + 'o_orderstatus|' + chr(39) + ' || id')} AS u FROM i)"


@query(with_("ord", more=_G + ", " + _GM) + "SELECT id, 'o_totalprice' AS \"column\", round(a.value + (b.value - a.value) * (pl - j), 4) AS number, NULL AS category FROM k JOIN g a ON a.pos = j JOIN g b ON b.pos = j + 1 UNION ALL SELECT id, 'o_orderstatus', NULL, coalesce(min(category) FILTER (c > u), max(category)) FROM cu CROSS JOIN cc GROUP BY id")
def gen_marginal(spark, d):
    o = orders(spark, d)
    grids, shares = synth.fit_marginals(o, ["o_totalprice"], ["o_orderstatus"])
    return rounded(synth.marginal_rows(grids, shares, o.count(), 71), 4)


_R = [f"({w} / {s} * exp(-0.5 * pow((o_totalprice - {m}) / {s}, 2.0)) + 1e-12)::DOUBLE" for w, m, s in _MODES]


@query("WITH r AS (SELECT o_totalprice AS v, " + ", ".join(f"{x} AS d{i}" for i, x in enumerate(_R)) + " FROM orders), m AS (" + " UNION ALL ".join(f"SELECT {i} AS mode, sum(d{i} / (d0 + d1 + d2)) AS n, sum(d{i} / (d0 + d1 + d2) * v) AS x, sum(d{i} / (d0 + d1 + d2) * v * v) AS xx FROM r" for i in range(3)) + ") SELECT 'o_totalprice' AS \"column\", mode, round(n / sum(n) OVER (), 6) AS weight, round(x / n, 3) AS mean, round(sqrt(xx / n - (x / n) * (x / n)), 3) AS std FROM m")
def gmm_round(spark, d):
    start = spark.createDataFrame([("o_totalprice", i, *m) for i, m in enumerate(_MODES)], "column string, mode int, weight double, mean double, std double")
    got = synth.mixture_round(orders(spark, d), ["o_totalprice"], start)
    return got.select("column", "mode", F.round("weight", 6).alias("weight"), F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query()
def gen_mixture(spark, d):
    o = orders(spark, d)
    return synth.mixture_rows(synth.fit_mixture(o, ["o_totalprice"], modes=3, rounds=4), o.count(), 72)


#: A posterior of three modes for order prices, an input of the query below.
_DP = (lambda n: bayes.Posterior(1 + n, bayes.STICK + np.array([700.0, 200.0, 0.0]), 1 + n, np.array([m for _, m, _ in _MODES]), 1 + n, np.array([s * s for _, _, s in _MODES])))(np.array([300.0, 500.0, 200.0]))
_DP_LOGS = ", ".join(f"{o!r}::DOUBLE - pow(o_totalprice - {m!r}::DOUBLE, 2.0) / (2 * {v!r}::DOUBLE) AS d{i}" for i, (o, m, v) in enumerate(zip(_DP.offsets().tolist(), _DP.mean.tolist(), _DP.variance.tolist(), strict=True)))
_DP_SUMS = " UNION ALL ".join(f"SELECT {i} AS mode, sum(e{i} / (e0 + e1 + e2)) + 1e-9 AS n, sum(e{i} / (e0 + e1 + e2) * x) AS sx, sum(e{i} / (e0 + e1 + e2) * x * x) AS sxx FROM e" for i in range(3))


@query(
    f"""WITH pr AS (SELECT avg(o_totalprice) AS m0, var_samp(o_totalprice) AS v0 FROM orders), l AS (SELECT o_totalprice - m0 AS x, {_DP_LOGS} FROM orders, pr),
    e AS (SELECT x, exp(d0 - greatest(d0, d1, d2)) AS e0, exp(d1 - greatest(d0, d1, d2)) AS e1, exp(d2 - greatest(d0, d1, d2)) AS e2 FROM l), m AS ({_DP_SUMS}),
    p AS (SELECT mode, n, sx / n AS mm, greatest(sxx / n - (sx / n) * (sx / n), 0) + 1e-6 * v0 AS s, 1 + n AS a, 0.001 + coalesce(sum(n) OVER (ORDER BY mode ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS b FROM m, pr),
    w AS (SELECT *, a / (a + b) * exp(coalesce(sum(ln(b / (a + b))) OVER (ORDER BY mode ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS w FROM p)
    SELECT mode, round(w / sum(w) OVER (), 6) AS weight, round(m0 + n * mm / (1 + n), 3) AS mean, round(sqrt((v0 + n * s + n / (1 + n) * mm * mm) / (1 + n)), 3) AS std FROM w, pr"""
)
def dp_round(spark, d):
    counts = bayes.counted(orders(spark, d), ["o_totalprice"])
    got = bayes.dp_round(counts, {"o_totalprice": _DP}, bayes.priors(counts))["o_totalprice"]
    rows = [(i, round(float(w), 6), round(float(m), 3), round(float(v) ** 0.5, 3)) for i, (w, m, v) in enumerate(zip(got.weights(), got.mean, got.variance, strict=True))]
    return spark.createDataFrame(rows, "mode int, weight double, mean double, std double")


@query()
def fit_modes(spark, d):
    return bayes.fit_modes(orders(spark, d), ["o_totalprice"])


@query(with_("ord", more=_G) + "SELECT 'grid.o_totalprice' AS param, pos::INT AS pos, round(value, 4) AS value FROM g")
def fit_clients(spark, d):
    fit = rounds.fit_clients(orders(spark, d), rounds.marginal_method(["o_totalprice"], synth.GRID), {}, 1)
    return rounded(spark.createDataFrame([(p, i, float(v)) for p, vs in fit.state.items() for i, v in enumerate(vs)], "param string, pos int, value double"), 4)


@query()
def fit_clients_mixture(spark, d):
    o, cols = orders(spark, d), ["o_totalprice"]
    stop = monitor.EarlyStop(epsilon=1e-3, patience=2, higher=True)
    fit = rounds.fit_clients(o, rounds.mixture_method(cols, by_sums=True), rounds.mixture_state(o, cols, 3), 6, evaluate=rounds.log_likelihood(o, cols), stop=stop)
    return rounds.mixture_params(o, fit.state, cols)


_E = [f"sqrt(-2 * ln(greatest({u01(80 + 2 * i, 'id')}, 1e-12))) * cos({u01(81 + 2 * i, 'id')} * 6.283185307179586)" for i in range(2)]


@query(f"WITH r AS (SELECT corr(o_totalprice, o_custkey) AS r FROM orders), e AS (SELECT id, {_E[0]} AS e0, {_E[1]} AS e1 FROM (SELECT row_number() OVER () - 1 AS id FROM orders)) SELECT id, round(e0, 6) AS z0, round(r * e0 + sqrt(1 - r * r) * e1, 6) AS z1 FROM e, r")
def copula_project(spark, d):
    o = table(spark, d, "orders")
    lower = copula.factor(copula.correlations(o.select(F.col("o_totalprice").alias("a"), F.col("o_custkey").alias("b")), ["a", "b"]))
    return rounded(copula.projected(spark.range(o.count()), lower, 80))


@query()
def gen_copula(spark, d):
    t = table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return copula.copula_rows(spark, copula.fit_copula(t, "key", NUM), table(spark, d, "orders").count(), 81)


@query("SELECT count(*) AS n FROM orders")
def sample_check(spark, d):
    n = synth.row_count(None, table(spark, d, "orders"))
    uniform = synth.SYNTHESIZERS["uniform"]
    return uniform.sample(uniform.fit(real(spark, d), _SCHEMA), _SCHEMA, n, 73).where("l_quantity IS NOT NULL AND l_returnflag IS NOT NULL").agg(F.count("*").alias("n"))


# ---- early stopping

_HIST = "h AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS round, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM (SELECT user_id AS run_id, ts, event_id, value FROM events))"


def _history(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("run_id"), rn.alias("round"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("value"))


@query(
    "WITH RECURSIVE " + _HIST + """, s AS (SELECT run_id, 0::BIGINT AS round, NULL::DOUBLE AS best, 0 AS bad, 0 AS missing, NULL::BIGINT AS stop FROM (SELECT DISTINCT run_id FROM h)
    UNION ALL SELECT run_id, round, best, bad, missing, CASE WHEN bad >= 6 OR missing >= 5 THEN round END FROM (
      SELECT h.run_id, h.round, CASE WHEN h.value IS NOT NULL AND (s.best IS NULL OR h.value > s.best + 0.001) THEN h.value ELSE s.best END AS best,
             CASE WHEN h.value IS NULL THEN s.bad WHEN s.best IS NULL OR h.value > s.best + 0.001 THEN 0 ELSE s.bad + 1 END AS bad, CASE WHEN h.value IS NULL THEN s.missing + 1 ELSE 0 END AS missing
      FROM s JOIN h ON h.run_id = s.run_id AND h.round = s.round + 1 WHERE s.stop IS NULL))
    SELECT run_id, max(stop) AS stop_round, arg_max(best, round) AS best FROM s GROUP BY 1"""
)
def early_stop(spark, d):
    return monitor.early_stop(_history(spark, d), 0.001, 6, higher=True)


@query(ORACLE_SQLS["early_stop"])
def early_stop_stream(spark, d):
    history, stops = scratch_path(spark, "history"), scratch_path(spark, "stops")
    _history(spark, d).repartition(4, F.hash("round")).write.parquet(history)
    stream = spark.readStream.schema("run_id long, round int, value double").option("maxFilesPerTrigger", 2).parquet(history)
    monitor.early_stop_stream(stream, stops, scratch_path(spark, "stream"), 0.001, 6, higher=True).awaitTermination()
    return monitor.stopped_runs(spark, stops)


@query("WITH " + _HIST + " SELECT run_id, round FROM (SELECT *, max(round) OVER (PARTITION BY run_id) AS total FROM h) WHERE round >= 2 AND (round - 2) % 3 = 0 AND round <> total")
def stop_cadence(spark, d):
    h = _history(spark, d)
    total = h.groupBy("run_id").agg(F.max("round").alias("total"))
    return h.join(total, "run_id").where(monitor.evaluate_at(F.col("round"), F.col("total"), 2, 3)).select("run_id", "round")
