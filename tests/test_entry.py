"""The registered queries run on the smallest tables, and have the values of their SQL."""

import math
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
PLANS = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4)
    return a == b


def ordered(rows):
    """Rows in an order that the last digits of numbers don't change."""
    return sorted(rows, key=lambda r: tuple((v is None, f"{v:.3g}" if isinstance(v, float) else str(v)) for v in sorted(r, key=lambda v: isinstance(v, float))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    odd = []
    for name in [n for n in PLANS if n in sql]:
        got = queries[name](spark, SF)
        want = con.sql(sql[name])
        if sorted(got.columns) != sorted(want.columns):
            odd.append((name, "columns"))
            continue
        columns = sorted(got.columns)
        have = ordered([tuple(r[c] for c in columns) for r in got.collect()])
        need = ordered(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql[name]})").fetchall())
        if len(have) != len(need) or not all(close(x, y) for a, b in zip(have, need, strict=True) for x, y in zip(a, b, strict=True)):
            odd.append((name, len(have), len(need)))
    assert odd == []
    assert __spark_entry__.entry(spark).count() > 0


def test_other_queries_stay_without_the_corpus_half(monkeypatch):
    def fails(name):
        raise ImportError(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", fails)
    assert sorted(__spark_entry__.queries()) == sorted(PLANS) and set(__spark_entry__.oracle_sql()) <= set(PLANS)
