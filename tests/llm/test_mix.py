"""Mixing sources to target weights."""

from collections import defaultdict

from pyspark.sql import functions as F

from tabulon.llm.mix import mix, word_count


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, rounds=2):
    """Targets by sharing out, capping and sharing the excess again."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > rounds * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = float(rounds * sizes[s])
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def rows_of(spark, docs):
    return [r.asDict() for r in mix(docs, word_count(F.col("text"))).collect()]


def test_targets_and_taken(spark):
    data = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "abcdefg"[i * i % 7] if i % 11 else None, 1) for i in range(900)]
    data += [(1000 + i, "x y z", "a", 1) for i in range(900)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    rows = rows_of(spark, docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in data)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    source = {d[0]: d[2] for d in data}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = plain_targets(sizes)
    for r in rows:
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
        assert r["source_size"] == sizes[source[r["doc_id"]]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * most[s]
    again = {r["doc_id"]: r["taken"] for r in rows_of(spark, docs.repartition(5))}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string"
    assert rows_of(spark, spark.createDataFrame([], schema)) == []
    rows = rows_of(spark, spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a"), (2, " \t\n", None)], schema))
    assert len(rows) == 4 and all(r["taken"] == 0 and r["size"] == 0 for r in rows)
    rows = rows_of(spark, spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (3, "c", "s")], schema))
    assert sum(r["taken"] for r in rows) >= 7 and max(r["taken"] for r in rows) <= 4
