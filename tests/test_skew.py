from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyguard.operators.skew import CHUNK, find_chunks, keyed_running, lookup, value_prefix


def skewed(spark, n=3000):
    """A third of the rows belongs to one key."""
    rng = random.Random(3)
    rows = [
        ("hot" if i % 3 == 0 else f"k{rng.randint(1, 200)}", rng.randint(0, 50_000) * 1_000_000, i, rng.randint(1, 9))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "key string, us long, seq long, n long")


def largest_chunk(df, chunks):
    return chunks.assign(df, "us").groupBy("key", CHUNK).count().agg(F.max("count")).first()[0]


def test_heavy_key_is_cut_into_small_chunks(spark):
    rows, df = skewed(spark)
    chunks = find_chunks(df, ["key"], "us", 100)
    assert [r["key"] for r in chunks.levels[0].collect()] == ["hot"]
    assert largest_chunk(df, chunks) <= 200
    assert not find_chunks(df, ["key"], "us", 5000).any


def test_burst_of_a_heavy_key_is_cut_finer(spark):
    """Most rows of the key fall into one second of a year; the rest is spread out."""
    year = 365 * 86_400 * 1_000_000
    rows = [("hot", year // 2 + i * 300, i, 1) for i in range(3000)] + [("hot", i * (year // 50), 9000 + i, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "key string, us long, seq long, n long")
    chunks = find_chunks(df, ["key"], "us", 100)
    assert len(chunks.levels) > 1
    assert largest_chunk(df, chunks) <= 200
    assert chunks.assign(df, "us").select(CHUNK).distinct().count() < 120
    got = {r["seq"]: r["before"] for r in keyed_running(df, ["key"], "us", "seq", {"before": F.col("n")}, 100).collect()}
    assert [got[r[2]] for r in sorted(rows, key=lambda r: r[1:3])] == list(range(len(rows)))


def test_keyed_running_matches_brute_force(spark):
    rows, df = skewed(spark)
    result = keyed_running(df, ["key"], "us", "seq", {"before": F.col("n")}, chunk_rows=100)
    got = {r["seq"]: r["before"] for r in result.collect()}
    totals: dict[str, int] = {}
    for key, _, seq, n in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[seq] == totals.get(key, 0)
        totals[key] = totals.get(key, 0) + n


def test_value_prefix_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(g, float(v), rng.randint(1, 5)) for g in ("a", "b") for v in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "grp string, value double, n long")
    got = {(r["grp"], r["value"]): r["n_before"] for r in value_prefix(df, "grp", "value", ["n"], cuts=16).collect()}
    assert len(got) == len(rows)
    for grp in ("a", "b"):
        total = 0
        for _, value, n in sorted(r for r in rows if r[0] == grp):
            assert got[(grp, value)] == total
            total += n


def test_lookup_gives_the_same_rows_broadcast_or_salted(spark):
    _, df = skewed(spark)
    table = df.groupBy("key").agg(F.min("seq").alias("first")).where("key <> 'k7'")
    for how in ("left", "inner", "left_semi", "left_anti"):
        small = lookup(df, table, ["key"], "seq", how)
        plain = lookup(df, table, ["key"], "seq", how, broadcast_rows=10)
        salted = lookup(df, table, ["key"], "seq", how, broadcast_rows=10, hot_rows=500)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert "__salt" in salted._jdf.queryExecution().optimizedPlan().toString()
        expected = sorted(map(tuple, small.collect()), key=str)
        assert expected == sorted(map(tuple, plain.collect()), key=str)
        assert expected == sorted(map(tuple, salted.collect()), key=str)
