import datetime
import random

import pytest
from pyspark.sql import functions as F

from pagelake.operators import cache as ops

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def cache(spark, *rows):
    return spark.createDataFrame([(k, d, at(c), at(e)) for k, d, c, e in rows], ops.CACHE_SCHEMA)


def requests(spark, *rows):
    return spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(rows)], "request_id INT, key STRING, ts TIMESTAMP")


def test_lookup_boundaries(spark):
    table = cache(spark, ("a", "1", 0, 100), ("a", "2", 50, 150), ("b", None, 0, 100), ("c", "old", 0, 5000), ("c", None, 10, 5000))
    asked = requests(spark, ("a", -1), ("a", 0), ("a", 49), ("a", 50), ("a", 149), ("a", 150), ("b", 10), ("c", 5), ("c", 10), ("d", 1), ("c", 4000))
    hits, misses = ops.cache_lookup(asked, table, slice_seconds=60)
    assert {r.request_id: r.data for r in hits.collect()} == {1: "1", 2: "1", 3: "2", 4: "2", 7: "old"}
    assert {r.request_id for r in misses.collect()} == {0, 5, 6, 8, 9, 10}


def test_lookup_moves_data_last(spark):
    """Data is in no sort of the as-of join, a hot key gives one entry to many requests, and ties are settled alike in any order."""
    rows = [("a", "1", 0, 100), ("a", "2", 0, 100), ("a", "3", 0, 90), ("b", None, 5, 70), ("b", "x", 5, 70), ("n", "y", 0, 9)]
    asked = requests(spark, *[("a", t) for t in range(0, 120, 3)], ("b", 6), (None, 1))
    found = []
    for order in (rows, rows[::-1]):
        looked = ops.look_up(asked, cache(spark, *order).repartition(3), slice_seconds=60)
        found.append(sorted((r.request_id, r.hit, r.data) for r in looked.collect()))
        plan = looked._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    assert found[0] == found[1] and len(found[0]) == 42
    assert {d for _, hit, d in found[0][:34] if hit} <= {"1", "2"} and [x[1:] for x in found[0][-2:]] == [(True, "x"), (False, None)]
    assert not any(hit for i, hit, _ in found[0] if 34 <= i < 40)


def test_upsert_keeps_the_last_live_write(spark):
    table = cache(spark, ("a", "1", 0, 100), ("b", "1", 0, 10), ("c", "1", 30, 100))
    new = cache(spark, ("a", "2", 20, 120), ("c", "2", 30, 100), ("d", None, 20, 120), ("e", "1", 20, 120))
    kept = ops.cache_upsert(table, new, F.lit(at(50)))
    assert {r.key: r.data for r in kept.collect()} == {"a": "2", "c": "2", "e": "1"}


def test_missing_cache_is_empty(spark, tmp_path):
    assert ops.load_cache(spark, str(tmp_path / "none")).count() == 0
    cache(spark, ("a", "1", 0, 100)).write.parquet(str(tmp_path / "c"))
    assert ops.load_cache(spark, str(tmp_path / "c")).count() == 1


def brute_flags(rows, ttl):
    ends, flags = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        flags[i] = key in ends and t < ends[key]
        if not flags[i]:
            ends[key] = t + ttl
    return flags


@pytest.mark.parametrize("hot_rows", [10**6, 150, 1])
def test_cached_flag_against_brute_force(spark, hot_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 3 + ["a", "b", "c"]), rng.randrange(0, 4000), i) for i in range(600)]
    rows += [("exact", 0, 600), ("exact", 99, 601), ("exact", 100, 602), ("exact", 100, 603), ("gap", 0, 604), ("gap", 9000, 605)]
    log = spark.createDataFrame([(k, at(t), i) for k, t, i in rows], "key STRING, ts TIMESTAMP, request_id INT")
    log = log.unionByName(spark.createDataFrame([(None, T0, 900), (None, T0, 901), ("late", None, 902), ("late", T0, 903)], log.schema))
    flagged = ops.cached_flag(log, 100, hot_rows=hot_rows)
    assert {r.request_id: r.cached for r in flagged.collect()} == {
        **brute_flags(rows, 100), 900: False, 901: True, 902: False, 903: False
    }
    assert flagged.columns == ["key", "ts", "request_id", "cached"]


@pytest.mark.parametrize("hot_rows", [10**6, 2, 1])
def test_one_miss_per_start_whatever_the_way(spark, hot_rows):
    """Repeated rows, null ids and null times: exactly one miss per life, the least id, null first."""
    rows = [("a", T0, 1), ("a", T0, 1), ("a", T0, None), ("b", T0, None), ("b", T0, None), (None, T0, 5), (None, T0, 4), (None, None, 3), ("c", T0, 2), ("c", T0, 1)]
    log = spark.createDataFrame(rows, "key STRING, ts TIMESTAMP, request_id INT")
    flagged = ops.cached_flag(log, 100, hot_rows=hot_rows).collect()
    assert len(flagged) == len(rows)
    misses = sorted((str(r.key), str(r.request_id)) for r in flagged if not r.cached)
    assert misses == [("None", "3"), ("None", "4"), ("a", "None"), ("b", "None"), ("c", "1")]


def test_requests_without_key_are_misses(spark):
    table = cache(spark, (None, "1", 0, 100), ("a", "1", 0, 100))
    hits, misses = ops.cache_lookup(requests(spark, (None, 5), ("a", 5)), table)
    assert [r.key for r in hits.collect()] == ["a"] and [r.key for r in misses.collect()] == [None]
