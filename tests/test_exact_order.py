"""Order statistics, sketches and ranges against plain Python, with no group gathered."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragweave.operators import quantiles, ranges, rerank, stats


@pytest.fixture(scope="module")
def skewed(spark):
    """Groups of many equal values, a wide spread, two values, one, none, and null names."""
    rng = random.Random(4)
    rows = [("ties", float(rng.choice([1, 1, 1, 2]))) for _ in range(3000)]
    rows += [("wide", rng.uniform(-1, 1) * 10 ** rng.uniform(-200, 200)) for _ in range(3000)]
    rows += [(None, float(i % 700)) for i in range(2100)] + [("two", 1.0), ("two", 5.0), ("one", 3.0), ("none", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


def by_group(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("limit", [1, 40, 100_000])
def test_order_statistics(skewed, monkeypatch, limit):
    rows, df = skewed
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    got = {r.g: r for r in quantiles.order_statistics(df, ["g"], "v", {"low": lambda n: F.lit(1), "mid": lambda n: F.floor((n + 1) / 2), "top": lambda n: n, "over": lambda n: n + 1}).collect()}
    want = {g: sorted(vs) for g, vs in by_group(rows).items()}
    assert set(got) == set(want)
    for g, vs in want.items():
        r = got[g]
        assert (r.n, r.low, r.mid, r.top, r.over) == (len(vs), vs[0], vs[(len(vs) + 1) // 2 - 1], vs[-1], None)


def test_order_statistics_without_groups_and_of_long_integers(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LIMIT", 10)
    big = 1 << 60
    df = spark.range(5000).select((F.col("id") * 7919 % 5000 + big).alias("v"))
    r = quantiles.order_statistics(df, [], "v", {"a": lambda n: F.lit(17), "b": lambda n: F.lit(4999)}).first()
    assert (r.n, r.a, r.b) == (5000, big + 16, big + 4998)
    assert quantiles.order_statistics(df.limit(0), [], "v", {"a": lambda n: n}).count() == 0


def test_statistics_by_exact_selection(skewed, monkeypatch):
    rows, df = skewed
    monkeypatch.setattr(quantiles, "LIMIT", 50)
    tame = df.filter("g is null or g <> 'wide'")
    want = {g: vs for g, vs in by_group(rows).items() if g != "wide"}
    for r in stats.latency(tame, ["g"], "v").collect():
        if r.g in want:
            assert r.n == len(want[r.g]) and r.p50 == pytest.approx(np.percentile(want[r.g], 50)) and r.p99 == pytest.approx(np.percentile(want[r.g], 99))
        else:
            assert r.g == "none" and (r.n, r.p50) == (0, None)
    for r in stats.exclusive_p90(tame, ["g"], "v").collect():
        assert r.p90 == (pytest.approx(statistics.quantiles(want[r.g], n=10)[-1]) if len(want[r.g]) > 1 else None)


def test_merged_sketches_have_a_small_rank_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("hour"), F.exp(F.rand(5) * 20).alias("v"))
    kept = quantiles.sketches(df, ["g", "hour"], "v")
    merged = quantiles.merged_sketches(kept, ["g"])
    found = quantiles.sketch_quantiles(merged, ["g"], [0.01, 0.5, 0.99])
    errors = quantiles.rank_errors(df, ["g"], "v", found).collect()
    assert len(errors) == 9 and all(r.n == 20_000 and r.rank_error < 0.02 for r in errors)


def table(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), rng.choice([None, *range(40)]), i) for i in range(400)]
    return rows, spark.createDataFrame(rows, "g string, at int, id long").repartition(5)


def in_order(rows):
    out = {}
    for g, at, i in rows:
        out.setdefault(g, []).append((at is None, at or 0, i))
    return {g: [i for _, _, i in sorted(x)] for g, x in out.items()}


def test_ranges_number_and_find_neighbours(spark):
    rows, df = table(spark)
    lines = in_order(rows)
    number = {i: n + 1 for ids in lines.values() for n, i in enumerate(ids)}
    assert {r.id: r.n for r in ranges.numbered(df, ["g"], "at", "id", "n").collect()} == number
    assert {r.id: r.s for r in ranges.running(df, ["g"], "at", "id", F.col("id"), "s", False).collect()} == {i: sum(ids[:n]) for ids in lines.values() for n, i in enumerate(ids)}
    near = {i: (ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None) for ids in lines.values() for n, i in enumerate(ids)}
    assert {r.id: (r.previous_id, r.next_id) for r in ranges.with_neighbours(df, ["g"], "at", "id").collect()} == near


def test_nearest_around_is_an_asof_join_both_ways(spark):
    rows, df = table(spark)
    rows = [r for r in rows if r[1] is not None]
    df = df.filter("at is not null")
    asked = [*rows[::9], ("hot", 17, 10_000), ("hot", 17, -1), ("a", -5, 10_001), ("a", 99, 10_002), (None, 3, 10_003), ("new", 3, 10_004)]
    hits = spark.createDataFrame([(*r, "x") for r in asked], "g string, at int, id long, note string")
    got = {(r.g, r.at, r.id): (r.previous_id, r.next_id) for r in ranges.nearest_around(hits, df, ["g"], "at", "id").collect()}
    want = {}
    for g, at, i in asked:
        own = sorted((a, j) for h, a, j in rows if h == g)
        before, after = [j for a, j in own if (a, j) < (at, i)], [j for a, j in own if (a, j) > (at, i)]
        want[g, at, i] = (before[-1] if before else None, after[0] if after else None)
    assert got == want


def test_no_window_of_a_neighbour_search_is_over_a_whole_group(spark):
    df = spark.range(100).selectExpr("1 g", "id at", "id")
    plan = ranges.with_neighbours(df, ["g"], "at", "id")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and all("__range" in line.split("windowspecdefinition")[1] for line in windows)


def test_citations_of_a_hot_query(spark):
    rows = [("q", n, s) for n, s in enumerate(["b", "a", None, "b", "c", "", "a"])] + [(None, 1, "z")]
    df = spark.createDataFrame(rows, "query_id string, rank int, source string")
    got = {(r.query_id, r["rank"]): r.citation_id for r in rerank.cite(df, "source").collect()}
    assert got == {("q", 0): 1, ("q", 1): 2, ("q", 2): 3, ("q", 3): 1, ("q", 4): 4, ("q", 5): 3, ("q", 6): 2, (None, 1): 1}
