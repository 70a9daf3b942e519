"""Selection by rank and merged moments against exact arithmetic."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickledger.operators import distribution as di

PS = [0.0, 0.25, 0.5, 0.9, 1.0]


def counts(spark, rows):
    return spark.createDataFrame(rows, "g string, price_gbp bigint, n bigint")


def plain(values, p):
    """Interpolated percentile of a sorted list, in exact fractions."""
    at = Fraction(p) * (len(values) - 1)
    low, high = math.floor(at), math.ceil(at)
    return float(values[low] + (values[high] - values[low]) * (at - low))


def test_rank_selection_of_any_long(spark):
    rng = random.Random(4)
    rows = []
    for g, draw in {
        "wide": lambda: rng.choice([-1, 1]) * rng.getrandbits(rng.choice([1, 8, 30, 62])), "one": lambda: 7, "near": lambda: 10**15 + rng.randrange(50),
        "edge": lambda: rng.choice([-2**63, 2**63 - 1, 0, -1, 1]), "prices": lambda: rng.randrange(10_000, 5_000_000), None: lambda: rng.randrange(3),
    }.items():
        rows += [(g, draw(), rng.choice([1, 1, 2, 1000])) for _ in range(300)] + [(g, None, 50)]
    rows += [("nulls", None, 3), ("none", 4, 0)]
    counted = counts(spark, rows).groupBy("g", "price_gbp").agg(F.sum("n").alias("n"))
    got = {r.g: r.percentiles for r in di.percentiles(counted, ["g"], PS).collect()}
    assert set(got) == {"wide", "one", "near", "edge", "prices", None}
    for g, found in got.items():
        mine = sorted(v for h, v, n in rows if h == g and v is not None for _ in range(n))
        for p, value in zip(PS, found):
            assert value == pytest.approx(plain(mine, p), rel=1e-12, abs=1e-9), (g, p)


def test_rank_selection_without_keys_equals_the_aggregate(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 4001 * 25).alias("price_gbp"))
    counted = di.price_counts(df, [])
    want = df.agg(F.percentile("price_gbp", PS)).first()[0]
    assert di.percentiles(counted, [], PS).first()["percentiles"] == want
    assert [r.percentiles for r in di.percentiles(counted.where("false"), [], PS).collect()] == [None]


def test_hot_group_of_a_million_values(spark):
    """No task but the scan's sees more than a few bands of the hot group."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("g"), (F.col("id") * 7_368_787 % 1_000_003 * 1_000 + 10**9).alias("v"))
    got = di.percentiles(di.price_counts(df, ["g"], "v"), ["g"], [0.5, 0.999], "v").first()["percentiles"]
    values = np.sort((np.arange(1_000_000, dtype=np.int64) * 7_368_787 % 1_000_003) * 1_000 + 10**9)
    assert np.allclose(got, np.percentile(values, [50, 99.9]), rtol=1e-15)
    bands = df.select(di.band(F.col("v")).alias("b")).groupBy("b").count().agg(F.max("count"), F.count("*")).first()
    assert bands[0] < 2_500 and bands[1] > 500


def exact_moments(pairs):
    n = sum(k for _, k in pairs)
    mean = Fraction(sum(v * k for v, k in pairs), n)
    return n, float(mean), sum(k * (v - mean) ** 2 for v, k in pairs)


def test_moments_of_very_many_rows(spark):
    rng = random.Random(6)
    groups = {
        "many": [(rng.randrange(10**8, 10**9), rng.randrange(1, 10**12)) for _ in range(60)],
        "tight": [(10**9 - 5 + i, 10**12) for i in range(5)],
        "mixed": [(v, rng.randrange(1, 10**6)) for v in (-10**12, -3, 0, 1, 2, 10**12)],
        "equal": [(123_456_789, 10**13)],
    }
    counted = counts(spark, [(g, v, n) for g, pairs in groups.items() for v, n in pairs] + [("many", None, 9)])
    states = di.moment_states(counted, ["g"])
    for r in di.merge_moments(states, ["g"]).collect():
        n, mean, m2 = exact_moments(groups[r.g])
        assert r.n == n and r.mean == pytest.approx(mean, rel=1e-13, abs=1e-3)
        assert r.m2 == pytest.approx(float(m2), rel=1e-9)
    assert sum(n for _, n in groups["many"]) > 10**13
    spread = {r.g: r.stddev for r in di.stddev_by(counted, ["g"]).collect()}
    assert spread["equal"] == 0.0 and spread["tight"] == pytest.approx(math.sqrt(2), rel=1e-9)


def test_moments_merge_in_any_order(spark):
    rng = random.Random(7)
    rows = [("a", rng.randrange(10**7), rng.randrange(1, 50)) for _ in range(400)]
    whole = di.merge_moments(di.moment_states(counts(spark, rows), ["g"]), ["g"]).first()
    parts = [di.merge_moments(di.moment_states(counts(spark, rows[i::7]), ["g"]), ["g"]) for i in range(7)]
    for order in (parts, parts[::-1], parts[3:] + parts[:3]):
        union = order[0]
        for p in order[1:]:
            union = union.unionByName(p)
        again = di.merge_moments(union, ["g"]).first()
        assert again.n == whole.n and again.mean == pytest.approx(whole.mean, rel=1e-14) and again.m2 == pytest.approx(whole.m2, rel=1e-12)
