"""Stored summaries: exact parts, stated errors of the sketches, any merge order."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from brickledger.plans import summaries as su

PS = [0.01, 0.25, 0.5, 0.9, 0.99]


@pytest.fixture(scope="module")
def sales(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), 2019 + rng.randrange(6), int(rng.lognormvariate(12.5, 0.6)), f"P{rng.randrange(4000)}")
            for _ in range(30_000)] + [("a", 2020, None, None), ("empty", 2021, None, "P1")]
    return rows, spark.createDataFrame(rows, "region string, sale_year int, price_gbp bigint, postcode string").repartition(6).cache()


@pytest.fixture(scope="module")
def stored(spark, sales, tmp_path_factory):
    path = su.write_summaries(su.price_summaries(sales[1]), str(tmp_path_factory.mktemp("s") / "summaries"))
    return su.read_summaries(spark, path)


def test_exact_parts_of_any_group(sales, stored):
    rows, _ = sales
    for keys, place in ((["region"], 0), (["sale_year"], 1), ([], None)):
        got = su.figures(su.merged(stored, keys), keys, PS).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r[place] if place is not None else None, []).append(r)
        assert len(got) == len(groups)
        for g in got:
            mine = groups[g[0] if keys else None]
            prices = [r[2] for r in mine if r[2] is not None]
            assert g.transactions == len(mine) and (g.min_price, g.max_price) == (min(prices, default=None), max(prices, default=None))
            if not prices:
                assert g.mean_price is None and g.price_stddev is None and g.quantiles is None
                continue
            assert math.isclose(g.mean_price, statistics.fmean(prices), rel_tol=1e-12)
            assert math.isclose(g.price_stddev, statistics.stdev(prices), rel_tol=1e-9)


def test_sketches_keep_their_bounds_in_any_order(sales, stored):
    rows, df = sales
    halves = [su.merged(stored.where(f"sale_year % 2 = {i}"), ["region"]) for i in (0, 1)]
    for merged in (su.merged(stored, ["region"]), su.merged(halves[0].unionByName(halves[1]), ["region"]),
                   su.merged(halves[1].unionByName(halves[0]).repartition(5), ["region"])):
        figures = su.figures(merged, ["region"], PS)
        errors = su.rank_errors(figures, df, PS, ["region"]).collect()
        assert len(errors) == 3 * len(PS) and max(r.rank_error for r in errors) <= 3 * su.RANK_ERROR
        for r in figures.collect():
            exact = len({x[3] for x in rows if x[0] == r.region and x[3] is not None})
            assert abs(r.places - exact) <= max(1, 2 * su.DISTINCT_ERROR * exact)


def test_empty_table(sales):
    nothing = su.price_summaries(sales[1].where("false"))
    assert nothing.count() == 0 and su.merged(nothing, ["region"]).count() == 0
