import hashlib
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickledger.operators import distribution as di, ranking
from brickledger.plans import analyses, charts


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; some prices are missing."""
    rows = [(f"k{i}", "hot" if i % 3 else f"g{i % 7}", None if i % 50 == 0 else 10_000 + (i * 7919) % 997) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "id string, g string, price_gbp bigint").repartition(13)


def _digest(salt, key):
    return hashlib.md5(f"{salt}-{key}".encode()).hexdigest()


def test_weighted_statistics_equal_plain_ones(skewed):
    rows, df = skewed
    stats = di.price_counts(df, ["g"]).groupBy("g").agg(
        di.rows().alias("n"), di.quantiles([0.25, 0.5, 0.9]).alias("q"), di.mean().alias("m"))
    spread = {r["g"]: r["stddev"] for r in di.stddev_by(di.price_counts(df, ["g"]), ["g"]).collect()}
    for r in stats.collect():
        mine = [p for _, g, p in rows if g == r["g"] and p is not None]
        assert r["n"] == sum(g == r["g"] for _, g, _ in rows)
        assert np.allclose(r["q"], np.percentile(mine, [25, 50, 90]))
        assert math.isclose(r["m"], statistics.fmean(mine)) and math.isclose(spread[r["g"]], statistics.stdev(mine))


def test_statistics_of_empty_and_single_groups(spark):
    df = spark.createDataFrame([("a", 5), ("b", None)], "g string, price_gbp bigint")
    rows = {r["g"]: r for r in di.price_counts(df, ["g"]).groupBy("g").agg(
        di.mean().alias("m"), di.quantile(0.5).alias("q")).collect()}
    assert (rows["a"]["m"], rows["a"]["q"]) == (5.0, 5.0)
    assert (rows["b"]["m"], rows["b"]["q"]) == (None, None)
    assert di.stddev_by(di.price_counts(df, ["g"]), ["g"]).collect() == [("a", None)]
    assert di.percentiles(di.price_counts(df, ["g"]), ["g"], [0.5]).collect() == [("a", [5.0])]
    empty = di.price_counts(df.where("false"), []).agg(di.mean().alias("m"), di.quantile(0.9).alias("q")).first()
    assert empty["m"] is None and empty["q"] is None


def test_numbering_is_dense_and_stable(skewed):
    rows, df = skewed
    expected = {key: n for n, key in enumerate(sorted((k for k, _, _ in rows), key=lambda k: _digest("row", k)), 1)}
    assert {r["id"]: r["row_number"] for r in ranking.number_rows(df, "id").collect()} == expected
    ids = {r["id"]: r["property_id"] for r in ranking.serial_id(df.coalesce(2), "id").collect()}
    assert ids == {k: f"LR{n:07d}" for k, n in expected.items()}


@pytest.mark.parametrize("n", [0, 1, 37, 3999, 4000, 9000])
def test_sample_has_exact_size_and_content(skewed, n):
    rows, df = skewed
    expected = set(sorted((k for k, _, _ in rows), key=lambda k: _digest(42, k))[:n])
    got = [r["id"] for r in ranking.sample_exact(df, n, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_stratified_test_part(skewed):
    rows, df = skewed
    got = {}
    for r in ranking.stratified_test(df, "g", ["hot", "g0"], "id").collect():
        got.setdefault(r["g"] if r["g"] in ("hot", "g0") else "", set()).add(r["id"])
    for stratum in ("hot", "g0", ""):
        keys = [k for k, g, _ in rows if (g if g in ("hot", "g0") else "") == stratum]
        want = sorted(keys, key=lambda k: _digest("split42", k))[:math.ceil(len(keys) * 0.2)]
        assert got[stratum] == set(want)


def test_every_value_is_a_stratum(skewed):
    rows, df = skewed
    want = {}
    for stratum in {g for _, g, _ in rows}:
        keys = [k for k, g, _ in rows if g == stratum]
        want[stratum] = set(sorted(keys, key=lambda k: _digest("split42", k))[:math.ceil(len(keys) * 0.2)])
    got = {}
    for r in ranking.stratified_test(df, "g", key="id").collect():
        got.setdefault(r["g"], set()).add(r["id"])
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 2, 4, 7, 3999, 4000])
def test_split_and_folds_have_exact_sizes(skewed, n):
    rows, df = skewed
    keys = sorted((k for k, _, _ in rows[:n]), key=lambda k: _digest("split42", k))
    tests = math.ceil(n * 0.2)
    want = {k: (True, None) for k in keys[:tests]}
    for fold, part in enumerate(np.array_split(np.array(keys[tests:], object), 5)):
        want |= {k: (False, fold) for k in part}
    some = df.where(F.substring("id", 2, 9).cast("int") < n)
    for table in (some.coalesce(1), some.repartition(9)):
        marked = ranking.with_split(table, "id", folds=5)
        assert marked.columns == [*df.columns, "is_test", "fold"]
        assert {r["id"]: (r["is_test"], r["fold"]) for r in marked.collect()} == want
    assert {r["id"]: r["is_test"] for r in ranking.with_split(some, "id").collect()} == {k: t for k, (t, _) in want.items()}


PROPERTY = ("region string, property_type string, bedrooms int, floor_area_sqm int, commute_mins int, epc_rating string, "
            "nearest_school_ofsted string, has_garden int, has_garage int, sale_year int, flood_risk string, price_gbp bigint")


def _homes(spark, *rows):
    base = ("Wales", "Flat", 2, 60, 20, "C", "Good", 0, 0, 2020, "Low", 100)
    return spark.createDataFrame([tuple(r.get(n, b) for n, b in zip(
        [f.split()[0] for f in PROPERTY.split(", ")], base)) for r in rows], PROPERTY)


def test_region_without_flats_has_no_ratio_and_sorts_last(spark):
    rows = analyses.type_by_region(_homes(
        spark, {"property_type": "Detached", "price_gbp": 300}, {"price_gbp": 100}, {"region": "Scotland"},
        {"region": "North East", "property_type": "Detached", "price_gbp": 200})).collect()
    assert [(r["region"], r["detached_avg"], r["detached_to_flat_ratio"]) for r in rows] == [
        ("Wales", 300.0, 3.0), ("North East", 200.0, None), ("Scotland", None, None)]


def test_top_decile_includes_the_cut_and_skips_missing_prices(spark):
    homes = _homes(spark, *[{"price_gbp": p} for p in range(1, 12)], {"price_gbp": None})
    rows = {r["segment"]: r["count"] for r in analyses.top_decile_profile(homes).collect()}
    assert rows == {"Top 10% Properties": 2, "Bottom 90% Properties": 9}


def test_bedroom_cells_below_ten_sales_are_left_out(spark):
    homes = _homes(spark, *[{"bedrooms": 1, "price_gbp": 100}] * 10, *[{"bedrooms": 2, "price_gbp": 999}] * 9,
                   *[{"bedrooms": 3, "price_gbp": 160}] * 10)
    assert [(r["bedrooms"], r["marginal_bedroom_value"]) for r in analyses.bedroom_value(homes).collect()] == [
        (1, None), (3, 60.0)]


def test_types_without_sales_stay_in_the_chart_table(spark):
    rows = charts.price_by_type(_homes(spark, {}, {"price_gbp": 200})).collect()
    assert [r["property_type"] for r in rows] == ["Detached", "Semi-Detached", "Terraced", "Flat"]
    assert rows[0]["median_price"] is None and rows[3]["median_price"] == 150.0
    assert [r["epc_rating"] for r in charts.epc_medians(_homes(spark, {}, {"epc_rating": "A"})).collect()] == ["A", "C"]


def test_histogram_matches_numpy(spark):
    prices = [(i * 7919) % 801 * 1000 for i in range(500)] + [900_000]
    rows = charts.price_histogram(_homes(spark, *[{"price_gbp": p} for p in prices])).collect()
    counts = np.histogram([p for p in prices if p <= 800_000], bins=60)[0]
    assert {r["bin"]: r["properties"] for r in rows} == {i: n for i, n in enumerate(counts.tolist()) if n}


def test_histogram_of_equal_prices(spark):
    counts = np.histogram([100, 100], bins=60)[0].tolist()
    assert sum(counts) == 2 and [r["properties"] for r in charts.price_histogram(_homes(spark, {}, {})).collect()] == counts


def test_histogram_plans_no_filter_on_a_worked_out_price(spark):
    """A filter on the price would be rewritten for every combination of the columns it is worked out from."""
    steps = spark.range(400).selectExpr(*[f"id % {k} AS a{k}" for k in range(2, 16)])
    homes = steps.selectExpr(f"IF(a7 = 3, NULL, 100000 + 10000 * ({' + '.join(f'a{k}' for k in range(2, 16))})) AS price_gbp", "a2")
    df = charts.price_histogram(homes)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "800000" in line]
    known = [r["price_gbp"] for r in homes.collect() if r["price_gbp"] is not None and r["price_gbp"] <= 800_000]
    assert 0 < len(known) < 400
    assert [r["properties"] for r in df.collect()] == np.histogram(known, bins=60)[0].tolist()


def test_split_of_repeated_and_missing_keys_follows_the_order(spark):
    """Parts are ranges of the (digest, key) order, compared natively; equal keys stay together."""
    keys = [None, None, "", "a", "a", "a"] + [f"k{i % 40}" for i in range(95)]
    df = spark.createDataFrame([(k,) for k in keys], "property_id string")
    split = ranking.with_split(df, test_fraction=0.2, seed=42, folds=3)
    got = {(r.property_id, r.is_test, r.fold) for r in split.collect()}
    order = sorted(keys, key=lambda k: (hashlib.md5("-".join(["split42", *([] if k is None else [k])]).encode()).hexdigest(), k or ""))
    tests, rest = 21, 80
    ends = [tests] + [tests + i * (rest // 3) + min(i, rest % 3) for i in (1, 2)]
    first = {k: order.index(k) for k in set(keys)}
    starts = [first[order[e]] for e in ends]
    part = {k: sum(at >= s for s in starts) for k, at in first.items()}
    assert got == {(k, p == 0, p - 1 if p else None) for k, p in part.items()}
    assert "lambdafunction" not in split._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
