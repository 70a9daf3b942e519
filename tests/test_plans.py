"""Properties of the plans that decide how they behave on large tables."""

import re

import pytest

from brickledger.plans import mart
from brickledger.sources.star_schema import transactions
from checks import inputs, registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


ANALYSES = [k for k in registry.registered() if re.match(r"(q|c[1-68]_|k|j)\d*", k) and not k.startswith(("c7", "c3", "c4"))]


@pytest.mark.parametrize("key", ANALYSES)
def test_no_python_in_the_plan(spark, sf_dir, key):
    plan = _plan(registry.registered()[key](spark, sf_dir))
    assert not re.search(r"Python|ExistingRDD|MapInPandas|DeserializeToObject", plan)


@pytest.mark.parametrize("key", ANALYSES)
def test_unpartitioned_windows_only_follow_an_aggregate(spark, sf_dir, key):
    """A window without PARTITION BY sits above an aggregate, never on raw sales."""
    lines = _optimized(registry.registered()[key](spark, sf_dir)).splitlines()
    for i, line in enumerate(lines):
        if re.search(r"[-+ ]Window \[.*windowspecdefinition\((?!\w+#\d+, )", line):
            below = next(l for l in lines[i + 1:] if re.search(r"Aggregate|GlobalLimit|Relation", l))
            assert "Relation" not in below, line


def test_every_line_is_read_and_years_are_exact(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert inputs.raw(spark, sf_dir).count() == lines
    some = transactions(spark, sf_dir, [2022, 2024])
    assert [r.y for r in some.selectExpr("year(date_of_transfer) AS y").distinct().orderBy("y").collect()] == [2022, 2024]
    parts = [transactions(spark, sf_dir, [y]).count() for y in inputs.YEARS]
    assert sum(parts) == lines and all(parts)


def test_order_dates_reach_the_scan_and_columns_are_pruned(spark, sf_dir):
    orders = next(l for l in _plan(transactions(spark, sf_dir, [2022])).splitlines() if "orders.parquet" in l)
    assert "GreaterThanOrEqual(o_orderdate" in orders and "LessThan(o_orderdate" in orders
    plan = _plan(registry.registered()["q02_type_by_region"](spark, sf_dir))
    lines = next(l for l in plan.splitlines() if "lineitem.parquet" in l)
    assert "l_quantity" not in lines.split("ReadSchema")[1] and "l_discount" not in lines.split("ReadSchema")[1]


def test_large_tables_are_never_forced_to_broadcast(spark, sf_dir):
    """Without a size-based broadcast only fixed tables and one-row results are broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(inputs.properties(spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("BroadcastExchange") == plan.count("LocalTableScan") == 4


def test_counts_are_shuffled_once_for_histogram(spark, sf_dir, tmp_path):
    from brickledger.plans import charts

    path = mart.write_properties(inputs.properties(spark, sf_dir), str(tmp_path / "mart"))
    df = charts.price_histogram(mart.read_properties(spark, path))
    df.collect()
    assert "ReusedExchange" in _plan(df) or _plan(df).count("FileScan") == 1


def test_no_pass_too_many_over_the_mart(spark, sf_dir, tmp_path):
    from brickledger.operators import prediction_errors, ranking
    from brickledger.plans import analyses

    path = mart.write_properties(inputs.properties(spark, sf_dir), str(tmp_path / "mart"))
    homes = mart.read_properties(spark, path)
    assert _plan(ranking.sample_exact(homes, 800, "property_id")).count("FileScan") == 2
    assert _plan(ranking.stratified_test(homes, "region")).count("FileScan") == 2
    predicted = prediction_errors.prediction_table(homes, homes.price_gbp, homes.price_gbp * 1.1)
    for table in (prediction_errors.regional_accuracy(predicted), analyses.regional_summary(homes)):
        table.collect()
        assert "ReusedExchange" in _plan(table) or _plan(table).count("FileScan") == 1
    # the split reads keys twice to find its ends; the rows are flagged without a shuffle of their own
    split = _plan(ranking.with_split(homes, folds=5))
    assert split.count("FileScan") == 3
    assert not re.search(r"Exchange (hash|range)partitioning\(property_id", split)
    profile = analyses.top_decile_profile(homes)
    profile.collect()
    assert "ReusedExchange" in _plan(profile) or _plan(profile).count("FileScan") == 1


def test_the_same_rows_under_any_shuffle_width(spark, sf_dir):
    def rows(width):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            return sorted(map(str, registry.registered()["m1_stratified_split"](spark, sf_dir).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    assert rows("3") == rows("17")


def test_valuation_adds_no_join_and_knows_its_tables(spark):
    from brickledger import schemas
    from brickledger.functions.valuation import price_level_sql, with_valuation

    empty = spark.createDataFrame([], schemas.CLEANED)
    assert "Join" not in with_valuation(empty, "price_gbp")._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.sql("SELECT * FROM VALUES ('Wales', 2019), ('Wales', 2018), ('Atlantis', 2019), (NULL, 2019), ('Wales', NULL) AS t(region, sale_year)")
    assert [r[0] for r in rows.selectExpr(price_level_sql()).collect()] == [210000.0, None, None, None, None]


def test_fixed_document_plans_the_properties_once(spark, monkeypatch):
    from brickledger import schemas
    from checks import inputs, registry

    own = {"property_id": "concat('LR', id)", "region": "element_at(array('Wales', 'Scotland'), CAST(id % 2 AS INT) + 1)",
           "sale_year": "2019 + id % 6", "price_gbp": "100000 + 1000 * id"}
    rows = spark.range(60).selectExpr(*[f"CAST({own.get(f.name, 'id % 3')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schemas.CLEANED.fields])
    planned = []
    monkeypatch.setattr(inputs, "_planned", lambda *_: planned.append(1) or rows)
    leaves = registry.fixed_document(spark, "own rows").collect()
    assert len(planned) == 1
    assert sum(r["path"].startswith("sample_predictions") and r["path"].endswith("actual_price") for r in leaves) == 60
