import json
import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from brickledger import session
from brickledger.functions import fixed_values as fv
from brickledger.operators.prediction_errors import regional_accuracy
from brickledger.operators import features as fe
from brickledger.plans import results, training as tr
from brickledger.session import Scratch
from checks import inputs, registry
from tests.conftest import SF_DIR

SMALL = tr.Settings(forest_trees=5, forest_depth=6, boosting_rounds=8, cv_rounds=4, folds=3, parallelism=3)


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    return tr.training_table(inputs.valued(spark, sf_dir), SMALL)


@pytest.fixture(scope="module")
def fitted(table):
    return tr.fit_models(table, SMALL)


def test_parts_are_disjoint_and_cover(table):
    train, test = tr.split_parts(table)
    assert train.count() + test.count() == table.count() == table.select("property_id").distinct().count()
    assert {r["fold"] for r in train.select("fold").distinct().collect()} == {0, 1, 2}


def test_ridge_equals_closed_form(table, fitted):
    pdf = fitted.train.toPandas()
    x, y = pdf[list(fv.FEATURES)].to_numpy(), pdf["log_price"].to_numpy()
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(std == 0, 1, std)
    w = np.linalg.solve(z.T @ z + SMALL.ridge_alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    test = fitted.test.toPandas().sort_values("property_id")
    expected = (test[list(fv.FEATURES)].to_numpy() - mean) / np.where(std == 0, 1, std) @ w + y.mean()
    got = tr.score(fitted.models[tr.RIDGE], fitted.test).toPandas().sort_values("property_id")["prediction"]
    assert np.allclose(got, expected, atol=1e-8)


def test_measures_against_numpy(fitted):
    scored = tr.score(fitted.models[tr.BOOSTING], fitted.test).toPandas()
    a, p = np.expm1(scored["log_price"]), np.expm1(scored["prediction"])
    row = tr.evaluate(fitted.models[tr.BOOSTING], fitted.test, "b").first()
    assert row["r2"] == round(1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum(), 4)
    assert row["rmse"] == round(np.sqrt(((a - p) ** 2).mean()), 0) and row["mae"] == round(abs(a - p).mean(), 0)
    assert row["mape"] == round((abs(a - p) / a).mean() * 100, 2)


def test_models_learn_the_rule(fitted):
    rows = {r["model"]: r for r in fitted.comparison().collect()}
    assert set(rows) == {tr.RIDGE, tr.FOREST, tr.BOOSTING}
    assert all(r["r2"] > 0.5 for r in rows.values())


def test_importances(spark, fitted):
    all_of_them = tr.model_importances(fitted.models[tr.BOOSTING], spark)
    assert all_of_them.count() == 35
    assert abs(all_of_them.agg(F.sum("importance")).first()[0] - 1) < 1e-9
    shares = tr.importance_shares(all_of_them).collect()
    assert len(shares) == 20 and abs(sum(r["importance_pct"] for r in shares) - 100) < 0.2
    assert [r["importance"] for r in shares] == sorted((r["importance"] for r in shares), reverse=True)


def test_index_fitted_on_train_only_differs_from_leaky_one(spark, sf_dir):
    valued = inputs.valued(spark, sf_dir)
    train = tr.training_table(valued, SMALL, materialise=False).select("property_id", "region_price_index")
    leaky = tr.training_table(valued, SMALL, "all", materialise=False).select("property_id", F.col("region_price_index").alias("l"))
    assert train.join(leaky, "property_id").where("region_price_index <> l").count() > 0


def test_saved_model_scores_new_rows(spark, sf_dir, fitted, tmp_path):
    path = tr.save_model(fitted.models[tr.BOOSTING], str(tmp_path / "model"))
    valued = inputs.valued(spark, sf_dir)
    train = valued.join(fitted.train.select("property_id"), "property_id", "left_semi")
    estimates = tr.score_new(path, valued.drop("price_gbp"), train)
    stored = tr.score_new(tr.save_model(fitted.models[tr.BOOSTING], path, train), valued.drop("price_gbp"))
    assert sorted(stored.collect()) == sorted(estimates.collect())
    direct = tr.predictions(fitted.models[tr.BOOSTING], fitted.test).select("property_id", "predicted_price")
    both = direct.join(estimates, "property_id")
    assert both.count() == fitted.test.count() and both.where("predicted_price <> estimate_gbp").count() == 0


def test_results_document(spark, sf_dir, fitted, tmp_path):
    scored = tr.predictions(fitted.models[tr.BOOSTING], fitted.test)
    r2, rmse = tr.cv_r2(fitted.train, SMALL), tr.cv_rmse(fitted.train, SMALL)
    assert r2.count() == rmse.count() == SMALL.folds
    document = results.results_document(
        inputs.valued(spark, sf_dir), scored, regional_accuracy(scored),
        tr.importance_shares(tr.model_importances(fitted.models[tr.BOOSTING], spark)), fitted.comparison(), r2, rmse)
    results.write_results(document, str(tmp_path / "json"))
    lines = [line for f in (tmp_path / "json").glob("part-*") for line in f.read_text().splitlines()]
    assert len(lines) == 1
    document = json.loads(lines[0])
    assert set(document) == {"model_metrics", "feature_importance", "regional_accuracy", *results.MEDIAN_SECTIONS,
                             "sample_predictions", "cv_scores"}
    assert len(document["sample_predictions"]) == min(500, fitted.test.count())
    assert len(document["feature_importance"]) == 20 and len(document["cv_scores"]["r2"]) == SMALL.folds
    assert set(document["model_metrics"]["gradient_boosting"]) == {
        "r2", "rmse", "mae", "mape", "cv_r2_mean", "cv_r2_std", "cv_rmse_mean"}
    assert document["feature_importance"][0]["importance_pct"] >= document["feature_importance"][1]["importance_pct"]


def test_parts_have_exact_sizes(table):
    train, test = tr.split_parts(table)
    n = table.count()
    assert test.count() == -(-n // 5) and test.where("fold IS NOT NULL").count() == 0
    sizes = sorted(r["count"] for r in train.groupBy("fold").count().collect())
    assert len(sizes) == 3 and sizes[-1] - sizes[0] <= 1


def test_a_thirteenth_region_gets_its_median(spark):
    rows = [("Atlantis", 300_000), ("Atlantis", 500_000), ("Wales", 200_000), (None, 1)]
    df = spark.createDataFrame(rows, "region string, price_gbp bigint")
    index = {r["region"]: r["region_price_index"] for r in fe.region_index(df).collect()}
    assert len(index) == 13 and index["Atlantis"] == 400.0 and index["Wales"] == 200.0 and index["Scotland"] is None
    joined = fe.with_region_index(df)
    assert sorted(map(str, joined.collect())) == sorted(map(str, [Row(region=r, price_gbp=p, region_price_index=index.get(r)) for r, p in rows]))
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_many_regions_are_joined_without_a_hint(spark, monkeypatch):
    monkeypatch.setattr(fe, "FEW_REGIONS", 3)
    df = spark.range(50).selectExpr("concat('R', id % 9) AS region", "id * 1000 AS price_gbp")
    index = {r["region"]: r["region_price_index"] for r in fe.region_index(df).collect()}
    assert {r["region"]: r["region_price_index"] for r in fe.with_region_index(df).collect()} == {k: v for k, v in index.items() if v is not None}


def test_written_records_keep_their_null_fields(spark, tmp_path):
    document = spark.sql("""SELECT named_struct('r2', CAST(NULL AS DOUBLE), 'name', 'x') AS model,
        array(named_struct('region', CAST(NULL AS STRING), 'n', 3), named_struct('region', 'Wales', 'n', CAST(NULL AS INT))) AS rows, array(0.5D, NULL) AS scores""")
    path = results.write_results(document, str(tmp_path / "json"))
    line = [x for f in (tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()]
    assert json.loads(line[0]) == {"model": {"r2": None, "name": "x"}, "rows": [{"region": None, "n": 3}, {"region": "Wales", "n": None}],
                                   "scores": [0.5, None]}
    back = results.flattened(results.read_results(spark, path, document.schema)).collect()
    assert [tuple(r) for r in back] == [
        ("model.r2", None, None), ("model.name", "x", None), ("rows[0].region", None, None), ("rows[0].n", None, 3.0),
        ("rows[1].region", "Wales", None), ("rows[1].n", None, None), ("scores[0]", None, 0.5), ("scores[1]", None, None)]


def test_scratch_tables_go_when_they_are_spent(spark, tmp_path, monkeypatch):
    def held():
        return sorted(x.split("-")[0] for x in os.listdir(tmp_path))

    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    with Scratch(spark) as scratch:
        one = scratch.store(spark.range(5), "one")
        two = scratch.store(one.selectExpr("id * 2 AS id"), "two", "one")
        assert held() == ["two"] and [r.id for r in two.orderBy("id").collect()] == [0, 2, 4, 6, 8]
        with pytest.raises(ValueError):
            scratch.path("two")
    assert held() == []
    tr.training_table(inputs.valued(spark, SF_DIR), SMALL)
    assert held() == ["features"]


def test_a_query_fits_only_the_models_it_names(spark, sf_dir, monkeypatch):
    fitted, whole = [], tr.fit_models
    monkeypatch.setattr(tr, "fit_models", lambda table, settings, names: fitted.extend(names) or whole(table, settings, names))
    registry._fit_once.cache_clear()
    assert registry.registered()["m3_ridge"](spark, sf_dir).first()["model"] == tr.RIDGE
    assert fitted == [tr.RIDGE]
    registry._fit_once.cache_clear()


def test_folds_are_fitted_side_by_side_while_they_fit_in_memory(spark):
    settings = tr.Settings(parallelism=5)
    assert tr.folds_at_once(1_000, 10**9, settings) == 5
    assert tr.folds_at_once(10**7, 10**10, settings) == 10**10 // (10**7 * tr.HELD_ROW_BYTES) == 2
    assert tr.folds_at_once(10**9, 10**10, settings) == tr.folds_at_once(0, 0, settings) == 1
    assert session.storage_bytes(spark) > 0


def test_the_joins_behind_the_valued_rows_run_once(spark, sf_dir, monkeypatch):
    planned, whole = [], inputs.valued
    monkeypatch.setattr(inputs, "valued", lambda *given: planned.append(1) or whole(*given))
    inputs._valued_once.cache_clear()
    for name in ("q12_importance_ranking", "p17_logs_and_time", "m14_one_split_scores"):
        registry.registered()[name](spark, sf_dir).count()
    assert len(planned) == 1
    columns = ["property_id", "price_gbp", "region"]
    stored, fresh = inputs.valued_stored(spark, sf_dir).select(columns), whole(spark, sf_dir).select(columns)
    assert stored.exceptAll(fresh).isEmpty() and fresh.exceptAll(stored).isEmpty()


def test_a_stored_table_is_not_written_again(spark, sf_dir, monkeypatch):
    names, whole = [], Scratch.store
    monkeypatch.setattr(Scratch, "store", lambda self, df, name, *spent: names.append(name) or whole(self, df, name, *spent))
    tr.training_table(inputs.valued_stored(spark, sf_dir), SMALL, stored=True)
    assert "training-rows" not in names and names[-1] == "features"


def test_folds_are_fitted_at_the_published_sizes(spark, sf_dir, monkeypatch):
    seen = []

    def few(train, pipeline, measure, settings):
        seen.append((measure, pipeline.getStages()[-1].getMaxIter(), pipeline.getStages()[-1].getMaxDepth(), settings.folds))
        return spark.createDataFrame([(k, 0.5 + k) for k in range(settings.folds)], "fold int, score double")

    monkeypatch.setattr(tr, "cross_validate", few)
    registry._folds_once.cache_clear()
    rows = registry.registered()["m9_cv_summary"](spark, sf_dir).collect()
    registry._folds_once.cache_clear()
    assert seen == [("r2", 400, 5, 5), ("rmse", 200, 5, 5)]
    assert [(r["measure"], r["mean"]) for r in rows] == [("r2", 2.5), ("rmse", 2.5)]


def test_the_results_document_holds_models_of_the_published_sizes(spark, sf_dir, monkeypatch):
    seen, whole = [], tr.fit_models

    def fit_small(table, settings, names):
        seen.extend((name, settings) for name in names)
        return whole(table, SMALL, names)

    def few(train, pipeline, measure, settings):
        seen.append((measure, settings))
        return spark.createDataFrame([(k, 0.5) for k in range(settings.folds)], "fold int, score double")

    monkeypatch.setattr(tr, "fit_models", fit_small)
    monkeypatch.setattr(tr, "cross_validate", few)
    for held in (registry._fit_once, registry._folds_once):
        held.cache_clear()
    document = registry.registered()["s7_results_document"](spark, sf_dir).first()
    for held in (registry._fit_once, registry._folds_once):
        held.cache_clear()
    assert len(document["cv_scores"]["r2"]) == len(document["cv_scores"]["rmse"]) == 5
    assert {name for name, _ in seen} == {tr.RIDGE, tr.FOREST, tr.BOOSTING, "r2", "rmse"}
    published = tr.Settings()
    assert all(replace(settings, parallelism=published.parallelism) == published for _, settings in seen)
    assert (published.forest_trees, published.forest_depth, published.boosting_rounds, published.cv_rounds) == (200, 18, 400, 200)
