"""Cross-products and the closed-form ridge against numpy."""

import numpy as np
import pytest

from brickledger.operators import gram
from brickledger.plans import training as tr
from checks import inputs


def test_products_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=500), rng.normal(10**6, 1, 500), np.full(500, 7.3), rng.integers(0, 2, 500)])
    df = spark.createDataFrame([(*map(float, row), None) for row in x], "a double, b double, c double, d double, e int").repartition(7)
    got = gram.products(df, ["a", "b", "c", "d", "e"])
    full = np.column_stack([x, np.zeros(500)])
    assert got.n == 500 and np.allclose(got.means, full.mean(axis=0), rtol=1e-12)
    centred = full - full.mean(axis=0)
    assert np.allclose(got.centred, centred.T @ centred, rtol=1e-9, atol=1e-7)
    assert got.deviations()[2] == got.deviations()[4] == 0.0
    strengths = got.squared_correlations("a")
    assert strengths["c"] == strengths["e"] == 0.0 and strengths["d"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 3])[0, 1] ** 2, abs=1e-10)
    assert gram.products(df.where("false"), ["a"]).n == 0


def test_closed_form_equals_the_solver_and_has_no_slope(spark, sf_dir):
    train, test = tr.split_parts(tr.training_table(inputs.valued(spark, sf_dir)))
    fit = tr.ridge_closed_form(train)
    solver = tr.score(tr.fit(tr.ridge_pipeline(train), train), test).select("property_id", "prediction").toPandas().sort_values("property_id")
    closed = fit.score(test).select("property_id", "prediction").toPandas().sort_values("property_id")
    assert np.allclose(closed["prediction"], solver["prediction"], atol=1e-8)
    assert max(abs(r.gradient) for r in tr.ridge_gradient(fit, train).collect()) < 1e-4
    with pytest.raises(ValueError):
        tr.ridge_closed_form(train.where("false"))
