"""Published result tables, given as literals."""

from brickledger import schemas
from brickledger.plans import analyses, charts
from brickledger.plans.training import importance_shares
from pyspark.sql import functions as F

# ---- Fixed values: published result tables -----------------------------------
IMPORTANCES = [
    ("region_price_index", 0.41718133677988634, 41.88), ("location_score", 0.16272331438354137, 16.34),
    ("bed_area", 0.15056992090649712, 15.12), ("type_detached", 0.11417575550113732, 11.46),
    ("type_flat", 0.042286760945474976, 4.25), ("amenity_score", 0.01865743883939298, 1.87),
    ("condition_score", 0.018141654015700694, 1.82), ("type_semi_detached", 0.016111399276572194, 1.62),
    ("years_from_2019", 0.012154464919187036, 1.22), ("type_terraced", 0.010277697204891141, 1.03),
    ("bedrooms", 0.009192192606242308, 0.92), ("commute_mins", 0.00862092771975544, 0.87),
    ("is_freehold", 0.005625681686815828, 0.56), ("commute_x_urban", 0.004564990647302267, 0.46),
    ("school_score", 0.0014414089743882289, 0.14), ("property_age", 0.0011290182394402438, 0.11),
    ("school_x_density", 0.0008688464595563878, 0.09), ("area_per_bed", 0.0008405070076675075, 0.08),
    ("flood_score", 0.0008117052665876321, 0.08), ("log_dist_centre", 0.0006640289323684901, 0.07),
]
REGIONAL = [
    ("East Midlands", 13612.201754385966, 114, 220000.0, 222158.5, 6.2),
    ("East of England", 23583.53896103896, 154, 370500.0, 375540.0, 6.4),
    ("London - Inner", 55407.730769230766, 130, 856000.0, 844460.0, 6.5),
    ("London - Outer", 33743.3984375, 128, 549500.0, 560445.0, 6.1),
    ("North East", 8711.757575757576, 132, 146000.0, 145061.0, 6.0),
    ("North West", 13018.423841059603, 151, 216000.0, 216721.0, 6.0),
    ("Scotland", 11623.7890625, 128, 176500.0, 178350.5, 6.6),
    ("South East", 27361.496, 125, 414000.0, 419747.0, 6.6),
    ("South West", 21927.154471544716, 123, 350000.0, 362565.0, 6.3),
    ("Wales", 12180.854166666666, 144, 194000.0, 193226.5, 6.3),
    ("West Midlands", 15961.631147540984, 122, 235000.0, 234722.5, 6.8),
    ("Yorkshire & Humber", 11945.630872483222, 149, 194000.0, 188210.0, 6.2),
]
COMPARISON = [
    ("Ridge Regression", 0.9339, 74872.0, 42143.0, 10.69), ("Random Forest", 0.9646, 54808.0, 33807.0, 9.34),
    ("Gradient Boosting", 0.987, 33199.0, 20567.0, 5.77),
]


def _features(spark):
    return spark.createDataFrame(IMPORTANCES, schemas.FEATURE_IMPORTANCE)


def test_shares_follow_from_importances(spark):
    rows = importance_shares(_features(spark).select("feature", "importance")).collect()
    assert {r["feature"]: r["importance_pct"] for r in rows} == {f: pct for f, _, pct in IMPORTANCES}


def test_ranking_bands_and_tied_cumulative(spark):
    rows = {r["feature"]: r for r in analyses.importance_ranking(_features(spark)).collect()}
    assert len(rows) == 20
    assert rows["area_per_bed"]["cumulative_importance_pct"] == rows["flood_score"]["cumulative_importance_pct"] == 99.9
    bands = [rows[f]["importance_band"] for f, _, _ in IMPORTANCES]
    assert bands == ["Critical", "High", "High", "High"] + ["Low"] * 6 + ["Minimal"] * 10


def test_top_fifteen_labels(spark):
    rows = charts.top_importances(_features(spark)).collect()
    assert len(rows) == 15
    assert rows[-1].asDict() == {"label": "Region Price Index", "importance_pct": 41.88,
                                 "importance_class": "Critical (>15%)"}
    assert {r["label"] for r in rows if r["importance_class"] == "High (5–15%)"} == {"Type Detached"}


def test_regional_accuracy_bands(spark):
    regional = spark.createDataFrame(REGIONAL, schemas.REGIONAL)
    rows = analyses.accuracy_by_region(regional).collect()
    assert len(rows) == 12 and {r["accuracy_band"] for r in rows} == {"Excellent (<8%)"}
    assert sum(r["test_transactions"] for r in rows) == 1600
    assert [r["mae_as_pct_of_price"] for r in rows] == sorted(r[5] for r in REGIONAL)
    share = regional.select("mae_pct", F.bround(F.col("mae") / F.col("median_actual") * 100, 1).alias("again"))
    assert all(r["mae_pct"] == r["again"] for r in share.collect())


def test_model_comparison_long(spark):
    rows = charts.model_comparison_long(spark.createDataFrame(COMPARISON, schemas.MODEL_COMPARISON)).collect()
    values = {(r["model"], r["measure"]): r["value"] for r in rows}
    assert len(values) == 9 and values[("Gradient Boosting", "rmse")] == 33199.0
