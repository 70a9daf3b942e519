import pytest

from brickledger import schemas
from brickledger.operators import cleaning, features as fe
from brickledger.functions import fixed_values as fv

BASE = dict(transaction_id="t", price=200_000, date_of_transfer="2022-03-04 00:00", postcode="LS1 1AA", property_type="D",
            new_build="N", tenure="F", paon=None, saon=None, street=None, locality=None, town="LEEDS", district="LEEDS",
            county="WEST YORKSHIRE", ppd_category="A", record_status="A")


def _raw(spark, *changes):
    rows = [{**BASE, "transaction_id": str(i), **change} for i, change in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.PRICE_PAID.fields) for r in rows], schemas.PRICE_PAID)


def _by_id(df):
    return {int(r["property_id"][2:]): r for r in df.collect()}


def test_filters_keep_closed_range_and_standard_homes(spark):
    raw = _raw(spark, {"price": 9_999}, {"price": 10_000}, {"price": 5_000_000}, {"price": 5_000_001},
               {"property_type": "O"}, {"ppd_category": "B"}, {"price": None}, {"property_type": None})
    assert sorted(int(r["transaction_id"]) for r in cleaning.standard_sales(raw).collect()) == [1, 2]


def test_labels_dates_and_flags(spark):
    rows = _by_id(cleaning.to_properties(_raw(
        spark, {}, {"date_of_transfer": "garbage"}, {"tenure": None}, {"tenure": "X"}, {"new_build": None},
        {"new_build": "Y"}, {"property_type": "F"}, {"property_type": "T", "date_of_transfer": "2020-12-31 00:00"})))
    first = rows[0]
    assert (first["property_type"], first["tenure"], first["region"], first["density"]) == (
        "Detached", "Freehold", "Yorkshire & Humber", "mixed")
    assert (first["sale_year"], first["sale_month"], first["sale_quarter"]) == (2022, 3, 1)
    assert (first["has_garden"], first["has_parking"], first["is_new_build"], first["condition"]) == (1, 1, 0, None)
    assert rows[1]["sale_year"] is None
    assert rows[2]["tenure"] == rows[3]["tenure"] == "Unknown"
    assert rows[4]["is_new_build"] == 0 and rows[5]["condition"] == "New Build"
    assert (rows[6]["has_garden"], rows[6]["has_parking"]) == (0, 0)
    assert (rows[7]["has_garden"], rows[7]["has_parking"], rows[7]["sale_quarter"]) == (1, 0, 4)


def test_unresolved_regions_are_dropped(spark):
    raw = _raw(spark, {}, {"county": "X", "district": "Y", "postcode": None}, {"county": None, "district": None})
    assert set(_by_id(cleaning.clean(raw))) == {0, 2}


def test_columns_match_schema_and_missing_inputs_become_zero_features(spark):
    properties = cleaning.clean(_raw(spark, {}))
    assert [f.name for f in schemas.CLEANED.fields] == properties.columns
    row = fe.feature_matrix(fe.engineer(properties), ["property_id"]).first()
    assert len(row) == 36 and not any(v is None for v in row)
    assert row["type_detached"] == 1 and row["is_freehold"] == 1 and row["region_price_index"] == 200
    # inputs that transaction files lack are unknown, and count as 0 only in the matrix
    assert row["age_band_score"] == row["amenity_score"] == row["location_score"] == row["bed_area"] == 0


@pytest.mark.parametrize("column,feature", [
    ("epc_rating", "epc_score"), ("nearest_school_ofsted", "school_score"), ("condition", "condition_score"),
    ("flood_risk", "flood_score"), ("age_band", "age_band_score")])
def test_unlisted_categories_score_null(spark, column, feature):
    df = spark.createDataFrame([("?",), (None,)], f"{column} string").selectExpr(f"{fe.ORDINAL_SCORES[feature]} AS s")
    assert [r["s"] for r in df.collect()] == [None, None]


def test_null_category_flags_are_zero(spark):
    df = spark.createDataFrame([(None, None)], "property_type string, tenure string")
    assert set(df.selectExpr(*fe.INDICATOR_FLAGS.values()).first()) == {0}


def test_feature_order_is_the_published_one():
    assert len(fv.FEATURES) == len(set(fv.FEATURES)) == 35
    assert fv.FEATURES[0] == "bedrooms" and fv.FEATURES[24] == "region_price_index" and fv.FEATURES[-1] == "years_from_2019"
