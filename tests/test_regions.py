from brickledger.functions import fixed_values as fv
from brickledger.operators.regions import with_region


def _resolve(spark, rows, mode):
    df = spark.createDataFrame(rows, "id int, county string, district string, postcode string")
    return {r["id"]: r["region"] for r in with_region(df, mode).collect()}


def _first_prefix(postcode):
    text = "NAN" if postcode is None else postcode.strip().upper()
    for region, starts in fv.POSTCODE_STARTS:
        if text.startswith(starts):
            return region
    return "Other"


def test_county_then_district_then_postcode(spark):
    rows = [
        (1, " Greater London ", "CROYDON", "CR0 1AA"), (2, "unmapped", "croydon ", "SW1 1AA"),
        (3, None, None, "LS1 1AA"), (4, "", "", ""), (5, None, None, None), (6, "KENT", None, "M1 1AA"),
    ]
    assert _resolve(spark, rows, "area") == {
        1: "London - Inner", 2: "London - Outer", 3: "Yorkshire & Humber", 4: "Other", 5: "Other", 6: "South East"}
    prefix = _resolve(spark, rows, "prefix")
    assert prefix[4] == "Other" and prefix[5] == "London - Outer"


def test_prefix_mode_equals_ordered_scan(spark):
    starts = [s for _, group in fv.POSTCODE_STARTS for s in group] + ["XX", "ZE", "Q"]
    codes = [f"{s}{n} 1AB" for s in starts for n in ("1", "12")] + [" ng1 2ab", None, ""]
    rows = [(i, None, None, code) for i, code in enumerate(codes)]
    assert _resolve(spark, rows, "prefix") == {i: _first_prefix(code) for i, code in enumerate(codes)}


def test_area_mode_reads_whole_areas(spark):
    expected = {
        "NG1 1AA": "East Midlands", "EH1 1AA": "Scotland", "BD1 1AA": "Yorkshire & Humber", "B1 1AA": "West Midlands",
        "N1 1AA": "London - Outer", "W1 1AA": "London - Inner", "W1A 1AA": "London - Inner", "W10 1AA": "London - Outer",
        "SW3 1AA": "London - Inner", "SW19 1AA": "London - Outer", "EC4 1AA": "London - Inner", "SR1 1AA": "North East",
        "SY1 1AA": "Wales", "ML1 1AA": "Scotland", "XX1 1AA": "Other", "g1 1aa": "Scotland",
    }
    rows = [(i, None, None, code) for i, code in enumerate(expected)]
    assert _resolve(spark, rows, "area") == dict(enumerate(expected.values()))


def test_white_space_around_names(spark):
    rows = [(i, f"{w}kent{w}", None, None) for i, w in enumerate((" ", "\t", "\n", "\x0b", "\x0c", "\r", " \r\n"))]
    rows += [(7, None, "\tcroydon \n", None), (8, " kent", None, None), (9, "ke nt", None, None)]
    assert _resolve(spark, rows, "area") == {**dict.fromkeys(range(7), "South East"), 7: "London - Outer", 8: "Other", 9: "Other"}


def test_lookups_add_no_join(spark):
    df = spark.createDataFrame([(1, "KENT", None, "M1 1AA")], "id int, county string, district string, postcode string")
    for mode in ("area", "prefix"):
        assert "Join" not in with_region(df, mode)._jdf.queryExecution().optimizedPlan().toString()
