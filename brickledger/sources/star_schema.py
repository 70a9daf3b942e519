"""Property sales read from the order tables.

Each order line becomes one transaction in the layout of the transaction
files, together with the property attributes that the files lack. All joins
are plain equi-joins: Spark broadcasts a dimension only while its measured
size is under the broadcast threshold, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brickledger.functions.scalar import decode_sql, literal

# ---- Fixed values: how order columns stand for property attributes ------------
YEAR_SHIFT = 24
# Orders after this year start over at the first sale year, so that all fall into the years of the fixed tables.
LAST_ORDER_YEAR, YEAR_SPAN = 2000, 6
TYPE_CODE = {"LARGE": "D", "MEDIUM": "S", "SMALL": "T", "STANDARD": "T", "ECONOMY": "F"}
CONDITION = {"AUTOMOBILE": "New Build", "BUILDING": "Excellent", "FURNITURE": "Good",
             "HOUSEHOLD": "Fair", "MACHINERY": "Poor"}
SCHOOL = {"1": "Outstanding", "2": "Good", "3": "Requires Improvement",
          "4": "Inadequate", "5": "Inadequate"}
FLOOD = {"N": "Low", "A": "Medium", "R": "High"}
COUNTIES = (
    "GREATER LONDON", " Greater London ", "Surrey", "KENT", "Hertfordshire", "ESSEX", "DEVON",
    "BRISTOL", "NOTTINGHAMSHIRE", "Derbyshire", "WARWICKSHIRE", "STAFFORDSHIRE",
    "WEST YORKSHIRE", "NORTH YORKSHIRE", "GREATER MANCHESTER", "MERSEYSIDE", "TYNE AND WEAR",
    "county durham", "CARDIFF", "POWYS", "RUTLAND", "ISLE OF WIGHT", "BORDERS", "HIGHLAND", "FIFE",
)
DISTRICTS = ("CAMDEN", "croydon ", "ELSEWHERE", "BARNET", "UNLISTED")
POSTCODE_AREAS = (
    "EC", "W", "SW", "SE", "E", "N", "NW", "IG", "EN", "GU", "RH", "OX", "CB", "NR", "MK", "BS",
    "EX", "PL", "NG", "DE", "NN", "B", "WV", "CV", "LS", "BD", "S", "M", "SK", "CH", "NE", "SR",
    "CF", "SA", "SY", "EH", "G", "AB", "IV", "ML", "XX",
)


# Columns read from each table.
INPUT_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
}


def _pick(values: tuple, index: str) -> str:
    listed = ", ".join(literal(v) for v in values)
    return f"try_element_at(array({listed}), CAST({index} % {len(values)} + 1 AS INT))"


_TYPE = decode_sql("p_type", TYPE_CODE, "O")
# amounts are never negative, so floor(x + 0.5) rounds them without the decimal
# detour that round() takes on doubles
TRANSACTION_COLUMNS = {
    "transaction_id": "md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                      "CAST(floor(l_extendedprice * 100 + 0.5D) AS BIGINT)))",
    "price": "CAST(floor(l_extendedprice + 0.5D) AS BIGINT)",
    "date_of_transfer": f"o_orderdate + make_ym_interval(IF(year(o_orderdate) > {LAST_ORDER_YEAR}, {YEAR_SHIFT - YEAR_SPAN}, {YEAR_SHIFT}), 0)",
    "postcode": f"CASE WHEN l_suppkey % 40 <> 7 THEN concat({_pick(POSTCODE_AREAS, '(l_suppkey + l_linenumber)')}, "
                "1 + l_partkey % 29, ' ', 1 + l_suppkey % 9, 'AB') END",
    "property_type": _TYPE,
    "new_build": "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Y' ELSE 'N' END",
    "tenure": decode_sql("l_linestatus", {"F": "F", "O": "L"}, "U"),
    "paon": "CAST(l_linenumber AS STRING)",
    "saon": "CAST(NULL AS STRING)",
    "street": "p_name",
    "locality": "CAST(NULL AS STRING)",
    "town": "concat('TOWN ', c_nationkey)",
    "district": _pick(DISTRICTS, "l_suppkey"),
    "county": _pick(COUNTIES, "c_nationkey"),
    "ppd_category": "CASE WHEN l_tax >= 0.08D THEN 'B' ELSE 'A' END",
    "record_status": "'A'",
    # attributes that transaction files lack
    "bedrooms": "l_linenumber - 1",
    "bathrooms": "CAST(least(l_linenumber - 1, 1 + l_suppkey % 4) AS INT)",
    "floor_area_sqm": "30 + 3 * CAST(l_quantity AS INT)",
    "build_year": "CAST(1800 + l_partkey % 219 AS INT)",
    "condition": decode_sql("c_mktsegment", CONDITION),
    "epc_rating": "substring('ABCDEFG', CAST(1 + l_suppkey % 7 AS INT), 1)",
    "nearest_school_ofsted": decode_sql("substring(o_orderpriority, 1, 1)", SCHOOL),
    "flood_risk": decode_sql("l_returnflag", FLOOD),
    "has_garage": "CAST(p_type <=> 'LARGE' AND l_partkey % 5 < 3 AS INT)",
    "commute_mins": "5 + 2 * p_size",
    "dist_to_station_km": "CAST(1 + l_partkey % 50 AS DOUBLE) / 10",
    "dist_to_centre_km": "CAST(5 + l_suppkey % 200 AS DOUBLE) / 10",
    "crime_index": "CAST(floor(l_discount * 1000 + 0.5D) AS DOUBLE)",
}


def _order_dates(years) -> str:
    """The order dates of exactly the given sale years, as ranges the scan can use."""
    placed = {y - YEAR_SHIFT for y in years if y - YEAR_SHIFT <= LAST_ORDER_YEAR}
    placed |= {y - YEAR_SHIFT + YEAR_SPAN for y in years if y - YEAR_SHIFT + YEAR_SPAN > LAST_ORDER_YEAR}
    ranges = [f"(o_orderdate >= TIMESTAMP_NTZ '{y}-01-01' AND o_orderdate < TIMESTAMP_NTZ '{y + 1}-01-01')" for y in sorted(placed)]
    return " OR ".join(ranges) or "false"


def transactions(spark: SparkSession, sf_dir: str, years=None) -> DataFrame:
    """Raw transactions. ``years`` prunes the order scan before any join."""
    def table(name: str) -> DataFrame:
        return spark.read.schema(INPUT_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    orders = table("orders") if years is None else table("orders").where(_order_dates(years))
    placed_orders = orders.join(table("customer"), F.expr("o_custkey = c_custkey"))
    sold = (
        table("lineitem")
        .join(table("part"), F.expr("l_partkey = p_partkey"))
        .join(placed_orders, F.expr("l_orderkey = o_orderkey"))
    )
    return sold.selectExpr(*[f"{text} AS {name}" for name, text in TRANSACTION_COLUMNS.items()])
