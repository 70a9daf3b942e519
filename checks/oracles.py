"""The same results as plain SQL over the given tables."""

from __future__ import annotations

from brickledger.functions import fixed_values as fv
from brickledger.sources import star_schema as st


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _case(column: str, table: dict, other: str = "NULL") -> str:
    whens = " ".join(f"WHEN {_q(k) if isinstance(k, str) else k} THEN {_q(v) if isinstance(v, str) else v}"
                     for k, v in table.items())
    return f"CASE {column} {whens} ELSE {other} END"


def _hex(expr: str) -> str:
    return f"CAST('0x' || substr({expr}, 1, 8) AS BIGINT)"


def _digest(key: str, salt) -> str:
    return f"md5('{salt}-' || {key})"


_YEARS = _in(fv.HPI_YEARS)

RAW = f"""raw AS (
  SELECT md5(concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
             CAST(l_suppkey AS VARCHAR), CAST(CAST(floor(l_extendedprice * 100 + 0.5::DOUBLE) AS BIGINT) AS VARCHAR))) AS transaction_id,
    CAST(floor(l_extendedprice + 0.5::DOUBLE) AS BIGINT) AS price,
    o_orderdate + CASE WHEN year(o_orderdate) > {st.LAST_ORDER_YEAR} THEN INTERVAL {st.YEAR_SHIFT - st.YEAR_SPAN} YEAR
                       ELSE INTERVAL {st.YEAR_SHIFT} YEAR END AS date_of_transfer,
    CASE WHEN l_suppkey % 40 <> 7 THEN
      {_list(st.POSTCODE_AREAS)}[(l_suppkey + l_linenumber) % {len(st.POSTCODE_AREAS)} + 1]
      || (1 + l_partkey % 29) || ' ' || (1 + l_suppkey % 9) || 'AB' END AS postcode,
    {_case('p_type', st.TYPE_CODE, "'O'")} AS property_type,
    CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Y' ELSE 'N' END AS new_build,
    CASE l_linestatus WHEN 'F' THEN 'F' WHEN 'O' THEN 'L' ELSE 'U' END AS tenure,
    CAST(l_linenumber AS VARCHAR) AS paon, CAST(NULL AS VARCHAR) AS saon, p_name AS street,
    CAST(NULL AS VARCHAR) AS locality, 'TOWN ' || c_nationkey AS town,
    {_list(st.DISTRICTS)}[l_suppkey % {len(st.DISTRICTS)} + 1] AS district,
    {_list(st.COUNTIES)}[c_nationkey % {len(st.COUNTIES)} + 1] AS county,
    CASE WHEN l_tax >= 0.08 THEN 'B' ELSE 'A' END AS ppd_category, 'A' AS record_status,
    l_linenumber - 1 AS bedrooms,
    CAST(least(l_linenumber - 1, 1 + l_suppkey % 4) AS INTEGER) AS bathrooms,
    CAST(30 + 3 * CAST(l_quantity AS INTEGER) AS INTEGER) AS floor_area_sqm,
    CAST(1800 + l_partkey % 219 AS INTEGER) AS build_year,
    {_case('c_mktsegment', st.CONDITION)} AS condition,
    substr('ABCDEFG', 1 + l_suppkey % 7, 1) AS epc_rating,
    {_case('substr(o_orderpriority, 1, 1)', st.SCHOOL)} AS nearest_school_ofsted,
    {_case('l_returnflag', st.FLOOD)} AS flood_risk,
    CASE WHEN p_type = 'LARGE' AND l_partkey % 5 < 3 THEN 1 ELSE 0 END AS has_garage,
    CAST(5 + 2 * p_size AS INTEGER) AS commute_mins,
    CAST(1 + l_partkey % 50 AS DOUBLE) / 10 AS dist_to_station_km,
    CAST(5 + l_suppkey % 200 AS DOUBLE) / 10 AS dist_to_centre_km,
    CAST(CAST(floor(l_discount * 1000 + 0.5::DOUBLE) AS BIGINT) AS DOUBLE) AS crime_index
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey
)"""


def _by_place(column: str) -> str:
    return _case(f"upper(trim({column}))", fv.COUNTY_REGION)


def _by_prefix() -> str:
    text = "upper(trim(coalesce(postcode, 'nan')))"
    whens = " ".join(
        "WHEN " + " OR ".join(f"starts_with({text}, '{s}')" for s in starts) + f" THEN {_q(region)}"
        for region, starts in fv.POSTCODE_STARTS
    )
    return f"CASE {whens} ELSE 'Other' END"


def _by_area() -> str:
    inner = fv.POSTCODE_STARTS[0][1]
    area = "regexp_extract(upper(trim(postcode)), '^([A-Z]{1,2})[0-9]', 1)"
    district = "regexp_extract(upper(trim(postcode)), '^([A-Z]{1,2}[0-9]{1,2})', 1)"
    whens = [f"WHEN {area} IN {_in([s for s in inner if s.isalpha()])} OR "
             f"{district} IN {_in([s for s in inner if not s.isalpha()])} THEN 'London - Inner'"]
    whens += [f"WHEN {area} IN {_in(areas)} THEN {_q(region)}" for region, areas in fv.POSTCODE_STARTS[1:]]
    return f"CASE {' '.join(whens)} ELSE 'Other' END"


def _region(fallback: str) -> str:
    return f"coalesce({_by_place('county')}, {_by_place('district')}, {fallback})"


_AGE_BAND = ("CASE WHEN build_year < 1900 THEN 'Pre-1900' WHEN build_year < 1945 THEN '1900-1945' "
             "WHEN build_year < 1975 THEN '1945-1975' WHEN build_year < 2000 THEN '1975-2000' "
             "WHEN build_year < 2015 THEN '2000-2015' WHEN build_year IS NOT NULL THEN 'Post-2015' END")

PROPERTY_COLUMNS = f"""'LR' || transaction_id AS property_id, postcode, region,
    {_case('property_type', fv.TYPE_LABELS)} AS property_type,
    coalesce({_case('tenure', fv.TENURE_LABELS)}, 'Unknown') AS tenure,
    bedrooms, bathrooms, floor_area_sqm, build_year,
    CAST(year(date_of_transfer) - build_year AS INTEGER) AS property_age, {_AGE_BAND} AS age_band,
    CASE WHEN new_build = 'Y' THEN 'New Build' ELSE condition END AS condition, epc_rating, nearest_school_ofsted,
    CASE WHEN property_type IN ('D', 'S', 'T') THEN 1 ELSE 0 END AS has_garden,
    CASE WHEN property_type IN ('D', 'S') THEN 1 ELSE 0 END AS has_parking, has_garage,
    commute_mins, dist_to_station_km, dist_to_centre_km, crime_index, flood_risk,
    CAST(year(date_of_transfer) AS INTEGER) AS sale_year, {_case('region', fv.DENSITY)} AS density,
    price AS price_gbp, CAST(month(date_of_transfer) AS INTEGER) AS sale_month,
    CAST(quarter(date_of_transfer) AS INTEGER) AS sale_quarter,
    CASE WHEN new_build = 'Y' THEN 1 ELSE 0 END AS is_new_build, town, county"""

REGIONED = f"regioned AS (SELECT *, {_region(_by_area())} AS region FROM raw)"

PROPS = f"""{RAW}, {REGIONED}, props AS (
  SELECT {PROPERTY_COLUMNS} FROM regioned
  WHERE region <> 'Other' AND property_type IN ('D', 'S', 'T', 'F') AND ppd_category = 'A'
    AND price BETWEEN {fv.PRICE_FLOOR} AND {fv.PRICE_CEILING}
), parts AS (
  SELECT property_id, p < 0 AS is_test, CAST(CASE WHEN p < 0 THEN NULL WHEN p < more * (each_fold + 1) THEN p // (each_fold + 1)
      ELSE more + (p - more * (each_fold + 1)) // nullif(each_fold, 0) END AS INTEGER) AS fold
  FROM (SELECT property_id, place - tests AS p, (size - tests) // 5 AS each_fold, (size - tests) % 5 AS more
    FROM (SELECT property_id, row_number() OVER (ORDER BY {_digest('property_id', 'split42')}) - 1 AS place, count(*) OVER () AS size,
        CAST(ceil(count(*) OVER () * 0.2::DOUBLE) AS BIGINT) AS tests FROM props))
)"""

PREDS = PROPS + f""", fixed AS (
  SELECT *, price_gbp AS actual_price,
    CAST(round_even(CAST(price_gbp * (75 + {_hex(_digest('property_id', 'predict'))} % 51) AS DOUBLE) / 100, 0) AS BIGINT)
      AS predicted_price FROM props
), preds AS (
  SELECT property_id, actual_price, predicted_price, region, property_type, bedrooms, floor_area_sqm, sale_year,
    predicted_price - actual_price AS error_gbp,
    round_even(CAST(predicted_price - actual_price AS DOUBLE) / actual_price * 100, 1) + 0.0::DOUBLE AS error_pct,
    abs(predicted_price - actual_price) AS abs_error FROM fixed
)"""


FIXED_MODELS = PREDS + """, e AS (
  SELECT model, actual_price::DOUBLE AS a, ((actual_price - predicted_price) * times)::DOUBLE AS e
  FROM preds, (VALUES ('Gradient Boosting', 1), ('Random Forest', 2), ('Ridge Regression', 3)) m(model, times)
), compared AS (
  SELECT model, round_even(1 - avg(e * e) / var_pop(a), 4) AS r2, round_even(sqrt(avg(e * e)), 0) AS rmse,
    round_even(avg(abs(e)), 0) AS mae, round_even(avg(abs(e / a)) * 100, 2) AS mape FROM e GROUP BY model
)"""


def _valuation() -> str:
    d = lambda column, table: f"CAST({_case(column, table)} AS DOUBLE)"
    return f"""{d('region', fv.BASE_PRICE)}
      * pow(1 + {d('region', fv.YEARLY_GROWTH)}, sale_year - 2019) * {d('sale_year', fv.YEAR_FACTOR)}
      * {d('property_type', fv.TYPE_FACTOR)} * {d('tenure', fv.TENURE_FACTOR)} * {d('condition', fv.CONDITION_FACTOR)}
      * {d('epc_rating', fv.EPC_FACTOR)} * {d('nearest_school_ofsted', fv.SCHOOL_FACTOR)}
      * (1 + (bedrooms - 3) * 0.08::DOUBLE) * (1 + (floor_area_sqm - 100) / 1000.0::DOUBLE)
      * greatest(0.70::DOUBLE, 1 - commute_mins * 0.003::DOUBLE)
      * CASE WHEN has_garden = 1 THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END
      * CASE WHEN has_parking = 1 THEN 1.03::DOUBLE ELSE 1.0::DOUBLE END
      * CASE WHEN has_garage = 1 THEN 1.04::DOUBLE ELSE 1.0::DOUBLE END
      * (1 - crime_index * 0.001::DOUBLE) * {d('flood_risk', fv.FLOOD_FACTOR)}
      * CASE WHEN age_band = 'Pre-1900' THEN 1.04::DOUBLE WHEN property_age > 50 THEN 0.96::DOUBLE ELSE 1.0::DOUBLE END"""


def _sale_price(amount: str) -> str:
    return f"CAST(round_even(greatest(50000.0::DOUBLE, {amount}) / 1000, 0) * 1000 AS BIGINT)"


_NOISE = f"(1 + ({_hex(_digest('property_id', 'noise'))} % 12001 - 6000) / 100000.0::DOUBLE)"
VALUED = PROPS + f""", valued AS (
  SELECT * EXCLUDE (price_gbp, raw_value), {_sale_price(f'raw_value * {_NOISE}')} AS price_gbp
  FROM (SELECT *, {_valuation()} AS raw_value FROM props)
)"""

_TEST = "property_id IN (SELECT property_id FROM parts WHERE is_test)"


def _engineered(source: str, fit_where: str = "TRUE") -> str:
    flag = lambda test: f"CASE WHEN {test} THEN 1 ELSE 0 END"
    return f""", region_index AS (
  SELECT region, quantile_cont(price_gbp, 0.5) / 1000 AS region_price_index FROM {source} WHERE {fit_where} GROUP BY region
), scored AS (
  SELECT *, {_case('epc_rating', fv.EPC_SCORE)} AS epc_score,
    {_case('nearest_school_ofsted', fv.SCHOOL_SCORE)} AS school_score,
    {_case('condition', fv.CONDITION_SCORE)} AS condition_score, {_case('flood_risk', fv.FLOOD_SCORE)} AS flood_score,
    {_case('age_band', fv.AGE_BAND_SCORE)} AS age_band_score,
    {flag("property_type = 'Detached'")} AS type_detached, {flag("property_type = 'Semi-Detached'")} AS type_semi_detached,
    {flag("property_type = 'Terraced'")} AS type_terraced, {flag("property_type = 'Flat'")} AS type_flat,
    {flag("tenure = 'Freehold'")} AS is_freehold, {flag("density = 'urban'")} AS urban
  FROM {source} LEFT JOIN region_index USING (region)
), engineered AS (
  SELECT *, bedrooms * floor_area_sqm AS bed_area, school_score * urban AS school_x_density,
    commute_mins * urban AS commute_x_urban, property_age * condition_score AS age_x_condition,
    epc_score * age_band_score AS epc_x_age,
    bathrooms / (bedrooms + 0.1::DOUBLE) AS bath_bed_ratio, floor_area_sqm / (bedrooms + 0.1::DOUBLE) AS area_per_bed,
    has_garden * 3 + has_parking * 2 + has_garage * 2 + school_score + epc_score AS amenity_score,
    region_price_index / 100 - commute_mins / 60 - dist_to_centre_km / 30 - crime_index / 100
      - flood_score * 0.1::DOUBLE AS location_score,
    ln(1 + price_gbp::DOUBLE) AS log_price, ln(1 + floor_area_sqm::DOUBLE) AS log_floor_area,
    ln(1 + dist_to_centre_km) AS log_dist_centre, ln(1 + dist_to_station_km) AS log_dist_station,
    sale_year - 2019 AS years_from_2019 FROM scored
)"""


ENGINEERED = VALUED + _engineered("valued")
TRAINING = VALUED + _engineered("valued", f"NOT ({_TEST})")


def _six(names) -> str:
    # + 0.0 turns a negative zero into zero
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0::DOUBLE AS {n}" for n in names)


def _per_feature(template: str) -> str:
    return " UNION ALL ".join(template.format(f=f) for f in fv.FEATURES)


_STRENGTHS = _per_feature(
    "SELECT '{f}' AS feature, round_even(coalesce(pow(corr(CAST({f} AS DOUBLE), log_price), 2), 0.0), 6) AS importance "
    "FROM engineered")
SHARES = ENGINEERED + f""", strengths AS MATERIALIZED ({_STRENGTHS}), kept AS (
  SELECT * FROM strengths ORDER BY importance DESC, feature LIMIT 20
), features AS (
  SELECT feature, importance, round_even(importance / (SELECT sum(importance) FROM kept) * 100, 2) AS importance_pct FROM kept
)"""

REGIONAL = PREDS + """, regional AS (
  SELECT region, avg(abs_error) AS mae, count(actual_price) AS count, quantile_cont(actual_price, 0.5) AS median_actual,
    quantile_cont(predicted_price, 0.5) AS median_predicted,
    round_even(avg(abs_error) / quantile_cont(actual_price, 0.5) * 100, 1) AS mae_pct
  FROM preds GROUP BY region
)"""

_COMMUTE_BAND = ("CASE WHEN commute_mins <= 15 THEN '0–15 min' WHEN commute_mins <= 30 THEN '16–30 min' "
                 "WHEN commute_mins <= 45 THEN '31–45 min' WHEN commute_mins <= 60 THEN '46–60 min' "
                 "WHEN commute_mins <= 75 THEN '61–75 min' ELSE '75+ min' END")
_ERROR_BAND = ("CASE WHEN error_pct BETWEEN -5 AND 5 THEN 'Within ±5%' WHEN error_pct BETWEEN -10 AND 10 THEN 'Within ±10%' "
               "WHEN error_pct BETWEEN -20 AND 20 THEN 'Within ±20%' WHEN error_pct > 20 THEN 'Overestimate >20%' "
               "ELSE 'Underestimate >20%' END")


def _accuracy(pct: str) -> str:
    return (f"CASE WHEN {pct} <= 8 THEN 'Excellent (<8%)' WHEN {pct} <= 12 THEN 'Good (8–12%)' "
            f"WHEN {pct} <= 18 THEN 'Fair (12–18%)' ELSE 'Needs improvement (>18%)' END")


def _cut(minutes: str) -> str:
    whens = " ".join(f"WHEN {minutes} > {lo} AND {minutes} <= {hi} THEN '{label}'" for lo, hi, label in fv.COMMUTE_CUTS)
    return f"CASE {whens} END"


def _importance_band(pct: str) -> str:
    return (f"CASE WHEN {pct} >= 20 THEN 'Critical' WHEN {pct} >= 10 THEN 'High' WHEN {pct} >= 5 THEN 'Medium' "
            f"WHEN {pct} >= 1 THEN 'Low' ELSE 'Minimal' END")


_CLASS = ("CASE WHEN importance_pct > 15 THEN 'Critical (>15%)' WHEN importance_pct > 5 THEN 'High (5–15%)' "
          "ELSE 'Medium (<5%)' END")
_PRETTY = ("array_to_string(list_transform(string_split(feature, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')")


def _segment_profile(name: str, test: str) -> str:
    return f"""SELECT '{name}' AS segment, count(*) AS count, round(avg(price_gbp), 0) AS avg_price,
      round(avg(bedrooms), 1) AS avg_bedrooms, round(avg(floor_area_sqm), 0) AS avg_floor_area,
      round(avg(commute_mins), 0) AS avg_commute_mins,
      round(avg(CASE WHEN epc_rating IN ('A','B','C') THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1) AS pct_good_epc,
      round(avg(CASE WHEN nearest_school_ofsted IN ('Outstanding','Good') THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1)
        AS pct_good_school,
      round(avg(has_garden), 2) AS pct_with_garden, round(avg(has_garage), 2) AS pct_with_garage
    FROM props, cut WHERE {test}"""


def _counted(source: str, keys: str, value: str = "price", group: str | None = None, where: str = "TRUE") -> str:
    return (f"SELECT {keys}, count(*) AS n, CAST(sum({value}) AS BIGINT) AS total FROM {source} WHERE {where} GROUP BY ALL")


def _medians(sections: dict[str, str], source: str, names: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS {names.split()[0]}, CAST({column} AS VARCHAR) AS {names.split()[1]}, count(*) AS transactions, "
        f"quantile_cont(price_gbp, 0.5) AS median_price FROM {source} GROUP BY 2"
        for name, column in sections.items())


def _hpi() -> str:
    rows = ", ".join(f"({_q(r)}, {y}, {fv.HPI_AVERAGE[y][i]})" for i, r in enumerate(fv.REGIONS) for y in fv.HPI_YEARS)
    return f", hpi(region, sale_year, benchmark_price) AS (SELECT col0, CAST(col1 AS INTEGER), CAST(col2 AS BIGINT) FROM (VALUES {rows}) v(col0, col1, col2))"


def _schools() -> str:
    rows = ", ".join(f"({_q(r)}, {_q(b)}, {fv.SCHOOL_SHARES[b][i]})" for i, r in enumerate(fv.REGIONS) for b in fv.SCHOOL_BANDS)
    return f", schools(region, band, published_pct) AS (SELECT col0, col1, CAST(col2 AS INTEGER) FROM (VALUES {rows}) v(col0, col1, col2))"


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"


def _ordered_values(values) -> str:
    return "(VALUES " + ", ".join(f"({_q(v)}, {i})" for i, v in enumerate(values)) + ")"


_KEYS6 = {k: k for k in ("region", "property_type", "sale_year", "bedrooms", "epc_rating", "nearest_school_ofsted")}
_JSON_SECTIONS = {"regional_medians": "region", "price_by_type": "property_type", "price_by_year": "sale_year",
                  "price_by_beds": "bedrooms", "price_by_epc": "epc_rating", "price_by_school": "nearest_school_ofsted"}


def _median(where: str) -> str:
    return f"quantile_cont(price_gbp, 0.5) FILTER (WHERE {where})"


def _scaled_stats() -> str:
    return _per_feature(
        "SELECT '{f}' AS feature, abs(round(avg((CAST({f} AS DOUBLE) - m) / s), 6)) AS mean, "
        "round(stddev_pop((CAST({f} AS DOUBLE) - m) / s), 6) AS std FROM train, "
        "(SELECT avg(CAST({f} AS DOUBLE)) AS m, stddev_pop(CAST({f} AS DOUBLE)) AS s FROM train)")


FOLDS = PREDS + """, fold_scores AS (
  SELECT fold, 1 - avg(e * e) / var_pop(a) AS r2, sqrt(avg(e * e)) AS rmse
  FROM (SELECT fold, actual_price::DOUBLE AS a, (actual_price - predicted_price)::DOUBLE AS e FROM preds JOIN parts USING (property_id)
        WHERE fold IS NOT NULL) GROUP BY fold
)"""


def _document() -> str:
    """Every leaf of the results document as (path, text, number)."""
    text = lambda path, value: f"SELECT {path} AS path, CAST({value} AS VARCHAR) AS text, CAST(NULL AS DOUBLE) AS number"
    number = lambda path, value: f"SELECT {path} AS path, CAST(NULL AS VARCHAR) AS text, CAST({value} AS DOUBLE) AS number"
    out = []
    for key, label in (("gradient_boosting", "Gradient Boosting"), ("random_forest", "Random Forest"), ("ridge_regression", "Ridge Regression")):
        out += [number(_q(f"model_metrics.{key}.{m}"), m) + f" FROM compared WHERE model = {_q(label)}" for m in ("r2", "rmse", "mae", "mape")]
    for name, value in (("cv_r2_mean", "round_even(avg(r2), 4)"), ("cv_r2_std", "round_even(stddev_pop(r2), 4)"), ("cv_rmse_mean", "round_even(avg(rmse), 0)")):
        out.append(number(_q(f"model_metrics.gradient_boosting.{name}"), value) + " FROM fold_scores")
    listed = "(SELECT *, row_number() OVER (ORDER BY importance_pct DESC, feature DESC) - 1 AS i FROM features)"
    out += [number("'feature_importance[' || i || '].importance_pct'", "importance_pct") + f" FROM {listed}",
            text("'feature_importance[' || i || '].feature'", "feature") + f" FROM {listed}"]
    listed = "(SELECT *, row_number() OVER (ORDER BY region) - 1 AS i FROM regional)"
    out.append(text("'regional_accuracy[' || i || '].region'", "region") + f" FROM {listed}")
    out += [number(f"'regional_accuracy[' || i || '].{m}'", f"round_even({m}, 0)") + f" FROM {listed}"
            for m in ("mae", "count", "median_actual", "median_predicted", "mae_pct")]
    for section, column in _JSON_SECTIONS.items():
        listed = (f"(SELECT *, row_number() OVER (ORDER BY item) - 1 AS i FROM (SELECT CAST({column} AS VARCHAR) AS item, "
                  f"round_even(quantile_cont(price_gbp, 0.5), 0) AS m FROM props GROUP BY 1))")
        out += [text(f"'{section}[' || i || '].{column}'", "item") + f" FROM {listed}",
                number(f"'{section}[' || i || '].median_price'", "m") + f" FROM {listed}"]
    fields = ("actual_price", "predicted_price", "region", "property_type", "bedrooms", "floor_area_sqm", "sale_year", "error_gbp", "error_pct", "abs_error")
    listed = (f"(SELECT *, row_number() OVER (ORDER BY {', '.join(fields)}) - 1 AS i FROM "
              f"(SELECT * FROM preds ORDER BY {_digest('property_id', 42)} LIMIT 500))")
    out += [(text if f in ("region", "property_type") else number)(f"'sample_predictions[' || i || '].{f}'", f) + f" FROM {listed}" for f in fields]
    out += [number("'cv_scores.r2[' || fold || ']'", "round_even(r2, 4)") + " FROM fold_scores",
            number("'cv_scores.rmse[' || fold || ']'", "round_even(rmse, 0)") + " FROM fold_scores"]
    # the shared tables of three chains, each defined once
    chain = SHARES + FOLDS[len(PROPS):] + FIXED_MODELS[len(PREDS):] + REGIONAL[len(PREDS):]
    return _with(chain, " UNION ALL ".join(out))


def _one_split(body: str) -> str:
    """The best single split over the 0/1 features: largest drop of the variance of log price in the training rows."""
    flags = ("type_detached", "type_semi_detached", "type_terraced", "type_flat", "is_freehold")
    listed = " UNION ALL ".join(f"SELECT property_id, price_gbp, log_price, '{f}' AS feature, {f} AS side FROM engineered" for f in flags)
    return _with(TRAINING + f""", listed AS ({listed}), sides AS (
  SELECT feature, side, count(*)::DOUBLE AS n, avg(log_price) AS mean FROM listed WHERE NOT ({_TEST}) GROUP BY ALL
), gains AS (
  SELECT a.feature, a.n * b.n * (a.mean - b.mean) * (a.mean - b.mean) AS gain FROM sides a JOIN sides b ON a.feature = b.feature AND a.side = 0 AND b.side = 1
), best AS (SELECT feature FROM gains ORDER BY gain DESC LIMIT 1), estimates AS (
  SELECT property_id, price_gbp AS actual_price, CAST(round_even(exp(mean) - 1, 0) AS BIGINT) AS predicted_price
  FROM listed JOIN best USING (feature) JOIN sides USING (feature, side))""", body)


def sql() -> dict[str, str]:
    raw_only = RAW
    sample = f"sample AS (SELECT * FROM preds ORDER BY {_digest('property_id', 42)} LIMIT 800)"
    train = f", train AS (SELECT * FROM engineered WHERE NOT ({_TEST}))"
    return {
        "q01_regional_summary": _with(PROPS, """SELECT region, count(*) AS transactions, min(price_gbp) AS min_price,
            round(percentile_cont(0.25) WITHIN GROUP (ORDER BY price_gbp), 0) AS p25_price,
            round(percentile_cont(0.50) WITHIN GROUP (ORDER BY price_gbp), 0) AS median_price,
            round(avg(price_gbp), 0) AS mean_price,
            round(percentile_cont(0.75) WITHIN GROUP (ORDER BY price_gbp), 0) AS p75_price,
            max(price_gbp) AS max_price, round(stddev(price_gbp), 0) AS price_stddev
            FROM props GROUP BY region ORDER BY median_price DESC"""),
        "q02_type_by_region": _with(PROPS, """SELECT region,
            round(avg(CASE WHEN property_type = 'Detached' THEN price_gbp END), 0) AS detached_avg,
            round(avg(CASE WHEN property_type = 'Semi-Detached' THEN price_gbp END), 0) AS semi_avg,
            round(avg(CASE WHEN property_type = 'Terraced' THEN price_gbp END), 0) AS terraced_avg,
            round(avg(CASE WHEN property_type = 'Flat' THEN price_gbp END), 0) AS flat_avg,
            round(avg(CASE WHEN property_type = 'Detached' THEN price_gbp END) /
              nullif(avg(CASE WHEN property_type = 'Flat' THEN price_gbp END), 0), 2) AS detached_to_flat_ratio
            FROM props GROUP BY region"""),
        "q03_epc_premium": _with(PROPS + ", base AS (SELECT avg(price_gbp) AS overall FROM props)", """
            SELECT epc_rating, count(*) AS properties, round(avg(price_gbp), 0) AS avg_price,
            round(avg(price_gbp) / (SELECT overall FROM base) * 100 - 100, 1) + 0.0::DOUBLE AS pct_premium_vs_avg,
            round(avg(floor_area_sqm), 0) AS avg_floor_area, round(avg(commute_mins), 0) AS avg_commute_mins
            FROM props GROUP BY epc_rating"""),
        "q04_school_effect": _with(PROPS, """SELECT nearest_school_ofsted, count(*) AS properties,
            round(avg(price_gbp), 0) AS avg_price,
            round(percentile_cont(0.50) WITHIN GROUP (ORDER BY price_gbp), 0) AS median_price,
            round(avg(price_gbp) - lag(avg(price_gbp)) OVER (ORDER BY CASE nearest_school_ofsted WHEN 'Outstanding' THEN 1
              WHEN 'Good' THEN 2 WHEN 'Requires Improvement' THEN 3 WHEN 'Inadequate' THEN 4 END), 0)
              AS price_diff_from_better_band
            FROM props GROUP BY nearest_school_ofsted"""),
        "q05_commute_prices": _with(PROPS, f"""SELECT {_COMMUTE_BAND} AS commute_band, count(*) AS properties,
            round(avg(price_gbp), 0) AS avg_price,
            round(percentile_cont(0.50) WITHIN GROUP (ORDER BY price_gbp), 0) AS median_price,
            round(avg(floor_area_sqm), 0) AS avg_floor_area FROM props GROUP BY commute_band"""),
        "q06_yearly_growth": _with(PROPS, """SELECT sale_year, count(*) AS transactions, round(avg(price_gbp), 0) AS avg_price,
            round(percentile_cont(0.50) WITHIN GROUP (ORDER BY price_gbp), 0) AS median_price,
            round(avg(price_gbp) / lag(avg(price_gbp)) OVER (ORDER BY sale_year) * 100 - 100, 1) + 0.0::DOUBLE AS yoy_pct_change,
            round(sum(price_gbp) / 1e9, 2) AS total_market_value_bn FROM props GROUP BY sale_year"""),
        "q07_bedroom_value": _with(PROPS + """, cells AS (SELECT property_type, bedrooms, round(avg(price_gbp), 0) AS avg_price,
            count(*) AS n FROM props GROUP BY property_type, bedrooms HAVING count(*) >= 10)""", """
            SELECT property_type, bedrooms, avg_price, n, round(avg_price - lag(avg_price) OVER
              (PARTITION BY property_type ORDER BY bedrooms), 0) AS marginal_bedroom_value FROM cells"""),
        "q08_accuracy_by_region": _with(REGIONAL, f"""SELECT region, round(median_actual, 0) AS median_actual_price,
            round(median_predicted, 0) AS median_predicted_price, round(mae, 0) AS mean_abs_error,
            mae_pct AS mae_as_pct_of_price, count AS test_transactions, {_accuracy('mae_pct')} AS accuracy_band FROM regional"""),
        "q09_error_distribution": _with(PREDS, f"""SELECT {_ERROR_BAND} AS error_band, count(*) AS predictions,
            round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct_of_total,
            round(avg(actual_price), 0) AS avg_actual_price FROM preds GROUP BY error_band"""),
        "q10_top_decile_profile": _with(
            PROPS + ", cut AS (SELECT percentile_cont(0.90) WITHIN GROUP (ORDER BY price_gbp) AS p90 FROM props)",
            _segment_profile("Top 10% Properties", "price_gbp >= p90") + " UNION ALL "
            + _segment_profile("Bottom 90% Properties", "price_gbp < p90")),
        "q11_flood_discount": _with(PROPS, """SELECT flood_risk, count(*) AS properties, round(avg(price_gbp), 0) AS avg_price,
            round(percentile_cont(0.50) WITHIN GROUP (ORDER BY price_gbp), 0) AS median_price,
            round(avg(floor_area_sqm), 0) AS avg_floor_area, round(avg(commute_mins), 0) AS avg_commute_mins
            FROM props GROUP BY flood_risk"""),
        "q12_importance_ranking": _with(SHARES, f"""SELECT feature, importance_pct,
            round(sum(importance_pct) OVER (ORDER BY importance_pct DESC), 1) AS cumulative_importance_pct,
            {_importance_band('importance_pct')} AS importance_band FROM features ORDER BY importance_pct DESC, feature LIMIT 20"""),
        "s1_price_paid_files": _with(raw_only, """SELECT transaction_id, price,
            strftime(date_of_transfer, '%Y-%m-%d %H:%M') AS date_of_transfer, postcode, property_type, new_build, tenure,
            paon, saon, street, locality, town, district, county, ppd_category, record_status FROM raw"""),
        "s2_yearly_union": _with(raw_only, _counted(
            "raw", "CAST(year(date_of_transfer) AS VARCHAR) AS year", where="year(date_of_transfer) IN (2022, 2024) "
            "AND property_type <> 'O' AND ppd_category = 'A' AND price BETWEEN 10000 AND 5000000")),
        "s3_headered_csv": _with(PROPS, "SELECT * EXCLUDE (sale_month, sale_quarter, is_new_build, town, county) FROM props"),
        "s4_registered_tables": _with(PROPS, """SELECT region, count(*) AS transactions,
            round(percentile_cont(0.5) WITHIN GROUP (ORDER BY price_gbp), 0) AS median_price,
            round(avg(price_gbp), 0) AS mean_price, round(stddev(price_gbp), 0) AS price_stddev FROM props GROUP BY region"""),
        "s6_csv_sinks": _with(PREDS, _counted("preds", "region", "abs_error")),
        "s7_median_sections": _with(PROPS, "SELECT section, item, round_even(median_price, 0) AS median_price FROM ("
                                    + _medians(_JSON_SECTIONS, "props", "section item") + ")"),
        "s7_fixed_document": _document(),
        "s8_exact_sample": _with(PROPS, f"SELECT property_id, price_gbp FROM props ORDER BY {_digest('property_id', 42)} LIMIT 800"),
        "s9_test_head": _with(PREDS, f"SELECT * FROM preds WHERE {_TEST} ORDER BY {_digest('property_id', 42)} LIMIT 500"),
        "f1_residential": _with(raw_only, _counted("raw", "property_type", where="property_type IN ('D', 'S', 'T', 'F')")),
        "f2_standard_category": _with(raw_only, _counted("raw", "property_type", where="ppd_category = 'A'")),
        "f3_price_range": _with(raw_only, """SELECT property_type, count(*) AS n, min(price) AS low, max(price) AS high
            FROM raw WHERE price >= 10000 AND price <= 5000000 GROUP BY property_type"""),
        "f4_resolved_regions": _with(f"{RAW}, {REGIONED}", _counted("regioned", "region", where="region <> 'Other'")),
        "f5_under_cap": _with(VALUED, _counted("valued", "region", "price_gbp", where="price_gbp <= 800000")),
        "f9_trend_of_one_type": _with(PROPS, """SELECT sale_year, property_type, quantile_cont(price_gbp, 0.5) AS median_price
            FROM props WHERE property_type = 'Flat' GROUP BY ALL"""),
        "f10_filtered_predictions": _with(PREDS, f"""SELECT *, {_accuracy('abs(error_pct)')} AS accuracy_band FROM preds
            WHERE region = 'South East' AND property_type = 'Terraced' AND abs(error_pct) <= 8"""),
        "p1_lenient_dates": _with(RAW + ", dated AS (SELECT CASE WHEN town <> 'TOWN 3' THEN date_of_transfer END AS d FROM raw)", """
            SELECT CAST(year(d) AS INTEGER) AS sale_year, CAST(month(d) AS INTEGER) AS sale_month,
            CAST(quarter(d) AS INTEGER) AS sale_quarter, count(*) AS n FROM dated GROUP BY ALL"""),
        "p3_type_labels": _with(raw_only, _counted("raw", f"property_type, {_case('property_type', fv.TYPE_LABELS)} AS label")),
        "p4_tenure_labels": _with(RAW + ", t AS (SELECT price, CASE WHEN district <> 'UNLISTED' THEN tenure END AS tenure FROM raw)",
                                  _counted("t", f"tenure, coalesce({_case('tenure', fv.TENURE_LABELS)}, 'Unknown') AS label")),
        "p5_clean_names": _with(raw_only, _counted(
            "raw", "upper(trim(county)) AS county_upper, upper(trim(district)) AS district_upper")),
        "p6_region_by_area": _with(raw_only, _counted(
            "raw", f"regexp_extract(coalesce(postcode, ''), '^([A-Z]*)', 1) AS area, {_region(_by_area())} AS region")),
        "p6_region_by_prefix": _with(raw_only, _counted(
            "raw", f"regexp_extract(coalesce(postcode, ''), '^([A-Z]*)', 1) AS area, {_region(_by_prefix())} AS region")),
        "p7_new_build_flag": _with(raw_only, _counted(
            "raw", "CASE WHEN district <> 'UNLISTED' AND new_build = 'Y' THEN 1 ELSE 0 END AS is_new_build")),
        "p8_final_columns": _with(PROPS, "SELECT * FROM props"),
        "p9_conditions": _with(raw_only, _counted("raw", """new_build, CASE WHEN new_build = 'Y' THEN 'New Build'
            WHEN county <> 'KENT' THEN condition END AS condition""")),
        "p10_amenity_flags": _with(PROPS, _counted("props", "property_type, has_garden, has_parking", "has_garage")),
        "p11_serial_ids": _with(PROPS, f"""SELECT property_id AS source_id, price_gbp,
            printf('LR%07d', row_number() OVER (ORDER BY {_digest('property_id', 'row')})) AS property_id FROM props"""),
        "p12_ordinal_scores": _with(ENGINEERED, "SELECT property_id, " + _six(
            ["epc_score", "school_score", "condition_score", "flood_score", "age_band_score"]) + " FROM engineered"),
        "p13_indicator_flags": _with(ENGINEERED, "SELECT property_id, " + _six(
            ["type_detached", "type_semi_detached", "type_terraced", "type_flat", "is_freehold"]) + " FROM engineered"),
        "p14_interactions": _with(ENGINEERED, "SELECT property_id, " + _six(
            ["bed_area", "school_x_density", "commute_x_urban", "age_x_condition", "epc_x_age", "bath_bed_ratio",
             "area_per_bed"]) + " FROM engineered"),
        "p15_composites": _with(ENGINEERED, "SELECT property_id, " + _six(["amenity_score", "location_score"]) + " FROM engineered"),
        "p17_logs_and_time": _with(ENGINEERED, "SELECT property_id, " + _six(
            ["log_price", "log_floor_area", "log_dist_centre", "log_dist_station", "years_from_2019"]) + " FROM engineered"),
        "p19_feature_matrix": _with(ENGINEERED, "SELECT property_id, " + ", ".join(
            f"round(coalesce(CAST({f} AS DOUBLE), 0.0), 6) + 0.0::DOUBLE AS {f}" for f in fv.FEATURES) + " FROM engineered"),
        "p20_price_from_log": _with(VALUED, "SELECT property_id, round(CAST(price_gbp AS DOUBLE), 2) AS price_back FROM valued"),
        "p21_residuals": _with(PREDS, "SELECT * FROM preds"),
        "p22_band_counts": _with(PREDS, f"""SELECT {_COMMUTE_BAND} AS commute_band, {_ERROR_BAND} AS error_band,
            {_accuracy('abs(error_pct)')} AS accuracy_band, {_AGE_BAND} AS age_band, count(*) AS n
            FROM preds JOIN (SELECT property_id, commute_mins, build_year FROM props) USING (property_id) GROUP BY ALL"""),
        "p23_commute_cuts": _with(PROPS + ", m AS (SELECT commute_mins * 2 - 30 AS minutes FROM props)",
                                  _counted("m", f"{_cut('minutes')} AS commute_band", "minutes")),
        "p24_rounding": _with(PROPS + ", q AS (SELECT property_type, price_gbp / 4.0::DOUBLE AS q FROM props)", """
            SELECT property_type, CAST(sum(CAST(round(q) AS BIGINT)) AS BIGINT) AS half_up,
            CAST(sum(CAST(round_even(q, 0) AS BIGINT)) AS BIGINT) AS half_even,
            CAST(sum(CAST(trunc(round(q, 1) * 10) AS BIGINT)) AS BIGINT) AS half_up_1 FROM q GROUP BY property_type"""),
        "p26_guarded_ratio": _with(PROPS, """SELECT bedrooms, count(*) AS n, round(avg(floor_area_sqm::DOUBLE /
            nullif(bedrooms, 0)), 6) AS area_per_bedroom FROM props GROUP BY bedrooms"""),
        "p27_clamped": _with(PROPS, """SELECT greatest(5, least(120, commute_mins * 2 - 20)) AS minutes, count(*) AS n
            FROM props GROUP BY ALL"""),
        "p28_absolute_errors": _with(PREDS, _counted("preds", "region", "abs(error_gbp)")),
        "p29_importance_classes": _with(SHARES, f"""SELECT feature, importance_pct, {_PRETTY} AS label,
            {_CLASS} AS importance_class, {_importance_band('importance_pct')} AS importance_band FROM features"""),
        "p31_price_texts": _with(VALUED + ", m AS (SELECT region, quantile_cont(price_gbp, 0.5) AS v FROM valued GROUP BY region)", """
            SELECT region, v / 1000 AS thousands, '£' || CAST(round_even(v / 1000, 0) AS BIGINT) || 'k' AS short_text,
            '£' || format('{:,}', CAST(round_even(v, 0) AS BIGINT)) AS long_text, region LIKE '%London%' AS is_london FROM m"""),
        "p32_valuations": _with(PROPS, f"SELECT property_id, {_sale_price(_valuation())} AS valuation_gbp FROM props"),
        "j3_region_index_rows": _with(PROPS, """SELECT property_id, region, region_price_index FROM props JOIN
            (SELECT region, quantile_cont(price_gbp, 0.5) / 1000 AS region_price_index FROM props GROUP BY region) USING (region)"""),
        "j5_benchmark_rows": _with(VALUED + _hpi(), """SELECT property_id, benchmark_price,
            round(CAST(price_gbp AS DOUBLE) / benchmark_price * 100 - 100, 1) + 0.0::DOUBLE AS pct_vs_benchmark
            FROM valued LEFT JOIN hpi USING (region, sale_year)"""),
        "j5_price_index_gap": _with(VALUED + _hpi(), """SELECT region, sale_year, coalesce(transactions, 0) AS transactions, round(a, 0) AS avg_price,
            benchmark_price, round(a / benchmark_price * 100 - 100, 1) + 0.0::DOUBLE AS pct_vs_benchmark FROM
            (SELECT region, sale_year, count(*) AS transactions, avg(price_gbp) AS a FROM valued GROUP BY ALL)
            FULL JOIN hpi USING (region, sale_year)"""),
        "j5_annual_change_gap": _with(VALUED + ", published(region, before, after, published_change_pct) AS (VALUES " + ", ".join(
            f"({_q(r)}, {fv.HPI_AVERAGE[2023][i]}::DOUBLE, {fv.HPI_AVERAGE[2024][i]}::DOUBLE, {fv.HPI_CHANGE_2024_PCT[i]}::DOUBLE)"
            for i, r in enumerate(fv.REGIONS)) + """), seen AS (
              SELECT region, avg(price_gbp) FILTER (sale_year = 2023) AS x, avg(price_gbp) FILTER (sale_year = 2024) AS y
              FROM valued WHERE sale_year IN (2023, 2024) GROUP BY region)""", """
            SELECT coalesce(s.region, p.region) AS region, round(x, 0) AS avg_before, round(y, 0) AS avg_price,
              round(y / x * 100 - 100, 1) + 0.0::DOUBLE AS observed_change_pct, round(after / before * 100 - 100, 1) + 0.0::DOUBLE AS index_change_pct,
              published_change_pct, round(y / x * 100 - 100 - published_change_pct, 1) + 0.0::DOUBLE AS gap_points
            FROM seen s FULL JOIN published p ON p.region = s.region"""),
        "j6_school_mix_gap": _with(PROPS + _schools(), """SELECT region, nearest_school_ofsted, properties,
            round(share, 1) AS observed_pct, published_pct, round(share - published_pct, 1) + 0.0::DOUBLE AS gap_points FROM
            (SELECT *, CAST(properties AS DOUBLE) / nullif(sum(properties) OVER (PARTITION BY region), 0) * 100 AS share FROM
              (SELECT coalesce(p.region, s.region) AS region, coalesce(nearest_school_ofsted, band) AS nearest_school_ofsted,
                 coalesce(n, 0) AS properties, published_pct FROM
                (SELECT region, nearest_school_ofsted, count(*) AS n FROM props GROUP BY region, nearest_school_ofsted) p
                FULL JOIN schools s ON s.region = p.region AND s.band = p.nearest_school_ofsted))"""),
        "j7_carried_attributes": _with(PREDS, _counted(
            "preds", "region, property_type, bedrooms, floor_area_sqm, sale_year", "error_gbp")),
        "a5_overall_p90": _with(PROPS, "SELECT round(quantile_cont(price_gbp, 0.9), 3) AS p90 FROM props"),
        "a3_merged_moments": _with(PROPS, """SELECT region, count(*) AS transactions, min(price_gbp) AS min_price, max(price_gbp) AS max_price,
            round(avg(price_gbp), 2) AS mean_price, round(stddev(price_gbp), 2) AS price_stddev FROM props GROUP BY region"""),
        "a5_sketched_quantiles": _with(PROPS, """SELECT region, quantile, TRUE AS within FROM (SELECT DISTINCT region FROM props),
            (SELECT unnest([0.05::DOUBLE, 0.25, 0.5, 0.75, 0.95]) AS quantile)"""),
        "a13_sketched_levels": _with(PROPS, "SELECT region, count(DISTINCT town) AS towns, TRUE AS within FROM props GROUP BY region"),
        "a6_medians_by_each_key": _with(PROPS, _medians(_KEYS6, "props", "dimension segment")),
        "a9_regional_statistics": _with(PROPS, """SELECT region, count(*) AS count, round_even(quantile_cont(price_gbp, 0.5), 0)
            AS median, round_even(avg(price_gbp), 0) AS mean, min(price_gbp) AS min, max(price_gbp) AS max
            FROM props GROUP BY region"""),
        "a12_regional_accuracy": _with(REGIONAL, "SELECT * REPLACE (round(mae, 6) AS mae) FROM regional"),
        "a13_distinct_levels": _with(PROPS, """SELECT count(DISTINCT region) AS regions,
            (SELECT string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FROM (SELECT DISTINCT sale_year AS y FROM props)) AS years
            FROM props"""),
        "a14_price_centre": _with(VALUED, """SELECT count(*) AS properties, avg(price_gbp) AS mean_price,
            quantile_cont(price_gbp, 0.5) AS median_price, max(price_gbp) AS max_price FROM valued"""),
        "a15_scatter_summary": _with(f"{PREDS}, {sample}", """SELECT round(pow(corr(actual_price, predicted_price), 2), 6) AS r2,
            round(avg(abs_error), 6) AS mae, greatest(max(actual_price), max(predicted_price)) AS axis_max FROM sample"""),
        "a18_fixture_measures": _with(PREDS + """, e AS (SELECT actual_price::DOUBLE AS a, (actual_price - predicted_price)::DOUBLE AS e
            FROM preds)""", """SELECT round_even(1 - sum(e * e) / (SELECT sum((a - m) * (a - m)) FROM e, (SELECT avg(a) AS m FROM e)), 4)
            AS r2, round_even(sqrt(avg(e * e)), 0) AS rmse, round_even(avg(abs(e)), 0) AS mae,
            round_even(avg(abs(e / a)) * 100, 2) AS mape FROM e"""),
        "a19_fold_summary": _with(FOLDS, """SELECT 'r2' AS measure, round(avg(r2), 6) AS mean, round(stddev_pop(r2), 6) AS std FROM fold_scores
            UNION ALL SELECT 'rmse', round(avg(rmse), 6), round(stddev_pop(rmse), 6) FROM fold_scores"""),
        "c1_regional_prices": _with(VALUED + ", m AS (SELECT region, quantile_cont(price_gbp, 0.5) AS v FROM valued GROUP BY region)", """
            SELECT region, v AS median_price, contains(region, 'London') AS is_london,
            '£' || CAST(round_even(v / 1000, 0) AS BIGINT) || 'k' AS label FROM m"""),
        "c2_price_by_type": _with(VALUED, f"""SELECT d.col0 AS property_type, m AS median_price, a AS p25_price, b AS p75_price,
            m - a AS arm_below, b - m AS arm_above, sales, CAST(d.col1 AS INTEGER) AS position
            FROM {_ordered_values(fv.PROPERTY_TYPES)} d LEFT JOIN (SELECT property_type, quantile_cont(price_gbp, 0.5) AS m,
            quantile_cont(price_gbp, 0.25) AS a, quantile_cont(price_gbp, 0.75) AS b, count(price_gbp) AS sales
            FROM valued GROUP BY property_type) s ON s.property_type = d.col0"""),
        "c3_top_importances": _with(SHARES, f"""SELECT {_PRETTY} AS label, importance_pct, {_CLASS} AS importance_class
            FROM (SELECT * FROM features ORDER BY importance_pct DESC, feature LIMIT 15)"""),
        "c4_scatter_sample": _with(f"{PREDS}, {sample}", """SELECT property_id, actual_price, predicted_price,
            abs(error_pct) AS abs_error_pct FROM sample"""),
        "c5_yearly_trend": _with(VALUED, """SELECT sale_year, property_type, quantile_cont(price_gbp, 0.5) AS median_price
            FROM valued GROUP BY ALL"""),
        "c6_epc_medians": _with(VALUED, f"""SELECT d.col0 AS epc_rating, CAST(d.col1 AS INTEGER) AS position, median_price
            FROM {_ordered_values(fv.EPC_BANDS)} d JOIN (SELECT epc_rating, quantile_cont(price_gbp, 0.5) AS median_price
            FROM valued GROUP BY epc_rating) s ON s.epc_rating = d.col0"""),
        "c6_school_medians": _with(VALUED, f"""SELECT d.col0 AS nearest_school_ofsted, CAST(d.col1 AS INTEGER) AS position, median_price
            FROM {_ordered_values(fv.SCHOOL_BANDS)} d JOIN (SELECT nearest_school_ofsted, quantile_cont(price_gbp, 0.5) AS median_price
            FROM valued GROUP BY nearest_school_ofsted) s ON s.nearest_school_ofsted = d.col0"""),
        "c8_commute_medians": _with(VALUED, f"""SELECT {_cut('commute_mins')} AS commute_band,
            quantile_cont(price_gbp, 0.5) AS median_price FROM valued GROUP BY commute_band"""),
        "c8_price_histogram": _with(VALUED + """, capped AS (SELECT price_gbp AS p FROM valued WHERE price_gbp <= 800000),
            lim AS (SELECT min(p) AS low, max(p) AS high FROM capped)""", """SELECT b.bin, coalesce(properties, 0) AS properties,
            lowest, highest FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(60)) b LEFT JOIN
            (SELECT CAST(least(floor((p - low)::DOUBLE / nullif((high - low)::DOUBLE, 0) * 60), 59) AS INTEGER) AS bin,
               count(*) AS properties, min(p) AS lowest, max(p) AS highest FROM capped, lim GROUP BY bin) f USING (bin)"""),
        "k1_headline_findings": _with(VALUED + f""", m AS (SELECT {_median('commute_mins <= 15')} AS near,
            {_median('commute_mins > 75')} AS far, {_median("epc_rating = 'A'")} AS ea, {_median("epc_rating = 'G'")} AS eg,
            {_median("nearest_school_ofsted = 'Outstanding'")} AS so, {_median("nearest_school_ofsted = 'Inadequate'")} AS si,
            {_median("property_type = 'Detached'")} AS td, {_median("property_type = 'Flat'")} AS tf,
            {_median('sale_year = 2019')} AS y19, {_median('sale_year = 2022')} AS y22, {_median('sale_year = 2023')} AS y23,
            {_median('sale_year = 2024')} AS y24, {_median("region = 'London - Inner'")} AS li,
            {_median("region = 'North East'")} AS ne FROM valued)""", """SELECT near AS median_within_15_min,
            far AS median_beyond_75_min, ea - eg AS epc_a_minus_g, so - si AS school_best_minus_worst, td AS median_detached,
            tf AS median_flat, round(td / tf, 1) AS detached_to_flat, y22 AS median_2022,
            round((y22 / y19 - 1) * 100, 1) + 0.0::DOUBLE AS pct_2022_vs_2019, y23 AS median_2023,
            round((y23 / y22 - 1) * 100, 1) + 0.0::DOUBLE AS pct_2023_vs_2022, y24 AS median_2024,
            round((y24 / y23 - 1) * 100, 1) + 0.0::DOUBLE AS pct_2024_vs_2023, li AS median_inner_london, ne AS median_north_east,
            round(li / ne, 1) AS inner_london_to_north_east FROM m"""),
        "k2_ingest_summary": _with(PROPS, "SELECT *, '£' || format('{:,}', CAST(round_even(median_price, 0) AS BIGINT)) AS median_text FROM ("
                                   + _medians({"total": "'all'", "year": "sale_year", "region": "region",
                                               "type": "property_type"}, "props", "section item") + ")"),
        "m1_split_counts": _with(PROPS, _counted("(SELECT * FROM props JOIN parts USING (property_id))", "is_test, fold", "price_gbp")),
        "m1_stratified_split": _with(PROPS, f"""SELECT property_id, region FROM (SELECT property_id, region,
            row_number() OVER (PARTITION BY region ORDER BY {_digest('property_id', 'split42')}) AS r,
            count(*) OVER (PARTITION BY region) AS size FROM props) WHERE r <= ceil(size * 0.2::DOUBLE)"""),
        "m2_feature_statistics": _with(TRAINING + train, _per_feature(
            "SELECT '{f}' AS feature, round(avg(CAST({f} AS DOUBLE)), 6) AS mean, "
            "round(stddev_pop(CAST({f} AS DOUBLE)), 6) AS std FROM train")),
        "m2_standardised": _with(TRAINING + train, _scaled_stats()),
        "m2_standardised_test": _with(TRAINING + train + f", test AS (SELECT * FROM engineered WHERE {_TEST})", _per_feature(
            "SELECT '{f}' AS feature, round(avg((CAST({f} AS DOUBLE) - m) / s), 5) AS mean, "
            "round(stddev_pop((CAST({f} AS DOUBLE) - m) / s), 5) AS std FROM test, "
            "(SELECT avg(CAST({f} AS DOUBLE)) AS m, stddev_samp(CAST({f} AS DOUBLE)) AS s FROM train)")),
        "m3_ridge_gradient": " UNION ALL ".join(f"SELECT '{f}' AS feature, 0.0::DOUBLE AS gradient" for f in (*fv.FEATURES, "intercept")),
        "m3_two_feature_ridge": _with(TRAINING + train + """, s AS (
            SELECT count(*)::DOUBLE AS n, avg(floor_area_sqm) AS ma, stddev_pop(floor_area_sqm) AS sa, avg(commute_mins) AS mb,
              stddev_pop(commute_mins) AS sb, avg(log_price) AS my, covar_pop(floor_area_sqm, commute_mins) AS ab,
              covar_pop(floor_area_sqm, log_price) AS ay, covar_pop(commute_mins, log_price) AS yb FROM train),
          z AS (SELECT *, n + 10 AS d, n * ab / (sa * sb) AS o, n * ay / sa AS u, n * yb / sb AS v FROM s)""", """
            SELECT 'floor_area_sqm' AS feature, round((u * d - v * o) / (d * d - o * o), 6) AS weight, round(ma, 6) AS mean, round(sa, 6) AS scale FROM z
            UNION ALL SELECT 'commute_mins', round((v * d - u * o) / (d * d - o * o), 6), round(mb, 6), round(sb, 6) FROM z
            UNION ALL SELECT 'intercept', round(my, 6), 0.0, 0.0 FROM z"""),
        "m10_one_split_importances": _one_split("SELECT feature, CASE WHEN feature IN (SELECT feature FROM best) THEN 1.0::DOUBLE ELSE 0.0 END AS importance FROM gains"),
        "m11_one_split_predictions": _one_split(f"""SELECT property_id, actual_price, predicted_price, predicted_price - actual_price AS error_gbp,
            round_even(CAST(predicted_price - actual_price AS DOUBLE) / actual_price * 100, 1) + 0.0::DOUBLE AS error_pct,
            abs(predicted_price - actual_price) AS abs_error FROM estimates WHERE {_TEST}"""),
        "m14_one_split_scores": _one_split("SELECT property_id, predicted_price AS estimate_gbp FROM estimates"),
        "m7_fixed_comparison": _with(FIXED_MODELS, "SELECT * FROM compared"),
        "c7_fixed_comparison": _with(FIXED_MODELS, "SELECT model, measure, value FROM (UNPIVOT (SELECT model, r2, rmse, mae FROM compared) "
                                     "ON r2, rmse, mae INTO NAME measure VALUE value)"),
        "m10_importance_shares": _with(SHARES, "SELECT feature, importance, importance_pct FROM features"),
        "m13_region_index_train": _with(VALUED + _engineered("valued", f"NOT ({_TEST})"), _region_index()),
        "m13_region_index_all": _with(ENGINEERED, _region_index()),
    }


def _region_index() -> str:
    regions = ", ".join(f"({_q(r)})" for r in fv.REGIONS)
    return f"SELECT coalesce(d.col0, r.region) AS region, region_price_index FROM (VALUES {regions}) d FULL JOIN region_index r ON r.region = d.col0"
