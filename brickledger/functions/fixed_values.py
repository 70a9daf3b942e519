"""Codes, names and figures that decide the results."""

# ---- Fixed values: transaction file codes ------------------------------------
TYPE_LABELS = {"D": "Detached", "S": "Semi-Detached", "T": "Terraced", "F": "Flat", "O": "Other"}
RESIDENTIAL_CODES = ("D", "S", "T", "F")
TENURE_LABELS = {"F": "Freehold", "L": "Leasehold", "U": "Unknown"}
STANDARD_CATEGORY = "A"
PRICE_FLOOR, PRICE_CEILING = 10_000, 5_000_000
UNRESOLVED_REGION = "Other"

# ---- Fixed values: region of each county or district -------------------------
COUNTY_REGION = {
    "GREATER LONDON": "London - Inner",
    "CITY OF LONDON": "London - Inner",
    "CITY OF WESTMINSTER": "London - Inner",
    "KENSINGTON AND CHELSEA": "London - Inner",
    "TOWER HAMLETS": "London - Inner",
    "HACKNEY": "London - Inner",
    "ISLINGTON": "London - Inner",
    "CAMDEN": "London - Inner",
    "LAMBETH": "London - Inner",
    "SOUTHWARK": "London - Inner",
    "WANDSWORTH": "London - Outer",
    "BARNET": "London - Outer",
    "CROYDON": "London - Outer",
    "BROMLEY": "London - Outer",
    "ENFIELD": "London - Outer",
    "HAVERING": "London - Outer",
    "REDBRIDGE": "London - Outer",
    "BEXLEY": "London - Outer",
    "SURREY": "South East",
    "KENT": "South East",
    "EAST SUSSEX": "South East",
    "WEST SUSSEX": "South East",
    "HAMPSHIRE": "South East",
    "BERKSHIRE": "South East",
    "BUCKINGHAMSHIRE": "South East",
    "OXFORDSHIRE": "South East",
    "HERTFORDSHIRE": "East of England",
    "ESSEX": "East of England",
    "SUFFOLK": "East of England",
    "NORFOLK": "East of England",
    "CAMBRIDGESHIRE": "East of England",
    "BEDFORDSHIRE": "East of England",
    "GLOUCESTERSHIRE": "South West",
    "SOMERSET": "South West",
    "DEVON": "South West",
    "CORNWALL": "South West",
    "DORSET": "South West",
    "WILTSHIRE": "South West",
    "BRISTOL": "South West",
    "NOTTINGHAMSHIRE": "East Midlands",
    "DERBYSHIRE": "East Midlands",
    "LEICESTERSHIRE": "East Midlands",
    "NORTHAMPTONSHIRE": "East Midlands",
    "LINCOLNSHIRE": "East Midlands",
    "WARWICKSHIRE": "West Midlands",
    "STAFFORDSHIRE": "West Midlands",
    "WEST MIDLANDS": "West Midlands",
    "WORCESTERSHIRE": "West Midlands",
    "SHROPSHIRE": "West Midlands",
    "WEST YORKSHIRE": "Yorkshire & Humber",
    "SOUTH YORKSHIRE": "Yorkshire & Humber",
    "NORTH YORKSHIRE": "Yorkshire & Humber",
    "EAST RIDING OF YORKSHIRE": "Yorkshire & Humber",
    "CITY OF KINGSTON UPON HULL": "Yorkshire & Humber",
    "GREATER MANCHESTER": "North West",
    "LANCASHIRE": "North West",
    "MERSEYSIDE": "North West",
    "CHESHIRE": "North West",
    "CUMBRIA": "North West",
    "TYNE AND WEAR": "North East",
    "COUNTY DURHAM": "North East",
    "NORTHUMBERLAND": "North East",
    "CLEVELAND": "North East",
    "CARDIFF": "Wales",
    "SWANSEA": "Wales",
    "NEWPORT": "Wales",
    "FLINTSHIRE": "Wales",
    "GWYNEDD": "Wales",
    "CONWY": "Wales",
    "PEMBROKESHIRE": "Wales",
    "CEREDIGION": "Wales",
    "POWYS": "Wales",
    "CARMARTHENSHIRE": "Wales",
}

# ---- Fixed values: postcode starts per region, tried from top to bottom ------
POSTCODE_STARTS = (
    ("London - Inner", ("EC", "WC", "W1", "W2", "W8", "W9", "SW1", "SW3", "SW5", "SE1")),
    ("London - Outer", ("E", "N", "SE", "SW", "W", "NW", "IG", "RM", "DA", "BR", "CR", "SM",
                        "KT", "TW", "UB", "HA", "EN")),
    ("South East", ("GU", "RH", "TN", "CT", "ME", "SO", "PO", "BN", "SL", "HP", "AL", "OX", "RG")),
    ("East of England", ("CB", "PE", "IP", "NR", "CO", "CM", "SS", "LU", "SG", "MK")),
    ("South West", ("BS", "BA", "TA", "EX", "TQ", "PL", "TR", "GL", "SP", "BH")),
    ("East Midlands", ("NG", "DE", "LE", "NN", "LN")),
    ("West Midlands", ("B", "WV", "WS", "DY", "ST", "WR", "HR", "CV")),
    ("Yorkshire & Humber", ("LS", "BD", "HX", "HD", "WF", "S", "DN", "YO", "HU")),
    ("North West", ("M", "SK", "OL", "BL", "WN", "WA", "PR", "BB", "LA", "CH", "CW")),
    ("North East", ("NE", "SR", "DH", "TS", "DL")),
    ("Wales", ("CF", "SA", "NP", "LL", "SY", "LD")),
    ("Scotland", ("EH", "G", "PA", "KA", "FK", "PH", "DD", "AB", "IV", "KY", "ML", "TD")),
)

# ---- Fixed values: regions, in published order -------------------------------
REGIONS = (
    "London - Inner", "London - Outer", "South East", "East of England", "South West",
    "East Midlands", "West Midlands", "Yorkshire & Humber", "North West", "North East",
    "Wales", "Scotland",
)
DENSITY = {
    "London - Inner": "urban", "London - Outer": "urban",
    "South East": "suburban", "East of England": "suburban", "South West": "suburban",
    "East Midlands": "mixed", "West Midlands": "mixed", "Yorkshire & Humber": "mixed",
    "North West": "mixed", "North East": "mixed", "Wales": "mixed", "Scotland": "mixed",
}

# ---- Fixed values: house price index, average price per region and year ------
HPI_YEARS = (2019, 2020, 2021, 2022, 2023, 2024)
HPI_AVERAGE = {
    2019: (523206, 412000, 325000, 290000, 261000, 197000, 210000, 174000, 183000, 130000, 171000, 158000),
    2020: (516000, 420000, 340000, 307000, 278000, 210000, 224000, 185000, 196000, 137000, 184000, 167000),
    2021: (524000, 456000, 375000, 336000, 312000, 236000, 252000, 207000, 218000, 152000, 206000, 181000),
    2022: (534000, 476000, 395000, 354000, 330000, 249000, 265000, 219000, 231000, 160000, 220000, 190000),
    2023: (503000, 453000, 378000, 338000, 319000, 238000, 254000, 208000, 222000, 155000, 213000, 185000),
    2024: (511000, 460000, 383000, 344000, 324000, 242000, 259000, 213000, 228000, 159000, 218000, 189000),
}
HPI_CHANGE_2024_PCT = (1.6, 1.5, 1.3, 1.8, 1.6, 1.7, 1.9, 2.4, 2.7, 2.5, 2.3, 2.1)

# ---- Fixed values: school inspection outcomes per region, percent ------------
SCHOOL_BANDS = ("Outstanding", "Good", "Requires Improvement", "Inadequate")
SCHOOL_SHARES = {
    "Outstanding": (31, 28, 23, 21, 20, 19, 21, 18, 20, 17, 15, 22),
    "Good": (49, 50, 48, 49, 50, 48, 47, 47, 48, 48, 52, 50),
    "Requires Improvement": (16, 17, 22, 23, 23, 25, 24, 27, 25, 27, 26, 22),
    "Inadequate": (4, 5, 7, 7, 7, 8, 8, 8, 7, 8, 7, 6),
}

# ---- Fixed values: category orders and scores --------------------------------
PROPERTY_TYPES = ("Detached", "Semi-Detached", "Terraced", "Flat")
EPC_BANDS = ("A", "B", "C", "D", "E", "F", "G")
EPC_SCORE = {"A": 6, "B": 5, "C": 4, "D": 3, "E": 2, "F": 1, "G": 0}
SCHOOL_SCORE = {"Outstanding": 3, "Good": 2, "Requires Improvement": 1, "Inadequate": 0}
CONDITION_SCORE = {"New Build": 4, "Excellent": 3, "Good": 2, "Fair": 1, "Poor": 0}
FLOOD_SCORE = {"Low": 0, "Medium": 1, "High": 2}
AGE_BAND_SCORE = {"Pre-1900": 0, "1900-1945": 1, "1945-1975": 2, "1975-2000": 3,
                  "2000-2015": 4, "Post-2015": 5}
# first build year that no longer belongs to the band
AGE_BAND_END = (("Pre-1900", 1900), ("1900-1945", 1945), ("1945-1975", 1975),
                ("1975-2000", 2000), ("2000-2015", 2015), ("Post-2015", None))

# ---- Fixed values: valuation rule --------------------------------------------
BASE_PRICE = {
    "London - Inner": 780_000, "London - Outer": 520_000, "South East": 420_000,
    "East of England": 370_000, "South West": 330_000, "East Midlands": 240_000,
    "West Midlands": 255_000, "Yorkshire & Humber": 210_000, "North West": 225_000,
    "North East": 165_000, "Wales": 210_000, "Scotland": 195_000,
}
YEARLY_GROWTH = {
    "London - Inner": 0.048, "London - Outer": 0.042, "South East": 0.035,
    "East of England": 0.033, "South West": 0.031, "East Midlands": 0.028,
    "West Midlands": 0.027, "Yorkshire & Humber": 0.025, "North West": 0.026,
    "North East": 0.020, "Wales": 0.029, "Scotland": 0.024,
}
BASE_YEAR = 2019
YEAR_FACTOR = {2019: 1.00, 2020: 0.97, 2021: 1.09, 2022: 1.12, 2023: 0.98, 2024: 1.01}
TYPE_FACTOR = {"Detached": 1.55, "Semi-Detached": 1.10, "Terraced": 0.90, "Flat": 0.75}
TENURE_FACTOR = {"Freehold": 1.05, "Leasehold": 0.95}
CONDITION_FACTOR = {"New Build": 1.12, "Excellent": 1.06, "Good": 1.00, "Fair": 0.91, "Poor": 0.80}
EPC_FACTOR = {"A": 1.06, "B": 1.04, "C": 1.02, "D": 1.00, "E": 0.97, "F": 0.94, "G": 0.90}
SCHOOL_FACTOR = {"Outstanding": 1.08, "Good": 1.02, "Requires Improvement": 0.97, "Inadequate": 0.92}
FLOOD_FACTOR = {"Low": 1.00, "Medium": 0.97, "High": 0.92}

# ---- Fixed values: model features, in training order -------------------------
FEATURES = (
    "bedrooms", "bathrooms", "floor_area_sqm", "log_floor_area",
    "property_age", "epc_score", "school_score", "condition_score",
    "flood_score", "age_band_score",
    "has_garden", "has_parking", "has_garage", "is_freehold",
    "commute_mins", "dist_to_station_km", "dist_to_centre_km",
    "log_dist_centre", "log_dist_station",
    "crime_index",
    "type_detached", "type_semi_detached", "type_terraced", "type_flat",
    "region_price_index",
    "bed_area", "school_x_density", "commute_x_urban", "age_x_condition",
    "epc_x_age", "bath_bed_ratio", "area_per_bed",
    "amenity_score", "location_score",
    "years_from_2019",
)

# ---- Fixed values: report bands ----------------------------------------------
COMMUTE_BANDS = ((15, "0–15 min"), (30, "16–30 min"), (45, "31–45 min"),
                 (60, "46–60 min"), (75, "61–75 min"))
COMMUTE_BAND_ABOVE = "75+ min"
COMMUTE_CUTS = ((0, 15, "0–15"), (15, 30, "16–30"), (30, 45, "31–45"),
                (45, 60, "46–60"), (60, 75, "61–75"), (75, 120, "75+"))
ACCURACY_BANDS = ((8, "Excellent (<8%)"), (12, "Good (8–12%)"), (18, "Fair (12–18%)"))
ACCURACY_BAND_ABOVE = "Needs improvement (>18%)"
ERROR_BANDS = ((5, "Within ±5%"), (10, "Within ±10%"), (20, "Within ±20%"))
ERROR_BAND_OVER, ERROR_BAND_UNDER = "Overestimate >20%", "Underestimate >20%"
IMPORTANCE_BANDS = ((20, "Critical"), (10, "High"), (5, "Medium"), (1, "Low"))
IMPORTANCE_BAND_BELOW = "Minimal"
HISTOGRAM_CAP_GBP, HISTOGRAM_BINS = 800_000, 60
