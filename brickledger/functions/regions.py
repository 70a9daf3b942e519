"""Fixed lookup tables for the region of a sale, and the text they are matched on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brickledger.functions import fixed_values as fv
from brickledger.functions.scalar import decode_sql, literal


def lookup_table(spark: SparkSession, columns: str, rows) -> DataFrame:
    """Fixed rows as a local relation: Spark knows its exact size."""
    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def place_region_sql(name: str) -> str:
    """Region of a county or district name; NULL where the name is not listed."""
    return decode_sql(name, fv.COUNTY_REGION)


def start_rank_sql(start: str) -> str:
    """Rank of the first region that lists a postcode start; NULL where none does."""
    first: dict[str, int] = {}
    for position, (_, starts) in enumerate(fv.POSTCODE_STARTS):
        for listed in starts:
            first.setdefault(listed, position)
    return decode_sql(start, first)


_WHITE = " \\t\\n\\u000B\\u000C\\r"  # what \s stands for in a pattern


def place_name_sql(column: str) -> str:
    """A place name as it is listed: upper case, no white space around it. Trimming takes a fraction of a pattern's time."""
    return f"upper(trim(BOTH '{_WHITE}' FROM {column}))"


def clean_name_sql(column: str) -> str:
    """Upper case without white space around it, tabs and line ends included."""
    return f"upper(regexp_replace({column}, '^\\\\s+|\\\\s+$', ''))"


def start_rank_region_sql(rank: str) -> str:
    # not element_at: over fixed values that is planned as never NULL
    names = ", ".join(literal(region) for region, _ in fv.POSTCODE_STARTS)
    return f"try_element_at(array({names}), {rank} + 1)"
