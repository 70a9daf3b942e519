"""Exact distribution statistics that hold up on very large groups.

A percentile aggregate keeps every distinct value of a group in one task, and
each scan task ships its own copy of that map there. So the rows are first
counted per (group, value): that step combines map-side and spreads over all
reducers, hot groups included. Two ways lead on from the counts:

* ``quantile`` weighs each value by its count in one aggregate. It keeps a map
  of a group's values, which is fine for prices: whole pounds inside fixed limits.
* ``percentiles`` selects by rank and takes values of any range: it adds up the
  counts of value bands, finds the bands that hold the wanted ranks, and
  descends only into those. No task holds more than a band.

Both give the exact interpolated percentiles. Variances come from moments
(count, mean, sum of squared deviations) that are merged pairwise, so they lose
no digits however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from brickledger.functions.scalar import ratio

PRICE = "price_gbp"
#: Bands per doubling of the value: a band spans at most 0.07% of its value.
BANDS_PER_DOUBLING = 1024


def price_counts(df: DataFrame, keys: Iterable[str], value: str = PRICE, also: Iterable[str] = ()) -> DataFrame:
    """One row per (keys, value): ``n`` rows, and sum and count of each ``also`` column."""
    extra = [a for c in also for a in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def rows() -> Column:
    return F.sum("n")


def _known(value: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.col("n"))


def total(value: str = PRICE) -> Column:
    """Exact sum of the value over the counted rows, as a double."""
    return F.sum(F.col(value).cast("decimal(20,0)") * F.col("n")).cast("double")


def mean(value: str = PRICE) -> Column:
    return ratio(total(value), F.sum(_known(value)))


def mean_of(column: str) -> Column:
    """Mean of a column carried through ``price_counts(also=...)``."""
    return ratio(F.sum(f"sum_{column}"), F.sum(f"n_{column}"))


def quantile(p: float, value: str = PRICE) -> Column:
    return F.percentile(F.col(value), p, F.col("n"))


def quantiles(ps: list[float], value: str = PRICE) -> Column:
    return F.percentile(F.col(value), ps, F.col("n"))


def shared(counted: DataFrame) -> DataFrame:
    """The same counts, for plans that use them more than once.

    A condition that holds for every row asks for every count and sum, so no use
    is planned with fewer columns than another, and all read one shuffle.
    """
    held = F.lit(True)
    for name in counted.columns:
        if name == "n" or name.startswith(("n_", "sum_")):
            held = held & (F.col(name).isNull() | (F.col(name).cast("double") >= F.lit(float("-inf"))))
    return counted.where(held)


def _same(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Equality of the keys, NULL being a key like any other; no keys are always equal."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_{k}"])
    return out


def band(value: Column) -> Column:
    """Number of the value's band; bands are in the order of the values and narrow in proportion to them."""
    size = value.cast("double")
    return F.signum(size).cast("int") * F.floor(F.log2(F.abs(size) + 1) * BANDS_PER_DOUBLING).cast("int")


def percentiles(counted: DataFrame, keys: list[str], ps: list[float], value: str = PRICE, name: str = "percentiles") -> DataFrame:
    """Exact interpolated percentiles of each group, as an array column, from counts per (keys, value).

    The first step adds up counts per group and band (64 thousand bands to
    either side of zero at most, whatever the values) and marks the bands that
    hold a wanted rank. The second reads only those bands' counts, a band being
    a window of its own. ``counted`` has columns ``keys``, ``value`` (whole
    numbers) and ``n``; NULL values do not count, and a group without any value
    gives no row (without keys: a NULL). NULLs are set aside by their counts and not by a filter on the
    value, which would reach the scan and keep the two steps from sharing it.
    """
    c = F.col
    known = counted.select(*keys, c(value).alias("_value"), "n", band(c(value)).alias("_band"))
    bands = known.groupBy(*keys, "_band").agg(F.sum(F.when(c("_value").isNotNull(), c("n"))).alias("_held")).where("_held > 0")
    in_order = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bands.select(
        *keys, "_band", (F.sum("_held").over(in_order) - c("_held")).alias("_before"), "_held",
        F.sum("_held").over(Window.partitionBy(*keys)).alias("_size"))
    # position of each percentile among ranks 0 to size - 1
    at = F.transform(F.array(*map(F.lit, ps)), lambda p: p * (c("_size") - 1))
    ranks = F.array_distinct(F.flatten(F.array(F.transform(at, lambda x: F.floor(x).cast("bigint")), F.transform(at, lambda x: F.ceil(x).cast("bigint")))))
    inside = F.filter(ranks, lambda r: (r >= c("_before")) & (r < c("_before") + c("_held")))
    wanted = placed.select(*[c(k).alias(f"_{k}") for k in keys], c("_band").alias("_in"), "_before", inside.alias("_ranks"), at.alias("_at")).where(
        F.size("_ranks") > 0)
    chosen = known.join(wanted, _same(known, wanted, keys) & known["_band"].eqNullSafe(wanted["_in"]))
    up_to = Window.partitionBy(*keys, "_band").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = chosen.withColumn("_through", c("_before") + F.sum("n").over(up_to))
    found = through.select(*keys, "_value", "_at", F.explode(F.filter(
        "_ranks", lambda r: (r < c("_through")) & (r >= c("_through") - c("n")))).alias("_rank"))
    # a row per group and rank: two for each percentile at most
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_by"), F.first("_at").alias("_at"))

    def interpolated(x: Column) -> Column:
        low, high = F.floor(x).cast("bigint"), F.ceil(x).cast("bigint")
        below, above = F.try_element_at(c("_by"), low).cast("double"), F.try_element_at(c("_by"), high).cast("double")
        return F.when(below == above, below).otherwise((high - x) * below + (x - low) * above)

    return by_rank.select(*keys, F.transform("_at", interpolated).alias(name))


def moment_states(counted: DataFrame, keys: list[str], value: str = PRICE) -> DataFrame:
    """Moments (``n``, ``mean``, ``m2``) of each group's bands, from counts per (keys, value).

    Inside a band, values are summed as distances from the whole number at the
    band's edge. The sums are whole numbers of 38 digits, subtracted before
    anything is rounded, so a tight group of many rows keeps its deviation;
    beyond 38 digits doubles take over.
    """
    c = F.col
    number = band(c(value))
    edge = (F.signum(number) * F.floor(F.pow(F.lit(2.0), F.abs(number) / F.lit(float(BANDS_PER_DOUBLING))) - 1)).cast("bigint")
    known = counted.select(*keys, F.when(c(value).isNotNull(), c("n").cast("bigint")).alias("n"), number.alias("_band"), edge.alias("_edge"),
                           (c(value).cast("bigint") - edge).alias("_off"))
    wide = known.withColumn("_times", F.try_multiply(c("_off").cast("decimal(19,0)"), c("n").cast("decimal(19,0)"))).withColumn(
        "_square", F.try_multiply(c("_times"), c("_off").cast("decimal(19,0)")))
    sums = wide.groupBy(*keys, "_band", "_edge").agg(
        F.sum("n").alias("n"), F.min("_off").alias("_low"), F.max("_off").alias("_high"),
        F.when(F.count("_square") == F.count("n"), F.try_sum("_times")).alias("_sum"),
        F.when(F.count("_square") == F.count("n"), F.try_sum("_square")).alias("_squares"),
        F.sum(c("_off").cast("double") * c("n")).alias("_sum_d"),
        F.sum(c("_off").cast("double") * c("_off").cast("double") * c("n")).alias("_squares_d")).where("n > 0")
    # sum = whole * n + rest, so sum^2 / n = n * whole^2 + 2 * whole * rest + rest^2 / n
    parted = sums.withColumn("_n", c("n").cast("decimal(19,0)")).withColumn("_whole", F.expr("CAST(`_sum` div `_n` AS DECIMAL(19,0))")).withColumn(
        "_rest", F.expr("try_subtract(`_sum`, `_whole` * `_n`)"))
    exact = F.expr("CAST(try_subtract(try_subtract(`_squares`, try_multiply(try_multiply(`_whole`, `_whole`), `_n`)), "
                   "try_multiply(`_whole` * 2, `_rest`)) AS DOUBLE) - CAST(`_rest` AS DOUBLE) * CAST(`_rest` AS DOUBLE) / n")
    rough = c("_squares_d") - c("_sum_d") * c("_sum_d") / c("n")
    return parted.select(*keys, "n", (c("_edge") + F.coalesce(c("_whole").cast("double") + c("_rest").cast("double") / c("n"), c("_sum_d") / c("n"))).alias("mean"),
                         F.when(c("_low") == c("_high"), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(exact, rough))).alias("m2"))


def merge_moments(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state per group out of any number of states of disjoint rows, merged one by one.

    Two states join to n = n1 + n2, mean = mean1 + d * n2 / n and
    m2 = m2_1 + m2_2 + d^2 * n1 * n2 / n, where d = mean2 - mean1. ``states`` may
    come from ``moment_states``, from a stored table, or from an earlier merge; a
    group's states must be few (bands, years), as they meet in one array.
    """
    def merged(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + apart * (b["n"] / n)).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * (b["n"] / n)).alias("m2"))

    entries = F.array_sort(F.collect_list(F.struct(F.col("n").cast("bigint").alias("n"), F.col("mean").cast("double").alias("mean"),
                                                   F.col("m2").cast("double").alias("m2"))))
    # the first state starts the merge; the order is that of the states, so reruns agree to the last digit
    one = F.aggregate(F.slice("_states", 2, F.size("_states")), F.get("_states", F.lit(0)), merged)
    return states.groupBy(*keys).agg(entries.alias("_states")).select(*keys, one.alias("_s")).select(*keys, "_s.*")


def deviation_of(n: Column, m2: Column) -> Column:
    """Sample deviation from a state; one row has none."""
    return F.sqrt(m2 / F.nullif(n.cast("double") - 1, F.lit(0.0)))


def stddev_by(counted: DataFrame, keys: list[str], value: str = PRICE, name: str = "stddev") -> DataFrame:
    """Sample standard deviation per group, from counts per (keys, value); a group without values gives no row."""
    merged = merge_moments(moment_states(counted, keys, value), keys)
    return merged.select(*keys, deviation_of(F.col("n"), F.col("m2")).alias(name))


def median_by(df: DataFrame, keys: list[str], value: str = PRICE, name: str = "median_price") -> DataFrame:
    return price_counts(df, keys, value).groupBy(*keys).agg(quantile(0.5, value).alias(name))


def segment_counts(df: DataFrame, segments: Mapping[str, Column], value: str = PRICE) -> DataFrame:
    """Counts per (dimension, segment, value) for several dimensions in one scan.

    A NULL segment drops out before the shuffle, so a dimension that only needs
    some of its values costs nothing for the rest.
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("dimension"), segment.cast("string").alias("segment"))
        for name, segment in segments.items()
    ])
    return (
        df.select(F.explode(pairs).alias("s"), F.col(value))
        .select("s.dimension", "s.segment", value)
        .where(F.col("segment").isNotNull())
        .groupBy("dimension", "segment", value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def segment_medians(df: DataFrame, segments: Mapping[str, Column], value: str = PRICE) -> DataFrame:
    """(dimension, segment, rows, median) over all dimensions."""
    return (
        segment_counts(df, segments, value)
        .groupBy("dimension", "segment")
        .agg(rows().alias("transactions"), quantile(0.5, value).alias("median_price"))
    )
