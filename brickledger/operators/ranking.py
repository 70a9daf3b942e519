"""Row numbers, exact-size samples and splits from key digests.

All of them order rows by a hex digest of the row key. The first four digits
cut the digest space into 65,536 even buckets, whose counts are small enough
to add up in one place; rows are then only ever ranked inside one bucket. No
step sorts or numbers the whole table in one task, and the outcome depends on
the keys alone, not on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brickledger.functions.scalar import digest

_BUCKET_DIGITS = 4


def _with_digest(df: DataFrame, key: str, salt) -> DataFrame:
    hexdigest = digest(F.col(key), salt)
    return df.withColumns({"_digest": hexdigest}).withColumn(
        "_bucket", F.substring("_digest", 1, _BUCKET_DIGITS)
    )


def _bucket_offsets(tagged: DataFrame, strata: list[str]) -> DataFrame:
    """Rows before each bucket; at most 65,536 rows per stratum."""
    counts = tagged.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))


def number_rows(df: DataFrame, key: str, salt="row", name: str = "row_number") -> DataFrame:
    """Dense 1..N numbering in digest order."""
    tagged = _with_digest(df, key, salt)
    offsets = _bucket_offsets(tagged, []).select("_bucket", "_before")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))
    # at most 65,536 offsets of two small fields
    return (
        tagged.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_before") + inside)
        .drop("_digest", "_bucket", "_before")
    )


def serial_id(df: DataFrame, key: str, name: str = "property_id") -> DataFrame:
    """``LR0000001``-style running identifiers."""
    numbered = number_rows(df, key, name="_number")
    return numbered.withColumn(name, F.format_string("LR%07d", "_number")).drop("_number")


def _first_in_buckets(tagged: DataFrame, strata: list[str], key: str, wanted: Column) -> DataFrame:
    """The first ``wanted`` rows in digest order of every stratum.

    ``edge`` holds one row per stratum: the bucket where the last wanted row
    falls and how many of its rows to take. One more pass ranks rows up to the
    edge inside their bucket and cuts the edge bucket; what it shuffles is the
    result and the rest of that bucket.
    """
    c = F.col
    placed = _bucket_offsets(tagged, strata).withColumns({
        "_through": c("_before") + c("_in_bucket"),
        "_size": F.sum("_in_bucket").over(Window.partitionBy(*strata)),
    }).withColumn("_wanted", F.least(wanted, c("_size")))
    edge = placed.where((c("_before") < c("_wanted")) & (c("_wanted") <= c("_through"))).select(
        *strata, c("_bucket").alias("_edge"), (c("_wanted") - c("_before")).alias("_take")
    )
    # one row without strata; else one per stratum, which Spark broadcasts while small
    joined = tagged.join(edge, strata) if strata else tagged.crossJoin(F.broadcast(edge))
    within = Window.partitionBy(*strata, "_bucket").orderBy("_digest", key)
    return (
        joined.where(c("_bucket") <= c("_edge"))
        .withColumn("_rank", F.row_number().over(within))
        .where((c("_bucket") < c("_edge")) | (c("_rank") <= c("_take")))
        .drop("_rank", "_edge", "_take", "_digest", "_bucket")
    )


def sample_exact(df: DataFrame, n: int, key: str, seed=42) -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer), chosen by seed.

    A plain top-k would send the best ``n`` rows of every scan task to one
    task, so the cut-off digest is located by counting instead.
    """
    return _first_in_buckets(_with_digest(df, key, seed), [], key, F.lit(n).cast("bigint"))


def _cut_rows(tagged: DataFrame, key: str, edges: Column) -> DataFrame:
    """One row: ``_cuts``, for each edge the (digest, key) of the first row behind it, in the order of the edges.

    ``edges`` is an array of row counts, rising, made from ``_size``. Buckets are
    counted; only the buckets that hold an edge are read again, digests and keys
    alone, and ranked. An edge at the very end has no row behind it.
    """
    c = F.col
    placed = _bucket_offsets(tagged, []).withColumn("_size", F.sum("_in_bucket").over(Window.partitionBy()))
    held = F.filter(F.transform(edges, lambda e, i: F.struct(i.alias("edge"), (e - c("_before")).alias("at"))),
                    lambda x: (x["at"] >= 0) & (x["at"] < c("_in_bucket")))
    # as many rows as there are edges at most
    wanted = placed.select("_bucket", held.alias("_held")).where(F.size("_held") > 0)
    inside = Window.partitionBy("_bucket").orderBy("_digest", key)
    ranked = tagged.select("_bucket", "_digest", key).join(F.broadcast(wanted), "_bucket").withColumn("_at", F.row_number().over(inside) - 1)
    cuts = ranked.select(F.explode(F.filter("_held", lambda x: x["at"] == c("_at"))).alias("_x"), "_digest", key).select(
        c("_x.edge").alias("edge"), F.struct("_digest", c(key).alias("_key")).alias("cut"))
    return cuts.agg(F.transform(F.array_sort(F.collect_list(F.struct("edge", "cut"))), lambda x: x["cut"]).alias("_cuts"))


def with_split(df: DataFrame, key: str = "property_id", test_fraction: float = 0.2, seed=42, name: str = "is_test",
               folds: int = 0, fold: str = "fold") -> DataFrame:
    """Seeded train/test flag of exact size: ``ceil(fraction * rows)`` rows are test rows.

    With ``folds`` the other rows get a fold number from 0 too, in folds whose
    sizes differ by one at most, larger ones first; test rows have none. Rows are
    in digest order of their keys, which must tell them apart; the parts are
    ranges of that order. Their ends are found by counting, so rows are flagged
    where they are: nothing but digests and keys of a few buckets is shuffled.
    """
    c = F.col
    tagged = _with_digest(df, key, f"split{seed}")
    tests = F.ceil(c("_size") * F.lit(test_fraction)).cast("bigint")
    rest = c("_size") - tests
    ends = [tests]
    for i in range(1, folds):
        # the first (rest mod folds) folds have one row more
        ends.append(tests + F.lit(i) * F.floor(rest / folds).cast("bigint") + F.least(F.lit(i).cast("bigint"), rest % folds))
    cuts = _cut_rows(tagged, key, F.array(*ends))
    placed = tagged.crossJoin(F.broadcast(cuts))  # one row
    # cuts rise, and (digest, key) pairs are in order with a NULL key first; plain comparisons, since a lambda over structs is interpreted row by row
    passed = []
    for i in range(len(ends)):
        cut = F.get("_cuts", F.lit(i))
        same = (cut["_digest"] == c("_digest")) & (cut["_key"].isNull() | F.coalesce(cut["_key"] <= c(key), F.lit(False)))
        passed.append(F.coalesce((cut["_digest"] < c("_digest")) | same, F.lit(False)).cast("int"))
    marked = placed.withColumn("_part", sum(passed[1:], passed[0])).withColumn(name, c("_part") == 0)
    if folds:
        marked = marked.withColumn(fold, F.when(c("_part") > 0, c("_part") - 1))
    return marked.drop("_digest", "_bucket", "_cuts", "_part")


def stratified_test(df: DataFrame, stratum: str, domain=None, key: str = "property_id", test_fraction: float = 0.2,
                    seed=42) -> DataFrame:
    """Test rows with exactly ``ceil(fraction * size)`` rows per stratum.

    Every value found is a stratum of its own, NULL included. With ``domain``
    only the listed ones are, and all others together form one more.
    """
    named = F.concat(F.lit("="), F.col(stratum).cast("string"))
    known = named if domain is None else F.when(F.col(stratum).isin(*domain), named)
    tagged = _with_digest(df, key, f"split{seed}").withColumn("_stratum", F.coalesce(known, F.lit("")))
    wanted = F.ceil(F.col("_size") * F.lit(test_fraction)).cast("bigint")
    return _first_in_buckets(tagged, ["_stratum"], key, wanted).drop("_stratum")
