"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, given by its
weights at common knots and linear between them. The integral of a schedule is
the source's share of the token budget. Its cumulative demand is the running
integral, scaled to the source's target; a document that covers the words from
``a`` to ``b`` of its source, in a fixed shuffled order, is trained at the time
when that demand reaches the middle of the span. Later passes over a source
continue the same count. Sorting by time gives a stream that holds every source
at its scheduled weight at every moment.

The running count inside a source is built from bucket sums: a source of n rows
is cut into about sqrt(n) buckets of its shuffled order, so neither a bucket nor
the list of a source's buckets is large however hot the source is. Only
DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brickledger.llm.support import broadcast_if_small, stored

TIMES = (0.0, 0.5, 1.0)
#: Weights at the knots, dealt to the sources in turn: one falls, one is level, one rises. Integrals 3, 1 and 2.
SCHEDULES = ((6.0, 3.0, 0.0), (1.0, 1.0, 1.0), (0.0, 2.0, 4.0))
SHARE = 1.5
PASSES = 2
SEED = 20_263
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between blanks, tabs and line controls; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def running_integral(weights: tuple[float, ...], times: tuple[float, ...]) -> list[float]:
    """Integral of the schedule up to each knot."""
    if len(weights) != len(times) or list(times) != sorted(set(times)) or times[0] != 0 or times[-1] != 1 or min(weights) < 0:
        raise ValueError("a schedule needs a weight of 0 or more at each of its rising times from 0 to 1")
    sums = [0.0]
    for k in range(len(times) - 1):
        sums.append(sums[-1] + (times[k + 1] - times[k]) * (weights[k] + weights[k + 1]) / 2)
    if not sums[-1] > 0:
        raise ValueError("the weights of a schedule are all zero")
    return sums


def _dealt(lists: list, number: Column) -> Column:
    """The entry of ``lists`` that a source of this number gets, in turn."""
    entries = [F.array(*map(F.lit, x)) if isinstance(x, (list, tuple)) else F.lit(x) for x in lists]
    return F.element_at(F.array(*entries), (number % len(entries) + 1).cast("int"))


def source_targets(sizes: DataFrame, schedules=SCHEDULES, times=TIMES, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source of ``sizes`` (source, size): its number, rows, size, buckets and target.

    Sources are numbered by code point, null last. Targets are in proportion to
    the integrals, but stop at ``passes`` times the source's size; what that
    leaves over is shared among the others by weight until none is above. With
    sources sorted by the level at which they fill up, that is one common level,
    found from running sums. The windows run over one row a source.
    """
    integrals = [running_integral(w, times)[-1] for w in schedules]
    found = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    numbered = found.select(
        "*", (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1).alias("number"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"))
    weighed = numbered.withColumn("weight", _dealt(integrals, F.col("number"))).withColumn(
        "most", (F.col("source_size") * passes).cast("double"))
    filled = everything.orderBy(F.col("most") / F.col("weight"), "number")
    levels = weighed.select(
        "*", ((F.col("budget") - F.coalesce(F.sum("most").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
              / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))).alias("level"))
    # beyond the first source that does not fill up, levels only fall
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return levels.select(
        "source", "number", "source_size", F.greatest(F.lit(1), F.ceil(F.sqrt("n"))).cast("bigint").alias("buckets"),
        F.coalesce(F.least(F.col("most"), open_level * F.col("weight")), F.col("most")).alias("target"))


def time_of(demand: Column, target: Column, number: Column, schedules=SCHEDULES, times=TIMES) -> Column:
    """The time at which a source's cumulative demand reaches ``demand`` (0 up to its target, which is above 0)."""
    sums = [running_integral(w, times) for w in schedules]
    reached = demand / target * _dealt([s[-1] for s in sums], number)
    out = None
    for k in reversed(range(len(times) - 1)):
        start = _dealt([s[k] for s in sums], number)
        at, to = _dealt([float(w[k]) for w in schedules], number), _dealt([float(w[k + 1]) for w in schedules], number)
        rest, width = reached - start, times[k + 1] - times[k]
        slope = (to - at) / F.lit(width)
        # the root of at * x + slope * x^2 / 2 = rest, in the form that is exact for a level stretch
        root = rest * 2.0 / (at + F.sqrt(F.greatest(F.lit(0.0), at * at + slope * rest * 2.0)))
        when = F.lit(float(times[k])) + F.when(rest > 0, F.least(F.lit(width), root)).otherwise(0.0)
        out = when if out is None else F.when(reached < _dealt([s[k + 1] for s in sums], number), when).otherwise(out)
    return out


def place(df: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", schedules=SCHEDULES,
          times=TIMES, share: float = SHARE, passes: int = PASSES, seed: int = SEED, keep_rows: bool = False) -> DataFrame:
    """One row per row of ``df``: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``positions``, ``taken``.

    ``positions`` holds a training time for each pass that takes the row: it is
    taken whole when the middle of its span lies below the source's target, so a
    source's taken words differ from its target by at most half a document.
    ``taken`` is its size times the passes. The order inside a source is that of
    the SHA-256 of seed and id, so reruns agree whatever the partitioning; rows
    equal in id and size are interchangeable. ``size`` defaults to the words of
    column ``text``; null counts as 0. Rows of size 0 have no position. A null
    source is a source of its own, a null id is read as empty. An empty table
    gives no rows. Other columns are not read; with ``keep_rows`` the whole row
    comes along as struct ``row``, so its names cannot clash.
    """
    size = word_count(F.col("text")) if size is None else F.coalesce(size.cast("bigint"), F.lit(0))
    rows = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep_rows else []
    docs = stored(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
                            *rows), "mix-sizes")
    extra = ["row"] if keep_rows else []
    sources = stored(source_targets(docs, schedules, times, share, passes), "mix-sources")
    known = broadcast_if_small(sources.withColumnRenamed("source", "of"), F.lit(64) + F.coalesce(F.octet_length("of"), F.lit(0)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    keyed = (docs.join(known, F.col("source").eqNullSafe(F.col("of"))).withColumn("digest", digest)
             .withColumn("bucket", F.floor(drawn * F.col("buckets")).cast("bigint")))
    sums = keyed.groupBy("number", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("number", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("number", "bucket").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    counted = keyed.join(offsets, ["number", "bucket"]).withColumn(
        "start", F.col("offset") + F.sum("size").over(inside) - F.col("size"))

    def at(turn: Column) -> Column:
        return F.col("start") + turn * F.col("source_size") + F.col("size") / 2.0

    turns = F.filter(F.array(*[F.lit(k).cast("bigint") for k in range(passes)]),
                     lambda k: (F.col("size") > 0) & (at(k) < F.col("target")))
    return counted.select(
        "id", "source", "size", "source_size", "target",
        F.transform(turns, lambda k: time_of(at(k), F.col("target"), F.col("number"), schedules, times)).alias("positions"),
        (F.size(turns) * F.col("size")).cast("bigint").alias("taken"), *extra)


def training_order(df: DataFrame, **options) -> DataFrame:
    """The mixed corpus: ``row`` (all columns of ``df``), ``copy`` (0 at its first pass) and ``position``, range-sorted by position."""
    placed = place(df, keep_rows=True, **options)
    copies = placed.select("id", "row", F.posexplode("positions").alias("copy", "position"))
    keys = [F.col("position"), F.col("id"), F.col("copy")]
    return copies.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", "copy", "position")
