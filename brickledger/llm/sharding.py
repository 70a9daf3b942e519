"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in source blocks. How many rows each block sends to each target is
drawn first, from the multivariate hypergeometric law a uniform shuffle obeys;
row sums are the block sizes, column sums the wanted target sizes. Each block
permutes its rows and cuts them by its matrix row, the rows are exchanged, and
each target permutes what it got. Every arrangement is equally likely, and sizes
are exact without a global sort. A shard consists of several targets, so neither
step puts a shard into one task. Blocks and targets grow with the counted rows,
so that tasks keep their size, up to a matrix the driver can draw and broadcast.
Only DataFrame functions run on the rows; the driver sees block counts and the
matrix, both bounded by parameters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

#: Least source blocks, and targets a shard; powers of two, as is every larger number of them.
BLOCKS = 512
PARTS = 16
#: Rows a block or target should hold at most, while the matrix stays within its limits.
TASK_ROWS = 4_000_000
#: Most source blocks, and most targets of all shards together beyond ``PARTS`` a shard: bounds the matrix.
MOST_BLOCKS = 2048
MOST_TARGETS = 1024
SEED = 20_261


def even_sizes(total: int, parts: int) -> list[int]:
    """``total`` cut into ``parts`` sizes that differ by one at most, larger ones first."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw; beyond the generator's range of 10^9 by inverting the law around its mode."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total, low, high = good + bad, max(0, draws - bad), min(draws, good)
    share = draws / total
    spread = int(10 * np.sqrt(good * share * (1 - share) * (bad / total)) + 50)
    mode = int((draws + 1) * (good + 1) / (total + 2))
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    steps = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(weights - weights.max()))
    return int(k[min(np.searchsorted(chances, rng.random() * chances[-1], side="right"), len(k) - 1)])


def communication_matrix(block_sizes: list[int], target_sizes: list[int], seed: int) -> list[list[int]]:
    """Counts of rows from each block to each target; both margins hold exactly."""
    if sum(block_sizes) != sum(target_sizes):
        raise ValueError("block and target sizes must have the same sum")
    rng = np.random.default_rng(seed)
    left = list(target_sizes)
    matrix = []
    for size in block_sizes:
        rest, draws, row = sum(left), size, []
        for room in left:
            rest -= room
            row.append(hypergeometric(rng, room, rest, draws))
            draws -= row[-1]
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def _doubled(least: int, most: int, wanted: int) -> int:
    """``least``, doubled while it is below ``wanted`` and does not pass ``most``."""
    while least < wanted and 2 * least <= most:
        least *= 2
    return least


def widths(rows: int, shards: int) -> tuple[int, int]:
    """Blocks, and targets a shard, for a number of rows.

    Beyond ``MOST_BLOCKS * TASK_ROWS`` rows blocks grow instead of multiplying; their sorts spill.
    """
    tasks = -(-rows // TASK_ROWS)
    return _doubled(BLOCKS, MOST_BLOCKS, tasks), _doubled(PARTS, max(PARTS, MOST_TARGETS // shards), -(-tasks // shards))


def _cut(starts: Column, rank: Column) -> Column:
    """Index of the last start that is not above the rank."""
    return F.size(F.filter(starts, lambda s: s <= rank)) - 1


def shard(df: DataFrame, keys: list[str], shards: int = 16, seed: int = SEED, blocks: int | None = None,
          parts: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 inside the shard).

    Shard sizes differ by one row at most, larger ones first. ``keys`` name the
    columns that tell rows apart; together with the seed they decide the result,
    whatever the partitioning; ``blocks`` and ``parts`` follow from the row count
    unless given. Rows equal in all keys are interchangeable: each
    gets a slot of its own. Nulls are values like any other. Fewer rows than
    shards leave the last shards empty, an empty table gives no rows. ``df``
    must not have columns named ``shard`` or ``slot``; names of its own with a
    leading ``__shard`` are reserved.
    """
    clash = {"shard", "slot", *(c for c in df.columns if c.startswith("__shard"))} & set(df.columns)
    if clash:
        raise ValueError(f"columns already present: {sorted(clash)}")
    spark = df.sparkSession
    names = [F.col(k) for k in keys]
    placed = F.xxhash64(F.lit(seed), *names)
    fine = blocks or MOST_BLOCKS
    counts = df.groupBy(F.pmod(placed, F.lit(fine)).cast("int").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    counted = {r["block"]: r["n"] for r in counts.collect()}
    found = widths(sum(counted.values()), shards)
    blocks, parts = blocks or found[0], parts or found[1]
    block = F.pmod(placed, F.lit(blocks)).cast("int")
    sizes = [sum(counted.get(b, 0) for b in range(first, fine, blocks)) for first in range(blocks)]
    per_shard = even_sizes(sum(sizes), shards)
    targets = [n for size in per_shard for n in even_sizes(size, parts)]
    cuts = []
    for b, row in enumerate(communication_matrix(sizes, targets, seed)):
        starts = np.concatenate([[0], np.cumsum(row)[:-1]]).tolist()
        cuts.append((b, [starts[s * parts] for s in range(shards)],
                     [starts[s * parts:(s + 1) * parts] for s in range(shards)]))
    # blocks x shards x parts numbers, whatever the input: safe to broadcast
    matrix = F.broadcast(spark.createDataFrame(
        cuts, "__shard_block int, __shard_starts array<bigint>, __shard_part_starts array<array<bigint>>"))
    local = Window.partitionBy("__shard_block").orderBy(F.xxhash64(F.lit(seed + 1), *names), *names)
    sent = (df.withColumn("__shard_block", block)
            .withColumn("__shard_rank", F.row_number().over(local) - 1)
            .join(matrix, "__shard_block")
            .withColumn("shard", _cut(F.col("__shard_starts"), F.col("__shard_rank")))
            .withColumn("__shard_part", _cut(F.element_at("__shard_part_starts", F.col("shard") + 1), F.col("__shard_rank")))
            .drop("__shard_block", "__shard_rank", "__shard_starts", "__shard_part_starts"))
    arrived = Window.partitionBy("shard", "__shard_part").orderBy(F.xxhash64(F.lit(seed + 2), *names), *names)
    n = F.lit(per_shard[0]) - (F.col("shard") >= F.lit(sum(sizes) % shards or shards)).cast("bigint")
    before = F.col("__shard_part") * F.expr(f"`__shard_n` div {parts}") + F.least(F.col("__shard_part"), F.col("__shard_n") % parts)
    return (sent.withColumn("__shard_n", n.cast("bigint"))
            .withColumn("slot", (before + F.row_number().over(arrived) - 1).cast("bigint"))
            .drop("__shard_part", "__shard_n"))
