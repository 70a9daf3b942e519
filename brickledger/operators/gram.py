"""All cross-products of a set of columns from one pass.

The columns and a constant 1 form a vector per row; the sum of each vector's
outer product with itself holds the row count, all sums and all sums of
products. Tasks multiply Arrow batches by themselves and add them up; entries are
summed over the tasks by a grouping, so the driver gets one matrix whose size
depends on the number of columns alone.
Means, variances, correlations and linear fits all follow from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Products:
    """Row count, means, and sums of products of deviations from the means, of ``columns`` in their order."""

    columns: tuple[str, ...]
    n: int
    means: np.ndarray
    centred: np.ndarray

    def at(self, *names: str) -> list[int]:
        return [self.columns.index(n) for n in names]

    def deviations(self) -> np.ndarray:
        """Population standard deviations."""
        return np.sqrt(np.maximum(np.diag(self.centred), 0) / max(self.n, 1))

    def squared_correlations(self, target: str) -> dict[str, float]:
        """Of every other column with the target; 0 where either does not vary."""
        t, own = self.at(target)[0], np.diag(self.centred)
        return {c: float(self.centred[i, t] ** 2 / (own[i] * own[t])) if own[i] > 0 and own[t] > 0 else 0.0
                for i, c in enumerate(self.columns) if i != t}


def products(table: DataFrame, columns: list[str]) -> Products:
    """Read the columns of ``table`` once; NULL counts as 0, as in the feature matrix.

    Values are taken from their distance to the first row's, which keeps products
    of deviations exact where values are large next to their spread. A column
    without variation has exact zeros. An empty table has n = 0.
    """
    values = table.select(*[F.expr(f"coalesce(CAST({c} AS DOUBLE), 0.0D)").alias(f"x{i}") for i, c in enumerate(columns)])
    first = values.first()
    k = len(columns)
    if first is None:
        return Products(tuple(columns), 0, np.zeros(k), np.zeros((k, k)))
    origin = np.array(first, float)

    def summed(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            moved = np.ones((batch.num_rows, k + 1))
            for i in range(k):
                moved[:, i + 1] = batch.column(i).to_numpy(zero_copy_only=False) - origin[i]
            total += moved.T @ moved
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "part"])

    entries = values.mapInArrow(summed, "at int, part double").groupBy("at").agg(F.sum("part").alias("total"))
    gram = np.zeros((k + 1) ** 2)
    for at, total in entries.collect():  # as many rows as the matrix has entries
        gram[at] = total
    gram = gram.reshape(k + 1, k + 1)
    n, sums = int(gram[0, 0]), gram[0, 1:]
    return Products(tuple(columns), n, origin + sums / n, gram[1:, 1:] - np.outer(sums, sums) / n)
