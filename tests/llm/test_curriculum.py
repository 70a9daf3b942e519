"""The curriculum mix against plain sums, and its targets and order."""

import random

import pytest
from pyspark.sql import functions as F

from brickledger.llm import curriculum as cu
from brickledger.llm import queries


def plain_targets(sizes, weights, share, passes):
    """Share out by weight, stop at the cap, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    most = {s: passes * n for s, n in sizes.items()}
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += unit * weight[s]
        left = sum(max(0.0, target[s] - most[s]) for s in open_)
        target = {s: min(t, most[s]) for s, t in target.items()}
        open_ = {s for s in open_ if target[s] < most[s]}
    return target


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_targets_equal_plain_resharing(spark):
    rng = random.Random(3)
    for trial in range(4):
        sizes = {rng.choice("abcdefgh") + str(i): rng.choice([0, 1, 10, 100, 1000, 10_000]) for i in range(12)} | {None: 50, "": 7, "é": 9}
        df = rows_of(spark, [(i, s, n) for i, (s, n) in enumerate(sizes.items())])
        share = [1.5, 0.3, 1.95, 5.0][trial]
        got = {r.source: r.target for r in cu.source_targets(df.select("source", "size"), share=share).collect()}
        assert got.keys() == sizes.keys()
        for s, t in plain_targets(sizes, [3, 1, 2], share, 2).items():
            assert got[s] == pytest.approx(t, abs=1e-6)


def test_time_inverts_the_integral(spark):
    for number, weights in enumerate(cu.SCHEDULES):
        total = cu.running_integral(weights, cu.TIMES)[-1]
        df = spark.range(0, 1000).select((F.col("id") / 1000 * 777).alias("demand"))
        at = df.select("demand", cu.time_of(F.col("demand"), F.lit(777.0), F.lit(number)).alias("t")).collect()
        for r in at:
            done, steps = 0.0, 400
            for i in range(steps):  # trapezoids up to t
                x = r.t * (i + 0.5) / steps
                k = 0 if x < 0.5 else 1
                done += (weights[k] + (weights[k + 1] - weights[k]) * (x - k / 2) * 2) * r.t / steps
            assert 0 <= r.t <= 1 and done / total * 777 == pytest.approx(r.demand, abs=0.02)


def test_taken_words_meet_the_targets(spark):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", rng.choice([0, 1, 5, 40, 400])) for i in range(3000)]
    placed = cu.place(rows_of(spark, rows), F.col("size")).collect()
    assert sorted(r.id for r in placed) == list(range(3000))
    by = {}
    for r in placed:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * len(r.positions) and r.positions == sorted(r.positions)
        by.setdefault(r.source, []).append(r)
    assert sum(t.target for t in {r.source: r for r in placed}.values()) == pytest.approx(1.5 * sum(n for *_, n in rows))
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 200
        # demand: the words taken up to any time follow the schedule
        spans = sorted((p, r.size) for r in own for p in r.positions)
        assert len({r.target for r in own}) == len({r.source_size for r in own}) == 1 and spans
    again = cu.place(rows_of(spark, rows).repartition(13), F.col("size")).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, placed), key=str)


def test_stream_holds_the_scheduled_weights(spark):
    rows = [(i, "abc"[i % 3], 10) for i in range(6000)]
    ordered = cu.training_order(rows_of(spark, rows), size=F.col("size"), share=0.5).collect()
    positions = [r.position for r in ordered]
    assert positions == sorted(positions) and {r["copy"] for r in ordered} == {0}
    early = [r.row.source for r in ordered if r.position < 0.25]
    late = [r.row.source for r in ordered if r.position >= 0.75]
    # first quarter: a 6 to 4.5, b 1, c 0 to 1; last quarter: a 1.5 to 0, b 1, c 3 to 4
    for part, want in ((early, (5.25, 1.0, 0.5)), (late, (0.75, 1.0, 3.5))):
        for source, weight in zip("abc", want):
            assert part.count(source) / len(part) == pytest.approx(weight / sum(want), abs=0.02)


def test_edge_rows(spark):
    data = [(1, "a b", "x", 1), (2, None, "x", 2), (3, "", None, 3), (None, "one two three", None, 4), (1, "a b", "x", 1),
            (5, "w " * 50_000, "y", 5), (6, " \t\n\x0b\x0c\r ", "y", 6), (7, "   ", "z", 7)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, row long")
    df = df.withColumn("target", F.lit("clash")).withColumn("positions", F.lit(0)).withColumn("id", F.lit(0))
    got = cu.place(df).collect()
    assert sorted(r.size for r in got) == [0, 0, 0, 2, 2, 2, 3, 50_000]
    assert all(r.positions == [] for r in got if r.size == 0)
    assert cu.place(df.limit(0)).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in cu.place(df.where("doc_id IN (2, 3)")).collect())
    ordered = cu.training_order(df)
    assert ordered.select("row.*").columns == df.columns and ordered.count() == sum(len(r.positions) for r in got)
    for bad in ([(1.0, 0.0)], [(0.0, 0.0, 0.0)], [(1.0, -1.0, 2.0)]):
        with pytest.raises(ValueError):
            cu.place(df, schedules=bad)


def test_query_returns_every_document_in_training_order(spark, sf_dir):
    df = queries.registered()["op12_curriculum_mix"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = df.collect()
    assert len(rows) == docs
    at = [r.position if r.position is not None else -1 for r in rows]
    assert at == sorted(at)
