"""Headline timings: one JSON line.

The property table is built once and stored, as every analysis and model starts
from it; that step is timed as ``build_properties``. Queries are then timed to
their full result (rows are written to the ``noop`` sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brickledger.plans import training  # noqa: E402
from brickledger.session import build_session  # noqa: E402
from checks import inputs, registry  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "q01_regional_summary", "q02_type_by_region", "q03_epc_premium", "q04_school_effect", "q05_commute_prices",
    "q06_yearly_growth", "q07_bedroom_value", "q08_accuracy_by_region", "q09_error_distribution",
    "q10_top_decile_profile", "q11_flood_discount", "q12_importance_ranking", "c5_yearly_trend", "c8_price_histogram",
    "k1_headline_findings", "k2_ingest_summary", "j5_price_index_gap", "j6_school_mix_gap", "p8_final_columns",
    "p19_feature_matrix", "p21_residuals", "p32_valuations", "s8_exact_sample", "m1_stratified_split",
]


RUNS = 2


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", {
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spent: dict[str, float] = {}

    def timed(name: str, work, runs: int = 1) -> None:
        taken = []
        for _ in range(runs):
            begin = time.perf_counter()
            work()
            taken.append(time.perf_counter() - begin)
        spent[name] = round(min(taken), 3)

    def run(df) -> None:
        df.write.mode("overwrite").format("noop").save()

    queries = registry.registered()
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not part of any query
    timed("build_properties", lambda: inputs.store_properties(spark, SF_DIR))
    for name in HEADLINE:
        timed(name, lambda name=name: run(queries[name](spark, SF_DIR)), RUNS)
    box = {}
    timed("m_training_table", lambda: box.update(table=training.training_table(inputs.valued(spark, SF_DIR))))
    train, test = training.split_parts(box["table"])
    timed("m3_ridge_fit", lambda: box.update(model=training.fit(training.ridge_pipeline(train), train)))
    timed("m3_ridge_closed_form", lambda: training.ridge_closed_form(train))
    timed("m6_ridge_evaluate", lambda: run(training.evaluate(box["model"], test, training.RIDGE)))
    timed("m5_boosting_fit_20_rounds", lambda: training.fit(
        training.boosting_pipeline(training.Settings(boosting_rounds=20)), train))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": SF_DIR,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
