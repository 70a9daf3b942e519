"""Distributed regression on log price: fit, evaluate, cross-validate, explain, score.

Only fitted models and one-row measures reach the driver. The feature table is
written once to the shared folder before any fit, because the tree learners
read it many times and a lost executor must not cost the whole upstream plan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brickledger.functions import fixed_values as fv
from brickledger.functions.scalar import half_even, literal
from brickledger.operators import features as fe, gram
from brickledger.operators.distribution import PRICE
from brickledger.operators.prediction_errors import model_measures, prediction_table, rounded_measures
from brickledger.operators.ranking import with_split
from brickledger.session import Scratch, storage_bytes, use_checkpoints

TARGET, PREDICTION, VECTOR = fe.TARGET, "prediction", "features"
RIDGE, FOREST, BOOSTING = "Ridge Regression", "Random Forest", "Gradient Boosting"
# attributes needed to report on predictions without joining back
CARRIED = ["property_id", "region", "property_type", "sale_year", PRICE, TARGET, "is_test", "fold"]


@dataclass(frozen=True)
class Settings:
    """Model sizes; the defaults are the published ones."""

    ridge_alpha: float = 10.0
    forest_trees: int = 200
    forest_depth: int = 18
    forest_min_leaf: int = 3
    boosting_rounds: int = 400
    boosting_rate: float = 0.05
    boosting_depth: int = 5
    boosting_min_leaf: int = 10
    boosting_subsample: float = 0.8
    cv_rounds: int = 200
    folds: int = 5
    test_fraction: float = 0.2
    seed: int = 42
    max_bins: int = 128  # split candidates per feature; the solver's default of 32 is coarse for areas and indices
    max_memory_mb: int = 256  # node statistics a task holds at once; the forest at full size fills it in every task, whatever it is
    parallelism: int = 1


def training_table(properties: DataFrame, settings: Settings = Settings(), fit_on: str = "train",
                   materialise: bool = True, stored: bool = False) -> DataFrame:
    """Features, log target, split flag and fold for every property.

    The test part has exactly its share of the rows, folds of the rest differ by
    one row at most. ``fit_on="train"`` fits the regional index on training rows
    only; ``"all"`` includes the test rows and so leaks the target. The split,
    the index and the features each read the properties, which are therefore
    written first, as the features are; ``stored`` says that they are already.
    """
    if fit_on not in ("train", "all"):
        raise ValueError(f"unknown fit_on: {fit_on}")
    scratch = Scratch(properties.sparkSession)
    copied = materialise and not stored
    base = scratch.store(properties, "training-rows") if copied else properties
    split = with_split(base, test_fraction=settings.test_fraction, seed=settings.seed, folds=settings.folds)
    fitted = split.where(~F.col("is_test")) if fit_on == "train" else split
    table = fe.feature_matrix(fe.engineer(split, fitted), CARRIED).where(F.col(TARGET).isNotNull())
    return scratch.store(table, "features", *["training-rows"] * copied) if materialise else table


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(fv.FEATURES), outputCol=VECTOR)


def ridge_pipeline(train: DataFrame, settings: Settings = Settings()) -> Pipeline:
    """Ridge on standardised features with penalty ``alpha * |w|^2`` on the summed squared error.

    The scaler divides by the sample deviation, which shrinks unit-variance
    features by sqrt((n-1)/n), so the penalty shrinks by (n-1)/n; the solver
    works on the label scaled by its deviation and on the mean error, hence
    the factor std(y)/n.
    """
    n, label_std = train.agg(F.count(TARGET), F.stddev_pop(TARGET)).first()
    penalty = settings.ridge_alpha * (n - 1) / n * label_std / n
    scaler = StandardScaler(inputCol=VECTOR, outputCol="scaled", withMean=True, withStd=True)
    ridge = LinearRegression(
        featuresCol="scaled", labelCol=TARGET, predictionCol=PREDICTION, elasticNetParam=0.0,
        regParam=penalty, standardization=False, solver="normal",
    )
    return Pipeline(stages=[_assembler(), scaler, ridge])


@dataclass(frozen=True)
class LinearFit:
    """A linear model on standardised features: ``intercept + sum(weight * (x - mean) / scale)``."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    penalty: float

    def standardised(self) -> list[Column]:
        return [F.expr(f"(coalesce(CAST({f} AS DOUBLE), 0.0D) - {literal(m)}) / {literal(s)}")
                for f, m, s in zip(self.features, self.means, self.scales)]

    def predicted(self) -> Column:
        """The prediction as one native expression."""
        terms = [z * w for z, w in zip(self.standardised(), self.weights)]
        return sum(terms, F.lit(self.intercept))

    def score(self, table: DataFrame) -> DataFrame:
        return table.withColumn(PREDICTION, self.predicted())


def ridge_closed_form(train: DataFrame, features: tuple[str, ...] = tuple(fv.FEATURES), settings: Settings = Settings(),
                      target: str = TARGET) -> LinearFit:
    """The ridge of ``ridge_pipeline`` from one pass over the rows.

    Features are centred and divided by their population deviation (1 where it
    is 0); the weights solve ``(Z'Z + alpha I) w = Z'(y - mean y)``. All of it is
    in the table's cross-products, a matrix of fixed size solved on the driver.
    """
    found = gram.products(train, [*features, target])
    if not found.n:
        raise ValueError("no training rows")
    scales = np.where(found.deviations() > 0, found.deviations(), 1.0)[:-1]
    cross = found.centred[:-1, :-1] / np.outer(scales, scales)
    weights = np.linalg.solve(cross + settings.ridge_alpha * np.eye(len(features)), found.centred[:-1, -1] / scales)
    return LinearFit(tuple(features), tuple(found.means[:-1].tolist()), tuple(scales.tolist()), tuple(weights.tolist()),
                     float(found.means[-1]), settings.ridge_alpha)


def ridge_gradient(fitted: LinearFit, train: DataFrame, target: str = TARGET) -> DataFrame:
    """(feature, gradient) of ``|y - prediction|^2 + penalty * |w|^2`` at the fit, and of the intercept; all 0 at its least value."""
    error = F.col(target) - fitted.predicted()
    names = [*fitted.features, "intercept"]
    slopes = [F.sum(-2 * z * error) + 2 * fitted.penalty * w for z, w in zip(fitted.standardised(), fitted.weights)] + [F.sum(-2 * error)]
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), s.alias("gradient")) for n, s in zip(names, slopes)])
    return train.agg(entries.alias("g")).selectExpr("inline(g)")


def forest_pipeline(settings: Settings = Settings()) -> Pipeline:
    forest = RandomForestRegressor(
        featuresCol=VECTOR, labelCol=TARGET, predictionCol=PREDICTION, numTrees=settings.forest_trees,
        maxDepth=settings.forest_depth, minInstancesPerNode=settings.forest_min_leaf,
        featureSubsetStrategy="all", maxBins=settings.max_bins, maxMemoryInMB=settings.max_memory_mb, seed=settings.seed,
    )
    return Pipeline(stages=[_assembler(), forest])


def boosting_pipeline(settings: Settings = Settings()) -> Pipeline:
    boosting = GBTRegressor(
        featuresCol=VECTOR, labelCol=TARGET, predictionCol=PREDICTION, maxIter=settings.boosting_rounds,
        stepSize=settings.boosting_rate, maxDepth=settings.boosting_depth,
        minInstancesPerNode=settings.boosting_min_leaf, subsamplingRate=settings.boosting_subsample,
        featureSubsetStrategy="all", maxBins=settings.max_bins, maxMemoryInMB=settings.max_memory_mb,
        checkpointInterval=10,
        seed=settings.seed,
    )
    return Pipeline(stages=[_assembler(), boosting])


def cv_boosting_pipeline(settings: Settings = Settings()) -> Pipeline:
    """The smaller boosting model of the pound-space folds: no subsampling, no leaf floor."""
    boosting = GBTRegressor(
        featuresCol=VECTOR, labelCol=TARGET, predictionCol=PREDICTION, maxIter=settings.cv_rounds,
        stepSize=settings.boosting_rate, maxDepth=settings.boosting_depth, featureSubsetStrategy="all",
        maxBins=settings.max_bins, maxMemoryInMB=settings.max_memory_mb, checkpointInterval=10, seed=settings.seed,
    )
    return Pipeline(stages=[_assembler(), boosting])


def fit(pipeline: Estimator, train: DataFrame) -> PipelineModel:
    use_checkpoints(train.sparkSession)
    return pipeline.fit(train)


def in_pounds(log_price: str) -> Column:
    return F.expm1(F.col(log_price))


def score(model: PipelineModel, table: DataFrame) -> DataFrame:
    """Predictions next to the carried columns; vectors are dropped."""
    scored = model.transform(table)
    return scored.drop(*[c for c in scored.columns if c in (VECTOR, "scaled")])


def evaluate(model: PipelineModel, test: DataFrame, name: str) -> DataFrame:
    """One row of rounded measures in pounds."""
    measures = model_measures(score(model, test), in_pounds(TARGET), in_pounds(PREDICTION))
    return rounded_measures(measures.select(F.lit(name).alias("model"), "*"))


def predictions(model: PipelineModel, test: DataFrame) -> DataFrame:
    return prediction_table(score(model, test), in_pounds(TARGET), in_pounds(PREDICTION), keep=("property_id",))


@dataclass
class Fitted:
    """The three models and the tables they were fitted on and are judged by."""

    train: DataFrame
    test: DataFrame
    models: dict[str, PipelineModel] = field(default_factory=dict)

    def comparison(self) -> DataFrame:
        rows = [evaluate(model, self.test, name) for name, model in self.models.items()]
        table = rows[0]
        for row in rows[1:]:
            table = table.unionByName(row)
        return table


def split_parts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.where(~F.col("is_test")), table.where(F.col("is_test"))


def fit_models(table: DataFrame, settings: Settings = Settings(),
               names: tuple[str, ...] = (RIDGE, FOREST, BOOSTING)) -> Fitted:
    train, test = split_parts(table)
    makers = {
        RIDGE: lambda: ridge_pipeline(train, settings),
        FOREST: lambda: forest_pipeline(settings),
        BOOSTING: lambda: boosting_pipeline(settings),
    }
    return Fitted(train, test, {name: fit(makers[name](), train) for name in names})


#: Bytes of storage memory a row takes while the tree learners hold it: binned features, its weight and its error so far.
HELD_ROW_BYTES = 350


def folds_at_once(rows: int, memory: int, settings: Settings) -> int:
    """Folds to fit side by side: ``parallelism`` at most, and one at least.

    Every fit holds its rows from round to round. Once the fits together exceed
    the memory, each round reads them from disk, which takes far longer than
    fitting one fold after another.
    """
    return max(1, min(settings.parallelism, memory // max(1, rows * HELD_ROW_BYTES)))


def cross_validate(train: DataFrame, pipeline: Pipeline, measure: str, settings: Settings = Settings()) -> DataFrame:
    """(fold, score) rows, one fit per fold on the other folds.

    ``measure`` is ``r2`` (log space) or ``rmse`` (pounds). Folds are fitted side
    by side as far as their rows fit into the executors' storage memory; each
    score is a single aggregated number.
    """
    in_log = measure == "r2"
    actual, predicted = (F.col(TARGET), F.col(PREDICTION)) if in_log else (in_pounds(TARGET), in_pounds(PREDICTION))
    use_checkpoints(train.sparkSession)

    def one(fold: int) -> tuple[int, float]:
        model = pipeline.copy().fit(train.where(F.col("fold") != fold))
        held_out = score(model, train.where(F.col("fold") == fold))
        return fold, model_measures(held_out, actual, predicted).first()[measure]

    with ThreadPoolExecutor(folds_at_once(train.count(), storage_bytes(train.sparkSession), settings)) as pool:
        scores = list(pool.map(one, range(settings.folds)))
    return train.sparkSession.createDataFrame(scores, "fold int, score double")


def cv_r2(train: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return cross_validate(train, boosting_pipeline(settings), "r2", settings)


def cv_rmse(train: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return cross_validate(train, cv_boosting_pipeline(settings), "rmse", settings)


def fold_scores(scored: DataFrame, actual: Column, predicted: Column, measure: str) -> DataFrame:
    """(fold, score) of given predictions: the measure of each fold's rows, all folds in one pass."""
    return model_measures(scored.where(F.col("fold").isNotNull()), actual, predicted, "fold").select("fold", F.col(measure).alias("score"))


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def importance_shares(importances: DataFrame, top: int = 20) -> DataFrame:
    """The largest importances and their share of the sum over those kept."""
    kept = importances.orderBy(F.col("importance").desc(), "feature").limit(top)
    whole = kept.agg(F.sum("importance").alias("_sum"))  # one row
    share = F.col("importance") / F.nullif(F.col("_sum"), F.lit(0.0)) * 100
    return kept.crossJoin(F.broadcast(whole)).select(
        "feature", "importance", half_even(share, 2).alias("importance_pct")
    ).orderBy(F.col("importance").desc(), "feature")


def model_importances(model: PipelineModel, spark: SparkSession, features: tuple[str, ...] = tuple(fv.FEATURES)) -> DataFrame:
    """Importances of the fitted tree model: one number per feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def feature_statistics(train: DataFrame) -> DataFrame:
    """(feature, mean, std) with population deviation, from one aggregate."""
    stats = ", ".join(f"named_struct('feature', '{f}', 'mean', avg({f}), 'std', stddev_pop({f}))" for f in fv.FEATURES)
    return train.agg(F.expr(f"array({stats})").alias("s")).selectExpr("inline(s)")


def standardise(table: DataFrame, statistics: DataFrame) -> DataFrame:
    """Features minus their training mean, over their deviation (1 where it is 0).

    The statistics are 35 rows and become literals of the projection.
    """
    stats = {row["feature"]: row for row in statistics.collect()}
    scaled = [((F.col(f) - stats[f]["mean"]) / (stats[f]["std"] or 1.0)).alias(f) for f in fv.FEATURES]
    return table.select(*[c for c in table.columns if c not in fv.FEATURES], *scaled)


def save_model(model: PipelineModel, path: str, fitted_on: DataFrame | None = None) -> str:
    """The model and, fitted on ``fitted_on``, the regional index (a row a region) next to it."""
    model.write().overwrite().save(f"{path}/model")
    if fitted_on is not None:
        fe.region_index(fitted_on).coalesce(1).write.mode("overwrite").parquet(f"{path}/region_index")
    return path


def score_new(path: str, properties: DataFrame, fitted_on: DataFrame | None = None) -> DataFrame:
    """Price estimates for new properties from a saved model.

    The regional index saved with the model is used, unless ``fitted_on`` is given to fit it again.
    """
    index = properties.sparkSession.read.parquet(f"{path}/region_index") if fitted_on is None else None
    if PRICE not in properties.columns:
        properties = properties.withColumn(PRICE, F.lit(None).cast("bigint"))
    matrix = fe.feature_matrix(fe.engineer(properties, fitted_on, index), ["property_id"])
    scored = score(PipelineModel.load(f"{path}/model"), matrix)
    return scored.select("property_id", F.bround(in_pounds(PREDICTION), 0).cast("bigint").alias("estimate_gbp"))
