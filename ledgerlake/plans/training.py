"""Demand models on Spark ML: features, grid search, evaluation, run records."""

from __future__ import annotations

import hashlib
import itertools
import uuid
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.operators.forest import WideForestRegressor
from ledgerlake.operators.series import QUANTITY, lag_column
from ledgerlake.sources.lake import Lake

LAGS = 6
SEED = 17
# Search space and folds of the demand model.
GRID_DEPTHS = [10, 20, 30]
GRID_TREES = [10, 20, 30]
FOLDS = 3
# Fits of a search that run at once, and finished fits that are stored together.
PARALLEL_FITS = 8
FITS_PER_APPEND = 9
# Rows remember their tree node from level to level; node statistics of one job stay small enough for
# several fits at once (measured on 13,000 rows: 512 MB 1.2 times, 1 GB 1.9 times as long as 128 MB).
NODE_STATISTICS = {"maxMemoryInMB": 128, "cacheNodeIds": True}
# Bagging follows partitions: rows are dealt by hash into as many as their number asks for, on any cluster.
PARTITION_ROWS = 25_000
_ROW_KEYS = ["district", "event_datetime"]
# Feature set, tree depth, number of trees.
Candidate = tuple[str, int, int]

FEATURE_SETS = {
    f"features{n}": [
        "district_vec", "event_weekday", "avg_latitude", "avg_longitude", "event_hour",
        *[lag_column(k) for k in range(1, n + 1)],
    ]
    for n in range(1, LAGS + 1)
}
# All categories one-hot, all lags.
ONE_HOT_FEATURES = [
    "district_vec", "event_weekday_vec", "avg_latitude", "avg_longitude", "event_hour_vec",
    *[lag_column(k) for k in range(1, LAGS + 1)],
]
MODEL_COLUMNS = [
    "district_index", "district_vec", "event_weekday_vec", "event_hour_vec",
    *FEATURE_SETS, "features_one_hot",
]


def split_at(features: DataFrame, cut_off, last_day=None) -> tuple[DataFrame, DataFrame]:
    """Rows before ``cut_off`` for training, from it (up to ``last_day``) for testing."""
    day, cut = F.col("event_date"), F.lit(cut_off).cast("date")
    test = features.filter(day >= cut)
    if last_day is not None:
        test = test.filter(day <= F.lit(last_day).cast("date"))
    return features.filter(day < cut), test


def encoding_pipeline(
    handle_invalid: str = "keep",
    one_hot_set: bool = False,
    more_sets: dict[str, list[str]] | None = None,
) -> Pipeline:
    """Index and one-hot the categories and assemble the nested feature sets.

    ``keep`` maps districts unseen in training to a category of their own,
    ``error`` refuses them.  ``more_sets`` names further feature sets by their columns.
    """
    stages = [
        StringIndexer(
            inputCol="district", outputCol="district_index", handleInvalid=handle_invalid
        ),
        OneHotEncoder(
            inputCols=["district_index", "event_weekday", "event_hour"],
            outputCols=["district_vec", "event_weekday_vec", "event_hour_vec"],
            handleInvalid=handle_invalid,
        ),
        *[
            VectorAssembler(inputCols=columns, outputCol=name)
            for name, columns in (FEATURE_SETS | (more_sets or {})).items()
        ],
    ]
    if one_hot_set:
        stages.append(VectorAssembler(inputCols=ONE_HOT_FEATURES, outputCol="features_one_hot"))
    return Pipeline(stages=stages)


def random_forest(features: str = "features1", **params) -> RandomForestRegressor:
    return WideForestRegressor(featuresCol=features, labelCol=QUANTITY, seed=SEED, **params)


def linear_regression(features: str = "features6", **params) -> LinearRegression:
    return LinearRegression(featuresCol=features, labelCol=QUANTITY, **params)


def _dealt(train: DataFrame) -> DataFrame:
    """Training rows (one per district and hour) in the same partitions and order everywhere."""
    parts = max(1, -(-train.count() // PARTITION_ROWS))
    return train.repartition(parts, *_ROW_KEYS).sortWithinPartitions(*_ROW_KEYS)


def fit_model(
    train: DataFrame,
    regressor,
    handle_invalid: str = "keep",
    more_sets: dict[str, list[str]] | None = None,
) -> PipelineModel:
    """Encoding stages plus one regressor, fitted together."""
    one_hot_set = regressor.getFeaturesCol() == "features_one_hot"
    encoding = encoding_pipeline(handle_invalid, one_hot_set, more_sets)
    return Pipeline(stages=[*encoding.getStages(), regressor]).fit(_dealt(train))


def rmse(predicted: DataFrame, label: str = QUANTITY, prediction: str = "prediction"):
    """Root mean squared error as a one-row DataFrame."""
    error = F.col(label) - F.col(prediction)
    return predicted.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def evaluator() -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=QUANTITY, predictionCol="prediction", metricName="rmse")


@dataclass
class TrainingRun:
    """Outcome of a grid search: the winning model and what is recorded about it."""

    model: PipelineModel
    cut_off: str
    rmse_train: float
    rmse_test: float
    max_depth: int
    num_trees: int
    features: list[str]
    candidate_rmse: list[tuple[str, int, int, float]]
    search: str = ""
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def report(self, spark: SparkSession, model_path: str | None = None) -> DataFrame:
        """The run as one row."""
        return spark.createDataFrame(
            [(self.run_id, model_path, self.cut_off, self.rmse_train, self.rmse_test,
              self.max_depth, self.num_trees, self.features)],
            "run_id STRING, model_path STRING, cut_off_date STRING, rmse_train DOUBLE, "
            "rmse_test DOUBLE, max_depth INT, num_trees INT, features ARRAY<STRING>",
        ).withColumn("cut_off_date", F.to_date("cut_off_date"))


@dataclass(frozen=True)
class SearchSpace:
    """Candidates (feature set x depth x trees) and the number of folds each is fitted on."""

    feature_sets: tuple[str, ...] = tuple(FEATURE_SETS)
    depths: tuple[int, ...] = tuple(GRID_DEPTHS)
    trees: tuple[int, ...] = tuple(GRID_TREES)
    folds: int = FOLDS

    def candidates(self) -> list[Candidate]:
        return list(itertools.product(self.feature_sets, self.depths, self.trees))

    def fits(self) -> list[tuple[Candidate, int]]:
        """Every candidate on every fold, the largest forests first, so that none is left alone at the end."""
        fits = itertools.product(self.candidates(), range(self.folds))
        return sorted(fits, key=lambda fit: -fit[0][1] * fit[0][2])


def search_id(train: DataFrame, cut_off, space: SearchSpace) -> str:
    """Names a search by its training rows and folds, so that stored fits serve only the same search."""
    values = sorted({*_ROW_KEYS, QUANTITY, *ONE_HOT_FEATURES} & set(train.columns))
    seen = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(F.xxhash64(*values), F.lit(1 << 40))).alias("content"),
    ).first()
    named = f"{cut_off}/{space.folds}/{SEED}/{seen['n']}/{seen['content']}"
    return hashlib.sha256(named.encode()).hexdigest()[:32]


class FitLog:
    """The stored table of fits; in memory only where no lake is given.

    Finished fits are appended a few at a time, so a search that was ended loses
    those of the last few seconds.  It holds one row per fit, 162 for the whole space.
    """

    def __init__(self, lake: Lake | None, search: str) -> None:
        self.lake, self.search = lake, search
        self.pending: list[tuple] = []
        self.done: dict[tuple[Candidate, int], tuple[float, int]] = {}
        self.lock = Lock()
        if lake is not None:
            for row in lake.read("search_fits").filter(F.col("search_id") == search).collect():
                fit = ((row["feature_set"], row["max_depth"], row["num_trees"]), row["fold"])
                self.done[fit] = (row["rmse"], row["n_rows"])

    def add(self, fit: tuple[Candidate, int], error: float, n_rows: int) -> None:
        with self.lock:
            self.done[fit] = (error, n_rows)
            self.pending.append((self.search, *fit[0], fit[1], error, n_rows))
            if len(self.pending) >= FITS_PER_APPEND:
                self._store()

    def _store(self) -> None:
        if self.lake is not None and self.pending:
            schema = self.lake.schema_of("search_fits")
            rows = self.lake.spark.createDataFrame(self.pending, schema).coalesce(1)
            self.lake.append("search_fits", rows)
        self.pending = []

    def close(self) -> None:
        with self.lock:
            self._store()

    def mean_errors(self, space: SearchSpace) -> list[tuple[str, int, int, float]]:
        """Mean error over the folds, per candidate."""
        return [
            (*c, sum(self.done[c, f][0] for f in range(space.folds)) / space.folds)
            for c in space.candidates()
        ]


def _forest_of(candidate: Candidate) -> RandomForestRegressor:
    features, depth, trees = candidate
    return random_forest(features, maxDepth=depth, numTrees=trees, **NODE_STATISTICS)


def fit_candidates(
    encoded: DataFrame, space: SearchSpace, log: FitLog, parallelism: int = PARALLEL_FITS
) -> None:
    """Fit and judge what the log doesn't hold yet, several fits at a time.

    The driver only starts the fits; each is a distributed job over the kept rows.
    """
    spark = encoded.sparkSession
    left = [fit for fit in space.fits() if fit not in log.done]

    def one(fit: tuple[Candidate, int]) -> None:
        candidate, fold = fit
        model = _forest_of(candidate).fit(encoded.filter(F.col("fold") != fold))
        error = F.col(QUANTITY) - F.col("prediction")
        judged = model.transform(encoded.filter(F.col("fold") == fold)).agg(
            F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n")
        ).first()
        log.add(fit, judged["rmse"], judged["n"])

    try:
        if left:
            with ThreadPool(min(parallelism, len(left))) as pool:
                for _ in pool.imap_unordered(inheritable_thread_target(spark)(one), left):
                    pass
    finally:
        log.close()


def grid_search(
    features: DataFrame,
    cut_off: str,
    last_day: str | None = None,
    feature_sets: list[str] | None = None,
    depths: list[int] | None = None,
    trees: list[int] | None = None,
    folds: int = FOLDS,
    parallelism: int = PARALLEL_FITS,
    lake: Lake | None = None,
) -> TrainingRun:
    """Cross-validated search over feature set, tree depth and tree count.

    The encoding does not depend on the searched parameters, so it is fitted
    once and the encoded rows (one per district and hour) are kept for all fits.
    Folds are rows by hash, not periods, so lags leak between folds; neither they nor the
    forests depend on the cluster.  With a ``lake`` every finished fit is stored, and a search
    that was ended goes on with the fits that are left.
    """
    space = SearchSpace(
        tuple(feature_sets or FEATURE_SETS), tuple(depths or GRID_DEPTHS), tuple(trees or GRID_TREES), folds
    )
    train, test = split_at(features, cut_off, last_day)
    log = FitLog(lake, search_id(train, cut_off, space))
    encoding = encoding_pipeline().fit(train)
    fold = F.pmod(F.xxhash64(*_ROW_KEYS), F.lit(folds)).cast("int")
    needed = [*space.feature_sets, QUANTITY, "fold"]
    encoded = encoding.transform(_dealt(train)).withColumn("fold", fold).select(*needed)
    encoded = encoded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit_candidates(encoded, space, log, parallelism)
        candidates = log.mean_errors(space)
        winner = min(candidates, key=lambda c: c[3])
        best = _forest_of(winner[:3]).fit(encoded)
        rmse_train = evaluator().evaluate(best.transform(encoded))
        rmse_test = evaluator().evaluate(best.transform(encoding.transform(test)))
    finally:
        encoded.unpersist()
    return TrainingRun(
        model=PipelineModel(stages=[*encoding.stages, best]),
        cut_off=str(cut_off),
        rmse_train=rmse_train,
        rmse_test=rmse_test,
        max_depth=best.getOrDefault("maxDepth"),
        num_trees=best.getNumTrees,
        features=FEATURE_SETS[best.getOrDefault("featuresCol")],
        candidate_rmse=candidates,
        search=log.search,
    )


def actual_and_predicted(
    model: PipelineModel, train: DataFrame, test: DataFrame
) -> DataFrame:
    """Actual and predicted quantity of all training and test rows."""
    columns = ["district", "event_datetime", QUANTITY, "prediction"]
    return (
        model.transform(train).select(*columns).union(model.transform(test).select(*columns))
    )


def record_run(lake: Lake, run: TrainingRun, model_path: str) -> None:
    """Append the run to the training log."""
    lake.append("training_runs", run.report(lake.spark, model_path))
