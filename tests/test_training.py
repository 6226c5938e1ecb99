import math
import re

import pytest
from pyspark.sql import functions as F

from conftest import final_plan, rows
from contract import frames
from contract.queries import AS_OF, CUT_OFF, LAST_DAY, TODAY
from ledgerlake.operators import series
from ledgerlake.plans import forecast, training
from ledgerlake.schemas import TABLES
from ledgerlake.sources import models
from ledgerlake.sources.shared import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def features(spark):
    return materialize(series.demand_features(frames.event_sales(spark, SF), AS_OF), "features")


@pytest.fixture(scope="module")
def run(features):
    return training.grid_search(features, CUT_OFF, LAST_DAY, ["features1", "features2"], [3, 5], [4], folds=2)


def test_feature_sets_are_nested():
    sets = list(training.FEATURE_SETS.values())
    assert [len(s) for s in sets] == [6, 7, 8, 9, 10, 11]
    assert all(set(a) < set(b) for a, b in zip(sets, sets[1:]))


def test_split(features):
    train, test = training.split_at(features, CUT_OFF, LAST_DAY)
    open_test = training.split_at(features, CUT_OFF)[1]
    assert train.count() + open_test.count() == features.count()
    assert test.agg(F.min("event_date").cast("string"), F.max("event_date").cast("string")).first() == (CUT_OFF, LAST_DAY)


def test_full_search_space_size():
    assert len(training.FEATURE_SETS) * len(training.GRID_DEPTHS) * len(training.GRID_TREES) == 54


def test_search_reports_the_best_candidate(spark, run):
    assert len(run.candidate_rmse) == 4
    best = min(run.candidate_rmse, key=lambda c: c[3])
    assert (run.features, run.max_depth, run.num_trees) == (training.FEATURE_SETS[best[0]], best[1], best[2])
    assert math.isfinite(run.rmse_train) and math.isfinite(run.rmse_test)
    report = run.report(spark, "somewhere").first()
    assert str(report["cut_off_date"]) == CUT_OFF and report["features"] == run.features


def test_rmse_formula_agrees_with_evaluator(run, features):
    predicted = run.model.transform(training.split_at(features, CUT_OFF, LAST_DAY)[1])
    own = training.rmse(predicted).first()["rmse"]
    assert own == pytest.approx(training.evaluator().evaluate(predicted)) == pytest.approx(run.rmse_test)


def test_unseen_district_is_kept_or_refused(features):
    stranger = features.limit(3).withColumn("district", F.lit("nowhere"))
    forest = training.random_forest("features1", maxDepth=2, numTrees=2)
    assert training.fit_model(features, forest).transform(stranger).count() == 3
    with pytest.raises(Exception):
        training.fit_model(features, forest, "error").transform(stranger).collect()


def test_linear_models(features):
    for name in ("features6", "features_one_hot"):
        model = training.fit_model(features, training.linear_regression(name))
        train, test = training.split_at(features, CUT_OFF, LAST_DAY)
        scored = training.actual_and_predicted(model, train, test)
        assert scored.count() == train.count() + test.count()
        assert scored.filter("isnan(prediction) OR prediction IS NULL").count() == 0


def test_registry_moves_alias(spark, run, features, tmp_path):
    root = str(tmp_path / "models")
    first = models.save_model(spark, run.model, root, "demand")
    other = training.fit_model(features, training.random_forest("features1", maxDepth=1, numTrees=1))
    second = models.save_model(spark, other, root, "demand", alias="trial")
    assert first != second
    assert models.load_model(spark, root, "demand").stages[-1].getNumTrees == run.num_trees
    assert models.load_model(spark, root, "demand", "trial").stages[-1].getNumTrees == 1
    same = rows(models.load_model(spark, root, "demand").transform(features), "district", "event_datetime", "prediction")
    assert same == rows(run.model.transform(features), "district", "event_datetime", "prediction")


def test_forecast_is_published_and_replaced_by_actuals(spark, lake, run, features):
    lake.merge("features_demand_forecast", features.filter("event_datetime <= '2024-01-25 10:00:00'"))
    training.record_run(lake, run, "somewhere")
    assert lake.read("training_runs").count() == 1
    forecast.publish_forecast(lake, run.model, TODAY)
    upcoming = lake.read("demand_forecast").filter("event_datetime = '2024-01-25 11:00:00'")
    assert upcoming.count() == features.select("district").distinct().count()
    # One hour later the real quantity is known and a new hour is predicted.
    lake.merge("features_demand_forecast", features.filter("event_datetime <= '2024-01-25 11:00:00'"))
    forecast.publish_forecast(lake, run.model, TODAY)
    actual = features.filter("event_datetime = '2024-01-25 11:00:00'").select(
        "district", F.col("sum_quantity_products").cast("double"))
    stored = lake.read("demand_forecast")
    assert rows(stored.filter("event_datetime = '2024-01-25 11:00:00'"), "district", "sum_quantity_products") == rows(actual)
    assert stored.filter("event_datetime = '2024-01-25 12:00:00'").count() == actual.count()
    history = forecast.recent(features, TODAY)
    assert str(history.agg(F.min("event_date")).first()[0]) == "2024-01-15"
    assert stored.groupBy("district", "event_datetime").count().filter("count > 1").count() == 0


def test_incremental_features_equal_full_ones(spark):
    sales = frames.event_sales(spark, SF)
    gold_columns = [f.name for f in TABLES["gld_sales"].schema]
    blank = {c: F.lit(None) for c in gold_columns if c not in sales.columns}
    gold = sales.withColumns(blank).select(*gold_columns)
    first, whole = frames.new_lake(spark), frames.new_lake(spark)
    first.append("gld_sales", gold.filter("event_date <= '2024-01-18'"))
    forecast.refresh_features(first, "2024-01-18 23:00:00")
    first.append("gld_sales", gold.filter("event_date > '2024-01-18'"))
    # The day filter reaches the partitions of the gold table.
    pruned = final_plan(forecast._from_day(first.read("gld_sales"), "2024-01-19"))
    # Sales without a day are always read again, so the filter keeps that partition as well.
    kept = r"PartitionFilters: \[\(isnull\(event_date#\d+\) OR \(event_date#\d+ >= 2024-01-19"
    assert re.search(kept, pruned)
    assert forecast.refresh_features(first, AS_OF, since="2024-01-19") > 0
    whole.append("gld_sales", gold)
    forecast.refresh_features(whole, AS_OF)
    exact = ["district", "event_datetime", "event_weekday", series.QUANTITY, *[series.lag_column(k) for k in range(1, 7)]]
    table = "features_demand_forecast"
    assert rows(first.read(table), *exact) == rows(whole.read(table), *exact)
    assert forecast.refresh_features(whole, AS_OF) == 0


def test_models_do_not_depend_on_the_partitions_of_their_input(features):
    found = []
    for parts in (3, 8):
        dealt = features.repartition(parts)
        train, test = training.split_at(dealt, CUT_OFF, LAST_DAY)
        model = training.fit_model(train, training.random_forest("features2", maxDepth=5, numTrees=4))
        search = training.grid_search(dealt, CUT_OFF, LAST_DAY, ["features1"], [3], [2, 4], folds=2)
        predicted = rows(model.transform(test), "district", "event_datetime", "prediction")
        found.append((predicted, search.candidate_rmse, search.rmse_test))
    assert found[0][0] == found[1][0]
    assert [c[:3] for c in found[0][1]] == [c[:3] for c in found[1][1]]
    assert [c[3] for c in found[0][1]] == pytest.approx([c[3] for c in found[1][1]])
    assert found[0][2] == pytest.approx(found[1][2])


def test_publishing_leaves_other_days_alone(spark, lake, run, features):
    until = lambda hour: features.filter(F.col("event_datetime") <= hour)
    lake.merge("features_demand_forecast", until("2024-01-25 10:00:00"))
    forecast.publish_forecast(lake, run.model, TODAY, days=10)
    files = lambda: {f for f in lake.read("demand_forecast").inputFiles()}
    before = files()
    lake.merge("features_demand_forecast", until("2024-01-25 11:00:00"))
    forecast.publish_forecast(lake, run.model, TODAY, days=1)
    kept = before & files()
    assert {f"2024-01-{day}" for day in range(15, 24)} == {f.split("event_date=")[1][:10] for f in kept}


def test_an_ended_search_goes_on_with_the_fits_that_are_left(spark, lake, features, monkeypatch):
    space = dict(feature_sets=["features1", "features3"], depths=[2, 4], trees=[2, 5], folds=3)
    whole = training.grid_search(features, CUT_OFF, LAST_DAY, **space)
    started = []
    fit = training._forest_of

    def ended(candidate):
        started.append(candidate)
        if len(started) > 13:
            raise RuntimeError("ended")
        return fit(candidate)

    monkeypatch.setattr(training, "_forest_of", ended)
    with pytest.raises(RuntimeError):
        training.grid_search(features, CUT_OFF, LAST_DAY, lake=lake, parallelism=1, **space)
    stored = lake.read("search_fits").count()
    assert stored == 13
    started.clear()
    monkeypatch.setattr(training, "_forest_of", lambda c: (started.append(c), fit(c))[1])
    rest = training.grid_search(features, CUT_OFF, LAST_DAY, lake=lake, **space)
    assert len(started) == 2 * 2 * 2 * 3 - stored + 1  # and the winner on all rows
    assert [c[:3] for c in rest.candidate_rmse] == [c[:3] for c in whole.candidate_rmse]
    assert [c[3] for c in rest.candidate_rmse] == pytest.approx([c[3] for c in whole.candidate_rmse])
    assert (rest.max_depth, rest.num_trees, rest.features) == (whole.max_depth, whole.num_trees, whole.features)
    fits = lake.read("search_fits")
    assert fits.count() == fits.select("feature_set", "max_depth", "num_trees", "fold").distinct().count() == 24


def test_fits_serve_only_the_same_rows_and_folds(features):
    space = training.SearchSpace(folds=3)
    train, _ = training.split_at(features, CUT_OFF, LAST_DAY)
    named = training.search_id(train, CUT_OFF, space)
    assert named == training.search_id(train.repartition(5), CUT_OFF, space)
    assert named != training.search_id(train.limit(train.count() - 1), CUT_OFF, space)
    assert named != training.search_id(train, CUT_OFF, training.SearchSpace(folds=2))
    assert len(space.fits()) == 162 and len(set(space.fits())) == 162
