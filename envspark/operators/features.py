"""Model features and evaluation (M1-M7) as DataFrame jobs; M5 uses MLlib.

Everything is per series (station): windows partition by station and order by time, so they scale with the
number of stations; splits are chronological, never random, since the data are time series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from envspark.functions.timefmt import truncate_hour
from envspark.operators.positions import positional_values


def feature_table(facts: DataFrame, variables: list[str], key: str = "station_id") -> DataFrame:
    """M1: hourly means per (station, hour) with one column per variable, plus hour and day of week
    (Monday = 0). One conditional aggregation, no pivot discovery job."""
    bucket = truncate_hour("observed_at").alias("bucket")
    wide = facts.groupBy(key, bucket).agg(
        *[F.avg(F.when(F.col("variable_code") == v, F.col("value"))).alias(v.lower()) for v in variables])
    return wide.withColumn("hour", F.hour("bucket")).withColumn("dow", (F.dayofweek("bucket") + 5) % 7)


def lag_features(features: DataFrame, target: str, n_lags: int = 24, key: str = "station_id") -> DataFrame:
    """M2: the previous n_lags values of the target per station (rows of the station's own series)."""
    w = Window.partitionBy(key).orderBy("bucket")
    return features.select(key, "bucket", target, *[F.lag(target, k).over(w).alias(f"lag_{k}")
                                                     for k in range(1, n_lags + 1)])


def sequence_windows(features: DataFrame, inputs: list[str], target: str, steps: int = 24, key: str = "station_id",
                     contiguous: bool = False) -> DataFrame:
    """M2: for every hour with ``steps`` hours before it, the sequence of their ``inputs`` (oldest first) and the target.

    Hours are rows of the series; with ``contiguous`` only sequences without a missing hour are kept.
    """
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(-steps, -1)
    step = F.struct("bucket", *inputs)
    rows = features.select(key, "bucket", F.col(target).alias("target"), F.collect_list(step).over(before).alias("sequence"))
    rows = rows.where((F.size("sequence") == steps) & F.col("target").isNotNull())
    if not contiguous:
        return rows
    hours = F.expr("timestampdiff(HOUR, sequence[0].bucket, bucket)")
    return rows.where(hours == steps)


def minmax_fit(df: DataFrame, cols: list[str]) -> DataFrame:
    """M3 fit: one row of per-column min and max (one aggregation). Fit on the 'train' rows of ``chrono_split`` only."""
    return df.agg(*[F.min(c).alias(f"{c}_min") for c in cols], *[F.max(c).alias(f"{c}_max") for c in cols])


def minmax_transform(df: DataFrame, fit: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """M3: (v - min) / (max - min); 0 when the column is flat. The fit row enters as one scalar subquery."""
    out = [F.col(k) for k in keep]
    g = fit.select(F.struct(*fit.columns)).scalar()
    for c in cols:
        mn, mx = g.getField(f"{c}_min"), g.getField(f"{c}_max")
        out.append(F.when(mx > mn, (F.col(c) - mn) / (mx - mn)).otherwise(F.lit(0.0)).alias(f"{c}_scaled"))
    return df.select(*out)


def minmax_inverse(scaled, mn, mx):
    """M3 inverse for predictions."""
    return scaled * (mx - mn) + mn


def chrono_split(df: DataFrame, ratio: float = 0.8, key: str = "station_id", order: str = "bucket") -> DataFrame:
    """M4: the first floor(ratio * n) rows of each series are 'train', the rest 'test'.

    The time at that position comes by histogram refinement (``positions``), so no task sorts a series; rows of that very time
    are 'test', also if it is repeated.
    """
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{order}`)").cast("double")
    cut = positional_values(df, key, micros, {"cut": F.floor(F.col("n") * ratio)}).select(F.col("series").alias(key), "cut")
    return df.join(cut, key).withColumn("split", F.when(F.col("cut").isNull() | (micros < F.col("cut")), F.lit("train"))
                                        .otherwise(F.lit("test"))).drop("cut")


def persistence_predictions(features: DataFrame, target: str, ratio: float = 0.8,
                            key: str = "station_id") -> DataFrame:
    """Predictions of the naive model (previous value of the series) on the test part of each series."""
    series = features.where(F.col(target).isNotNull()).select(key, "bucket", F.col(target).alias("actual"))
    w = Window.partitionBy(key).orderBy("bucket")
    pred = series.withColumn("predicted", F.lag("actual", 1).over(w))
    return chrono_split(pred, ratio, key).where((F.col("split") == "test") & F.col("predicted").isNotNull())


def prediction_errors(pred: DataFrame) -> DataFrame:
    """M7: actual, predicted, error = actual - predicted, error % of |actual| (null when actual = 0)."""
    err = F.col("actual") - F.col("predicted")
    return pred.select("*", err.alias("error"),
                       F.when(F.col("actual") != 0, F.abs(err) / F.abs(F.col("actual")) * 100).alias("error_pct"))


def regression_metrics(pred: DataFrame) -> DataFrame:
    """M6: n, MAE, RMSE, MAPE (%, rows with actual <> 0), R^2 = 1 - SSE / SST."""
    e = F.col("actual") - F.col("predicted")
    mean_y = pred.select(F.avg("actual")).scalar()
    return pred.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(F.col("actual") != 0, F.abs(e) / F.abs(F.col("actual")))) * 100).alias("mape"),
        (F.lit(1.0) - F.sum(e * e) / F.sum((F.col("actual") - mean_y) * (F.col("actual") - mean_y))).alias("r2"),
    )


def forest_importance(features: DataFrame, target: str, inputs: list[str], num_trees: int = 100,
                      max_depth: int = 10, seed: int = 42) -> DataFrame:
    """M5: random forest regressor (MLlib, distributed training) and its ranked feature importances."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = features.where(F.col(target).isNotNull()).na.fill(0.0, subset=inputs)
    vec = VectorAssembler(inputCols=inputs, outputCol="features").transform(data)
    model = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=num_trees, maxDepth=max_depth,
                                  seed=seed).fit(vec)
    imp = model.featureImportances.toArray().tolist()
    spark = features.sparkSession
    rows = sorted(zip(inputs, imp), key=lambda x: -x[1])
    return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def trained(features: DataFrame, target: str, inputs: list[str], kind: str = "forest", num_trees: int = 100, max_depth: int = 10,
            seed: int = 42) -> tuple[DataFrame, dict[str, float]]:
    """M5: (predictions, importances) of a random forest or of gradient boosting, trained on the rows given (MLlib)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    common = dict(featuresCol="features", labelCol=target, maxDepth=max_depth, seed=seed)
    models = {"forest": lambda: RandomForestRegressor(numTrees=num_trees, **common),
              "boosting": lambda: GBTRegressor(maxIter=num_trees, **common)}
    if kind not in models:
        raise ValueError("kind must be forest or boosting")
    data = features.where(F.col(target).isNotNull()).na.fill(0.0, subset=inputs)
    vec = VectorAssembler(inputCols=inputs, outputCol="features").transform(data)
    model = models[kind]().fit(vec)
    predictions = model.transform(vec).select(F.col(target).alias("actual"), F.col("prediction").alias("predicted"))
    return predictions, dict(zip(inputs, model.featureImportances.toArray().tolist()))


def regressor_summary(features: DataFrame, target: str, inputs: list[str], kind: str, **how) -> DataFrame:
    """M5: one row of a trained model: rows, RMSE on its training rows against the spread of the target, and what its
    importances add up to."""
    predictions, importances = trained(features, target, inputs, kind, **how)
    spread = predictions.select(F.stddev_pop("actual")).scalar()
    return predictions.agg(
        F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sqrt(F.avg((F.col("actual") - F.col("predicted")) ** 2)).alias("rmse"),
        F.lit(len(importances)).alias("n_features"), F.lit(float(sum(importances.values()))).alias("importance_sum")).withColumn(
        "better_than_mean", F.col("rmse") < spread)
