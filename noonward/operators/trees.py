"""Forests and boosted trees: one MLlib model per hour ahead.

Features and targets are scaled per plant, so one model serves all plants: MLlib grows each tree over
the training parts of all plants, and the number of fits (24 per experiment) does not depend on the data.
Each sample also carries how its plant behaves in training, so that the trees can tell plants apart.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noonward import constants as K
from noonward.functions.columns import finite

# Smallest leaf of each kind of model.
SMALLEST_LEAF = {"RF": 1, "XGB": 1, "LGBM": 20}
MAX_BINS = 256


def tree_model(model: str, params: dict[str, float]):
    """The estimator a model name stands for; parameters it does not accept are ignored."""
    if model not in SMALLEST_LEAF:
        raise ValueError(f"unknown model: {model}")
    p = {k: v for k, v in params.items() if k in K.ALLOWED_PARAMS[model]}
    shared = {
        "maxDepth": int(p.get("max_depth", 3)),
        "minInstancesPerNode": SMALLEST_LEAF[model],
        "maxBins": MAX_BINS,
        "seed": int(p.get("random_state", K.RANDOM_SEED)),
        "featureSubsetStrategy": "all",
    }
    trees = int(p.get("n_estimators", 30))
    if model == "RF":
        return RandomForestRegressor(numTrees=trees, **shared)
    return GBTRegressor(maxIter=trees, stepSize=float(p.get("learning_rate", 0.1)), **shared)


def with_plant_behaviour(samples: DataFrame) -> DataFrame:
    """Samples with `_x`: their features, then the plant's mean and spread of the target in training, and how the
    target goes with the features (a correlation of daily means, 0 where there is none)."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + finite(x)) / F.size(c)
    days = samples.filter("part = 'train'").select("plant_id", mean("features").alias("x"), mean("y").alias("y"))
    goes = F.covar_pop("x", "y") / F.nullif(F.stddev_pop("x") * F.stddev_pop("y"), F.lit(0.0))
    plants = days.groupBy("plant_id").agg(F.avg("y").alias("_mean"), F.stddev_pop("y").alias("_spread"), goes.alias("_goes"))
    told = [finite(c) for c in ("_mean", "_spread", "_goes")]
    joined = samples.join(plants, "plant_id", "left")
    return joined.withColumn("_x", F.concat(F.transform("features", finite), F.array(*told))).drop("_mean", "_spread", "_goes")


def fit_trees(
    samples: DataFrame,
    model: str,
    params: dict[str, float],
    horizons: range = range(K.HOURS_PER_DAY),
    parallelism: int = 8,
) -> tuple[DataFrame, list]:
    """Forecasts of the test part in scaled units, and the fitted models.

    `samples` is read once per fit, so give it checkpointed. Fits run side by side to fill the cluster.
    """
    vectors = with_plant_behaviour(samples).withColumn("_x", array_to_vector("_x"))
    train = vectors.filter("part = 'train'").select("_x", F.transform("y", finite).alias("_y"))

    def fit(h: int):
        estimator = tree_model(model, params).setFeaturesCol("_x").setLabelCol("_label")
        return estimator.setPredictionCol(f"_p{h}").fit(train.select("_x", F.col("_y")[h].alias("_label")))

    with ThreadPoolExecutor(parallelism) as pool:
        fitted = list(pool.map(fit, horizons))
    forecast = vectors.filter("part = 'test'")
    for one in fitted:
        forecast = one.transform(forecast)
    guesses = [F.col(f"_p{h}") for h in horizons]
    return forecast.withColumn("y_pred", F.array(*guesses)).drop("_x", *[f"_p{h}" for h in horizons]), fitted


def save_models(models: list, path: str) -> None:
    for h, model in enumerate(models):
        model.write().overwrite().save(f"{path}/hour_{h:02d}")
