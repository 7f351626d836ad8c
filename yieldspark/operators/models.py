"""Folds, calibration on Spark ML, cross-validated boosting, and models on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldspark.operators.boosting import Boosted, boosted, probability
from yieldspark.operators.ordering import row_ranges, running_sums
from yieldspark.sources.staging import checked, stage


def _dealt(rows: DataFrame, counted: DataFrame, key: str, within: list[str], repeat: Column, name: str, folds: int, seed: int, ranges: int) -> DataFrame:
    """rows with the fold `name`: within the given columns, keys in hashed order are dealt round the folds.

    Hashes are uniform, so their first digits cut the order into even ranges without a sample. counted has the
    same keys as rows and is cheap to read: its counts by range say at which place each range begins, so rows
    move once, without their hash.
    """
    hashed = F.md5(F.concat_ws("|", repeat.cast("string"), F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    cut = F.shiftright(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") * F.lit(ranges).cast("long"), 32)
    sizes = counted.groupBy(cut.alias("of__"), *(F.col(c).alias(f"{c}__key") for c in within)).agg(F.count(F.lit(1)).alias("n__"))
    before = Window.partitionBy(*(f"{c}__key" for c in within)).orderBy("of__").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and class
    starts = checked(sizes.withColumn("start__", F.coalesce(F.sum("n__").over(before), F.lit(0))).drop("n__"), "starts")
    own = Window.partitionBy("range__", *within).orderBy("hash__", key)
    placed = rows.withColumn("range__", cut).repartition("range__", *within).withColumn("hash__", hashed).withColumn("place__", F.row_number().over(own))
    same = F.col("range__") == F.col("of__")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__key"))
    return placed.join(starts, same).select(*rows.columns, ((F.col("start__") + F.col("place__") - 1) % folds).cast("long").alias(name))


def _ranges(counted: DataFrame) -> int:
    """More ranges than elsewhere: their rows are wide."""
    return 4 * row_ranges(counted)


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, repeats: int = 1, seed: int = 1337) -> DataFrame:
    """repeat, key, label, fold: within each class and repeat, keys in hashed order are dealt round the folds."""
    each = stage(df.select(key, label), "labelled").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    out = _dealt(each, each, key, ["repeat", label], F.col("repeat"), "fold", folds, seed, _ranges(each))
    return out.select(key, label, F.col("repeat").cast("long").alias("repeat"), "fold")


def platt(df: DataFrame, score: str, label: str):
    """L2 logistic calibration (C = 1) of a score: a fitted model with .transform adding p_cal."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = df.count()
    steps = [VectorAssembler(inputCols=[score], outputCol="features__"), LogisticRegression(featuresCol="features__", labelCol=label, regParam=1.0 / n, standardization=False, rawPredictionCol="raw__", probabilityCol="prob__", predictionCol="pred__", tol=1e-10, maxIter=200)]
    return Pipeline(stages=steps).fit(df)


def apply_platt(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("p_cal", F.get(vector_to_array("prob__"), 1)).drop("features__", "raw__", "prob__", "pred__")


def isotonic(df: DataFrame, score: str, label: str):
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="p_cal").fit(df)


def calibrated(model, df: DataFrame) -> DataFrame:
    """df with p_cal, by a fitted (or loaded) calibrator of either kind."""
    from pyspark.ml import PipelineModel

    return apply_platt(model, df) if isinstance(model, PipelineModel) else model.transform(df)


def cross_validated(df: DataFrame, key: str, label: str, columns: list[str], folds: int = 5, repeats: int = 3, select: Callable[[DataFrame], list[str]] | None = None, **trees) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold scores, fits): a boosted model for each repeat and fold, grown until its held-out fold stops gaining.

    Scores are key, label, repeat, fold, p: each key once a repeat, by the model that has not seen its fold.
    Fits are repeat, fold, n_trees, features, average_precision, roc_auc and brier of that fold. select names the
    columns that a model may use, from its training rows alone (key, label and columns); without it all are used.
    All models grow in the same jobs, over bins of all rows; **trees goes to `boosted`. Rows carry their columns
    and folds, so none are joined; scores are made where they are read.
    """
    labelled = stage(df.where(F.col(label).isNotNull()).select(key, label, *columns), "labelled")
    rows, ranges = labelled.withColumn("held__", F.lit(0).cast("long")), _ranges(labelled)
    for repeat in range(repeats):
        rows = _dealt(rows, labelled, key, [label], F.lit(repeat + 1), "fold__", folds, 1337, ranges)
        rows = rows.withColumn("held__", F.col("held__") + F.pow(F.lit(2), F.col("fold__") + repeat * folds).cast("long")).drop("fold__")
    rows = stage(rows, "training")
    chosen = [list(columns)] * (folds * repeats)
    if select:
        chosen = [select(rows.where(F.shiftright("held__", m) % 2 == 0).drop("held__")) for m in range(folds * repeats)]  # a model's own rows
    fitted = boosted(rows, columns, label, held=F.col("held__"), models=folds * repeats, chosen=chosen, **trees)
    scored = F.array(*(F.when(F.shiftright("held__", m) % 2 == 1, F.struct(F.lit(m // folds + 1).cast("long").alias("repeat"), F.lit(m % folds).cast("long").alias("fold"), probability(model).alias("p"))) for m, model in enumerate(fitted)))
    scores = rows.select(key, label, F.explode(F.filter(scored, lambda s: s.isNotNull())).alias("s")).select(key, label, "s.*")
    y = F.col(label).cast("long")
    points = stage(scores.groupBy("repeat", "fold", "p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")), "curve")
    curve = running_sums(points, [F.desc("p")], {"tp": F.col("pos"), "fp": F.col("neg")}, keys=["repeat", "fold"])
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))
    error = points.groupBy("repeat", "fold").agg((F.sum(F.col("pos") * (1 - F.col("p")) ** 2 + F.col("neg") * F.col("p") ** 2) / F.sum(F.col("pos") + F.col("neg"))).alias("brier"))
    sizes = df.sparkSession.createDataFrame([(m // folds + 1, m % folds, len(model.trees), chosen[m]) for m, model in enumerate(fitted)], "repeat long, fold long, n_trees long, features array<string>")
    fits = sizes.join(curve.groupBy("repeat", "fold").agg(precision.alias("average_precision"), auc.alias("roc_auc")), ["repeat", "fold"]).join(error, ["repeat", "fold"])
    return scores, fits


def refit(df: DataFrame, label: str, columns: list[str], fits: DataFrame | None = None, rounds: int = 5000, **trees) -> Boosted:
    """A model of all labelled rows: `rounds` trees, or the median number of the cross-validated fits."""
    if fits is not None:
        rounds = max(1, int(fits.agg(F.median("n_trees")).first()[0]))
    return boosted(df, columns, label, rounds, **trees)[0]


def selection_counts(fits: DataFrame) -> DataFrame:
    """feature, n, share: in how many of the fits (a row each, its features in the array `features`) it was chosen."""
    n = fits.count()
    return fits.select(F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / n)


def save_model(model, path: str) -> None:
    """A boosted model (its trees and edges as JSON) or a fitted calibrator of Spark ML, so that another job may score."""
    if isinstance(model, Boosted):
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/boosted")
    else:
        model.write().overwrite().save(f"{path}/model")


def load_model(spark: SparkSession, path: str):
    """What save_model wrote: a Boosted, or a Spark ML model of the class its metadata name."""
    from pyspark.ml.util import DefaultParamsReader

    try:
        return Boosted.from_json(spark.read.text(f"{path}/boosted").first()[0])
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
    return DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
