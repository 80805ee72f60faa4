"""Clustering and decision trees on tables, with their evaluation as frames."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.functions.vectors import as_doubles, squared_distance
from textpulse.operators.embeddings import nearest_each
from textpulse.operators.sampling import draw, random_split
from textpulse.session import local_rows


def feature_vector(df: DataFrame, inputs: list[str], out: str = "features") -> DataFrame:
    """One vector of vector and number columns in the given order."""
    return VectorAssembler(inputCols=inputs, outputCol=out).transform(df)


def ml_vectors(df: DataFrame, vector: str = "vector", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(as_doubles(vector)))


# --- clustering -------------------------------------------------------------------------------


@dataclass
class Clusters:
    centers: DataFrame  # (cluster, vector)
    cost: float
    model: object | None


def total_inertia(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Sum of squared distances to the mean: the cost of a single cluster, in one pass."""
    spread = [F.var_pop(F.get(as_doubles(vector), F.lit(i))) for i in range(size)]
    total = spread[0]
    for part in spread[1:]:
        total = total + part
    return df.agg((total * F.count(F.lit(1))).alias("cost"))


def k_means(df: DataFrame, k: int, size: int, vector: str = "vector", seed: int = 1, max_iter: int = 20) -> Clusters:
    """K-means; also for k = 1, which Spark's estimator refuses."""
    spark = df.sparkSession
    if k == 1:
        means = df.agg(F.array(*[F.avg(F.get(as_doubles(vector), F.lit(i))) for i in range(size)]).alias("vector"))
        cost = total_inertia(df, vector, size).first()["cost"]
        return Clusters(means.select(F.lit(0).alias("cluster"), "vector"), float(cost), None)
    features = ml_vectors(df.select(vector), vector).select("features").persist()
    try:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(features)
    finally:
        features.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centers = local_rows(spark, rows, "cluster int, vector array<double>")
    return Clusters(centers, float(model.summary.trainingCost), model)


def inertia_curve(
    df: DataFrame, size: int, vector: str = "vector", ks=range(1, 21), seed: int = 1, parallelism: int = 4
) -> DataFrame:
    """``(k, cost)`` for each k. All fits share one cached input; ``parallelism`` of them run at a time.

    The fits are independent and each is a row of short jobs, so side by side they fill the cluster.
    """
    kept = df.select(as_doubles(vector).alias(vector)).persist()

    def cost(k: int) -> tuple[int, float]:
        return k, k_means(kept, k, size, vector, seed).cost

    try:
        kept.count()
        with ThreadPool(parallelism) as pool:
            rows = pool.map(inheritable_thread_target(df.sparkSession)(cost), list(ks))
    finally:
        kept.unpersist()
    return local_rows(df.sparkSession, rows, "k int, cost double")


def assign_clusters(df: DataFrame, centers: DataFrame, vector: str = "vector") -> DataFrame:
    """Adds the nearest centre and the squared distance to it; the k centres are one scalar sub-query."""
    listed = centers.agg(F.collect_list(F.struct("cluster", as_doubles("vector").alias("c")))).scalar()
    ranked = F.transform(
        "__centers",
        lambda m: F.struct(squared_distance(as_doubles(vector), m["c"]).alias("distance"), m["cluster"].alias("cluster")),
    )
    nearest_center = df.withColumn("__centers", listed).withColumn("__best", F.array_min(ranked))
    return nearest_center.select(*df.columns, "__best.cluster", "__best.distance")


def start_rows(df: DataFrame, key: str, k: int, vector: str = "vector", seed: int = 1) -> list[list[float]]:
    """The vectors of ``k`` rows drawn by a hash of their keys, to start from; fewer if there are fewer rows."""
    drawn = df.select(draw(key, seed, "start").alias("__draw"), F.col(key).alias("__key"), as_doubles(vector).alias("v"))
    return [list(r["v"]) for r in drawn.orderBy("__draw", "__key").limit(k).collect()]


def _set_of_centers(spark, models: dict[int, list[list[float]]]) -> Column:
    """Centres of all models as one value, ``array<struct<model, centers>>``; bounded by the numbers of centres."""
    rows = local_rows(spark, sorted(models.items()), "model int, centers array<array<double>>")
    return rows.agg(F.collect_list(F.struct("model", "centers"))).scalar()


def _nearest_of_each(df: DataFrame, models: dict[int, list[list[float]]], vector: str) -> DataFrame:
    """``(v, model, distance, cluster)``: a row of ``df`` for each model, with its nearest centre; of equally near ones
    the first."""
    listed = df.select(as_doubles(vector).alias("v"), _set_of_centers(df.sparkSession, models).alias("models"))
    ranked = F.transform(
        "models",
        lambda m: F.struct(
            m["model"].alias("model"),
            F.array_min(F.transform(m["centers"], lambda c, i: F.struct(squared_distance(F.col("v"), c).alias("distance"), i.alias("cluster")))).alias("best"),
        ),
    )
    near = listed.select("v", F.explode(ranked).alias("near"))
    return near.select("v", "near.model", "near.best.distance", "near.best.cluster")


def lloyd(df: DataFrame, models: dict[int, list[list[float]]], size: int, vector: str = "vector", rounds: int = 10) -> DataFrame:
    """Lloyd's iterations of several models at once, from given centres, for a fixed number of rounds:
    ``(model, cluster, vector, n, cost)`` with the rows and the sum of squared distances of each final cluster.

    A round is one pass over ``df`` for all models: rows meet the centres, which the driver sends with the query, and
    means are partial before the shuffle. A cluster without rows keeps its centre. ``df`` is best a stored table.
    """
    means = [F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(size)]
    for _ in range(rounds):
        moved = _nearest_of_each(df, models, vector).groupBy("model", "cluster").agg(*means).collect()
        models = {m: list(centers) for m, centers in models.items()}
        for r in moved:
            models[r["model"]][r["cluster"]] = [r[f"m{i}"] for i in range(size)]
    sums = _nearest_of_each(df, models, vector).groupBy("model", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("cost"))
    rows = [(m, i, [float(x) for x in c]) for m, centers in sorted(models.items()) for i, c in enumerate(centers)]
    centers = local_rows(df.sparkSession, rows, "model int, cluster int, vector array<double>")
    return centers.join(sums, ["model", "cluster"], "left").na.fill({"n": 0, "cost": 0.0})


def lloyd_curve(df: DataFrame, key: str, size: int, ks=range(1, 21), vector: str = "vector", rounds: int = 10, seed: int = 1) -> DataFrame:
    """``(k, cost)``: within-class inertia for each number of clusters, all models in the same passes. The model of k
    clusters starts from the first k drawn rows."""
    start = start_rows(df, key, max(ks), vector, seed)
    found = lloyd(df, {k: start[:k] for k in ks}, size, vector, rounds)
    return found.groupBy(F.col("model").alias("k")).agg(F.sum("cost").alias("cost"))


def words_of_centers(centers: DataFrame, words: DataFrame, k: int = 10, digits: int | None = None) -> DataFrame:
    """``(cluster, rank, word, similarity)``: nearest words of each centre ``(cluster, vector)``, in one scan of the words."""
    return nearest_each(words, "word", centers, "cluster", k, digits=digits)


# --- trees ------------------------------------------------------------------------------------


@dataclass
class TreeResult:
    model: PipelineModel
    predictions: DataFrame
    features: list[str]

    @property
    def tree(self):
        return next(s for s in self.model.stages if hasattr(s, "toDebugString"))

    def text(self) -> str:
        return self.tree.toDebugString

    def importances(self) -> DataFrame:
        """``(feature, importance)`` of the features the tree uses."""
        found = self.tree.featureImportances
        rows = [(int(i), float(found[int(i)])) for i in range(found.size) if found[int(i)] > 0]
        table = local_rows(self.predictions.sparkSession, rows, "feature int, importance double")
        return table.orderBy(F.desc("importance"), "feature")


def classify_tree(
    df: DataFrame, inputs: list[str], label: str, key: str, seed: int, max_categories: int = 10,
    train_share: float = 0.7,
) -> TreeResult:
    """Decision tree for a label. The list of labels is that of all rows, in order, so that every test
    row is predicted and counted; a null label is an error. All else is fitted on the training part.

    Features with few distinct values are taken as categories. ``predictedLabel`` has the label back.
    """
    data = feature_vector(df.withColumn("__label", F.col(label).cast("string")), inputs, "__features")
    train, test = random_split(data.select(key, label, "__label", "__features"), key, seed, train_share)
    labels = StringIndexer(
        inputCol="__label", outputCol="indexedLabel", stringOrderType="alphabetAsc", handleInvalid="error"
    )
    kept = train.persist()
    try:
        label_model = labels.fit(data.select("__label"))
        stages = [
            label_model,
            VectorIndexer(inputCol="__features", outputCol="indexedFeatures", maxCategories=max_categories, handleInvalid="keep"),
            DecisionTreeClassifier(labelCol="indexedLabel", featuresCol="indexedFeatures", seed=seed, maxBins=max(32, max_categories + 1)),
            IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=label_model.labels),
        ]
        model = Pipeline(stages=stages).fit(kept)
    finally:
        kept.unpersist()
    predictions = model.transform(test).select(key, label, "indexedLabel", "prediction", "predictedLabel")
    return TreeResult(model, predictions, inputs)


def regress_tree(
    df: DataFrame, inputs: list[str], target: str, key: str, seed: int, max_categories: int = 60,
    max_bins: int = 64, min_per_node: int = 2, train_share: float = 0.7,
) -> TreeResult:
    """Decision tree for a number."""
    data = feature_vector(df, inputs, "__features").select(key, F.col(target).cast("double").alias(target), "__features")
    train, test = random_split(data.where(F.col(target).isNotNull()), key, seed, train_share)
    kept = train.persist()
    try:
        model = Pipeline(
            stages=[
                VectorIndexer(inputCol="__features", outputCol="indexedFeatures", maxCategories=max_categories, handleInvalid="keep"),
                DecisionTreeRegressor(
                    labelCol=target, featuresCol="indexedFeatures", maxBins=max_bins,
                    minInstancesPerNode=min_per_node, seed=seed,
                ),
            ]
        ).fit(kept)
    finally:
        kept.unpersist()
    return TreeResult(model, model.transform(test).select(key, target, "prediction"), inputs)


# --- evaluation -------------------------------------------------------------------------------


def confusion_matrix(df: DataFrame, label: str = "indexedLabel", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(df: DataFrame, label: str = "indexedLabel", prediction: str = "prediction", positive=1.0) -> DataFrame:
    """Accuracy, test error, and recall, precision and F of one class, in one pass."""
    y, p = F.col(label) == F.lit(positive), F.col(prediction) == F.lit(positive)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == F.col(prediction)).alias("right"),
        F.count_if(y & p).alias("tp"),
        F.count_if(y).alias("actual"),
        F.count_if(p).alias("predicted"),
    )
    zero = F.lit(0.0)
    return counts.select(
        F.try_divide("right", "n").alias("accuracy"),
        (1 - F.try_divide("right", "n")).alias("test_error"),
        F.coalesce(F.try_divide("tp", "actual"), zero).alias("recall"),
        F.coalesce(F.try_divide("tp", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("predicted")), zero).alias("f_measure"),
    )


def rmse(df: DataFrame, target: str, prediction: str | Column = "prediction") -> DataFrame:
    gap = F.col(target) - (F.col(prediction) if isinstance(prediction, str) else prediction)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))
