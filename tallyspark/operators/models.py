"""Models of samples from their features' expression: components, classifiers and mixtures, on Spark's own learners.

Expression is long, (sample, feature, x), with a draw as a further key where uncertainty is carried along; samples are
rows, so nothing of a size that grows with them is held by the driver.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(expression: DataFrame, keys: list[str], feature: str, value: str) -> DataFrame:
    """(keys, features): a dense vector per key in the order of the features' names; absent ones are 0."""
    names = expression.select(feature).distinct()
    grid = expression.select(*keys).distinct().crossJoin(names)  # samples by features, as dense vectors are
    cells = grid.join(expression.select(*keys, feature, value), [*keys, feature], "left").select(*keys, F.struct(feature, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x")).alias("c"))
    ordered = cells.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("c"))
    return ordered.select(*keys, array_to_vector(F.transform("c", lambda c: c["x"])).alias("features"))


def principal_components(rows: DataFrame, keys: list[str], k: int) -> tuple[DataFrame, object]:
    """(keys, z: array of k scores) and the fitted model, whose pc holds the loadings."""
    model = PCA(k=k, inputCol="features", outputCol="z").fit(rows)
    return model.transform(rows).select(*keys, vector_to_array("z").alias("z")), model


def _labelled(rows: DataFrame, label: str):
    index = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip").fit(rows)
    return index.transform(rows), index.labels


def _averaged(scored: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """(keys, class, p): probabilities averaged over draws."""
    names = F.array(*(F.lit(x) for x in labels))
    pairs = F.explode(F.arrays_zip(names.alias("class"), vector_to_array("probability").alias("p")))
    flat = scored.select(*keys, pairs.alias("c")).select(*keys, F.col("c.class").alias("class"), F.col("c.p").alias("p"))
    return flat.groupBy(*keys, "class").agg(F.avg("p").alias("p"))


def classify_logistic(train: DataFrame, test: DataFrame, keys: list[str], label: str, penalty: float = 0.001, rounds: int = 200) -> DataFrame:
    """(keys, class, p) for test rows by logistic regression with an L1 penalty; several rows of one key are draws."""
    rows, labels = _labelled(train, label)
    model = LogisticRegression(labelCol="label_index", regParam=penalty, elasticNetParam=1.0, maxIter=rounds, family="multinomial").fit(rows)
    return _averaged(model.transform(test), keys, labels)


def classify_forest(train: DataFrame, test: DataFrame, keys: list[str], label: str, trees: int = 200, seed: int = 0) -> DataFrame:
    """(keys, class, p) for test rows by a random forest; several rows of one key are draws."""
    rows, labels = _labelled(train, label)
    model = RandomForestClassifier(labelCol="label_index", numTrees=trees, featureSubsetStrategy="sqrt", seed=seed).fit(rows)
    return _averaged(model.transform(test), keys, labels)


def mixture(rows: DataFrame, keys: list[str], k: int, least: float = 1e-5, seed: int = 0) -> DataFrame:
    """(keys, component, p): memberships above `least` in a mixture of k normals."""
    scored = GaussianMixture(k=k, seed=seed, featuresCol="features", probabilityCol="probability").fit(rows).transform(rows)
    return scored.select(*keys, F.posexplode(vector_to_array("probability")).alias("component", "p")).where(F.col("p") > least)
