"""Classifiers on text and pooled features, by ``pyspark.ml``: fitted, scored and compared as tables.

A model is metric-level, not bit-level, equal to other implementations of the same loss.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velmira.operators import metrics
from velmira.operators.splits import stratified_sample


def balanced(train: DataFrame, label: str) -> DataFrame:
    """``train`` with the column ``weight``: N / (K * n) of the row's class.  One row per class is broadcast."""
    counts = train.groupBy(label).agg(F.count("*").alias("__n"))
    sums = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    weights = counts.join(F.broadcast(sums)).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return train.join(F.broadcast(weights), label)


def _regression(label: str, features: str, n: int) -> LogisticRegression:
    # the usual penalty of one over all rows, so it weighs 1 / n beside a mean loss
    return LogisticRegression(labelCol=label, featuresCol=features, weightCol="weight", maxIter=200, tol=1e-4, regParam=1.0 / max(n, 1))


def fit_text(train: DataFrame, text: str, label: str, max_features: int = 20_000, least_df: int = 2) -> PipelineModel:
    """TF-IDF of words and word pairs, L2-normalised, and a logistic regression with balanced classes.  ``label`` holds
    ids from 0; null texts count as empty ones."""
    rows = balanced(train.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), label).withColumn(text, F.coalesce(text, F.lit("")))
    stages = [
        RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="__words", outputCol="__pairs"),
        SQLTransformer(statement="SELECT *, concat(__words, __pairs) AS __terms FROM __THIS__"),
        CountVectorizer(inputCol="__terms", outputCol="__tf", vocabSize=max_features, minDF=float(least_df)),
        IDF(inputCol="__tf", outputCol="__tfidf"),
        Normalizer(inputCol="__tfidf", outputCol="__features"),
        _regression(label, "__features", rows.count()),
    ]
    return Pipeline(stages=stages).fit(rows)


def scored_text(model: PipelineModel, rows: DataFrame, text: str, label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep, y, p`` of the rows with a label."""
    held = rows.where(F.col(label).isNotNull()).withColumn(text, F.coalesce(text, F.lit("")))
    return model.transform(held).select(*keep, F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))


def fit_vectors(train: DataFrame, vector: Column, label: str):
    """Logistic regression with balanced classes on an array column; rows without a vector don't train."""
    rows = balanced(train.withColumn("__v", vector).where(F.col("__v").isNotNull() & F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double")), label)
    return _regression(label, "__f", rows.count()).fit(rows.withColumn("__f", array_to_vector(F.col("__v"))))


def ablation(train: DataFrame, test: DataFrame, regimes: dict[str, Column], label: str) -> DataFrame:
    """``regime, n_train, n_test, coverage, macro_f1``: one model per regime (a name and the array column that it sees).
    Rows that a regime has no vector for are skipped and lower its coverage."""
    spark = train.sparkSession
    out = []
    for name, vector in regimes.items():
        seen = train.where(vector.isNotNull()).count()
        if seen == 0:
            out.append((name, 0, 0, 0.0, None))
            continue
        model = fit_vectors(train, vector, label)
        held = test.where(F.col(label).isNotNull()).withColumn("__v", vector)
        scored = model.transform(held.where("__v is not null").withColumn("__f", array_to_vector(F.col("__v")))).select(F.col(label).cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
        n, every = scored.count(), held.count()
        f1 = metrics.macro_f1(scored, []).first() if n else None
        out.append((name, seen, n, n / every if every else 0.0, f1.macro_f1 if f1 else None))
    return spark.createDataFrame(out, "regime string, n_train bigint, n_test bigint, coverage double, macro_f1 double")


def clustered_sample(rows: DataFrame, key: str, vector: str, k: int, per_cluster: int, seed: int = 42) -> DataFrame:
    """``key, cluster``: at most ``per_cluster`` rows of each of k clusters, for review (a sampling operator)."""
    held = rows.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(held)
    return stratified_sample(model.transform(held).select(key, F.col("prediction").alias("cluster")), ["cluster"], key, per_cluster, seed)
