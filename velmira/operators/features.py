"""Feature vectors: mean pooling, blocks with availability flags, late fusion, masking, TF-IDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_pooled(vectors: DataFrame, by: str, vector: str, dim: int) -> DataFrame:
    """Mean vector per group, L2-normalised; partial sums per dimension, so no group is ever gathered."""
    sums = vectors.groupBy(by).agg(F.count(vector).alias("n"), *(F.sum(F.col(vector)[i].cast("double")).alias(f"__{i}") for i in range(dim)))
    mean = F.array(*(F.col(f"__{i}") / F.col("n") for i in range(dim)))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)) + 1e-9
    return sums.select(by, "n", mean.alias("mean")).select(by, "n", F.transform("mean", lambda x: x / norm).alias("vector"))


def block(vector: Column, dim: int) -> Column:
    """The vector, or zeros, and a last entry that tells which."""
    return F.concat(F.coalesce(vector, F.array_repeat(F.lit(0.0), dim)), F.array(vector.isNotNull().cast("double")))


def fused(logits: list[Column]) -> Column:
    """Mean of the logit vectors that are there; null if none is."""
    there = [F.when(x.isNotNull(), F.lit(1)).otherwise(0) for x in logits]
    count = sum(there[1:], there[0])
    total = None
    for x in logits:
        total = x if total is None else F.coalesce(F.zip_with(total, x, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))), total, x)
    return F.transform(total, lambda v: v / count)


def masked(logits: Column, populated: list[int]) -> Column:
    return F.transform(logits, lambda v, i: F.when(i.isin(populated), v).otherwise(F.lit(float("-inf"))))


def masked_mean(vectors: list[Column], missing: float = -1e9) -> Column:
    """Mean of score vectors over the same classes where a class that a vector doesn't reach counts as ``missing``; null
    vectors don't count."""
    longest = F.greatest(*(F.coalesce(F.size(v), F.lit(0)) for v in vectors)) if len(vectors) > 1 else F.size(vectors[0])
    padded = [F.when(v.isNotNull(), F.concat(v, F.array_repeat(F.lit(missing), longest - F.size(v)))) for v in vectors]
    there = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in vectors[1:]), F.when(vectors[0].isNotNull(), 1).otherwise(0))
    total = padded[0]
    for p in padded[1:]:
        total = F.coalesce(F.zip_with(total, p, lambda a, b: a + b), total, p)
    return F.transform(total, lambda v: v / there)


def sigmoid(values: Column) -> Column:
    return F.transform(values, lambda x: 1 / (1 + F.exp(-x)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def contributions(df: DataFrame, modalities: list[str]) -> DataFrame:
    """``n`` rows and the number of rows that have each of the modalities."""
    return df.agg(F.count("*").alias("n"), *(F.count(m).alias(m) for m in modalities))


def argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def tfidf(documents: DataFrame, key: str, text: str, least_df: int = 2) -> DataFrame:
    """``key, term, weight`` over words of two letters or more: tf * (ln((1+n)/(1+df)) + 1), rows L2-normalised."""
    words = documents.where(F.length(text) > 0).select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    n = documents.select(F.count("*").alias("n_docs"))
    raw = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def _grams(text: str) -> Column:
    """Words of two letters or more, and every two neighbours of them joined by a blank."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.flatten(F.transform(F.array(words), lambda w: F.concat(w, pairs(w))))


def tfidf_fit(train: DataFrame, text: str, max_features: int = 20_000, least_df: int = 2) -> DataFrame:
    """``term, idf`` of the ``max_features`` most frequent words and word pairs that ``least_df`` documents have; of equally
    frequent ones the first by name.  Null and empty documents count as documents."""
    held = train.where(F.length(text) > 0).select(_grams(text).alias("g"))
    marked = F.concat(
        F.transform("g", lambda t: F.struct(t.alias("term"), F.lit(1).alias("cf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct("g"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("cf"), F.lit(1).alias("df"))),
    )
    terms = held.select(F.inline(marked)).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")).where(F.col("df") >= least_df)
    best = terms.orderBy(F.desc("cf"), "term").limit(max_features)
    n = train.select(F.count("*").alias("n_docs"))
    return best.join(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def tfidf_transform(documents: DataFrame, vocabulary: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, weight`` of the terms of ``vocabulary`` (``tfidf_fit``): tf * idf, rows L2-normalised; ``key`` is unique.
    The vocabulary is bounded, so it is broadcast; a document is moved once, as text."""
    terms = documents.where(F.length(text) > 0).select(key, text).repartition(key).select(key, F.explode(_grams(text)).alias("term"))
    tf = terms.join(F.broadcast(vocabulary), "term").groupBy(key, "term", "idf").agg(F.count("*").alias("tf"))
    raw = tf.select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("w") / norm).alias("weight"))
