"""Classification metrics as aggregations: confusion counts, per-class report, F1, kappa, class weights.

Input rows: ``group columns``, ``y``, ``p``.  Every metric comes from one grouped count, so the shuffle carries at most
one row per (group, y, p) and task.  Divisions by zero give 0 (as a report shows them); kappa is null if undefined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    return df.where("y is not null").groupBy(*by, "y", "p").agg(F.count("*").alias("n"))


def class_report(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, label, precision, recall, f1, support`` over the union of labels seen in y or p."""
    cells = confusion(df, by)
    none = F.lit(0).cast("long")
    as_y = F.struct(F.col("y").alias("label"), F.col("n").alias("as_y"), none.alias("as_p"))
    as_p = F.struct(F.col("p").alias("label"), none.alias("as_y"), F.col("n").alias("as_p"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(*by, F.explode(F.array(as_y, as_p)).alias("s"), hit.alias("hit"))
    sums = sides.where("s.label is not null").groupBy(*by, F.col("s.label").alias("label")).agg(F.sum("s.as_y").alias("support"), F.sum("s.as_p").alias("predicted"), (F.sum("hit") / 2).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rated = sums.withColumns({"precision": ratio("tp", "predicted"), "recall": ratio("tp", "support")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rated.select(*by, "label", "precision", "recall", f1.alias("f1"), "support")


def full_report(df: DataFrame, by: list[str]) -> DataFrame:
    """``class_report`` with the rows ``accuracy`` (its value as f1), ``macro avg`` and ``weighted avg`` of each group."""
    report = class_report(df, by).withColumn("label", F.col("label").cast("string"))
    right = confusion(df, by).groupBy(*by).agg(F.sum("n").alias("support"), (F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).alias("f1"))
    none = F.lit(None).cast("double")
    accuracy = right.select(*by, F.lit("accuracy").alias("label"), none.alias("precision"), none.alias("recall"), "f1", "support")
    names = ("precision", "recall", "f1")
    macro = report.groupBy(*by).agg(*(F.avg(n).alias(n) for n in names), F.sum("support").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = report.groupBy(*by).agg(*((F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names), F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    return report.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def macro_f1(df: DataFrame, by: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Mean F1 over the labels seen, or over ``labels`` (``label``, and ``by`` where groups differ), where an unseen label
    counts as 0 and other labels don't count."""
    report = class_report(df, by)
    if labels is not None:
        if by and not set(by) <= set(labels.columns):
            labels = df.select(*by).distinct().join(F.broadcast(labels))
        report = labels.join(report, [*by, "label"], "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    return report.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_labels"))


def agreement(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, n_valid, n_invalid, agreement``: rows whose ``p`` is null are invalid and don't count for the agreement."""
    return df.where("y is not null").groupBy(*by).agg(
        F.count("p").alias("n_valid"), F.count_if(F.col("p").isNull()).alias("n_invalid"), F.avg((F.col("y") == F.col("p")).cast("int")).alias("agreement")
    )


def kappa(df: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, agreement, kappa`` of two raters ``y`` and ``p``; rows where either is null are left out."""
    cells = confusion(df.where("p is not null"), by)
    # a cell counts once for its row label and once for its column label
    sides = F.array(F.struct(F.col("y").alias("label"), F.col("n").alias("r"), F.lit(0).cast("long").alias("c")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("r"), F.col("n").alias("c")))
    same = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    labels = cells.select(*by, same.alias("same"), F.explode(sides).alias("s")).groupBy(*by, "s.label").agg(F.sum("s.r").alias("r"), F.sum("s.c").alias("c"), F.sum("same").alias("twice"))
    sums = labels.groupBy(*by).agg(F.sum("r").alias("n"), (F.sum("twice") / 2).alias("same"), F.sum(F.col("r") * F.col("c")).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return sums.select(*by, "n", po.alias("agreement"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def class_weights(df: DataFrame, by: list[str]) -> DataFrame:
    """Balanced weights N / (K * n) per class."""
    counts = df.where("y is not null").groupBy(*by, "y").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    return counts.withColumn("weight", F.sum("n").over(group) / (F.count("*").over(group) * F.col("n")))


def populated_weights(df: DataFrame, by: list[str], classes: DataFrame) -> DataFrame:
    """Balanced weights over the populated classes only.  ``classes``: ``by, label, populated``; an unpopulated class has
    weight 0, a populated one ``N / (K * max(n, 1))`` of the N rows and K classes that are populated."""
    counts = df.where("y is not null").groupBy(*by, F.col("y").alias("label")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    rows = F.broadcast(classes).join(counts, [*by, "label"], "left").select(*by, "label", "populated", n.alias("n"))
    group = Window.partitionBy(*by)
    total, k = F.sum(F.when(F.col("populated"), F.col("n")).otherwise(0)).over(group), F.count_if("populated").over(group)
    return rows.withColumn("weight", F.when(F.col("populated"), total / (k * F.greatest(F.col("n"), F.lit(1)))).otherwise(0.0))
