"""Free answers of a model to the classes of a task: tolerant parsing, fallback, populated classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velmira.functions.rules import CLASSES, TASKS, UNPOPULATED

# fixed values: usual answers and the class that each means, in the order in which they are tried
SYNONYMS = {
    "epilepsy_type": {
        "generalized": "Generalised",
        "generalised": "Generalised",
        "focal": "Focal",
        "combined focal and generalized": "Combined Focal and Generalised",
        "combined focal and generalised": "Combined Focal and Generalised",
        "combined": "Combined Focal and Generalised",
        "unknown": "Unknown",
    },
    "seizure_type": {
        "focal": "Focal",
        "focal onset": "Focal",
        "generalized": "Generalised",
        "generalised": "Generalised",
        "generalized onset": "Generalised",
        "unknown": "Unknown",
        "unknown onset": "Unknown",
        "unclassified": "Unclassified",
    },
    "ez_localization": {
        "temporal": "Temporal",
        "extratemporal": "Extratemporal",
        "extra-temporal": "Extratemporal",
        "extra temporal": "Extratemporal",
        "frontal": "Extratemporal",
        "parietal": "Extratemporal",
        "occipital": "Extratemporal",
        "insular": "Extratemporal",
        "multifocal": "Multifocal",
        "multi-focal": "Multifocal",
        "bilateral": "Multifocal",
        "hemispheric": "Hemispheric",
        "unknown": "Unknown",
        "non-localising": "Unknown",
        "non-localizing": "Unknown",
    },
    "aed_response": {
        "drug-resistant": "drug-resistant",
        "drug resistant": "drug-resistant",
        "drug-refractory": "drug-resistant",
        "refractory": "drug-resistant",
        "drug-responsive": "drug-responsive",
        "drug responsive": "drug-responsive",
        "responsive": "drug-responsive",
        "seizure-free": "drug-responsive",
        "seizure free": "drug-responsive",
        "unspecified": "unspecified",
        "unknown": "unspecified",
    },
    "surgery_outcome": {
        "seizure-free": "Seizure-free",
        "seizure free": "Seizure-free",
        "engel i": "Seizure-free",
        "engel 1": "Seizure-free",
        "improved": "Improved",
        "engel ii": "Improved",
        "engel iii": "Improved",
        "no improvement": "No improvement",
        "engel iv": "No improvement",
        "not applicable": "Not applicable",
        "no surgery": "Not applicable",
    },
    "status_epilepticus": {
        "convulsive se": "Convulsive SE",
        "gcse": "Convulsive SE",
        "non-convulsive se": "Non-convulsive SE",
        "ncse": "Non-convulsive SE",
        "refractory se": "Refractory SE",
        "rse": "Refractory SE",
        "none": "None",
        "no se": "None",
        "unknown": "Unknown",
    },
}


def plain(text: Column) -> Column:
    """Lower case, only letters, digits, blanks and hyphens; trimmed before that."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"[^\p{L}\p{N} -]", ""))


def _known(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum() or c in " -")


def answer_class(task: str, raw: Column, norm: Column) -> Column:
    """The class that an answer means, or null: the very name, a usual answer, a class name inside it (in the order of the
    classes), a usual answer inside it.  ``norm`` is ``plain(raw)``."""
    if task not in TASKS:
        raise KeyError(f"unknown task: {task}")
    case = F.when(raw.isNull() | (raw == ""), F.lit(None).cast("string")).when(raw.isin(*CLASSES[task]), raw)
    for usual, meant in SYNONYMS[task].items():
        case = case.when(norm == _known(usual), meant)
    for name in CLASSES[task]:
        case = case.when(norm.contains(_known(name)), name)
    for usual, meant in SYNONYMS[task].items():
        case = case.when(norm.contains(_known(usual)), meant)
    return case


def with_answers(df: DataFrame, task: str, raw: str, name: str = "answer") -> DataFrame:
    """``df`` and the class of the answer ``raw`` for the task that the column ``task`` names."""
    held = df.withColumn("__plain", plain(F.col(raw)))
    out = F.lit(None).cast("string")
    for one in TASKS:
        out = F.when(F.col(task) == one, answer_class(one, F.col(raw), F.col("__plain"))).otherwise(out)
    return held.withColumn(name, out).drop("__plain")


def populated(task: str) -> list[str]:
    return [c for c in CLASSES[task] if c not in UNPOPULATED.get(task, ())]


def class_table(spark: SparkSession) -> DataFrame:
    """``task, label, label_id, populated``: every class of every task (a fixed table)."""
    rows = [(t, c, i, c in populated(t)) for t in TASKS for i, c in enumerate(CLASSES[t])]
    return spark.createDataFrame(rows, "task string, label string, label_id int, populated boolean")


def with_fallback(df: DataFrame, task: str, answer: str, only_populated: bool = False) -> DataFrame:
    """``df`` with ``label_id`` and ``invalid``: an answer that is no class (with ``only_populated``: no populated one) is
    invalid and gets the smallest id of the classes that count."""
    classes = class_table(df.sparkSession)
    counted = classes.where("populated") if only_populated else classes
    least = counted.groupBy("task").agg(F.min("label_id").alias("__least"))
    ids = counted.select(F.col("task").alias(task), F.col("label").alias(answer), "label_id")
    joined = df.join(F.broadcast(ids), [task, answer], "left").join(F.broadcast(least.withColumnRenamed("task", task)), task, "left")
    return joined.withColumns({"invalid": F.col("label_id").isNull(), "label_id": F.coalesce("label_id", "__least")}).drop("__least")
