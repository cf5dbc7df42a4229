"""Wide table to task rows, label ids, folds, leak removal, stratified samples; entity merge and linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velmira.functions.rules import CLASSES, TASKS
from velmira.functions.text import canonical_person


def task_rows(patients: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, task, label, label_id``: one row per profile and task with a label of the vocabulary."""
    ids = F.create_map(*(x for t in TASKS for i, c in enumerate(CLASSES[t]) for x in (F.lit(f"{t}|{c}"), F.lit(i))))
    long = patients.select(*keep, F.expr("stack(6, " + ", ".join(f"'{t}', {t}_label" for t in TASKS) + ") as (task, label)"))
    return long.withColumn("label_id", F.try_element_at(ids, F.concat_ws("|", "task", "label"))).where("label is not null and label_id is not null")


def bucket(key: Column, seed: int = 42, of: int = 10) -> Column:
    """Engine-portable hash bucket: the same in every run and engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key, F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.lit(of))


def group_fold(key: Column, seed: int = 42) -> Column:
    """Nine in ten groups to train, one to test; all rows of a key go together."""
    return F.when(bucket(key, seed) == 0, "test").otherwise("train")


def without_leaks(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    return test.join(train.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def stratified_sample(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows per stratum in seeded hash order (a sampling operator: the limit is its purpose)."""
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def merged_entities(candidates: DataFrame) -> DataFrame:
    """Candidates of one document that name the same person become one entity.

    Columns pmc_id, seq, patient_ref, is_explicit, fact, quote, figure_ref.  Facts need a quote of 15 characters; an
    explicit name is preferred for display, then the earliest."""
    key = F.coalesce(canonical_person(F.col("patient_ref")), F.lit(""))
    fine = (F.length("quote") >= 15) & (F.length("fact") > 0)
    return candidates.withColumn("person", key).where("person <> ''").groupBy("pmc_id", "person").agg(
        F.min(F.struct((~F.col("is_explicit")).alias("x"), "seq", "patient_ref"))["patient_ref"].alias("display"),
        F.bool_or("is_explicit").alias("is_explicit"),
        F.count_distinct(F.when(fine, F.struct("fact", "quote"))).alias("n_facts"),
        F.sort_array(F.collect_set("figure_ref")).alias("figures"),
    )


def linked_figures(panels: DataFrame, profiles: DataFrame) -> DataFrame:
    """Panels to profiles of the same document by figure number: pmc_id, subfig_id, figure_no with pmc_id, patient_ref,
    figure_refs.  The first matching reference of a profile counts."""
    refs = profiles.select("pmc_id", "patient_ref", F.posexplode("figure_refs").alias("pos", "ref")).withColumn("figure_no", F.regexp_extract("ref", r"(\d+)", 1))
    met = panels.join(refs.where("figure_no <> ''"), ["pmc_id", "figure_no"])
    return met.groupBy("pmc_id", "subfig_id", "patient_ref").agg(F.min_by("ref", "pos").alias("figure_ref"))


#: Tiers that train under each regime; a tier that is trained on is not scored.
REGIMES = {"B": ("train",), "B_C": ("train", "bronze"), "B_C_D": ("train", "bronze", "expansion")}


def regime_rows(rows: DataFrame, tier: str) -> DataFrame:
    """``regime`` and the rows that train under it: the union of its tiers, by one pass instead of a union per regime."""
    member = F.array(*(F.when(F.col(tier).isin(*tiers), F.lit(name)) for name, tiers in REGIMES.items()))
    return rows.withColumn("regime", F.explode(F.filter(member, lambda x: x.isNotNull())))


def scored_rows(rows: DataFrame, tier: str) -> DataFrame:
    """``regime`` and the rows that are scored under it: those of tiers that it doesn't train on."""
    member = F.array(*(F.when(~F.col(tier).isin(*tiers), F.lit(name)) for name, tiers in REGIMES.items()))
    return rows.withColumn("regime", F.explode(F.filter(member, lambda x: x.isNotNull())))


def head_sizes(parts: list[DataFrame], by: list[str], label_id: str) -> DataFrame:
    """``by, n_classes``: outputs that hold every label of any of the parts (the greatest id and one more)."""
    most = [p.groupBy(*by).agg(F.max(label_id).alias("m")) for p in parts]
    every = most[0]
    for m in most[1:]:
        every = every.unionByName(m)
    return every.groupBy(*by).agg((F.max("m") + 1).alias("n_classes"))


def support(train: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """``by, n, status``: ``skipped`` where fewer than ``least`` rows train."""
    return train.groupBy(*by).agg(F.count("*").alias("n")).withColumn("status", F.when(F.col("n") < least, "skipped").otherwise("trained"))


def wholly_merged(candidates: DataFrame) -> DataFrame:
    """``merged_entities`` with the facts themselves, in the order in which they were found: the facts of a person are
    bounded by its document, not by the corpus."""
    key = F.coalesce(canonical_person(F.col("patient_ref")), F.lit(""))
    fine = candidates.withColumn("person", key).where("person <> '' and length(quote) >= 15 and length(fact) > 0")
    once = fine.groupBy("pmc_id", "person", "fact", "quote").agg(F.min("seq").alias("seq"))
    facts = once.groupBy("pmc_id", "person").agg(F.array_sort(F.collect_list(F.struct("seq", "fact", "quote"))).alias("f"))
    kept = facts.select("pmc_id", "person", F.transform("f", lambda x: F.struct(x["fact"].alias("fact"), x["quote"].alias("quote"))).alias("facts"))
    return merged_entities(candidates).join(kept, ["pmc_id", "person"], "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<struct<fact:string,quote:string>>")))
