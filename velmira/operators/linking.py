"""Panels to captions, profiles and features; chunk results put together; gates on documents and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velmira.functions.text import path_hash


def with_details(panels: DataFrame, details: DataFrame, key: str, order: str) -> DataFrame:
    """Left lookup of ``details`` by ``key``; of several details of one key the last in ``order`` counts."""
    rest = [c for c in details.columns if c not in (key, order)]
    last = details.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__d"))
    return panels.join(last, key, "left").select(*panels.columns, *(F.col(f"__d.{c}").alias(c) for c in rest))


def back_to_rows(results: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join of results to the first row of their key in ``order``."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r"))
    return results.join(first, key).select(*results.columns, *(F.col(f"__r.{c}").alias(c) for c in rest))


def linked_profiles(panels: DataFrame, profiles: DataFrame, document: str = "paper") -> DataFrame:
    """``panels`` with ``n_profiles, first_ref`` of the profiles of the same document that refer to the panel's figure.

    ``panels``: ``document, figure_no``; ``profiles``: ``document, patient_ref, figure_refs``.  References are counted per
    document and figure before the join, so a document of very many profiles adds one row per figure.
    """
    number = F.regexp_extract("ref", r"(\d+)", 1)
    refs = profiles.select(document, "patient_ref", F.explode("figure_refs").alias("ref")).select(document, "patient_ref", number.alias("figure_no")).where("figure_no <> ''")
    counted = refs.groupBy(document, "figure_no").agg(F.count_distinct("patient_ref").alias("n_profiles"), F.min("patient_ref").alias("first_ref"))
    return panels.join(counted, [document, "figure_no"], "left").withColumn("n_profiles", F.coalesce("n_profiles", F.lit(0)))


def with_features(images: DataFrame, features: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """``images`` with the feature row of the hash of their path, where there is one."""
    return images.withColumn(digest, path_hash(F.col(path))).join(features, digest, "left")


def merged_chunks(chunks: DataFrame, key: str, chunk: str, flag: str, kind: str, items: str) -> DataFrame:
    """Results of the chunks of one document as one: ``key, flag`` (any), ``kind`` (the last that isn't empty), ``items``
    (all, in the order of the chunks)."""
    held = F.when(F.length(kind) > 0, F.struct(F.col(chunk), F.col(kind).alias("k")))
    every = F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("at"), F.col(items).alias("i"))))
    return chunks.groupBy(key).agg(
        F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag), F.max(held)["k"].alias(kind), F.flatten(F.transform(every, lambda x: x["i"])).alias(items)
    )


def gate(kind: Column, accepted: list[str], rejected: list[str], article: Column) -> Column:
    """Status of a document: ``rejected`` by the type of the article, ``other`` by its kind, or ``accepted``.  The type is
    asked first, because it costs nothing."""
    return F.when(F.lower(article).isin(*rejected), "rejected").when(~F.coalesce(F.lower(F.trim(kind)), F.lit("")).isin(*accepted), "other").otherwise("accepted")


def documents_with_quotes(facts: DataFrame, document: str, quote: str, least: int = 15) -> DataFrame:
    """``document, n_quotes``: the documents that hold a quote of ``least`` characters or more."""
    fine = F.length(F.regexp_replace(F.col(quote), r"^\s+|\s+$", "")) >= least
    return facts.groupBy(document).agg(F.count_if(fine).alias("n_quotes")).where("n_quotes > 0")


def ranges(ref: Column) -> Column:
    """The numbers that a reference such as "patients 2-5" or "cases 1, 3 and 4" names; at most 200 of a range."""
    t = F.regexp_replace(F.lower(ref), r"[–—]", "-")
    bounds = F.regexp_extract_all(t, F.lit(r"(\d{1,4})\s*(?:-|to)\s*(\d{1,4})"), F.lit(0))
    def span(x: Column) -> Column:
        low, high = F.regexp_extract(x, r"^(\d+)", 1).cast("int"), F.regexp_extract(x, r"(\d+)$", 1).cast("int")
        return F.when((high >= low) & (high - low < 200), F.sequence(low, F.greatest(low, high))).otherwise(F.array(low, high))
    single = F.transform(F.regexp_extract_all(F.regexp_replace(t, r"\d{1,4}\s*(?:-|to)\s*\d{1,4}", " "), F.lit(r"\d{1,4}"), F.lit(0)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(bounds, span)), single)))


def range_links(facts: DataFrame, persons: DataFrame, document: str, ref: str, number: str) -> DataFrame:
    """Facts about ranges of persons to each person that the range names: ``facts`` and the columns of ``persons``."""
    told = facts.withColumn(number, F.explode(ranges(F.col(ref))))
    return told.join(persons, [document, number])
