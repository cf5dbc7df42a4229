"""Problem 1: the same or nearly the same record on both sides of a split.

Method: set-similarity join of the texts' word triples across the split.  The prefix filter of candidates.py gives every
pair that may be alike, and these are checked exactly; no pair is left out.

Parameters: likeness 0.6 over runs of three words, texts of at least 12 words.

Edge cases: a null text, or one below 12 words, meets nothing; copies of one text are collapsed before the search
and expanded in the result; repeated manifest rows count once; a record listed in train and elsewhere stands on
both sides, but never pairs with itself; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velmira.functions.ids import paper_number, squeezed
from velmira.llm.candidates import BROADCAST_TEXTS, copied_texts, overlapping_pairs, text_key, triple_levels, verified, without_copies
from velmira.session import cut

LIKENESS = 0.6
LEAST_WORDS = 12
SKETCH_BITS = 256
FIELDS = ("semiology_text", "mri_report_text")


def folds(manifest: DataFrame) -> DataFrame:
    """``record_id, fold, is_train``: one row per record and normalised fold."""
    fold = squeezed(F.col("fold"))
    return (
        manifest.select("record_id", fold.alias("fold"))
        .where("record_id is not null and fold <> ''")
        .distinct()
        .withColumn("is_train", F.col("fold") == "train")
    )


def sides_of(manifest: DataFrame) -> DataFrame:
    """``record, side``: 1 for train, 2 for another fold, 3 for both."""
    side = F.max(F.when(F.col("is_train"), 1).otherwise(0)) + F.max(F.when(F.col("is_train"), 0).otherwise(2))
    return folds(manifest).groupBy(F.col("record_id").alias("record")).agg(side.cast("int").alias("side"))


def _texts(patients: DataFrame, *keep: str) -> DataFrame:
    """One row per record and non-null text; ``uid`` tells record and field apart."""
    rows = F.array(
        *(F.struct((F.col("record_id") * len(FIELDS) + i).alias("uid"), F.col(f).alias("body"), F.lit(i + 1).cast("long").alias("salt")) for i, f in enumerate(FIELDS))
    )
    return patients.select(*keep, F.inline(rows)).where("uid is not null and length(body) > 0")


def _record(uid: str) -> Column:
    return F.expr(f"{uid} div {len(FIELDS)}")


def marked_texts(patients: DataFrame, manifest: DataFrame) -> DataFrame:
    """``uid, body, salt, side`` of the texts of records that have a fold: 1 train, 2 another one, 3 both."""
    return _texts(patients.select("record_id", *FIELDS).join(sides_of(manifest).withColumnRenamed("record", "record_id"), "record_id"), "side")


def text_links(patients: DataFrame, manifest: DataFrame, likeness: float = LIKENESS) -> tuple[DataFrame, DataFrame | None]:
    """(``a, b, likeness``: like texts across the split by uid; ``uid, member``: rows of the texts that stand in many
    rows, which are searched as their first row only, or None if there is no such text)."""
    raw, marked = _texts(patients), marked_texts(patients, manifest)
    many, n_many = copied_texts(raw)
    members = None
    if n_many:
        # all rows of these texts that have a fold, and the sides that they stand on together
        first = many.select("text_key", "first_uid")
        rows = raw.select("uid", text_key().alias("text_key"))
        rows = cut(rows.join(F.broadcast(first) if n_many <= BROADCAST_TEXTS else first, "text_key").join(sides_of(manifest), _record("uid") == F.col("record")).select("text_key", "uid", "side"))
        sided = rows.groupBy("text_key").agg(F.min("uid").alias("first_uid"), F.bit_or("side").alias("side"))
        many = cut(sided)
        marked = without_copies(marked, many, n_many)
        members = cut(many.select("text_key", F.col("first_uid").alias("uid")).join(rows.select("text_key", F.col("uid").alias("member")), "text_key").select("uid", "member"))
    pairs = cut(overlapping_pairs(marked, likeness, LEAST_WORDS, triple_levels(raw), SKETCH_BITS, n_texts=len(FIELDS) * patients.count()))
    return verified(pairs, raw, likeness), members


def like_records(patients: DataFrame, manifest: DataFrame) -> DataFrame:
    """``x, y``: records with a like text, in one order or the other; not yet sorted into the sides of the split."""
    links, members = text_links(patients, manifest)
    links = links.select("a", "b")
    if members is not None:
        # a text in many rows is like itself, if it is long enough
        words = F.size(F.regexp_extract_all(F.lower("body"), F.lit("[a-z0-9]+"), F.lit(0)))
        itself = _texts(patients).join(members.select("uid").distinct(), "uid").where(words >= LEAST_WORDS).select(F.col("uid").alias("a"), F.col("uid").alias("b"))
        links = cut(links.union(itself))
        for end in ("a", "b"):
            rows = members.select(F.col("uid").alias(end), F.col("member"))
            links = links.join(rows, end, "left").withColumn(end, F.coalesce("member", end)).drop("member")
    return links.select(_record("a").alias("x"), _record("b").alias("y")).where("x <> y")


def found(patients: DataFrame, manifest: DataFrame) -> DataFrame:
    """p1_found: ``id_a, id_b`` (smaller first) of rows across the split with the same patient or a like text."""
    sides = cut(sides_of(manifest))
    like = cut(like_records(patients, manifest).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    end = lambda r, s: sides.select(F.col("record").alias(r), F.col("side").alias(s))
    across = like.join(end("x", "side_x"), "x").join(end("y", "side_y"), "y").where("((side_x & 1) > 0 and (side_y & 2) > 0) or ((side_x & 2) > 0 and (side_y & 1) > 0)")
    people = (
        patients.select("record_id", paper_number(F.col("pmc_id")).alias("paper"), "patient_num")
        .where("paper is not null and patient_num is not null and record_id is not null")
        .join(sides.withColumnRenamed("record", "record_id"), "record_id")
    )
    t = people.where("(side & 1) > 0").select("paper", "patient_num", F.col("record_id").alias("t"))
    e = people.where("(side & 2) > 0").select("paper", "patient_num", F.col("record_id").alias("e"))
    same_patient = t.join(e, ["paper", "patient_num"]).where("t <> e").select(F.least("t", "e").alias("x"), F.greatest("t", "e").alias("y"))
    return across.select("x", "y").union(same_patient).distinct().select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))


def report(patients: DataFrame, manifest: DataFrame) -> DataFrame:
    """Counts of cross-split pairs per evaluation fold and source of the evaluation record."""
    pairs = found(patients, manifest)
    fold = folds(manifest)
    source = patients.select("record_id", squeezed(F.col("source")).alias("source"))
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("record_id"), "id_a", "id_b")
    evaluated = ends.join(fold.where("not is_train"), "record_id").join(source, "record_id")
    return evaluated.groupBy("fold", "source").agg(
        F.count("*").alias("n_pairs"), F.count_distinct("record_id").alias("n_records")
    )
