"""Problem 4: groups of near-duplicate records.

Method: set-relation skipping in an inverted index.  The index lists of word triples are sorted by set size, and
an entry meets only the stretch of its list with compatible sizes, found by position (index-level skipping).
The prefix filter of candidates.py gives every pair that may be alike; no pair is left out.

Answers are derived where a similar set's are known (answer-level skipping): every text has a *leader*, the first of the
texts that it may be like, and is checked against it first.  Two texts that are both like their common leader are in its
group whatever their own likeness is, so that pair needs no check; all other pairs are checked exactly.  The links that
hold are followed into groups.

Parameters: likeness 0.6 over runs of three words, texts of at least 50 words.

Edge cases: null parts are left out, a row without any part or below 50 words is in no group; a text in many rows
is searched once and its rows are listed after it; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velmira.llm import textops as X
from velmira.llm.candidates import BROADCAST_TEXTS, copied_texts, likeness_of_pairs, overlapping_pairs, text_key, triple_levels, wanted, without_copies
from velmira.llm.components import components
from velmira.session import cut

LIKENESS = 0.6
LEAST_WORDS = 50
GROUP_PAIRS = 20_000
_ROWS = 4_000  # rows of pairs and texts taken together
PARTS = ("semiology_text", "eeg_report_text", "demographics_notes")


def bodies(patients: DataFrame) -> DataFrame:
    return patients.where("record_id is not null").select(
        F.col("record_id").alias("uid"), F.concat_ws(" ", *PARTS).alias("body"), F.lit(0).cast("long").alias("salt")
    ).where("length(body) > 0")


def _grouped_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of whole groups (first column), as many at a time as make about ``_ROWS`` rows."""
    held: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        held = [h + c for h, c in zip(held, columns)] if held else columns
        if len(held[0]) >= _ROWS:
            cut_at = len(held[0]) - 1
            while cut_at > 0 and held[0][cut_at - 1] == held[0][-1]:
                cut_at -= 1
            if cut_at:
                yield [h[:cut_at] for h in held]
                held = [h[cut_at:] for h in held]
    if held and held[0]:
        yield held


def _link_stage(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kind, x, y, lead, body in _grouped_batches(batches):
            texts = {u: t for k, u, t in zip(kind, x, body) if k == 0}
            place = {u: i for i, u in enumerate(texts)}
            pairs = [(u, v, w) for k, u, v, w in zip(kind, x, y, lead) if k == 1]
            g, go = X.grams(*X.word_hashes(texts.values()), 3)
            alike = lambda rows: likeness_of_pairs(g, go, *(np.array([place[r[i]] for r in rows], np.int64) for i in (0, 1))) >= least - 1e-12
            # first every text against its leader, then the pairs that this leaves open
            first = sorted({(w, t) for u, v, w in pairs if w is not None for t in (u, v) if t != w})
            like = {r for r, ok in zip(first, alike(first)) if ok}
            known = lambda t, w: t == w or (w, t) in like
            rest = [(u, v) for u, v, w in pairs if w is None or (w not in (u, v) and not (known(u, w) and known(v, w)))]
            links = [*like, *(r for r, ok in zip(rest, alike(rest)) if ok)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in links], pa.int64()) for i in (0, 1)], ["src", "dst"])

    return run


def links_of(pairs: DataFrame, texts: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``src, dst``: links that tie the same groups as all pairs (``a < b``) of likeness ``least`` or more would.

    The pairs of a leader are checked together, so each of its texts is sent and taken apart once; a leader of more than
    ``GROUP_PAIRS`` pairs is spread over several tasks by the second text of the pair.
    """
    leaders = pairs.groupBy("b").agg(F.min("a").alias("lead"))
    led = pairs.join(leaders.withColumnRenamed("lead", "lead_b"), "b").join(leaders.select(F.col("b").alias("a"), F.col("lead").alias("lead_a")), "a", "left")
    common = F.coalesce("lead_a", "a") == F.col("lead_b")
    led = cut(led.select("a", "b", F.col("lead_b").alias("owner"), F.when(common, F.col("lead_b")).alias("lead")))
    heavy = cut(led.groupBy("owner").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_PAIRS).select("owner", F.ceil(F.col("n") / GROUP_PAIRS).alias("parts")))
    if heavy.isEmpty():
        grouped = led.withColumn("group", F.xxhash64("owner"))
    else:
        parts = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))
        grouped = led.join(heavy, "owner", "left").withColumn("group", F.xxhash64("owner", parts))
    needed = grouped.select("group", F.explode(F.array("a", "b", "lead")).alias("uid")).where("uid is not null").distinct()
    none = F.lit(None)
    sent = wanted(texts.select("uid", "body"), pairs).join(needed, "uid").select("group", F.lit(0).alias("kind"), F.col("uid").alias("x"), none.cast("long").alias("y"), none.cast("long").alias("lead"), "body")
    asked = grouped.select("group", F.lit(1).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), "lead", none.cast("string").alias("body"))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = sent.unionByName(asked).repartition(tasks, "group").sortWithinPartitions("group")
    return together.mapInArrow(_link_stage(least), "src bigint, dst bigint")


def found(patients: DataFrame) -> DataFrame:
    """p4_found: ``record_id, group_id`` of every row in a group of two or more."""
    raw = bodies(patients)
    many, n_many = copied_texts(raw)
    texts = without_copies(raw, many, n_many)
    pairs = cut(overlapping_pairs(texts, LIKENESS, LEAST_WORDS, triple_levels(raw), n_texts=patients.count()))
    links = cut(links_of(pairs, raw))
    classes = cut(components(links))
    listed = classes.select(F.col("node").alias("record_id"), F.col("component").alias("group_id"))
    if n_many == 0:
        return listed
    # texts in many rows: a class of their own if they are like no other, when they are long enough
    first = many.select("text_key", F.col("first_uid").alias("uid"))
    words = F.size(F.regexp_extract_all(F.lower("body"), F.lit("[a-z0-9]+"), F.lit(0)))
    few = n_many <= BROADCAST_TEXTS
    long = raw.join(F.broadcast(first) if few else first, "uid").where(words >= LEAST_WORDS).select("text_key", "uid")
    grouped = long.join(classes.select(F.col("node").alias("uid"), "component"), "uid", "left").select("text_key", F.coalesce("component", "uid").alias("group_id"))
    grouped = cut(grouped)
    copies = raw.select(F.col("uid").alias("record_id"), text_key().alias("text_key")).join(F.broadcast(grouped) if few else grouped, "text_key").select("record_id", "group_id")
    return listed.unionByName(copies).distinct()
