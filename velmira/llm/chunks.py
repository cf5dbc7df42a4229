"""Problem 1, by content-defined chunks: what share of each evaluation record stands in the training split.

Normalised texts (words, see textops.py) are cut where a rolling hash of three words is least among ``WINDOW``
neighbours, so equal stretches are cut alike wherever they stand.  Chunk digests of the evaluation folds are joined to
those of the train fold, and the lengths of the shared chunks are summed into a fraction per record and field.

A chunk that stands in very many evaluation texts is looked up by broadcast, the others by shuffle; the train side has
one row per digest, so no key is ever gathered.

Edge cases: null texts and texts without words have no row; a record that stands in train and in another fold is compared
with the other train records only; a chunk that comes twice in a text counts with both its lengths; texts are compared
within their field; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velmira.functions.ids import squeezed
from velmira.llm import textops as X
from velmira.llm.overlap import FIELDS, folds, marked_texts
from velmira.session import cut

WINDOW = 8
HOT = 20_000
BROADCAST_CHUNKS = 100_000


def cut_chunks(words: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, length in words, row) of the chunks of every text.  A chunk begins at the first word of a text and wherever
    the rolling hash is least; the digest is a polynomial of its words."""
    if len(words) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams, go = X.grams(words, offsets, 3)
    place = X.minima(grams, go, window)
    row = X.row_index(go)[place]
    starts = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], place - go[row] + offsets[row])))
    length = np.diff(np.append(starts, len(words)))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    # sums of words times powers of their place inside the chunk
    inside = np.arange(len(words)) - np.repeat(starts, length)
    powers = np.full(int(length.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(X.mix(words) * powers[inside])))
    return X.mix(total[starts + length] - total[starts] + length.astype(np.uint64)), length, rows


def _chunk_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest, length, row = cut_chunks(*X.word_hashes(batch.column(1).to_pylist()))
        uid = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        salt = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        side = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int32)
        digest = X.mix(digest ^ X.mix(salt)[row])
        yield pa.RecordBatch.from_arrays([pa.array(uid[row]), pa.array(side[row]), pa.array(X.signed(digest)), pa.array(length.astype(np.int32))], ["uid", "side", "digest", "words"])


def fractions(patients: DataFrame, manifest: DataFrame) -> DataFrame:
    """p1_overlap: ``record_id, field, n_words, shared_words, fraction`` of every text of the evaluation folds."""
    texts = marked_texts(patients, manifest)
    chunks = cut(texts.select("uid", "body", "salt", "side").mapInArrow(_chunk_stage, "uid bigint, side int, digest bigint, words int"))
    evaluated = chunks.where("(side & 2) > 0")
    # least and greatest uid that hold the chunk in train: one of them is another text's unless both are the own
    train = chunks.where("(side & 1) > 0").groupBy("digest").agg(F.min("uid").alias("low"), F.max("uid").alias("high"))
    hot = cut(evaluated.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).select("digest"))
    n_hot = hot.count()
    if 0 < n_hot <= BROADCAST_CHUNKS:
        known = cut(train.join(F.broadcast(hot), "digest"))
        rest = evaluated.join(F.broadcast(hot), "digest", "left_anti").join(train, "digest", "left")
        joined = rest.unionByName(evaluated.join(F.broadcast(hot), "digest", "left_semi").join(F.broadcast(known), "digest", "left"))
    else:
        joined = evaluated.join(train, "digest", "left")
    shared = F.coalesce((F.col("low") != F.col("uid")) | (F.col("high") != F.col("uid")), F.lit(False))
    sums = joined.groupBy("uid").agg(F.sum("words").alias("n_words"), F.sum(F.when(shared, F.col("words")).otherwise(0)).alias("shared_words"))
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("uid") % len(FIELDS) + 1).cast("int"))
    return sums.select(F.expr(f"uid div {len(FIELDS)}").alias("record_id"), field.alias("field"), "n_words", "shared_words", (F.col("shared_words") / F.col("n_words")).alias("fraction"))


def report(patients: DataFrame, manifest: DataFrame) -> DataFrame:
    """``fold, source, field, n_texts, mean_fraction, n_half, n_whole``: evaluation texts, and how many of them stand to a
    half or wholly in train."""
    fold = folds(manifest).where("not is_train").select("record_id", "fold")
    source = patients.select("record_id", squeezed(F.col("source")).alias("source"))
    rows = fractions(patients, manifest).join(fold, "record_id").join(source, "record_id")
    return rows.groupBy("fold", "source", "field").agg(F.count("*").alias("n_texts"), F.round(F.avg("fraction"), 6).alias("mean_fraction"), F.count_if(F.col("fraction") >= 0.5).alias("n_half"), F.count_if(F.col("fraction") >= 1).alias("n_whole"))
