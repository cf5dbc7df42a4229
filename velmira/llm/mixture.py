"""Problem 9: mixing sources to target weights.

Method: Sainte-Laguë apportionment.  Sizes are tokens of the public BPE vocabulary (bpe.py).  Documents of a source
fall into shards by a seeded hash, as many as the source's own tokens need, and inside a shard into blocks of nearly equal
tokens; blocks are small enough that the smallest source still has ``LEAST_BLOCKS``.  Blocks are allotted to sources by the
highest quotients of share over 1, 3, 5, ..., then a source's blocks to its shards the same way by shard size.  Inside a
shard, the tokens of its quota are taken in seeded order of the blocks, all of them once before any of them twice.

The total is the largest at which no source needs more than its ``max_repeats`` passes.  Shares of listed sources
without tokens go to the others in proportion, and are reported as not reached.  Documents without a source, of a
source that isn't listed, or without tokens are not in the mixture.  Only the table of targets (one row per listed
source) reaches the driver; a shard holds about ``SHARD_TOKENS`` tokens, so no task holds the documents of a source.
Empty tables give an empty mixture.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velmira.llm.bpe import counted
from velmira.session import cut

BLOCK_TOKENS = 2048
LEAST_BLOCKS = 64  # of a source, and of a shard
SHARD_TOKENS = 4_000_000
SEED = 42


def apportion(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Laguë: seats to the highest quotients w/1, w/3, w/5, ...; equal quotients go to the earlier entry.

    A capped entry takes no more than its cap, the rest goes on among the others.
    """
    weights = np.asarray(weights, float)
    caps = np.full(len(weights), 1 << 50) if caps is None else np.asarray(caps, np.int64)
    seats = int(min(seats, caps[weights > 0].sum())) if (weights > 0).any() else 0
    if seats <= 0:
        return np.zeros(len(weights), np.int64)
    # seats won at price p: quotients w/(2k+1) >= p
    won = lambda p: np.where(weights > 0, np.minimum(np.floor((weights / p + 1) / 2), caps), 0).astype(np.int64)
    low, high = 1e-18, weights.max() * 1.000001
    for _ in range(200):
        middle = (low * high) ** 0.5
        if won(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    seat = won(high)
    while seat.sum() < seats:
        quotient = np.where(seat < caps, weights / (2 * seat + 1), -1.0)
        seat[int(np.argmax(quotient))] += 1
    return seat


def _shard_quotas(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("shard").reset_index(drop=True)
    blocks = group["blocks"].to_numpy()
    quota = apportion(blocks.astype(float), int(group["quota"].iloc[0]), blocks * int(group["max_repeats"].iloc[0]))
    return pd.DataFrame({"source": group["source"], "shard": group["shard"], "shard_quota": quota})


def wanted_sources(targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats`` of the listed sources that may be in the mixture."""
    return targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )


def blocks_of(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, n_tokens, shard, block, blocks, size``: the documents of listed sources in seeded order, cut into
    blocks per shard (``blocks`` and ``size`` in tokens are the shard's)."""
    listed = wanted_sources(targets).select("source")
    sized = cut(counted(documents.join(F.broadcast(listed), "source", "left_semi"), "text", keep=("doc_id", "source")).where("n_tokens > 0"))
    sums = cut(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    least = sums.agg(F.min("tokens")).first()[0] or 0
    unit = max(1, min(block_tokens, least // LEAST_BLOCKS))
    shards = F.greatest(F.lit(1), F.floor(F.col("tokens") / max(shard_tokens, LEAST_BLOCKS * unit)))
    placed = sized.join(F.broadcast(sums.select("source", shards.alias("shards"))), "source")
    placed = placed.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("shard", F.pmod("h", F.col("shards"))).drop("shards")
    shard = Window.partitionBy("source", "shard")
    running = shard.orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns({"end": F.sum("n_tokens").over(running), "size": F.sum("n_tokens").over(shard)})
    placed = placed.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("size") / unit)).cast("long"))
    middle = F.col("end") - F.col("n_tokens") / 2
    return placed.withColumn("block", F.least(F.floor(middle * F.col("blocks") / F.col("size")), F.col("blocks") - 1)).select(
        "doc_id", "source", "n_tokens", "shard", "block", "blocks", "size"
    )


def mixture(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, source, copy, n_tokens``: one row per taken copy of a document, ``copy`` from 1."""
    spark = documents.sparkSession
    placed = cut(blocks_of(documents, targets, block_tokens, shard_tokens, seed))
    shards = placed.groupBy("source", "shard").agg(F.max("blocks").alias("blocks"), F.max("size").alias("size"))
    have = wanted_sources(targets).join(shards.groupBy("source").agg(F.sum("blocks").alias("available")), "source").orderBy("source").toPandas()
    empty = placed.where("false").select("doc_id", "source", F.lit(1).alias("copy"), "n_tokens")
    if have.empty:
        return empty
    share = have["target_share"].to_numpy() / have["target_share"].sum()
    caps = (have["available"] * have["max_repeats"]).to_numpy()
    have["quota"] = apportion(share, int(np.floor((caps / share).min())), caps)
    quotas = spark.createDataFrame(have[["source", "quota", "max_repeats"]].astype({"quota": "int64", "max_repeats": "int64"}))
    # rows of shards, not of documents: one per SHARD_TOKENS tokens of a source
    per_shard = shards.select("source", "shard", "blocks").join(F.broadcast(quotas), "source").groupBy("source").applyInPandas(_shard_quotas, "source string, shard bigint, shard_quota bigint")
    blocks = placed.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("tokens"), F.max("blocks").alias("blocks"), F.max("size").alias("size"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("source", "shard", "block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the quota's tokens: whole passes over the shard, then blocks in seeded order up to the rest
    due = F.col("shard_quota") * F.col("size") / F.col("blocks")
    taken = (
        blocks.withColumn("end", F.sum("tokens").over(order))
        .join(per_shard, ["source", "shard"])
        .join(F.broadcast(quotas.select("source", "max_repeats")), "source")
        .withColumn("passes", F.floor(due / F.col("size") + 1e-9))
        .withColumn("copies", F.least(F.col("passes") + F.when(F.col("end") - F.col("tokens") / 2 < due - F.col("passes") * F.col("size"), 1).otherwise(0), F.col("max_repeats")))
        .where("copies > 0")
        .select("source", "shard", "block", F.col("copies").cast("int").alias("copies"))
    )
    return placed.join(taken, ["source", "shard", "block"]).select(
        "doc_id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_tokens"
    )


def shares(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per listed source: ``source, target_share, max_repeats, n_docs, n_rows, n_tokens, reached_share, most_copies``."""
    mixed = mixture(documents, targets, block_tokens, seed, shard_tokens)
    sums = mixed.groupBy("source").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.max("copy").alias("most_copies")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    total = F.sum("n_tokens").over(Window.partitionBy())
    return (
        targets.select("source", "target_share", "max_repeats")
        .join(sums, "source", "left")
        .select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_rows"), zero("n_tokens"), F.coalesce(F.col("n_tokens") / total, F.lit(0.0)).alias("reached_share"), zero("most_copies"))
    )
