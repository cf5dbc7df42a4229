"""Problem 7: splits that keep related records together.

Method: frontier breadth-first components (components.py) over papers; a paper's records are one node, however many
there are, and patient links tie papers.  Components are ordered by a seeded hash and cut at the wanted shares; the few that
are larger than ``LARGE`` are placed before, because one near a cut would miss the shares by its size.

Edge cases: rows with a null or unreadable ``pmc_id`` are in no group and are assigned on their own; links with an
end that isn't in patients, or whose relation isn't "same patient", tie nothing; repeated links count once; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velmira.functions.ids import paper_number, squeezed
from velmira.llm.components import components
from velmira.session import cut

LARGE = 0.005
RANGE_GROUPS = 20_000
SHARES = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def papers_of(patients: DataFrame) -> DataFrame:
    return patients.select("record_id", paper_number(F.col("pmc_id")).alias("paper"), "patient_num")


def tied_papers(patients: DataFrame, links: DataFrame) -> DataFrame:
    """``src, dst``: papers tied by a link that says same patient and whose both ends are in patients."""
    people = papers_of(patients).where("paper is not null and patient_num is not null").select("paper", "patient_num").distinct()
    same = links.where(squeezed(F.col("relation")) == "same_patient").select(
        paper_number(F.col("pmc_id_a")).alias("src"), F.col("patient_num_a").alias("num_a"),
        paper_number(F.col("pmc_id_b")).alias("dst"), F.col("patient_num_b").alias("num_b"),
    )
    end = lambda p, n: people.select(F.col("paper").alias(p), F.col("patient_num").alias(n))
    return same.join(end("src", "num_a"), ["src", "num_a"], "left_semi").join(end("dst", "num_b"), ["dst", "num_b"], "left_semi").select("src", "dst").where("src <> dst").distinct()


def group_keys(patients: DataFrame, links: DataFrame) -> DataFrame:
    """``paper, group_key`` of every paper that is tied to another one."""
    return components(cut(tied_papers(patients, links))).select(F.col("node").alias("paper"), F.col("component").alias("group_key"))


def grouped(patients: DataFrame, links: DataFrame) -> DataFrame:
    """``record_id, group_key``: null for rows without a paper number."""
    tied = cut(group_keys(patients, links))
    return papers_of(patients).join(tied, "paper", "left").select("record_id", F.coalesce("group_key", "paper").alias("group_key"))


def found(patients: DataFrame, links: DataFrame, manifest: DataFrame) -> DataFrame:
    """p7_found: ``record_id, group_key`` of every row of each group that stands in more than one fold."""
    rows = grouped(patients, links).where("group_key is not null")
    fold = manifest.select("record_id", squeezed(F.col("fold")).alias("fold")).where("fold <> ''").distinct()
    spread = (
        rows.join(fold, "record_id")
        .groupBy("group_key")
        .agg(F.min("fold").alias("least"), F.max("fold").alias("most"))
        .where("least <> most")
        .select("group_key")
    )
    return rows.join(spread, "group_key", "left_semi").select("record_id", "group_key")


def splits(patients: DataFrame, links: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, seed: int = 42) -> DataFrame:
    """``record_id, group_key, split``.  Groups of at least ``LARGE`` of all rows (so at most 1 / ``LARGE`` of them) are
    placed first, the largest in the split that lacks most; the others follow in seeded hash order and are cut where the
    running count of rows crosses what the splits still lack.  The order is scanned in hash ranges of about
    ``RANGE_GROUPS`` groups: rows are counted per range first, then only inside the range, so no task holds all groups.
    A row without a group is a group of its own."""
    alone = F.xxhash64(F.lit("r"), "record_id")
    rows = grouped(patients, links).withColumn("unit", F.when(F.col("group_key").isNull(), alone).otherwise(F.xxhash64(F.lit("g"), "group_key")))
    units = cut(rows.groupBy("unit").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("unit", F.lit(seed))))
    total, n_units = units.agg(F.sum("n"), F.count("*")).first()
    large = units.where(F.col("n") >= LARGE * (total or 0)).orderBy(F.desc("n"), "h").collect() if total else []
    lack = {name: share * (total or 0) for name, share in shares}
    placed_large = []
    for group in large:
        name = max(lack, key=lambda k: lack[k])
        lack[name] -= group.n
        placed_large.append((group.unit, name))
    listed = units.sparkSession.createDataFrame(placed_large, "unit bigint, split string")
    small = units.join(F.broadcast(listed), "unit", "left_anti").withColumn("span", F.pmod("h", F.lit(max(1, (n_units or 0) // RANGE_GROUPS))))
    spans = small.groupBy("span").agg(F.sum("n").alias("span_n"))
    before = spans.withColumn("before", F.coalesce(F.sum("span_n").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("span").orderBy("h", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("n").over(inside) - F.col("n") / 2
    # the rest is shared out by what is lacking; a split that large groups have filled gets nothing more
    room = {name: max(v, 0.0) for name, v in lack.items()}
    rest = (total or 0) - sum(group.n for group in large)
    scale = rest / sum(room.values()) if sum(room.values()) else 0.0
    choice, edge = F.lit(shares[-1][0]), 0.0
    edges = []
    for name, _ in shares[:-1]:
        edge += room[name] * scale
        edges.append((name, edge))
    for name, at in reversed(edges):
        choice = F.when(F.col("middle") < at, name).otherwise(choice)
    placed = small.join(F.broadcast(before.select("span", "before")), "span").withColumn("middle", middle).select("unit", choice.alias("split"))
    placed = placed.unionByName(listed)
    return rows.join(placed, "unit").select("record_id", "group_key", "split")


def split_shares(patients: DataFrame, links: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, seed: int = 42) -> DataFrame:
    """``split, target_share, n_rows, n_groups, reached_share``; rows without a group count as a group each."""
    out = splits(patients, links, shares, seed)
    wanted = patients.sparkSession.createDataFrame(list(shares), "split string, target_share double")
    sums = out.groupBy("split").agg(F.count("*").alias("n_rows"), (F.count_distinct("group_key") + F.count_if(F.col("group_key").isNull())).alias("n_groups"))
    n = F.coalesce("n_rows", F.lit(0))
    reached = F.coalesce(F.try_divide(n.cast("double"), F.sum("n_rows").over(Window.partitionBy())), F.lit(0.0))
    return wanted.join(sums, "split", "left").select("split", "target_share", n.alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), reached.alias("reached_share"))
