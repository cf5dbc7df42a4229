"""Result tables: fixed grids, pivots, winners, bands, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zero_filled_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """``column, n, percent`` for every value of the domain, in one aggregation."""
    counts = df.groupBy(F.col(column).alias(column)).agg(F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    filled = F.broadcast(grid).join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("percent", F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy())))


def pivoted(results: DataFrame, row: str, columns: list[str], keys: list[str], value: str) -> DataFrame:
    """Mean of ``value`` per row and key (fixed order); rows without any value are left out."""
    key = F.concat_ws("_", *columns)
    return results.withColumn("__key", key).groupBy(row).pivot("__key", keys).agg(F.avg(value)).dropna("all", subset=keys)


def winners(results: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """The best name per group; ties go to the first name in order."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last(value), name)
    return results.where(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def bands(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: ``by, band, value, first, last, n``."""
    w = Window.partitionBy(*by).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    marked = df.withColumn("band", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "band").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def gap_clusters(df: DataFrame, by: list[str], position: str, gap: float, size: float | None = None, border: float = 0.1) -> DataFrame:
    """Sorted positions fall into clusters wherever a step is ``gap`` or more: ``by, cluster, centre, n``.  With ``size``,
    centres within ``border`` of either end of 0 to ``size`` are left out."""
    w = Window.partitionBy(*by).orderBy(position)
    step = (F.col(position) - F.lag(position).over(w) >= gap).cast("int")
    marked = df.withColumn("cluster", F.sum(F.coalesce(step, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*by, "cluster").agg(F.floor(F.avg(position)).alias("centre"), F.count("*").alias("n"))
    return out if size is None else out.where((F.col("centre") > size * border) & (F.col("centre") < size * (1 - border)))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small table as pipe text: three decimals, a dash for null.  More than ``limit`` rows are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def seed_means(runs: DataFrame, by: list[str], value: str, n: str, seed: str) -> DataFrame:
    """``by, mean, values, n_seeds, n_first``: runs of several seeds as one: the mean, the values in the order of the seeds
    (missing ones left out) and the number of rows of the first run that states one."""
    values = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(seed).alias("s"), F.col(value).alias("v")))))
    return runs.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.transform(values, lambda x: x["v"]).alias("values"), F.count("*").alias("n_seeds"),
        F.coalesce(F.min_by(n, F.when(F.col(n).isNotNull(), F.col(seed))), F.lit(0)).alias("n_first"),
    )


def best_per_tier(results: DataFrame, tier: str, name: str, value: str) -> DataFrame:
    """``tier, name, score``: the name with the best mean over all tasks per tier; of equal ones the first by name."""
    means = results.groupBy(tier, name).agg(F.avg(value).alias("score")).where("score is not null")
    return means.groupBy(tier).agg(F.max("score").alias("score")).join(
        means.withColumnRenamed("score", "__s"), tier
    ).where("__s = score").groupBy(tier, "score").agg(F.min(name).alias(name))


def plain_pivot(results: DataFrame, row: str, column: str, keys: list[str], value: str) -> DataFrame:
    """One column per key; a second value of one cell is an error in the data, the first one counts."""
    return results.groupBy(row).pivot(column, keys).agg(F.first(value, ignorenulls=True))


def tier_rows(summaries: DataFrame, keep: list[str], tiers: list[str], fields: list[str]) -> DataFrame:
    """Flat rows ``keep, tier, fields`` of structs per tier."""
    rows = F.array(*(F.struct(F.lit(t).alias("tier"), *(F.col(f"{t}.{f}").alias(f) for f in fields)) for t in tiers))
    return summaries.select(*keep, F.inline(rows))


def run_summary(items: DataFrame, status: str, amount: str) -> DataFrame:
    """``status, n_items, total``: how a run ended, by status."""
    return items.groupBy(F.coalesce(F.col(status), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n_items"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))
