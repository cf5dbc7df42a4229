"""Tables inside articles and panels of a profile: header split, row facts, row batches, panel choice, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY_CELLS = ("", "-", "NA", "n/a", "N/A")


def table_lines(content: Column) -> Column:
    """The lines that hold a pipe, but for rules of dashes.  A line that opens with a pipe loses its outer pipes; in others a
    first or last cell may be empty.  Several tables of one text come as one."""
    held = F.filter(F.split(content, r"\r\n|\r|\n"), lambda x: x.contains("|") & ~x.rlike(r"^[\s|]*:?-{3,}[\s|:+=-]*$"))
    return F.transform(held, lambda x: F.when(x.startswith("|"), F.regexp_replace(x, r"^\|\s*|\s*\|\s*$", "")).otherwise(x))


def header_size(lines: Column) -> Column:
    """Header lines of a pipe-text table, one to three: the first is one; the second and third are unless their first
    cell opens with a number or has one to ten characters.  Later ones count only after an earlier one."""
    cell = lambda i: F.trim(F.element_at(F.split(F.coalesce(F.get(lines, F.lit(i)), F.lit("")), r"\|"), 1))
    data = lambda i: cell(i).rlike(r"^\d+[.)]*(\s|$)") | F.length(cell(i)).between(1, 10)
    return F.when(F.size(lines) < 2, F.size(lines)).when(data(1), 1).when((F.size(lines) < 3) | data(2), 2).otherwise(3)


def table_rows(tables: DataFrame, key: list[str], content: str, batch: int = 10) -> DataFrame:
    """``key, batch, header, rows``: data rows in batches with the header repeated; a table of headers only gives none."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.length(F.trim(x)) > 0)
    split = tables.select(*key, lines.alias("l")).withColumn("h", header_size(F.col("l")))
    rows = split.select(*key, F.array_join(F.slice("l", 1, F.greatest("h", F.lit(1))), "\n").alias("header"), F.posexplode(F.slice("l", F.col("h") + 1, F.greatest(F.size("l") - F.col("h"), F.lit(0)))).alias("i", "row"))
    grouped = rows.groupBy(*key, "header", F.floor(F.col("i") / batch).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("r"))
    return grouped.select(*key, "batch", "header", F.transform("r", lambda x: x["row"]).alias("rows"))


def row_facts(rows: DataFrame, key: list[str], cells: str, label: str) -> DataFrame:
    """``key, fact, quote``: one fact per filled cell of a row given as a map; the quote names the table and is padded
    to the 15 characters that a quote must have."""
    pairs = rows.select(*key, F.col(label).alias("__label"), F.explode(F.map_entries(cells)).alias("e")).where(F.col("e.value").isNotNull() & ~F.trim(F.col("e.value")).isin(*EMPTY_CELLS))
    fact = F.concat("e.key", F.lit(": "), "e.value")
    quote = F.concat(F.lit("[Table "), "__label", F.lit("] "), fact)
    return pairs.select(*key, fact.alias("fact"), F.rpad(quote, F.greatest(F.length(quote), F.lit(15)), " ").alias("quote"))


def chosen_panels(mri: Column, eeg: Column, most: int) -> Column:
    """At most ``most`` panels: half of each modality where both exist (MRI gets the odd one), else of the one there is."""
    half = most // 2
    both = F.concat(F.slice(mri, 1, most - half), F.slice(eeg, 1, half)) if half else F.slice(mri, 1, most)
    return F.when((F.size(mri) > 0) & (F.size(eeg) > 0), both).when(F.size(mri) > 0, F.slice(mri, 1, most)).otherwise(F.slice(eeg, 1, most))


def completed(results: DataFrame, axes: dict[str, list], value: str) -> DataFrame:
    """Every combination of the given axes (small fixed lists), with null where there is no result."""
    grid = results.sparkSession.range(1).select(*(F.lit(None).alias("__none"),))
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return F.broadcast(grid.drop("__none")).join(results.select(*axes, value), list(axes), "left")


def messages(turns: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """``key, messages``: the turns of a conversation in order."""
    held = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content")))).alias("m"))
    return held.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
