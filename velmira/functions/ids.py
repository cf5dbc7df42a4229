"""Identifier normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paper_number(pmc_id: Column) -> Column:
    """The ten-digit number inside a paper id, however it is spelled; null where there is none."""
    return F.nullif(F.regexp_extract(pmc_id, r"([0-9]{10})", 1), F.lit("")).try_cast("bigint")


def squeezed(value: Column) -> Column:
    """Lower-cased, every run of blanks, underscores and hyphens as one underscore, trimmed."""
    flat = F.regexp_replace(F.lower(value), r"[\s _\-]+", "_")
    return F.regexp_replace(flat, r"^_+|_+$", "")
