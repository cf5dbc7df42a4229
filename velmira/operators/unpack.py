"""Problem 3: several values packed in one field.

Method: the delimiter is inferred per source.  A value is first taken out of its container (list, tuple, quotes, stray
marks at its ends); what stands between two items gives its *shape*.  For each source, field and shape every
candidate delimiter is scored on all values: how regular the pieces are (a piece should look like one path), how
often their number agrees with the declared count, and whether it separates anything at all.  The best candidate
splits the values of that group; a value that it leaves irregular is split at every place where one path ends and the
next begins.  A delimiter only counts where an item may begin after it, so marks inside a name don't split it.

Edge cases: null, blank and placeholder values (``[]``, ``-``, ``nan``, ``None``, ...) give no row, nor do empty items;
repeated items and rows are kept; quotes around an item are dropped, those inside it are kept; empty tables give empty
tables; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velmira.functions.ids import squeezed

FIELDS = {"mri_image_paths": "num_mri_images", "eeg_image_paths": "num_eeg_images"}

_QUOTES = "\"'‘’“”`"
_OPENS = rf"(?=[{_QUOTES}\[(]*[^\s/{_QUOTES}]+/|[{_QUOTES};,|]|\s*$)"  # where an item, an empty item or the end may follow
DELIMITERS = {
    "semicolon": rf"\s*;\s*{_OPENS}",
    "pipe": rf"\s*\|\s*{_OPENS}",
    "comma": rf"\s*,\s*{_OPENS}",
    "tab": rf" *\t+ *{_OPENS}",
    "newline": rf"[ \t]*[\r\n]+\s*{_OPENS}",
    "blank": rf"(?<=[{_QUOTES}])\s+(?=[{_QUOTES}])|(?<=\.\w{{2,5}})\s+(?=[^\s/{_QUOTES}]+/)",
}
_ANY = "|".join(f"(?:{p})" for p in DELIMITERS.values())
_REGULAR = rf"^[^\s/{_QUOTES}]+/(?:[^/]|/(?!\S*/PMC))*\.\w{{2,5}}$"
_TWO = r"\.(?i:jpe?g|png|tiff?|gif|bmp|svg|webp|dcm)\b.*\.(?i:jpe?g|png|tiff?|gif|bmp|svg|webp|dcm)\b"
_NOTHING = r"^(?i:none|nan|null|na|n/a|nil|-|–|—|\[\s*\]|\(\s*\))?$"


def content(value: Column) -> Column:
    """The value without container and stray marks; null if nothing is left."""
    v = F.trim(F.regexp_replace(value, r"^[\s ]+|[\s ]+$", ""))
    v = F.regexp_replace(v, rf"^[\"“]\s*(?=[\[(])|(?<=[\])])\s*[\"”]$", "")  # a quoted list
    v = F.regexp_replace(v, r"^[\[(]\s*|\s*[\])]$", "")
    v = F.regexp_replace(v, r"^[\s,;|]+|[\s,;|]+$", "")
    v = F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))
    return F.when(~v.rlike(_NOTHING), v)


def clean_items(pieces: Column) -> Column:
    """Trimmed items without the quotes around them; empty and placeholder items are left out."""
    bare = F.transform(pieces, lambda x: F.regexp_replace(F.trim(x), rf"^[{_QUOTES}]+\s*|\s*[{_QUOTES}]+$", ""))
    return F.filter(bare, lambda x: ~x.rlike(_NOTHING))


def _regular(items: Column) -> Column:
    return F.size(F.filter(items, lambda x: x.rlike(_REGULAR) & ~x.rlike(_TWO))) / F.greatest(F.size(items), F.lit(1))


def packed_values(table: DataFrame, key: str, fields: dict[str, str], source: str) -> DataFrame:
    """``key, field, source, declared, body, shape``: one row per value that holds anything."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(n).cast("int").alias("declared")) for f, n in fields.items()))
    between = rf"\.\w{{2,5}}([{_QUOTES}]*\s*(?:[;,|\t\r\n]+\s*|\s+))[{_QUOTES}]*[^\s/{_QUOTES}]+/"
    return (
        table.select(key, squeezed(F.col(source)).alias("source"), F.explode(rows).alias("x"))
        .select(key, F.coalesce("source", F.lit("")).alias("source"), "x.field", "x.declared", content(F.col("x.value")).alias("body"))
        .where("body is not null")
        .withColumn("shape", F.regexp_replace(F.regexp_replace(F.regexp_extract("body", between, 1), r" +", " "), rf"[{_QUOTES}]+", "'"))
    )


def infer_delimiters(values: DataFrame) -> DataFrame:
    """``source, field, shape, delimiter, score``: the best candidate of each group, from all its values."""
    tries = F.array(
        *(F.struct(F.lit(name).alias("delimiter"), clean_items(F.split("body", pattern)).alias("items")) for name, pattern in DELIMITERS.items())
    )
    scored = values.where("shape <> ''").select("source", "field", "shape", "declared", F.explode(tries).alias("t")).select(
        "source", "field", "shape", "t.delimiter",
        _regular(F.col("t.items")).alias("regular"),
        (F.size("t.items") == F.col("declared")).cast("double").alias("agrees"),
        (F.size("t.items") > 1).cast("double").alias("splits"),
    )
    score = F.avg("regular") + 0.5 * F.coalesce(F.avg("agrees"), F.lit(0.0)) + 0.25 * F.avg("splits")
    scores = scored.groupBy("source", "field", "shape", "delimiter").agg(score.alias("score"))
    return scores.groupBy("source", "field", "shape").agg(F.max_by("delimiter", F.struct("score", "delimiter")).alias("delimiter"), F.max("score").alias("score"))


def unpacked(table: DataFrame, key: str = "record_id", fields: dict[str, str] | None = None, source: str = "source") -> DataFrame:
    """p3_found: ``record_id, field, pos, path``: one row per item, ``pos`` from 1 over the items that aren't empty."""
    values = packed_values(table, key, fields or FIELDS, source)
    chosen = infer_delimiters(values).select("source", "field", "shape", "delimiter")
    joined = values.join(chosen, ["source", "field", "shape"], "left")
    by_choice = F.array(F.col("body"))
    for name, pattern in DELIMITERS.items():
        by_choice = F.when(F.col("delimiter") == name, F.split("body", pattern)).otherwise(by_choice)
    items = joined.select(key, "field", "body", clean_items(by_choice).alias("items"))
    whole = F.when(_regular(F.col("items")) >= 1.0, F.col("items")).otherwise(clean_items(F.split("body", _ANY)))
    return items.select(key, "field", F.posexplode(whole).alias("pos", "path")).select(key, "field", (F.col("pos") + 1).alias("pos"), "path")
