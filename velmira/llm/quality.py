"""Problem 10: per-document text statistics and the kind of text: prose, list, table or junk.

Method: an ordered rule list is induced by incremental reduced-error pruning on labelled documents
(quality_training.py), its learned thresholds are exported as ``RULES`` (quality_rules.py), and they are applied as
one SQL CASE over the statistics.  Everything here runs inside the JVM, over whole texts.

Null, empty and blank texts have the kind null and null shares with zero counts.  Text of any length and script is
measured whole; extra columns are ignored; repeated rows are measured each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velmira.llm.quality_rules import DEFAULT, RULES

# fixed values: frequent function words of en, de, fr, es, without those that often open a list item
COMMON = (
    "the of and to in was were with at on for by is had not after before from as than that but no which when are be been or it its this these there "
    "der die das und mit von war den dem zu im am bei wir aus nach auf nicht jedoch wurde sich es ist für über als "
    "l d qu n le la les du et on ne ont dans sur pas mais nous au aux était que par avec sont puis si plus "
    "el los las no está del y en con por lo fue mientras se más pero para su"
).split()

# every pattern is linear in the text: no repeated group can be entered at more than one place
_SENTENCE = r"[.!?](?<=\p{L}\p{N}{0,2}[)\"”’]{0,2}[.!?])[)\"”’]?(?:\s|$)"
_ITEM = r"^[ \t]*(?:[-*+•▪–—◦·‣]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[\d{1,3}\])[ \t]+\S"
_CELL_MARKS = ("|", "\t", ",", ";")

FEATURES = (
    "n_chars", "n_tokens", "n_lines", "mean_word", "letter_share", "digit_share", "symbol_share", "common_share", "sentence_words",
    "item_share", "tokens_per_line", "cell_share", "separator_rate", "distinct_rate", "long_share", "distinct_lines", "ended_share",
)


def statistics(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``FEATURES`` of each row."""
    t = F.col("__t")
    base = documents.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    full = lambda pieces: F.filter(pieces, lambda x: F.length(x) > 0)
    base = base.withColumns(
        {
            "__lines": F.filter(F.split(t, r"[\r\n]+"), lambda x: F.length(F.trim(x)) > 0),
            "__tokens": full(F.split(F.lower(t), r"\s+")),
            "__words": full(F.split(F.lower(t), r"[^\p{L}]+")),
        }
    )
    base = base.withColumns(
        {
            "n_chars": F.length(t).cast("double"),
            "__ink": F.length(F.array_join("__tokens", "")).cast("double"),
            "n_tokens": F.size("__tokens").cast("double"),
            "n_lines": F.size("__lines").cast("double"),
            "__letters": F.length(F.array_join("__words", "")).cast("double"),
            "n_words": F.size("__words").cast("double"),
            "__digits": F.length(t).cast("double") - F.length(F.translate(t, "0123456789", "")),
            "__common": F.size(F.filter("__words", lambda x: x.isin(*COMMON))).cast("double"),
            "__sentences": F.regexp_count(t, F.lit(_SENTENCE)).cast("double"),
            "__separators": F.length(t).cast("double") - F.length(F.translate(t, ";,|•·", "")),
            "__long": F.length(F.array_join(F.filter("__tokens", lambda x: F.length(x) >= 30), "")).cast("double"),
        }
    )
    # Shares of the text's length.  A line is tabular if it has as many cells (three or more, short on average) as
    # the last line with that mark.
    weight = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + F.length(x))
    whole = F.nullif(weight(F.col("__lines")), F.lit(0))

    def tabular(mark: str) -> Column:
        count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))
        last = F.coalesce(count(F.try_element_at("__lines", F.lit(-1))), F.lit(0))
        same = F.filter("__lines", lambda x: (F.length(x) <= 32 * (last + 1)) & (count(x) == last))
        return F.when((last >= 2) & (F.size(same) >= 2), weight(same) / whole).otherwise(0.0)

    ways = [tabular(mark) for mark in _CELL_MARKS]
    gaps = F.filter("__lines", lambda x: F.contains(x, F.lit("  ")) & (F.regexp_count(F.trim(x), F.lit(r"\S {2,}(?=\S)")) >= 2))
    ways.append(F.when(F.size(gaps) >= 2, weight(gaps) / whole).otherwise(0.0))
    items = F.filter("__lines", lambda x: x.rlike(_ITEM))
    ended = F.filter("__lines", lambda x: F.rtrim(x).rlike(r"[.!?:;,]$"))
    over = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(0.0))
    return base.select(
        *keep,
        "n_chars", "n_tokens", "n_lines",
        over("__letters", "n_words").alias("mean_word"),
        over("__letters", "__ink").alias("letter_share"),
        over("__digits", "__ink").alias("digit_share"),
        F.when(F.col("__ink") > 0, 1 - (F.col("__letters") + F.col("__digits")) / F.col("__ink")).otherwise(0.0).alias("symbol_share"),
        over("__common", "n_words").alias("common_share"),
        F.when(F.col("__sentences") > 0, F.least(F.col("n_tokens") / F.col("__sentences"), F.lit(999.0))).otherwise(999.0).alias("sentence_words"),
        F.coalesce(weight(items) / whole, F.lit(0.0)).alias("item_share"),
        over("n_tokens", "n_lines").alias("tokens_per_line"),
        F.greatest(*ways).alias("cell_share"),
        over("__separators", "n_tokens").alias("separator_rate"),
        F.when(F.col("n_tokens") > 0, F.size(F.array_distinct("__tokens")) / F.sqrt("n_tokens")).otherwise(0.0).alias("distinct_rate"),
        over("__long", "__ink").alias("long_share"),
        F.when(F.col("n_lines") > 0, F.size(F.array_distinct("__lines")) / F.col("n_lines")).otherwise(0.0).alias("distinct_lines"),
        F.when(F.col("n_lines") > 0, F.size(ended) / F.col("n_lines")).otherwise(0.0).alias("ended_share"),
    )


def kind(rules=RULES, default: str = DEFAULT) -> Column:
    """The exported rule list as a CASE expression: the first rule whose conditions all hold gives the kind."""
    case = F.when(F.col("n_tokens") == 0, F.lit(None).cast("string"))
    for label, conditions in rules:
        holds = F.lit(True)
        for feature, sign, limit in conditions:
            holds = holds & (F.col(feature) <= limit if sign == "<=" else F.col(feature) > limit)
        case = case.when(holds, label)
    return case.otherwise(default)


def found(documents: DataFrame) -> DataFrame:
    """p10_found: ``doc_id, kind`` of the documents that are mostly list, table or junk."""
    # the running number keeps the filter above the statistics: pushed below, it would compute all of them again
    kinds = statistics(documents).select("doc_id", kind().alias("kind"), F.monotonically_increasing_id().alias("__at"))
    return kinds.where("kind <> 'prose' and __at >= 0").select("doc_id", "kind")


def report(documents: DataFrame) -> DataFrame:
    """``doc_id``, the rounded statistics and the kind of every document."""
    stats = statistics(documents)
    return stats.select("doc_id", *(F.round(f, 6).alias(f) for f in FEATURES), kind().alias("kind"))
