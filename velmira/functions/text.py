"""Text, caption and identifier functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LABEL = r"[A-Za-z](?:\s*[-–—,&]\s*[A-Za-z])*"
# a labelled part "(A) text": its label and what follows up to the next label or the end
BRACKETED = rf"(?is)\(({_LABEL})\)\s*[:\s]*(.+?)(?=\({_LABEL}\)|$)"
LEADING = rf"(?is)(?:^|(?<=[.;]\s)|(?<=\n))({_LABEL})[):]\s*(.+?)(?=(?:(?<=[.;]\s)|(?<=\n)){_LABEL}[):]|$)"
LISTED = r"(?is)(?:^|(?<=[;.]\s))([A-Za-z]),\s*(.+?)(?=;\s*[A-Za-z],|$)"


def clean_text(text: Column) -> Column:
    """Whitespace runs as one blank, control characters dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\x00-\x1f\x7f-\x9f]", ""))


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - len(suffix))), F.lit(suffix))).otherwise(text)


def input_text(separator: str = " | ", placeholder: str = "(no clinical text)", captions: bool = True) -> Column:
    """The labelled parts of a profile in fixed order; ``captions=False`` leaves the imaging reports out."""
    parts = [("Age", "age"), ("Sex", "sex"), ("Semiology", "semiology_text"), ("MRI", "mri_report_text"), ("EEG", "eeg_report_text"), ("Notes", "demographics_notes")]
    kept = [p for p in parts if captions or p[0] not in ("MRI", "EEG")]
    cols = [F.when(F.length(F.trim(F.col(c))) > 0, F.concat(F.lit(f"{n}: "), F.col(c))) for n, c in kept]
    return F.coalesce(F.nullif(F.concat_ws(separator, *cols), F.lit("")), F.lit(placeholder))


def list_literal(value: Column) -> Column:
    """A list written as a literal of quoted strings; anything malformed is an empty list."""
    body = F.regexp_replace(value, r"^\s*\[|\]\s*$", "")
    fine = value.rlike(r"""^\s*\[\s*(?:(?:'[^']*'|"[^"]*")\s*(?:,\s*(?:'[^']*'|"[^"]*")\s*)*,?\s*)?\]\s*$""")
    items = F.transform(F.regexp_extract_all(body, F.lit(r"""'[^']*'|"[^"]*\""""), F.lit(0)), lambda x: F.substr(x, F.lit(2), F.length(x) - 2))
    return F.when(fine, items).otherwise(F.array().cast("array<string>"))


def path_hash(path: Column) -> Column:
    return F.left(F.sha1(path), F.lit(16))


# fixed values: how a figure number stands in a file name, the first that fits counts
FIGURE_NUMBERS = (r"[Ff]ig(?:ure)?[-_]?(\d+)", r"[Ff](\d+)", r"figure(\d+)")


def figure_number(path: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")) for pattern in FIGURE_NUMBERS))


def figure_id(path: Column) -> Column:
    return F.concat(F.lit("fig"), figure_number(path))


def document_id(path: Column) -> Column:
    """``PMC`` and its number inside a path, or null."""
    return F.nullif(F.regexp_extract(path, r"PMC\d+", 0), F.lit(""))


def panel_label(index: Column) -> Column:
    return F.when(index < 26, F.char(index + 65)).otherwise(F.concat(F.lit("Panel"), (index + 1).cast("string")))


def readable_size(size: Column) -> Column:
    out, scale = F.format_string("%.1f TB", size / 1024.0**4), 1024.0
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < scale ** (power + 1), F.format_string(f"%.1f {unit}", size / scale**power)).otherwise(out)
    return out


def expand_labels(label: Column) -> Column:
    """``A`` as [A], ``A-C`` as [A, B, C], ``A, B & C`` as [A, B, C]; a falling range is empty."""
    t = F.upper(F.trim(label))
    first, last = F.ascii(F.regexp_extract(t, r"^([A-Z])\s*[-–—]\s*([A-Z])$", 1)), F.ascii(F.regexp_extract(t, r"^([A-Z])\s*[-–—]\s*([A-Z])$", 2))
    ranged = F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda c: F.char(c))).otherwise(F.array().cast("array<string>"))
    split = F.filter(F.transform(F.split(t, r"[,&]\s*"), lambda x: F.trim(x)), lambda x: F.length(x) == 1)
    return F.when(t.rlike(r"^[A-Z]\s*[-–—]\s*[A-Z]$"), ranged).otherwise(split)


def _first_of_label(parts: Column) -> Column:
    return F.filter(parts, lambda x, i: F.array_position(F.transform(parts, lambda y: y["label"]), x["label"]) == i + 1)


def labelled_parts(caption: Column) -> Column:
    """``array<struct<label, text>>``: the first notation with two labels or more gives the parts; else empty.  A label
    that comes again keeps its first text."""
    c = F.regexp_replace(caption, r"^\s+|\s+$", "")
    found = []
    for pattern in (BRACKETED, LEADING, LISTED):
        names, texts = (F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in (1, 2))
        stripped = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"[.;,]+$", "")
        zipped = F.flatten(F.zip_with(names, texts, lambda n, x: F.transform(expand_labels(n), lambda one: F.struct(one.alias("label"), stripped(x).alias("text")))))
        found.append(F.when(F.size(names) >= 2, _first_of_label(zipped)))
    return F.coalesce(*found, F.array().cast("array<struct<label:string,text:string>>"))


def caption_levels(caption: Column, label: Column, answered: Column) -> Column:
    """``struct<text, confidence>`` of a panel: its part of the caption (0.8), else what a model answered (0.6), else the
    whole caption (0.3)."""
    part = F.get(F.filter(labelled_parts(caption), lambda x: x["label"] == F.upper(label)), F.lit(0))["text"]
    level = lambda text, sure: F.when(F.length(text) > 0, F.struct(text.alias("text"), F.lit(sure).alias("confidence")))
    return F.coalesce(level(part, 0.8), level(answered, 0.6), level(caption, 0.3))


def listed_lines(header: str, items: Column, most: int) -> Column:
    """``header`` and one line ``- label: caption`` per item (``array<struct<label, caption>>``), captions cut at ``most``."""
    return F.array_join(F.concat(F.array(F.lit(header)), F.transform(items, lambda x: F.concat(F.lit("- "), x["label"], F.lit(": "), F.left(F.coalesce(x["caption"], F.lit("")), F.lit(most))))), "\n")


def numbered_facts(facts: Column) -> Column:
    """One numbered paragraph per ``struct<fact, quote>``: the fact, and its quote on a line of its own."""
    one = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["fact"], F.lit("\n   QUOTE: "), x["quote"])
    return F.array_join(F.transform(facts, one), "\n")


def lines_about(definition: Column, classes: Column) -> Column:
    """The first line of a definition and those of the others that name one of the classes in double quotes."""
    lines = F.split(definition, "\n")
    named = lambda x: F.exists(classes, lambda c: F.contains(x, F.concat(F.lit('"'), c, F.lit('"'))))
    return F.array_join(F.filter(lines, lambda x, i: (i == 0) | named(x)), "\n")


def first_json(text: Column) -> Column:
    """The JSON object in a model's answer: code fences taken off, else from the first to the last brace; or null."""
    bare = F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    inner = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(bare), valid(inner))


def canonical_person(ref: Column) -> Column:
    """Number or letter by which a document names a person ("Patient 3", "pt. 3", "#3"), else the normalised text."""
    t = F.trim(F.regexp_replace(F.lower(ref), r"[\s_]+", " "))
    number = F.nullif(F.regexp_extract(t, r"^(?:patient|pt\.?|case|subject|proband|no\.?|p|#)?\s*#?0*([0-9]+|[a-z])$", 1), F.lit(""))
    return F.coalesce(number, F.nullif(t, F.lit("")))
