"""Problem 5: mapping freely typed values to a reference list.

Method: a prefix-filter set-similarity join.  A value is a set of character pairs of its words (with word borders)
and of its letters, so neither word order nor a slip of the pen matters much.  Tokens are put in a global order, rarest in the reference
list first; only the first n - ceil(t*n) + 1 tokens of either set are joined; pairs pass a length and a positional
filter; the Jaccard coefficient is then computed exactly and the best entry kept (ties: the smaller id).

Every entry stands in the list under several spellings (name, abbreviation, usual names of the technique); the side of
a region is brought to one spelling first.  Abbreviations must agree wholly.  What the side words contribute can't
carry a match: the rest of the two sets must be alike as well.

Edge cases: null, blank and missing-value signs are not mapped at all; a value below the threshold is reported with
``ref_id`` 0; each different value is matched once, however often it occurs; repeated rows are kept; empty tables give
empty tables.  The reference list is broadcast only up to ``REFERENCE_ROWS`` spellings and ``REFERENCE_NAMES`` names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velmira.session import cut

THRESHOLDS = {"modality": 0.42, "anatomical_region": 0.36}
REFERENCE_ROWS = 20_000
REFERENCE_NAMES = 1_000_000
# fixed values: signs for a missing value
MISSING = ("", "-", "--", "–", "—", "n/a", "na", "n.a.", "n.a", "#n/a", "nan", "null", "none", "nil", "?", ".")
SIDES = {"left": ("l", "lt", "left", "sinistra"), "right": ("r", "rt", "right", "dextra"), "bilateral": ("bl", "bil", "bilat", "both", "bilaterally", "bilateral")}
FILLERS = ("the", "in", "of", "at", "a", "an", "side", "sides", "sided", "region", "area", "lesion", "part", "on")
# fixed values: usual names of the techniques
TECHNIQUES = {
    "MRI_T1_WEIGHTED": ("t1", "t1w", "t1wi", "t1 weighted", "t1 weighted image", "t1 image", "t1 weighted sequence"),
    "MRI_T2_WEIGHTED": ("t2", "t2w", "t2wi", "t2 weighted", "t2 weighted image", "t2 image", "t2 weighted sequence"),
    "MRI_FLAIR": ("flair", "t2 flair", "flair sequence", "flair image", "t1 flair"),
    "MRI_DWI_ADC": ("dwi", "adc", "dwi adc", "diffusion", "diffusion weighted", "diffusion weighted image", "diffusion weighted imaging", "adc map", "apparent diffusion coefficient"),
    "MRI_CONTRAST": ("contrast", "contrast enhanced", "post contrast", "with contrast", "gadolinium", "gadolinium enhanced", "post gadolinium", "t1 contrast", "ce"),
    "MRI_OTHER": ("other", "other sequence"),
    "EEG_SCALP": ("scalp", "surface", "surface scalp", "scalp recording", "scalp trace"),
    "EEG_ICTAL": ("ictal", "ictal trace", "ictal recording", "seizure"),
    "EEG_INTERICTAL": ("interictal", "inter ictal", "interictal recording", "interictal trace"),
    "EEG_INTRACRANIAL": ("intracranial", "intra cranial", "invasive", "stereo", "subdural", "depth electrode", "intracranial recording"),
    "EEG_OTHER": ("other", "other recording"),
    "UNKNOWN": ("unknown", "unknown modality", "modality unknown", "not known"),
}
ALONE = {
    "MRI_T1_WEIGHTED": ("t1", "t1w", "t1wi", "t1 weighted", "t1 weighted image", "t1 image"), "MRI_T2_WEIGHTED": ("t2", "t2w", "t2wi", "t2 weighted", "t2 weighted image", "t2 image"),
    "MRI_FLAIR": ("flair", "t2 flair", "flair sequence"), "MRI_DWI_ADC": ("dwi", "adc", "dwi adc", "diffusion weighted image", "adc map", "diffusion"),
    "EEG_SCALP": ("scalp electroencephalogram", "scalp electroencephalography"), "EEG_ICTAL": ("ictal electroencephalogram",), "EEG_INTERICTAL": ("interictal electroencephalogram",),
    "EEG_INTRACRANIAL": ("ieeg", "seeg", "ecog", "icEEG".lower(), "electrocorticography", "intracranial electroencephalogram"),
}


# techniques that are no entry, but are spelled like one: a value next to them is unmatched
OTHERS = ("ecg", "ecg trace", "ekg", "emg trace", "ecg recording", "ct", "ct scan", "contrast ct", "pet ct")


def spelled(value: Column, sides: bool) -> Column:
    """Words of the value in lower case, parted by single blanks; for regions with sides in one spelling."""
    t = F.regexp_replace(F.lower(value), r"\b[b]/l\b", "bilateral")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    if sides:
        t = F.regexp_replace(t, r"^([a-z0-9]{1,4}) b$", "$1 bilateral")  # an abbreviation with its side
        for side, names in SIDES.items():
            t = F.regexp_replace(t, r"(?<=^|\s)(?:" + "|".join(names) + r")(?=\s|$)", side)
        t = F.regexp_replace(t, r"(?<=^|\s)(?:" + "|".join(FILLERS) + r")(?=\s|$)", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def pairs_of(text: Column) -> Column:
    """Distinct character pairs of the words, word borders included, and the letters by themselves, which a
    transposition leaves alone."""
    words = F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    pairs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    letters = F.filter(F.split(text, ""), lambda c: ~c.isin("", " "))
    return F.array_distinct(F.concat(pairs, letters))


def modality_spellings(modality_ref: DataFrame) -> DataFrame:
    """``ref_id, spelling, side, exact``."""
    named = {}
    for name, usual in TECHNIQUES.items():
        kind = name.split("_")[0].lower()
        named[name] = [f"{kind} {u}" for u in usual] if kind in ("mri", "eeg") else list(usual)
        named[name] += list(ALONE.get(name, ()))
    usual = F.create_map(*(x for name, values in named.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))
    own = F.array(F.col("modality_name"), F.col("description"))
    every = F.concat(own, F.coalesce(F.try_element_at(usual, F.col("modality_name")), F.array().cast("array<string>")))
    spark = modality_ref.sparkSession
    others = spark.createDataFrame([(0, o, "", False) for o in OTHERS], "ref_id int, spelling string, side string, exact boolean")
    entries = modality_ref.select(F.col("modality_id").alias("ref_id"), F.explode(every).alias("s")).select(
        "ref_id", spelled(F.col("s"), False).alias("spelling"), F.lit("").alias("side"), F.lit(False).alias("exact")
    )
    return entries.unionByName(others)


def region_spellings(region_ref: DataFrame) -> DataFrame:
    every = F.array(
        F.struct(F.col("region_name").alias("s"), F.lit(False).alias("exact")), F.struct(F.col("abbrev").alias("s"), F.lit(True).alias("exact"))
    )
    return region_ref.select(F.col("region_id").alias("ref_id"), F.coalesce("side", F.lit("")).alias("side"), F.explode(every).alias("x")).select(
        "ref_id", spelled(F.col("x.s"), True).alias("spelling"), "side", "x.exact"
    )


def best_matches(values: DataFrame, spellings: DataFrame, threshold: float) -> DataFrame:
    """``values``: ``spelling`` (distinct); gives ``spelling, ref_id, likeness`` of the best entry at the threshold.

    The values are spread once, by number, over the tasks; everything after that keeps their place, so the work on few
    but costly values is not folded into one task.  The posted reference list is broadcast up to ``REFERENCE_ROWS``
    spellings and joined by shuffle beyond; its token counts (pairs of characters in use) fit one row.
    """
    spellings = spellings.where("spelling <> ''").distinct()
    refs = spellings.withColumn("ref_set", pairs_of(F.col("spelling"))).withColumnRenamed("spelling", "ref_spelling")
    refs = cut(refs.withColumn("ref_no", F.xxhash64("ref_id", "ref_spelling", "side", "exact")))
    small = refs.limit(REFERENCE_ROWS + 1).count() <= REFERENCE_ROWS
    counts = refs.select(F.explode("ref_set").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    rarity = counts.agg(F.map_from_entries(F.collect_list(F.struct("token", "df"))).alias("rarity"))

    def ordered(df: DataFrame, tokens: str, n: str) -> DataFrame:
        """Tokens in order of rarity, then of themselves."""
        rare = F.transform(tokens, lambda t: F.struct(F.coalesce(F.try_element_at("rarity", t), F.lit(0)).alias("df"), t.alias("token")))
        return df.join(F.broadcast(rarity)).withColumn(tokens, F.transform(F.array_sort(rare), lambda x: x["token"])).drop("rarity").withColumn(n, F.size(tokens))

    def prefixes(df: DataFrame, key: str, tokens: str, n: str, place: str) -> DataFrame:
        """One row per prefix token."""
        length = (F.col(n) - F.ceil(F.lit(threshold) * F.col(n) - 1e-9) + 1).cast("int")
        return df.select(key, n, F.posexplode(F.slice(tokens, 1, length)).alias(place, "token"))

    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = cut(ordered(values.select("spelling").repartition(tasks, "spelling").withColumn("set", pairs_of(F.col("spelling"))), "set", "n")).repartition(tasks, "spelling")
    refs = cut(ordered(refs, "ref_set", "m"))
    left, right = prefixes(sets, "spelling", "set", "n", "place"), prefixes(refs, "ref_no", "ref_set", "m", "ref_place")
    # only numbers are gathered per pair; the places of the first shared token, the left one before the right one
    first = F.min(F.col("place").cast("long") * (1 << 20) + F.col("ref_place"))
    met = (
        left.join(F.broadcast(right) if small else right, "token")
        .where((F.col("m") >= threshold * F.col("n")) & (F.col("n") >= threshold * F.col("m")))
        .groupBy("spelling", "ref_no", "n", "m")
        .agg(first.alias("first"))
    )
    # positional filter: what can still agree behind the first shared token
    most = 1 + F.least(F.col("n") - F.floor(F.col("first") / (1 << 20)) - 1, F.col("m") - F.col("first") % (1 << 20) - 1)
    met = met.where(most / (F.col("n") + F.col("m") - most) >= threshold - 1e-9).select("spelling", "ref_no")
    entries = refs.select("ref_no", "ref_id", "side", "exact", "ref_set")
    met = met.join(sets.select("spelling", "set"), "spelling").join(F.broadcast(entries) if small else entries, "ref_no")
    likeness = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    checked = met.withColumn("likeness", likeness("set", "ref_set")).where((F.col("likeness") >= threshold) & (~F.col("exact") | (F.col("likeness") == 1)))
    side = pairs_of(F.col("side"))
    rest = F.when(F.col("side") == "", F.col("likeness")).otherwise(likeness(F.array_except("set", side), F.array_except("ref_set", side)))
    good = checked.withColumn("rest", rest).where(F.col("rest") >= threshold)
    return good.groupBy("spelling").agg(
        F.max_by("ref_id", F.struct("likeness", "rest", (-F.col("ref_id")).alias("r"))).alias("ref_id"), F.max("likeness").alias("likeness")
    )


def found(subcaptions: DataFrame, modality_ref: DataFrame, region_ref: DataFrame) -> DataFrame:
    """p5_found: ``subfig_id, field, ref_id`` of each typed value that isn't an entry's very name; 0: unmatched."""
    parts = []
    for field, ref, name, spellings, sides in (
        ("modality", modality_ref, "modality_name", modality_spellings(modality_ref), False),
        ("anatomical_region", region_ref, "region_name", region_spellings(region_ref), True),
    ):
        typed = subcaptions.select("subfig_id", F.col(field).alias("typed")).where(F.col("typed").isNotNull())
        plain = F.lower(F.trim(F.regexp_replace("typed", r"[\s ]+", " ")))
        names = ref.select(F.col(name).alias("typed"))
        names = F.broadcast(names) if names.limit(REFERENCE_NAMES + 1).count() <= REFERENCE_NAMES else names
        typed = typed.where(~plain.isin(*MISSING)).join(names, "typed", "left_anti")
        different = cut(typed.select("typed").distinct().withColumn("spelling", spelled(F.col("typed"), sides)))
        best = best_matches(different.select("spelling").where("spelling <> ''").distinct(), spellings, THRESHOLDS[field])
        mapped = different.join(best, "spelling", "left").select("typed", "ref_id")
        parts.append(typed.join(mapped, "typed", "left").select("subfig_id", F.lit(field).alias("field"), F.coalesce("ref_id", F.lit(0)).alias("ref_id")))
    return parts[0].unionByName(parts[1])
