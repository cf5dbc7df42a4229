"""Problem 6: noise in text from scanned pages.

Method: digits are masked to find running headers, lines are put together again with SQL windows, and misread
characters are found by grouping words under a skeleton of confusable glyphs and choosing the frequent form.

* Page numbers: lines that hold nothing but a number in one of the usual dresses, and headers that begin or end with a
  number which isn't a volume's or a year.
* Headers: a line in title or upper case whose *core* (digits masked, dress such as "Vol. 12" or "CASE REPORT" taken off)
  stands in a dress in at least ``DRESSED_SHARE`` of the texts of several lines, and twice or more.
* Hyphens: among the lines that are left, one that ends in a letter and a hyphen before a line that goes on in lower
  case; the two halves are joined.
* Characters: all words of the collection are counted; under one skeleton, a form ``RATIO`` times rarer than the
  prevailing one may be a misreading of it, and is one if the context supports that: in ``SUPPORT`` of its places the word
  before it, or the one behind it, stands by the prevailing form ``PLACE_RATIO`` times as often.  All of these are ratios,
  so the result doesn't change when the collection is doubled.

Edge cases: null, empty and blank texts carry no trace and come out as they are; a text without line ends can only
carry misread characters; repeated rows count once, rows of one id are told apart by their text; empty tables give empty tables; texts of any length are
read whole.  The list of misread forms is broadcast only up to ``BROADCAST_FORMS`` rows, beyond it is joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velmira.session import cut

DRESSED = 2
DRESSED_SHARE = 0.001
RATIO = 8
SUPPORT = 0.5
PLACE_RATIO = 3
BROADCAST_FORMS = 200_000
_HYPHENS = "-\u00ad\u2010\u2011\u00ac"
_PAGE = r"^\s*(?:\[\s*\d{1,5}\s*\]|\(\s*\d{1,5}\s*\)|[-–—~]\s*\d{1,5}\s*[-–—~]|(?i:page|pg\.?|p\.|s\.)\s*\d{1,5}(?:\s*(?:of|/|von)\s*\d{1,5})?|\d{1,5}(?:\s*/\s*\d{1,5})?)\s*$"
_DRESS = r"(?i:\bcase reports?\b|\boriginal articles?\b|\breview articles?\b|\bvol(?:ume)?\b\.?|\bno\b\.|\bpp?\b\.|\bissue\b)|[#·|—–•:,()]"
_TITLE = r"^(?:[\p{Lu}#][\p{L}\p{N}'’.-]*|of|the|in|on|and|for|&|[#·|—–•:,()]+|[Vv]ol\.?|[Oo]riginal|article|\s)+$"
# fixed values: glyphs that scanners take for one another (¢ stands for a bracket inside a word), then pairs for one
GLYPHS = ("oa0", "lI1i!|", "s5", "ceéè¢", "tf", "gq9", "hb6", "vy")
PAIRS = (("", ""), ("ri", "n"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"))
_WORD = r"[\p{L}0-9!|¢]*\p{L}[\p{L}0-9!|¢]*"


def skeletons(word: Column) -> Column:
    """The word with every confusable glyph replaced by its class, once for each pair that may stand for one glyph."""
    plain = F.replace(F.replace(F.lower(word), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    forms = []
    for pair, one in PAIRS:
        out = F.replace(plain, F.lit(pair), F.lit(one)) if pair else plain
        out = F.translate(out, "".join(g[1:] for g in GLYPHS), "".join(g[0] * (len(g) - 1) for g in GLYPHS))
        forms.append(F.concat(F.lit(pair + " "), out))
    return F.array(*forms)


def texts_of(patients: DataFrame, evidence: DataFrame) -> DataFrame:
    """``field, row_id, text`` of the texts that aren't blank."""
    a = patients.select(F.lit("semiology_text").alias("field"), F.col("record_id").alias("row_id"), F.col("semiology_text").alias("text"))
    b = evidence.select(F.lit("evidence_quote").alias("field"), F.col("gt_id").alias("row_id"), F.col("evidence_quote").alias("text"))
    return a.unionByName(b).where(F.col("text").rlike(r"\S"))


def marked_lines(texts: DataFrame) -> DataFrame:
    """``field, row_id, text_key, pos, line, pageno, header`` of the texts of more than one line."""
    several = texts.where(F.col("text").rlike(r"[\r\n]")).groupBy("field", "row_id", F.xxhash64("text").alias("text_key")).agg(F.first("text").alias("text"))
    lines = several.select("field", "row_id", "text_key", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line"))
    lines = lines.withColumn("first", F.col("pos") == 0).where(F.col("line").rlike(r"\S") | F.col("first"))
    page = F.col("line").rlike(_PAGE)
    masked = F.regexp_replace(F.trim("line"), r"\d+", "#")
    titled = ~page & F.col("line").rlike(r"\S") & masked.rlike(_TITLE) & (F.regexp_count(masked, F.lit(r"\p{Lu}")) >= 2)
    core = F.trim(F.regexp_replace(F.lower(F.regexp_replace(masked, _DRESS, " ")), r"\s+", " "))
    dressed = masked.rlike(r"#|\||·|—|(?i:\bcase report\b|\boriginal article\b)") | (masked == F.upper(masked))
    lines = lines.withColumns({"pageno": page, "core": F.when(titled & (core != ""), core), "dressed": dressed})
    least = lines.where("first").agg(F.greatest(F.lit(float(DRESSED)), F.count("*") * DRESSED_SHARE).alias("least"))
    cores = lines.where("core is not null and dressed").groupBy("core").agg(F.count("*").alias("n")).join(F.broadcast(least)).where("n >= least")
    # a core of one word is a name or a label, not a header
    cores = cores.where(F.size(F.split("core", " ")) >= 2).select("core", F.lit(True).alias("header"))
    cores = _joinable(cores)
    # a number at either end of a header is a page's, unless it is a volume's or a year
    bare = F.regexp_replace("line", r"(?i)\b(?:vol(?:ume)?|no|issue)\b\.?\s*\d+\s*$|\b(?:19|20)\d\d\b", " ")
    numbered = bare.rlike(r"^\W*\d{1,5}\b|\b\d{1,5}\W*$")
    header = F.coalesce("header", F.lit(False))
    return lines.join(cores, "core", "left").select("field", "row_id", "text_key", "pos", "line", (F.col("pageno") | (header & numbered)).alias("pageno"), header.alias("header"))


def reflowed(marked: DataFrame) -> DataFrame:
    """``field, row_id, text_key, text, hyphen, header, pageno``: one row per text of more than one line, in one piece."""
    key = ["field", "row_id", "text_key"]
    text = Window.partitionBy(*key).orderBy("pos")
    kept = marked.where(F.col("line").rlike(r"\S") & ~F.col("header") & ~F.col("pageno")).withColumn("after", F.lead("line").over(text))
    broken = F.rtrim("line").rlike(rf"\p{{L}}[{_HYPHENS}]$") & F.ltrim(F.coalesce("after", F.lit(""))).rlike(r"^\p{Ll}")
    kept = kept.withColumn("broken", broken)
    own = F.rtrim("line").rlike(r"(?i)\b(?:drug|non|[a-z]\d)-$")  # the hyphen of a compound stays
    piece = F.when(F.col("broken") & ~own, F.regexp_replace(F.rtrim("line"), rf"[{_HYPHENS}]$", "")).when(F.col("broken"), F.rtrim("line")).otherwise(F.concat(F.trim("line"), F.lit(" ")))
    joined = kept.select(*key, "pos", "broken", F.ltrim(piece).alias("piece")).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"), F.bool_or("broken").alias("hyphen")
    )
    flags = marked.groupBy(*key).agg(F.bool_or("header").alias("header"), F.bool_or("pageno").alias("pageno"))
    out = flags.join(joined, key, "left")
    return out.select(*key, F.trim(F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("text"), F.coalesce("hyphen", F.lit(False)).alias("hyphen"), "header", "pageno")


_BRACKET = r"(?<=\p{L})\((?=\p{L}|\s+\p{Ll})"  # a bracket that a word runs into, or that ends one before a plain word


def _words(text: Column) -> Column:
    # the marks are rare, so most texts go through one pattern only
    low = F.lower(text)
    plain = F.when(low.contains("!"), F.regexp_replace(low, r"!(?=\s|$|[.,;:)\"”])", " ")).otherwise(low)
    marked = F.when(plain.contains("("), F.regexp_replace(plain, _BRACKET, "¢")).otherwise(plain)
    return F.regexp_extract_all(marked, F.lit(_WORD), F.lit(0))


def rival_forms(texts: DataFrame) -> DataFrame:
    """``form, right``: words of the texts and the much more frequent form of the same skeleton."""
    # exploded as an expression: of a column Spark would first test the size, and read every text twice for that
    forms = texts.select(F.explode(_words(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    forms = forms.where(F.length("form") >= 3).withColumn("skeleton", F.explode(skeletons(F.col("form"))))
    group = Window.partitionBy("skeleton")
    ranked = forms.withColumn("best", F.max(F.struct("n", F.col("form").rlike(r"^[a-z]+$").alias("plain"), "form")).over(group))
    wrong = (F.col("form") != F.col("best.form")) & (F.col("best.n") >= RATIO * F.col("n"))
    # codes such as t1w or fp2 have letters and digits by right; the prevailing form must be a plain word
    found = ranked.where(wrong & F.col("best.form").rlike(r"^\p{L}+$"))
    return found.groupBy("form").agg(F.max_by("best.form", F.struct("best.n", "best.form")).alias("right"))


def _sieve(keys: DataFrame, hashed: Column) -> Callable[[Column], Column]:
    """A test of hashes against the keys, which lets some others through but drops none: a table of at most 2^22 bits
    (half a megabyte, whatever the number of keys) that goes into the plan as one constant."""
    bits = min(max(1 << 14, 1 << int(32 * keys.count()).bit_length()), 1 << 22)
    place = lambda h: F.pmod(h, F.lit(bits))
    rows = keys.select(place(hashed).alias("p")).groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).collect()
    table = [0] * (bits // 64)
    for r in rows:
        table[r.i] = r.b
    constant = F.from_json(F.lit(str(table)), "array<bigint>")
    return lambda h: F.getbit(F.get(constant, F.shiftright(place(h), 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1


def misread_words(texts: DataFrame, key: list[str]) -> DataFrame:
    """``key, form, right``: the misread words of each text (``key, text``), once for every place.

    Only words that may be misread, and only neighbours that some of them stand next to, leave their text.
    """
    words = texts.select(*key, _words(F.col("text")).alias("w"))
    rivals = cut(rival_forms(texts))
    may_be = _sieve(rivals, F.xxhash64("form"))
    near = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    odd = F.transform("w", lambda x, i: F.when(may_be(F.xxhash64(x)), F.struct(x.alias("form"), near(i - 1).alias("before"), near(i + 1).alias("after"))))
    odd = words.select(*key, F.inline(F.filter(odd, lambda p: p.isNotNull()))).join(_joinable(rivals), "form")
    odd = cut(odd.select(*key, "form", "right", "before", "after"))
    # the prevailing form has to be usual in the very place, not only somewhere: before a word or behind one it stands
    # PLACE_RATIO times as often as the odd form does
    asked = odd.where("before <> ''").select(F.col("before").alias("l"), F.col("right").alias("r"))
    asked = cut(asked.union(odd.where("after <> ''").select(F.col("right").alias("l"), F.col("after").alias("r"))).distinct())
    is_asked = _sieve(asked, F.xxhash64("l", "r"))
    pairs = F.transform("w", lambda x, i: F.when(is_asked(F.xxhash64(F.get("w", i - 1), x)), F.struct(F.get("w", i - 1).alias("l"), x.alias("r"))))
    counts = words.select(F.inline(F.filter(pairs, lambda p: p.isNotNull()))).where("l is not null").groupBy("l", "r").agg(F.count("*").alias("usual"))
    counts = cut(counts)
    places = odd.groupBy("form", "right", "before", "after").agg(F.count("*").alias("n"))
    for side, left, right in (("before", "before", "right"), ("after", "right", "after")):
        at = places.where(f"{side} <> ''").groupBy("form", "right", side).agg(F.sum("n").alias("m"))
        usual = counts.select(F.col("l").alias(left), F.col("r").alias(right), "usual")
        fits = at.join(usual, [left, right]).where(F.col("usual") >= PLACE_RATIO * F.col("m"))
        places = places.join(fits.select("form", "right", side, F.lit(True).alias(f"fits_{side}")), ["form", "right", side], "left")
    supported = F.sum(F.when(F.col("fits_before").isNotNull() | F.col("fits_after").isNotNull(), F.col("n")).otherwise(0))
    good = cut(places.groupBy("form", "right").agg((supported / F.sum("n")).alias("support")).where(F.col("support") >= SUPPORT).select("form", "right"))
    return odd.join(_joinable(good), ["form", "right"]).select(*key, "form", "right")


def _joinable(forms: DataFrame) -> DataFrame:
    forms = cut(forms)
    return F.broadcast(forms) if forms.count() <= BROADCAST_FORMS else forms


def traces(patients: DataFrame, evidence: DataFrame) -> DataFrame:
    """p6_found: ``field, row_id, kind``: one row per text and trace."""
    texts = texts_of(patients, evidence)
    flowed = cut(reflowed(marked_lines(texts)))
    single = texts.where(~F.col("text").rlike(r"[\r\n]"))
    whole = single.select("field", "row_id", "text").unionByName(flowed.where("text is not null").select("field", "row_id", "text"))
    chars = misread_words(whole, ["field", "row_id"]).select("field", "row_id").distinct().withColumn("kind", F.lit("chars"))
    kinds = F.filter(F.array(*(F.when(F.col(k), F.lit(k)) for k in ("hyphen", "header", "pageno"))), lambda k: k.isNotNull())
    lines = flowed.select("field", "row_id", F.explode(kinds).alias("kind"))
    return lines.unionByName(chars).distinct()


def repaired(patients: DataFrame, evidence: DataFrame) -> DataFrame:
    """``field, row_id, text``: every text as one continuous piece without headers and page numbers, with misread
    words put right where the prevailing form is known (case of the first letter kept)."""
    texts = texts_of(patients, evidence)
    flowed = cut(reflowed(marked_lines(texts)))
    single = texts.where(~F.col("text").rlike(r"[\r\n]"))
    whole = single.select("field", "row_id", F.xxhash64("text").alias("text_key"), "text").unionByName(flowed.select("field", "row_id", "text_key", F.coalesce("text", F.lit("")).alias("text")))
    key = ["field", "row_id", "text_key"]
    fixes = misread_words(whole, key).groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("form", "right"))).alias("fixes"))
    border = r"(?<=[\p{L}0-9!|¢])(?![\p{L}0-9!|¢])|(?<![\p{L}0-9!|¢])(?=[\p{L}0-9!|¢])"

    def right(word: Column) -> Column:
        known = F.try_element_at("fixes", F.lower(word))
        capital = F.concat(F.upper(F.substring(known, 1, 1)), F.substr(known, F.lit(2)))
        return F.coalesce(F.when(word.rlike(r"^\p{Lu}"), capital).otherwise(known), word)

    fixed = F.array_join(F.transform(F.split(F.regexp_replace("text", _BRACKET, "¢"), border), right), "")
    return whole.join(fixes, key, "left").select("field", "row_id", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(fixed).alias("text"))
