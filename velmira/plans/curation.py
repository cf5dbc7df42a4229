"""Registered queries of labels, linking, splits, metrics and reports, with oracles written for themselves.

Where an oracle needs expected values, they are written down by hand (``GOLDEN``), not derived from the rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velmira.functions import rules, text
from velmira.functions.ids import paper_number
from velmira.operators import features, images, labels, linking, metrics, report, splits
from velmira.session import table

# fixed values: phrases and the class that each must get
GOLDEN = (
    ("ez_localization", "bilateral temporal", "Multifocal"),
    ("ez_localization", "Bilateral frontal", "Multifocal"),
    ("ez_localization", "left fronto-temporal", "Multifocal"),
    ("ez_localization", "right temporo-parietal", "Multifocal"),
    ("ez_localization", "Temporal-parietal-occipital", "Multifocal"),
    ("ez_localization", "left hemisphere", "Hemispheric"),
    ("ez_localization", "right hemispheric", "Hemispheric"),
    ("ez_localization", "mesial temporal", "Temporal"),
    ("ez_localization", "left temporal", "Temporal"),
    ("ez_localization", "left frontal", "Extratemporal"),
    ("ez_localization", "right parietal", "Extratemporal"),
    ("ez_localization", "Opercular", "Extratemporal"),
    ("ez_localization", "Frontobasal", "Extratemporal"),
    ("ez_localization", "cingulate", "Extratemporal"),
    ("ez_localization", "Focal", "Unknown"),
    ("ez_localization", "Left", "Unknown"),
    ("ez_localization", "Right", "Unknown"),
    ("ez_localization", "cryptogenic", "Unknown"),
    ("ez_localization", "multifocal", "Multifocal"),
    ("ez_localization", "", None),
    ("ez_localization", "none", None),
    ("ez_localization", "extra-temporal", "Extratemporal"),
    ("ez_localization", "extratemporal", "Extratemporal"),
    ("ez_localization", "temporal and frontal", "Multifocal"),
    ("status_epilepticus", "refractory status epilepticus", "Refractory SE"),
    ("status_epilepticus", "RSE developed during admission", "Refractory SE"),
    ("status_epilepticus", "super-refractory status", "Refractory SE"),
    ("status_epilepticus", "non-convulsive status epilepticus", "Non-convulsive SE"),
    ("status_epilepticus", "NCSE on EEG", "Non-convulsive SE"),
    ("status_epilepticus", "absence status", "Non-convulsive SE"),
    ("status_epilepticus", "convulsive status epilepticus", "Convulsive SE"),
    ("status_epilepticus", "generalized tonic-clonic status", "Convulsive SE"),
    ("status_epilepticus", "GCSE", "Convulsive SE"),
    ("status_epilepticus", "no history of status epilepticus", "None"),
    ("status_epilepticus", "without status epilepticus", "None"),
    ("status_epilepticus", "status epilepticus reported", "Unknown"),
    ("status_epilepticus", "not mentioned", None),
    ("status_epilepticus", "no history of refractory status epilepticus", "Refractory SE"),
    ("aed_response", "drug-resistant", "drug-resistant"),
    ("aed_response", "refractory epilepsy", "drug-resistant"),
    ("aed_response", "seizure-free for 2 years", "drug-responsive"),
    ("aed_response", "taking AED", "unspecified"),
    ("surgery_outcome", "Engel I", "Seizure-free"),
    ("surgery_outcome", "Engel class III", "Improved"),
    ("surgery_outcome", "Engel IV", "No improvement"),
    ("surgery_outcome", "no surgery", "Not applicable"),
    ("surgery_outcome", "no improvement", "Improved"),
    ("surgery_outcome", "not seizure-free", "Seizure-free"),
    ("surgery_outcome", "engel 1a", None),
    ("epilepsy_type", "focal", "Focal"),
    ("epilepsy_type", "generalized", "Generalised"),
    ("epilepsy_type", "JME", "Generalised"),
    ("epilepsy_type", "TLE", "Focal"),
    ("epilepsy_type", "complex", "Focal"),
    ("epilepsy_type", "multiple", "Focal"),
    ("epilepsy_type", "focal and generalised", "Combined Focal and Generalised"),
    ("epilepsy_type", "cryptogenic", "Unknown"),
    ("seizure_type", "focal onset", "Focal"),
    ("seizure_type", "tonic-clonic", "Generalised"),
    ("seizure_type", "unclassified", "Unclassified"),
    ("seizure_type", "fast activity", "Focal"),
    ("seizure_type", "witnessed generalised seizure", "Unknown"),
    ("seizure_type", "status epilepticus", None),
)
# fixed values: file names and the figure that each shows
FIGURE_FILES = (("PMC1_fig3.jpg", "fig3"), ("abc_f12.jpg", "fig12"), ("Figure-7.png", "fig7"), ("xF02.gif", "fig02"), ("fig 5.jpg", None), ("scan.png", None), ("ABC-figure11.tif", "fig11"))
# fixed values: captions and their parts
CAPTIONS = (
    ("(A) T1-weighted MRI showing lesion. (B) FLAIR sequence.", "A=T1-weighted MRI showing lesion|B=FLAIR sequence"),
    ("A: Axial MRI. B: Coronal view.", "A=Axial MRI|B=Coronal view"),
    ("A, preoperative MRI; B, postoperative MRI", "A=preoperative MRI|B=postoperative MRI"),
    ("(a-c) MRI sequences. (d) EEG recording.", "A=MRI sequences|B=MRI sequences|C=MRI sequences|D=EEG recording"),
    ("(A) one. (A) two. (B) three.", "A=one|B=three"),
    ("(A, B & C) all. (D) rest.", "A=all|B=all|C=all|D=rest"),
    ("One panel (A) alone", ""),
    ("", ""),
)
_q = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
r6 = lambda c, name: F.round(c, 6).alias(name)

_TASK_SQL = "['" + "','".join(rules.TASKS) + "']"
_ANSWER = "CASE gt_id % 4 WHEN 0 THEN truth WHEN 1 THEN upper(truth) WHEN 2 THEN 'Label: ' || lower(truth) || '!' ELSE left(evidence_quote, 200) END"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else _q(v) for v in r) + ")" for r in rows) + ")"


def _listed(column: str) -> str:
    """Number of quoted strings of a well-formed list literal, else 0."""
    one = """(?:''[^'']*''|"[^"]*")"""
    return f"CASE WHEN regexp_matches({column}, '^\\s*\\[\\s*(?:{one}\\s*(?:,\\s*{one}\\s*)*,?\\s*)?\\]\\s*$') THEN len(regexp_extract_all({column}, '{one}')) ELSE 0 END"


def _answers(s, d) -> DataFrame:
    """Answers in four dresses, one of them free text."""
    e = table(s, d, "task_evidence").where(F.col("task").isin(*rules.TASKS))
    k = F.col("gt_id") % 4
    raw = F.when(k == 0, F.col("truth")).when(k == 1, F.upper("truth")).when(k == 2, F.concat(F.lit("Label: "), F.lower("truth"), F.lit("!"))).otherwise(F.left("evidence_quote", F.lit(200)))
    return labels.with_answers(e.withColumn("raw", raw), "task", "raw").select("gt_id", "task", "truth", "answer")


def _preds(s, d) -> DataFrame:
    return _answers(s, d).where("truth is not null").select("gt_id", "task", F.col("truth").alias("y"), F.col("answer").alias("p"))


def _tiers(s, d) -> DataFrame:
    names = {"A": "gold", "B": "train", "C": "bronze", "D": "expansion"}
    kind = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return splits.task_rows(table(s, d, "patients"), ["record_id", "tier"]).withColumn("part", F.try_element_at(kind, F.col("tier"))).where("part is not null")


def _runs(s, d) -> DataFrame:
    e = table(s, d, "events")
    runs = e.select(F.col("event_type").alias("baseline"), F.concat(F.lit("t"), (F.col("user_id") % 6).cast("string")).alias("task"), (F.col("event_id") % 5).cast("int").alias("seed"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("f1"))
    return runs.groupBy("baseline", "task", "seed").agg(F.round(F.avg("f1"), 4).alias("f1"), F.count("*").alias("n_test"))


_RUNS = "WITH r AS (SELECT event_type AS baseline, 't' || CAST(user_id % 6 AS VARCHAR) AS task, CAST(event_id % 5 AS INT) AS seed, round(avg(CASE WHEN event_id % 11 <> 0 THEN value END), 4) AS f1, count(*) AS n_test FROM events GROUP BY ALL)"


def _figures(s, d) -> DataFrame:
    """``p_partkey, width, height`` of invented figures of many shapes."""
    return table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 37 * 40 + 100).cast("int").alias("width"), (F.col("p_partkey") % 23 * 50 + 100).cast("int").alias("height"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    golden = lambda s: s.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(GOLDEN)], "i int, task string, raw string")
    panels = lambda s, d: table(s, d, "subcaptions")
    patients = lambda s, d: table(s, d, "patients")
    evidence = lambda s, d: table(s, d, "task_evidence")
    paper = lambda: paper_number(F.col("pmc_id")).alias("paper")
    details = lambda s, d: panels(s, d).select("subfigure_path", "subfig_id", "subcaption", "confidence")
    return {
        "q04_golden_labels": lambda s, d: rules.with_labels(golden(s), F.col("task"), "raw", "label").select("i", "label"),
        "q11_parse_label": lambda s, d: _answers(s, d).select("gt_id", "answer"),
        "q12_pred_fallback": lambda s, d: labels.with_fallback(_answers(s, d), "task", "answer", only_populated=True).groupBy("task").agg(F.count("*").alias("n"), F.count_if("invalid").alias("n_invalid"), F.sum("label_id").cast("bigint").alias("sum_ids")),
        "q15_caption_cases": lambda s, d: s.createDataFrame([(i, c) for i, (c, _) in enumerate(CAPTIONS)], "i int, c string").select("i", F.array_join(F.transform(text.labelled_parts(F.col("c")), lambda x: F.concat(x["label"], F.lit("="), x["text"])), "|").alias("parts")),
        "q17_figure_cases": lambda s, d: s.createDataFrame([(i, p) for i, (p, _) in enumerate(FIGURE_FILES)], "i int, p string").select("i", text.figure_id(F.col("p")).alias("figure")),
        "q19_caption_levels": lambda s, d: panels(s, d).select("subfig_id", text.caption_levels(F.concat(F.lit("(Y) First part. (Z) "), "subcaption"), F.when(F.col("subfig_id") % 3 != 0, F.lit("y")).otherwise("q"), F.when(F.col("subfig_id") % 2 == 0, F.col("modality"))).alias("x")).select("subfig_id", "x.text", "x.confidence"),
        "q22_document_id": lambda s, d: patients(s, d).select("record_id", text.document_id(F.col("pmc_id")).alias("document"), F.concat_ws("_p", "pmc_id", "patient_num").alias("patient_key")),
        "q23_support": lambda s, d: splits.support(_tiers(s, d).where("part = 'train'"), ["task", "label"]).select("task", "label", "n", "status"),
        "q27_regime_union": lambda s, d: splits.regime_rows(_tiers(s, d), "part").groupBy("regime", "task").agg(F.count("*").alias("n_train"), F.count_distinct("label_id").alias("n_classes")),
        "q27_regime_scored": lambda s, d: splits.scored_rows(_tiers(s, d), "part").groupBy("regime", "part").agg(F.count("*").alias("n")),
        "q27_head_sizes": lambda s, d: splits.head_sizes([_tiers(s, d).where(F.col("part") == p) for p in ("train", "bronze")], ["task"], "label_id"),
        "q30_full_report": lambda s, d: metrics.full_report(_preds(s, d), ["task"]).where("label in ('accuracy', 'macro avg', 'weighted avg')").select("task", "label", r6(F.col("f1"), "f1"), "support"),
        "q32_macro_f1_populated": lambda s, d: metrics.macro_f1(_preds(s, d), ["task"], labels.class_table(s).where("populated").select("task", "label")).select("task", r6(F.col("macro_f1"), "macro_f1"), "n_labels"),
        "q33_agreement": lambda s, d: metrics.agreement(_preds(s, d), ["task"]).select("task", "n_valid", "n_invalid", r6(F.col("agreement"), "agreement")),
        "q38_best_per_tier": lambda s, d: report.best_per_tier(_runs(s, d).withColumn("tier", F.concat(F.lit("s"), F.col("seed").cast("string"))), "tier", "baseline", "f1").select("tier", "baseline", r6(F.col("score"), "score")),
        "q39_seed_mean": lambda s, d: report.seed_means(_runs(s, d), ["baseline", "task"], "f1", "n_test", "seed").select("baseline", "task", r6(F.col("mean"), "mean"), F.size("values").alias("n_values"), F.round(F.get("values", F.lit(0)), 4).alias("first_value"), "n_seeds", "n_first"),
        "q42_populated_weights": lambda s, d: metrics.populated_weights(_preds(s, d), ["task"], labels.class_table(s).select("task", "label", "populated")).select("task", "label", "populated", "n", r6(F.col("weight"), "weight")),
        "q44_renditions": lambda s, d: images.renditions(panels(s, d).select(F.col("subfigure_path").alias("path")).union(panels(s, d).where("subfig_id % 3 = 0").select(F.regexp_replace("subfigure_path", r"\.\w+$", ".tif")))).select("stem", F.array_join("paths", " ").alias("paths"), "n_types"),
        "q45_first_of_each": lambda s, d: images.first_of_each(panels(s, d).select("source_image", "subfig_id", "subfigure_label").where("source_image is not null"), ["source_image"], "subfig_id"),
        "q46_grid_lines": lambda s, d: report.gap_clusters(table(s, d, "orders").select("o_custkey", (F.col("o_orderkey") % 1000).cast("long").alias("place")).distinct(), ["o_custkey"], "place", 20, size=1000),
        "q50_aspect_grid": lambda s, d: _figures(s, d).select("p_partkey", F.inline(images.aspect_grid(F.col("width"), F.col("height")))),
        "q51_link_subfigures": lambda s, d: linking.linked_profiles(
            panels(s, d).select("subfig_id", paper(), text.figure_number(F.col("source_image")).alias("figure_no")),
            patients(s, d).select(paper(), F.col("patient_num").cast("string").alias("patient_ref"), F.array(F.concat(F.lit("Figure "), F.col("num_linked_figures").cast("string"))).alias("figure_refs")),
        ).select("subfig_id", "n_profiles", "first_ref"),
        "q52_caption_lookup": lambda s, d: linking.with_details(panels(s, d).select(F.col("subfig_id").alias("panel"), F.when(F.col("subfig_id") % 10 != 0, F.col("subfigure_path")).alias("subfigure_path")), details(s, d), "subfigure_path", "subfig_id").select("panel", "subcaption", "confidence"),
        "q52_back_to_rows": lambda s, d: linking.back_to_rows(panels(s, d).select(F.col("subfig_id").alias("panel"), "source_image"), panels(s, d).select("source_image", "subfig_id", "subfigure_label"), "source_image", "subfig_id").select("panel", "subfigure_label"),
        "q52_manifest_join": lambda s, d: table(s, d, "split_manifest").select("record_id", "fold").distinct().join(patients(s, d).select("record_id", "patient_num", "tier"), "record_id"),
        "q54_merged_chunks": lambda s, d: linking.merged_chunks(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") > 0.05).alias("has_data"), F.nullif("l_returnflag", F.lit("N")).alias("kind"), F.array(F.col("l_partkey").cast("string")).alias("items")), "l_orderkey", "l_linenumber", "has_data", "kind", "items").select("l_orderkey", "has_data", "kind", F.array_join("items", " ").alias("items")),
        "q56_range_link": lambda s, d: linking.range_links(table(s, d, "orders").select("o_custkey", F.concat(F.lit("patients "), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit("-"), (F.col("o_orderkey") % 7 + 1).cast("string")).alias("ref")), table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 6 + 1).alias("number")), "o_custkey", "ref", "number").groupBy("o_custkey", "number").agg(F.count("*").alias("n_facts")),
        "q58_quoted_documents": lambda s, d: linking.documents_with_quotes(evidence(s, d), "pmc_id", "evidence_quote"),
        "q58_modality_mentioned": lambda s, d: panels(s, d).where(F.coalesce(F.col("modality").rlike("(?i)MRI|EEG"), F.lit(False))).select("subfig_id"),
        "q60_contributions": lambda s, d: features.contributions(table(s, d, "embeddings").select(F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("mri"), F.when(F.col("vec_id") % 2 != 0, F.col("embedding")).alias("eeg")), ["mri", "eeg"]),
        "q62_masked_logits": lambda s, d: table(s, d, "embeddings").select("vec_id", features.argmax(features.masked(F.col("embedding"), [0, 2, 5, 9, 33])).alias("pred")),
        "q62_sigmoid_cosine": lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(features.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 5).alias("cosine"), F.round(F.get(features.sigmoid(F.transform("embedding", lambda x: x.cast("double"))), F.lit(0)), 6).alias("first")),
        "q63_kind_of_best": lambda s, d: table(s, d, "embeddings").select("vec_id", images.kind_of_best(F.transform("embedding", lambda x: F.abs(x).cast("double")), ["MRI"] * 14 + ["EEG"] * 10 + ["CT"] * 10 + ["OTHER"] * 30).alias("kind")),
        "q67_gate": lambda s, d: table(s, d, "papers").select("pmc_id", linking.gate(F.when(F.col("n_sections") > 4, " Case_Series ").otherwise("trial"), ["case_series"], ["review-article"], F.col("article_type")).alias("status")),
        "q68_run_summary": lambda s, d: report.run_summary(table(s, d, "papers").select(F.col("article_type").alias("kind"), "n_sections"), "kind", "n_sections"),
        "q69_fact_block": lambda s, d: evidence(s, d).where("evidence_quote is not null and truth is not null").select("gt_id", text.numbered_facts(F.array(F.struct(F.col("truth").alias("fact"), F.left("evidence_quote", F.lit(60)).alias("quote")), F.struct(F.col("task").alias("fact"), F.lit("q").alias("quote")))).alias("block")),
        "q69_listed_lines": lambda s, d: panels(s, d).select("subfig_id", text.listed_lines("Panels:", F.array(F.struct(F.coalesce("subfigure_label", F.lit("?")).alias("label"), F.col("subcaption").alias("caption"))), 40).alias("lines")),
        "q36_plain_pivot": lambda s, d: report.plain_pivot(_runs(s, d).groupBy("baseline", "task").agg(F.round(F.avg("f1"), 4).alias("f1")), "baseline", "task", [f"t{i}" for i in range(6)], "f1"),
    }


def oracle_sql() -> dict[str, str]:
    classes = _values([(t, c, i, str(c not in rules.UNPOPULATED.get(t, ()))) for t in rules.TASKS for i, c in enumerate(rules.CLASSES[t])])
    known = lambda n: "".join(c for c in n.lower() if c.isalnum() or c in " -")
    usual = _values([(t, known(k), v, i) for t in rules.TASKS for i, (k, v) in enumerate(labels.SYNONYMS[t].items())])
    named = _values([(t, c, known(c), i) for t in rules.TASKS for i, c in enumerate(rules.CLASSES[t])])
    answers = (
        f"WITH c(task, label, label_id, pop) AS {classes}, u(task, k, v, i) AS {usual}, nm(task, label, k, i) AS {named},"
        f" e AS (SELECT gt_id, task, truth, {_ANSWER} AS raw FROM task_evidence WHERE list_contains({_TASK_SQL}, task)),"
        r" n AS (SELECT *, lower(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '[^\p{L}\p{N} -]', '', 'g')) AS norm FROM e),"
        " hits AS (SELECT gt_id, 100 AS r, raw AS v FROM n SEMI JOIN c ON n.task=c.task AND n.raw=c.label"
        " UNION ALL SELECT gt_id, 200 + i, v FROM n JOIN u ON n.task=u.task AND norm=k"
        " UNION ALL SELECT gt_id, 300 + i, label FROM n JOIN nm ON n.task=nm.task AND contains(norm, k)"
        " UNION ALL SELECT gt_id, 400 + i, v FROM n JOIN u ON n.task=u.task AND contains(norm, k)),"
        " b AS (SELECT gt_id, arg_min(v, r) AS answer FROM hits GROUP BY gt_id),"
        " a AS (SELECT e.gt_id, e.task, truth, answer FROM e LEFT JOIN b ON e.gt_id=b.gt_id),"
        " p AS (SELECT gt_id, task, truth AS y, answer AS p FROM a WHERE truth IS NOT NULL)"
    )
    stats = (
        answers + ", l AS (SELECT DISTINCT task, y AS label FROM p UNION SELECT DISTINCT task, p FROM p WHERE p IS NOT NULL),"
        " s AS (SELECT l.task, l.label, count(*) FILTER (WHERE p.y=l.label) AS sup, count(*) FILTER (WHERE p.p=l.label) AS pre, count(*) FILTER (WHERE p.p=l.label AND p.y=l.label) AS tp FROM l JOIN p ON l.task=p.task GROUP BY ALL),"
        " f AS (SELECT task, label, sup, coalesce(2.0*tp/nullif(sup+pre, 0), 0) AS f1 FROM s)"
    )
    stack = " UNION ALL ".join(f"SELECT record_id, tier, '{t}' AS task, {t}_label AS label FROM patients" for t in rules.TASKS)
    tiers = f"WITH c(task, label, label_id, pop) AS {classes}, st AS ({stack}), x AS (SELECT st.*, label_id, CASE tier WHEN 'A' THEN 'gold' WHEN 'B' THEN 'train' WHEN 'C' THEN 'bronze' WHEN 'D' THEN 'expansion' END AS part FROM st JOIN c ON st.task=c.task AND st.label=c.label WHERE tier IN ('A','B','C','D'))"
    regimes = "(VALUES ('B','train'),('B_C','train'),('B_C','bronze'),('B_C_D','train'),('B_C_D','bronze'),('B_C_D','expansion'))"
    number = r"coalesce(nullif(regexp_extract({0}, '[Ff]ig(?:ure)?[-_]?(\d+)', 1), ''), nullif(regexp_extract({0}, '[Ff](\d+)', 1), ''), nullif(regexp_extract({0}, 'figure(\d+)', 1), ''))"
    paper = "TRY_CAST(nullif(regexp_extract({0}, '([0-9]{{10}})', 1), '') AS BIGINT)"
    gaps = "WITH u AS (SELECT DISTINCT o_custkey, o_orderkey % 1000 AS place FROM orders), a AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY o_custkey ORDER BY place) >= 20 THEN 1 ELSE 0 END AS g FROM u), b AS (SELECT *, CAST(sum(g) OVER (PARTITION BY o_custkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM a)"
    figures = "WITH f AS (SELECT p_partkey, CAST(p_partkey % 37 * 40 + 100 AS INT) AS w, CAST(p_partkey % 23 * 50 + 100 AS INT) AS h FROM part), g AS (SELECT *, CAST(w // 2 AS INT) AS hw, CAST(h // 2 AS INT) AS hh, w / CAST(h AS DOUBLE) AS a FROM f)"
    box = lambda cond, x1, y1, x2, y2, sure=0.7, label="subfigure": f"SELECT p_partkey, CAST({x1} AS INT) AS x1, CAST({y1} AS INT) AS y1, CAST({x2} AS INT) AS x2, CAST({y2} AS INT) AS y2, CAST({sure} AS DOUBLE) AS confidence, '{label}' AS label FROM g WHERE {cond}"
    sq, wide, tall = "a BETWEEN 0.8 AND 1.2", "a > 1.5", "a < 0.67"
    grid = " UNION ALL ".join([
        box(sq, 0, 0, "hw", "hh"), box(sq, "hw", 0, "w", "hh"), box(sq, 0, "hh", "hw", "h"), box(sq, "hw", "hh", "w", "h"), box(wide, 0, 0, "hw", "h"), box(wide, "hw", 0, "w", "h"),
        box(tall, 0, 0, "w", "hh"), box(tall, 0, "hh", "w", "h"), box(f"NOT ({sq}) AND NOT ({wide}) AND NOT ({tall})", 0, 0, "w", "h", 1.0, "single_panel"),
    ])
    top = "list_position(list_transform(embedding, lambda x: abs(x)), list_max(list_transform(embedding, lambda x: abs(x))))"
    return {
        "q04_golden_labels": f"SELECT CAST(i AS INT) AS i, label FROM {_values([(i, e) for i, (_, _, e) in enumerate(GOLDEN)])} t(i, label)",
        "q11_parse_label": f"{answers} SELECT gt_id, answer FROM a",
        "q12_pred_fallback": f"{answers}, k AS (SELECT task, min(label_id) AS least FROM c WHERE pop='True' GROUP BY task) SELECT a.task, count(*) AS n, count(*) FILTER (WHERE c.label_id IS NULL) AS n_invalid, CAST(sum(coalesce(c.label_id, least)) AS BIGINT) AS sum_ids FROM a LEFT JOIN (SELECT * FROM c WHERE pop='True') c ON a.task=c.task AND a.answer=c.label JOIN k ON a.task=k.task GROUP BY a.task",
        "q15_caption_cases": f"SELECT CAST(i AS INT) AS i, parts FROM {_values([(i, e) for i, (_, e) in enumerate(CAPTIONS)])} t(i, parts)",
        "q17_figure_cases": f"SELECT CAST(i AS INT) AS i, figure FROM {_values([(i, e) for i, (_, e) in enumerate(FIGURE_FILES)])} t(i, figure)",
        "q22_document_id": r"SELECT record_id, nullif(regexp_extract(pmc_id, 'PMC\d+'), '') AS document, concat_ws('_p', pmc_id, patient_num) AS patient_key FROM patients",
        "q23_support": f"{tiers} SELECT task, label, count(*) AS n, CASE WHEN count(*) < 20 THEN 'skipped' ELSE 'trained' END AS status FROM x WHERE part='train' GROUP BY task, label",
        "q27_regime_union": f"{tiers} SELECT regime, task, count(*) AS n_train, count(DISTINCT label_id) AS n_classes FROM x JOIN {regimes} r(regime, p) ON part=p GROUP BY regime, task",
        "q27_regime_scored": f"{tiers}, z AS (SELECT * FROM (SELECT unnest(['B','B_C','B_C_D']) AS regime), (SELECT unnest(['gold','train','bronze','expansion']) AS p)) SELECT regime, part, count(*) AS n FROM x JOIN (SELECT * FROM z ANTI JOIN {regimes} r(regime, p) USING (regime, p)) k ON part=k.p GROUP BY ALL",
        "q27_head_sizes": f"{tiers} SELECT task, CAST(max(label_id) + 1 AS INT) AS n_classes FROM x WHERE part IN ('train','bronze') GROUP BY task",
        "q30_full_report": f"{stats} SELECT task, 'accuracy' AS label, round(avg(CASE WHEN y=p THEN 1.0 ELSE 0.0 END), 6) AS f1, count(*) AS support FROM p GROUP BY task UNION ALL SELECT task, 'macro avg', round(avg(f1), 6), CAST(sum(sup) AS BIGINT) FROM f GROUP BY task UNION ALL SELECT task, 'weighted avg', round(sum(f1*sup)/sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM f GROUP BY task",
        "q32_macro_f1_populated": f"{stats} SELECT c.task, round(avg(coalesce(f1, 0)), 6) AS macro_f1, count(*) AS n_labels FROM c LEFT JOIN f ON c.task=f.task AND c.label=f.label WHERE pop='True' GROUP BY c.task",
        "q33_agreement": f"{answers} SELECT task, count(p) AS n_valid, count(*) - count(p) AS n_invalid, round(avg(CASE WHEN p IS NULL THEN NULL WHEN y=p THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM p GROUP BY task",
        "q38_best_per_tier": f"{_RUNS}, m AS (SELECT 's' || CAST(seed AS VARCHAR) AS tier, baseline, avg(f1) AS score FROM r GROUP BY ALL) SELECT tier, baseline, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, baseline) AS k FROM m WHERE score IS NOT NULL) WHERE k=1",
        "q39_seed_mean": f"{_RUNS} SELECT baseline, task, round(avg(f1), 6) AS mean, CAST(count(f1) AS INT) AS n_values, round(arg_min(f1, seed) FILTER (WHERE f1 IS NOT NULL), 4) AS first_value, count(*) AS n_seeds, arg_min(n_test, seed) AS n_first FROM r GROUP BY ALL",
        "q42_populated_weights": f"{answers}, k AS (SELECT c.task, c.label, pop='True' AS populated, count(p.y) AS n FROM c LEFT JOIN p ON c.task=p.task AND c.label=p.y GROUP BY ALL) SELECT task, label, populated, n, round(CASE WHEN populated THEN (sum(n) FILTER (WHERE populated) OVER w) / ((count(*) FILTER (WHERE populated) OVER w) * CAST(greatest(n, 1) AS DOUBLE)) ELSE 0.0 END, 6) AS weight FROM k WINDOW w AS (PARTITION BY task)",
        "q44_renditions": r"WITH u AS (SELECT subfigure_path AS path FROM subcaptions UNION SELECT regexp_replace(subfigure_path, '\.\w+$', '.tif') FROM subcaptions WHERE subfig_id % 3 = 0) SELECT regexp_replace(path, '\.[A-Za-z0-9]+$', '') AS stem, string_agg(path, ' ' ORDER BY path) AS paths, count(DISTINCT lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1))) AS n_types FROM u WHERE path IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1))) > 1",
        "q45_first_of_each": "SELECT source_image, subfig_id, subfigure_label FROM (SELECT *, row_number() OVER (PARTITION BY source_image ORDER BY subfig_id) AS k FROM subcaptions WHERE source_image IS NOT NULL) WHERE k=1",
        "q46_grid_lines": f"{gaps} SELECT o_custkey, cluster, CAST(floor(avg(place)) AS BIGINT) AS centre, count(*) AS n FROM b GROUP BY ALL HAVING floor(avg(place)) > 100 AND floor(avg(place)) < 900",
        "q50_aspect_grid": f"{figures} {grid}",
        "q51_link_subfigures": f"WITH s AS (SELECT subfig_id, {paper.format('pmc_id')} AS paper, {number.format('source_image')} AS f FROM subcaptions), r AS (SELECT {paper.format('pmc_id')} AS paper, CAST(patient_num AS VARCHAR) AS ref, CAST(num_linked_figures AS VARCHAR) AS f FROM patients) SELECT subfig_id, count(DISTINCT ref) AS n_profiles, min(ref) AS first_ref FROM s LEFT JOIN r ON s.paper=r.paper AND s.f=r.f GROUP BY subfig_id",
        "q52_caption_lookup": "WITH l AS (SELECT subfigure_path, arg_max(struct_pack(s := subcaption, c := confidence), subfig_id) AS d FROM subcaptions GROUP BY 1) SELECT a.subfig_id AS panel, d.s AS subcaption, d.c AS confidence FROM subcaptions a LEFT JOIN l ON a.subfig_id % 10 <> 0 AND a.subfigure_path = l.subfigure_path",
        "q52_back_to_rows": "WITH l AS (SELECT source_image, arg_min(struct_pack(s := subfigure_label), subfig_id) AS d FROM subcaptions WHERE source_image IS NOT NULL GROUP BY 1) SELECT subfig_id AS panel, d.s AS subfigure_label FROM subcaptions JOIN l USING (source_image)",
        "q52_manifest_join": "SELECT record_id, fold, patient_num, tier FROM (SELECT DISTINCT record_id, fold FROM split_manifest) JOIN patients USING (record_id)",
        "q54_merged_chunks": "SELECT l_orderkey, bool_or(l_tax > 0.05) AS has_data, arg_max(l_returnflag, (l_linenumber, l_returnflag)) FILTER (WHERE l_returnflag <> 'N') AS kind, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS items FROM lineitem GROUP BY 1",
        "q56_range_link": "WITH f AS (SELECT o_custkey, o_orderkey % 4 + 1 AS lo, o_orderkey % 7 + 1 AS hi FROM orders) SELECT o_custkey, CAST(c_nationkey % 6 + 1 AS INT) AS number, count(*) AS n_facts FROM f JOIN customer ON o_custkey=c_custkey AND ((lo <= hi AND c_nationkey % 6 + 1 BETWEEN lo AND hi) OR (lo > hi AND c_nationkey % 6 + 1 IN (lo, hi))) GROUP BY 1, 2",
        "q58_quoted_documents": r"SELECT pmc_id, count(*) AS n_quotes FROM task_evidence WHERE length(regexp_replace(evidence_quote, '^\s+|\s+$', '', 'g')) >= 15 GROUP BY 1",
        "q58_modality_mentioned": "SELECT subfig_id FROM subcaptions WHERE lower(modality) LIKE '%mri%' OR lower(modality) LIKE '%eeg%'",
        "q60_contributions": "SELECT count(*) AS n, count(*) FILTER (WHERE vec_id % 3 <> 0) AS mri, count(*) FILTER (WHERE vec_id % 2 <> 0) AS eeg FROM embeddings",
        "q62_masked_logits": "SELECT vec_id, CAST([0, 2, 5, 9, 33][list_position([embedding[1], embedding[3], embedding[6], embedding[10], embedding[34]], list_max([embedding[1], embedding[3], embedding[6], embedding[10], embedding[34]]))] AS INT) AS pred FROM embeddings",
        "q62_sigmoid_cosine": "SELECT vec_id, round(list_cosine_similarity(CAST(embedding[1:32] AS DOUBLE[]), CAST(embedding[33:64] AS DOUBLE[])), 5) AS cosine, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS first FROM embeddings",
        "q63_kind_of_best": f"SELECT vec_id, CASE WHEN {top} <= 14 THEN 'MRI' WHEN {top} <= 24 THEN 'EEG' WHEN {top} <= 34 THEN 'CT' ELSE 'OTHER' END AS kind FROM embeddings",
        "q67_gate": "SELECT pmc_id, CASE WHEN lower(article_type) = 'review-article' THEN 'rejected' WHEN n_sections > 4 THEN 'accepted' ELSE 'other' END AS status FROM papers",
        "q68_run_summary": "SELECT coalesce(article_type, 'unknown') AS status, count(*) AS n_items, CAST(sum(n_sections) AS BIGINT) AS total FROM papers GROUP BY 1",
        "q69_fact_block": "SELECT gt_id, '1. ' || truth || chr(10) || '   QUOTE: ' || left(evidence_quote, 60) || chr(10) || '2. ' || task || chr(10) || '   QUOTE: q' AS block FROM task_evidence WHERE evidence_quote IS NOT NULL AND truth IS NOT NULL",
        "q69_listed_lines": "SELECT subfig_id, 'Panels:' || chr(10) || '- ' || coalesce(subfigure_label, '?') || ': ' || left(coalesce(subcaption, ''), 40) AS lines FROM subcaptions",
        "q54_merge_entities": "WITH e AS (SELECT pmc_id, gt_id, CAST(patient_num AS VARCHAR) AS person, 'Patient ' || CAST(patient_num AS VARCHAR) AS display, gt_id % 2 = 0 AS x, truth, evidence_quote AS q FROM task_evidence WHERE patient_num IS NOT NULL) SELECT pmc_id, person, arg_min(display, (NOT x, gt_id)) AS display, bool_or(x) AS is_explicit, count(DISTINCT CASE WHEN length(q) >= 15 AND length(truth) > 0 THEN struct_pack(a := truth, b := q) END) AS n_facts FROM e GROUP BY pmc_id, person",
        "q61_late_fusion": "WITH f AS (SELECT vec_id, list_transform(range(1, 33), lambda i: CASE WHEN vec_id % 3 <> 0 THEN (CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 32] AS DOUBLE)) / 2 ELSE CAST(embedding[i] AS DOUBLE) END) AS v FROM embeddings) SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS pred FROM f",
        "q63_decision": "WITH f AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings), g AS (SELECT vec_id, list_max(v[1:14]) AS good, list_max(v[15:64]) AS bad FROM f) SELECT vec_id, CASE WHEN good >= bad AND good >= 0.0005 AND good / greatest(bad, 1e-8) >= 1.5 THEN 'ACCEPT' WHEN bad > good AND bad / greatest(good, 1e-8) >= 1.5 THEN 'REJECT' ELSE 'BORDERLINE' END AS decision FROM g",
        "q74_panel_selection": f"WITH l AS (SELECT record_id, {_listed('mri_image_paths')} AS m, {_listed('eeg_image_paths')} AS e FROM patients) SELECT record_id, CAST(CASE WHEN m > 0 AND e > 0 THEN least(m, 2) + least(e, 1) WHEN m > 0 THEN least(m, 3) ELSE least(e, 3) END AS INT) AS n_panels FROM l",
        "q36_plain_pivot": f"{_RUNS}, m AS (SELECT baseline, task, round(avg(f1), 4) AS f1 FROM r GROUP BY ALL) SELECT baseline, " + ", ".join(f"max(CASE WHEN task='t{i}' THEN f1 END) AS t{i}" for i in range(6)) + " FROM m GROUP BY baseline",
    }
