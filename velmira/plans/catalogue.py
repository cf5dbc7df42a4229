"""Registered queries of the core operators with their SQL oracles.

Every query runs over its whole tables.  Predictions and results that the tables don't hold are derived from them by
expressions that both engines compute alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velmira.functions import rules, text
from velmira.operators import classifiers, features, images, metrics, report, splits, tables, units, unpack
from velmira.plans import curation
from velmira.session import shared_folder, table
from velmira.sources import articles
from velmira.streaming import incremental

_TIERS = ["A", "B", "C", "D"]
# two "raters" of the evidence table: its label, and what the rules read out of the quote
_PREDS = "SELECT gt_id, task, truth AS y, {p} AS p FROM task_evidence WHERE truth IS NOT NULL"


def _read_rule_sql() -> str:
    return "CASE task " + " ".join(f"WHEN '{t}' THEN {rules.consolidate_sql(t, 'evidence_quote')}" for t in rules.TASKS) + " END"


def _preds(s, d) -> DataFrame:
    e = table(s, d, "task_evidence").where("truth is not null")
    return rules.with_labels(e, F.col("task"), "evidence_quote", "p").select("gt_id", "task", F.col("truth").alias("y"), "p")


def _table_texts(documents: DataFrame) -> DataFrame:
    """The table of each document that has one: two lines or more with cells between pipes, wherever they stand."""
    lines = documents.where(F.col("text").contains("|")).select("doc_id", tables.table_lines(F.col("text")).alias("lines"))
    return lines.where(F.size("lines") >= 2).select("doc_id", F.array_join("lines", "\n").alias("text"))


def _tfidf_split(documents: DataFrame) -> DataFrame:
    """TF-IDF fitted on four fifths of the documents, weights of the others."""
    test = F.pmod(F.col("doc_id"), F.lit(5)) == 0
    return features.tfidf_transform(documents.where(test), features.tfidf_fit(documents.where(~test), "text"), "doc_id", "text")


def _results(s, d) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("event_type").alias("baseline"), F.concat(F.lit("t"), (F.col("user_id") % 6).cast("string")).alias("task"), F.element_at(F.array(F.lit("gold"), F.lit("silver"), F.lit("bronze")), (F.col("event_id") % 3 + 1).cast("int")).alias("tier"), F.col("value").alias("f1"), "event_id")


_RESULTS = "SELECT event_type AS baseline, 't' || CAST(user_id % 6 AS VARCHAR) AS task, ['gold','silver','bronze'][CAST(event_id % 3 + 1 AS INT)] AS tier, value AS f1, event_id FROM events"
_KEYS = [f"t{i}_{t}" for i in range(6) for t in ("gold", "silver", "bronze")]
r6 = lambda c, name=None: F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name or c)


def _boxes(s, d) -> DataFrame:
    e = table(s, d, "orders")
    return e.select((F.col("o_custkey")).alias("image_id"), (F.col("o_orderkey") % 97).alias("x1"), (F.col("o_orderkey") % 89).alias("y1"), (F.col("o_orderkey") % 97 + 20 + F.col("o_orderkey") % 31).alias("x2"), (F.col("o_orderkey") % 89 + 20 + F.col("o_orderkey") % 29).alias("y2"), (F.col("o_totalprice") / 1e6 + F.col("o_orderkey") / 1e12).alias("confidence"))


def _panels(s, d) -> DataFrame:
    return table(s, d, "subcaptions")


def _languages(s, d) -> DataFrame:
    ids = F.create_map(*(x for i, n in enumerate(("de", "en", "es", "fr")) for x in (F.lit(n), F.lit(i))))
    return table(s, d, "documents").select("doc_id", "text", F.try_element_at(ids, F.col("lang")).alias("language"))


def _text_scores(s, d) -> DataFrame:
    """Scores of a classifier of the language: four fifths of the documents train, the others are scored."""
    rows = _languages(s, d)
    test = F.pmod(F.col("doc_id"), F.lit(5)) == 0
    model = classifiers.fit_text(rows.where(~test), "text", "language")
    return metrics.full_report(classifiers.scored_text(model, rows.where(test), "text", "language"), []).select(F.col("label").cast("string").alias("label"), r6("f1"), "support")


def _ablation(s, d) -> DataFrame:
    e = table(s, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    test = F.pmod(F.col("vec_id"), F.lit(5)) == 0
    a, b = F.slice("v", 1, 32), F.when(F.col("vec_id") % 3 != 0, F.slice("v", 33, 32))
    regimes = {"first": a, "second": b, "both": F.concat(features.block(a, 32), features.block(b, 32)), "either": F.coalesce(b, a)}
    return classifiers.ablation(e.where(~test), e.where(test), regimes, "label")


def _xml(s, d) -> DataFrame:
    """Articles written from the papers table, with the text of a figure and two sections."""
    safe = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<body><sec><title>One</title><p>"), safe("abstract"), F.lit("</p><fig id='f1'><label>Figure 1</label></fig></sec><sec><p>x</p></sec></body>"))
    front = F.concat(F.lit("<front><article-title>"), safe("title"), F.lit("</article-title><abstract><p>"), safe("abstract"), F.lit("</p></abstract></front>"))
    return table(s, d, "papers").select("pmc_id", F.concat(F.lit("<article>"), front, body, F.lit("</article>")).alias("xml"))


def _streamed(s, d) -> DataFrame:
    """Events taken in as a stream of files, once each, then counted: the same as the table counted at once."""
    folder = shared_folder(s, "stream")
    schema = table(s, d, "events").schema
    incremental.ingest(s, f"{d}/events.parquet*", schema, f"{folder}/out", f"{folder}/state")
    return s.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    patients = lambda s, d: table(s, d, "patients")
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "p2_found": lambda s, d: units.ages_in_days(patients(s, d)),
        "p2_units": lambda s, d: units.decoded_units(patients(s, d)),
        "p2_recovery": lambda s, d: units.recovery(patients(s, d)),
        "p3_found": lambda s, d: unpack.unpacked(patients(s, d)),
        "p3_delimiters": lambda s, d: unpack.infer_delimiters(unpack.packed_values(patients(s, d), "record_id", unpack.FIELDS, "source")),
        "q01_tier_assign": lambda s, d: patients(s, d).select("record_id", rules.tier().alias("assigned")),
        "q02_tier_distribution": lambda s, d: report.zero_filled_counts(patients(s, d).withColumn("assigned", rules.tier()), "assigned", _TIERS).select("assigned", "n", r6("percent")),
        "q03_tier_doc_variant": lambda s, d: patients(s, d).select("record_id", rules.tier("doc").alias("assigned")),
    }
    for i, task in enumerate(rules.TASKS):
        out[f"q{4 + i:02d}_consolidate_{task}"] = lambda s, d, t=task: rules.with_labels(table(s, d, "task_evidence"), t, "evidence_quote", "label").select("gt_id", "label")
    out |= {
        "q10_consolidate_dispatch": lambda s, d: _preds(s, d),
        "q13_modality_text": lambda s, d: _panels(s, d).select("subfig_id", rules.modality_of(F.col("subcaption")).alias("read")),
        "q14_table_filename": lambda s, d: _panels(s, d).select("subfig_id", F.element_at(F.split("subfigure_path", "/"), -1).rlike(rules.TABLE_FILE).alias("is_table")),
        "q15_subcaption_parts": lambda s, d: _panels(s, d).withColumn("c", F.concat(F.coalesce("subcaption", F.lit("")), F.lit(" (Y) "), F.coalesce("modality", F.lit("?")), F.lit("; (Z) end."))).select("subfig_id", F.inline(text.labelled_parts(F.col("c")))),
        "q16_panel_label": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.panel_label((F.col("l_orderkey") % 30).cast("int")).alias("label")),
        "q17_figure_id": lambda s, d: _panels(s, d).select("subfig_id", text.figure_id(F.col("source_image")).alias("figure")),
        "q18_first_json": lambda s, d: table(s, d, "events").select("event_id", F.get_json_object(text.first_json(F.concat(F.lit("Answer: ```json\n"), "props", F.lit("\n```"))), "$.k").alias("k")),
        "q19_input_text": lambda s, d: patients(s, d).select("record_id", text.input_text().alias("input")),
        "q20_masked_text": lambda s, d: patients(s, d).select("record_id", text.truncated(text.input_text(captions=False), 3000).alias("input")),
        "q21_path_hash": lambda s, d: _panels(s, d).select("subfig_id", text.path_hash(F.col("subfigure_path")).alias("hash")),
        "q22_task_rows": lambda s, d: splits.task_rows(patients(s, d), ["record_id"]),
        "q24_split_summary": lambda s, d: splits.task_rows(patients(s, d), ["record_id"]).groupBy("task").agg(F.count("*").alias("n"), F.count_distinct("label_id").alias("n_classes")),
        "q25_group_fold": lambda s, d: patients(s, d).where("pmc_id is not null").select("record_id", splits.group_fold(F.col("pmc_id")).alias("fold")),
        "q26_leak_anti": lambda s, d: splits.without_leaks(patients(s, d).where("tier = 'A' and pmc_id is not null"), patients(s, d).where("tier = 'B'"), "pmc_id").select("record_id"),
        "q28_stratified_sample": lambda s, d: splits.stratified_sample(table(s, d, "task_evidence").select("gt_id", "task", "truth"), ["task", "truth"], "gt_id", 20),
        "q29_confusion": lambda s, d: metrics.confusion(_preds(s, d), ["task"]),
        "q30_class_report": lambda s, d: metrics.class_report(_preds(s, d), ["task"]).select("task", "label", r6("precision"), r6("recall"), r6("f1"), "support"),
        "q31_macro_f1": lambda s, d: metrics.macro_f1(_preds(s, d), ["task"]).select("task", r6("macro_f1"), "n_labels"),
        "q33_kappa": lambda s, d: metrics.kappa(_preds(s, d), ["task"]).select("task", "n", r6("agreement"), r6("kappa")),
        "q34_winners": lambda s, d: report.winners(_results(s, d).groupBy("baseline", "task").agg(F.round(F.avg("f1"), 6).alias("f1")), ["task"], "baseline", "f1"),
        "q35_bands": lambda s, d: report.bands(_results(s, d).select("task", "event_id", "tier"), ["task"], "event_id", "tier").groupBy("task").agg(F.count("*").alias("n_bands"), F.max("n").alias("longest")),
        "q36_pivot": lambda s, d: report.pivoted(_results(s, d), "baseline", ["task", "tier"], _KEYS, "f1").select("baseline", *(r6(k) for k in _KEYS)),
        "q37_overall": lambda s, d: _results(s, d).groupBy("baseline", "tier").agg(r6(F.avg("f1"), "f1")),
        "q41_class_weights": lambda s, d: metrics.class_weights(_preds(s, d), ["task"]).select("task", "y", "n", r6("weight")),
        "q43_quality_gate": lambda s, d: table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 50 != 0).alias("file_exists"), (F.col("p_retailprice") / 30).alias("file_size_mb"), (F.col("p_size") * 90).alias("width"), (F.col("p_size") * 60).alias("height")).select("p_partkey", images.failure_reason().alias("reason")),
        "q44_best_rendition": lambda s, d: images.best_rendition(_panels(s, d).select(F.col("subfigure_path").alias("path")).union(_panels(s, d).select(F.regexp_replace("subfigure_path", r"\.\w+$", ".png")))),
        "q45_duplicates": lambda s, d: images.duplicates(table(s, d, "part").select(F.col("p_partkey").alias("path"), F.md5(F.concat("p_brand", "p_type")).alias("digest")), "digest"),
        "q46_gap_clusters": lambda s, d: report.gap_clusters(table(s, d, "orders").select("o_custkey", (F.col("o_orderkey") % 1000).cast("long").alias("place")).distinct(), ["o_custkey"], "place", 20),
        "q47_sessions": lambda s, d: incremental.sessions(table(s, d, "events"), "user_id", "ts", "30 minutes").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events")),
        "q48_nms": lambda s, d: images.suppressed(_boxes(s, d)),
        "q53_explode_references": lambda s, d: _panels(s, d).select("subfig_id", F.inline("intext_references")),
        "q54_merge_entities": lambda s, d: splits.merged_entities(table(s, d, "task_evidence").select("pmc_id", F.col("gt_id").alias("seq"), F.concat(F.lit("Patient "), F.col("patient_num").cast("string")).alias("patient_ref"), (F.col("gt_id") % 2 == 0).alias("is_explicit"), F.col("truth").alias("fact"), F.col("evidence_quote").alias("quote"), F.lit("Figure 1").alias("figure_ref"))).select("pmc_id", "person", "display", "is_explicit", "n_facts"),
        "q57_valid_quotes": lambda s, d: table(s, d, "task_evidence").select("gt_id", F.when(F.length(F.regexp_replace("evidence_quote", r"^\s+|\s+$", "")) >= 15, F.col("truth")).alias("kept"), F.col("redacted").contains("[redacted]").alias("masked")),
        "q59_mean_pool": lambda s, d: features.mean_pooled(table(s, d, "embeddings"), "label", "embedding", 64).select("label", "n", F.posexplode("vector").alias("pos", "v")).select("label", "n", "pos", F.round("v", 5).alias("v")),
        "q61_late_fusion": lambda s, d: table(s, d, "embeddings").withColumn("a", F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double"))).withColumn("b", F.when(F.col("vec_id") % 3 != 0, F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")))).select("vec_id", features.argmax(features.fused([F.col("a"), F.col("b")])).alias("pred")),
        "q63_decision": lambda s, d: table(s, d, "embeddings").select("vec_id", images.decision(F.transform("embedding", lambda x: F.abs(x).cast("double")), 14).alias("decision")),
        "q64_tfidf": lambda s, d: features.tfidf(table(s, d, "papers").select("pmc_id", "abstract"), "pmc_id", "abstract").select("pmc_id", "term", F.round("weight", 6).alias("weight")),
        "q64_tfidf_bigrams": lambda s, d: _tfidf_split(table(s, d, "documents")),
        "q40_grid_complete": lambda s, d: tables.completed(_results(s, d).groupBy("baseline", "tier").agg(F.round(F.avg("f1"), 6).alias("f1")), {"baseline": ["click", "purchase", "nobody"], "tier": ["gold", "silver", "bronze"]}, "f1"),
        "q55_row_facts": lambda s, d: tables.row_facts(table(s, d, "part").select("p_partkey", F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).otherwise(F.lit("-"))).alias("cells"), F.lit("2").alias("label")), ["p_partkey"], "cells", "label"),
        "q69_messages": lambda s, d: tables.messages(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").select("l_orderkey", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), " ").alias("talk")),
        "q73_table_rows": lambda s, d: tables.table_rows(_table_texts(table(s, d, "documents")), ["doc_id"], "text").select("doc_id", "batch", F.size("rows").alias("n_rows"), "header"),
        "q74_panel_selection": lambda s, d: patients(s, d).select("record_id", F.size(tables.chosen_panels(text.list_literal(F.coalesce("mri_image_paths", F.lit("[]"))), text.list_literal(F.coalesce("eeg_image_paths", F.lit("[]"))), 3)).alias("n_panels")),
        "q65_logreg_eval": _text_scores,
        "q65_modality_ablation": _ablation,
        "q66_paper_parse": lambda s, d: articles.articles(_xml(s, d)).select("pmc_id", "title", "abstract", F.size("sections").alias("n_sections"), F.array_join(F.transform("sections", lambda x: x["title"]), "|").alias("headings"), F.size("figures").alias("n_figures")),
        "q76_kmeans_sample": lambda s, d: classifiers.clustered_sample(table(s, d, "embeddings"), "vec_id", "embedding", 8, 10),
        "q77_stream_incremental": _streamed,
        "q70_todo": lambda s, d: incremental.new_rows(table(s, d, "papers").select("pmc_id"), patients(s, d).select("pmc_id"), "pmc_id"),
        "q71_value_counts_top": lambda s, d: _panels(s, d).groupBy("modality").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("modality")).limit(10),
        "q72_dataset_stats": lambda s, d: _panels(s, d).agg(F.count("*").alias("n"), F.count_distinct("pmc_id").alias("n_papers"), F.count_if(F.size("findings") > 0).alias("with_findings"), F.count_if(F.col("modality").isNotNull()).alias("with_modality")),
        "q75_modality_coverage": lambda s, d: patients(s, d).agg(r6(F.avg((F.coalesce("num_mri_images", F.lit(0)) > 0).cast("int")), "mri"), r6(F.avg((F.coalesce("num_eeg_images", F.lit(0)) > 0).cast("int")), "eeg")),
    }
    return out | curation.queries()


def oracle_sql() -> dict[str, str]:
    preds = f"WITH e AS ({_PREDS.format(p=_read_rule_sql())})"
    results = f"WITH r AS ({_RESULTS})"
    cells = preds + ", c AS (SELECT task, y, p, count(*) AS n FROM e GROUP BY ALL)"
    rep = cells + (
        ", l AS (SELECT task, y AS label FROM c UNION SELECT task, p FROM c WHERE p IS NOT NULL),"
        " m AS (SELECT l.task, l.label, coalesce((SELECT sum(n) FROM c WHERE c.task=l.task AND c.y=l.label),0) AS sup, coalesce((SELECT sum(n) FROM c WHERE c.task=l.task AND c.p=l.label),0) AS pre,"
        " coalesce((SELECT sum(n) FROM c WHERE c.task=l.task AND c.p=l.label AND c.y=l.label),0) AS tp FROM l),"
        " q AS (SELECT task, label, CASE WHEN pre=0 THEN 0.0 ELSE tp/CAST(pre AS DOUBLE) END AS prec, CASE WHEN sup=0 THEN 0.0 ELSE tp/CAST(sup AS DOUBLE) END AS rec, sup FROM m),"
        " f AS (SELECT *, CASE WHEN prec+rec=0 THEN 0.0 ELSE 2*prec*rec/(prec+rec) END AS f1 FROM q)"
    )
    stack = " UNION ALL ".join(f"SELECT record_id, '{t}' AS task, {t}_label AS label FROM patients" for t in rules.TASKS)
    ids = "CASE " + " ".join(f"WHEN task='{t}' AND label='{c}' THEN {i}" for t in rules.TASKS for i, c in enumerate(rules.CLASSES[t])) + " END"
    long = f"WITH s AS ({stack}), l AS (SELECT record_id, task, label, CAST({ids} AS INT) AS label_id FROM s)"
    parts = lambda names: "concat_ws(' | ', " + ", ".join(f"CASE WHEN length(trim({c}, ' '))>0 THEN '{n}: ' || {c} END" for n, c in names) + ")"
    allparts = [("Age", "age"), ("Sex", "sex"), ("Semiology", "semiology_text"), ("MRI", "mri_report_text"), ("EEG", "eeg_report_text"), ("Notes", "demographics_notes")]
    few = [p for p in allparts if p[0] not in ("MRI", "EEG")]
    masked = f"coalesce(nullif({parts(few)}, ''), '(no clinical text)')"
    fold = "CASE WHEN CAST('0x' || substr(md5(pmc_id || '42'), 1, 8) AS BIGINT) % 10 = 0 THEN 'test' ELSE 'train' END"
    out = {
        "q01_tier_assign": f"SELECT record_id, {rules.tier_sql()} AS assigned FROM patients",
        "q02_tier_distribution": f"WITH t AS (SELECT {rules.tier_sql()} AS assigned FROM patients), d AS (SELECT unnest(['A','B','C','D']) AS assigned), c AS (SELECT d.assigned, count(t.assigned) AS n FROM d LEFT JOIN t USING (assigned) GROUP BY 1) SELECT assigned, n, round(100.0*n/sum(n) OVER (), 6) AS percent FROM c",
        "q03_tier_doc_variant": f"SELECT record_id, {rules.tier_sql('doc')} AS assigned FROM patients",
        "q10_consolidate_dispatch": f"{preds} SELECT gt_id, task, y, p FROM e",
        "q13_modality_text": f"SELECT subfig_id, {rules.sql(rules.MODALITY_RULES, chr(39).join(['lower(coalesce(subcaption, ', '', '))']), 'UNKNOWN')} AS read FROM subcaptions",
        "q14_table_filename": f"SELECT subfig_id, regexp_matches(regexp_extract(subfigure_path, '[^/]*$'), '{rules.TABLE_FILE}') AS is_table FROM subcaptions",
        "q16_panel_label": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 30 < 26 THEN chr(CAST(65 + l_orderkey % 30 AS INT)) ELSE 'Panel' || CAST(l_orderkey % 30 + 1 AS VARCHAR) END AS label FROM lineitem",
        "q17_figure_id": r"SELECT subfig_id, 'fig' || coalesce(nullif(regexp_extract(source_image, '[Ff]ig(?:ure)?[-_]?(\d+)', 1), ''), nullif(regexp_extract(source_image, '[Ff](\d+)', 1), ''), nullif(regexp_extract(source_image, 'figure(\d+)', 1), '')) AS figure FROM subcaptions",
        "q18_first_json": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
        "q19_input_text": f"SELECT record_id, coalesce(nullif({parts(allparts)}, ''), '(no clinical text)') AS input FROM patients",
        "q20_masked_text": f"SELECT record_id, CASE WHEN length({masked}) > 3000 THEN left({masked}, 2997) || '...' ELSE {masked} END AS input FROM patients",
        "q21_path_hash": "SELECT subfig_id, left(sha1(subfigure_path), 16) AS hash FROM subcaptions",
        "q22_task_rows": f"{long} SELECT record_id, task, label, label_id FROM l WHERE label IS NOT NULL AND label_id IS NOT NULL",
        "q24_split_summary": f"{long} SELECT task, count(*) AS n, count(DISTINCT label_id) AS n_classes FROM l WHERE label_id IS NOT NULL GROUP BY task",
        "q25_group_fold": f"SELECT record_id, {fold} AS fold FROM patients WHERE pmc_id IS NOT NULL",
        "q26_leak_anti": "SELECT record_id FROM patients WHERE tier='A' AND pmc_id IS NOT NULL AND pmc_id NOT IN (SELECT pmc_id FROM patients WHERE tier='B' AND pmc_id IS NOT NULL)",
        "q28_stratified_sample": "SELECT gt_id, task, truth FROM (SELECT gt_id, task, truth, row_number() OVER (PARTITION BY task, truth ORDER BY md5(CAST(gt_id AS VARCHAR) || '42'), gt_id) AS r FROM task_evidence) WHERE r <= 20",
        "q29_confusion": f"{cells} SELECT task, y, p, n FROM c",
        "q30_class_report": f"{rep} SELECT task, label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1, CAST(sup AS BIGINT) AS support FROM f",
        "q31_macro_f1": f"{rep} SELECT task, round(avg(f1), 6) AS macro_f1, count(*) AS n_labels FROM f GROUP BY task",
        "q33_kappa": f"{preds}, v AS (SELECT * FROM e WHERE p IS NOT NULL), t AS (SELECT task, count(*) AS n, avg(CAST(y=p AS INT)) AS po FROM v GROUP BY task), a AS (SELECT task, y AS k, count(*) AS r FROM v GROUP BY ALL), b AS (SELECT task, p AS k, count(*) AS c FROM v GROUP BY ALL), x AS (SELECT a.task, sum(r*coalesce(c,0)) AS s FROM a LEFT JOIN b ON a.task=b.task AND a.k=b.k GROUP BY a.task) SELECT t.task, n, round(po, 6) AS agreement, round((po - s/(CAST(n AS DOUBLE)*n)) / nullif(1 - s/(CAST(n AS DOUBLE)*n), 0), 6) AS kappa FROM t JOIN x USING (task)",
        "q34_winners": f"{results}, a AS (SELECT baseline, task, round(avg(f1), 6) AS f1 FROM r GROUP BY ALL) SELECT baseline, task, f1 FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY f1 DESC, baseline) AS k FROM a WHERE f1 IS NOT NULL) WHERE k=1",
        "q35_bands": f"{results}, a AS (SELECT *, CASE WHEN tier IS NOT DISTINCT FROM lag(tier) OVER (PARTITION BY task ORDER BY event_id) THEN 0 ELSE 1 END AS ch FROM r), b AS (SELECT task, sum(ch) OVER (PARTITION BY task ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS band FROM a), c AS (SELECT task, band, count(*) AS n FROM b GROUP BY ALL) SELECT task, count(*) AS n_bands, max(n) AS longest FROM c GROUP BY task",
        "q36_pivot": f"{results} SELECT baseline, " + ", ".join(f"round(avg(CASE WHEN task || '_' || tier = '{k}' THEN f1 END), 6) AS {k}" for k in _KEYS) + " FROM r GROUP BY baseline",
        "q37_overall": f"{results} SELECT baseline, tier, round(avg(f1), 6) AS f1 FROM r GROUP BY ALL",
        "q41_class_weights": f"{preds}, c AS (SELECT task, y, count(*) AS n FROM e GROUP BY ALL) SELECT task, y, n, round(sum(n) OVER (PARTITION BY task) / (count(*) OVER (PARTITION BY task) * CAST(n AS DOUBLE)), 6) AS weight FROM c",
        "q43_quality_gate": "SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'missing' WHEN p_retailprice/30 < 0.001 THEN 'too_small_file' WHEN p_retailprice/30 > 50 THEN 'too_large_file' WHEN least(p_size*90, p_size*60) < 100 THEN 'too_small' WHEN greatest(p_size*90, p_size*60) > 4096 THEN 'too_large' END AS reason FROM part",
        "q44_best_rendition": r"WITH u AS (SELECT subfigure_path AS path FROM subcaptions UNION ALL SELECT regexp_replace(subfigure_path, '\.\w+$', '.png') FROM subcaptions), x AS (SELECT path, regexp_replace(path, '\.[A-Za-z0-9]+$', '') AS stem, coalesce(nullif(list_position(['.jpg','.jpeg','.png','.gif','.tif','.tiff'], lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1))), 0), 99) AS k FROM u) SELECT stem, arg_min(path, (k, path)) AS best, count(*) AS n_renditions FROM x GROUP BY stem",
        "q45_duplicates": "SELECT p_partkey AS path, md5(p_brand || p_type) AS digest, row_number() OVER (PARTITION BY md5(p_brand || p_type) ORDER BY p_partkey) > 1 AS is_duplicate FROM part",
        "q46_gap_clusters": "WITH u AS (SELECT DISTINCT o_custkey, o_orderkey % 1000 AS place FROM orders), a AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY o_custkey ORDER BY place) >= 20 THEN 1 ELSE 0 END AS g FROM u), b AS (SELECT *, CAST(sum(g) OVER (PARTITION BY o_custkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM a) SELECT o_custkey, cluster, CAST(floor(avg(place)) AS BIGINT) AS centre, count(*) AS n FROM b GROUP BY ALL",
        "q47_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS g FROM events) SELECT user_id, CAST(sum(g) AS BIGINT) AS n_sessions, count(*) AS n_events FROM a GROUP BY user_id",
        "q53_explode_references": "SELECT subfig_id, r.figure AS figure, r.sentence AS sentence FROM (SELECT subfig_id, unnest(intext_references) AS r FROM subcaptions)",
        "q57_valid_quotes": r"SELECT gt_id, CASE WHEN length(regexp_replace(evidence_quote, '^\s+|\s+$', '', 'g')) >= 15 THEN truth END AS kept, contains(redacted, '[redacted]') AS masked FROM task_evidence",
        "q59_mean_pool": "WITH x AS (SELECT label, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), m AS (SELECT label, pos, avg(v) AS v, count(*) AS n FROM x GROUP BY ALL) SELECT label, n, CAST(pos AS INT) AS pos, round(v / (sqrt(sum(v*v) OVER (PARTITION BY label)) + 1e-9), 5) AS v FROM m",
        "q40_grid_complete": f"{results}, a AS (SELECT baseline, tier, round(avg(f1), 6) AS f1 FROM r GROUP BY ALL), g AS (SELECT * FROM (SELECT unnest(['click','purchase','nobody']) AS baseline), (SELECT unnest(['gold','silver','bronze']) AS tier)) SELECT g.baseline, g.tier, a.f1 FROM g LEFT JOIN a ON g.baseline=a.baseline AND g.tier=a.tier",
        "q55_row_facts": "WITH f AS (SELECT p_partkey, 'size: ' || CAST(p_size AS VARCHAR) AS fact FROM part UNION ALL SELECT p_partkey, 'brand: ' || p_brand FROM part WHERE p_size % 7 != 0) SELECT p_partkey, fact, rpad('[Table 2] ' || fact, CAST(greatest(length('[Table 2] ' || fact), 15) AS INT), ' ') AS quote FROM f",
        "q69_messages": "SELECT l_orderkey, string_agg(l_returnflag || ':' || l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS talk FROM lineitem GROUP BY 1",
        "q70_todo": "SELECT pmc_id FROM papers WHERE pmc_id NOT IN (SELECT pmc_id FROM patients WHERE pmc_id IS NOT NULL)",
        "q71_value_counts_top": "SELECT modality, count(*) AS n FROM subcaptions GROUP BY 1 ORDER BY n DESC, modality NULLS FIRST LIMIT 10",
        "q72_dataset_stats": "SELECT count(*) AS n, count(DISTINCT pmc_id) AS n_papers, count(*) FILTER (WHERE len(findings) > 0) AS with_findings, count(modality) AS with_modality FROM subcaptions",
        "q73_table_rows": r"WITH l AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: contains(x, '|') AND NOT regexp_matches(x, '^[\s|]*:?-{3,}[\s|:+=-]*$')), lambda x: CASE WHEN starts_with(x, '|') THEN regexp_replace(x, '^\|\s*|\s*\|\s*$', '', 'g') ELSE x END) AS l FROM documents WHERE contains(text, '|')), m AS (SELECT doc_id, list_filter(l, lambda x: length(trim(x)) > 0) AS l FROM l WHERE len(l) >= 2), c AS (SELECT doc_id, l, trim(split_part(l[2], '|', 1)) AS a, trim(split_part(l[3], '|', 1)) AS b FROM m), h AS (SELECT doc_id, l, CASE WHEN len(l) < 2 THEN len(l) WHEN regexp_matches(a, '^\d+[.)]*(\s|$)') OR length(a) BETWEEN 1 AND 10 THEN 1 WHEN len(l) < 3 OR regexp_matches(b, '^\d+[.)]*(\s|$)') OR length(b) BETWEEN 1 AND 10 THEN 2 ELSE 3 END AS h FROM c), r AS (SELECT doc_id, array_to_string(l[1:greatest(h, 1)], chr(10)) AS header, unnest(range(0, len(l) - h)) AS i FROM h) SELECT doc_id, CAST(i // 10 AS BIGINT) AS batch, CAST(count(*) AS INT) AS n_rows, header FROM r GROUP BY ALL",
        "p3_found": r"""WITH v AS (SELECT record_id, 'mri_image_paths' AS field, mri_image_paths AS v FROM patients UNION ALL SELECT record_id, 'eeg_image_paths', eeg_image_paths FROM patients), i AS (SELECT record_id, field, regexp_extract_all(replace(replace(v, chr(92) || '"', '"'), chr(92) || '''', ''''), '(?i)[a-z0-9_.-]+/PMC[0-9]+/[^/]*?\.(?:jpe?g|png|tiff?|gif|bmp|svg|webp|dcm)') AS items FROM v WHERE v IS NOT NULL) SELECT record_id, field, CAST(unnest(range(1, len(items) + 1)) AS INT) AS pos, unnest(items) AS path FROM i""",
        "q66_paper_parse": r"SELECT pmc_id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS title, trim(regexp_replace(coalesce(abstract, ''), '\s+', ' ', 'g')) AS abstract, CAST(CASE WHEN trim(regexp_replace(coalesce(abstract, ''), '\s+', ' ', 'g')) = '' THEN 2 ELSE 3 END AS INT) AS n_sections, CASE WHEN trim(regexp_replace(coalesce(abstract, ''), '\s+', ' ', 'g')) = '' THEN '' ELSE 'ABSTRACT|' END || 'BODY: One|BODY: Section 2' AS headings, CAST(1 AS INT) AS n_figures FROM papers",
        "q77_stream_incremental": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1",
        "q75_modality_coverage": "SELECT round(avg(CAST(coalesce(num_mri_images,0) > 0 AS INT)), 6) AS mri, round(avg(CAST(coalesce(num_eeg_images,0) > 0 AS INT)), 6) AS eeg FROM patients",
        "q64_tfidf": r"WITH w AS (SELECT pmc_id, unnest(regexp_extract_all(lower(abstract), '\b\w\w+\b')) AS term FROM papers WHERE length(abstract) > 0), tf AS (SELECT pmc_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT pmc_id, term, tf * (ln((1.0 + (SELECT count(*) FROM papers)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term)) SELECT pmc_id, term, round(w / sqrt(sum(w*w) OVER (PARTITION BY pmc_id)), 6) AS weight FROM x",
    }
    for i, task in enumerate(rules.TASKS):
        out[f"q{4 + i:02d}_consolidate_{task}"] = f"SELECT gt_id, {rules.consolidate_sql(task, 'evidence_quote')} AS label FROM task_evidence"
    return out | curation.oracle_sql()
