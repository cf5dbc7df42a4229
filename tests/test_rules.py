import pytest
from pyspark.sql import functions as F

from velmira.functions import rules, text

CASES = {
    "ez_localization": [
        ("bilateral temporal", "Multifocal"), ("left fronto-temporal", "Multifocal"), ("Temporal-parietal-occipital", "Multifocal"), ("left hemisphere", "Hemispheric"),
        ("mesial temporal", "Temporal"), ("left frontal", "Extratemporal"), ("Opercular", "Extratemporal"), ("Frontobasal", "Extratemporal"), ("cingulate", "Extratemporal"),
        ("Focal", "Unknown"), ("Left", "Unknown"), ("cryptogenic", "Unknown"), ("multifocal", "Multifocal"), ("", None), ("none", None), ("extra-temporal", "Extratemporal"),
        ("extratemporal", "Extratemporal"), ("temporal and frontal", "Multifocal"), (None, None),
    ],
    "status_epilepticus": [
        ("refractory status epilepticus", "Refractory SE"), ("RSE developed during admission", "Refractory SE"), ("NCSE on EEG", "Non-convulsive SE"), ("absence status", "Non-convulsive SE"),
        ("generalized tonic-clonic status", "Convulsive SE"), ("GCSE", "Convulsive SE"), ("no history of status epilepticus", "None"), ("status epilepticus reported", "Unknown"),
        ("not mentioned", None), ("no history of refractory status epilepticus", "Refractory SE"),
    ],
    "aed_response": [("drug-resistant", "drug-resistant"), ("seizure-free for 2 years", "drug-responsive"), ("taking AED", "unspecified")],
    "surgery_outcome": [("Engel I", "Seizure-free"), ("Engel class III", "Improved"), ("Engel IV", "No improvement"), ("no surgery", "Not applicable"), ("no improvement", "Improved"), ("engel 1a", None)],
    "epilepsy_type": [("focal", "Focal"), ("generalized", "Generalised"), ("JME", "Generalised"), ("TLE", "Focal"), ("complex", "Focal"), ("focal and generalised", "Combined Focal and Generalised"), ("cryptogenic", "Unknown")],
    "seizure_type": [("focal onset", "Focal"), ("tonic-clonic", "Generalised"), ("unclassified", "Unclassified"), ("witnessed generalised seizure", "Unknown"), ("status epilepticus", None)],
}


@pytest.mark.parametrize("task", rules.TASKS)
def test_consolidate(spark, task):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(CASES[task])], "i int, raw string, want string")
    rows = df.withColumn("got", rules.consolidate(task, F.col("raw"))).collect()
    assert [(r.raw, r.got) for r in rows] == [(r.raw, r.want) for r in rows]


def test_unknown_task_is_an_error():
    with pytest.raises(KeyError):
        rules.consolidate("survival", "x")


def test_captions_and_ids(spark):
    rows = [("(A) T1-weighted MRI showing lesion. (B) FLAIR sequence.",), ("(a-c) MRI sequences. (d) EEG recording.",), ("A: Axial MRI. B: Coronal view.",), ("one panel only",), (None,)]
    df = spark.createDataFrame(rows, "c string").select("c", text.labelled_parts(F.col("c")).alias("p"))
    got = {r.c: [(x.label, x.text) for x in r.p] for r in df.collect()}
    assert got[rows[0][0]] == [("A", "T1-weighted MRI showing lesion"), ("B", "FLAIR sequence")]
    assert [x[0] for x in got[rows[1][0]]] == ["A", "B", "C", "D"]
    assert [x[0] for x in got[rows[2][0]]] == ["A", "B"]
    assert got[rows[3][0]] == [] and got[None] == []


def test_json_and_lists(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('text {"a": 2} end',), ('{"a": ',), (None,)], "t string").select(text.first_json(F.col("t")).alias("j"))
    assert [r.j for r in df.collect()] == ['{"a": 1}', '{"a": 2}', None, None]
    df = spark.createDataFrame([("['a', 'b']",), ("[]",), ("['a'",), (None,)], "t string").select(text.list_literal(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == [["a", "b"], [], [], []]


def test_caption_and_figure_cases(spark):
    from velmira.plans import curation

    captions = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(curation.CAPTIONS)], "i int, c string").orderBy("i").select(text.labelled_parts(F.col("c")).alias("p"))
    assert ["|".join(f"{x.label}={x.text}" for x in r.p) for r in captions.collect()] == [w for _, w in curation.CAPTIONS]
    names = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(curation.FIGURE_FILES)], "i int, c string").orderBy("i").select(text.figure_id(F.col("c")).alias("f"))
    assert [r.f for r in names.collect()] == [w for _, w in curation.FIGURE_FILES]


def test_every_golden_label(spark):
    from velmira.plans import curation

    df = spark.createDataFrame([(i, *g) for i, g in enumerate(curation.GOLDEN)], "i int, task string, raw string, want string")
    rows = rules.with_labels(df, F.col("task"), "raw", "got").orderBy("i").collect()
    assert [(r.task, r.raw, r.got) for r in rows] == [(r.task, r.raw, r.want) for r in rows]


def test_rules_read_the_text_once(spark):
    df = spark.createDataFrame([("epilepsy_type", "focal")], "task string, raw string")
    plan = rules.with_labels(df, F.col("task"), "raw", "got")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 3
