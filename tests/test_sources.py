import json
import struct

import pytest
from pyspark.sql import functions as F

from velmira.operators import images, labels, linking, metrics, report, splits
from velmira.sources import files
from velmira.streaming import incremental


def test_csv_and_null_literals(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,label,note\n1,None,none\n2,Focal," "\n3,x,"said ""hi"",\nthen left"\n')
    rows = {r.k: r for r in files.read_csv(spark, str(tmp_path / "a.csv"), "k int, label string, note string", ("", "none"), keep=("label",)).collect()}
    assert rows[1].label == "None" and rows[1].note is None and rows[2].note is None
    assert rows[3].note == 'said "hi",\nthen left'


def test_flat_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], ("x", 2)), (2, None, None)], "k int, items array<string>, pair struct<s:string,n:int>")
    files.write_flat_csv(df, str(tmp_path / "flat"))
    back = {r.k: r for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "flat")).withColumn("k", F.col("k").cast("int")).collect()}
    assert json.loads(back[1]["items"]) == ["a", "b"] and json.loads(back[1]["pair"]) == {"s": "x", "n": 2} and back[2]["items"] is None
    files.write_json_lines(df, str(tmp_path / "lines"))
    assert sorted(files.read_json(spark, str(tmp_path / "lines"), "k int, items array<string>, pair struct<s:string,n:int>").collect()) == sorted(df.collect())
    files.write_json_array(df, str(tmp_path / "all.json"))
    assert json.load(open(tmp_path / "all.json"))[0]["items"] == ["a", "b"]
    with pytest.raises(ValueError):
        files.write_json_array(df, str(tmp_path / "more.json"), limit=1)


def test_parted_output_and_missing_input(spark, tmp_path):
    df = spark.createDataFrame([("t", "train", 1), ("t", "test", 2)], "task string, fold string, k int")
    files.write_parted(df, str(tmp_path / "parts"), ["task", "fold"])
    assert files.read_or_empty(spark, str(tmp_path / "parts" / "task=t" / "fold=test"), "k int").collect()[0].k == 2
    assert files.read_or_empty(spark, str(tmp_path / "parts" / "task=t" / "fold=gone"), "k int").count() == 0


def test_runs(spark, tmp_path):
    for name, f1 in (("ez_seed1", 0.5), ("ez_seed2_strong", 0.7), ("ez_seed1_regimeB_C", 0.1)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"macro_f1": f1}))
    (tmp_path / "broken.json").write_text("{")
    got = {r.stem: (r.task, r.seed, r.strong, r.regime) for r in files.read_runs(spark, str(tmp_path / "*.json"), "macro_f1 double").collect()}
    assert got == {"ez_seed1": ("ez", 1, False, None), "ez_seed2_strong": ("ez", 2, True, None), "ez_seed1_regimeB_C": ("ez", 1, False, "B_C")}


def test_finding_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.PNG", "b.txt", "sub/c.png", "sub/d.jpg"):
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())
    assert names(files.find_files(spark, str(tmp_path), ("png",))) == ["a.PNG", "c.png"]
    assert names(files.find_files(spark, str(tmp_path), pattern="^[bd]")) == ["b.txt", "d.jpg"]
    candidates = spark.createDataFrame([("P1", 0, "x/P1"), ("P1", 1, "y/P1"), ("P2", 0, "x/P2")], "pmc_id string, ord int, path string")
    existing = spark.createDataFrame([("y/P1",), ("z/P1",)], "path string")
    assert [tuple(r) for r in files.first_existing(candidates, existing, "pmc_id", "ord").collect()] == [("P1", "y/P1")]
    found = spark.createDataFrame([("d/PMC1/a.xml",), ("d/PMC1/b.nxml",), ("d/PMC1/.c.nxml",), ("d/PMC2/sub/a.nxml",), ("d/PMC2/z.xml",)], "path string")
    assert {r.pmc_id: r.path for r in files.primary_documents(found).collect()} == {"PMC1": "d/PMC1/b.nxml", "PMC2": "d/PMC2/z.xml"}


def test_image_headers(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\0" * 8
    gif, bmp = b"GIF89a" + struct.pack("<HH", 10, 20) + b"\0" * 4, b"BM" + b"\0" * 16 + struct.pack("<ii", 30, -40)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 50, 60) + b"\0" * 8
    for name, data in (("a.png", png), ("b.gif", gif), ("c.bmp", bmp), ("d.jpg", jpeg), ("e.png", b"nothing")):
        (tmp_path / name).write_bytes(data)
    rows = images.image_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    got = {r.path.rsplit("/", 1)[-1]: (r.format, r.width, r.height) for r in rows}
    assert got == {"a.png": ("PNG", 640, 480), "b.gif": ("GIF", 10, 20), "c.bmp": ("BMP", 30, 40), "d.jpg": ("JPEG", 60, 50), "e.png": (None, None, None)}
    assert images.image_size(None) == (None, None, None)


def test_patient_client(spark):
    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise files.AskAgain(503)
        return [p.upper() for p in prompts]

    waits = []
    assert files.patient(flaky, sleep=waits.append)(["a"]) == ["A"] and len(waits) == 2
    with pytest.raises(files.AskAgain):
        files.patient(lambda _: (_ for _ in ()).throw(files.AskAgain(400)), sleep=waits.append)(["a"])
    assert files.wait_seconds(0, draw=lambda: 0) == 1 and files.wait_seconds(50, draw=lambda: 1) == 90
    turn = files.round_robin([lambda p: ["x"], lambda p: ["y"]])
    assert [turn(["p"])[0] for _ in range(3)] == ["x", "y", "x"]

    def complete(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p * 2 for p in prompts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k int, prompt string").coalesce(1)
    got = {r.k: (r.answer, r.error) for r in files.answered(df, "k", "prompt", complete, batch=1, concurrent=2).collect()}
    assert got == {1: ("aa", None), 2: (None, "no"), 3: ("cc", None)}


def test_progress_can_be_resumed(spark, tmp_path):
    log = str(tmp_path / "progress")
    incremental.record_progress(spark, log, "read", {"rows": 5})
    incremental.record_progress(spark, log, "parse", {"rows": 4}, error="stopped")
    assert incremental.finished_steps(spark, log) == ["read"]
    incremental.record_progress(spark, log, "parse", {"rows": 6})
    assert incremental.finished_steps(spark, log) == ["parse", "read"]
    assert {(r.step, r.value, r.n_errors) for r in incremental.progress(spark, log).collect()} == {("read", 5.0, 0), ("parse", 6.0, 1)}


def test_answers(spark):
    rows = [("epilepsy_type", "Focal", "Focal"), ("epilepsy_type", "generalized.", "Generalised"), ("epilepsy_type", "It is FOCAL epilepsy", "Focal"), ("epilepsy_type", "combined", "Combined Focal and Generalised"),
            ("seizure_type", "Focal onset", "Focal"), ("aed_response", "the case is refractory", "drug-resistant"), ("surgery_outcome", "Engel I", "Seizure-free"), ("status_epilepticus", "NCSE", "Non-convulsive SE"),
            ("status_epilepticus", "", None), ("status_epilepticus", None, None), ("ez_localization", "???", None), ("unknown_task", "Focal", None)]
    df = labels.with_answers(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, task string, raw string, want string"), "task", "raw")
    assert [(r.raw, r.answer) for r in df.orderBy("i").collect()] == [(r[1], r[2]) for r in rows]
    filled = {r.i: (r.label_id, r.invalid) for r in labels.with_fallback(df, "task", "answer", only_populated=True).collect()}
    assert filled[0] == (0, False) and filled[8] == (1, True) and filled[10] == (0, True)
    with pytest.raises(KeyError):
        labels.answer_class("survival", F.lit("x"), F.lit("x"))


def test_linking(spark):
    panels = spark.createDataFrame([(1, 9, "2"), (2, 9, "3"), (3, None, "2")], "subfig_id int, paper long, figure_no string")
    profiles = spark.createDataFrame([(9, "p1", ["Figure 2", "Fig. 12"]), (9, "p2", ["Figure 2A"]), (9, "p3", None), (8, "p4", ["Figure 2"])], "paper long, patient_ref string, figure_refs array<string>")
    got = {r.subfig_id: (r.n_profiles, r.first_ref) for r in linking.linked_profiles(panels, profiles).collect()}
    assert got == {1: (2, "p1"), 2: (0, None), 3: (0, None)}
    details = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 3, "none")], "path string, at int, caption string")
    found = linking.with_details(spark.createDataFrame([("a",), ("b",), (None,)], "path string"), details, "path", "at").collect()
    assert {r.path: r.caption for r in found} == {"a": "new", "b": None, None: None}
    refs = spark.createDataFrame([("patients 2-5",), ("cases 1, 3 and 4",), ("patients 3–4 and 9",), ("all",), (None,), ("5-2",)], "ref string").select("ref", linking.ranges(F.col("ref")).alias("n")).collect()
    assert [r.n for r in refs] == [[2, 3, 4, 5], [1, 3, 4], [3, 4, 9], [], None, [2, 5]]
    one = splits.linked_figures(spark.createDataFrame([("P", 1, "2")], "pmc_id string, subfig_id int, figure_no string"), spark.createDataFrame([("P", "a", ["Fig 2b", "Figure 2"])], "pmc_id string, patient_ref string, figure_refs array<string>")).collect()
    assert [(r.subfig_id, r.figure_ref) for r in one] == [(1, "Fig 2b")]


def test_reports(spark):
    runs = spark.createDataFrame([("t", 2, 0.4, None), ("t", 1, 0.6, 7), ("t", 3, None, 9)], "task string, seed int, f1 double, n int")
    (one,) = report.seed_means(runs, ["task"], "f1", "n", "seed").collect()
    assert (one["mean"], one["values"], one["n_seeds"], one["n_first"]) == (0.5, [0.6, 0.4], 3, 7)
    best = report.best_per_tier(spark.createDataFrame([("g", "b", 0.5), ("g", "a", 0.5), ("g", "c", 0.1), ("h", "c", None)], "tier string, name string, f1 double"), "tier", "name", "f1").collect()
    assert [(r.tier, r.name, r.score) for r in best] == [("g", "a", 0.5)]
    preds = spark.createDataFrame([("t", "a", "a"), ("t", "a", "b"), ("t", "b", "b"), ("t", "b", None)], "task string, y string, p string")
    rows = {r.label: r for r in metrics.full_report(preds, ["task"]).collect()}
    assert rows["accuracy"].f1 == 0.5 and rows["accuracy"].support == 4 and abs(rows["macro avg"].f1 - (2 / 3 + 0.5) / 2) < 1e-12
    weights = metrics.populated_weights(preds, ["task"], spark.createDataFrame([("t", "a", True), ("t", "b", True), ("t", "c", True), ("t", "d", False)], "task string, label string, populated boolean"))
    assert {r.label: r.weight for r in weights.collect()} == {"a": 4 / 6, "b": 4 / 6, "c": 4 / 3, "d": 0.0}
    people = spark.createDataFrame([("P1", 2, "Patient 1", True, "g", "y" * 20, None), ("P1", 1, "1", False, "f", "x" * 20, None), ("P1", 3, "1", False, "f", "x" * 20, None), ("P1", 4, "2", True, "h", "short", None)], "pmc_id string, seq int, patient_ref string, is_explicit boolean, fact string, quote string, figure_ref string")
    assert {r.person: [f.fact for f in r.facts] for r in splits.wholly_merged(people).collect()} == {"1": ["f", "g"], "2": []}


def test_decisions_and_grids(spark):
    scores = [([0.9, 0.1, 0.2], "ACCEPT"), ([0.001, 0.0001, 0.0012], "BORDERLINE"), ([0.0004, 0.0001, 0.0001], "BORDERLINE"), ([0.1, 0.1, 0.2], "REJECT"), ([0.75, 0.1, 0.5], "ACCEPT"), ([0.74, 0.1, 0.5], "BORDERLINE")]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(scores)], "i int, s array<double>").select("i", images.decision(F.col("s"), 2).alias("d")).orderBy("i")
    assert [r.d for r in df.collect()] == [w for _, w in scores]
    shapes = spark.createDataFrame([(100, 100), (400, 100), (100, 400), (130, 100)], "w int, h int").select(F.size(images.aspect_grid(F.col("w"), F.col("h"))).alias("n"))
    assert [r.n for r in shapes.collect()] == [4, 2, 2, 1]


def test_small_functions(spark):
    from velmira.functions import text

    definition = 'Classes of the task\n"Focal": one side\n"Unknown": neither\nNote: see "Focal"'
    df = spark.createDataFrame([(definition, ["Focal"]), (definition, []), (None, ["Focal"])], "d string, c array<string>")
    got = [r.x for r in df.select(text.lines_about(F.col("d"), F.col("c")).alias("x")).collect()]
    assert got == ['Classes of the task\n"Focal": one side\nNote: see "Focal"', "Classes of the task", None]
    flat = report.tier_rows(spark.createDataFrame([("b", (0.5, 3), None)], "name string, gold struct<f1:double,n:int>, bronze struct<f1:double,n:int>"), ["name"], ["gold", "bronze"], ["f1", "n"])
    assert sorted(tuple(r) for r in flat.collect()) == [("b", "bronze", None, None), ("b", "gold", 0.5, 3)]
    seen = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, t int").select("k", F.timestamp_seconds("t").alias("ts"))
    assert {r.k: r.ts.second for r in incremental.first_seen(seen, "k", "ts").collect()} == {"a": 1, "b": 2}
    parts = spark.createDataFrame([("t", 0), ("t", 4)], "task string, label_id int"), spark.createDataFrame([("t", 2), ("u", 1)], "task string, label_id int")
    assert {r.task: r.n_classes for r in splits.head_sizes(list(parts), ["task"], "label_id").collect()} == {"t": 5, "u": 2}
    assert splits.support(parts[0], ["task"]).first().status == "skipped"


def test_captions_by_level(spark):
    from velmira.functions import text

    df = spark.createDataFrame([("(A) left. (B) right.", "a", "said"), ("(A) left. (B) right.", "c", "said"), ("whole", "a", None), (None, "a", None)], "c string, l string, m string")
    got = [(r.x.text, r.x.confidence) if r.x else None for r in df.select(text.caption_levels(F.col("c"), F.col("l"), F.col("m")).alias("x")).collect()]
    assert got == [("left", 0.8), ("said", 0.6), ("whole", 0.3), None]
