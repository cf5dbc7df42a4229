import math
import re
from collections import Counter

from pyspark.sql import functions as F

from velmira.operators import features, images, metrics, report, splits, units, unpack
from velmira.sources.articles import parse_article
from velmira.streaming import incremental


def ages(spark, rows):
    df = spark.createDataFrame([(i, a, n, "PMC9000000001", "clash") for i, (a, n) in enumerate(rows)], "record_id long, age string, demographics_notes string, pmc_id string, days string")
    return {r.record_id: r.age_days for r in units.ages_in_days(df).collect()}


def test_ages(spark):
    got = ages(spark, [("20", None), ("6", "Age in months."), ("6", "First symptoms appeared at 6 months of age."), ("2½ years", None), ("half a year", None), ("9;6 (y;m)", None), ("2 6/12", None),
                       ("4/12", None), ("P1Y6M", None), ("1+4 weeks", None), ("about 3 mo", None), ("10-12", None), (">5", None), ("", None), (None, None), ("in the forties", None), ("30 weeks gestation", None),
                       ("twenty-one years", None), ("9", "A 9-month-old child."), ("12 hours", None), ("36 months (3 years)", None), ("３３", None), ("180 months", None), ("7,5 y", None)])
    year, month = 365.25, 30.4375
    half_up = lambda x: math.floor(x + 0.5)
    want = {0: 20 * year, 1: 6 * month, 2: 6 * year, 3: 2.5 * year, 4: year / 2, 5: 9 * year + 6 * month, 6: 2 * year + 6 * month, 7: 4 * month, 8: year + 6 * month, 9: 11, 10: 3 * month,
            17: 21 * year, 18: 9 * month, 19: 0.5, 20: 36 * month, 21: 33 * year, 22: 180 * month, 23: 7.5 * year}
    assert got == {k: half_up(v) for k, v in want.items()}


def test_ages_of_rows_without_or_with_one_key(spark):
    rows = [(None, "20", None, None), (None, "3 months", None, "PMC9000000001"), (7, "30", None, "PMC9000000001"), (7, "30", None, "PMC9000000001"), (8, "5", "Age in weeks.", None)]
    df = spark.createDataFrame(rows, "record_id long, age string, demographics_notes string, pmc_id string")
    got = sorted((r.record_id or 0, r.age_days) for r in units.ages_in_days(df).collect())
    assert got == [(0, 91), (0, 7305), (7, 10958), (7, 10958), (8, 35)]
    assert units.decoded_units(df).count() == 5


def test_ages_empty(spark):
    assert ages(spark, []) == {}


def test_ages_decode_only_where_the_convention_can_be_outweighed(spark, monkeypatch):
    # a paper whose ages are in months, some of them bare
    rows = [(i, f"{100 + i % 7}" if i % 4 == 0 else f"{100 + i % 7} months", None, "PMC9000000001") for i in range(80)]
    rows += [(100 + i, f"{30 + i % 9} years", None, "PMC9000000002") for i in range(80)] + [(200, "4", "Age in weeks.", None), (201, "7", None, None), (202, "2 years 3 months", None, None)]
    df = spark.createDataFrame(rows, "record_id long, age string, demographics_notes string, pmc_id string")
    days = lambda n, unit: math.floor(n * unit + 0.5)
    soft = {r.record_id: r.age_days for r in units.ages_in_days(df, convention=0.5).collect()}
    assert all(soft[i] == days(100 + i % 7, 30.4375) for i in range(80)) and soft[202] == 822

    def unused(*_):
        raise AssertionError("fitted or decoded without effect")

    monkeypatch.setattr(units, "learned", unused)
    monkeypatch.setattr(units, "_sequences", unused)
    hard = {r.record_id: r.age_days for r in units.ages_in_days(df).collect()}
    bare = {i: days(100 + i % 7, 365.25) for i in range(0, 80, 4)}
    assert hard == {i: d for i, d in soft.items() if i < 200} | bare | {200: 28, 201: 2557, 202: 822}


def test_viterbi_follows_the_level():
    import numpy as np

    model = units.Model(np.log(np.array([0.4, 0.4, 0.1, 0.05, 0.05])), np.array([2.0] * 5), np.array([1.5] * 5), 0.9, 0.3)
    values, first = np.array([10, 11, 10, 132, 126, 11.0]), np.array([0, -1, -1, -1, -1, -1])
    assert list(units.viterbi(values, first, model)) == [0, 0, 0, 1, 1, 0]
    assert list(units.viterbi(values, first, model, convention=400)) == [0] * 6
    assert list(units.viterbi(np.array([9.0]), np.array([3]), model, convention=400)) == [3]


def test_hidden_units_are_found_where_devices_keep_theirs(spark):
    import random

    r, rows = random.Random(8), []
    for i in range(1500):
        device, month = i % 30, (i % 30) % 2
        number = round((8 + device % 5) * (12 if month else 1) * (1 + 0.2 * r.random()))
        rows.append((i, f"{number} months" if month else f"{number} years", None, f"PMC90000{device:05d}"))
    df = spark.createDataFrame(rows, "record_id long, age string, demographics_notes string, pmc_id string")
    out = units.recovery(df).collect()
    hidden, found, year = (sum(r[c] for r in out) for c in ("n_hidden", "n_found", "n_year"))
    assert hidden > 200 and found >= 0.97 * hidden and year < 0.6 * hidden
    assert {r.record_id: r.unit for r in units.decoded_units(df).collect()} == {i: "month" if (i % 30) % 2 else "year" for i in range(1500)}
    assert units.recovery(df.where("false")).count() == 0 and units.decoded_units(df.where("false")).count() == 0


def paths(spark, values):
    df = spark.createDataFrame([(i, v, None, None, None, "s") for i, v in enumerate(values)], "record_id long, mri_image_paths string, eeg_image_paths string, num_mri_images int, num_eeg_images int, source string")
    out = {}
    for r in unpack.unpacked(df).orderBy("record_id", "pos").collect():
        out.setdefault(r.record_id, []).append((r.pos, r.path))
    return out


def test_unpack(spark):
    a, b, c = "figs/PMC1/a.jpg", "sub/PMC1/fig 1, left.png", "sub/PMC1/c;x.tif"
    got = paths(spark, [f"['{a}', '{b}']", f'["{a}","{c}"]', f"{a};{b}", f"{a} | {b}", f"['{a}' '{b}']", f";{a};;{b}, ", f'"[\'{a}\']"', "[]", "nan", None, "  ", f"['{a}', '{a}'", f"{a}\n{b}", f'{a};"{c}"'])
    one = [(1, a), (2, b)]
    assert got == {0: one, 1: [(1, a), (2, c)], 2: one, 3: one, 4: one, 5: one, 6: [(1, a)], 11: [(1, a), (2, a)], 12: one, 13: [(1, a), (2, c)]}


def test_metrics_against_plain_python(spark):
    rows = [("t", y, p) for y, p in zip("aabbbcc", "abbbcca")] + [("u", "a", "a")]
    df = spark.createDataFrame(rows, "task string, y string, p string")
    f1 = {r.task: r.macro_f1 for r in metrics.macro_f1(df, ["task"]).collect()}
    assert abs(f1["t"] - (0.5 + 2 / 3 + 0.5) / 3) < 1e-12 and f1["u"] == 1
    k = {r.task: r.kappa for r in metrics.kappa(df, ["task"]).collect()}
    assert abs(k["t"] - (4 / 7 - 17 / 49) / (1 - 17 / 49)) < 1e-12 and k["u"] is None


def test_images(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10, 0.9), (1, 1, 1, 11, 11, 0.8), (1, 50, 50, 60, 60, 0.7)], "image_id int, x1 int, y1 int, x2 int, y2 int, confidence double")
    assert sorted(r.x1 for r in images.suppressed(boxes).collect()) == [0, 50]
    cells = images.grid_cells(spark.createDataFrame([(1, 100, 100, [50], [5, 50])], "image_id int, width int, height int, v array<int>, h array<int>"))
    assert cells.count() == 4
    clusters = report.gap_clusters(spark.createDataFrame([(1, p) for p in (0, 19, 39, 60)], "k int, p int"), ["k"], "p", 20)
    assert sorted(r.n for r in clusters.collect()) == [1, 1, 2]


def test_features_and_splits(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 1.0], [4.0, 0.0])], "i int, a array<double>, b array<double>")
    got = {r.i: r.p for r in df.select("i", features.argmax(features.fused([F.col("a"), F.col("b")])).alias("p")).collect()}
    assert got == {1: 0, 2: 0}
    rows = spark.createDataFrame([("P1", 1, "Patient 1", True, "f", "x" * 20, "Fig 1"), ("P1", 2, "1", False, "f", "x" * 20, "Fig 2"), ("P1", 3, "", False, "g", "short", None)], "pmc_id string, seq int, patient_ref string, is_explicit boolean, fact string, quote string, figure_ref string")
    (one,) = splits.merged_entities(rows).collect()
    assert (one.display, one.n_facts, one.figures) == ("Patient 1", 1, ["Fig 1", "Fig 2"])


def test_article():
    xml = '<article article-type="review-article"><front><article-title>T <i> x </i>y</article-title><abstract><p>Abs</p></abstract></front><body><sec><title>One</title><p>Text</p><fig-group><fig id="f1"><label>Figure 1</label><caption><p>Cap</p></caption></fig></fig-group></sec><sec><p>Two</p></sec><table-wrap><table><tr><th>A</th><td>1</td></tr></table></table-wrap></body></article>'
    got = parse_article(xml, "PMC1")
    assert got["article_type"] == "review-article" and got["title"] == "T xy"
    assert [s["title"] for s in got["sections"]] == ["ABSTRACT", "BODY: One", "BODY: Section 2"]
    assert got["figures"][0]["fig_id"] == "f1" and got["tables"][0]["content"] == "A | 1"
    assert parse_article("<broken") is None and parse_article(None) is None


def test_stream_takes_each_file_once(spark, tmp_path):
    source, sink, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.range(5).write.parquet(source)
    incremental.ingest(spark, source, "id long", sink, state)
    spark.range(5, 8).write.mode("append").parquet(source)
    incremental.ingest(spark, source, "id long", sink, state)
    assert spark.read.parquet(sink).count() == 8


def test_tables(spark):
    from velmira.operators import tables

    df = spark.createDataFrame([(1, "Drug name here | Dose in milligrams\nsecond header line | x\n1 | 20\n2 | 30"), (2, "only one line"), (3, "A long heading cell | b\n" + "\n".join(f"{i} | x" for i in range(12)))], "k int, content string")
    got = {(r.k, r.batch): len(r.rows) for r in tables.table_rows(df, ["k"], "content").collect()}
    assert got == {(1, 0): 2, (3, 0): 10, (3, 1): 2}
    facts = tables.row_facts(spark.createDataFrame([(1, {"a": "1", "b": "-", "c": None}, "1")], "k int, cells map<string,string>, label string"), ["k"], "cells", "label").collect()
    assert [(r.fact, r.quote) for r in facts] == [("a: 1", "[Table 1] a: 1 ")]
    panels = spark.createDataFrame([(["m1", "m2", "m3"], ["e1", "e2"]), ([], ["e1", "e2", "e3"])], "m array<string>, e array<string>").select(tables.chosen_panels(F.col("m"), F.col("e"), 2).alias("p"))
    assert [r.p for r in panels.collect()] == [["m1", "e1"], ["e1", "e2"]]


def test_tfidf_fits_on_train_and_transforms_test(spark):
    train = ["Left insula seizure, left insula", "left temporal seizure onset", "Größe der Läsion", "Größe der Insel", None, ""]
    test = ["left insula onset a b", "die Größe der Insula", "unseen", None]
    words = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(re.findall(r"\b\w\w+\b", (t or "").lower()))
    for most in (4, 20_000):
        cf, df = Counter(x for t in train for x in words(t)), Counter(x for t in train for x in set(words(t)))
        vocabulary = sorted((x for x in df if df[x] >= 2), key=lambda x: (-cf[x], x))[:most]
        idf = {x: math.log((1 + len(train)) / (1 + df[x])) + 1 for x in vocabulary}
        want = {}
        for k, t in enumerate(test):
            w = {x: n * idf[x] for x, n in Counter(words(t)).items() if x in idf}
            want |= {(k, x): v / math.sqrt(sum(u * u for u in w.values())) for x, v in w.items()}
        frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "k int, text string")
        got = features.tfidf_transform(frame(test), features.tfidf_fit(frame(train), "text", most), "k", "text").collect()
        assert {(r.k, r.term): round(r.weight, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
        assert most == 4 or any(" " in x for x in vocabulary)


def test_table_rows_of_documents(spark):
    from velmira.plans import catalogue
    from velmira.operators import tables

    texts = [
        "Dose | Pt | Outcome\n10 mg | 1 | free\n20 mg | 2 | no",
        "Table 1. Doses\nDose | Pt\n10 mg | 1",
        "| Name of the patient | Dose |\n|---|---|\n| second heading line | mg |\n| third heading line | x |\n| 1 | 20 |",
        "| Name of the patient | Dose |\n| second heading line | mg |\n| P1 | 20 |",
        "Name | Dose\n | first cell empty\n1. a longer numbered cell | 20",
        "prose with one | in it",
        None,
        "Name | Dose | Outcome\n- | - | -\nP1 | 20 | ",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (len(r.header.split("\n")), len(r.rows)) for r in tables.table_rows(catalogue._table_texts(df), ["doc_id"], "text").collect()}
    assert got == {0: (1, 2), 1: (1, 1), 2: (3, 1), 3: (2, 1), 4: (2, 1), 7: (1, 2)}
