import itertools
import os
import random
import re

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from velmira.llm import bpe, candidates, canon, chunks, components, groupsplit, mixture, neardup, overlap, quality, quality_training, scans
from velmira.llm import textops as X

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentences(r, n):
    return [" ".join(r.choice(WORDS) + str(r.randint(1, 60)) if r.random() < 0.3 else r.choice(WORDS) for _ in range(r.randint(12, 20))) for _ in range(n)]


def edited(r, text, rate=0.03):
    return " ".join(r.choice(WORDS) if r.random() < rate else w for w in text.split())


def shingles(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}, len(w)


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def fixture(seed=5, n=60):
    r = random.Random(seed)
    texts = [". ".join(sentences(r, r.randint(4, 7))) for _ in range(n)]
    texts += [edited(r, t, rate) for t in texts[:25] for rate in (0.02, 0.05)]
    texts += [". ".join(r.sample(t.split(". "), len(t.split(". ")))) for t in texts[:15]]
    texts += texts[:5] + [None, "", "  ", "short text", "word " * 3000, texts[0].upper()]
    return texts


PATIENTS = "record_id long, pmc_id string, patient_num int, semiology_text string, mri_report_text string, eeg_report_text string, demographics_notes string, source string, uid string, body string"


def patients(spark, texts):
    rows = [(i, f"PMC90000{i % 40:05d}" if i % 11 else None, i, t, None, None, None, " PubMed", "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, PATIENTS)


def manifest(spark, n):
    folds = ["train", "Val", "test-gold", " TRAIN ", "test_bronze"]
    return spark.createDataFrame([(i, folds[i % 5]) for i in range(n) if i % 17] + [(1, "Val")], "record_id long, fold string")


def test_overlap_against_brute_force(spark):
    texts = fixture()
    got = {(r.id_a, r.id_b) for r in overlap.found(patients(spark, texts), manifest(spark, len(texts))).collect()}
    sets = [shingles(t) for t in texts]
    side = {i: i % 5 in (0, 3) for i in range(len(texts)) if i % 17}
    want = {(a, b) for a, b in itertools.combinations(sorted(side), 2) if side[a] != side[b] and sets[a][1] >= 12 and sets[b][1] >= 12 and likeness(sets[a][0], sets[b][0]) >= 0.6}
    assert got == want and len(got) > 30


def test_overlap_of_a_text_in_many_rows(spark):
    r = random.Random(77)
    same, near = ". ".join(sentences(r, 5)), None
    near = edited(r, same, 0.02)
    texts = [same] * 40 + [near] * 3 + ["short one"] * 30 + [". ".join(sentences(r, 5)) for _ in range(20)]
    rows = patients(spark, texts).withColumn("pmc_id", F.lit(None).cast("string"))
    got = {(x.id_a, x.id_b) for x in overlap.found(rows, manifest(spark, len(texts))).collect()}
    sets = [shingles(t) for t in texts]
    train = {i for i in range(len(texts)) if i % 17 and i % 5 in (0, 3)}
    other = {i for i in range(len(texts)) if i % 17 and i % 5 not in (0, 3)} | {1}
    want = {tuple(sorted((a, b))) for a in train for b in other if a != b and sets[a][1] >= 12 and sets[b][1] >= 12 and likeness(sets[a][0], sets[b][0]) >= 0.6}
    assert got == want and len(want) > 300
    assert all(x.n_pairs > 0 for x in overlap.report(rows, manifest(spark, len(texts))).collect())


def test_neardup_of_texts_in_many_rows(spark):
    r = random.Random(78)
    same = ". ".join(sentences(r, 5))
    texts = [same] * 30 + [edited(r, same, 0.02)] + ["below fifty words"] * 30 + [". ".join(sentences(r, 5))] * 12 + [". ".join(sentences(r, 5)) for _ in range(10)]
    got = {x.record_id: x.group_id for x in neardup.found(patients(spark, texts)).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 61 for i in range(61, 73)}


def test_derived_answers_tie_the_same_groups(spark, monkeypatch):
    texts = [t for t in fixture(15, 40) if t]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "uid long, body string, salt long")
    pairs = candidates.overlapping_pairs(df, 0.6, 12, candidates.triple_levels(df))
    tied = lambda links: {(x.node, x.component) for x in components.components(links).collect()}
    every = tied(candidates.verified(pairs, df, 0.6).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    assert tied(neardup.links_of(pairs, df)) == every and every
    monkeypatch.setattr(neardup, "GROUP_PAIRS", 2)
    monkeypatch.setattr(neardup, "_ROWS", 7)
    assert tied(neardup.links_of(pairs, df)) == every


def test_buckets_do_not_change_the_pairs(spark):
    texts = [t for t in fixture(12, 30) if t]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "uid long, body string, salt long")
    levels = candidates.triple_levels(df)
    few, many = ({(x.a, x.b) for x in candidates.verified(candidates.overlapping_pairs(df, 0.6, 12, levels, buckets=n), df, 0.6).collect()} for n in (2, 23))
    assert few == many and few


def test_the_order_counts_the_triples_of_every_text(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(4)) for i in range(300)] + ["one two three one two three"] * 50 + [None, "", "two words"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "uid long, body string").repartition(7)
    g, go = X.grams(*X.word_hashes(texts), 3)
    v, _ = X.distinct_sorted(g, go)
    want = np.bincount(candidates._cell(v), minlength=candidates._CELLS)
    assert want.sum() == 300 * 2 + 50 * 3
    level = np.frombuffer(zstandard.decompress(candidates.triple_levels(df)), np.uint8)
    assert ((level > 0) == (want > 0)).all() and level[want.argmax()] == level.max() > 3
    assert (candidates.triple_counts(df) == want).all()
    assert not np.frombuffer(zstandard.decompress(candidates.triple_levels(df.where("false"))), np.uint8).any()


def test_chunks_cut_alike_and_fractions(spark):
    r = random.Random(6)
    words = [f"w{r.randint(1, 500)}" for _ in range(400)]
    whole, tail = " ".join(words), " ".join(["other", "start"] + words[100:])
    digest, length, row = chunks.cut_chunks(*X.word_hashes([whole, tail, None, "", "one"]))
    assert [int(length[row == i].sum()) for i in range(5)] == [400, 302, 0, 0, 1]
    shared = np.isin(digest[row == 1], digest[row == 0])
    assert length[row == 1][shared].sum() > 280
    rows = patients(spark, [whole, tail, "nothing alike at all", None, whole])
    folds = spark.createDataFrame([(0, "train"), (1, "val"), (2, "val"), (3, "val"), (4, "train"), (4, "test")], "record_id long, fold string")
    got = {x.record_id: x.fraction for x in chunks.fractions(rows, folds).collect()}
    assert set(got) == {1, 2, 4} and got[1] > 0.9 and got[2] == 0 and got[4] == 1
    assert chunks.fractions(rows.where("false"), folds).count() == 0


def test_neardup_against_brute_force(spark):
    texts = fixture(9)
    got = {r.record_id: r.group_id for r in neardup.found(patients(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a][1] >= 50 and sets[b][1] >= 50 and likeness(sets[a][0], sets[b][0]) >= 0.6:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    size = {}
    for i in range(len(texts)):
        size[root(i)] = size.get(root(i), 0) + 1
    assert got == {i: root(i) for i in range(len(texts)) if size[root(i)] > 1}


def near_pairs(seed, n, sizes, low, high):
    """Texts by twos, the second with single words replaced at random until the likeness is in [low, high)."""
    r, texts = random.Random(seed), []
    while len(texts) < 2 * n:
        words = [f"{r.choice(WORDS)}{r.randint(1, 400)}" for _ in range(r.choice(sizes))]
        other = list(words)
        for i in r.sample(range(len(words)), len(words)):
            other[i] = "x%d" % r.randint(1, 10**6)
            like = likeness(shingles(" ".join(words))[0], shingles(" ".join(other))[0])
            if like < high:
                break
        if low <= like < high:
            texts += [" ".join(words), " ".join(other)]
    return texts


def linked_across(spark, texts):
    """Pairs of neighbours (2i, 2i + 1) that p1_found gives with the first in train and the second in another fold."""
    folds = spark.createDataFrame([(i, "val" if i % 2 else "train") for i in range(len(texts))], "record_id long, fold string")
    rows = patients(spark, texts).withColumn("pmc_id", F.lit(None).cast("string"))
    return {(r.id_a, r.id_b) for r in overlap.found(rows, folds).collect()}


@pytest.mark.parametrize("low", [0.6, 0.65])
def test_no_pair_near_the_threshold_is_lost(spark, low):
    texts = near_pairs(21, 250, (50, 60, 80, 150), low, low + 0.05)
    twos = {(i, i + 1) for i in range(0, len(texts), 2)}
    assert linked_across(spark, texts) == twos
    groups = {r.record_id: r.group_id for r in neardup.found(patients(spark, texts)).collect()}
    assert groups == {i: i - i % 2 for i in range(len(texts))}


def test_short_texts_near_the_threshold(spark):
    texts = near_pairs(22, 200, (13, 16, 20, 30, 40), 0.6, 0.7)
    assert linked_across(spark, texts) == {(i, i + 1) for i in range(0, len(texts), 2)}


def repeating(r):
    """Texts by twos that say a passage over and over, each two alike (0.96 and more) at different numbers of copies."""
    texts = []
    for words, few, many in ((60, 1, 4), (20, 20, 25), (40, 20, 25), (40, 3, 8), (25, 2, 40)):
        passage = " ".join(f"{r.choice(WORDS)}{r.randint(1, 400)}" for _ in range(words))
        texts += [" ".join([passage] * few), " ".join([passage] * many)]
    return texts + ["drop " * 60, "drop " * 3000]


def test_texts_that_repeat_themselves(spark):
    texts = repeating(random.Random(31))
    assert all(likeness(shingles(a)[0], shingles(b)[0]) > 0.9 for a, b in zip(texts[::2], texts[1::2]))
    assert linked_across(spark, texts) == {(i, i + 1) for i in range(0, len(texts), 2)}
    # p4 compares texts of 50 words and more, and all of these are that long
    groups = {r.record_id: r.group_id for r in neardup.found(patients(spark, texts)).collect()}
    assert groups == {i: i - i % 2 for i in range(len(texts))}


def test_shared_passage_of_few_triples_links_nothing(spark):
    r = random.Random(41)
    few = " ".join(r.choice("abcd") for _ in range(300))
    texts = [few + " " + " ".join(f"{r.choice(WORDS)}{r.randint(1, 10**6)}" for _ in range(100)) for _ in range(2)]
    assert likeness(shingles(texts[0])[0], shingles(texts[1])[0]) < 0.3
    assert neardup.found(patients(spark, texts)).count() == 0


def test_empty_tables(spark):
    none = patients(spark, [])
    assert overlap.found(none, manifest(spark, 0).where("false")).count() == 0
    assert neardup.found(none).count() == 0


def test_hot_group_of_copies(spark):
    r = random.Random(1)
    same = ". ".join(sentences(r, 5))
    rows = patients(spark, [same] * 300 + [". ".join(sentences(r, 5)) for _ in range(50)])
    got = neardup.found(rows).collect()
    assert len(got) == 300 and {x.group_id for x in got} == {0}


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 120)] + [(200, 200 + i) for i in range(50)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)] + [(7, 7), (None, 3), (1, 2)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {x.node: x.component for x in components.components(df).collect()} == {k: root(k) for k in parent}
    assert components.components(df.where("false")).count() == 0


def test_group_splits_keep_groups_together(spark):
    rows = patients(spark, ["x"] * 200).withColumn("patient_num", F.lit(1))
    links = spark.createDataFrame([(1, "PMC9000000001", 1, "9000000002", 1, "Same-Patient"), (2, "PMC9000000003", 1, "PMC9000000004", 1, "sibling"), (3, "PMC9000000005", 1, "PMC9999999999", 1, "same_patient")],
                                  "link_id long, pmc_id_a string, patient_num_a int, pmc_id_b string, patient_num_b int, relation string")
    out = groupsplit.splits(rows, links).collect()
    assert len(out) == 200 and {r.split for r in out} == {"train", "validation", "test"}
    by = {}
    for r in out:
        if r.group_key is not None:
            by.setdefault(r.group_key, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())
    shares = {r.split: r.reached_share for r in groupsplit.split_shares(rows, links).collect()}
    assert abs(shares["train"] - 0.8) <= 0.03 and abs(shares["test"] - 0.1) <= 0.03
    keys = {r.group_key for r in out}
    assert 9000000002 not in keys and 9000000004 in keys and 9000000005 in keys


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=80), st.integers(1, 5))
def test_minima_are_local(values, window):
    h = np.array(values, dtype=np.uint64)
    got = set(X.minima(h, np.array([0, len(h)]), window).tolist())
    starts = range(max(1, len(h) - window + 1)) if len(h) else []
    want = {i for s in starts for i in range(s, min(s + window, len(h))) if h[i] == h[s : s + window].min()}
    assert got == want


def test_likeness_matches_sets():
    texts = [t or "" for t in fixture(2, 20)]
    a, b = texts, texts[1:] + texts[:1]
    assert np.allclose(candidates.likeness_of_batches(a, b), [likeness(shingles(x)[0], shingles(y)[0]) for x, y in zip(a, b)])


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_public_library(encoder, text):
    import tiktoken

    if not hasattr(test_bpe_equals_public_library, "ref"):
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        test_bpe_equals_public_library.ref = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encoder.transducer.rank, special_tokens={})
    ids = encoder.encode(text)
    assert ids == test_bpe_equals_public_library.ref.encode_ordinary(text)
    stream = bpe.StreamDecoder(encoder.transducer.token)
    assert "".join(stream.feed([i]) for i in ids) + stream.end() == text


def test_bpe_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "A <|endoftext|> b" * 2000)], "doc_id long, text string")
    out = {r.doc_id: r.ids for r in bpe.encoded(df, "doc_id", "text").collect()}
    assert out[1] == [] and out[2] == [] and len(out[3]) > 10000
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {1: "", 2: "", 3: "A <|endoftext|> b" * 2000}


def test_apportion_is_sainte_lague():
    r = random.Random(2)
    for _ in range(50):
        w = np.array([r.random() for _ in range(r.randint(1, 6))])
        seats, plain = r.randint(0, 40), np.zeros(len(w), int)
        for _ in range(seats):
            plain[int(np.argmax(w / (2 * plain + 1)))] += 1
        assert list(mixture.apportion(w, seats)) == list(plain)
    assert list(mixture.apportion(np.array([0.9, 0.1]), 10, np.array([3, 100]))) == [3, 7]


def test_mixture_reaches_shares(spark):
    r = random.Random(4)
    docs = [(i, " ".join(sentences(r, 6)), ["a", "a", "a", "b", None][i % 5], "x") for i in range(400)] + [(900, None, "a", "x"), (901, "", "b", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, copy string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 3), ("gone", 0.1, 9)], "source string, target_share double, max_repeats int")
    out = {r.source: r for r in mixture.shares(df, targets, block_tokens=256).collect()}
    assert abs(out["a"].reached_share - 0.5 / 0.9) < 0.03 and out["gone"].n_rows == 0
    assert out["a"].most_copies <= 2 and out["b"].most_copies <= 3
    assert mixture.mixture(df.where("false"), targets).count() == 0
    assert mixture.mixture(df, targets.where("false")).count() == 0


def test_mixture_of_a_small_source_and_small_shards(spark):
    r = random.Random(14)
    docs = [(i, " ".join(sentences(r, r.randint(1, 6))), "tiny" if i % 40 == 0 else "large") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("tiny", 0.04, 6), ("large", 0.96, 1)], "source string, target_share double, max_repeats int")
    for shard_tokens in (5_000, 4_000_000):
        out = {x.source: x for x in mixture.shares(df, targets, shard_tokens=shard_tokens).collect()}
        assert abs(out["tiny"].reached_share - 0.04) < 0.01 and out["tiny"].most_copies <= 6 and out["large"].most_copies == 1


def test_rule_list_on_held_out_documents(spark):
    held = quality_training.labelled(600, seed=99)
    stats = quality.statistics(spark.createDataFrame(held[["doc_id", "text"]])).select("doc_id", quality.kind().alias("kind")).toPandas()
    both = held.merge(stats, on="doc_id")
    assert (both["kind"] == both["label"]).mean() > 0.97
    none = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t")], "doc_id long, text string")
    assert quality.found(none).count() == 0 and quality.report(none).count() == 3


def test_mapping(spark):
    regions = spark.createDataFrame([(1, "left insula", "left", "INS-L"), (2, "insula", None, "INS"), (3, "bilateral insula", "bilateral", "INS-B"), (4, "temporal lobe", None, "TL")], "region_id int, region_name string, side string, abbrev string")
    modalities = spark.createDataFrame([(1, "MRI_FLAIR", "FLAIR MRI"), (2, "EEG_ICTAL", "ictal EEG"), (3, "EEG_INTERICTAL", "interictal EEG"), (12, "UNKNOWN", "unknown")], "modality_id int, modality_name string, description string")
    cases = [("flair mri", 1), ("FLAIR seqeunce", 1), ("inter-ictal EEG", 3), ("EEG (ictal)", 2), ("CT", 0), ("ECG trace", 0), ("unknwon", 12), ("MRI_FLAIR", None), ("N/A", None), (None, None), ("-", None)]
    places = [("Insula, left", 1), ("INS L", 1), ("isnula", 2), ("bilat. insula", 3), ("insula?", 2), ("the temporal lobe region", 4), ("left hand", 0), ("panel B", 0), ("insula", None), (" ", None), ("ins-b", 3)]
    rows = [(i, m, p, "clash") for i, ((m, _), (p, _)) in enumerate(zip(cases, places))]
    df = spark.createDataFrame(rows, "subfig_id long, modality string, anatomical_region string, spelling string")
    got = {(r.field, r.subfig_id): r.ref_id for r in canon.found(df, modalities, regions).collect()}
    want = {("modality", i): w for i, (_, w) in enumerate(cases) if w is not None} | {("anatomical_region", i): w for i, (_, w) in enumerate(places) if w is not None}
    assert got == want


def test_scans(spark):
    base = "the patient was seen before morning and the attacks returned during the night with nausea"
    rows = [(i, base) for i in range(80)] + [
        (100, "the patient was seen be-\nfore morning and the\nJournal of Brain Noise, Vol. 12\nattacks returned"), (101, "the patient was\n[95]\nseen before"), (102, "the pafient was seen before morn1ng"),
        (103, "JOURNAL OF BRAIN NOISE\nthe attacks returned"), (104, None), (105, "  "), (106, "CASE REPORT · Journal of Brain Noise\nthe attacks"), (107, "Clinical course:\nthe attacks returned"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "record_id long, semiology_text string, kind string")
    none = spark.createDataFrame([], "gt_id long, evidence_quote string")
    got = {(r.row_id, r.kind) for r in scans.traces(df, none).collect()}
    assert got == {(100, "hyphen"), (100, "header"), (101, "pageno"), (102, "chars"), (103, "header"), (106, "header")}
    clean = {r.row_id: r.text for r in scans.repaired(df, none).collect()}
    assert clean[100] == "the patient was seen before morning and the attacks returned" and clean[102] == "the patient was seen before morning"
    assert scans.traces(df.where("false"), none).count() == 0
    # rows of one id are told apart by their text; numbered headers count as page numbers too
    more = df.unionByName(spark.createDataFrame([(200, "the attacks re-\nturned", "x"), (200, "the patient was\nseen be-\nfore", "x"), (201, "17   Journal of Brain Noise\nthe attacks returned", "x"), (202, "Journal of Brain Noise, Vol. 3\nthe attacks", "x")], "record_id long, semiology_text string, kind string"))
    again = {(r.row_id, r.kind) for r in scans.traces(more, none).collect()}
    assert again == got | {(200, "hyphen"), (201, "header"), (201, "pageno"), (202, "header")}
    assert sorted(r.text for r in scans.repaired(more, none).where("row_id = 200").collect()) == ["the attacks returned", "the patient was seen before"]


def test_result_is_the_same_when_the_scans_are_doubled(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("needs the test tables")
    one, quotes = spark.read.parquet(f"{d}/patients.parquet"), spark.read.parquet(f"{d}/task_evidence.parquet")
    once = {tuple(r) for r in scans.traces(one, quotes).collect()}
    two = one.unionByName(one.withColumn("record_id", F.col("record_id") + 10**9)), quotes.unionByName(quotes.withColumn("gt_id", F.col("gt_id") + 10**9))
    twice = {tuple(r) for r in scans.traces(*two).where("row_id < 1000000000").collect()}
    assert len(once ^ twice) <= 0.02 * len(once) and len(once) > 30
