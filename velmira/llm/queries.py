"""Registered queries of the llm operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velmira.llm import bpe, canon, chunks, groupsplit, mixture, neardup, overlap, quality, scans
from velmira.session import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: overlap.found(table(s, d, "patients"), table(s, d, "split_manifest")),
        "p1_report": lambda s, d: overlap.report(table(s, d, "patients"), table(s, d, "split_manifest")),
        "p1_overlap": lambda s, d: chunks.fractions(table(s, d, "patients"), table(s, d, "split_manifest")),
        "p1_overlap_report": lambda s, d: chunks.report(table(s, d, "patients"), table(s, d, "split_manifest")),
        "p4_found": lambda s, d: neardup.found(table(s, d, "patients")),
        "p5_found": lambda s, d: canon.found(table(s, d, "subcaptions"), table(s, d, "modality_ref"), table(s, d, "region_ref")),
        "p6_found": lambda s, d: scans.traces(table(s, d, "patients"), table(s, d, "task_evidence")),
        "p6_repaired": lambda s, d: scans.repaired(table(s, d, "patients"), table(s, d, "task_evidence")),
        "p7_found": lambda s, d: groupsplit.found(table(s, d, "patients"), table(s, d, "patient_links"), table(s, d, "split_manifest")),
        "p8_ids": lambda s, d: bpe.encoded(table(s, d, "documents"), "doc_id", "text"),
        "p8_roundtrip": lambda s, d: bpe.decoded(bpe.encoded(table(s, d, "documents"), "doc_id", "text"), "doc_id"),
        "p9_mix": lambda s, d: mixture.mixture(table(s, d, "documents"), table(s, d, "source_targets")),
        "p9_shares": lambda s, d: mixture.shares(table(s, d, "documents"), table(s, d, "source_targets")),
        "p10_found": lambda s, d: quality.found(table(s, d, "documents")),
        "p10_report": lambda s, d: quality.report(table(s, d, "documents")),
        "p7_shares": lambda s, d: groupsplit.split_shares(table(s, d, "patients"), table(s, d, "patient_links")),
        "p7_splits": lambda s, d: groupsplit.splits(table(s, d, "patients"), table(s, d, "patient_links")),
    }


_number = lambda c: f"TRY_CAST(nullif(regexp_extract({c}, '([0-9]{{10}})', 1), '') AS BIGINT)"
_squeezed = lambda c: rf"trim(regexp_replace(lower({c}), '[\s\x{{00A0}}_\-]+', '_', 'g'), '_')"
# every pair of texts that share a run of three words, with the size of what they share: brute force over whole tables
_LIKE = (
    " w AS (SELECT id, field, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM b),"
    " t AS (SELECT DISTINCT id, field, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= {least}),"
    " n AS (SELECT id, field, count(*) AS n FROM t GROUP BY ALL),"
    " c AS (SELECT x.id AS a, y.id AS b, x.field, count(*) AS m FROM t x JOIN t y ON x.g = y.g AND x.field = y.field AND x.id < y.id GROUP BY ALL),"
    " k AS (SELECT c.a, c.b FROM c JOIN n p ON c.a = p.id AND c.field = p.field JOIN n q ON c.b = q.id AND c.field = q.field WHERE m / CAST(p.n + q.n - m AS DOUBLE) >= 0.6)"
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "WITH b AS (SELECT record_id AS id, 1 AS field, semiology_text AS body FROM patients UNION ALL SELECT record_id, 2, mri_report_text FROM patients),"
        + _LIKE.format(least=12)
        + f", f AS (SELECT DISTINCT record_id, {_squeezed('fold')} = 'train' AS t FROM split_manifest WHERE record_id IS NOT NULL AND {_squeezed('fold')} <> ''),"
        + f" s AS (SELECT x.record_id AS a, y.record_id AS b FROM patients x JOIN patients y ON x.patient_num = y.patient_num AND {_number('x.pmc_id')} = {_number('y.pmc_id')} AND x.record_id < y.record_id),"
        + " u AS (SELECT a, b FROM k UNION SELECT a, b FROM s)"
        + " SELECT DISTINCT a AS id_a, b AS id_b FROM u JOIN f p ON a = p.record_id JOIN f q ON b = q.record_id WHERE p.t <> q.t",
        "p4_found": "WITH RECURSIVE b AS (SELECT record_id AS id, 1 AS field, concat_ws(' ', semiology_text, eeg_report_text, demographics_notes) AS body FROM patients),"
        + _LIKE.format(least=50)
        + ", e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)"
        + " SELECT node AS record_id, min(root) AS group_id FROM r GROUP BY node",
        "p7_found": f"WITH RECURSIVE p AS (SELECT record_id, {_number('pmc_id')} AS paper, patient_num FROM patients),"
        f" l AS (SELECT DISTINCT {_number('pmc_id_a')} AS a, patient_num_a AS na, {_number('pmc_id_b')} AS b, patient_num_b AS nb FROM patient_links WHERE {_squeezed('relation')} = 'same_patient'),"
        " t AS (SELECT l.a, l.b FROM l WHERE EXISTS (SELECT 1 FROM p WHERE paper = a AND patient_num = na) AND EXISTS (SELECT 1 FROM p WHERE paper = b AND patient_num = nb)),"
        " e AS (SELECT a, b FROM t UNION SELECT b, a FROM t), r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),"
        " g AS (SELECT node, min(root) AS root FROM r GROUP BY node),"
        " k AS (SELECT record_id, coalesce(g.root, paper) AS group_key FROM p LEFT JOIN g ON paper = node WHERE paper IS NOT NULL),"
        f" f AS (SELECT DISTINCT record_id, {_squeezed('fold')} AS fold FROM split_manifest WHERE {_squeezed('fold')} <> ''),"
        " x AS (SELECT group_key FROM k JOIN f USING (record_id) GROUP BY 1 HAVING count(DISTINCT fold) > 1)"
        " SELECT record_id, group_key FROM k SEMI JOIN x USING (group_key)",
        "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
