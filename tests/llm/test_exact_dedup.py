"""Exact dedup against brute force: nulls, empty and long texts, ties, repeated rows, hot groups, clashing columns."""

import hashlib
import re

from topicloom.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, salt int, norm string, keep_id long"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        known = [x for x in ids if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=4):
    docs = spark.createDataFrame([(i, t, "d", 1, "n", 7) for i, t in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_dedup.exact_dedup(docs).collect()), key=str)


def test_rows_equal_brute_force(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (4, "a\n b"), (1, " a b"), (9, None), (8, ""), (None, None), (None, "only null"), (None, "only null"), (7, "x"), (7, "x"), (2, "é é"), (6, "é é")]
    rows += [(100 + k, "long " * 40_000 + str(k % 2)) for k in range(4)]
    rows += [(1000 + k, "hot  copy" if k % 2 else "hot copy") for k in range(500)] + [(None, "hot copy")] * 50
    assert run(spark, rows) == brute(rows)


def test_result_does_not_depend_on_the_partitions(spark):
    rows = [(k, f"t{k % 7}") for k in range(60)]
    assert run(spark, rows, 1) == run(spark, rows, 9) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(docs).count() == exact_dedup.drop_copies(docs).count() == 0


def test_equal_digests_of_different_contents_stay_apart(spark, monkeypatch):
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, bits: real(exact_dedup.F.lit("same"), bits))
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b  b"), (5, "b b")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)]
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == [1, 3, 4]


def test_rows_that_stay_are_those_flagged(spark):
    rows = [(2, "x y"), (2, "a b c"), (1, "a b c"), (None, "a b c"), (None, "z"), (None, "z"), (1, "a b  c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, norm(r.text)) for r in exact_dedup.drop_copies(docs).collect()), key=str) == [(1, "a b c"), (2, "x y"), (None, "z")]


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
