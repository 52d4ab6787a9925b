"""The pipeline's stages on near copies between two thresholds, null ids and repeated rows."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def words(start, n):
    return " ".join(f"w{k}" for k in range(start, start + n))


def test_near_copies_from_080_on_go(spark):
    base = words(0, 104)  # 100 shingles
    near = words(0, 94) + " " + words(900, 10)  # 90 shared of 110: 0.818
    far = words(500, 93) + " " + words(700, 11)
    other = words(500, 82) + " " + words(800, 22)  # 78 shared of 122: 0.64
    docs = table(spark, [(1, base), (2, near), (3, far), (4, other)])
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == [1, 3, 4]


def got(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_null_ids_and_repeated_rows(spark):
    a, b, c, d, e = (words(1000 * k, 60) for k in range(5))
    like_d = words(3000, 59) + " end"  # 55 shared of 57
    run = words(4010, 30)  # a passage of e
    language = table(spark, [(None, "12 34"), (None, a), (None, None), (1, b), (1, b), (2, "..")])
    assert got(corpus_pipeline.language(spark, language, "")) == [(1, b), (1, b), (None, a)]
    exact = table(spark, [(1, b)] * 3 + [(2, b), (None, b), (1, c), (None, a), (None, a), (None, d)])
    assert got(corpus_pipeline.exact(spark, exact, "")) == [(1, b), (1, c), (None, a), (None, d)]
    near = table(spark, [(5, d), (5, a), (5, a), (7, like_d), (None, like_d), (None, c), (None, b), (None, e)])
    assert got(corpus_pipeline.near(spark, near, "")) == [(5, a), (5, d), (None, b), (None, c), (None, e)]
    rows = [(1, b), (1, b), (1, c), (2, e), (None, a), (None, f"{run} tail"), (None, d)]
    assert got(corpus_pipeline.substrings(spark, table(spark, rows), "")) == [(1, b), (1, c), (2, e), (None, "tail"), (None, a), (None, d)]
