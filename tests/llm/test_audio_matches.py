"""The registered media query returns every match of a query."""

import random

from topicloom.llm import audio


def test_all_matches_of_a_query(spark):
    rng = random.Random(0)
    melody = [rng.uniform(-1, 1) for _ in range(64)]
    other = [rng.uniform(-1, 1) for _ in range(64)]
    rows = [(0, melody), (1, melody), (2, melody[8:]), (3, other), (4, None), (None, melody), (100, melody)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = audio.media_matches(vectors).collect()
    pairs = sorted((r.id, r.match_id) for r in got if r.match_id is not None)
    assert pairs == [(0, 1), (0, 2), (0, 100), (100, 0), (100, 1), (100, 2)]
    assert all(r.n_matches == 3 and r.overlap >= audio.MIN_OVERLAP and r.bit_error <= audio.MAX_BIT_ERROR for r in got if r.match_id is not None)
    assert sorted((r.id is None, r.id or 0) for r in got if r.match_id is None) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]
    assert all(r.n_matches == 0 for r in got if r.match_id is None)
    again = audio.media_matches(vectors.unionByName(vectors)).collect()
    assert sum(r.match_id is not None for r in again) == 2 * len(pairs)
