"""Search over classes against brute force, recall on noisy copies, and every filter against plain sums."""

import random

import numpy as np

from topicloom.llm import audio


def test_every_filter_equals_plain_sums():
    frames = np.random.default_rng(3).random((30, 12)).astype(np.float32)
    got = audio.fingerprint(frames)
    for f, (kind, low, size, width, cuts) in enumerate(audio.FILTERS):
        for t in range(len(got)):
            x = frames[t : t + width, low : low + size].astype(float)
            half, mid, third = width // 2, size // 2, width // 3
            if kind == "time":
                a, b = x[:half].sum(), x[half:].sum()
            elif kind == "pitch":
                a, b = x[:, :mid].sum(), x[:, mid:].sum()
            elif kind == "cross":
                a, b = x[:half, :mid].sum() + x[half:, mid:].sum(), x[:half, mid:].sum() + x[half:, :mid].sum()
            else:
                a, b = x[third : 2 * third].sum(), (x[:third].sum() + x[2 * third : 3 * third].sum()) / 2
            level = np.searchsorted(cuts, np.log1p(a) - np.log1p(b))
            assert (got[t] >> np.uint32(30 - 2 * f)) & 3 == audio.GRAY[level]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def melodies(n, seed=0):
    rng = random.Random(seed)
    return [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(n)]


def test_classes_and_matches(spark):
    one, two, three = melodies(3)
    rows = [(100, one), (7, one), (8, one), (9, one[8:]), (10, two), (200, two), (11, three), (12, []), (13, None), (None, one), (7, one)]
    got = audio.class_matches(vectors(spark, rows).repartition(3)).collect()
    members = sorted(((r.id, r.class_id, r.class_size, r.n_matches) for r in got if r.kind == "member"), key=str)
    assert members == sorted(
        [(100, 7, 3, 3), (7, 7, 3, 3), (7, 7, 3, 3), (8, 7, 3, 3), (9, 9, 1, None), (10, 10, 2, 1), (200, 10, 2, 1), (11, 11, 1, None), (12, None, None, None), (13, None, None, None), (None, None, None, None)], key=str
    )
    assert [(r.class_id, r.match_class) for r in got if r.kind == "match"] == [(7, 9)]
    assert audio.class_matches(vectors(spark, [])).count() == 0


def test_many_copies_give_no_pairs(spark):
    one = melodies(1)[0]
    got = audio.class_matches(vectors(spark, [(k, one) for k in range(400)])).groupBy("kind").count().collect()
    assert [(r["kind"], r["count"]) for r in got] == [("member", 400)]


def best(a, b):
    """Least bit error of all overlaps that are long enough, by comparing at every offset."""
    out = 1.0
    for offset in range(audio.MIN_OVERLAP - len(b), len(a) - audio.MIN_OVERLAP + 1):
        i, j = max(offset, 0), max(-offset, 0)
        n = min(len(a) - i, len(b) - j)
        if n >= audio.MIN_OVERLAP:
            out = min(out, np.bitwise_count(a[i : i + n] ^ b[j : j + n]).sum() / (32 * n))
    return out


def test_recall_on_noisy_cut_and_shifted_copies(spark):
    """Queries are clean, the others noisy, cut, and shifted by less than a hop; recall against all pairs at all offsets."""
    rng = np.random.default_rng(1)
    t = np.arange(audio.RATE // 16) / audio.RATE
    rows = []
    for k in range(12):
        hz = 440 * 2 ** (rng.integers(-20, 20, 64) / 12)
        x = np.concatenate([np.sin(2 * np.pi * f * t) for f in hz])
        for v in range(8):
            y = x
            if v:
                cut = int(rng.integers(0, 9000))
                y = x[cut:] + rng.normal(0, 0.03 * v, len(x) - cut)
            rows.append((100 * k if v == 0 else 100 * k + v, (np.clip(y, -1.5, 1.5) * 15000).astype("<i2").tobytes()))
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, samples binary").repartition(4), "id", "samples").collect()
    by_id = {r.id: np.array(r.print, np.int32).view(np.uint32) for r in prints}
    want = {(q, m) for q in by_id if q % 100 == 0 for m in by_id if m != q and best(by_id[m], by_id[q]) <= audio.MAX_BIT_ERROR}
    got = {(r.query_id, r.match_id) for r in audio.search(spark.createDataFrame(prints)).collect()}
    assert len(want) >= 40 and got <= want
    assert len(got) / len(want) >= 0.9
