"""Chroma fingerprints: alignment of cut and noisy copies, and defined cases."""

import numpy as np

from topicloom.llm import audio


def tune(seed, notes=40):
    hz = 440 * 2 ** (np.random.default_rng(seed).integers(-20, 20, notes) / 12)
    return np.concatenate([np.sin(2 * np.pi * f * np.arange(2048) / audio.RATE) for f in hz]).astype(np.float32)


def printed(x):
    return audio.fingerprint(audio.chroma(x))


def test_integral_image_equals_plain_sums():
    frames = np.random.default_rng(1).random((40, 12)).astype(np.float32)
    got = printed_frames = audio.fingerprint(frames)
    kind, low, size, width, cuts = audio.FILTERS[0]
    for t in range(len(printed_frames)):
        a, b = frames[t : t + width // 2, low : low + size].sum(), frames[t + width // 2 : t + width, low : low + size].sum()
        assert got[t] >> 30 == audio.GRAY[np.searchsorted(cuts, np.log1p(a) - np.log1p(b))]


def test_cut_copy_aligns():
    x = tune(1)
    offset, overlap, error = audio.align(printed(x), printed(x[audio.HOP * 20 : audio.HOP * 100]))
    assert offset == 20 and overlap > 50 and error == 0


def test_noisy_copy_aligns_and_other_tune_does_not():
    x = tune(2)
    noise = np.random.default_rng(0).normal(0, 0.02, len(x)).astype(np.float32)
    offset, _, error = audio.align(printed(x), printed(x + noise))
    assert offset == 0 and error < audio.MAX_BIT_ERROR
    other = audio.align(printed(x), printed(tune(3)))
    assert other is None or other[1] < audio.MIN_OVERLAP or other[2] > audio.MAX_BIT_ERROR


def test_search_and_defined_cases(spark):
    pcm = lambda x: (x * 20000).astype("<i2").tobytes()
    rows = [(0, pcm(tune(1)), 1), (1, pcm(tune(1)[audio.HOP * 8 :]), 1), (2, pcm(tune(9)), 1), (3, None, 1), (4, b"x", 1), (None, pcm(tune(1)), 1)]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, samples binary, print int"), "id", "samples")
    sizes = {r.id: len(r.print) for r in prints.collect()}
    assert sizes[3] == sizes[4] == 0 and sizes[0] == sizes[1] + 8
    assert [(r.query_id, r.match_id, r.offset) for r in audio.search(prints).collect()] == [(0, 1, -8)]
    assert audio.media_matches(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
