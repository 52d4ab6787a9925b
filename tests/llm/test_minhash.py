"""Near dedup against brute force over all pairs."""

import random
import re

import pytest

from topicloom.llm import minhash

SCHEMA = "doc_id long, text string, sig string, bucket int"


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing every pair."""
    sets = {}
    for i, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(8):
        base = [word() for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(12):  # a drifting chain: the ends may not be linked to the smallest id
            rows.append(" ".join(base))
            base = base[:]
            for _ in range(max(1, len(base) // 90)):
                base[rng.randrange(len(base))] = word()
    rows += ["One two", "one\ttwo", "three", "", None, " \n", "A B C D E", "a b c d e", "x " * 3000]
    rng.shuffle(rows)
    return [(i, t, "s", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    got = minhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = minhash.near_dedup(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_many_near_copies_that_the_smallest_does_not_link(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(700):
        own = base[:]
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(own), "", 0))
    got = minhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_table_and_null_id(spark):
    assert minhash.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    got = minhash.near_dedup(spark.createDataFrame([(None, "a b c d e f", "", 0), (7, "a b c d e f", "", 0)], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == [(7, 2, 7, True), (None, 2, 7, False)]
