import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(lib, text):
    return [*lib.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_match_library():
    own, lib, rng = packing.SpacedBPE(PATH), Tokenizer.from_file(PATH), random.Random(1)
    pool = list("ab .,'s\n\t  é漢😀\xa0 ") + ["<|endoftext|>", " the", "  ", "\n\n", "'s", "1", "\x1c"]
    own.limit = 50
    for _ in range(20):
        texts = ["".join(rng.choice(pool) for _ in range(n)) for n in [0, 1, 2, 3, 8, 40] * 5] + [None, "a b " + "x" * 100]
        for text, got in zip(texts, own.packed(texts), strict=True):
            assert got == np.asarray(ids_of(lib, text)[:-1], "<u4").tobytes(), repr(text)


def naive_first_fit(rests, capacity):
    bins = []
    for p in sorted(rests, key=lambda p: (-p[2], p[0])):
        for b in bins:
            if sum(x[2] for x in b) + p[2] <= capacity:
                b.append(p)
                break
        else:
            bins.append([p])
    return bins


@pytest.mark.parametrize("seed", range(5))
def test_tree_is_first_fit(seed):
    rng = random.Random(seed)
    rests = [(d, 0, rng.randint(1, 63)) for d in range(rng.randint(0, 200))]
    assert packing.first_fit_decreasing(rests, 64) == naive_first_fit(rests, 64)


@pytest.mark.parametrize("seed", range(30))
def test_pack_is_whole_without_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 63, 64, 65, rng.randint(1, 700)]) for _ in range(rng.randint(0, 60))]
    seen = defaultdict(list)
    for pieces in packing.pack(lengths, 64):
        total = sum(n for _, _, n in pieces)
        assert total <= 64 and total & (total - 1) == 0
        for d, s, n in pieces:
            seen[d] += range(s, s + n)
    assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}


def test_rows(spark):
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", "a b", "a b", "word " * 3000, "x\n\n y  z"] + [f"text number {k} " * (k % 50) for k in range(300)]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start long")
    rows = packing.pack_documents(docs, PATH, with_ids=True).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        want = ids_of(lib, texts[r.doc_id])
        assert r.doc_tokens == len(want) and r.ids == want[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes())
        seen[r.doc_id] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(v) == list(range(len(ids_of(lib, texts[d])))) for d, v in seen.items()) and len(seen) == len(texts)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (7, "c"), (7, "c")], "doc_id long, text string")
    assert packing.pack_documents(odd, PATH).count() >= 4
