import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from topicloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def same(own, lib, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in own.packed(texts)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_random_texts_match_library():
    own, lib, rng = packing.RankedBPE(PATH), Tokenizer.from_file(PATH), random.Random(1)
    assert own.plain
    pool = list("ab .,'sS\n\t\r  é漢😀\xa0 ́ ") + ["<|endoftext|>", " the", "  ", "\n\n", "'s", "'LL", "'ve", "1", "\x1c", "\x00"]
    for _ in range(40):
        assert same(own, lib, ["".join(rng.choice(pool) for _ in range(n)) for n in [0, 1, 2, 3, 8, 40, 300]] + [None])


def test_every_character_matches_library():
    own, lib = packing.RankedBPE(PATH), Tokenizer.from_file(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c >= 0xE0000 and c < 0xE0200)]
    for at in range(0, len(points), 512):
        assert same(own, lib, ["\tz\t".join(f"a{c}b 1{c}2 !{c}? {c} {c}a {c}1 {c}! \n{c}\n" for c in map(chr, points[at : at + 512]))]), hex(points[at])


def test_long_runs_match_library():
    own, lib, rng = packing.RankedBPE(PATH), Tokenizer.from_file(PATH), random.Random(2)
    letters = "".join(rng.choice("abcdefg") for _ in range(50_000))
    assert same(own, lib, ["a" * 50_000, letters, "!" * 50_000, "7" * 50_000, " " * 9_999 + "a", " " * 1_000_000 + "a", "x" + "\n" * 1_000_000, "é" * 50_000])


def test_each_merge_is_what_its_bytes_come_to():
    """The condition under which merging by number equals merging by listed pairs."""
    stored = json.loads(open(PATH, encoding="utf-8").read())
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in stored["model"]["merges"]]
    rank = {p: k for k, p in enumerate(pairs)}
    for k, (a, b) in enumerate(pairs):
        parts = list(a + b)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(pairs)))
            assert (parts[best], parts[best + 1]) in rank, k
            parts[best : best + 2] = ["".join(parts[best : best + 2])]


def test_other_files_go_to_the_library(tmp_path):
    stored = json.loads(open(PATH, encoding="utf-8").read())
    stored["pre_tokenizer"]["add_prefix_space"] = True
    assert packing.ranks_of(stored) is None
    stored["pre_tokenizer"]["add_prefix_space"] = False
    stored["model"]["merges"][:2] = stored["model"]["merges"][1::-1]
    assert packing.ranks_of(stored) is None
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(stored), encoding="utf-8")
    own = packing.RankedBPE(str(path))
    assert not own.plain and same(own, Tokenizer.from_file(str(path)), ["the other text", None, "a\n\nb"])
