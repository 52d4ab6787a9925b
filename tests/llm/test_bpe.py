import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.WordBPE(PATH), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    pools = ["abcdefghijklmnopqrstuvwxyz", "the and ing tion's ", "AÀÉßΣσςİıǅ", "0123456789٣½", "́̈ȩ   \x1c\x1f\x85\t\n", "'s't're!?…—$%&", "漢字かな한글😀👩‍👩‍👧", "<|endoftext|>"]
    for n in (0, 1, 2, 5, 30, 300):
        for _ in range(60):
            pool = "".join(rng.sample(pools, rng.randint(1, 4)))
            yield "".join(rng.choice(pool) for _ in range(n))
    yield from ["", "don't DON'T 'S !'s", "a<|endoftext|>B <|startoftext|>", "ΟΔΟΣ Σ", "x" * 5000, "ab" * 4000, "".join(rng.choice("aeinrst") for _ in range(20000)), "!" * 3000]


def test_matches_library(both):
    own, lib = both
    for text in texts():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_lookahead_is_finite_and_memory_constant(both):
    own, _ = both
    look = own.table.lookahead
    assert look and look < 2000
    t = bpe.Transducer(own.table)
    rng, most = random.Random(5), 0
    whole = bytes(rng.choice(b"ethinoras") for _ in range(30000))
    ids = []
    for k in range(0, len(whole), 100):
        ids += t.feed(whole[k : k + 100])
        most = max(most, len(t.held))
    ids += t.finish()
    assert most <= look + max(bpe.BLOCK, own.table.longest) + bpe.BLOCK
    assert ids == own.table.merge([own.table.inner[b] for b in whole[:-1]] + [own.table.last[whole[-1]]])


def test_improper_merges_read_to_the_end():
    chars = bpe.byte_symbols()
    vocab = {c: i for i, c in enumerate(chars)} | {"abc": 300, "ab": 301}
    assert bpe.MergeTable(vocab, [("ab", "c"), ("a", "b")]).lookahead is None


def test_byte_machine_gives_characters_when_complete():
    m = bpe.ByteToText()
    assert [m.feed(bytes([b])) for b in "é€".encode()] == ["", "é", "", "", "€"]
    assert m.feed(b"\xe2\x82") == "" and m.finish() == "�"


def test_rows(spark, both):
    rows = [(1, None, "x"), (2, "", None), (3, "Hello  wörld", "x"), (3, "Hello  wörld", "x"), (None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.bpe_round_trip(docs, PATH, with_ids=True).collect()
    assert len(got) == 5 and {r.doc_id: r.n_tokens for r in got}[1] == 0
    for r in got:
        text = {1: "", 2: "", 3: "Hello  wörld", None: "a"}[r.doc_id]
        ids = both[1].encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == both[1].decode(ids, skip_special_tokens=False)
    assert bpe.bpe_round_trip(docs.limit(0), PATH).count() == 0
