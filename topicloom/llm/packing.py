"""Packing documents into sequences: first-fit decreasing on a tournament tree, in randomised groups.

Documents are dealt to groups by a seeded hash of their id, about
``GROUP_DOCS`` to a group, and each group is packed by itself: one shuffle of the
texts, no state across groups. Within a group

1. whole sequences are cut off each document; what is left is shorter than one;
2. the rests are placed first-fit decreasing; the first bin with room is found
   by descending a tournament tree of bin capacities;
3. gaps are closed: the emptiest bins are taken apart and their pieces cut to
   fill the gaps of the fullest;
4. the one bin that then may still have room is cut into sequences whose sizes
   are powers of two, which need no padding.

Defined cases: a null text counts as empty, which is one end id; documents with
null or repeated ids are packed row by row, their pieces told apart by sequence
and offset only; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.bpe import byte_symbols
from topicloom.llm.shared import bounded_batches, row_parts

CAPACITY = 1024
GROUP_DOCS = 256
END_ID = 0
CACHE_WORDS, CACHED_CHARS = 250_000, 64
#: Fixed value: the pre-tokens of byte-level tokenizers.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(r"\s{10000}")


class SpacedBPE:
    """Ids of a byte-level tokenizer, word by word.

    The pre-tokens of the byte-level pattern never reach from a character that
    isn't white space over a following space, so words between single spaces are
    encoded alone, the unseen ones of a group together, and kept in two
    generations of at most ``limit`` words. Texts in which white space meets white
    space, and those that hold a special token, go to the library whole.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        (self.tab,) = self.library.encode("\t", add_special_tokens=False).ids
        self.limit = limit
        self.known: dict[str, bytes | None] = {}  # of words after a space; None: it depends on its neighbours
        self.old: dict[str, bytes | None] = {}

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[str]) -> list[str]:
        """Have the ids of these words at hand; gives the long ones, which aren't to be kept."""
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        words = words.difference(self.known)  # looks up the words only; a difference of key views would walk the whole cache
        kept = words & self.old.keys()
        for w in kept:
            self.known[w] = self.old[w]
        words -= kept
        plain = []
        for w in words:
            if not w or w[0].isspace() or w[-1].isspace():
                self.known[w] = None
            elif "\t" in w:
                self.known[w] = self.whole(" " + w)
            else:
                plain.append(w)
        # a tab between two words is a pre-token of its own
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            (found,) = self.library.encode_batch_fast(["".join([f" {w}\t" for w in part]) + " a"], add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            ends, raw, start = np.flatnonzero(ids == self.tab).tolist(), ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                self.known[w] = raw[4 * start : 4 * end]
                start = end + 1
        return [w for w in words if len(w) > CACHED_CHARS]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [[] if not t or any(s in t for s in self.special) else t.split(" ") for t in texts]
        words: set[str] = set()
        for own in split:
            words.update(own)
        long = self._learn(words)
        get, out = self.known.__getitem__, []
        for text, own in zip(texts, split, strict=True):
            if own and own[0] and not own[0][0].isspace() and not own[0][-1].isspace():
                try:
                    out.append(self.whole(own[0]) + b"".join(map(get, own[1:])))
                    continue
                except TypeError:
                    pass
            out.append(self.whole(text or ""))
        for w in long:
            self.known.pop(w, None)
        return out


class RankedBPE:
    """Ids of a byte-level tokenizer whose merges are numbered in their order, by an encoder that merges by token number.

    Merging by number gives the library's ids if every merge is what its own bytes
    come to; tests check that for the vocabulary in use, and all characters against
    the library. Texts that hold a special token or a long run of white space, which
    the encoder's pattern can't take, go to :class:`SpacedBPE`, and so do all texts
    where the file says anything else than plain byte-level merges.
    """

    def __init__(self, path: str):
        import tiktoken

        self.other = SpacedBPE(path)
        self.ranks = ranks_of(json.loads(self.other.library.to_str()))
        self.plain = self.ranks and tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=self.ranks, special_tokens={})

    def _fits(self, text: str) -> bool:
        return not any(s in text for s in self.other.special) and not LONG_SPACE.search(text)

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.plain:
            return self.other.packed(texts)
        out = [self.plain.encode_to_numpy(t).astype("<u4", copy=False).tobytes() if t and self._fits(t) else None for t in texts]
        left = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(left, self.other.packed([texts[k] for k in left]), strict=True):
            out[k] = ids
        return out


def ranks_of(stored: dict) -> dict[bytes, int] | None:
    """Number of each token's bytes, if a stored tokenizer is plain byte-level BPE with the bytes first and then the merges in order; else None."""
    model, before = stored["model"], stored["pre_tokenizer"] or {}
    odd = [stored["normalizer"], *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
    if any(odd) or (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) != ("ByteLevel", False, True):
        return None
    byte = {c: b for b, c in enumerate(byte_symbols())}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if sorted(model["vocab"].get(c, -1) for c in byte) != list(range(256)) or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    return {bytes(byte[c] for c in token): n for token, n in model["vocab"].items() if n < 256 + len(merges)}


@lru_cache(2)
def tokenizer(path: str) -> RankedBPE:
    """One tokenizer for each Python worker."""
    return RankedBPE(path)


class Tournament:
    """A complete binary tree over bin capacities; each node holds the larger of its children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(bins, 1):
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with so much room."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.best[at] < size:
                at += 1
        return at - self.leaves

    def take(self, b: int, size: int) -> None:
        at = b + self.leaves
        self.best[at] -= size
        while at > 1:
            at //= 2
            self.best[at] = max(self.best[2 * at], self.best[2 * at + 1])


Piece = tuple[int, int, int]  # document, start, length


def first_fit_decreasing(rests: list[Piece], capacity: int) -> list[list[Piece]]:
    """Bins of pieces; ties by document."""
    tree, bins = Tournament(len(rests), capacity), []
    for piece in sorted(rests, key=lambda p: (-p[2], p[0])):
        b = tree.first_fit(piece[2])
        if b == len(bins):
            bins.append([])
        bins[b].append(piece)
        tree.take(b, piece[2])
    return bins


def close_gaps(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Take the emptiest bins apart to fill the others; the last with room ends up in powers of two."""
    used = [sum(p[2] for p in b) for b in bins]
    full = [b for b, u in zip(bins, used, strict=True) if u == capacity]
    part = sorted((u, k) for k, u in enumerate(used) if u < capacity)
    i, j = 0, len(part) - 1
    loose: list[Piece] = []
    rows = {k: list(bins[k]) for _, k in part}
    room = {k: capacity - u for u, k in part}
    while i < j:
        k = part[j][1]
        while room[k] and i < j:
            if not loose:
                loose = rows.pop(part[i][1])[::-1]
                i += 1
                if i > j:
                    break
            doc, start, length = loose.pop()
            size = min(length, room[k])
            rows[k].append((doc, start, size))
            room[k] -= size
            if size < length:
                loose.append((doc, start + size, length - size))
        if not room[k]:
            full.append(rows.pop(k))
            j -= 1
    last = [p for k in sorted(rows) for p in rows[k]] + loose[::-1]
    total = sum(p[2] for p in last)
    while total >= capacity:
        taken, last = _cut(last, capacity)
        full.append(taken)
        total -= capacity
    while total:
        size = 1 << (total.bit_length() - 1)
        taken, last = _cut(last, size)
        full.append(taken)
        total -= size
    return full


def _cut(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``size`` ids of a list of pieces, and the rest."""
    taken, rest = [], list(pieces)
    while size:
        doc, start, length = rest.pop(0)
        n = min(length, size)
        taken.append((doc, start, n))
        size -= n
        if n < length:
            rest.insert(0, (doc, start + n, length - n))
    return taken, rest


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences of pieces that hold each id of documents of these lengths once."""
    sequences = [[(d, s, capacity)] for d, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rests = [(d, n - n % capacity, n % capacity) for d, n in enumerate(lengths) if n % capacity]
    return sequences + close_gaps(first_fit_decreasing(rests, capacity), capacity)


def _packer(path: str, capacity: int, with_ids: bool):
    def group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = tokenizer(path)
        keys = table.column("id").to_pylist()
        ids = [x + struct.pack("<I", END_ID) for x in t.packed(table.column("text").to_pylist())]
        order = sorted(range(len(keys)), key=lambda k: (keys[k] is None, keys[k] or 0, ids[k]))
        keys, ids = [keys[k] for k in order], [ids[k] for k in order]
        base = key[0].as_py() << 32
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        cut = []
        for s, pieces in enumerate(pack([len(x) // 4 for x in ids], capacity)):
            at = 0
            for doc, start, length in pieces:
                own = ids[doc][4 * start : 4 * (start + length)]
                for c, v in zip(out, (keys[doc], start, length, zlib.crc32(own), len(ids[doc]) // 4, base + s, at), strict=True):
                    out[c].append(v)
                if with_ids:
                    cut.append(np.frombuffer(own, "<u4").astype(np.int32))
                at += length
        columns = {c: pa.array(v, pa.int64()) for c, v in out.items()}
        if with_ids:
            columns["ids"] = pa.array(cut, pa.list_(pa.int32()))
        return pa.Table.from_pydict(columns)

    return group


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` its ids."""
    bounded_batches(docs.sparkSession)
    groups = row_parts(docs, group_docs)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(groups)))
    return rows.groupBy("g").applyInArrow(_packer(path, capacity, with_ids), schema)
