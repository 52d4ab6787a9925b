"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. In a merge list whose products are distinct and whose parts come
before their products, a token boundary can differ between two texts that agree
to its right for ``lookahead`` symbols only through a chain of merges, each of
lower priority than the last, in which the right part of every merge starts with
the left part of the one before. ``MergeTable`` computes the longest reach of
such a chain from the merge list. The transducer therefore holds one block and
the lookahead: it merges the block, emits the tokens that end at least
``lookahead`` symbols before its end, and goes on from there. No merge crosses an
emitted boundary, so the rest is encoded as if it stood alone. What it holds is
constant, however long a word without white space may be.

Decoding. ``ByteToText`` is an incremental state machine that takes bytes and
gives text as soon as a character is complete; malformed bytes become U+FFFD.

Speed. Words between white space are encoded once and kept in a two-generation
cache of bounded size; words of more than ``CACHED_CHARS`` pass it by.

Defined cases: a null or empty text has no ids and decodes to the empty text;
special tokens that occur in a text get their own ids, as the tokenizers library
does by default; repeated rows are encoded each; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from topicloom.llm.shared import bounded_batches

BLOCK = 256
CACHED_CHARS = 64
CACHE_WORDS, CACHE_PARTS = 250_000, 150_000


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where Latin-1 prints it, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(own)
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary, merge priorities and the lookahead that follows from them."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.token = {i: t for t, i in vocab.items()}
        self.suffix = suffix
        chars = byte_symbols()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + suffix] for c in chars]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        for r, (a, b) in enumerate(pairs):
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        self.order = {p: r for p, (r, _) in self.rank.items()}
        self.product = [vocab[a + b] for a, b in pairs]
        size = lambda i: len(self.token[i].removesuffix(suffix) if suffix else self.token[i])
        self.longest = max((size(p) for _, p in self.rank.values()), default=1)
        self.lookahead = self._lookahead(size)

    def _lookahead(self, size) -> int | None:
        """Longest reach of a chain of merges, in symbols; None if the list isn't proper, so that words must be read to their end."""
        parts: dict[int, tuple[int, int]] = {}
        reach: dict[int, int] = {}  # by left part: its size and what its merges so far reach beyond it
        most = 1
        singles = {*self.inner, *self.last}
        for (u, v), (_, product) in self.rank.items():
            if product in parts or not (u in parts or u in singles) or not (v in parts or v in singles):
                return None
            far, spine = size(v), v
            while True:
                far = max(far, reach.get(spine, 0))
                if spine not in parts:
                    break
                spine = parts[spine][0]
            parts[product] = (u, v)
            reach[u] = max(reach.get(u, 0), size(u) + far)
            most = max(most, far)
        return most

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of one block: always the pair of best priority, the leftmost first."""
        rank = self.rank
        if len(symbols) < 64:
            ids, get, none = list(symbols), self.order.get, len(rank)
            pairs = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
            while pairs and (best := min(pairs)) < none:
                k = pairs.index(best)
                ids[k : k + 2] = (self.product[best],)
                del pairs[k]
                if k:
                    pairs[k - 1] = get((ids[k - 1], ids[k]), none)
                if k < len(pairs):
                    pairs[k] = get((ids[k], ids[k + 1]), none)
            return ids
        ids: list[int | None] = list(symbols)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p][0], k, p) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if j >= n or ids[k] is None or (ids[k], ids[j]) != pair:
                continue
            ids[k], ids[j] = rank[pair][1], None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] < n and (p := (ids[i], ids[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p][0], i, p))
        return [i for i in ids if i is not None]


class Transducer:
    """Encodes the bytes of one word as they come, in constant memory."""

    def __init__(self, table: MergeTable, block: int = BLOCK):
        self.table, self.held = table, bytearray()
        self.room = None if table.lookahead is None else table.lookahead + max(block, table.longest)

    def _tokens(self, end: bool) -> list[int]:
        t = self.table
        symbols = [t.inner[b] for b in self.held]
        if end and symbols:
            symbols[-1] = t.last[self.held[-1]]
        return t.merge(symbols)

    def feed(self, data: bytes) -> Iterator[int]:
        if len(data) <= BLOCK and not self.held:
            self.held += data
            return
        for at in range(0, len(data), BLOCK):
            self.held += data[at : at + BLOCK]
            while self.room is not None and len(self.held) > self.room:
                stable, done = len(self.held) - self.table.lookahead, 0
                for token in self._tokens(False):
                    size = len(self.table.token[token])
                    if done + size > stable:
                        break
                    done += size
                    yield token
                del self.held[:done]

    def finish(self) -> Iterator[int]:
        yield from self._tokens(True)
        self.held.clear()


class ByteToText:
    """Bytes in, complete characters out."""

    def __init__(self):
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._state.decode(data)

    def finish(self) -> str:
        return self._state.decode(b"", True)


class Cache(dict):
    """A dict that fills itself through ``make`` and holds at most two generations of ``limit`` entries."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordBPE:
    """A word-based BPE tokenizer read from a tokenizers JSON file: NFC, lower case, white space dropped, words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = MergeTable(self.vocab, spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or "")
        self.token = self.table.token | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        bytelevel = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes = {i: bytes(byte_of[c] for c in t) if bytelevel and t not in self.special else t.encode() for i, t in self.token.items()}
        self.gap = b"" if bytelevel else b" "
        self.parts = Cache(self._part, CACHE_PARTS)
        self.cache = Cache(self._packed, CACHE_WORDS)

    def _word(self, word: str) -> list[tuple[bytes, bytes]]:
        """The pre-tokens of a run without white space."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        return list(map(self.parts.__getitem__, self.pattern.findall(word.lower())))

    def _part(self, part: str) -> tuple[bytes, bytes]:
        """Ids of one pre-token from the transducer, as little-endian unsigned 32-bit integers, and what they decode to."""
        t, data = Transducer(self.table), part.encode()
        ids = [*t.feed(data), *t.finish()]
        return struct.pack(f"<{len(ids)}I", *ids), "".join(self.decode_stream(ids)).encode()

    def _packed(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word, and what they decode to."""
        found = self._word(word)
        return found[0] if len(found) == 1 else (b"".join([p[0] for p in found]), self.gap.join([p[1] for p in found]))

    def pieces(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded) of the words and special tokens of a text, in order."""
        segments = self.special_pattern.split(text) if self.special_pattern and "<|" in text else [text]
        for k, segment in enumerate(segments):
            if k % 2:
                yield np.asarray([self.special[segment]], "<u4").tobytes(), segment.encode()
            elif any(c in segment for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
                yield from map(self.cache.__getitem__, regex.findall(r"[^\s]+", segment))
            else:
                yield from map(self.cache.__getitem__, segment.split())

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in self.pieces(text or "")), "<u4").tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain. A file without a decoder means the tokens' own strings with a space between them."""
        machine, first = ByteToText(), True
        for i in ids:
            yield machine.feed(self.bytes[i] if first else self.gap + self.bytes[i])
            first = False
        yield machine.finish()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(2)
def tokenizer(path: str) -> WordBPE:
    """One tokenizer for each Python worker."""
    return WordBPE(path)


def _encoded(path: str, with_ids: bool):
    def batches(it):
        t = tokenizer(path)
        for batch in it:
            counts, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = list(t.pieces(text)) if text else []
                packed, decoded = b"".join([p[0] for p in found]), t.gap.join([p[1] for p in found])
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
                    texts.append(decoded.decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return batches


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids and the decoded text. A map over the rows, no shuffle."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(_encoded(path, with_ids), schema)
