"""The tokens of ``text.tokens`` found piece by piece, for large tables; a worker remembers what the rules make of a piece.

A piece lies between spaces. The rules change a piece by its own characters, with these exceptions: they treat the text's two ends
in their own way, and split a full stop off before a piece that begins with a capital letter, unless that letter's piece was itself
reached by such a match. Pieces without special characters stay as they are. Where Python's rules may differ from the JVM's, there
are no tokens (``None``), and the caller takes ``text.tokens``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from topicloom.functions import text as T

#: As many pieces or tokens are remembered at once, of as many characters, and so many tokens go to the JVM in one batch.
MOST, LONGEST, BATCH = 100_000, 60, 100_000
#: Texts are counted together until they have so many characters.
CHARS = 8_000_000

_RULES = [(re.compile(p, re.A), re.sub(r"\$(\d)", r"\\g<\1>", r), p[-1:] == "$" or k == 0) for k, (p, r) in enumerate(T.TREEBANK)]
_STOP = next(k for k, (p, _) in enumerate(T.TREEBANK) if p.endswith("([A-Z])"))
#: The first rule that looks for whole words, which end otherwise in the JVM outside ASCII.
_WHOLE = next(k for k, (p, _) in enumerate(T.TREEBANK) if p.startswith("(?i)"))
_SPECIAL = re.compile(r"""[":,.;@#$%&?!'\[\](){}<>]|--""")
_LISTED = ("cannot", "gonna", "wanna", "gotta", "lemme", "gimme", "d'ye", "more'n", "'tis", "'twas")
_WORDS = re.compile("|".join(_LISTED), re.I | re.A)
_OPEN, _INITIAL = re.compile(r"\.[\])}>\"']*\Z"), re.compile(r"[A-Z]\.[\])}>\"']*\Z")
#: Put after a piece whose full stop comes before a capital letter, and where a piece may have been reached by the match before.
_MARK = "\0"
_BEFORE_CAPITAL, _CHAIN = re.compile(r"\.([\])}>\"']*) +(?=[A-Z])"), re.compile(rf"{_MARK} [A-Z]\.[\])}}>\"']*{_MARK}")
#: Pieces of one word alone, and what stands for other pieces: no word, a text that isn't counted, and from the last one down lists of words.
_PLAIN = r"^[a-zA-ZÀ-ÖØ-öø-ÿ]+(?:[,:;?!]|\.\x00)?$"
_NONE, _UNSURE, _SEVERAL = -1, -2, -3
#: Pieces in which each special character is treated alone, so that one search cuts them.
_SIMPLE = re.compile(r"""(?!\.)(?:[^"'.,:-]|\.(?!\.)|[,:](?![,:])|-(?!-))*\Z""")
_CUT = re.compile(r"[;@#$%&?!\[\](){}<>]|[:,](?![0-9])|(?:[^;@#$%&?!\[\](){}<>:,]|[:,](?=[0-9]))+")
#: The JVM's ``$`` also stands before these.
_LINE_ENDS = "\x85\u2028\u2029"
_LETTER, _DIGIT = re.compile("[a-zA-Z]"), re.compile("[0-9]")
#: Of these letters both sides know the same cases.
_LATIN = re.compile("[\0-\u012f\u0131-\u017f]*\\Z")


class Unsure(Exception):
    pass


class Treebank:
    def __init__(self):
        self.known: dict[str, tuple] = {}
        self.placed: dict[tuple, tuple] = {}

    def _rules(self, context: str, whole: bool) -> tuple[list[str], bool]:
        """Tokens of a short text, and whether a full stop was split off before a capital letter."""
        out, reached = f" {context} ", False
        for k, (pattern, to, trimmed) in enumerate(_RULES[: len(_RULES) if whole else _WHOLE]):
            if k == _STOP:
                reached = pattern.search(out) is not None
            out = f" {pattern.sub(to, out.strip(' '))} " if trimmed else pattern.sub(to, out)
        return [x for x in out.split(" ") if x], reached

    def _at(self, piece: str, first: bool, last: bool, capital: bool, odd: bool) -> tuple[tuple, bool]:
        """A piece's tokens at its place, with stand-ins for its neighbours; ``capital``: a capital letter follows, ``odd``: its text has some of ``_WORDS``."""
        if last and piece[-1] in _LINE_ENDS:
            raise Unsure
        whole = odd and _WORDS.search(piece) is not None
        if not whole:
            core, end = piece[:-1], piece[-1]
            if core.isalnum():
                if end in ",:;?!@#$%&":
                    return (core, end), False
                if end == ".":
                    return ((core, end), not last) if last or capital else ((piece,), False)
            if not _SPECIAL.search(piece):
                return (piece,), False
            if _SIMPLE.match(piece):
                stop = _OPEN.search(piece) if last or capital else None
                if not stop:
                    return tuple(_CUT.findall(piece)), False
                k = stop.start()
                return (*_CUT.findall(piece[:k]), ".", *piece[k + 1 :]), not last
        key = (piece, first, last, capital)
        if key in self.placed:
            return self.placed[key]
        if whole and not piece.isascii():
            raise Unsure
        found, reached = self._rules(("" if first else "a ") + piece + ("" if last else " A" if capital else " a"), whole)
        out = tuple(found[0 if first else 1 : len(found) if last else -1]), reached
        if len(piece) <= LONGEST:
            if len(self.placed) >= MOST:
                self.placed.clear()
            self.placed[key] = out
        return out

    def tokens(self, text: str) -> list[str] | None:
        for c in "\t\n\r\f":
            text = text.replace(c, " ")
        lower = text.lower()
        odd = any(w in lower for w in _LISTED)
        pieces = [p for p in text.split(" ") if p]
        out, last, reached, get = [], len(pieces) - 1, -2, self.known.get
        push = out.append
        try:
            for i, p in enumerate(pieces):
                if p.isalnum() and not (odd and _WORDS.search(p)):
                    push(p)
                    continue
                if 0 < i < last:
                    found = get(p)
                    if found is None:
                        # what ends in a full stop depends on the next piece
                        found = () if "." in p and _OPEN.search(p) else self._at(p, False, False, False, odd)[0]
                        if len(p) <= LONGEST:
                            if len(self.known) >= MOST:
                                self.known.clear()
                            self.known[p] = found
                    if found:
                        out += found
                        continue
                capital = i < last and "A" <= pieces[i + 1][0] <= "Z" and not (reached == i - 1 and _INITIAL.match(p))
                found, own = self._at(p, i == 0, i == last, capital, odd)
                out += found
                if own:
                    reached = i
        except Unsure:
            return None
        return out


class VocabularyWord:
    """``text.is_vocabulary_word`` for one token: the lower-cased word, or nothing. ``Unsure`` where only the JVM knows a letter."""

    def __init__(self, stop_words: bool | list[str] = True, numbers: bool = True, short: bool = True, punctuation: bool = True, min_len: int = 3, max_len: int = 20):
        self.stops = frozenset((T.STOP_WORDS if stop_words is True else stop_words) or ())
        self.numbers, self.least, self.most = numbers, min_len if short else 0, max_len

    def __call__(self, token: str) -> str:
        if not self.least <= len(token) <= self.most:
            return ""
        if not (token.isascii() and token.isalpha()):
            if not _LETTER.search(token):
                return ""
            if not _LATIN.match(token):
                raise Unsure
            if not token[0].isalpha() or self.numbers and _DIGIT.search(token):
                return ""
        word = token.lower()
        return "" if word in self.stops else word


def _value(scalar) -> str | None:
    """A text, None where it is null or not UTF-8, which the JVM mends."""
    try:
        return scalar.as_py()
    except UnicodeDecodeError:
        return None


def tokenised(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., tokens): ``text.tokens`` of each text."""
    own = docs.select(*keep, "text")
    schema = t.StructType([*own.schema.fields, t.StructField("_tokens", t.ArrayType(t.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        treebank = Treebank()
        for batch in batches:
            texts, start, lists, n = batch.column(batch.num_columns - 1), 0, [], 0
            for k in range(len(texts)):
                text = _value(texts[k])
                lists.append(None if text is None else treebank.tokens(text))
                n += len(lists[-1] or ())
                if n >= BATCH or k == len(texts) - 1:
                    part = batch.slice(start, len(lists))
                    left = texts.take(pa.array([start + j if x is None else None for j, x in enumerate(lists)], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], left, pa.array(lists, pa.list_(pa.string()))], names=[*batch.schema.names, "_tokens"])
                    start, lists, n = k + 1, [], 0

    found = own.mapInArrow(run, schema)
    return found.select(*keep, F.coalesce("_tokens", T.tokens(F.col("text"))).alias("tokens"))


class WordCounts:
    """Occurrences and documents of vocabulary words, summed over texts.

    Arrow splits texts at spaces and numbers their distinct pieces; only these are looked up one by one, and remembered as numbers of the
    words that the filters leave of them. A full stop before a capital letter is marked first.
    """

    def __init__(self, **filters):
        self.treebank, self.vocabulary = Treebank(), VocabularyWord(**filters)
        self._start()

    def _start(self) -> None:
        self.numbers: dict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.n, self.docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known, self.several, self.held = _Known(self), [], 0

    def taken(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words, their occurrences and documents; from here on they are counted anew."""
        out = list(self.numbers), self.n, self.docs
        self._start()
        return out

    def words(self, tokens) -> list[int]:
        """Numbers of the words among tokens."""
        return [self.numbers[w] for w in map(self.vocabulary, tokens) if w]

    def piece(self, piece: str, first: bool = False, last: bool = False, odd: bool = True) -> list[int]:
        marked = piece[-1:] == _MARK
        return self.words(self.treebank._at(piece[:-1] if marked else piece, first, last, marked, odd)[0])

    def _ends(self, text: str) -> tuple[str, list[int]]:
        """What lies between a text's first and last piece, and the words of these; all words, and no rest, where a text has the mark itself."""
        if _MARK in text:
            if (tokens := self.treebank.tokens(text)) is None:
                raise Unsure
            return "", self.words(tokens)
        for c in "\t\n\r\f":
            text = text.replace(c, " ")
        text = _BEFORE_CAPITAL.sub(rf".\1{_MARK} ", text.strip(" "))
        if _CHAIN.search(text):
            pieces, reached = text.split(" "), -2
            for k, p in enumerate(pieces):
                if p[-1:] == _MARK:
                    if reached == k - 1 and _INITIAL.match(p[:-1]):
                        pieces[k] = p[:-1]
                    elif self.treebank._at(p[:-1], k == 0, False, True, True)[1]:
                        reached = k
            text = " ".join(pieces)
        first, _, rest = text.partition(" ")
        middle, _, last = rest.rpartition(" ")
        if not last:
            return "", self.piece(first, True, True) if first else []
        return middle, self.piece(first, True) + self.piece(last, last=True)

    def _found(self, pieces: pa.Array) -> np.ndarray:
        """What ``_Known`` tells of distinct pieces within a text; those of one word alone are filtered together."""
        odd = pc.match_substring_regex(pieces, "|".join(_LISTED), ignore_case=True)
        plain = pc.and_not(pc.match_substring_regex(pieces, _PLAIN), odd)
        cut = pc.utf8_lower(pc.ascii_rtrim(pieces.filter(plain), f",:;?!.{_MARK}")).dictionary_encode()
        words, size = cut.dictionary, pc.utf8_length(cut.dictionary)
        kept = pc.and_(pc.greater_equal(size, self.vocabulary.least), pc.less_equal(size, self.vocabulary.most))
        kept = pc.and_not(pc.and_(kept, pc.match_substring_regex(words, "[a-z]")), pc.is_in(words, pa.array(sorted(self.vocabulary.stops), words.type))).to_numpy(zero_copy_only=False)
        numbers = np.full(len(words), _NONE)
        numbers[kept] = [*map(self.numbers.__getitem__, words.filter(pa.array(kept)).to_numpy(zero_copy_only=False))]
        for piece in pieces.filter(odd).to_pylist():
            if piece not in self.known:
                self.known.find(piece, True)
        plain, out = plain.to_numpy(zero_copy_only=False), np.empty(len(pieces), np.int64)
        out[plain] = numbers[cut.indices.to_numpy()]
        out[~plain] = [*map(self.known.__getitem__, pieces.filter(pa.array(~plain)).to_numpy(zero_copy_only=False))]
        return out

    def add(self, texts: list[str | None]) -> list[int]:
        """Counts texts; the places of those that were not counted."""
        if len(self.known) + self.held >= 5 * MOST:
            self._forget()
        middles, more, places, left = [], [], [], set()
        for k, text in enumerate(texts):
            middle, own = "", []
            try:
                if text is None:
                    raise Unsure
                middle, own = self._ends(text)
            except Unsure:
                left.add(k)
            middles.append(middle)
            more += own
            places += [k] * len(own)
        pieces = pc.split_pattern(pa.array(middles, pa.large_string()), " ")
        at, coded = pc.list_parent_indices(pieces).to_numpy(), pieces.flatten().dictionary_encode()
        ids = self._found(coded.dictionary)[coded.indices.to_numpy()]
        left.update(np.unique(at[ids == _UNSURE]).tolist())
        some = ids <= _SEVERAL
        for k, x in zip(at[some].tolist(), ids[some].tolist()):
            own = self.several[_SEVERAL - x]
            more += own
            places += [k] * len(own)
        one = ids >= 0
        ids, at = np.concatenate([ids[one], np.array(more, np.int64)]), np.concatenate([at[one], np.array(places, np.int64)])
        if left:
            counted = ~np.isin(at, list(left))
            ids, at = ids[counted], at[counted]
        size = len(self.numbers)
        keys = np.sort(at * size + ids)
        keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
        new = size - len(self.n)
        self.n = np.append(self.n, np.zeros(new, np.int64)) + np.bincount(ids, minlength=size)
        self.docs = np.append(self.docs, np.zeros(new, np.int64)) + np.bincount(keys % max(size, 1), minlength=size)
        return sorted(left)


class _Known(dict):
    """The word's number of each piece within a text, or what ``_NONE``, ``_UNSURE`` and ``_SEVERAL`` stand for."""

    def __init__(self, counts: WordCounts):
        self[""] = _NONE
        self.counts = counts

    def __missing__(self, piece: str) -> int:
        return self.find(piece, len(piece) > LONGEST)

    def find(self, piece: str, odd: bool) -> int:
        """``odd``: may have some of ``_WORDS``. Long pieces are not remembered."""
        counts = self.counts
        try:
            words = counts.piece(piece, odd=odd)
            found = _NONE if not words else words[0]
            if len(words) > 1:
                found = _SEVERAL - len(counts.several)
                counts.several.append(words)
                counts.held += len(words)
        except Unsure:
            found = _UNSURE
        if len(piece) <= LONGEST:
            self[piece] = found
        return found


def vocabulary_parts(docs: DataFrame, **filters) -> DataFrame:
    """(word, n_total, doc_freq, doc_id, text) of ``docs`` (doc_id, text, again): counts of vocabulary words by parts of the table.

    Rows without a word are documents that were not counted: those marked ``again``, and those of which Python isn't sure.
    """
    own = docs.select("doc_id", "text", "again")
    schema = t.StructType([t.StructField("word", t.StringType()), t.StructField("n_total", t.LongType()), t.StructField("doc_freq", t.LongType()), own.schema["doc_id"], own.schema["text"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts(**filters)

        def counted(kind, text_kind):
            words, n, df = counts.taken()
            seen = pa.array(n > 0)  # not so where all texts of a word are left
            columns = [pa.array(words, pa.string()), pa.array(n), pa.array(df), pa.nulls(len(n), kind), pa.nulls(len(n), text_kind)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names).filter(seen)

        kind = text_kind = None
        for batch in batches:
            ids, texts, again = batch.columns
            kind, text_kind, left, part, start, chars = ids.type, texts.type, [], [], 0, 0
            for k, later in enumerate(again.to_pylist()):
                part.append(None if later else _value(texts[k]))
                chars += len(part[-1] or "")
                if chars >= CHARS or k == len(texts) - 1:
                    left += [start + j for j in counts.add(part)]
                    part, start, chars = [], k + 1, 0
                if len(counts.numbers) >= 4 * MOST:
                    yield counted(kind, text_kind)
            if left:
                part = batch.take(pa.array(left))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(left), pa.string()), pa.nulls(len(left), pa.int64()), pa.nulls(len(left), pa.int64()), part.column(0), part.column(1)], names=schema.names)
        if counts.numbers:
            yield counted(kind, text_kind)

    return own.mapInArrow(run, schema)
