"""Text functions as column expressions: tokens, word filters, cuts and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the Penn Treebank word tokenizer, as (pattern, replacement) in order of use. A full stop is split off
# at the end of the text and before a capital letter. No look-around, so that other SQL engines can run them.
TREEBANK = [
    ('^"', "`` "),
    ('([ (\\[{<])"', "$1 `` "),
    ("([:,])([^0-9])", " $1 $2"),
    ("([:,])$", " $1 "),
    ("\\.\\.\\.", " ... "),
    ("[;@#$%&]", " $0 "),
    ("([^.])\\.([\\])}>\"']*)[ \\t\\n]+([A-Z])", "$1 . $2 $3"),
    ("([^.])\\.([\\])}>\"']*)[ \\t\\n]*$", "$1 . $2 "),
    ("[?!]", " $0 "),
    ("([^'])' ", "$1 ' "),
    ("[\\]\\[(){}<>]", " $0 "),
    ("--", " -- "),
    ("''", " '' "),
    ('"', " '' "),
    ("([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    ("(?i)\\b(can)(not)\\b", "$1 $2"),
    ("(?i)\\b(gon|wan)(na)\\b", "$1 $2"),
    ("(?i)\\b(got)(ta)\\b", "$1 $2"),
    ("(?i)\\b(lem|gim)(me)\\b", "$1 $2"),
    ("(?i)\\b(d)('ye)\\b", "$1 $2"),
    ("(?i)\\b(more)('n)\\b", "$1 $2"),
    ("(?i) ('t)(is|was)\\b", " $1 $2"),
]

# The English stop-word list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers "
    "herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll "
    "m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def tokens(text: Column) -> Column:
    """Words by the Treebank rules, within the JVM."""
    out = F.concat(F.lit(" "), F.regexp_replace(text, "[\\t\\n\\r\\f]", " "), F.lit(" "))
    for k, (pattern, replacement) in enumerate(TREEBANK):
        # the first rule and those on the text's end see it without the spaces around it
        out = F.regexp_replace(F.trim(out) if "$" in pattern[-1:] or k == 0 else out, pattern, replacement)
        if "$" in pattern[-1:] or k == 0:
            out = F.concat(F.lit(" "), out, F.lit(" "))
    return F.filter(F.split(out, " +"), lambda t: t != "")


def tokens_sql(text: str) -> str:
    """The same words in DuckDB's SQL."""
    out = f"' ' || regexp_replace({text}, '[\\t\\n\\r\\f]', ' ', 'g') || ' '"
    for k, (pattern, replacement) in enumerate(TREEBANK):
        quoted = [x.replace("'", "''") for x in (pattern, replacement.replace("$", "\\"))]
        if "$" in pattern[-1:] or k == 0:
            out = f"' ' || regexp_replace(trim({out}), '{quoted[0]}', '{quoted[1]}', 'g') || ' '"
        else:
            out = f"regexp_replace({out}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, ' +'), lambda t: t <> '')"


def is_vocabulary_word(word: Column, stop_words: bool | list[str] = True, numbers: bool = True, short: bool = True, punctuation: bool = True, min_len: int = 3, max_len: int = 20) -> Column:
    """Whether a token may enter the vocabulary: has a Latin letter, starts with a letter, and passes the filters that are on.

    ``stop_words`` is a switch or a list of its own. ``punctuation`` is kept for callers; the letter tests cover it either way.
    """
    ok = word.rlike("[a-zA-Z]") & word.rlike(r"^\p{L}") & (F.length(word) <= max_len)
    if stop_words:
        ok &= ~F.lower(word).isin(STOP_WORDS if stop_words is True else list(stop_words))
    if numbers:
        ok &= ~word.rlike(r"\p{Nd}")
    if short:
        ok &= F.length(word) >= min_len
    return ok


def first_words(text: Column, n: int = 100) -> Column:
    """The first n pieces between single spaces."""
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def chunks(text: Column, width: int) -> Column:
    """Pieces of ``width`` characters; the empty text has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)).cast("int"), F.lit(width))
    pieces = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(width)))
    return F.filter(pieces, lambda p: p != "")


def literal_chunks(text: Column, width: int) -> Column:
    """Pieces of ``width`` characters, and always the rest after the last whole one: an empty piece, or the text again where it is shorter."""
    whole = F.floor(F.length(text) / width).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda i: F.substring(text, i * width + 1, F.lit(width)))
    return F.concat(pieces, F.array(F.substring(text, whole * width + 1, F.lit(width))))


def split_long(text: Column, n_tokens: Column, most: int) -> Column:
    """The text alone, or its pieces of ``most`` characters where it has more than ``most`` tokens."""
    return F.when(n_tokens > most, chunks(text, most)).otherwise(F.array(text))


def first_integer(text: Column) -> Column:
    """The first integer in a model's reply, null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(-?\d+)", 1), F.lit("")).cast("int")
