"""Token counters: how long a text is for a model, and its first n tokens."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class TokenCounter(Protocol):
    def count(self, text: Column) -> Column: ...

    def cut(self, text: Column, n: int) -> Column: ...


class SpaceTokens:
    """The default, an approximation within the JVM: pieces between single spaces. The empty text has none."""

    def count(self, text: Column) -> Column:
        return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))

    def cut(self, text: Column, n: int) -> Column:
        return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


class EncoderTokens:
    """Tokens of an encoder with ``encode(text) -> ids`` and ``decode(ids) -> text``, in Arrow batches. ``make`` builds it in each worker."""

    def __init__(self, make):
        self.make = make

    def count(self, text: Column) -> Column:
        make = self.make

        def lengths(batches):
            encoder = make()
            for texts in batches:
                yield pd.Series([len(encoder.encode(t)) if isinstance(t, str) else None for t in texts], dtype="Int32")

        return F.pandas_udf(lengths, "int", functionType=F.PandasUDFType.SCALAR_ITER)(text)

    def cut(self, text: Column, n: int) -> Column:
        make = self.make

        def firsts(batches):
            encoder = make()
            for texts in batches:
                yield pd.Series([encoder.decode(encoder.encode(t)[:n]) if isinstance(t, str) else None for t in texts], dtype=object)

        return F.pandas_udf(firsts, "string", functionType=F.PandasUDFType.SCALAR_ITER)(text)


def within_budget(rows: list[str], lengths: list[int], budget: int) -> list[str]:
    """The longest prefix whose tokens don't pass the budget."""
    used = pd.Series(lengths, dtype="int64").cumsum()
    return rows[: int((used <= budget).sum())]
