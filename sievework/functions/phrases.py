"""Phrases of a dictionary in texts: one pass over each text, whatever the size of the dictionary."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Texts that are held as strings at once.
TEXTS = 256


def _is_word(c: str) -> bool:
    """A word character of Unicode: letters, digits, marks, connectors and joiners."""
    return c.isalnum() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc", "Nl") or c in "‌‍"


def _automaton(phrases: list[str]):
    """Aho-Corasick over the phrases; each has its number, and whether a word boundary before and behind it has a word character inside."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        a.add_word(p, (k, len(p), _is_word(p[0]), _is_word(p[-1])))
    a.make_automaton()
    return a


def _finder(phrases: list[str]) -> Callable[[pa.Array], pa.Array]:
    def some(automaton, texts: pa.Array) -> pa.Array:
        held, whole = [], []
        for t in texts.to_pylist():
            near, full = set(), set()
            for end, (k, size, before, behind) in automaton.iter(t) if t else ():
                near.add(k)
                if k not in full:
                    start = end + 1 - size
                    left = _is_word(t[start - 1]) if start else False
                    right = _is_word(t[end + 1]) if end + 1 < len(t) else False
                    if left != before and right != behind:
                        full.add(k)
            held.append(sorted(near))
            whole.append(sorted(full))
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(held, kind), pa.array(whole, kind)], ["held", "whole"])

    def run(texts: pa.Array) -> pa.Array:
        automaton = _automaton(phrases)
        return pa.concat_arrays([some(automaton, texts.slice(start, TEXTS)) for start in range(0, max(1, len(texts)), TEXTS)])

    return run


def found(text: Column, phrases: list[str]) -> Column:
    """A struct of two sorted arrays of numbers: `held`, the phrases that stand anywhere in the text, and `whole`, those that stand
    between word boundaries. Texts are taken as they are; phrases are distinct and not empty; null texts hold nothing.

    The automaton is built once for each batch, in the task; its size is that of the dictionary, which travels with the function. Of a
    batch, `TEXTS` texts are Python strings at once.
    """
    if not phrases:
        none = F.array().cast("array<int>")
        return F.struct(none.alias("held"), none.alias("whole"))

    return F.arrow_udf(_finder(phrases), StructType([StructField(c, ArrayType(IntegerType())) for c in ("held", "whole")]))(text)
