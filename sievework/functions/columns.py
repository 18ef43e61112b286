"""Column expressions shared by the operators. All but the embedding stay inside the JVM."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Unicode-aware whitespace.
SPACE = r"(?U)\s+"
#: The characters that it stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Whitespace at both ends. A run in the middle is looked at once: only its first blank is tried, and nothing is given back.
OUTER_SPACE = r"\A\s+|(?<!\s)\s++\z"


def words(text: Column) -> Column:
    """Whitespace-separated tokens without empties; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without whitespace of any kind at both ends."""
    return F.regexp_replace(text, f"(?U){OUTER_SPACE}", "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def content_hash(text: Column) -> Column:
    """md5 of the lower-cased text with single spaces."""
    return F.md5(F.array_join(words(F.lower(text)), " "))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.when(whole == 0, 0.0).otherwise(100.0 * part / whole), digits)


def rounded(x: Column, digits: int) -> Column:
    """As SQL over binary doubles: the product with the power of ten is rounded, half away from zero. Spark's own round takes the
    shortest decimal for the number, so it goes up at 0.2579875, whose double is below."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def one_decimal(x: Column) -> Column:
    """A number from 0 on with one decimal, as C and Python write it: the double's exact value decides, halves go to the even digit.
    `format_string` takes the shortest decimal for the number and halves up: 2.25 gives 2.3, and 0.35, whose double is below, 0.4."""
    part = x - F.floor(x)
    # both products are exact, so the sign of their sum is that of the distance to the half
    high = F.floor(part * 2**20) / 2**20
    tenth = F.floor(part * 10)
    over = (20 * high - (2 * tenth + 1)) + 20 * (part - high)
    tenth = tenth + F.when((over > 0) | ((over == 0) & (tenth % 2 == 1)), 1).otherwise(0)
    # a double of 2^53 or more is whole
    return F.when(x < 2.0**53, F.concat((F.floor(x) + F.when(tenth == 10, 1).otherwise(0)).cast("string"), F.lit("."), (tenth % 10).cast("string"))).otherwise(F.format_string("%.1f", x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column, steep: float = 8.0, middle: float = 0.35) -> Column:
    return 1 / (1 + F.exp(-steep * (x - middle)))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [0, 1]; 0 if a side is null, empty or zero."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, clamp(dot(a, b) / n, 0.0, 1.0)), F.lit(0.0))


def csv_items(text: Column) -> Column:
    """A comma-separated list as trimmed, non-blank items."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def years_of_experience(text: Column) -> Column:
    """The largest N of `N years` or `N+ yrs`; 0 if there is none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\d+(?:\.\d+)?)\s*\+?\s*(?:years|year|yrs|yr)\b"), 1)
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("double"))), F.lit(0.0))


def years_mentioned(text: Column) -> Column:
    """As years_of_experience, for numbers that `years` or `yrs` follow at once, whatever comes after."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\d+(?:\.\d+)?)\+?\s*(?:years?|yrs?)"), 1)
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.cast("double"))), F.lit(0.0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row, also where use() has lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Texts whose words are held at once.
TEXTS = 256


def _embedder(dims: int) -> Callable[[pa.Array], pa.Array]:
    token = re.compile(f"[^{WHITE}]+")

    def some(texts: pa.Array) -> np.ndarray:
        found = [[m[0] for m in itertools.islice(token.finditer(t), dims)] if t else [] for t in texts.to_pylist()]
        sizes = np.array([len(x) for x in found], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.zeros((len(texts), dims))
        if len(owner):
            flat = list(itertools.chain.from_iterable(found))
            points = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
            chars = np.array(list(map(len, flat)), np.int64)
            value = np.add.reduceat(points, np.cumsum(chars) - chars, dtype=np.int64) % 100 / 100.0
            length = np.sqrt(np.bincount(owner, value * value, len(texts)))
            out[owner, place] = value / np.where(length > 0, length, 1)[owner]
        return out

    def run(texts: pa.Array) -> pa.Array:
        out = np.empty((len(texts), dims))
        for start in range(0, len(texts), TEXTS):
            out[start : start + TEXTS] = some(texts.slice(start, TEXTS))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))

    return run


def hash_embedding(text: Column, dims: int = 768) -> Column:
    """Offline embedding: dimension i is the sum of code points of word i, lower-cased, mod 100, in hundredths; L2-normalised. Sums
    and lengths are those of `TEXTS` rows of an Arrow batch at once."""
    return F.arrow_udf(_embedder(dims), ArrayType(DoubleType()))(F.lower(text))
