"""Fill-in-middle transformation of whole texts.

Method: an indexable skip list over the units of a text. Its lowest lane has the units, each express lane above skips FAN links of
the lane below; every link carries its width in units and in code points. A cut rank is reached by descending from the top lane,
going forward while the accumulated unit width stays within the rank: the code-point widths of the links taken add up to the exact
place of the cut. Units are runs of blanks with the word behind them, and blanks at the end, so they cover the text.

Ranks, form and order of the parts come from a hash of the seed and the id, so they depend on nothing else. Only the widths are
computed in Python, by Arrow batch; texts are cut and joined by Spark's own functions, and nothing is shuffled.

Results: null texts count as empty, and empty texts are plain; texts that hold a marker are plain, so that others can be rebuilt by
their markers. A null id counts as the empty string in the hash. Repeated rows give repeated results, an empty table an empty one.
Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Links that a link of the next lane skips.
FAN = 8
#: Bytes of text whose units are found at once.
SLICE = 4 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class SkipList:
    """Lanes of links over units of given code-point widths."""

    def __init__(self, widths: np.ndarray) -> None:
        self.lanes = [(np.ones(len(widths), np.int64), widths)]
        while len(self.lanes[-1][0]) > FAN:
            at = np.arange(0, len(self.lanes[-1][0]), FAN)
            self.lanes.append(tuple(np.add.reduceat(w, at) for w in self.lanes[-1]))

    def reach(self, rank: int) -> int:
        """Code points in front of the unit with this rank."""
        units = points = link = 0
        for unit_width, point_width in reversed(self.lanes):
            while link < len(unit_width) and units + unit_width[link] <= rank:
                units += int(unit_width[link])
                points += int(point_width[link])
                link += 1
            link *= FAN
        return points


def unit_widths(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts as one run of UTF-8 bytes: the code points of every unit, and where the units of each text start (one entry more)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    blank = _BLANK[raw]
    ends = ~blank
    ends[:-1] &= blank[1:]
    full = at[1:] > at[:-1]
    ends[at[1:][full] - 1] = True
    stops = np.flatnonzero(ends) + 1
    widths = np.add.reduceat((raw & 0xC0) != 0x80, np.concatenate([[0], stops[:-1]]), dtype=np.int64)
    return widths, np.searchsorted(stops, at, "right")


@F.arrow_udf(StructType([StructField(c, LongType()) for c in ("n", "low", "high")]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([text, h1, h2], ["text", "h1", "h2"])
    n, low, high = [], [], []
    for part in common.slices(batch, "text", SLICE):
        widths, first = unit_widths(*common.text_buffer(part.column("text")))
        for a, b, x, y in zip(first[:-1].tolist(), first[1:].tolist(), part.column("h1").to_pylist(), part.column("h2").to_pylist(), strict=True):
            units = b - a
            lanes = SkipList(widths[a:b])
            one, two = x % (units + 1), y % (units + 1)
            n.append(units)
            low.append(lanes.reach(min(one, two)))
            high.append(lanes.reach(max(one, two)))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, low, high)], ["n", "low", "high"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, the transformed text.

    `fim_percent` of the texts that may be are transformed, `spm_percent` of these with the suffix first.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col), text.alias("_text"), digest.alias("_digest"))
    h1, h2, h3, h4 = (F.conv(F.substring("_digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_text", F.lit(m))
    plain = (F.col("_text") == "") | (h3 % 100 >= fim_percent) | marked
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select(id_col, "_text", form.alias("form"), _cuts("_text", h1, h2).alias("_cut"))
    low, high = F.col("_cut.low").cast("int"), F.col("_cut.high").cast("int")
    part = {"p": F.substr("_text", F.lit(1), low), "m": F.substr("_text", low + 1, high - low), "s": F.substr("_text", high + 1)}
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), part["p"], F.lit(SUFFIX), part["s"], F.lit(MIDDLE), part["m"])).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), part["s"], F.lit(PREFIX), part["p"], F.lit(MIDDLE), part["m"])).otherwise(F.col("_text"))
    cut = F.col("form") != "plain"
    return rows.select(id_col, F.col("_cut.n").alias("n"), "form", F.when(cut, F.col("_cut.low")).alias("prefix_chars"), F.when(cut, F.col("_cut.high") - F.col("_cut.low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that transform() was given, from its output and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # nothing stands in front of the first marker
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
