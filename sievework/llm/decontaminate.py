"""Benchmark decontamination by winnowing, in DataFrame functions only.

A span of `window` words has window - k + 1 grams of k words. Of each such run of grams the least hash is kept, on both sides,
so texts that share a span share a kept hash. Documents with a kept hash of a benchmark item are candidates; in them, each
window is looked up among the items' windows, which extends a hit to all words of all shared windows. An item with fewer
words is one window of its own length.

The benchmark's hashes are broadcast only up to `BROADCAST_ROWS` rows, which are counted; beyond that the join shuffles.
Results: null, empty or word-less texts have no words and no hits; repeated rows get equal results; items without words
never occur; repeated items or item ids count once for each id. Empty tables give empty results or no hits. Extra columns
are kept out of the way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BROADCAST_ROWS = 1 << 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _grams(h: Column, n: int, seed: int) -> Column:
    """A hash of each n neighbours of an array of hashes."""
    from_to = F.sequence(F.lit(0), F.size(h) - n)
    return F.when(F.size(h) >= n, F.transform(from_to, lambda i: F.xxhash64(F.lit(seed), *(F.get(h, i + j) for j in range(n))))).otherwise(F.array().cast("array<bigint>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _kept(h: Column, window: int) -> Column:
    """The distinct winnowed gram hashes of an array of hashed words."""
    k = (window + 1) // 2
    span = window - k + 1

    def least(g: Column) -> Column:
        if span == 1:
            return F.array_distinct(g)
        places = F.sequence(F.lit(0), F.size(g) - span)
        return F.when(F.size(g) >= span, F.array_distinct(F.transform(places, lambda i: F.least(*(F.get(g, i + j) for j in range(span)))))).otherwise(F.array().cast("array<bigint>"))

    return _let(_grams(h, k, window), least)


def _windows(h: Column, window: int) -> Column:
    """Two hashes of each window, its width and its start, in order."""
    both = F.arrays_zip(_grams(h, window, -window).alias("one"), _grams(h, window, -100 - window).alias("two"))
    return F.transform(both, lambda w, i: F.struct(F.lit(window).alias("width"), i.alias("start"), w["one"].alias("one"), w["two"].alias("two")))


def _every(words: Column, widths: list[int], of: Callable[[Column, int], Column]) -> Column:
    """of() for all widths, from words that are hashed once."""
    return _let(_hashes(words), lambda h: of(h, widths[0]) if len(widths) == 1 else F.concat(*(of(h, w) for w in widths)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contaminated_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The windows of documents that occur in items, and the items' windows; None without items. docs: _id, _h, _text; items: item, words,
    width. All documents are tokenised once for all widths, candidates once more."""
    items = common.settled(items, "items")
    widths = sorted(w for (w,) in items.select("width").distinct().collect())  # `window` values at most
    if not widths:
        return None
    of_width = lambda f: F.coalesce(*(F.when(F.col("width") == w, _every(F.col("words"), [w], f)) for w in widths))
    kept = common.settled(items.select(F.explode(of_width(_kept)).alias("gram")).distinct(), "grams")
    ours = common.settled(items.select("item", F.explode(of_width(_windows)).alias("w")).select("item", "w.width", "w.one", "w.two").distinct(), "windows")
    texts = docs.select("_id", "_h", common.word_array(F.col("_text")).alias("words"))
    found = texts.select("_id", "_h", F.explode(_every(F.col("words"), widths, _kept)).alias("gram")).join(_small(kept), "gram", "left_semi")
    found = common.settled(found.select(F.col("_id").alias("c_id"), F.col("_h").alias("c_h")).distinct(), "candidates")
    held = docs.join(_small(found), (F.col("_h") == F.col("c_h")) & F.col("_id").eqNullSafe(F.col("c_id")), "left_semi")
    every = held.select("_id", "_h", F.explode(_every(common.word_array(F.col("_text")), widths, _windows)).alias("w")).select("_id", "_h", "w.*")
    hits = every.join(_small(ours.select("width", "one", "two").distinct()), ["width", "one", "two"], "left_semi")
    return common.settled(hits.distinct(), "hits"), ours


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows without a shared window, all columns as they are."""
    found = contaminated_windows(common.keyed(docs, id_col, text_col), _items(benchmark, item_col, item_text_col, window))
    if found is None:
        return docs
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    hits = _small(common.settled(found[0].select(F.col("_id").alias("__sw_k"), F.col("_h").alias("__sw_h")).distinct(), "hits"))
    return docs.join(hits, (key == F.col("__sw_h")) & F.col(id_col).eqNullSafe(F.col("__sw_k")), "left_anti")


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), common.word_array(F.col(item_text_col).cast("string")).alias("words"))
    return items.where(F.size("words") > 0).withColumn("width", F.least(F.lit(window), F.size("words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """id, n_words, n_hit (words within a shared window), n_items, items (sorted strings), contaminated, for every row."""
    keyed = common.keyed(docs, id_col, text_col)
    items = _items(benchmark, item_col, item_text_col, window)
    base = keyed.select("_id", "_h", F.size(common.word_array(F.col("_text"))).cast("long").alias("n_words"))
    found = contaminated_windows(keyed, items)
    if found is None:
        return base.select(F.col("_id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    places, ours = found
    names = places.select("_id", "_h", "width", "one", "two").distinct().join(_small(ours), ["width", "one", "two"]).select("_id", "_h", "item").distinct()
    covered = F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)))
    hit = places.groupBy("_id", "_h").agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    named = names.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    other = hit.join(named, (hit["_h"] == named["_h"]) & hit["_id"].eqNullSafe(named["_id"]), "left").select(hit["_id"].alias("o_id"), hit["_h"].alias("o_h"), "n_hit", "items")
    out = base.join(other, (F.col("_h") == F.col("o_h")) & F.col("_id").eqNullSafe(F.col("o_id")), "left")
    names_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names_or_none).cast("long").alias("n_items"), names_or_none.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
