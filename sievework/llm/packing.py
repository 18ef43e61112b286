"""Best-fit packing of documents into training sequences.

Method: conflict-constrained best-fit. Bins are kept in order of the room they have left, each with the bitmaps of the sources
and duplicate clusters in it. An item goes to the tightest bin that has room and no conflict: the search starts at the first bin
with room and steps to successors until one is compatible; without one a bin is opened. Items come longest first. Documents
longer than a bin give full pieces, which are bins of their own, and a rest that is packed like any item.

The corpus is dealt by a hash of the row into shards of about `shard_items` items, whatever its sources are, so no task grows
with the corpus or with a hot source. Only lengths and hashes are shuffled, no texts.

Results: rows without words (null or empty texts) take no room and aren't placed; repeated rows are separate items, which
conflict as copies; null sources never conflict. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def pack_shard(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; items in the order in which they are to be placed. Negative sources don't conflict."""
    room: list[tuple[int, int]] = []  # (what is left, bin), ordered
    held: list[tuple[int, int]] = []  # the bitmaps of sources and clusters by bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source) if source >= 0 else 0, 1 << cluster
        i = bisect_left(room, (size, -1))
        while i < len(room) and (held[room[i][1]][0] & s or held[room[i][1]][1] & c):
            i += 1
        if i < len(room):
            left, b = room.pop(i)
        else:
            left, b = capacity, len(held)
            held.append((0, 0))
        out.append((b, capacity - left))
        held[b] = (held[b][0] | s, held[b][1] | c)
        if left > size:
            insort(room, (left - size, b))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = 2048, shard_items: int = 4096, cluster_col: str | None = None) -> DataFrame:
    """id, piece, first_word, n_words, bin (`shard-number`; full pieces have one of their own), offset: one row per placed piece.

    Words are runs of non-whitespace. The cluster of a document is the value of `cluster_col`, as of a near-duplicate search, or where
    there is none a hash of its lower-cased words.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"\s+"), lambda w: w != "")
    copies = F.xxhash64("w") if cluster_col is None else F.coalesce(F.xxhash64("given"), F.xxhash64("w"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("w"), *([F.col(cluster_col).cast("string").alias("given")] if cluster_col else []))
    rows = rows.select("id", "source", copies.alias("cluster"), F.size("w").cast("long").alias("n"), F.xxhash64("id", "w").alias("h"))
    # a row number of its own tells even equal rows apart; written once, it stays what it is, and texts are split once
    rows = common.settled(rows.where("n > 0").withColumn("salt", F.monotonically_increasing_id()), "items")
    full = rows.where(F.col("n") >= capacity).select("id", "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / capacity) - 1)).alias("piece"))
    whole = full.select("id", "piece", (F.col("piece") * capacity).alias("first_word"), F.lit(capacity).cast("long").alias("n_words"), F.concat(F.lit("full-"), F.col("salt"), F.lit("-"), F.col("piece")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    rest = rows.select("id", "source", "cluster", "h", "salt", F.floor(F.col("n") / capacity).alias("piece"), (F.col("n") % capacity).alias("size")).where("size > 0")
    shards = max(1, -(-rest.count() // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("h", "salt"), F.lit(shards)).cast("long"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["size", "h", "id", "salt"], ascending=[False, True, True, True], kind="stable", na_position="last")
        sources, clusters = pd.factorize(items["source"])[0].tolist(), pd.factorize(items["cluster"])[0].tolist()
        placed = pack_shard(items["size"].tolist(), sources, clusters, capacity)
        name = f"{items['shard'].iloc[0]}-"
        return pd.DataFrame({"id": items["id"], "piece": items["piece"], "first_word": items["piece"] * capacity, "n_words": items["size"], "bin": [f"{name}{b}" for b, _ in placed], "offset": [o for _, o in placed]})

    packed = rest.groupBy("shard").applyInPandas(run, f"id {id_type}, piece long, first_word long, n_words long, bin string, offset long")
    return whole.unionByName(packed).withColumnRenamed("id", id_col)
