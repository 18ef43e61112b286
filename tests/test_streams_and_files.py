"""A stream that has seen all rows equals its batch twin; files come back as they went."""

import pytest
from pyspark.sql import functions as F

from sievework.sources import files, keyed
from sievework.streaming import state, streams


@pytest.fixture()
def events(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 700).alias("ts"), (F.col("id") % 7).alias("user_id"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("stage"))
    path = str(tmp_path / "events")
    df.coalesce(1).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path), tmp_path


def finished(df, tmp_path, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_windows(events):
    batch, stream, tmp = events
    same(finished(streams.stage_windows(stream, "ts", "stage"), tmp, "complete", "w"), streams.stage_windows(batch, "ts", "stage"))


def stamped(spark, rows, names):
    """rows with seconds as their second value."""
    return spark.createDataFrame(rows, f"{names[0]} long, s long, {names[1]} string, event_id long").select(names[0], F.timestamp_seconds("s").alias("ts"), names[1], "event_id")


def appended(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def collected(stream, tmp, mode, out):
    """Runs a stream to the end of its input, from its checkpoint if it has one; rows go to `out`."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp / "checkpoint")).trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_first_uploads_in_any_order_and_after_a_restart(spark, tmp_path):
    state.with_rocksdb(spark)
    path, out = str(tmp_path / "uploads"), []
    first = [(1, 5000, "a", 7), (1, 4000, "a", 9), (2, 4000, "b", 3), (2, 4000, "b", 2), (1, 6000, "a", 1)]
    appended(stamped(spark, first, ("owner", "h")), path)
    stream = lambda: streams.ingest_dedup(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), ["owner", "h"], "ts", ["event_id"], "1 hour", "2 hours").select("owner", "h", "event_id")
    collected(stream(), tmp_path, "append", out)
    assert out == []  # the watermark hasn't passed any of them
    # earlier rows of the same keys within the watermark, and a later row that moves it
    second = [(1, 3500, "a", 20), (3, 3000, "c", 5), (9, 12_000, "x", 0)]
    appended(stamped(spark, second, ("owner", "h")), path)
    collected(stream(), tmp_path, "append", out)
    assert sorted(out) == [(1, "a", 20), (2, "b", 2), (3, "c", 5)]
    # further uploads are dropped, late ones too; a key is new again once it was forgotten
    appended(stamped(spark, [(2, 9000, "b", 30), (1, 1, "a", 31), (9, 40_000, "x", 1)], ("owner", "h")), path)
    collected(stream(), tmp_path, "append", out)
    appended(stamped(spark, [(2, 50_000, "b", 40), (9, 90_000, "x", 2)], ("owner", "h")), path)
    collected(stream(), tmp_path, "append", out)
    assert sorted(out) == [(1, "a", 20), (2, "b", 2), (2, "b", 40), (3, "c", 5), (9, "x", 0)]
    batch = streams.ingest_dedup(stamped(spark, [*first, *second], ("owner", "h")), ["owner", "h"], "ts", ["event_id"])
    assert sorted(map(tuple, batch.select("owner", "h", "event_id").collect())) == [(1, "a", 20), (2, "b", 2), (3, "c", 5), (9, "x", 0)]


def test_first_uploads_equal_the_batch(events):
    batch, stream, tmp = events
    state.with_rocksdb(batch.sparkSession)
    out = []
    closing = batch.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(10**9)).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("stage"))
    appended(closing, str(tmp / "events"))
    collected(streams.ingest_dedup(stream, ["user_id", "stage"], "ts", ["event_id"], "10 days"), tmp, "append", out)
    batch = batch.where("event_id > 0")  # Spark takes the epoch itself for late
    assert sorted(out) == sorted(map(tuple, streams.ingest_dedup(batch, ["user_id", "stage"], "ts", ["event_id"]).collect()))


def test_latest_stage_with_expiry_and_restart(spark, tmp_path):
    state.with_rocksdb(spark)
    path = str(tmp_path / "stages")
    table = keyed.KeyedTable(spark, str(tmp_path / "table"), "user long, ts timestamp, stage string, closed boolean", ["user"], 3)
    rows = [(1, 100, "applied", 0), (1, 300, "hired", 0), (1, 200, "screened", 0), (2, 100, "a", 0), (2, 100, "b", 0)]

    def run(more):
        appended(stamped(spark, more, ("user", "stage")), path)
        stream = streams.latest_stage(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), "user", "ts", "stage", "1 hour", "2 hours")
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).foreachBatch(table.sink(F.struct("ts", "stage", "closed"))).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return sorted((r.user, r.stage, r.closed) for r in table.read().collect())

    assert run(rows) == [(1, "hired", False), (2, "b", False)]
    # an older stage changes nothing, a newer one does, also after a restart
    assert run([(1, 250, "late", 0), (2, 400, "c", 0)]) == [(1, "hired", False), (2, "c", False)]
    assert run([(3, 20_000, "new", 0)]) == [(1, "hired", True), (2, "c", True), (3, "new", False)]
    # what is older than the watermark is dropped; a forgotten key begins anew
    assert run([(2, 300, "dropped", 0), (1, 21_000, "again", 0)]) == [(1, "again", False), (2, "c", True), (3, "new", False)]
    batch = streams.latest_stage(stamped(spark, rows, ("user", "stage")), "user", "ts", "stage")
    assert sorted((r.user, r.stage) for r in batch.collect()) == [(1, "hired"), (2, "b")]


# --- tables that are changed by merges ---


def keyed_table(spark, tmp_path, buckets=4):
    return keyed.KeyedTable(spark, str(tmp_path / "table"), "k long, v string, n long", ["k"], buckets)


def test_merges_touch_only_their_buckets(spark, tmp_path):
    t = keyed_table(spark, tmp_path, 16)
    assert t.read().count() == 0 and t.versions() == []
    t.merge(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.col("id").alias("n")))
    before = t.commit()["buckets"]
    t.merge(spark.createDataFrame([(5, "new", 1), (5, "newer", 2), (1000, "more", 3), (None, "null", 4)], "k long, v string, n long"), F.col("n"))
    after = t.commit()["buckets"]
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 3
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 102 and got[5] == "newer" and got[1000] == "more" and got[None] == "null" and got[6] == "old"
    # versions stay what they were until they are forgotten
    assert {r.k: r.v for r in t.read(1).collect()}[5] == "old"
    t.merge(spark.createDataFrame([(None, "again")], "k long, v string"))
    assert {r.k: (r.v, r.n) for r in t.read().collect()}[None] == ("again", 4)
    kept = sorted(map(tuple, t.read().collect()), key=repr)
    gone = t.vacuum()
    assert t.versions() == [3] and gone == 0 or sorted(map(tuple, t.read().collect()), key=repr) == kept


def test_repeated_and_broken_batches_change_nothing(spark, tmp_path, monkeypatch):
    t = keyed_table(spark, tmp_path)
    rows = lambda v: spark.createDataFrame([(k, v, k) for k in range(10)], "k long, v string, n long")
    assert t.merge(rows("a"), writer="w", number=0) and t.merge(rows("b"), writer="w", number=1)
    assert not t.merge(rows("c"), writer="w", number=1) and not t.merge(rows("c"), writer="w", number=0)
    assert t.merge(rows("b"), writer="other", number=0)
    monkeypatch.setattr(keyed.KeyedTable, "_publish", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        t.merge(rows("broken"), writer="w", number=2)
    monkeypatch.undo()
    assert {r.v for r in t.read().collect()} == {"b"} and t.commit()["batches"] == {"w": 1, "other": 0}
    assert t.merge(rows("d"), writer="w", number=2)
    assert {r.v for r in t.read().collect()} == {"d"} and t.vacuum() >= 3 and {r.v for r in t.read().collect()} == {"d"}


def test_of_two_writers_one_must_try_again(spark, tmp_path):
    t, u = keyed_table(spark, tmp_path), keyed_table(spark, tmp_path)
    rows = spark.createDataFrame([(1, "a", 1)], "k long, v string, n long")
    t.merge(rows)
    stale = u.commit()
    t.merge(rows)
    u.commit = lambda version=None: stale
    with pytest.raises(keyed.Conflict):
        u.merge(rows)
    assert t.read().count() == 1


def test_merges_resolve_columns(spark, tmp_path):
    t = keyed_table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, n long"))
    t.merge(spark.createDataFrame([(1, None, 5), (3, "c", 7)], "k long, v string, n long"), resolve={"v": lambda old, new: F.coalesce(new, old), "n": lambda old, new: old + new}, matched_only=True)
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", 6), (2, "b", 2)]
    t.merge(spark.createDataFrame([], "k long, v string, n long"))
    assert t.read().count() == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, 'q"x'), (3, None)], "a int, b string")
    path = str(tmp_path / "x.csv")
    df.coalesce(1).write.options(header=True, escape='"').csv(path)
    same(files.load(spark, path, "a int, b string"), df)
    (tmp_path / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "utf.txt").write_bytes("caf\xe9".encode())
    assert sorted((r.text, r.encoding) for r in files.texts(spark, str(tmp_path / "*.txt")).collect()) == [("caf\xe9", "latin-1"), ("caf\xe9", "utf-8")]
    for bad in ("x.pdf", "none.csv"):
        with pytest.raises(files.SourceError):
            files.guard(spark, str(tmp_path / bad))


def test_a_source_with_files_in_two_encodings(spark, tmp_path):
    folder = tmp_path / "mixed.tsv"
    folder.mkdir()
    (folder / "a.tsv").write_bytes("k\tv\n1\tcafé, noir\n".encode())
    (folder / "b.tsv").write_bytes("k\tv\n2,thé\n".encode("latin-1"))
    (folder / "c.tsv").write_bytes(b"k\tv\n3\tplain\n")
    back, warning = files.load_any_encoding(spark, str(folder), "k string, v string")
    assert sorted(map(tuple, back.collect())) == [("1", "café, noir"), ("2", "thé"), ("3", "plain")] and warning == "read as latin-1"
    (folder / "b.tsv").unlink()
    assert files.load_any_encoding(spark, str(folder), "k string, v string")[1] is None


def test_tables_over_jdbc_are_read_in_parts(spark):
    url, driver = "jdbc:derby:memory:sieve;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    orders = spark.range(100).select(F.col("id").cast("int").alias("K"), (F.col("id") * 2).cast("int").alias("V"))
    for name, df in (("ORDERS", orders), ("NOTHING", orders.limit(0)), ("SMALL", orders.limit(3))):
        df.coalesce(1).write.format("jdbc").options(url=url, dbtable=name, driver=driver).mode("overwrite").save()
    got = files.relational_jdbc(spark, url, {"ORDERS": "K", "NOTHING": "K", "SMALL": None}, 5, driver=driver)
    assert got["ORDERS"].rdd.getNumPartitions() == 5 and got["SMALL"].rdd.getNumPartitions() == 1 and got["NOTHING"].count() == 0
    same(got["ORDERS"], orders)
    with pytest.raises(files.SourceError, match="ABSENT"):
        files.relational_jdbc(spark, url, {"ORDERS": "K", "ABSENT": None}, driver=driver)


def test_texts_of_named_files_are_those_of_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TOGETHER", 10)
    folder = f"file://{tmp_path}/texts"
    contents = [(1, "caf\xe9".encode()), (2, "caf\xe9".encode("latin-1")), (3, b""), (4, b"longer than ten bytes"), (5, b"\r\n x\n")]
    written = spark.createDataFrame(contents, "doc_id long, content binary").coalesce(1).mapInPandas(files.file_writer(folder), "doc_id long, path string").localCheckpoint()
    assert sorted((r.doc_id, r.path) for r in written.collect()) == [(i, f"{folder}/{i}.txt") for i in range(1, 6)]
    both = [sorted((r.path.rsplit("/", 1)[1], r.text, r.encoding) for r in x.collect()) for x in (files.texts_of(written), files.texts(spark, folder + "/*.txt"))]
    # Spark's reader leaves empty files out
    assert both[0] == sorted([*both[1], ("3.txt", "", "utf-8")]) and len(both[0]) == 5
