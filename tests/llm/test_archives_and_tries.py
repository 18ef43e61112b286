"""Archives, prefix tries and fill-in-middle against plain versions."""

import gzip
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from sievework.llm import common, conversation_trie, fill_in_middle, warc  # noqa: E402


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clashing(df):
    names = ["id", "h", "sha", "key", "n", "m", "own", "file", "depth", "pos", "form", "output", "_text", "_cut", "leaves", "part"]
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})


# --- archives ---

PAGES = "page_id long, url string, html string"


def pages():
    rnd = random.Random(2)
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "<p>é"), (None, "http://n/", "<p>é"), (None, None, None), (4, "http://b/x y\r\nz", "same"), (9, "http://b/9", "same"), (9, "http://b/9", "same"), (9, "http://b/10", "same"), (5, "http://c/", "WARC/1.1\r\n\r\n\r\n" * 3), (6, "http://long/", "<td>\n" * 300_000)]
    rows += [(i, f"http://h/{i % 70}", rnd.choice(["hot", f"<html>{i}</html>", f"page {i % 9} ü"])) for i in range(10, 400)]
    return rows + rows[20:60] + [(700, "http://copies/", "copied")] * 2500


def records(index):
    number = lambda c: F.col(c).cast("long").alias(c)
    return warc.read(index).select(number("id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


@pytest.mark.parametrize("least", [0, 5])
def test_archives_read_back(spark, least, monkeypatch):
    monkeypatch.setattr(common, "FREQUENT", [1000, 5][least > 0])
    rows = pages()
    index = warc.write(clashing(spark.createDataFrame(rows, PAGES)), min_bytes=least)
    assert got(records(index)) == sorted(brute.archived(rows, least), key=repr)
    whole = warc.read(index.where("record_type = 'response'"))
    # duplicates are kept once if large enough, and every payload comes back
    assert {(r.id and int(r.id), r.payload) for r in whole.collect()} <= {(i, t or "") for i, _, t in rows}
    assert {r.payload for r in whole.select("payload").distinct().collect()} == {t or "" for _, _, t in rows}


def test_archives_of_an_empty_table(spark):
    assert got(records(warc.write(spark.createDataFrame([], PAGES)))) == []


def test_selected_records_are_read_by_ranges(spark):
    rows = [(i, f"http://h{i % 3}/{i}", f"<p>{i}</p>" * 50) for i in range(200)]
    index = common.settled(warc.write(spark.createDataFrame(rows, PAGES).coalesce(1)))
    some = warc.read(index.where("url LIKE 'http://h1/%'"))
    assert sorted((int(r.id), r.payload) for r in some.collect()) == [(i, t) for i, u, t in rows if "h1" in u]
    # a file is a sequence of gzip members: a warcinfo record first, then those of the index, back to back
    files = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("at")).collect()
    for f in files:
        raw = Path(f.file.removeprefix("file://")).read_bytes()
        assert gzip.decompress(raw[: f.at[0].offset]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert [a.offset + a.length for a in f.at] == [*[a.offset for a in f.at[1:]], len(raw)]
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == len(f.at) + 1


def test_neighbouring_ranges_are_one_request():
    gap, run = warc.GAP, warc.RUN
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + gap, 5), ("a", 21 + 2 * gap, 5), ("b", 0, run), ("b", run, 2 * run), ("b", 3 * run, 1)]
    assert [(f, a, b, len(m)) for f, a, b, m in warc.ranges(rows)] == [("a", 0, 20 + gap, 3), ("a", 21 + 2 * gap, 26 + 2 * gap, 1), ("b", 0, run, 1), ("b", run, 3 * run, 1), ("b", 3 * run, 3 * run + 1, 1)]


def test_a_changed_payload_is_an_error(spark):
    index = common.settled(warc.write(spark.createDataFrame([(1, "http://a/", "one two three")], PAGES)))
    row = index.first()
    path = Path(row.file.removeprefix("file://"))
    raw = bytearray(path.read_bytes())
    fields, block = warc.parsed(gzip.decompress(bytes(raw[row.offset :])))
    kept = [(k, v) for k, v in fields.items() if k not in ("WARC-Type", "Content-Length")]
    other = warc.member(warc.record("response", kept, block.replace(b"two", b"2wo")))
    path.write_bytes(bytes(raw[: row.offset]) + other)
    with pytest.raises(Exception, match="another payload"):
        warc.read(index.withColumn("length", F.lit(len(other)).cast("long"))).collect()


# --- prefix tries ---

TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed, n=300):
    rnd = random.Random(seed)
    rows = [(None, 0, "user", "lost"), (None, None, None, None), (2, 0, "user", "x"), (-7, 0, "user", "hi"), (-5, 0, None, "hi"), (-5, 1, "user", None), (4_000_000_003, 3, "a", "b")]
    for c in range(10, n):
        base = rnd.choice(["hot", "hot", "warm", str(c)])
        for t in range(rnd.choice([1, 2, 3, 8, 12])):
            rows.append((c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant"])[: 9 * (rnd.random() < 0.99)], f"{base} {t} é" if rnd.random() < 0.8 else None))
    rows += [(600, t, "user", f"long {t}") for t in range(2500)] + [(601, t, "user", f"long {t}" if t < 1900 else f"other {t}") for t in range(2100)]
    rnd.shuffle(rows)
    return rows + rows[5:25]


@pytest.mark.parametrize(("weight", "queue", "frequent"), [(10_000_000, 1 << 17, 1000), (1000, 50, 1000), (40, 3, 20)])
def test_trie(spark, monkeypatch, weight, queue, frequent):
    monkeypatch.setattr(conversation_trie, "LEAST_WEIGHT", weight)
    monkeypatch.setattr(conversation_trie, "BLOCK", 100)
    monkeypatch.setattr(conversation_trie, "CHUNK", 30)
    monkeypatch.setattr(common, "FREQUENT", frequent)
    rows = conversations(4)
    out = conversation_trie.trie(clashing(spark.createDataFrame(rows, TURNS)), queue=queue)
    assert got(out) == sorted(brute.trie(rows), key=repr)


def test_trie_of_an_empty_table(spark):
    assert got(conversation_trie.trie(spark.createDataFrame([], TURNS))) == []
    assert got(conversation_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS))) == []


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 100) if c % 5 and brute.zlib.crc32(str(c).encode()) % 9 >= 1)
    (row,) = conversation_trie.trie(spark.createDataFrame([(c, 0, "user", "gone")], TURNS)).collect()
    assert tuple(row) == (c, 0, None, 1, 0, 1, 0, brute.hashlib.sha256(str(c).encode()).hexdigest())


def test_queue_spills_in_order(tmp_path):
    rnd = random.Random(1)
    entries = [(rnd.randint(-5, 5), rnd.randint(-9, 9), rnd.randint(0, 3), k, 1) for k in range(500)]
    queue = conversation_trie.Queue(f"file://{tmp_path}", 7)
    for e in entries[:300]:
        queue.push(e)
    out = [queue.pop() for _ in range(50)]
    for e in entries[300:]:
        queue.push(e)
    while queue.head() is not None:
        assert queue.head() == (x := queue.pop())
        out.append(x)
    queue.close()
    assert out[:50] == sorted(entries[:300])[:50] and out[50:] == sorted([*sorted(entries[:300])[50:], *entries[300:]])
    assert not list(tmp_path.iterdir())


# --- fill-in-middle ---


def test_fill_in_middle(spark):
    rnd = random.Random(6)
    letters = ["a", "b", " ", "\n", "\t", "é", " ", " ", "漢", "😀", "<", "P>", "\x0b"]
    texts = [None, "", " ", "\n\n ", "one", " one", "one ", "x<P>y", "a <M> b", "<S", "w " * 120_000, "\n" * 1_000_000, "z" * 1_000_000] + ["".join(rnd.choices(letters, k=rnd.randint(1, 60))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[50], rows[50], (None, "null id here"), (None, None), (-4, "minus four")]
    out = fill_in_middle.transform(clashing(spark.createDataFrame(rows, "doc_id long, text string")))
    want = [(i, *brute.middle(i, t)) for i, t in rows]
    assert got(out) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = out.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")))
    assert got(back) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_skip_list_reaches_every_rank():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 64, 65, 1000):
        widths = rng.integers(1, 9, n)
        lanes = fill_in_middle.SkipList(widths)
        assert [lanes.reach(k) for k in range(n + 1)] == np.concatenate([[0], np.cumsum(widths)]).tolist()
