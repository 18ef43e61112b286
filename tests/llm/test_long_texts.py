"""Runs of a million separators: no operator's work grows with the square of a run."""

import re
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from sievework.llm import common, decontaminate, fill_in_middle, license_scan, ngram_join, packing, pii, secret_scan, suffix_dedup, toxicity, url_filter, warc  # noqa: E402

RUNS = [" ", "-", "\n", " \n", "=.", "a.", "@", "0", "+", "_-", "/", "\x0b\t", "é "]
LICENSE = "released under the mit license today"


@pytest.fixture(scope="module")
def rows():
    return [(k, f"alpha {LICENSE}{run * (1_000_000 // len(run))}omega end") for k, run in enumerate(RUNS)] + [(100, "alpha omega end")]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_words(spark, docs, rows):
    n = docs.select("doc_id", F.size(common.word_array(F.col("text"))).alias("n"))
    docs.count(), n.collect()
    began = time.time()
    got = dict(map(tuple, n.collect()))
    assert got == {i: len(brute.WORD.findall(brute.lower(t))) for i, t in rows}
    assert time.time() - began < 8  # 13 texts of a megabyte, some of them a million words


def test_words_beside_other_line_ends(spark):
    texts = ["abc   ", "  abc", "abc \u0085", "--", "", "a", "-a-", "a--b\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [list(r[0]) for r in df.select(common.word_array(F.col("t"))).collect()] == [brute.WORD.findall(t) for t in texts]


def _labels(spark, rows):
    return spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d, r: toxicity.score_documents(d, _labels(s, r)),
    "license_scan": lambda s, d, r: license_scan.scan(d)[0],
    "suffix_dedup": lambda s, d, r: suffix_dedup.remove_repeats(d),
    "ngram_join": lambda s, d, r: ngram_join.shingle_components(d),
    "url_filter": lambda s, d, r: url_filter.judge(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://org/"), "text").alias("url")), s.createDataFrame(url_filter.RULES, "verdict string, host string, path string")),
    "secret_scan": lambda s, d, r: secret_scan.scan(d),
    "decontaminate": lambda s, d, r: decontaminate.decontaminate(d, s.createDataFrame([(1, r[0][1])], "item_id long, text string")),
    "pii": lambda s, d, r: pii.find(d),
    "warc": lambda s, d, r: warc.read(warc.write(d, "doc_id", "text", "text")),
    "fill_in_middle": lambda s, d, r: fill_in_middle.transform(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_operator_ends_soon(spark, docs, rows, name):
    began = time.time()
    out = OPERATORS[name](spark, docs, rows)
    got = out.collect()
    assert len(got) == len(rows)
    assert time.time() - began < 120
    by = {int(r[0]): r for r in got}
    if name == "license_scan":
        assert all(by[i].base_labels == "mit" and by[i].n_words == len(brute.WORD.findall(brute.lower(t))) for i, t in rows[:-1])
    elif name == "decontaminate":
        assert all(by[i].n_words == len(brute.WORD.findall(brute.lower(t))) for i, t in rows)
    elif name == "warc":
        assert all(by[i].payload == t for i, t in rows)
    elif name == "fill_in_middle":
        assert all(tuple(by[i])[1:] == brute.middle(i, t) for i, t in rows)


def test_packing_places_every_word(spark, docs, rows):
    out = packing.pack(docs.withColumn("source", F.lit("s")))
    words = sum(len(re.findall(r"\S+", t, re.A)) for _, t in rows)
    assert out.agg(F.sum("n_words")).first()[0] == words
