"""Every operator against a plain version, with nulls, empties, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from sievework.llm import common, decontaminate, embedding_dedup, license_scan, ngram_join, packing, pii, secret_scan, suffix_dedup, toxicity, url_filter  # noqa: E402

DOC = "doc_id long, text string"
#: Columns that operators use inside; as extra columns they must not disturb.
CLASH = ["_id", "_h", "_text", "id", "n", "digest", "key", "words", "score", "start"]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["ab", "ça", "the", "of", "q", "zz", "ñandu", "longword", "É"]
    make = lambda k: " ".join(rnd.choice(vocabulary) + str(rnd.randint(0, 60)) for _ in range(k))
    passages = [make(25) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "a" * 130), (4, "xyz" * 50)]
    for i in range(5, n):
        t = make(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            t = t[: len(t) // 2] + rnd.choice(passages)[rnd.randint(0, 30) :] + t[len(t) // 2 :]
        rows.append((i, t))
    return rows + [rows[10], rows[20], (None, rows[30][1]), (None, None), (500, rows[40][1]), (501, rows[40][1][7:])]


def test_repeated_windows(spark):
    rows = corpus(5)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute.repeats([r[1] for r in rows], 40), strict=True)), key=repr)
    assert got(suffix_dedup.remove_repeats(clashing(spark.createDataFrame(rows, DOC)), threshold=40)) == want


def test_repeated_windows_in_one_long_text(spark):
    rows = [(1, "".join(random.Random(1).choice("abcdef") for _ in range(3000)) + "0123456789" * 300), (2, "0123456789" * 5)]
    want = sorted(((r[0], *b) for r, b in zip(rows, brute.repeats([r[1] for r in rows], 40), strict=True)), key=repr)
    assert got(suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC), threshold=40)) == want


def test_repeated_windows_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    monkeypatch.setattr(common, "FREQUENT", 3)
    rnd, line = random.Random(8), "the same passage of some length stands in many documents, "
    rows = [(i, "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30))) + line + str(rnd.randint(0, 9)) * rnd.randint(0, 40)) for i in range(60)] + corpus(6, 60)
    want = sorted(((r[0], *b) for r, b in zip(rows, brute.repeats([r[1] for r in rows], 40), strict=True)), key=repr)
    assert got(suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC), threshold=40)) == want


def near_copies(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    bases = [[rnd.choice(words) for _ in range(rnd.choice([25, 40, 80, 150]))] for _ in range(8)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "x"), (6, "The End Now"), (7, "the end now")]
    for i in range(8, 300):
        b = list(rnd.choice(bases[:1] if i % 3 == 0 else bases))
        for _ in range(rnd.randint(0, 4)):
            b[rnd.randrange(len(b))] = f"n{rnd.randint(0, 3000)}"
        rows.append((i, " ".join(b)))
    return rows + [rows[20], rows[21], (None, None)]


@pytest.mark.parametrize("seed", [0, 1])
def test_shingle_components(spark, seed, monkeypatch):
    monkeypatch.setattr(common, "FREQUENT", [1000, 10][seed])
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", [1000, 20][seed])
    monkeypatch.setattr(ngram_join, "FAN", [32, 2][seed])
    rows = near_copies(seed)
    out = ngram_join.shingle_components(clashing(spark.createDataFrame(rows, DOC)))
    assert got(out.select("doc_id", "n_shingles", "component_id")) == sorted(brute.shingle_components(rows)[0], key=repr)


def test_one_document_of_each_component_stays(spark):
    rows = near_copies(2)
    df = clashing(spark.createDataFrame(rows, DOC))
    out = ngram_join.one_per_component(df, words=5, threshold=(8, 10))
    full, roots = brute.shingle_components(rows, 5, 8, 10)
    assert out.columns == df.columns
    assert out.count() == len({r for r, (_, n, _) in zip(roots, full, strict=True) if n}) + sum(n == 0 for _, n, _ in full)
    kept = [r.doc_id for r in out.collect()]
    assert {c for _, n, c in full if n} <= set(kept)


@pytest.mark.parametrize("window", [10, 4])
def test_decontamination(spark, window):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)] + ["É", "ñu", "Ab"]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, make(rnd.choice([3, 6, 9, 10, 11, 15, 40]))) for i in range(30)] + [(99, ""), (98, None), (5, make(12))]
    docs = [(1, None), (2, ""), (3, "..."), (4, "w1, w2! W3")]
    for i in range(5, 100):
        t = make(rnd.randint(0, 60)).split()
        for _ in range(rnd.randint(0, 2)):
            s = (rnd.choice(items)[1] or "").split()[rnd.randint(0, 3) :]
            k = rnd.randint(0, len(t))
            t[k:k] = s[: rnd.randint(3, 30)]
        docs.append((i, rnd.choice([" ", ". ", "\n"]).join(t)))
    docs += [docs[10], (None, docs[11][1]), (10, "other")]
    d, b = clashing(spark.createDataFrame(docs, DOC)), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(d, b, window=window)
    want = brute.contaminated(docs, items, window)
    assert got(out.select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated")) == sorted(want, key=repr)
    assert decontaminate.keep_clean(d, b, window=window).count() == sum(not w[-1] for w in want)


def test_license_scan(spark):
    rows = [(1, None), (2, ""), (3, "a\nReleased under the MIT License.\nmit license mit license"), (4, "Licensed under CC BY-NC 4.0."), (5, "x GNU general   public-license, APACHE LICENSE"), (6, "This work is licensed under the Gnu public license version 3 general"), (6, "This work is licensed under the Gnu public license version 3 general"), (None, "cc\nby")]
    out = {r[0]: r for r in license_scan.scan(clashing(spark.createDataFrame(rows, DOC)))[0].collect()}
    assert tuple(out[3])[1:7] == (10, 3, 4, 8, "mit", "mit")
    assert out[4].labels == "cc-by,cc-by-nc" and out[4].base_labels == "cc-by"
    assert tuple(out[5])[1:6] == (7, 2, 1, 5, "apache,gpl")
    assert out[6].base_labels == "" and out[6].labels == "gpl" and out[6].score == 1.0
    assert tuple(out[1])[1:] == (0, 0, None, None, "", "", 0.0) and out[None].base_labels == "cc-by"


def test_license_sentences_across_lines(spark):
    filler = " ".join(f"w{i}" for i in range(45))
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal"
    gpl = "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public\r\n\r\nLicense as published by the Free Software Foundation"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    rows = [(i * 3 + j, pre + t) for i, t in enumerate((mit, gpl, bsd)) for j, pre in enumerate(("", filler + "\n", f"{filler} {filler}\n{filler} a b c\n"))]
    far = mit.replace("copy\n", f"copy\n{filler} {filler} {filler}\n")
    out = {r.doc_id: r for r in license_scan.scan(clashing(spark.createDataFrame([*rows, (90, far)], DOC)))[0].collect()}
    assert all(out[j].labels == "mit" and out[6 + j].labels == "bsd" and "gpl" in out[3 + j].labels.split(",") and out[3 + j].score == 1.0 for j in range(3))
    assert out[90].labels == "" and out[90].score == 0.0


def test_scattered_words_are_no_license(spark):
    rows = [(1, "under the tree the mit students released a new car without any license plate"), (2, "version control of the apache helicopter, 2 licensed pilots under license 0"), (3, "x y released, under the MIT -- license z"), (4, "a licensed under (the) apache license ver 2.0 b")]
    out = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, DOC))[0].collect()}
    assert out[1] == out[2] == ("", 0.0) and out[3] == ("mit", 1.0) and out[4][0] == "apache"


def test_license_scan_equals_a_plain_one(spark):
    rnd = random.Random(14)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in brute.WORD.findall(brute.lower(t))})
    rows = [(1, None), (2, "")]
    for i in range(3, 160):
        parts = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            t = rnd.choice([t for _, t in license_scan.TEMPLATES] + [p for p, _ in license_scan.PHRASES]).split()
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(["other", "the", "x"])
            k = rnd.randint(0, len(parts))
            parts[k:k] = t
        rows.append((i, "".join(w + rnd.choice([" ", "\n", "\n# ", "  "]) for w in parts)))
    out = got(license_scan.scan(spark.createDataFrame(rows + rows[5:8], DOC))[0])
    want = sorted(((i, *brute.licensed(t, license_scan.PHRASES, license_scan.TEMPLATES)) for i, t in rows + rows[5:8]), key=repr)
    assert [x[:7] for x in out] == [x[:7] for x in want] and np.allclose([x[7] for x in out], [x[7] for x in want])


def test_near_vectors(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    base = rng.standard_normal((60, 16))
    rows = [(i, list(map(float, base[i % 60] + 0.04 * rng.standard_normal(16))), i % 60 % 3) for i in range(300)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, rows[0][1], None), (2003, [1.0] * 15 + [None], 1), (2004, [float("nan")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out, want = got(embedding_dedup.near_duplicates(df)), sorted(brute.near_vectors(rows), key=repr)
    links, all_links = sum(r[1] for r in out), sum(r[1] for r in want)
    assert len(out) == len(want) and links <= all_links and links >= 0.9 * all_links
    assert all(a[1] <= b[1] for a, b in zip(out, want, strict=True))


def test_vector_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", 16)
    rng = np.random.Generator(np.random.PCG64(5))
    rows = [(i, list(map(float, np.ones(8) + 0.05 * rng.standard_normal(8))), 1) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got(embedding_dedup.near_duplicates(df)) == sorted(brute.near_vectors(rows), key=repr)


def test_urls(spark):
    rows = [(1, None), (2, "nohost"), (3, "http://EN.Example.ORG/en/12?x"), (4, "x://org"), (5, "x://notexample.org/es/"), (6, "a://b.com?q"), (None, "http://org/"), (7, "http://com/fr/a#b?c"), (8, "http://a.com\nx/fr/"), (9, "://"), (10, "http://a.b.com/de/x"), (10, "http://a.b.com/de/x"), (11, "http://www.example.org/es/")]
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    out = url_filter.judge(clashing(spark.createDataFrame(rows, "page_id long, url string")), rules)
    assert got(out) == sorted(((i, *brute.judged(u, url_filter.RULES)) for i, u in rows), key=repr)


def test_urls_with_ties_between_rules_and_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "LEAST_RANGES", 5)
    monkeypatch.setattr(url_filter, "CUT", 6)
    rules = [("block", "b.org", "/a"), ("allow", "b.org", "/a"), ("allow", "org", "/a/bc"), ("block", "x.b.org", ""), ("allow", "com", "/"), ("block", "q.com", "/")]
    hosts = ["b.org", "x.b.org", "y.x.b.org", "xb.org", "org", "q.com", "aq.com", "Q.COM", "c.net"]
    rows = [(i, f"http://{hosts[i % 9]}{['', '/', '/a', '/a/b', '/a/bcd?x', '#f'][i % 6]}") for i in range(200)]
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    for i, u in rows:
        host, path, *_ = brute.judged(u, [])
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert out[i] == (max(fits)[3:] if fits else (None, "allow")), u


def test_long_texts(spark):
    """Texts of some 60,000 bytes, twice, in the operators that read documents."""
    rnd = random.Random(20)
    long = " ".join(f"{rnd.choice('abcdefgh')}{rnd.randint(0, 3000)}é" for _ in range(9000))
    rows = [(1, long), (2, long), (3, long[:30000] + " other"), (4, "short me@x.org token=abcdef123")]
    df = spark.createDataFrame(rows, DOC)
    assert got(suffix_dedup.remove_repeats(df)) == sorted(((r[0], *b) for r, b in zip(rows, brute.repeats([r[1] for r in rows], 400), strict=True)), key=repr)
    assert got(ngram_join.shingle_components(df).select("doc_id", "n_shingles", "component_id")) == sorted(brute.shingle_components(rows)[0], key=repr)
    item = " ".join(brute.WORD.findall(brute.lower(long))[5000:5012])
    out = decontaminate.decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert got(out.select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated")) == sorted(brute.contaminated(rows, [(1, item)]), key=repr)
    assert got(pii.find(df).select("doc_id", "spans")) == [(1, ""), (2, ""), (3, ""), (4, "email:6:14")]
    assert {r.doc_id: r.n_assign for r in secret_scan.scan(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert license_scan.scan(df)[0].where("n_words > 8000").count() == 2 and sum(r.n_words for r in packing.pack(df.withColumn("source", F.lit("s"))).collect()) == sum(len(t.split()) for _, t in rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(df, labels).count() == 4


def junk(seed, parts, n):
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(n)] + [(None, None), (1, "")]


def test_personal_data(spark):
    rows = junk(1, ["@", ".", "+", "1", "2.", "3", " ", "-", "a", "b@c.d", "é", "255", "(", ")", "4111111111111111", "+1 (555) 123-4567", "mailto:", "://", "iban"], 1500)
    out = got(pii.find(clashing(spark.createDataFrame(rows, DOC))).select("doc_id", "base_sha256"))
    assert out == sorted(((i, hashlib.sha256(brute.listed(brute.personal(t)).encode()).hexdigest()) for i, t in rows), key=repr)


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "é me@x.org and 10.0.0.1.", 9), (2, None, 0), (3, "ftp://joe:pw@host.org/x IBAN GB82 WEST 1234 5698 7654 32 ok", 0)]
    out = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out[1].text == "é [EMAIL] and [IP]." and out[1].n_chars == len(out[1].text) and out[2].text is None
    assert out[3].text == "[LINK] IBAN [ACCOUNT] ok"


def test_secrets(spark):
    rows = junk(2, ["PassWord", "token", "api_key", '="', "=", ": ", "'", "abcdef0123", "AKIAABCDEF", "GHIJ0123456789", "ſecret", " ", "x", "deadbeef00", "é"], 1500)
    out = got(secret_scan.scan(clashing(spark.createDataFrame(rows, DOC))).select("doc_id", "base_sha256"))
    assert out == sorted(((i, hashlib.sha256(brute.listed(brute.secrets(t)).encode()).hexdigest()) for i, t in rows), key=repr)


def test_learnt_formats_find_unannounced_secrets(spark):
    rnd = random.Random(9)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(22))
    rows = [(i, f"token = {key()}") for i in range(200)] + [(1000, f"see {key()} there"), (1001, "an extraordinarily2long wordlikethisone1 here")]
    out = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, DOC)).collect()}
    assert out[1000] == "format:4:26" and out[1001] == ""


def test_short_and_long_learnt_secrets_without_digits(spark):
    rnd = random.Random(4)
    pick = lambda of, n: "".join(rnd.choice(of) for _ in range(n))
    upper, word = "QXZJKVWYGH", lambda: pick("aeiourstlnm", rnd.randint(3, 11))
    rows = [(i, f"{' '.join(word() for _ in range(20))} password={pick(upper, 10)}") for i in range(300)]
    short = pick(upper, 10)
    out = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame([*rows, (1000, f"see {short}. Then {word()}"), (1001, "ordinary sentences remain untouched")], DOC)).collect()}
    assert out[1000] == "format:4:14" and out[1001] == ""
    assert sum("format" in out[i] for i in range(300)) == 0
    keys = [(i, f"words here token={'aX12' * 100}{i % 10}") for i in range(50)] + [(60, "only ordinary words here, ordinary"), (61, f"key {'aX12' * 100}7")]
    out = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(keys, DOC)).collect()}
    assert out[61] == "format:4:405"


def test_packing(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 70) + [str(i % 40)]), f"s{i % 5}") for i in range(300)] + [(1, None, "s1"), (2, "", None), (3, "same text", None), (3, "same text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.pack(df, capacity=64, shard_items=50).collect()
    assert sum(r.n_words for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    bins = {}
    for r in out:
        bins.setdefault(r.bin, []).append(r)
    source = {i: s for i, _, s in rows}
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        assert all(x.offset + x.n_words == y.offset for x, y in zip(b, b[1:], strict=False)) and b[-1].offset + b[-1].n_words <= 64
        named = [source[r.doc_id] for r in b if source[r.doc_id]]
        assert len(named) == len(set(named))


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.pack_shard([6, 5, 4, 4], [0, 1, 2, 0], [0, 1, 2, 3], 10) == [(0, 0), (1, 0), (0, 6), (1, 5)]
    assert packing.pack_shard([3, 3, 3], [0, 0, -1], [0, 1, 2], 10) == [(0, 0), (1, 0), (0, 3)]


def test_best_fit_equals_a_plain_one():
    rnd = random.Random(15)
    for _ in range(30):
        items = sorted(((rnd.randint(1, 20), rnd.randint(-1, 6), rnd.randint(0, 25)) for _ in range(150)), key=lambda x: -x[0])
        assert packing.pack_shard(*map(list, zip(*items, strict=True)), 20) == brute.packed(items, 20)


def test_packing_of_repeated_rows_and_given_clusters(spark):
    long = " ".join(["w"] * 70)
    rows = [(1, long, "a", "c1"), (1, long, "a", "c1"), (None, long, None, None), (2, "x y", None, "c1"), (3, "z", None, "c1"), (4, "z z", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, near string")
    bins = {}
    for r in packing.pack(clashing(df), capacity=64, cluster_col="near").collect():
        bins.setdefault(r.bin, []).append(r)
    assert all(sum(r.n_words for r in b) <= 64 for b in bins.values()) and sum(len(b) for b in bins.values()) == 9
    near = {i: c for i, _, _, c in rows}
    assert all(len(x) == len(set(x)) for b in bins.values() for x in [[near[r.doc_id] for r in b if near[r.doc_id]]])


def test_scoring_from_another_folder(tmp_path):
    """Executors need not be able to import the package."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from pyspark.sql import SparkSession
from sievework.llm import secret_scan, toxicity
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
d = s.createDataFrame([(i, f"word{{i % 7}} token = abcd{{i}}efgh vile{{i % 2}}") for i in range(40)], "doc_id long, text string")
assert toxicity.score_documents(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")).count() == 40
assert secret_scan.scan(d).count() == 40
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(7)
    fill = lambda k: [rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randint(0, 50)) for _ in range(k)]
    rows, labels = [], []
    for i in range(900):
        w, toxic = fill(rnd.randint(5, 60)), rnd.random() < 0.3
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(["vile", "nasty"]) + rnd.choice(["ling", "ness", "ly"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (None, "vileness")]
    d, known = clashing(spark.createDataFrame(rows, DOC)), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(d, known).collect()}
    held = [(out[i].score, t) for i, t in labels if out[i].held_out]
    assert len(held) > 100 and np.mean([(s >= 0.5) == t for s, t in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    kept = toxicity.keep_clean(d, known)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in out.values())


def test_toxicity_learns_rare_words_and_from_few_examples(spark):
    rnd = random.Random(3)
    fill = lambda: " ".join(rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randint(0, 50)) for _ in range(12))
    marks = ["vileness", "nastyword", "grimthing", "foulmouth", "hateful"]
    rows = [(i, f"{fill()} {marks[i // 2 % 5]} {marks[i // 2 % 5]}" if i % 2 else fill()) for i in range(24)]
    labels = [(i, i % 2) for i in range(24)]
    asked = [(100 + i, f"{fill()} {m} {m}") for i, m in enumerate(marks)] + [(200 + i, fill()) for i in range(5)]
    out = {r.doc_id: r for r in toxicity.score_documents(spark.createDataFrame(rows + asked, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(out[100 + i].evidence.split(",")[0].split(":")[1] == "1" for i in range(5))
    assert np.mean([out[100 + i].score for i in range(5)]) > np.mean([out[200 + i].score for i in range(5)])


def test_toxicity_scores_equal_a_full_search(spark):
    """The whole chain of terms, weights, neighbours and votes against a dense version of it."""
    rnd = random.Random(12)
    word = lambda: rnd.choice(["vile", "kind", "é", "stone"]) + rnd.choice(["", "ness", "lings", "ly"]) + str(rnd.randint(0, 9))
    rows = [(i, " ".join(word() for _ in range(rnd.randint(1, 30)))) for i in range(160)] + [(900, None), (901, "!!"), (7, "vileness0")]
    known = {i: int("vile" in t) for i, t in rows[:120]}
    labels = list(known.items())
    model = toxicity.fit(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int"), "doc_id", "text")
    out = {(r.doc_id, r.text): r for r in toxicity.score_documents(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, toxic int")).join(spark.createDataFrame(rows, DOC), "doc_id").collect()}
    assert out[900, None].score == out[901, "!!"].score and len({r.score for r in out.values()}) > 100
    texts = {}
    for i, t in rows:
        if i in known and zlib.crc32(str(i).encode()) % 5:
            texts[i] = min(t, texts.get(i, t))
    assert sorted(map(int, model.index.ids)) == sorted(texts)
    bag = lambda t: Counter(x for w in brute.WORD.findall(brute.lower(t)) for x in ([("w", w)] + [("s", w.encode()[:6])] * (len(w.encode()) > 6)))
    bags, df = {i: bag(t) for i, t in texts.items()}, Counter(x for _, t in rows for x in bag(t))
    n1 = sum(known[i] for i in bags)
    n0, weight = len(bags) - n1, {}
    for x in {x for b in bags.values() for x in b}:
        yes, no = (sum(x in b for i, b in bags.items() if known[i] == c) for c in (1, 0))
        weight[x] = (np.log((1 + len(rows)) / (1 + df[x])) + 1) * float(toxicity.association(np.array([yes]), np.array([no]), n1, n0)[0])
    vector = lambda b: {x: (1 + np.log(c)) * weight[x] for x, c in b.items() if x in weight}
    unit = lambda v: {x: w / np.sqrt(sum(y * y for y in v.values())) for x, w in v.items()}
    vectors, place = {i: unit(vector(b)) for i, b in bags.items()}, {int(i): k for k, i in enumerate(model.index.ids)}
    for i, t in rows[:40] + rows[120:150]:
        v = unit(vector(bag(t)))
        best = sorted(((-round(sum(w * e.get(x, 0) for x, w in v.items()), 6), place[j]) for j, e in vectors.items()))[: toxicity.NEIGHBOURS]
        best = [(k, -c) for c, k in best if -c > 1e-6]
        vote = model.index.vote(np.array([k for k, _ in best]), np.array([c for _, c in best]), model.prior)
        if i != 7:
            assert abs(model.final(vote) - out[i, t].score) < 1e-3


def test_block_max_search_equals_full_search():
    rng = np.random.Generator(np.random.PCG64(8))
    n, terms = 700, 80
    counts = rng.poisson(0.08, (n, terms))
    counts[counts.sum(1) == 0, 0] = 1
    row, term = np.nonzero(counts)
    index = toxicity.Index(np.arange(terms), rng.random(terms) + 1, list(range(n)), np.zeros(n), np.ones(n), row, term, counts[row, term])
    dense = np.zeros((n, terms))
    dense[row, term] = index.weights(term, counts[row, term])
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for i in range(0, n, 50):
        t = np.flatnonzero(counts[i])
        ids, score = index.nearest(t, counts[i, t], but=i)
        full = dense @ dense[i]
        full[i] = -1
        best = np.sort(full[full > 1e-6])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(score, best, atol=1e-5)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    out = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    frames = [toxicity.score_documents(docs, labels), toxicity.keep_clean(docs, labels), license_scan.scan(docs)[0], suffix_dedup.remove_repeats(docs), ngram_join.shingle_components(docs), ngram_join.one_per_component(docs), packing.pack(docs), secret_scan.scan(docs), decontaminate.decontaminate(docs, items), decontaminate.keep_clean(docs, items), pii.find(docs), pii.redact(docs)]
    frames.append(embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")))
    frames.append(url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")))
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    fill = lambda k: " ".join(f"{rnd.choice('abcdefgh')}{rnd.randint(0, 99)}" for _ in range(k))
    item = fill(20)
    rows = [(i, fill(40) + (" vileling nastyness" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(500, rows[1][1]), (501, rows[1][1] + " more"), (502, fill(10) + " " + item), (503, fill(20) + " me@x.org"), (504, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = common.settled(stage(spark, df, str(tmp_path)))
        assert df.columns == docs.columns
        ids.append({r.doc_id for r in df.collect()})
    assert not any(i % 4 == 0 for i in ids[0] if i < 400) and {500, 501, 502, 503, 504} <= ids[0]
    assert len(ids[1] & {1, 500, 501}) == 1 and ids[0] - ids[1] < {1, 500, 501}
    assert ids[1] - ids[2] == {502} and ids[3] == ids[2]
    assert df.where("doc_id = 503").first().text.endswith("[EMAIL]")
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids[3] - {504}
