import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import language_id, media_columns, quality_classifier, quality_rules

from .conftest import prose

SF = "/root/testdata/sf0.01"


def test_media_round_trip_and_correction(make, odd):
    media = media_columns.store(make(odd))
    got = {r.doc_id: r for r in media_columns.digests(media).collect()}
    for row in odd:
        text = (row[1] or "").encode()
        payload = media_columns.padded(text)
        r = got[row[0]]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].feature == got[5].feature
    kinds = {r.id: r.detected for r in media_columns.sniff(media).collect()}
    stored = {r.id: r.media for r in media.collect()}
    for k, data in stored.items():
        assert kinds[k] == media_columns.STORED_TYPES[zlib.crc32(media_columns.padded((dict((o[0], o[1]) for o in odd)[k] or "").encode())) % 3]
    assert media_columns.digests(media_columns.store(make([]))).count() == 0


def png():
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\x7f")) + chunk(b"IEND", b"")


def test_carving_confirms_structure(spark):
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    wav = media_columns.write_wav(b"x" * 192)
    data = b"junk BM RIFF P5\n " + png() + b"GIF89a not one" + gif + b"--" + wav + b"BMtail"
    spoiled = bytearray(png())
    spoiled[-20] ^= 1
    rows = spark.createDataFrame([(1, "image/gif", bytearray(data)), (2, "image/png", bytearray(png())), (3, None, bytearray(spoiled)), (4, "x", None)], media_columns.MEDIA)
    out = {r.id: r for r in media_columns.sniff(rows).collect()}
    assert out[1].detected == media_columns.UNKNOWN
    assert [(e.type, bytes(e.bytes)) for e in out[1].embedded] == [("image/png", png()), ("image/gif", gif), ("audio/wav", wav)]
    assert [data[e.offset : e.offset + e.length] == bytes(e.bytes) for e in out[1].embedded] == [True] * 3
    assert out[2].detected == "image/png" and out[3].detected == media_columns.UNKNOWN and out[4].embedded == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    right, all_ = found.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert all_ > 200 and right / all_ > 0.97


def test_scores_near_those_of_the_exact_kernel(spark):
    """With every training text as a landmark the approximation is the exact kernel: scores agree with kernel ridge regression written out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang IS NOT NULL AND doc_id % 7 = 0").select("doc_id", "text", "lang")
    langs, matrix = language_id.fit(docs)
    rows = docs.withColumn("held", language_id.held_out("doc_id")).collect()

    def grams(text):
        data = text.encode().lower()
        return {data[k : k + n] for n in (2, 3, 4) for k in range(len(data) - n + 1)}

    train = [r for r in rows if not r.held]
    assert 40 < len(train) <= language_id.LANDMARKS
    sets = [grams(r.text) for r in train]
    kernel = lambda x, y: len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1))
    gram = np.array([[kernel(x, y) for y in sets] for x in sets])
    target = np.where(np.array([[r.lang == lang for lang in langs] for r in train]), 1.0, -1.0)
    weights = np.linalg.solve(gram + language_id.RIDGE * len(train) * np.eye(len(train)), target)
    held = [r for r in rows if r.held]
    exact = np.array([[kernel(grams(r.text), y) for y in sets] for r in held]) @ weights
    x = language_id.presence([r.text.encode() for r in held]).astype(np.float32)
    own = (x @ matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    assert len(held) > 10 and np.abs(own - exact).max() < 0.05  # hashed cells collide now and then
    assert (own.argmax(1) == exact.argmax(1)).mean() > 0.95


def test_more_languages_than_rows_to_spare(spark, monkeypatch):
    """No language is left out, however many there are; each gets fewer rows."""
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 160)
    rows = [(100 * k + j, prose(1000 + 20 * k + j % 20, 40) + f" {chr(0x4E00 + 7 * k) * 6} " * 4, f"l{k:02d}") for k in range(80) for j in range(16)]
    langs, matrix = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == [f"l{k:02d}" for k in range(80)] and matrix.shape[1] == 80


def test_language_of_odd_rows(make, odd):
    docs = make(odd)
    out = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[4].lang_pred == "en" and 0 <= out[4].score <= 1
    assert out[None].held_out is False
    empty = make([])
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    unlabelled = make([(1, prose(1), None, None)])
    assert language_id.predict(unlabelled, language_id.fit(unlabelled)).first().lang_pred == "und"
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, None, 6, 7, 8, 9, 11}
    assert language_id.keep_identified(empty).count() == 0


FOREIGN = ["人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待", "Все люди рождаются свободными и равными в своем достоинстве и правах.", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", "qzxj kkvw", "x", "x7f3k9q2z8v4j1w6p0r5b3n8m2c7 q9zk4vx81jw"]


def test_foreign_and_random_texts_go_and_clean_ones_stay(spark):
    import random
    import string

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(5)
    noise = ["".join(r.choice(string.ascii_lowercase + string.digits + "  ") for _ in range(n)) for n in (20, 60, 200, 1000) for _ in range(5)]
    strange = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(FOREIGN + noise)], "doc_id long, text string, lang string")
    given = docs.select("doc_id", "text", "lang").unionByName(strange)
    kept = {x.doc_id for x in language_id.keep_identified(given).collect()}
    assert not {k for k in kept if k < 0}
    clean = {x.doc_id for x in docs.filter("lang IS NOT NULL AND length(text) > 100").collect()}
    assert len(clean) > 800 and len(clean & kept) >= 0.99 * len(clean)


def test_thresholds_come_from_all_held_out_texts(spark, make):
    docs = make([(k, prose(k, 4 + k % 7), "en" if k % 2 else "fr", "s0") for k in range(16_000)]).select("doc_id", "text", "lang")
    _, matrix, known, sizes = language_id.train(docs, "doc_id", "text", "lang")
    least = language_id.calibrated(docs, spark.sparkContext.broadcast((matrix, known)), sizes, "doc_id", "text", "lang") / language_id.STEPS
    held = [r.text.encode() for r in docs.filter(language_id.held_out()).collect()]
    assert len(held) > 3500
    below = language_id.measures(held, matrix, known)[:, None] < [least, least + 1 / language_id.STEPS]
    missed = int((len(held) - 1) * language_id.MISSED)
    assert (below[:, 0].sum(0) <= missed).all() and (below[:, 1].sum(0) > missed).all()


def test_fit_of_the_driver_holds_bits(spark, make):
    import tracemalloc

    docs = make([(k, prose(k, 60), "en" if k % 2 else "fr", "s0") for k in range(1200)]).select("doc_id", "text", "lang")
    tracemalloc.start()
    language_id.fit(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_single_language_and_few_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").select("doc_id", "text", "lang")
    strange = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(FOREIGN)], docs.schema)
    kept = {x.doc_id for x in language_id.keep_identified(docs.unionByName(strange)).collect()}
    assert not {k for k in kept if k < 0} and len(kept) >= 0.98 * docs.count()
    few = docs.limit(40).unionByName(strange)  # too few held-out texts for a threshold: only texts without a letter go
    assert language_id.keep_identified(few).count() == few.count()


def brute_statistics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, t in enumerate(threes) if threes.count(t) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


@pytest.mark.parametrize("text", ["", " \n", "a b", "a b c a b c", "x y z\nx y z\n\nx y z", "é ☃ # * a|b <c> é ☃ #", "w " * 50, prose(3), "a\x0bb\x85c d\x1ce", "one two\nthree one two\nthree"])
def test_statistics_against_brute_force(text):
    assert quality_rules.statistics(text.encode())[0] == brute_statistics(text)


def test_rules_on_labelled_documents(spark):
    """Fitted on the labels of some documents, right on those of others."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality_rules.apply(docs, quality_rules.fit(docs, labels.filter("doc_id % 3 <> 0")))
    rows = out.join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    passed = [r for r in rows if not r.base_failed]
    assert len(passed) > 60 and np.mean([r.kept == (r.quality == 1) for r in passed]) > 0.9


def walk(trees, row):
    """A node at a time, from each tree's root."""
    total = trees.base
    for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value):
        node = 0
        while feature[node] >= 0:
            node = 2 * node + (1 if row[feature[node]] <= threshold[node] else 2)
        total += value[node]
    return 1 / (1 + np.exp(-total))


def test_trees_against_a_plain_walk():
    r = np.random.default_rng(4)
    x = np.round(r.random((500, 4)), 2)  # with values on the thresholds
    trees = quality_rules.boost(x, ((x[:, 0] > 0.4) ^ (x[:, 2] > 0.7)).astype(float), [0, 0, 0, 0])
    assert np.allclose(trees.score(x), [walk(trees, row) for row in x])


def test_boosting_is_monotone():
    r = np.random.default_rng(1)
    x = r.random((800, 3))
    y = ((x[:, 0] + 0.3 * r.standard_normal(800) < 0.6) | (x[:, 0] > 0.9)).astype(float)  # rises at the end: a free model would follow
    trees = quality_rules.boost(x, y, [-1, 0, 0])
    grid = np.linspace(0, 1, 200)
    for other in r.random((20, 2)):
        score = trees.score(np.column_stack([grid, np.tile(other, (200, 1))]))
        assert (np.diff(score) <= 1e-12).all()
    one = quality_rules.boost(x, (x[:, 1] > 0.5).astype(float), [0, 0, 0]).score(x)
    assert np.mean((one > 0.5) == (x[:, 1] > 0.5)) > 0.97


def test_rules_of_odd_rows(make, odd, spark):
    docs = make(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_rules.fit(docs, none)
    assert model is None
    out = quality_rules.apply(docs, model).collect()
    assert len(out) == len(odd)
    by = {r.doc_id: r for r in out}
    assert by[1].base_failed and by[1].n_words == 0 and by[4].kept and by[7].n_words == 1
    assert quality_rules.apply(make([]), None).count() == 0


def test_classifier_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    model = quality_classifier.fit(docs, labels.filter("doc_id % 3 <> 0"), good)
    out = quality_classifier.classify(docs, model, F.col("source"), F.col("lang"))
    rows = out.select("doc_id", "kept").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0 or r.toxic == 1]
    assert len(bad) > 50 and np.mean(clean) > 0.97 and np.mean(bad) < 0.15


def test_posterior_against_plain_sums(spark):
    """Sites from real hosts and paths of pages; every posterior written out in Python."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), F.regexp_extract("url", "//[^/]+/([^/]*)", 1).alias("path"))
    scores = pages.select(F.col("page_id").alias("id"), "host", "path", (F.pmod("page_id", F.lit(13)) / 3.0 - 2).alias("evidence")).withColumn("units", F.rint(quality_classifier.SCALE / (1 + F.exp(-F.col("evidence")))).cast("long"))
    rows = scores.collect()
    p = {r.id: r.units / quality_classifier.SCALE for r in rows}
    mean = sum(p.values()) / len(p)
    within = max(sum(x * x for x in p.values()) / len(p) - mean * mean, 1e-6)

    def groups(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(p[r.id])
        return out

    def strength(of):
        n, n2, k = len(p), sum(len(v) ** 2 for v in of.values()), len(of)
        between = (sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in of.values()) - (k - 1) * within) / (n - n2 / n)
        return min(max(within / between, 1.0), 1e6) if between > 0 else 1e6

    hosts, paths = groups(lambda r: r.host), groups(lambda r: (r.host, r.path))
    sh, sp = strength(hosts), strength(paths)
    got = {r.id: r for r in quality_classifier.posterior(scores).collect()}
    assert len(hosts) > 3 and len(got) == len(rows)
    for r in rows:
        h, q = hosts[r.host], paths[r.host, r.path]
        host = (sum(h) - p[r.id] + sh * mean) / (len(h) - 1 + sh)
        path = (sum(q) - p[r.id] + sp * host) / (len(q) - 1 + sp)
        assert abs(got[r.id].host_quality - host) < 1e-9 and abs(got[r.id].path_quality - path) < 1e-9
        odds = r.evidence + np.log(path / (1 - path)) - np.log(mean / (1 - mean))
        assert abs(got[r.id].quality - 1 / (1 + np.exp(-odds))) < 1e-9


def test_sparse_sites_shrink_to_their_host(spark):
    rows = [(k, "h1", "p1", 0.0, 900_000) for k in range(200)] + [(k, "h2", "p2", 0.0, 100_000) for k in range(200, 400)] + [(400, "h1", "new", 0.0, 100_000), (401, "h3", "p3", 0.0, 900_000)]
    rows += [(500 + k, f"h{4 + k % 5}", f"p{k % 3}", 0.0, 500_000 + (k % 7) * 60_000) for k in range(200)]
    got = {r.id: r for r in quality_classifier.posterior(spark.createDataFrame(rows, "id long, host string, path string, evidence double, units long")).collect()}
    assert got[0].quality > 0.6 > 0.4 > got[250].quality
    assert abs(got[400].path_quality - got[400].host_quality) < 1e-9  # nothing else on the path: the host speaks
    mean = sum(r[4] for r in rows) / len(rows) / 1e6
    assert abs(got[401].path_quality - mean) < 1e-6  # nor on the host: the global prior


def test_classifier_of_odd_rows(make, odd):
    docs = make(odd)
    out = quality_classifier.classify(docs, None, F.col("source"), F.col("lang"))
    assert out.count() == len(odd) and out.filter("quality IS NULL OR kept IS NULL").count() == 0
    assert quality_classifier.classify(make([]), None, F.col("source"), F.col("lang")).count() == 0
