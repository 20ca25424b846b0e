"""Files, findings at rest, the stream of jobs, and recomparison."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parcelwise.functions import text
from parcelwise.plans import compare
from parcelwise.sources import relational, store
from parcelwise.streaming import queue, recompare

from .test_matching import coded, ring, star


def found(spark, rows):
    return spark.createDataFrame(rows, "analysis long, rule string, delta double")


def test_a_run_that_finds_nothing_removes_the_old_findings(spark, tmp_path):
    path, keys = str(tmp_path / "findings"), lambda *k: spark.createDataFrame([(x,) for x in k], "analysis long")
    read = lambda: sorted((r.analysis, r.rule) for r in store.read_findings(spark, path, "analysis").collect())
    store.replace_findings(found(spark, [(k, f"R{k}", 0.5) for k in range(200)]), keys(*range(200)), path, "analysis", buckets=4)
    assert len(read()) == 200
    store.replace_findings(found(spark, [(7, "R9", 1.0), (7, "R8", 2.0)]), keys(7, 8), path, "analysis", buckets=4)
    assert read() == sorted([(k, f"R{k}") for k in range(200) if k not in (7, 8)] + [(7, "R9"), (7, "R8")])
    store.replace_findings(found(spark, []), keys(*range(200)), path, "analysis", buckets=4)
    assert read() == []


def test_uploads(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b""), ("c.pdf", b"hello"), ("d.pdf", b"%PDF-" + b"y" * 99)):
        (tmp_path / name).write_bytes(content)
    good, bad = store.read_uploads(spark, str(tmp_path), max_bytes=50)
    assert [r.length for r in good.collect()] == [10]
    assert sorted(r.reason for r in bad.collect()) == ["not a PDF", "too large"]  # Spark passes over the empty file


def test_audit_grows(spark, tmp_path):
    for k in range(2):
        store.append_audit(spark.createDataFrame([(k, "edit")], "id int, action string"), str(tmp_path / "audit"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "audit")).orderBy("id").collect()] == [0, 1]


def test_alternates_are_kept_once(spark):
    o = spark.createDataFrame([(1, 0, 0, "area", 5.0, None), (1, 1, 0, "area", 5.0000000001, None), (1, 2, 0, "area", 5.1, None), (1, 3, 0, "confrontant", None, "X")], "pair long, ordinal int, idx int, field string, value_num double, value_text string")
    assert sorted(r.ordinal for r in store.alternates(o, "pair").collect()) == [0, 2, 3]


def test_each_job_runs_in_one_batch(spark, tmp_path):
    jobs, seen = tmp_path / "jobs", []
    jobs.mkdir()
    schema = spark.createDataFrame([], "job long, kind string").schema
    for k in range(3):
        (jobs / f"{k}.json").write_text(json.dumps({"job": k, "kind": "compare"}))
        queue.run_stream(spark, str(jobs), schema, str(tmp_path / "state"), lambda df, n: seen.append(sorted(r.job for r in df.collect()))).awaitTermination()
    assert seen == [[0], [1], [2]]


def test_recompare_is_a_full_comparison_of_the_changed(spark):
    r = random.Random(8)
    a = {k: coded(star(k, 4 + k % 4)) for k in range(12)}
    b = {k: [(c, e + r.choice([0, 0, 3.5]), n) for c, e, n in v] for k, v in a.items()}
    old = compare.compare_vertices(ring(spark, a), ring(spark, b))
    changed = {k: [(c, e, n + (0.8 if i == 1 else 0)) for i, (c, e, n) in enumerate(v)] if k in (2, 5) else v for k, v in b.items()}
    new = compare.recompare(old, spark.createDataFrame([(2,), (5,)], "pair long"), ring(spark, a), ring(spark, changed))
    full = compare.compare_vertices(ring(spark, a), ring(spark, changed))
    assert sorted(map(str, new.collect())) == sorted(map(str, full.collect()))


@pytest.mark.parametrize("raw,label", [("Vértice", "vertice"), ("Az. °", "az °"), ("AZIMUTE (gms)", "azimute gms"), ("Coord._N/m", "coord n m"), ("Nº", "no"), ("Área\u00a0m²", "area m2"), ("ﬁm + 1", "fim + 1"), ("e\u0301", "e"), ("Žluťoučký", "zlutoucky"), ("a#b", "a#b"), ("", "")])
def test_labels_follow_the_decomposition(spark, raw, label):
    assert spark.createDataFrame([(raw,)], "x string").select(text.normalize_label(F.col("x"))).first()[0] == label


def test_values_as_text(spark):
    rows = spark.createDataFrame([(1, None), (2, 1.5), (3, 100.0), (4, 1234567.1234567), (5, 0.0)], "k int, x double").select(text.value_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [None, "1.5", "100", "1234567.123457", "0"]


def test_alternates_differ_from_the_primary_by_a_millionth(spark):
    o = spark.createDataFrame([(1, k, 0, "area", x, None) for k, x in enumerate([0.4e-6, 0.6e-6, 1.3e-6, 1.5e-6])] + [(1, 9, 0, "distance", None, None), (1, 10, 0, "confrontant", None, "X"), (1, 11, 0, "confrontant", None, "X"), (1, 12, 0, "confrontant", None, "Y")], "pair long, ordinal int, idx int, field string, value_num double, value_text string")
    assert sorted(r.ordinal for r in store.alternates(o, "pair").collect()) == [0, 3, 9, 10, 12]


def relational_tables(spark):
    analyses = spark.createDataFrame([(k, "compared") for k in range(20)], "pair long, status string")
    extractions = spark.createDataFrame([(k, r) for k in range(19) for r in "AB"], "pair long, role string")
    observations = spark.createDataFrame([(k % 7, 0.5 + k % 2 * 0.4, k % 3 == 0) for k in range(100)], "pair long, confidence double, edited boolean")
    findings = spark.createDataFrame([(k % 5, f"R{k % 3}", ["error", "info"][k % 2]) for k in range(30)], "pair long, rule string, severity string")
    return {"analyses": analyses, "extractions": extractions, "observations": observations, "findings": findings}


def test_bucketed_tables_are_joined_without_an_exchange(spark, tmp_path):
    relational.save(relational_tables(spark), "store_test", str(tmp_path / "store"), 4)
    held = relational.load(spark, "store_test")
    for df in (relational.overview(held), relational.with_finding(held, ["R1"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    rows = {r.pair: r for r in relational.overview(held).collect()}
    assert len(rows) == 20 and rows[19].documents == 0 and rows[3].documents == 2
    assert [sum(r[c] for r in rows.values()) for c in ("observations", "findings", "errors")] == [100, 30, 15]
    assert sum(r.unsure for r in rows.values()) == sum(k % 2 == 0 and k % 3 != 0 for k in range(100))
    assert sorted(r.pair for r in relational.with_finding(held, ["R1"]).collect()) == [0, 1, 2, 3, 4]
    for t in relational.TABLES:
        spark.sql(f"DROP TABLE store_test_{t}")


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A count of each pair's values stands for the comparison; it is asked for the touched pairs only."""
    asked = []

    def count(observations):
        asked.append(sorted(r.pair for r in observations.select("pair").distinct().collect()))
        return observations.filter("value_num > 10").groupBy("pair").agg(F.count(F.lit(1)).cast("double").alias("delta"))

    base = str(tmp_path / "base")
    observations = spark.createDataFrame([(p, 2 * p + r, 1, i, "easting", 5.0, None, 0.7, False) for p in range(6) for r in (0, 1) for i in range(3)], "pair long, document long, ordinal long, idx int, field string, value_num double, value_text string, confidence double, edited boolean")
    recompare.create(observations.withColumn("ordinal", F.col("idx").cast("long")), count, base, 4)
    read = lambda: sorted((r.pair, r.delta) for r in recompare.findings(spark, base).collect())
    assert read() == []
    batch = lambda *rows: spark.createDataFrame([(*r[:3], None, r[3], "u") for r in rows], recompare.CORRECTIONS).withColumn("at", F.timestamp_seconds(F.lit(1000) + F.col("value_num").cast("long")))
    first, second = batch((1, 2, 0, 20.0), (4, 9, 2, 30.0)), batch((1, 2, 1, 40.0), (4, 9, 2, 31.0), (4, 9, 2, 1.0))
    for n, rows in ((0, first), (1, second), (0, first), (2, batch())):
        recompare.apply_batch(rows, n, count, base, 4)
    assert read() == [(1, 2.0), (4, 1.0)] and asked[1:] == [[1, 4]] * 3
    recompare.apply_batch(batch((4, 9, 2, 50.0)), 3, count, base, 4)
    assert read() == [(1, 2.0), (4, 1.0)]
    back = batch((1, 2, 0, 60.0), (1, 2, 1, 61.0)).withColumn("value_num", F.lit(1.0))
    recompare.apply_batch(back, 4, count, base, 4)
    assert read() == [(4, 1.0)]
