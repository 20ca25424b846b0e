"""The same doubles as SQL makes, where rounding to whole units would show a last bit."""

import random

import duckdb
from pyspark.sql import functions as F

from parcelwise.functions import crs
from parcelwise.operators import rings
from parcelwise.queries import survey
from parcelwise.queries.tables import SIDES


def test_sides_are_the_doubles_of_sql(spark):
    r = random.Random(5)
    rows = [(p, k, 333000 + r.randrange(9_000_000) / 10_000, 7394000 + 10.0 * r.randrange(1, 51)) for p in range(400) for k in range(5)]
    v = spark.createDataFrame(rows, "pair long, idx int, e double, n double")
    got = {(x.pair, x.idx): x for x in rings.sides(v, ["pair"]).collect()}
    c = duckdb.connect()
    c.execute("CREATE TABLE va (pair BIGINT, idx INT, e DOUBLE, n DOUBLE)")
    c.executemany("INSERT INTO va VALUES (?, ?, ?, ?)", rows)
    want = c.execute(f"WITH {SIDES} SELECT pair, idx, length, azimuth FROM sa").fetchall()
    assert all(got[p, k].length == length for p, k, length, _ in want)
    # atan2 itself is not alike in the last bit of some
    assert sum(got[p, k].azimuth != azimuth for p, k, _, azimuth in want) < 0.1 * len(rows)


def test_longitude_is_added_in_degrees(spark):
    """A point on the central meridian has the meridian's very longitude, not one that radians have rounded."""
    at = spark.createDataFrame([(z,) for z in range(1, 61)], "zone int").select("zone", crs.geographic(F.lit(500000.0), F.lit(7394000.0), F.col("zone"), F.lit("S"))["longitude"].alias("longitude")).collect()
    assert all(x.longitude == x.zone * 6 - 183 for x in at)


def test_a_half_turn_has_the_sign_of_sql(spark, tmp_path):
    """Pair 2's second vertex is moved by 0.4 to the east, which turns the side from there round."""
    rows = [(2, 0, 0, 1, 1000.0, 1.0), (2, 0, 0, 2, 5000.0, 1.0), (2, 0, 0, 3, 5020.0, 1.0)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.execute(survey.SQL["side_findings"])
    names = [d[0] for d in want.description]
    rows = sorted(map(repr, want.fetchall()))
    assert any("'R20'" in x and "-1800000" in x for x in rows)
    assert sorted(repr(tuple(x[n] for n in names)) for x in survey.side_findings(spark, str(tmp_path)).collect()) == rows
