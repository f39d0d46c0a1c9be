"""Traps of the library's operators that the star tables do not hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platen import schema
from platen.functions import colour as K
from platen.functions import paths as N
from platen.operators import collections as C
from platen.operators import edits as E
from platen.operators import ingest as I
from platen.operators import library as L
from platen.operators import raster as R
from platen.operators import session as S

from .conftest import rows_of


def test_filter_of_nothing_admits_unrated_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, 3, "pick", "red")], "id long, rating int, flag string, colour_label string")
    assert L.Filter(min_rating=0).is_everything()
    assert rows.where(L.Filter(min_rating=0).column()).count() == 2
    assert [r.id for r in rows.where(L.Filter(unflagged=True).column()).collect()] == [1]
    assert [r.id for r in rows.where(L.Filter(min_rating=1).column()).collect()] == [2]


def test_ranks_are_total_and_without_gaps(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = L.ranked(rows, [F.col("k").asc(), F.col("id").desc()], "place", 0).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000))
    assert [(r.k, -r.id) for r in got] == sorted((r.k, -r.id) for r in got)


def test_closure_ends_at_loops_and_orphans(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 99), (5, None), (6, 5)], "id long, parent_id long")
    got = {(r.id, r.ancestor) for r in L.closure(nodes).collect()}
    assert {(1, 1), (1, 2), (1, 3), (2, 1), (3, 2)} <= got
    assert {a for i, a in got if i == 4} == {4}
    assert {a for i, a in got if i == 6} == {5, 6}


def test_positions_go_on_past_refused_images(spark):
    rows = spark.createDataFrame([(1, 10, 5)], "collection_id long, image_id long, position long")
    asked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 404, 3), (1, 12, 4)], "collection_id long, image_id long, ordinal long")
    images = spark.createDataFrame([(10,), (11,), (12,)], "image_id long")
    got = {r.image_id: r.position for r in C.appended(rows, asked, images).collect()}
    assert got == {11: 7, 12: 9}


def test_restored_collections_have_fresh_ids_and_parents(spark):
    spec = "id long, parent_id long, name string, is_quick boolean, is_target boolean"
    rows = spark.createDataFrame([(1, None, "quick", True, False), (2, None, "a", False, True), (3, 2, "b", False, False)], spec)
    members = spark.createDataFrame([(1, 5, 1), (3, 6, 1)], "collection_id long, image_id long, position long")
    left, kept, gone = C.removed(rows, members, 2)
    assert [(r.id, r.is_target) for r in left.collect()] == [(1, True)]
    assert [r.collection_id for r in kept.collect()] == [1]
    back = {r.name: (r.id, r.parent_id) for r in C.restored(left, gone, 100).collect()}
    assert back["a"] == (100, None) and back["b"] == (101, 100)


def test_a_b_a_makes_three_versions(spark):
    saves = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a")], "image_id long, at int, content string")
    assert [(r.version, r.content) for r in E.versions(saves, ["at"]).orderBy("version").collect()] == [(1, "a"), (2, "b"), (3, "a")]


def test_next_free_fills_gaps(spark):
    used = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 3), (3, 1)], "file long, n int")
    assert {r.file: r.n for r in E.next_free(used, "file", "n").collect()} == {1: 3, 2: 1, 3: 2}


def test_validation_names_what_is_wrong(spark):
    doc = '{"schema_version": 2, "tone": {"exposure_ev": 9.0, "contrast": null}}'
    rows = E.parsed(spark.createDataFrame([(doc,)], "json string"), schema.EDIT)
    got = E.validated(rows, {"tone.exposure_ev": (-5, 5), "tone.contrast": (-1, 1)}).first().faults
    assert got == ["schema_version", "tone.exposure_ev", "tone.contrast"]


def test_relink_outcomes(spark):
    missing = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None), (6, "d")], "id long, content_hash string")
    found = spark.createDataFrame([("/y", "a"), ("/x", "a"), ("/z", "b"), ("/held", "d")], "path string, content_hash string")
    held = spark.createDataFrame([("/held",)], "path string")
    got = {r.id: (r.path, r.outcome) for r in I.relinked(missing, found, held).collect()}
    assert got == {1: ("/x", "relinked"), 2: (None, "ambiguous"), 3: (None, "ambiguous"), 4: (None, "still_missing"), 5: (None, "unhashed"), 6: (None, "still_missing")}


def test_names_with_wildcards_are_not_patterns(spark):
    rows = spark.createDataFrame([("a%/x",), ("ab/x",), ("a%",), ("a%b/x",)], "p string")
    assert [r.p for r in rows.where(I.under(F.col("p"), "a%")).collect()] == ["a%/x", "a%"]


@pytest.mark.parametrize("text, want", [("2024:02:31 00:00:00", 1709337600), ("1969:01:01 00:00:00", None), ("2024:01:01 24:00:00", None), ("short", None), ("2024:01:01 00:00:60", 1704067260)])
def test_wall_clock(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(I.wall_clock(F.col("t")).alias("w")).first().w == want


def test_listing_reads_supported_files_only(spark, tmp_path):
    for n in ("a.ARW", "b.arw", "c.jpg", "d"):
        (tmp_path / n).write_bytes(b"raw")
    got = I.listing(spark, str(tmp_path)).collect()
    assert sorted(r.path.rsplit("/")[-1] for r in got) == ["a.ARW", "b.arw"] and {r.size for r in got} == {3}


def test_paths(spark):
    row = spark.createDataFrame([("\\\\?\\C:\\A\\b", "a//b/", "x.tar.gz", "noext")], "v string, p string, f string, g string")
    stem, ext = N.split_name(F.col("f"))
    _, none = N.split_name(F.col("g"))
    got = row.select(N.slashed(F.col("v")), N.last_part(F.col("p")), stem, ext, none).first()
    assert tuple(got) == ("C:/A/b", "b", "x.tar", "gz", "arw")


def test_undo_and_redo(spark):
    steps = [("set", 1), ("set", 2), ("undo", 0), ("undo", 0), ("undo", 0), ("redo", 0), ("set", 5), ("redo", 0)]
    rows = spark.createDataFrame([(7, i, c, float(v)) for i, (c, v) in enumerate(steps)], "user long, seq long, command string, value double")
    got = [(r.value, r.past, r.future) for r in S.folded(rows, "user", ["seq"]).orderBy("seq").collect()]
    assert got == [(1, 1, 0), (2, 2, 0), (1, 1, 1), (0, 0, 2), (0, 0, 2), (1, 1, 1), (5, 2, 0), (5, 2, 0)]


def test_levels_of_odd_scales(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (1.0,), (2.0,), (0.5,), (0.3,), (1e-9,)], "s double")
    assert [r.l for r in rows.select(S.level_of(F.col("s"), 5).alias("l")).collect()] == [5, 5, 0, 0, 1, 1, 5]


def test_hsv_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in rng.random((200, 3))], "r double, g double, b double")
    back = K.rgb_of(*K.hsv((F.col("r"), F.col("g"), F.col("b"))))
    gap = rows.select(F.max(F.greatest(*[F.abs(a - F.col(c)) for a, c in zip(back, "rgb")])).alias("m")).first().m
    assert gap < 1e-12


def test_delta_e_of_published_pairs(spark):
    # Pairs of the published CIEDE2000 test set and their differences.
    pairs = [
        (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
        (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0),
        (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
        (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
        (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
    ]
    d = spark.createDataFrame(pairs, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    got = K.delta_e_2000(d, ("l1", "a1", "b1"), ("l2", "a2", "b2")).collect()
    assert all(math.isclose(r.delta_e, r.want, abs_tol=1e-4) for r in got)


def test_pyramid_rebuilds_the_tile(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.random(30)]) for i in range(4)], "id int, t array<double>")
    d = rows.withColumn("c", R.downsampled(F.col("t"), 6, 5)).withColumn("l", R.laplacian(F.col("t"), F.col("c"), 6, 5))
    d = d.withColumn("back", F.zip_with("l", R.upsampled(F.col("c"), 3, 3, 6, 5), lambda a, b: a + b))
    for r in d.collect():
        assert len(r.c) == 9 and np.allclose(r.back, r.t)


def test_borders(spark):
    row = spark.range(1).select(*[R.place(F.lit(x), 4, b).alias(f"{b}{i}") for b in ("clamp", "mirror") for i, x in enumerate((-2, -1, 0, 3, 4, 5))])
    assert tuple(row.first()) == (0, 0, 0, 3, 3, 3, 2, 1, 0, 3, 2, 1)


def test_singular_matrix_has_no_inverse():
    assert K.invert3([[1, 2, 3], [2, 4, 6], [0, 0, 1]]) is None
    m = [[2.0, 0.0, 1.0], [0.0, 1.0, 0.0], [1.0, 0.0, 1.0]]
    assert np.allclose(np.array(m) @ np.array(K.invert3(m)), np.eye(3))


def test_debounce_rounds_times_as_its_sql_does(spark, tmp_path):
    import duckdb

    from platen import catalogue

    # Gaps within two milliseconds of the wait, at every part of a millisecond, on both sides of the epoch; no time at all.
    c = duckdb.connect()
    c.sql(
        f"""COPY (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE make_timestamp(CASE WHEN user_id % 2 = 0 THEN 1704067200000000 ELSE -9000000000 END + user_id * 37 % 1000
            + CASE WHEN event_id % 2 = 1 THEN 7200000000 + user_id * 91 % 4001 - 2000 ELSE 0 END) END AS ts, user_id
        FROM (SELECT i AS event_id, i // 2 AS user_id FROM range(8000) r(i))) TO '{tmp_path}/events.parquet'"""
    )
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.sql(catalogue.oracle_sql()["cmd_debounce"]).df()
    got = catalogue.queries()["cmd_debounce"](spark, str(tmp_path)).toPandas()
    assert 4000 < len(want) < 8000
    assert rows_of(got) == rows_of(want)
