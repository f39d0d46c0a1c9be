"""The plans that scale depends on."""

from pyspark.sql import functions as F

from platen.functions import colour as K
from platen.operators import library as L
from platen.operators import raster as R
from platen.standins import Library


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_a_filter_needs(spark, sf_dir, tmp_path):
    Library(spark, sf_dir).images.write.parquet(str(tmp_path / "images"))
    p = plan(L.admitted(spark.read.parquet(str(tmp_path / "images")), L.Filter(flag="pick", min_rating=2)))
    assert "EqualTo(flag,pick)" in p and "GreaterThanOrEqual(rating,2)" in p
    assert "Exchange" not in p and "price" not in p and "copy_name" not in p


def test_stencils_and_colours_need_no_exchange(spark, sf_dir):
    tiles = Library(spark, sf_dir).raw("embeddings").select(F.col("embedding").cast("array<double>").alias("t"))
    assert "Exchange" not in plan(tiles.select(R.stencil(F.col("t"), 8, 8, R.box(1))))
    px = spark.range(10).select(*[(F.col("id") / 10).alias(c) for c in "rgb"])
    p = plan(K.graded(K.mixed_bands(px, [(0.1, 0.1, 0.1)] * 8), (10.0, 0.1, 0.1), (20.0, 0.1, 0.1), (30.0, 0.1, 0.1)))
    assert "Exchange" not in p and "Python" not in p


def test_aggregates_count_before_they_shuffle(spark, sf_dir):
    p = plan(L.tally(Library(spark, sf_dir).images, Library(spark, sf_dir).files))
    assert "partial_count" in p
    p = plan(R.histogram(spark.range(100), {"a": F.col("id") % 7}))
    assert "partial_count" in p


def test_no_query_of_the_library_collects_a_product(spark, sf_dir):
    from platen import catalogue

    for name in ("lib_filter_all_axes", "coll_counts", "coll_reorder", "edit_latest", "scan_classify", "relink_unique", "profile_for_image"):
        assert "CartesianProduct" not in plan(catalogue.queries()[name](spark, sf_dir)), name


def test_output_names_are_distinct(spark):
    from platen.plans import export

    wanted = [(1, "a"), (2, "a"), (3, "a-2"), (4, "A"), (5, "b"), (6, "a-2"), (7, "a-2-2"), (8, "b-3"), (9, "b"), (10, "b")]
    taken, want = set(), {}
    for i, stem in wanted:
        n = 1
        while (name := stem if n == 1 else f"{stem}-{n}").lower() in taken:
            n += 1
        taken.add(name.lower())
        want[i] = f"{name}.jpg"
    got = {r.id: r.output for r in export.names(spark.createDataFrame(wanted, "id long, stem string").repartition(3)).collect()}
    assert got == want and got[2] == "a-2.jpg" and got[3] == "a-2-2.jpg"
    assert export.names(spark.createDataFrame([], "id long, stem string")).count() == 0


def test_placed_names_are_free(spark):
    from platen.operators import ingest

    there = [("f", "C.ARW", "x"), ("f", "C-2.ARW", "y"), ("g", "C.ARW", "x"), ("f", "Z.ARW", "q")]
    card = [(1, "f", "C.ARW", "new"), (2, "f", "C.ARW", "y"), (3, "f", "C.ARW", "new"), (4, "f", "D.ARW", "x"), (5, "f", "D.ARW", "q"), (6, "g", "C.ARW", "x"), (7, "f", "C-3.ARW", "other"), (8, "f", "plain", "p"), (9, "f", "plain", "r")]
    schema = "folder string, name string, content_hash string"
    held = {(f, n): h for f, n, h in there}
    want = {}
    for i, f, n, h in card:
        target, k = n, 1
        while (f, target) in held and held[f, target] != h:
            k += 1
            stem, _, ext = n.rpartition(".") if "." in n else (n, "", "arw")
            target = f"{stem}-{k}.{ext}"
        want[i] = (None, True) if (f, target) in held else (target, False)
        held.setdefault((f, target), h)
    got = {r.id: (r.placed, r.already) for r in ingest.placed(spark.createDataFrame(card, "id long, " + schema).repartition(2), spark.createDataFrame(there, schema)).collect()}
    assert got == want and got[1] == ("C-3.ARW", False) and got[2] == (None, True) and got[4] == ("D.ARW", False)
