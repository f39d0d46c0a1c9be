import pytest
from pyspark.sql import functions as F

from platen import schema
from platen.store import Refused, TableStore, migrated


def rows(spark, name, *values):
    return spark.createDataFrame([v + (None,) * (len(schema.table(name)) - len(v)) for v in values], schema.table(name))


def test_commits_are_whole_and_checked(spark, tmp_path):
    s = TableStore(spark, str(tmp_path))
    assert s.table("images").count() == 0
    base = {
        "volumes": rows(spark, "volumes", (1, "fixed")),
        "folders": rows(spark, "folders", (1, 1, None, "a", "a"), (2, 1, 1, "a/b", "a/b")),
        "files": rows(spark, "files", (10, 2, "x.arw", "x.arw"), (11, 1, "y.arw", "y.arw")),
        "images": rows(spark, "images", (100, 10), (101, 11)),
    }
    assert s.commit(base) == 1 and s.check() == []
    with pytest.raises(Refused, match="file_id"):
        s.commit({"images": rows(spark, "images", (100, 99))})
    with pytest.raises(Refused, match="repeats"):
        s.commit({"files": rows(spark, "files", (10, 2, "x.arw", "x.arw"), (10, 1, "z.arw", "z.arw"))})
    assert s.manifest()["version"] == 1 and s.table("images").count() == 2
    s.commit(s.deleted("files", s.table("files").where("id = 10")))
    assert [r.id for r in s.table("images").collect()] == [101] and s.table("images", 1).count() == 2


def test_migrations(spark, tmp_path):
    s = TableStore(spark, str(tmp_path))
    s.commit({"volumes": rows(spark, "volumes", (1, "fixed"))})
    steps = [(5, lambda t: {}), (6, lambda t: {"volumes": t["volumes"].withColumn("label", F.lit("new"))})]
    assert migrated(s, steps, 5) == 6 and s.table("volumes").first().label == "new"
    with pytest.raises(Refused):
        migrated(s, [(1, lambda t: {}), (3, lambda t: {})], 0)
    with pytest.raises(Refused):
        migrated(s, steps, 9)
