"""Queries of writes to the catalog, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import edits as E
from .operators import mutations as M
from .standins import Library

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def _raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return Library(spark, sf_dir).raw(table)


_IMAGES = "SELECT o_orderkey AS id, (o_orderkey % 6)::INTEGER AS rating, CASE WHEN o_orderkey % 3 = 0 THEN 'pick' END AS flag, o_orderpriority AS colour_label FROM orders"
_MARKS = "SELECT DISTINCT l_orderkey + 100 * (l_orderkey % 50) AS id, CASE WHEN l_orderkey % 4 > 0 THEN (l_orderkey % 8)::INTEGER END AS rating, 'reject' AS flag, NULL::VARCHAR AS colour_label FROM lineitem"
_ONCE = f"SELECT * FROM ({_MARKS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rating NULLS FIRST) = 1"


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o, li = _raw(spark, sf_dir, "orders"), _raw(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    images = o.select(key.alias("id"), (key % 6).cast("int").alias("rating"), F.when(key % 3 == 0, "pick").alias("flag"), F.col("o_orderpriority").alias("colour_label"))
    key = F.col("l_orderkey")
    rating = F.when(key % 4 > 0, (key % 8).cast("int"))
    asked = li.select((key + 100 * (key % 50)).alias("id"), rating.alias("rating")).groupBy("id")
    # Of several wishes for one image the one without stars, or of fewest, counts.
    marks = asked.agg(F.when(F.count("rating") < F.count("*"), F.lit(None)).otherwise(F.min("rating")).alias("rating"))
    return M.judged(images, marks.withColumns({"flag": F.lit("reject"), "colour_label": F.lit(None).cast("string")}))


@query("judge_set", f"WITH i AS ({_IMAGES}), m AS (SELECT * FROM ({_ONCE}) WHERE coalesce(rating, 0) <= 5) SELECT i.id, coalesce(CASE WHEN m.id IS NULL THEN i.rating ELSE m.rating END, -1) AS rating, coalesce(CASE WHEN m.id IS NULL THEN i.flag ELSE m.flag END, '') AS flag, coalesce(CASE WHEN m.id IS NULL THEN i.colour_label END, '') AS colour_label FROM i LEFT JOIN m ON i.id = m.id")
def judge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[0].fillna({"rating": -1, "flag": "", "colour_label": ""})


@query("judge_refused", f"WITH i AS ({_IMAGES}), m AS ({_ONCE}) SELECT id, CASE WHEN rating > 5 THEN 'too many stars' ELSE 'no such image' END AS reason FROM m WHERE rating > 5 OR id NOT IN (SELECT id FROM i)")
def judge_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[1]


_SETS = "SELECT c_custkey AS id, c_nationkey::BIGINT AS parent_id, c_name AS name, lower(c_name) AS name_key FROM customer"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _raw(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("parent_id"), F.col("c_name").alias("name"), F.lower("c_name").alias("name_key"))


@query("coll_create", f"{_SETS} UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + s_suppkey, s_nationkey, s_name, lower(s_name) FROM supplier WHERE s_suppkey % 10 <> 0")
def coll_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _raw(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 10 == 0, " \t").otherwise(F.concat(F.lit("  "), "s_name", F.lit(" ")))
    return M.created(_sets(spark, sf_dir), s.select(F.col("s_suppkey").alias("n"), F.col("s_nationkey").alias("parent_id"), name.alias("name")))


@query("coll_rename", f"SELECT c.id, parent_id, coalesce(s_name, c.name) AS name, lower(coalesce(s_name, c.name)) AS name_key FROM ({_SETS}) c LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON s_suppkey = c.id")
def coll_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _raw(spark, sf_dir, "supplier")
    return M.renamed(_sets(spark, sf_dir), s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 10 == 0, "").otherwise(F.concat("s_name", F.lit("\n"))).alias("name")))


def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("image_id"), F.col("p_size").alias("version"))


_GONE = "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("image_id"))


@query("forget_left", f"SELECT p_name AS name, p_partkey AS image_id, p_size AS version FROM part WHERE NOT {_GONE}")
def forget_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.forgotten(_presets(spark, sf_dir), _asked(spark, sf_dir), ["image_id"])[0].select("name", "image_id", "version")


@query("forget_keeping", f"SELECT p_name AS name, p_partkey AS image_id, p_size AS version FROM part WHERE {_GONE}")
def forget_keeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.forgotten(_presets(spark, sf_dir), _asked(spark, sf_dir), ["image_id"])[1].select("name", "image_id", "version")


def _returned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left, gone = M.forgotten(_presets(spark, sf_dir), _asked(spark, sf_dir), ["image_id"])
    since = gone.where("image_id % 2 = 0").select(F.lit("new").alias("name"), "image_id", F.lit(0).alias("version"))
    return M.put_back(left.select("name", "image_id", "version").unionByName(since), gone.select("name", "image_id", "version"), ["image_id"])


@query("put_back", f"SELECT CASE WHEN {_GONE} AND p_partkey % 2 = 0 THEN 'new' ELSE p_name END AS name, p_partkey AS image_id, CASE WHEN {_GONE} AND p_partkey % 2 = 0 THEN 0 ELSE p_size END AS version FROM part")
def put_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returned(spark, sf_dir)[0].select("name", "image_id", "version")


@query("put_back_refused", f"SELECT p_name AS name, p_partkey AS image_id, p_size AS version FROM part WHERE {_GONE} AND p_partkey % 2 = 0")
def put_back_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returned(spark, sf_dir)[1].select("name", "image_id", "version")


_CHOICES = "SELECT p_brand AS make, p_type AS model, arg_max(p_name, p_partkey) AS path FROM part GROUP BY ALL"


@query("profile_remember", f"WITH old AS ({_CHOICES}) SELECT make, model, CASE WHEN make = 'Brand#11' OR length(make) % 2 = 1 THEN 'chosen/' || model ELSE path END AS path FROM old")
def profile_remember(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera's newer choice replaces its older one."""
    p = _raw(spark, sf_dir, "part")
    old = p.groupBy(F.col("p_brand").alias("make"), F.col("p_type").alias("model")).agg(F.max_by("p_name", "p_partkey").alias("path"))
    new = old.where("make = 'Brand#11' OR length(make) % 2 = 1").select("make", "model", F.concat(F.lit("chosen/"), "model").alias("path"))
    return E.merged(old, new, ["make", "model"]).select("make", "model", "path")


@query("profile_chosen", f"WITH p AS ({_CHOICES}) SELECT s_suppkey AS id, c.make, c.model, path FROM (SELECT s_suppkey, 'Brand#' || (s_suppkey % 60) AS make, (SELECT min(p_type) FROM part) AS model FROM supplier) c LEFT JOIN p ON p.make = c.make AND p.model = c.model")
def profile_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _raw(spark, sf_dir, "part")
    profiles = p.groupBy(F.col("p_brand").alias("make"), F.col("p_type").alias("model")).agg(F.max_by("p_name", "p_partkey").alias("path"))
    kind = F.broadcast(p.agg(F.min("p_type").alias("model")))  # one row
    cameras = _raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("make")).crossJoin(kind)
    return M.chosen(profiles, cameras).select("id", "make", "model", "path")


@query("seq_marked", "SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')".replace("FROM orders WHERE o_orderkey IN", "FROM orders QUALIFY o_orderkey IN"))
def seq_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = _raw(spark, sf_dir, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    marks = _raw(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return M.marked(o.select(F.col("o_orderkey").alias("id"), place.alias("position")), marks)
