"""The catalog's tables, built from the star-schema tables the queries run on.

Region, nation and customer make a forest of folders on volumes; orders are
files, line items images, events edit versions, parts previews.
``SQL`` has the same tables as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATION, REGION = 10_000_000, 20_000_000


class Library:
    """The stand-in tables over one folder of Parquet files; each is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def volumes(self) -> DataFrame:
        key = F.col("r_regionkey").cast("long")
        return self.raw("region").select(
            key.alias("id"),
            F.col("r_name").alias("label"),
            F.when(key != 3, F.concat(F.lit("/mnt/"), F.lower("r_name"))).alias("last_mount_path"),
        )

    @property
    def folders(self) -> DataFrame:
        region, nation, customer = self.raw("region"), self.raw("nation"), self.raw("customer")
        place = nation.select(F.col("n_nationkey").cast("long").alias("nk"), F.col("n_regionkey").cast("long").alias("rk"), F.lower("n_name").alias("path"))
        roots = region.select((F.lit(REGION) + F.col("r_regionkey")).cast("long").alias("id"), F.col("r_regionkey").cast("long").alias("volume_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("").alias("relative_path"))
        middle = place.select((F.lit(NATION) + F.col("nk")).alias("id"), F.col("rk").alias("volume_id"), (F.lit(REGION) + F.col("rk")).alias("parent_id"), F.col("path").alias("relative_path"))
        leaves = customer.join(F.broadcast(place), F.col("c_nationkey") == F.col("nk")).select(  # as many rows as there are nations
            F.col("c_custkey").alias("id"), F.col("rk").alias("volume_id"), (F.lit(NATION) + F.col("nk")).alias("parent_id"), F.concat("path", F.lit("/"), "c_name").alias("relative_path")
        )
        return roots.unionByName(middle).unionByName(leaves)

    @property
    def files(self) -> DataFrame:
        key = F.col("o_orderkey")
        taken = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
        return self.raw("orders").select(
            key.alias("id"),
            F.col("o_custkey").alias("folder_id"),
            F.concat(F.lit("IMG_"), F.lpad(key.cast("string"), 8, "0"), F.lit(".ARW")).alias("filename"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("size"),
            F.when(key % 7 != 0, taken).alias("captured_at"),
            F.when(key % 11 != 0, F.split("o_orderpriority", "-")[0]).alias("camera_make"),
            F.when(key % 13 != 0, F.col("o_orderpriority")).alias("camera_model"),
            ((F.col("o_orderstatus") == "F") & (key % 5 == 0)).alias("missing"),
        )

    @property
    def images(self) -> DataFrame:
        q = F.col("l_quantity")
        return self.raw("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
            F.col("l_orderkey").alias("file_id"),
            F.when(q > 10, F.floor(q / 10)).cast("int").alias("rating"),
            F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "pick").alias("flag"),
            F.when(F.col("l_partkey") % 13 == 0, "red").when(F.col("l_partkey") % 17 == 0, "green").alias("colour_label"),
            (F.col("l_linenumber") > 1).alias("is_virtual_copy"),
            F.when(F.col("l_linenumber") > 1, F.concat(F.lit("copy "), (F.col("l_linenumber") - 1).cast("string"))).alias("copy_name"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_extendedprice").alias("price"),
        )


#: The same as DuckDB expressions, to stand after WITH.
SQL = f"""volumes AS (SELECT r_regionkey::BIGINT AS id, r_name AS label, CASE WHEN r_regionkey <> 3 THEN '/mnt/' || lower(r_name) END AS last_mount_path FROM region),
folders AS (SELECT ({REGION} + r_regionkey)::BIGINT AS id, r_regionkey::BIGINT AS volume_id, NULL::BIGINT AS parent_id, '' AS relative_path FROM region
    UNION ALL SELECT ({NATION} + n_nationkey)::BIGINT, n_regionkey::BIGINT, ({REGION} + n_regionkey)::BIGINT, lower(n_name) FROM nation
    UNION ALL SELECT c_custkey, n_regionkey::BIGINT, ({NATION} + n_nationkey)::BIGINT, lower(n_name) || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
files AS (SELECT o_orderkey AS id, o_custkey AS folder_id, 'IMG_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.ARW' AS filename, round(o_totalprice * 100)::BIGINT AS size,
    CASE WHEN o_orderkey % 7 <> 0 THEN epoch(o_orderdate)::BIGINT END AS captured_at,
    CASE WHEN o_orderkey % 11 <> 0 THEN string_split(o_orderpriority, '-')[1] END AS camera_make,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS camera_model,
    (o_orderstatus = 'F' AND o_orderkey % 5 = 0) AS missing FROM orders),
images AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS file_id, CASE WHEN l_quantity > 10 THEN floor(l_quantity / 10)::INTEGER END AS rating,
    CASE l_returnflag WHEN 'R' THEN 'reject' WHEN 'A' THEN 'pick' END AS flag,
    CASE WHEN l_partkey % 13 = 0 THEN 'red' WHEN l_partkey % 17 = 0 THEN 'green' END AS colour_label,
    l_linenumber > 1 AS is_virtual_copy, CASE WHEN l_linenumber > 1 THEN 'copy ' || (l_linenumber - 1)::VARCHAR END AS copy_name,
    l_partkey AS part_id, l_suppkey AS supplier_id, l_extendedprice AS price FROM lineitem)"""


def sql(body: str, recursive: bool = False) -> str:
    """``body`` with the stand-in tables before it; body may go on with further expressions after a comma."""
    return f"WITH {'RECURSIVE ' * recursive}{SQL}{body}"
