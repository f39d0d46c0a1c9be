"""Queries over the library view, folders, collections, edits and previews, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import collections as C
from .operators import edits as E
from .operators import library as L
from .operators import previews as P
from .standins import NATION, REGION, Library, sql

TIES = ["rating", "flag", "colour_label", "part_id", "supplier_id", "price"]
#: Whole numbers that may be null are given as doubles, which every reader shows alike.
def _shown() -> list:
    return ["image_id", "file_id", "path", F.col("captured_at").cast("double").alias("captured_at"), F.col("rating").cast("double").alias("rating"), "flag", "colour_label", "price"]

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


_PATH = "regexp_replace(coalesce(last_mount_path, '') || '/' || relative_path || '/' || filename, '/{2,}', '/', 'g')"


def _seen_sql(where: str = "true", within: str = "true") -> str:
    return f""", seen AS (SELECT images.id AS image_id, file_id, {_PATH} AS path, captured_at, filename, rating, flag, colour_label, price, part_id, supplier_id
FROM images JOIN files ON file_id = files.id JOIN folders ON folder_id = folders.id JOIN volumes ON volume_id = volumes.id WHERE NOT missing AND {where} AND {within})"""


_SEEN = "image_id, file_id, path, captured_at::DOUBLE AS captured_at, rating::DOUBLE AS rating, flag, colour_label, price"


def _seen(lib: Library, filter: L.Filter = L.Filter(), within: DataFrame | None = None) -> DataFrame:
    return L.sequence(lib.images, lib.files, lib.folders, lib.volumes, filter, within)


@query(
    "lib_sequence",
    sql(
        _seen_sql()
        + f""" SELECT row_number() OVER (ORDER BY captured_at NULLS LAST, filename, image_id, rating NULLS FIRST, flag NULLS FIRST, colour_label NULLS FIRST, part_id, supplier_id, price) AS place, {_SEEN} FROM seen"""
    ),
)
def lib_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.in_order(_seen(Library(spark, sf_dir)), TIES).select("place", *_shown())


_FILTERS = {
    "pick": (L.Filter(flag="pick"), "flag = 'pick'"),
    "unflagged": (L.Filter(unflagged=True), "flag IS NULL"),
    "rating": (L.Filter(min_rating=3), "rating >= 3"),
    "colour": (L.Filter(colour="red"), "colour_label = 'red'"),
    "all_axes": (L.Filter(flag="reject", min_rating=2, colour="green"), "flag = 'reject' AND rating >= 2 AND colour_label = 'green'"),
    "none": (L.Filter(min_rating=0), "true"),
}
for _name, (_filter, _where) in _FILTERS.items():

    def _filtered(spark: SparkSession, sf_dir: str, f: L.Filter = _filter) -> DataFrame:
        return _seen(Library(spark, sf_dir), f).select(*_shown())

    query(f"lib_filter_{_name}", sql(_seen_sql(_where) + f" SELECT {_SEEN} FROM seen"))(_filtered)


@query(
    "lib_sequence_in_folder",
    sql(
        f""", tree(id) AS (SELECT id FROM folders WHERE id = {NATION + 3} OR id = {REGION + 1} UNION SELECT f.id FROM folders f JOIN tree ON f.parent_id = tree.id)"""
        + _seen_sql("true", "folder_id IN (SELECT id FROM tree)")
        + f" SELECT {_SEEN} FROM seen",
        recursive=True,
    ),
)
def lib_sequence_in_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    below = L.below(lib.folders, lib.folders.where(F.col("id").isin(NATION + 3, REGION + 1))).select("id")
    return _seen(lib, within=below).select(*_shown())


@query("lib_admitted", sql(" SELECT id FROM images WHERE flag = 'pick' AND rating >= 4"))
def lib_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.admitted(Library(spark, sf_dir).images, L.Filter(flag="pick", min_rating=4))


@query("lib_matches", sql(" SELECT images.id, bool_or(coalesce(flag = 'pick', false) AND NOT coalesce(missing, true)) AS found FROM images LEFT JOIN files ON file_id = files.id GROUP BY images.id"))
def lib_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    return L.matches(lib.images, lib.files, L.Filter(flag="pick"))


@query(
    "lib_taken_label",
    sql(
        """ SELECT id, captured_at::DOUBLE AS captured_at, CASE WHEN camera_make IS NULL THEN camera_model WHEN camera_model IS NULL THEN camera_make
    WHEN starts_with(lower(camera_model), lower(camera_make)) THEN camera_model ELSE camera_make || ' ' || camera_model END AS camera FROM files"""
    ),
)
def lib_taken_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Library(spark, sf_dir).files.select("id", F.col("captured_at").cast("double").alias("captured_at"), L.camera_label().alias("camera"))


@query(
    "lib_labels",
    sql(
        r""" SELECT images.id, filename || coalesce(' · ' || copy_name, '') AS label, regexp_replace(filename, '\.[^.]*$', '') || coalesce('-' || regexp_replace(copy_name, '[\s/\\:]', '-', 'g'), '') AS stem
    FROM images JOIN files ON file_id = files.id"""
    ),
)
def lib_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    f = lib.files.select(F.col("id").alias("file_id"), "filename")
    return lib.images.join(f, "file_id").select("id", L.label_of().alias("label"), L.stem_of().alias("stem"))


@query(
    "lib_tally",
    sql(" SELECT count(*) AS total, count(*) FILTER (flag = 'pick') AS picked, count(*) FILTER (flag = 'reject') AS rejected FROM images JOIN files ON file_id = files.id WHERE NOT missing"),
)
def lib_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    return L.tally(lib.images, lib.files)


@query("lib_missing", sql(" SELECT count(*) AS missing FROM images JOIN files ON file_id = files.id WHERE files.missing"))
def lib_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    return L.missing_count(lib.images, lib.files)


@query(
    "lib_cells",
    sql(
        """, wanted AS (SELECT o_orderkey AS ordinal, o_orderkey * 9 + 5 AS id FROM orders),
facts AS (SELECT id, max(rating) AS rating, max(flag) AS flag, max(colour_label) AS colour_label FROM images GROUP BY id)
SELECT ordinal, wanted.id, coalesce(rating, 0) AS rating, coalesce(flag, 'none') AS flag, coalesce(colour_label, 'none') AS colour_label FROM wanted LEFT JOIN facts ON wanted.id = facts.id"""
    ),
)
def lib_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    wanted = lib.raw("orders").select(F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") * 9 + 5).alias("id"))
    return L.cells(lib.images, wanted)


_PLACED = """, placed AS (SELECT id, flag, row_number() OVER (ORDER BY captured_at NULLS LAST, filename, id) - 1 AS place FROM (
    SELECT files.id, captured_at, filename, CASE WHEN size % 3 = 0 THEN 'pick' END AS flag FROM files WHERE NOT missing))"""


def _placed(lib: Library) -> DataFrame:
    f = lib.files.where(~F.col("missing")).select(F.col("id").alias("image_id"), "captured_at", "filename", F.when(F.col("size") % 3 == 0, "pick").alias("flag"))
    return L.ranked(f, [F.col("captured_at").asc_nulls_last(), F.col("filename").asc(), F.col("image_id").asc()], "place", 0)


@query("seq_narrow_cursor", sql(_PLACED + " SELECT coalesce(min(place) FILTER (place >= 500), max(place)) AS cursor FROM placed WHERE flag = 'pick'"))
def seq_narrow_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.narrowed(_placed(Library(spark, sf_dir)).where("flag = 'pick'"), 500)


@query("seq_page", sql(_PLACED + " SELECT place, id FROM placed WHERE place BETWEEN 64 AND 127"))
def seq_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page(_placed(Library(spark, sf_dir)), 64, 64).select("place", F.col("image_id").alias("id"))


@query("seq_swap", sql(_PLACED + " SELECT CASE place WHEN 10 THEN 20 WHEN 20 THEN 10 ELSE place END AS place, id FROM placed"))
def seq_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.swapped(_placed(Library(spark, sf_dir)), "place", 10, 20).select("place", F.col("image_id").alias("id"))


@query("seq_select_range", sql(_PLACED + " SELECT id FROM placed WHERE place BETWEEN least(900, 40) AND greatest(900, 40) OR flag = 'pick'"))
def seq_select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _placed(Library(spark, sf_dir))
    return p.where(F.col("place").between(min(900, 40), max(900, 40)) | F.coalesce(F.col("flag") == "pick", F.lit(False))).select(F.col("image_id").alias("id"))


@query(
    "folder_tree_rollup",
    sql(
        """, up(id, ancestor) AS (SELECT id, id FROM folders UNION SELECT up.id, f.parent_id FROM up JOIN folders f ON f.id = up.ancestor WHERE f.parent_id IS NOT NULL),
own AS (SELECT folder_id, count(*) AS own FROM images JOIN files ON file_id = files.id WHERE NOT missing GROUP BY folder_id),
tot AS (SELECT ancestor, sum(own)::BIGINT AS total FROM up JOIN own ON up.id = own.folder_id GROUP BY ancestor)
SELECT f.id, f.volume_id, f.parent_id::DOUBLE AS parent_id, f.relative_path, coalesce(own, 0) AS own, total FROM folders f JOIN tot ON f.id = tot.ancestor LEFT JOIN own ON own.folder_id = f.id""",
        recursive=True,
    ),
)
def folder_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    return L.folder_tree(lib.folders, lib.files, lib.images).withColumn("parent_id", F.col("parent_id").cast("double"))


# --- collections: a customer is a collection, its orders the members ------------------------------

_MEMBERS = """, members AS (SELECT o_custkey AS collection_id, o_orderkey AS image_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) * 3 AS position FROM orders),
gone AS (SELECT o_orderkey AS image_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)),
colls AS (SELECT c_custkey AS id, ('c' || c_nationkey)::VARCHAR AS name, c_custkey = 7 AS is_quick FROM customer)"""


def _members(lib: Library) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) * 3
    return lib.raw("orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("image_id"), place.cast("long").alias("position"))


def _gone(lib: Library) -> DataFrame:
    return lib.raw("orders").select(F.col("o_orderkey").alias("image_id")).join(lib.raw("lineitem").select(F.col("l_orderkey").alias("image_id")), "image_id", "left_anti")


def _collections(lib: Library) -> DataFrame:
    return lib.raw("customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("name"), (F.col("c_custkey") == 7).alias("is_quick"))


@query(
    "coll_counts",
    sql(
        _MEMBERS
        + """ SELECT colls.id, name, is_quick, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS members FROM colls
LEFT JOIN (SELECT collection_id, count(*) AS n FROM members GROUP BY 1) a ON a.collection_id = colls.id
LEFT JOIN (SELECT collection_id, count(*) AS n FROM members WHERE image_id IN (SELECT image_id FROM gone) GROUP BY 1) b ON b.collection_id = colls.id"""
    ),
)
def coll_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    return C.counts(_collections(lib), _members(lib), _gone(lib))


@query("coll_members", sql(_MEMBERS + " SELECT collection_id, image_id, row_number() OVER (PARTITION BY collection_id ORDER BY position, image_id) AS rank FROM members WHERE image_id NOT IN (SELECT image_id FROM gone)"))
def coll_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    return C.members(_members(lib), _gone(lib))


@query(
    "coll_append_positions",
    sql(
        _MEMBERS
        + """, asked AS (SELECT c_custkey AS collection_id, (c_custkey * 10 + k) % 15000 AS image_id, k AS ordinal FROM customer, range(1, 6) t(k)),
top AS (SELECT collection_id, max(position) AS m FROM members GROUP BY 1)
SELECT a.collection_id, a.image_id, coalesce(m, 0) + ordinal AS position FROM asked a LEFT JOIN top ON top.collection_id = a.collection_id
WHERE a.image_id IN (SELECT o_orderkey FROM orders) AND NOT EXISTS (SELECT 1 FROM members x WHERE x.collection_id = a.collection_id AND x.image_id = a.image_id)"""
    ),
)
def coll_append_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    asked = lib.raw("customer").select(F.col("c_custkey").alias("collection_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("ordinal"))
    asked = asked.withColumn("image_id", (F.col("collection_id") * 10 + F.col("ordinal")) % 15000)
    return C.appended(_members(lib), asked, lib.raw("orders").select(F.col("o_orderkey").alias("image_id")))


_ORDERED = ", listed AS (SELECT collection_id, image_id, row_number() OVER (PARTITION BY collection_id ORDER BY image_id DESC) AS ordinal FROM members WHERE image_id % 2 = 0)"


@query(
    "coll_reorder",
    sql(
        _MEMBERS
        + _ORDERED
        + """, size AS (SELECT collection_id, count(*) AS n FROM listed GROUP BY 1)
SELECT m.collection_id, m.image_id, coalesce(l.ordinal, m.position + coalesce(n, 0)) AS position FROM members m
LEFT JOIN listed l ON l.collection_id = m.collection_id AND l.image_id = m.image_id LEFT JOIN size s ON s.collection_id = m.collection_id"""
    ),
)
def coll_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(Library(spark, sf_dir))
    listed = m.where("image_id % 2 = 0").select("collection_id", "image_id", F.row_number().over(Window.partitionBy("collection_id").orderBy(F.col("image_id").desc())).cast("long").alias("ordinal"))
    return C.reordered(m, listed)


@query(
    "coll_swap",
    sql(
        _MEMBERS
        + """, ends AS (SELECT collection_id, min(position) AS a, max(position) AS b FROM members GROUP BY 1)
SELECT m.collection_id, image_id, CASE position WHEN a THEN b WHEN b THEN a ELSE position END AS position FROM members m JOIN ends e ON e.collection_id = m.collection_id"""
    ),
)
def coll_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(Library(spark, sf_dir))
    ends = m.groupBy("collection_id").agg(F.min("position").alias("a"), F.max("position").alias("b"))
    return m.join(ends, "collection_id").withColumn("position", F.when(F.col("position") == F.col("a"), F.col("b")).when(F.col("position") == F.col("b"), F.col("a")).otherwise(F.col("position"))).drop("a", "b")


@query("coll_holding", sql(_MEMBERS + " SELECT o_orderkey AS image_id, list_sort(list(collection_id))::VARCHAR AS held_by FROM orders JOIN members ON image_id = o_orderkey GROUP BY 1"))
def coll_holding(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = C.holding(_members(Library(spark, sf_dir)))
    return held.select("image_id", F.concat(F.lit("["), F.array_join(F.transform("held_by", lambda x: x.cast("string")), ", "), F.lit("]")).alias("held_by"))


@query("coll_take_out", sql(_MEMBERS + " SELECT collection_id, image_id, position, image_id % 3 = 0 AS removed FROM members"))
def coll_take_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(Library(spark, sf_dir))
    kept, removed = C.taken_out(m, m.where("image_id % 3 = 0").select("collection_id", "image_id"))
    return kept.withColumn("removed", F.lit(False)).unionByName(removed.withColumn("removed", F.lit(True)))


@query(
    "coll_subtree",
    sql(f""", tree(id, depth) AS (SELECT {REGION + 2}::BIGINT, 0 UNION ALL SELECT f.id, depth + 1 FROM folders f JOIN tree ON f.parent_id = tree.id) SELECT id, depth FROM tree""", recursive=True),
)
def coll_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.subtree(Library(spark, sf_dir).folders, REGION + 2)


@query("coll_name_keys", "SELECT c_custkey AS id, lower(trim('  ' || c_name || 'É ')) AS name_key FROM customer")
def coll_name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.paths import name_key

    c = Library(spark, sf_dir).raw("customer")
    return c.select(F.col("c_custkey").alias("id"), name_key(F.concat(F.lit("  "), F.col("c_name"), F.lit("É "))).alias("name_key"))


# --- edits: a user's events are the versions of a document ----------------------------------------

_SAVED = """, saved AS (SELECT user_id AS image_id, ts, event_id, event_type AS content FROM events)"""


def _saved(lib: Library) -> DataFrame:
    return lib.raw("events").select(F.col("user_id").alias("image_id"), "ts", "event_id", F.col("event_type").alias("content"))


_VERSIONS = (
    _SAVED
    + """, fresh AS (SELECT *, lag(content) OVER (PARTITION BY image_id ORDER BY ts, event_id) AS old FROM saved),
versions AS (SELECT image_id, event_id, content, row_number() OVER (PARTITION BY image_id ORDER BY ts, event_id)::INTEGER AS version FROM fresh WHERE old IS DISTINCT FROM content)"""
)


@query("edit_versions", sql(_VERSIONS + " SELECT image_id, version, event_id, content FROM versions"))
def edit_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.versions(_saved(Library(spark, sf_dir)), ["ts", "event_id"]).select("image_id", "version", "event_id", "content")


@query("edit_latest", sql(_VERSIONS + " SELECT image_id, max(version) AS version, arg_max(content, version) AS content FROM versions GROUP BY image_id"))
def edit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latest(E.versions(_saved(Library(spark, sf_dir)), ["ts", "event_id"]))


@query("edit_history", sql(_VERSIONS + " SELECT image_id, string_agg(version || ':' || content, ',' ORDER BY version) AS history FROM versions GROUP BY image_id"))
def edit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.history(E.versions(_saved(Library(spark, sf_dir)), ["ts", "event_id"]))


@query(
    "snapshot_read",
    sql(
        _VERSIONS
        + """, snaps AS (SELECT image_id, max(version) // 2 AS version, 'half' AS name FROM versions GROUP BY image_id)
SELECT s.image_id, s.name, s.version, v.content FROM snaps s JOIN versions v ON v.image_id = s.image_id AND v.version = s.version"""
    ),
)
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = E.versions(_saved(Library(spark, sf_dir)), ["ts", "event_id"])
    snaps = v.groupBy("image_id").agg(F.expr("max(version) div 2").cast("int").alias("version")).withColumn("name", F.lit("half"))
    return E.snapshot_states(snaps, v).select("image_id", "name", "version", "content")


@query(
    "edit_adopt_groups",
    """SELECT a.p_partkey AS id, a.p_size AS tone_a, b.p_size AS tone_b, a.p_brand AS crop_a, a.p_size <> b.p_size AS changed FROM part a JOIN part b ON b.p_partkey = 5""".replace(
        "a.p_size AS tone_a, b.p_size AS tone_b, a.p_brand AS crop_a", "b.p_size AS tone, a.p_brand AS crop, a.p_retailprice AS detail"
    ),
)
def edit_adopt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Library(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_size").alias("tone"), F.col("p_brand").alias("crop"), F.col("p_retailprice").alias("detail")).alias("state"))
    look = part.where("id = 5").select(F.col("state").alias("look"))  # one row
    out = part.crossJoin(F.broadcast(look)).withColumn("new", E.adopt("state", "look", ["tone"]))
    return out.select("id", "new.tone", "new.crop", "new.detail", (~F.col("new").eqNullSafe(F.col("state"))).alias("changed"))


@query("edit_touched_groups", "SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_size <> 11 THEN 'tone' END, CASE WHEN p_brand <> 'Brand#2' THEN 'crop' END], lambda x: x IS NOT NULL), ',') AS touched FROM part")
def edit_touched_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Library(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_size").alias("tone"), F.col("p_brand").alias("crop")).alias("state"))
    return part.select("id", F.array_join(E.touched("state", {"tone": F.lit(11), "crop": F.lit("Brand#2")}), ",").alias("touched"))


@query("preset_json_parse", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.k')::INTEGER BETWEEN 10 AND 90 AS valid FROM events")
def preset_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Library(spark, sf_dir).raw("events").withColumn("doc", F.from_json("props", "k INT"))
    return e.select("event_id", "doc.k", F.col("doc.k").between(10, 90).alias("valid"))


@query(
    "profile_for_image",
    sql(
        """, profiles AS (SELECT split_part(o_orderpriority, '-', 1) AS make, o_orderpriority AS model, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS chosen FROM orders GROUP BY ALL)
SELECT images.id, chosen FROM images JOIN files ON file_id = files.id JOIN profiles ON make = camera_make AND model = camera_model"""
    ),
)
def profile_for_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    picked = lib.raw("orders").groupBy(F.split("o_orderpriority", "-")[0].alias("make"), F.col("o_orderpriority").alias("model"))
    profiles = picked.agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("chosen"))
    return E.profiles_of(lib.images, lib.files, profiles).select("id", "chosen")


@query("copy_next_name", "SELECT l_orderkey AS file_id, min(k) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem) o, range(1, 12) t(k) WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o.l_orderkey AND x.l_linenumber = k) GROUP BY 1")
def copy_next_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Library(spark, sf_dir).raw("lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("n"))
    return E.next_free(li, "file_id", "n")


@query(
    "paste_look",
    sql(
        _VERSIONS
        + """, head AS (SELECT image_id, max(version) AS version, arg_max(content, version) AS content FROM versions GROUP BY 1)
SELECT image_id, version + 1 AS version, 'view' AS content FROM head WHERE content <> 'view' AND image_id % 2 = 0"""
    ),
)
def paste_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = E.latest(E.versions(_saved(Library(spark, sf_dir)), ["ts", "event_id"]))
    return E.pasted(head.where("image_id % 2 = 0"), F.lit("view"))


# --- previews: parts are images, brands renderers --------------------------------------------------

_PREV = """, levels AS (SELECT * FROM (VALUES ('thumb', 256), ('small', 1024), ('standard', 2560)) t(level, edge)),
heads AS (SELECT p_partkey AS image_id, md5(p_name) AS hash FROM part),
previews AS (SELECT p_partkey AS image_id, level, CASE WHEN p_partkey % 3 = 0 THEN md5(p_name) ELSE md5(p_type) END AS hash, CASE WHEN p_size % 2 = 0 THEN 'r1' ELSE 'r0' END AS renderer,
    edge AS width, edge * 2 // 3 AS height, (p_size * 100 + edge)::BIGINT AS bytes FROM part, levels WHERE (p_partkey + edge) % 4 <> 0)"""


def _previews(lib: Library) -> tuple[DataFrame, DataFrame, DataFrame]:
    levels = P.levels(lib.spark)
    part = lib.raw("part")
    heads = part.select(F.col("p_partkey").alias("image_id"), F.md5("p_name").alias("hash"))
    rows = part.crossJoin(F.broadcast(levels)).where("(p_partkey + edge) % 4 <> 0")  # three levels
    previews = rows.select(
        F.col("p_partkey").alias("image_id"),
        "level",
        F.when(F.col("p_partkey") % 3 == 0, F.md5("p_name")).otherwise(F.md5("p_type")).alias("hash"),
        F.when(F.col("p_size") % 2 == 0, "r1").otherwise("r0").alias("renderer"),
        F.col("edge").alias("width"),
        F.expr("edge * 2 div 3").cast("int").alias("height"),
        (F.col("p_size") * 100 + F.col("edge")).cast("long").alias("bytes"),
    )
    return heads, levels, previews


@query(
    "preview_outstanding",
    sql(
        _PREV
        + """ SELECT h.image_id, string_agg(l.level, ',' ORDER BY edge) AS wanted FROM heads h, levels l
WHERE NOT EXISTS (SELECT 1 FROM previews p WHERE p.image_id = h.image_id AND p.level = l.level AND p.hash = h.hash AND p.renderer = 'r1') GROUP BY 1"""
    ),
)
def preview_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, levels, previews = _previews(Library(spark, sf_dir))
    return P.outstanding(heads, levels, previews, "r1")


@query(
    "preview_covering",
    sql(
        _PREV
        + """ SELECT image_id, arg_min(level, greatest(width, height)) AS level, min(greatest(width, height)) AS edge
FROM previews p JOIN heads h USING (image_id) WHERE p.hash = h.hash AND renderer = 'r1' AND greatest(width, height) >= 600 GROUP BY image_id"""
    ),
)
def preview_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, _, previews = _previews(Library(spark, sf_dir))
    return P.covering(previews, heads, "r1", 600)


@query("preview_tally", sql(_PREV + " SELECT count(*) AS previews, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM previews"))
def preview_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tally(_previews(Library(spark, sf_dir))[2])


_LISTED = """, listed AS (SELECT image_id || '-' || level || CASE WHEN image_id % 50 = 0 THEN '.tmp' ELSE '.jpg' END AS path, bytes AS size FROM previews
    UNION ALL SELECT 'orphan-' || p_partkey || '.jpg', p_size::BIGINT FROM part WHERE p_partkey % 7 = 0)"""


@query(
    "preview_sweep",
    sql(_PREV + _LISTED + " SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS freed FROM listed WHERE path LIKE '%.jpg' AND path NOT IN (SELECT image_id || '-' || level || '.jpg' FROM previews WHERE image_id % 5 <> 0)"),
)
def preview_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = Library(spark, sf_dir)
    previews = _previews(lib)[2]
    name = F.concat_ws("-", "image_id", "level")
    listed = previews.select(F.concat(name, F.when(F.col("image_id") % 50 == 0, ".tmp").otherwise(".jpg")).alias("path"), F.col("bytes").alias("size"))
    orphans = lib.raw("part").where("p_partkey % 7 = 0").select(F.concat(F.lit("orphan-"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"), F.col("p_size").cast("long").alias("size"))
    return P.sweep(listed.unionByName(orphans), previews.where("image_id % 5 <> 0").select(F.concat(name, F.lit(".jpg")).alias("path")))


@query("preview_upsert", sql(_PREV + " SELECT image_id, level, CASE WHEN image_id % 2 = 0 THEN 'r2' ELSE renderer END AS renderer FROM previews UNION ALL SELECT image_id, level, 'r2' FROM heads, levels WHERE (image_id + edge) % 4 = 0 AND image_id % 2 = 0"))
def preview_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, levels, previews = _previews(Library(spark, sf_dir))
    new = heads.where("image_id % 2 = 0").crossJoin(F.broadcast(levels)).select("image_id", "level", F.lit("r2").alias("renderer"))  # three levels
    return P.recorded(previews.select("image_id", "level", "renderer"), new)


@query("preview_paths", sql(_PREV + " SELECT image_id, level, lpad(lower(to_hex(image_id % 256)), 2, '0') || '/' || image_id || '-' || level || '-' || hash[1:12] || '.jpg' AS path FROM previews"))
def preview_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _previews(Library(spark, sf_dir))[2].select("image_id", "level", P.relative_path().alias("path"))
