"""Queries of volumes, backups, viewports, formats, lights and grain, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colour as C
from .functions import places as P
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


_SPELL = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '\\\\?\\UNC\\nas\\' WHEN 1 THEN '\\\\?\\C:\\' WHEN 2 THEN '\\\\nas' || (p_partkey % 7) || '\\' WHEN 3 THEN '\\\\.\\' ELSE '' END || p_name AS path FROM part"""


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _raw(spark, sf_dir, "part"), F.col("p_partkey") % 5
    nas = F.concat(F.lit("\\\\nas"), (F.col("p_partkey") % 7).cast("string"), F.lit("\\"))
    head = F.when(k == 0, "\\\\?\\UNC\\nas\\").when(k == 1, "\\\\?\\C:\\").when(k == 2, nas).when(k == 3, "\\\\.\\").otherwise("")
    return p.select(F.col("p_partkey").alias("id"), F.concat(head, "p_name").alias("path"))


@query("volume_plain_path", f"""SELECT id, CASE WHEN starts_with(path, '\\\\?\\UNC\\') THEN '\\\\' || substr(path, 9) WHEN starts_with(path, '\\\\?\\') THEN substr(path, 5) ELSE path END AS plain FROM ({_SPELL})""")
def volume_plain_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelt(spark, sf_dir).select("id", P.plain_path(F.col("path")).alias("plain"))


@query(
    "volume_share",
    f"""SELECT id, CASE WHEN fine THEN parts[1] END AS host, CASE WHEN fine THEN parts[2] END AS share FROM (SELECT id, parts, starts_with(path, '\\\\') AND NOT starts_with(path, '\\\\?\\') AND NOT starts_with(path, '\\\\.\\') AND len(parts) >= 2 AS fine
FROM (SELECT id, path, list_filter(string_split(substr(path, 3), '\\'), lambda x: x <> '') AS parts FROM ({_SPELL})))""",
)
def volume_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, share = P.share_of(F.col("path"))
    return _spelt(spark, sf_dir).select("id", host.alias("host"), share.alias("share"))


@query(
    "volume_mount",
    """WITH p AS (SELECT c_custkey AS id, '/n' || c_nationkey || '/' || c_mktsegment || '/' || c_name AS path FROM customer),
m AS (SELECT 'root' AS device, '/' AS mount UNION ALL SELECT 'd' || n_nationkey, '/n' || n_nationkey FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 's' || n_nationkey, '/n' || n_nationkey || '/BUILDING' FROM nation WHERE n_regionkey < 2)
SELECT id, path, device, mount FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(mount) DESC) AS k FROM p JOIN m ON mount = '/' OR path = mount OR starts_with(path, mount || '/')) WHERE k = 1""",
)
def volume_mount(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _raw(spark, sf_dir, "customer"), _raw(spark, sf_dir, "nation")
    path = F.concat(F.lit("/n"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment", F.lit("/"), "c_name")
    at = F.concat(F.lit("/n"), F.col("n_nationkey").cast("string"))
    mounts = spark.createDataFrame([("root", "/")], "device string, mount string")
    mounts = mounts.unionByName(n.where("n_regionkey < 3").select(F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("device"), at.alias("mount")))
    mounts = mounts.unionByName(n.where("n_regionkey < 2").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("device"), F.concat(at, F.lit("/BUILDING")).alias("mount")))
    return P.mounts_of(c.select(F.col("c_custkey").alias("id"), path.alias("path")), mounts)


_FILES = "SELECT 'shop' || CASE WHEN o_orderkey % 9 = 0 THEN '_' ELSE '-' END || strftime(o_orderdate + INTERVAL (o_orderkey % 86400) SECOND, '%Y-%m-%dT%H-%M-%SZ') || CASE WHEN o_orderkey % 7 = 0 THEN '.tmp' ELSE '.bak' END AS name FROM orders"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _raw(spark, sf_dir, "orders")
    at = F.unix_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss") + F.col("o_orderkey") % 86400
    return o.select(F.concat(F.lit("shop"), F.when(F.col("o_orderkey") % 9 == 0, "_").otherwise("-"), P.stamp(at), F.when(F.col("o_orderkey") % 7 == 0, ".tmp").otherwise(".bak")).alias("name"))


@query("backup_names", f"SELECT name, regexp_full_match(name, 'shop-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}Z[.]bak') AS ours FROM ({_FILES})")
def backup_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("name", P.is_snapshot(F.col("name"), "shop", ".bak").alias("ours"))


@query("backup_prune", f"SELECT name FROM (SELECT DISTINCT name, dense_rank() OVER (ORDER BY name DESC) AS k FROM ({_FILES}) WHERE regexp_full_match(name, 'shop-.{{19}}Z[.]bak')) WHERE k > 10")
def backup_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pruned(_files(spark, sf_dir).distinct(), "shop", ".bak")


@query(
    "format_and_turn",
    """SELECT p_partkey AS id, CASE lower(e) WHEN 'jpg' THEN 'jpeg' WHEN 'jpeg' THEN 'jpeg' WHEN 'png' THEN 'png16' WHEN 'tif' THEN 'tiff16' WHEN 'tiff' THEN 'tiff16' END AS format, CASE p_size % 8 WHEN 3 THEN 'rotate180' WHEN 5 THEN 'rotate270' WHEN 6 THEN 'rotate90' ELSE 'as_shot' END AS orientation
FROM (SELECT *, ['JPG', 'jpeg', 'Png', 'tif', 'TIFF', 'webp'][p_partkey % 6 + 1] AS e FROM part)""",
)
def format_and_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.element_at(F.array(*[F.lit(x) for x in ("JPG", "jpeg", "Png", "tif", "TIFF", "webp")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), P.export_format(e).alias("format"), P.orientation(F.col("p_size") % 8).alias("orientation"))


_VIEWS = "SELECT p_partkey AS id, p_size * 37.0::DOUBLE AS c, (p_partkey % 3) * 400 AS size, 0.1::DOUBLE + p_size / 25.0::DOUBLE AS scale, p_size * 90 + 10 AS extent, p_partkey % 900 + 1 AS other FROM part"


@query(
    "viewport",
    f"""SELECT id, c + (100 - size / 2.0) / scale AS at, greatest(c + (0 - size / 2.0) / scale, 0) AS low, least(c + (size - size / 2.0) / scale, extent) AS high,
CASE WHEN size <> 0 THEN least(size / extent, size / other) END AS fit, CASE WHEN size / (2 * scale) * 2 >= extent THEN extent / 2.0 ELSE least(greatest(c, size / (2 * scale)), extent - size / (2 * scale)) END AS held,
least(greatest(c, 0), extent) AS loose, (SELECT min(k) FROM range(0, 20) t(k) WHERE 64 * pow(2, k) >= greatest(extent, other))::INTEGER AS levels FROM ({_VIEWS})""",
)
def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _raw(spark, sf_dir, "part")
    v = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 37.0).alias("c"), ((F.col("p_partkey") % 3) * 400).alias("size"), (F.col("p_size") / 25.0 + 0.1).alias("scale"), (F.col("p_size") * 90 + 10).alias("extent"), (F.col("p_partkey") % 900 + 1).alias("other"))
    c, size, scale, extent, other = (F.col(x) for x in ("c", "size", "scale", "extent", "other"))
    low, high = P.visible_span(c, size, scale, extent)
    return v.select(
        "id", P.image_at(c, F.lit(100.0), size, scale).alias("at"), low.alias("low"), high.alias("high"), P.fit_scale(size, size, extent, other).alias("fit"),
        P.clamped_center(c, size, scale, extent).alias("held"), P.clamped_center(c, size, scale, extent, True).alias("loose"), P.max_level(extent, other, 64).alias("levels"),
    )


_CUBE = "CASE WHEN pow({0}, 3) > 216 / 24389.0::DOUBLE THEN pow({0}, 3) ELSE (116 * {0} - 16) * 27 / 24389.0::DOUBLE END"


@query(
    "lab_inverse",
    f"""SELECT id, {_CUBE.format('(y + a / 500)')} * 0.9642 AS x, {_CUBE.format('y')} * 1.0 AS y, {_CUBE.format('(y - b / 200)')} * 0.8249 AS z
FROM (SELECT p_partkey AS id, (p_size * 2 + 16) / 116.0::DOUBLE AS y, (p_partkey % 101 - 50)::DOUBLE AS a, (p_partkey % 83 - 41)::DOUBLE AS b FROM part)""",
)
def lab_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    x, y, z = C.lab_inverse((F.col("p_size") * 2.0, (key % 101 - 50).cast("double"), (key % 83 - 41).cast("double")))
    return _raw(spark, sf_dir, "part").select(key.alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))


def _locus(t: str) -> str:
    """SQL of (u, v) from a temperature's name."""
    i, (xa, xb), (ya, yb, yc) = f"(1000 / {t})", C.LOCUS_X, C.LOCUS_Y

    def cubic(x: str, c) -> str:
        return f"((({c[0]}::DOUBLE * {x} + {c[1]}::DOUBLE) * {x} + {c[2]}::DOUBLE) * {x} + {c[3]}::DOUBLE)"

    return f"""SELECT id, tint, kelvin, 4 * px / (-2 * px + 12 * py + 3) AS u, 6 * py / (-2 * px + 12 * py + 3) AS v FROM (SELECT *, CASE WHEN {t} < 2222 THEN {cubic('px', ya)} WHEN {t} < 4000 THEN {cubic('px', yb)} ELSE {cubic('px', yc)} END AS py
FROM (SELECT *, CASE WHEN {t} < 4000 THEN {cubic(i, xa)} ELSE {cubic(i, xb)} END AS px FROM w))"""


@query(
    "white_point",
    f"""WITH w AS (SELECT id, tint, k AS kelvin, greatest(k * 0.999::DOUBLE, 1667) AS lo, least(k * 1.001::DOUBLE, 25000) AS hi FROM (SELECT p_partkey AS id, (p_partkey % 301 - 150)::DOUBLE AS tint, least(greatest(1500::DOUBLE + p_partkey * 13 % 24000, 1667), 25000)::DOUBLE AS k FROM part)),
a AS ({_locus('kelvin')}), l AS ({_locus('lo')}), h AS ({_locus('hi')}),
n AS (SELECT a.id, a.u, a.v, a.tint / 3000 / greatest(sqrt(pow(h.u - l.u, 2) + pow(h.v - l.v, 2)), 1e-9) AS s, h.u - l.u AS du, h.v - l.v AS dv FROM a JOIN l ON a.id = l.id JOIN h ON a.id = h.id),
c AS (SELECT id, 3 * pu / (2 * pu - 8 * pv + 4) AS cx, 2 * pv / (2 * pu - 8 * pv + 4) AS cy FROM (SELECT id, u - dv * s AS pu, v + du * s AS pv FROM n))
SELECT id, cx / cy AS x, 1.0::DOUBLE AS y, (1 - cx - cy) / cy AS z FROM c""",
)
def white_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    lights = _raw(spark, sf_dir, "part").select(key.alias("id"), (key * 13 % 24000 + 1500.0).alias("kelvin"), (key % 301 - 150).cast("double").alias("tint"))
    return C.white_point(lights, "kelvin", "tint").select("id", "x", "y", "z")


@query(
    "chromaticity",
    f"""SELECT p_partkey AS id, CASE WHEN d = 0 THEN 0 ELSE 4 * a / d END AS u, CASE WHEN d = 0 THEN 0 ELSE 6 * b / d END AS v, CASE p_size % 25 {' '.join(f'WHEN {k} THEN {v}' for k, v in C.ILLUMINANTS.items())} ELSE 6504 END::DOUBLE AS kelvin
FROM (SELECT *, a + 15 * b + 3 * c AS d FROM (SELECT *, (p_partkey % 7) / 7.0::DOUBLE AS a, (p_partkey % 5) / 5.0::DOUBLE AS b, (p_partkey % 3) / 3.0::DOUBLE AS c FROM part))""",
)
def chromaticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    u, v = C.uv_of((key % 7 / 7.0, key % 5 / 5.0, key % 3 / 3.0))
    return _raw(spark, sf_dir, "part").select(key.alias("id"), u.alias("u"), v.alias("v"), C.illuminant_kelvin(F.col("p_size") % 25).alias("kelvin"))


@query(
    "grain",
    """WITH p AS (SELECT p_partkey AS id, p_size * 0.37::DOUBLE AS x, (p_partkey % 97) * 0.53::DOUBLE AS y FROM part),
n AS (SELECT id, i, j, x - floor(x) AS fx, y - floor(y) AS fy, (floor(x) + i) * 0.1031 - floor((floor(x) + i) * 0.1031) AS a, (floor(y) + j) * 0.103 - floor((floor(y) + j) * 0.103) AS b FROM p, range(0, 2) t(i), range(0, 2) s(j)),
h AS (SELECT *, (a + b + 2 * t) * (a + t) AS g FROM (SELECT *, a * (b + 33.33) + b * (a + 33.33) AS t FROM n)),
w AS (SELECT *, (CASE WHEN i = 0 THEN 1 - fx * fx * (3 - 2 * fx) ELSE fx * fx * (3 - 2 * fx) END) * (CASE WHEN j = 0 THEN 1 - fy * fy * (3 - 2 * fy) ELSE fy * fy * (3 - 2 * fy) END) AS weight FROM h)
SELECT id, sum((g - floor(g)) * weight) AS noise FROM w GROUP BY id""",
)
def grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return _raw(spark, sf_dir, "part").select(key.alias("id"), C.value_noise(F.col("p_size") * 0.37, (key % 97) * 0.53).alias("noise"))
