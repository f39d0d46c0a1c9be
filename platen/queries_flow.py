"""Queries of scans, ingest, sessions, streaming and export plans, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as N
from .operators import ingest as I
from .operators import session as S
from .plans import export as X
from .standins import Library, sql
from .streaming import debounce as D

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# --- scanning: documents are files; those of some ids are known from before -------------------------

_FILES = """listed AS (SELECT source || '/' || lang || '/' || doc_id || '.ARW' AS path, n_chars AS size, doc_id * 60 AS mtime, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 10 <> 3),
known AS (SELECT source || '/' || lang || '/' || doc_id || '.ARW' AS path, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id * 60 END AS mtime,
    sha256(coalesce(text, '')) AS content_hash, false AS missing FROM documents WHERE doc_id % 10 <> 5)"""


def _files(lib: Library) -> tuple[DataFrame, DataFrame]:
    d = lib.raw("documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".ARW")))
    hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    listed = d.where("doc_id % 10 <> 3").select(path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 60).alias("mtime"), hash.alias("content_hash"))
    known = d.where("doc_id % 10 <> 5").select(
        path.alias("path"),
        F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"),
        F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.col("doc_id") * 60).alias("mtime"),
        hash.alias("content_hash"),
        F.lit(False).alias("missing"),
    )
    return listed, known


@query(
    "scan_classify",
    f"""WITH {_FILES} SELECT coalesce(l.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'missing' WHEN l.size = k.size AND l.mtime = k.mtime THEN 'unchanged' ELSE 'updated' END AS action
FROM listed l FULL JOIN known k ON l.path = k.path""",
)
def scan_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.classified(*_files(Library(spark, sf_dir)))


@query(
    "scan_merge",
    f"""WITH {_FILES} SELECT coalesce(l.path, k.path) AS path, coalesce(l.size, k.size) AS size, coalesce(l.mtime, k.mtime) AS mtime,
CASE WHEN k.path IS NULL OR (l.path IS NOT NULL AND NOT (l.size = k.size AND l.mtime = k.mtime)) THEN NULL ELSE k.content_hash END AS content_hash, l.path IS NULL AS missing FROM listed l FULL JOIN known k ON l.path = k.path""",
)
def scan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, known = _files(Library(spark, sf_dir))
    return I.merged(known, listed.drop("content_hash"))


@query(
    "scan_mark_missing",
    f"""WITH {_FILES} SELECT path, (path = 'src1' OR starts_with(path, 'src1/')) AND path NOT IN (SELECT path FROM listed) AS missing FROM known""",
)
def scan_mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, known = _files(Library(spark, sf_dir))
    return I.marked_missing(known, listed, "src1").select("path", "missing")


@query("hash_content", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def hash_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Library(spark, sf_dir).raw("documents").select("doc_id", I.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query("hash_duplicates", "SELECT sha256(coalesce(text, '')) AS hash, count(*) AS files, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Library(spark, sf_dir).raw("documents").select("doc_id", I.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("files"), F.min("doc_id").alias("first")).where("files > 1")


@query(
    "relink_unique",
    """WITH f AS (SELECT doc_id, source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS h FROM documents),
miss AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE h END AS h FROM f WHERE doc_id % 3 = 0), cand AS (SELECT path, h FROM f WHERE doc_id % 3 <> 0), held AS (SELECT path FROM f WHERE doc_id % 12 = 1),
first AS (SELECT h, min(path) AS path FROM cand WHERE path NOT IN (SELECT path FROM held) GROUP BY h), twins AS (SELECT h, count(*) AS n FROM miss WHERE h IS NOT NULL GROUP BY h)
SELECT id, CASE WHEN m.h IS NOT NULL AND first.path IS NOT NULL AND n = 1 THEN first.path END AS path,
CASE WHEN m.h IS NULL THEN 'unhashed' WHEN first.path IS NULL THEN 'still_missing' WHEN n > 1 THEN 'ambiguous' ELSE 'relinked' END AS outcome
FROM miss m LEFT JOIN first ON first.h = m.h LEFT JOIN twins ON twins.h = m.h""",
)
def relink_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Library(spark, sf_dir).raw("documents")
    f = d.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    missing = f.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 0, F.col("content_hash")).alias("content_hash"))
    return I.relinked(missing, f.where("doc_id % 3 <> 0").select("path", "content_hash"), f.where("doc_id % 12 = 1"))


@query("ingest_day_folder", sql(" SELECT id, coalesce(strftime(to_timestamp(captured_at) AT TIME ZONE 'UTC', '%Y/%Y-%m-%d'), 'undated') AS folder FROM files"))
def ingest_day_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Library(spark, sf_dir).files.select("id", I.day_folder(F.col("captured_at")).alias("folder"))


@query(
    "ingest_wall_clock",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE epoch(o_orderdate)::BIGINT + 3661 END AS at FROM orders""",
)
def ingest_wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Library(spark, sf_dir).raw("orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy:MM:dd 25:01:01")).otherwise(F.date_format("o_orderdate", "yyyy:MM:dd 01:01:01"))
    return o.select(F.col("o_orderkey").alias("id"), F.coalesce(I.wall_clock(text), F.lit(-1)).cast("long").alias("at"))


@query(
    "ingest_dedupe",
    """WITH RECURSIVE d AS (SELECT doc_id, lang AS folder, doc_id % 4 = 0 AS old, 'IMG_' || (doc_id % 97) || CASE WHEN doc_id % 5 = 0 THEN '-2' ELSE '' END AS stem, sha256(coalesce(text, '')) AS h FROM documents),
held AS (SELECT folder, stem || '.ARW' AS name, min(h) AS h FROM d WHERE old GROUP BY ALL),
card AS (SELECT doc_id AS id, folder, stem, h, regexp_replace(stem, '(-[0-9]+)+$', '') AS f FROM d WHERE NOT old),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, f ORDER BY id) AS i FROM card),
r AS (SELECT folder, f, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::VARCHAR AS name, NULL::VARCHAR AS placed, NULL::BOOLEAN AS already,
    coalesce((SELECT map_from_entries(list((x.name, x.h))) FROM held x WHERE x.folder IS NOT DISTINCT FROM k.folder AND regexp_replace(x.name, '(-[0-9]+)*\\.ARW$', '') = k.f), map([]::VARCHAR[], []::VARCHAR[])) AS taken
    FROM (SELECT DISTINCT folder, f FROM n) k
  UNION ALL
  SELECT folder, f, i, id, name, CASE WHEN already THEN NULL ELSE t END, already, CASE WHEN already THEN taken ELSE map_concat(taken, map([t], [h])) END
  FROM (SELECT *, tries[free] AS t, list_contains(list_transform(tries[1:free - 1], lambda x: taken[x]), h) AS already
    FROM (SELECT *, list_position(list_transform(tries, lambda x: taken[x] IS NULL), true) AS free
      FROM (SELECT n.folder, n.f, n.i, n.id, n.stem || '.ARW' AS name, n.h, r.taken, list_transform(range(1, cardinality(r.taken)::BIGINT + 2), lambda k: CASE WHEN k = 1 THEN n.stem ELSE n.stem || '-' || k END || '.ARW') AS tries
        FROM r JOIN n ON n.folder IS NOT DISTINCT FROM r.folder AND n.f = r.f AND n.i = r.i + 1))))
SELECT id, folder, name, placed, already FROM r WHERE i > 0""",
)
def ingest_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a file, three quarters of them on the card and the others in the folder."""
    stem = F.concat(F.lit("IMG_"), (F.col("doc_id") % 97).cast("string"), F.when(F.col("doc_id") % 5 == 0, "-2").otherwise(""))
    d = Library(spark, sf_dir).raw("documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("folder"), F.concat(stem, F.lit(".ARW")).alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), (F.col("doc_id") % 4 == 0).alias("old")
    )
    return I.placed(d.where("NOT old"), d.where("old").groupBy("folder", "name").agg(F.min("content_hash").alias("content_hash")))


@query(
    "path_key",
    """SELECT c_custkey AS id, c_name || 'É/Ab' AS exact, translate(c_name || 'É/Ab', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded,
translate(nfc_normalize(c_name || 'E' || chr(769)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM customer""",
)
def path_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Library(spark, sf_dir).raw("customer")
    text = F.concat("c_name", F.lit("É/Ab"))
    apart = F.concat("c_name", F.lit("É"))
    return c.select(F.col("c_custkey").alias("id"), N.path_key(text, "exact").alias("exact"), N.path_key(text, "ascii").alias("folded"), N.path_key(apart, "nfc").alias("normal"))


@query("path_parts", sql(" SELECT id, list_filter(string_split(relative_path, '/'), lambda x: x <> '')[-1] AS last, CASE WHEN relative_path = 'nation_1' THEN '' WHEN starts_with(relative_path, 'nation_1/') THEN substr(relative_path, 10) ELSE '-' END AS below FROM folders"))
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Library(spark, sf_dir).folders
    return f.select("id", N.last_part(F.col("relative_path")).alias("last"), F.coalesce(N.relative_to(F.col("relative_path"), F.lit("nation_1")), F.lit("-")).alias("below"))


@query("path_uuid", "SELECT p_partkey AS id, upper(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS uuid FROM (SELECT p_partkey, md5(p_name) AS h FROM part)")
def path_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Library(spark, sf_dir).raw("part")
    return p.select(F.col("p_partkey").alias("id"), N.uuid_text(F.md5("p_name")).alias("uuid"))


# --- sessions -----------------------------------------------------------------------------------------


@query(
    "cmd_coalesce",
    """WITH n AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR coalesce(lag(value > 150) OVER w, true) THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM n)
SELECT user_id, step::BIGINT AS step, any_value(event_type) AS command, count(*) AS merged, arg_max(value, (ts, event_id)) AS value FROM s GROUP BY user_id, step""",
)
def cmd_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.steps(Library(spark, sf_dir).raw("events"), ["ts", "event_id"], breaks=F.col("value") > 150)
    return s.groupBy("user_id", "step").agg(F.first("event_type").alias("command"), F.count("*").alias("merged"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query(
    "cmd_debounce",
    """SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after IS NULL OR epoch_ms(after) - epoch_ms(ts) >= 7200000""",
)
def cmd_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.debounced(Library(spark, sf_dir).raw("events"), "ts", 7_200_000).select("user_id", "event_id")


@query(
    "cmd_generation",
    """WITH r AS (SELECT event_id, user_id % 30 AS tile, floor(event_id / 1000)::BIGINT AS generation FROM events), h AS (SELECT tile, max(generation) AS generation FROM r GROUP BY tile)
SELECT event_id, tile, generation FROM r SEMI JOIN h ON r.tile = h.tile AND r.generation = h.generation""",
)
def cmd_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Library(spark, sf_dir).raw("events").select("event_id", (F.col("user_id") % 30).alias("tile"), F.floor(F.col("event_id") / 1000).alias("generation"))
    return S.current(r, r.groupBy("tile").agg(F.max("generation").alias("generation"))).select("event_id", "tile", "generation")


@query(
    "cmd_fold",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'set' END AS command, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS seq, 0.0::DOUBLE AS now, []::DOUBLE[] AS past, []::DOUBLE[] AS future FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT e.user_id, e.i, e.seq, CASE WHEN command = 'set' THEN v WHEN command = 'undo' AND len(past) > 0 THEN past[-1] WHEN command = 'redo' AND len(future) > 0 THEN future[-1] ELSE now END,
    CASE WHEN command = 'set' THEN list_append(past, now)[-{S.DEPTH}:] WHEN command = 'undo' AND len(past) > 0 THEN past[:-2] WHEN command = 'redo' AND len(future) > 0 THEN list_append(past, now) ELSE past END,
    CASE WHEN command = 'set' THEN [] WHEN command = 'undo' AND len(past) > 0 THEN list_append(future, now) WHEN command = 'redo' AND len(future) > 0 THEN future[:-2] ELSE future END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, seq, now AS value, len(past)::INTEGER AS past, len(future)::INTEGER AS future FROM r WHERE i > 0""",
)
def cmd_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Library(spark, sf_dir).raw("events")
    command = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("set")
    return S.folded(e.select("user_id", F.col("event_id").alias("seq"), command.alias("command"), "value", "ts"), "user_id", ["ts", "seq"])


_VIEWS = "views AS (SELECT o_orderkey AS view, (o_orderkey * 37) % 2000 AS l, (o_orderkey * 53) % 1500 AS t FROM orders), box AS (SELECT view, l, t, l + 700 AS r, t + 500 AS b FROM views)"


def _views(lib: Library) -> DataFrame:
    left, top = (F.col("o_orderkey") * 37) % 2000, (F.col("o_orderkey") * 53) % 1500
    return lib.raw("orders").select(F.col("o_orderkey").alias("view"), left.alias("left"), top.alias("top"), (left + 700).alias("right"), (top + 500).alias("bottom"))


_TILES = f"""{_VIEWS}, tiles AS (SELECT view, tx, ty, pow((tx + 0.5::DOUBLE) * 256 - (l + r) / 2, 2) + pow((ty + 0.5::DOUBLE) * 256 - (t + b) / 2, 2) AS distance
    FROM (SELECT *, unnest(range(t // 256, (b - 1) // 256 + 1)) AS ty FROM (SELECT *, unnest(range(l // 256, (r - 1) // 256 + 1)) AS tx FROM box)))"""


@query("tile_plan", f"WITH {_TILES} SELECT view, tx::INTEGER AS tx, ty::INTEGER AS ty, distance FROM tiles")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.visible_tiles(_views(Library(spark, sf_dir)))


@query(
    "tile_stale",
    f"WITH {_TILES} SELECT view, tx::INTEGER AS tx, ty::INTEGER AS ty, row_number() OVER (PARTITION BY view ORDER BY distance, tx, ty)::INTEGER AS rank FROM tiles WHERE (view + tx + ty) % 3 <> 0",
)
def tile_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = S.visible_tiles(_views(Library(spark, sf_dir)))
    return S.pending(tiles, tiles.where("(view + tx + ty) % 3 = 0")).select("view", "tx", "ty", "rank")


@query("tile_level", "SELECT p_partkey AS id, CASE WHEN s <= 0 THEN 6 WHEN s >= 1 THEN 0 ELSE least(greatest(floor(log2(1 / s)), 0), 6) END::INTEGER AS level FROM (SELECT p_partkey, (p_size - 3) / 40::DOUBLE AS s FROM part)")
def tile_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Library(spark, sf_dir).raw("part")
    return p.select(F.col("p_partkey").alias("id"), S.level_of((F.col("p_size") - 3) / 40, 6).alias("level"))


@query("stage_order", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{d}', {str(p).lower()})" for i, (s, d, p) in enumerate(S.STAGES)) + ") t(place, stage, domain, preview)")
def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stages(spark)


# --- export and streaming -----------------------------------------------------------------------------


@query(
    "export_names",
    """WITH RECURSIVE w AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 7 = 0 THEN '-2' ELSE '' END AS stem, p_partkey % 50 AS shelf FROM part),
n AS (SELECT id, stem || '_' || shelf || CASE WHEN id % 11 = 0 THEN '-2' ELSE '' END AS stem FROM w),
k AS (SELECT *, regexp_replace(lower(stem), '(-[0-9]+)+$', '') AS f, row_number() OVER (PARTITION BY regexp_replace(lower(stem), '(-[0-9]+)+$', '') ORDER BY id) AS i FROM n),
r AS (SELECT f, 0::BIGINT AS i, NULL::BIGINT AS id, NULL::VARCHAR AS name, []::VARCHAR[] AS taken FROM (SELECT DISTINCT f FROM k)
  UNION ALL
  SELECT f, i, id, name, list_append(taken, lower(name))
  FROM (SELECT k.f, k.i, k.id, r.taken, list_filter(list_transform(range(1, len(r.taken) + 2), lambda x: CASE WHEN x = 1 THEN k.stem ELSE k.stem || '-' || x END), lambda t: NOT list_contains(r.taken, lower(t)))[1] AS name
    FROM r JOIN k ON k.f = r.f AND k.i = r.i + 1))
SELECT id, name || '.jpg' AS output FROM r WHERE i > 0""",
)
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(F.col("p_partkey") % 7 == 0, "-2").otherwise(""))
    stem = F.concat(w, F.lit("_"), (F.col("p_partkey") % 50).cast("string"), F.when(F.col("p_partkey") % 11 == 0, "-2").otherwise(""))
    p = Library(spark, sf_dir).raw("part").select(F.col("p_partkey").alias("id"), stem.alias("stem"))
    return X.names(p).select("id", "output")


@query("export_fit", "SELECT p_partkey AS id, greatest(1, floor(w * s + 0.5::DOUBLE))::INTEGER AS width, greatest(1, floor(h * s + 0.5::DOUBLE))::INTEGER AS height FROM (SELECT *, least(1, 2048::DOUBLE / greatest(w, h)) AS s FROM (SELECT p_partkey, p_size * 100 + 200 AS w, p_size * 70 + 300 AS h FROM part))")
def export_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Library(spark, sf_dir).raw("part")
    w, h = X.fit(F.col("p_size") * 100 + 200, F.col("p_size") * 70 + 300, 2048)
    return p.select(F.col("p_partkey").alias("id"), w.alias("width"), h.alias("height"))


@query(
    "export_gather",
    """WITH o AS (SELECT user_id AS id, min(event_id) AS ordinal, arg_min(event_type, event_id) AS camera FROM events GROUP BY 1), e AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS content FROM events WHERE user_id % 4 <> 0 GROUP BY 1)
SELECT o.id, ordinal, o.camera, coalesce(content, 'default') AS content, CASE o.camera WHEN 'view' THEN 'p1' WHEN 'click' THEN 'p2' END AS profile FROM o LEFT JOIN e ON e.id = o.id""",
)
def export_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Library(spark, sf_dir).raw("events")
    ordered = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("ordinal"), F.col("event_type").alias("camera"))
    edits = e.where("user_id % 4 <> 0").groupBy(F.col("user_id").alias("image_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("content"))
    profiles = spark.createDataFrame([("view", "p1"), ("click", "p2")], "camera string, profile string")
    return X.gathered(ordered, edits, profiles, "default").select("id", "ordinal", "camera", "content", "profile")


@query(
    "edit_sessions",
    """WITH n AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC) AS k FROM n) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def edit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = D.edit_sessions(Library(spark, sf_dir).raw("events"))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_events_debounce", f"SELECT * FROM ({ORACLES['edit_sessions']}) WHERE end_us <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)")
def stream_events_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from a stream; those that the watermark leaves open are withheld."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A glob, as a stream reads folders; it takes the table whether a file or a folder.
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{sf_dir}/events.parque[t]")
    return D.drained(spark, D.edit_sessions(stream)).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
