"""Explicit schemas of the catalog's tables and of the edit document."""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T

SCHEMA_VERSION = 6
EDIT_SCHEMA_VERSION = 1


#: Specifications of the tables; table() gives the struct types, which need a session.
TABLES: dict[str, str] = {
    "volumes": "id BIGINT, kind STRING, uuid STRING, windows_serial BIGINT, host STRING, share STRING, mount_path STRING, label STRING, last_mount_path STRING, path_convention STRING",
    "folders": "id BIGINT, volume_id BIGINT, parent_id BIGINT, relative_path STRING, path_key STRING",
    "files": "id BIGINT, folder_id BIGINT, filename STRING, filename_key STRING, size BIGINT, mtime BIGINT, content_hash STRING, captured_at BIGINT, "
        "camera_make STRING, camera_model STRING, camera_serial STRING, shutter_count BIGINT, lens STRING, missing BOOLEAN, imported_at BIGINT",
    "images": "id BIGINT, file_id BIGINT, is_virtual_copy BOOLEAN, copy_name STRING, rating TINYINT, flag STRING, colour_label STRING, created_at BIGINT",
    "edit_states": "id BIGINT, image_id BIGINT, version INT, json STRING, edit_state_hash STRING, source STRING, created_at BIGINT",
    "previews": "id BIGINT, image_id BIGINT, level STRING, path STRING, edit_state_hash STRING, width INT, height INT, bytes BIGINT, created_at BIGINT, renderer STRING",
    "camera_profiles": "camera_make STRING, camera_model STRING, path STRING, name STRING, chosen_at BIGINT",
    "presets": "name STRING, json STRING, groups ARRAY<STRING>, created_at BIGINT",
    "snapshots": "image_id BIGINT, version INT, name STRING, created_at BIGINT",
    "collections": "id BIGINT, parent_id BIGINT, name STRING, name_key STRING, is_quick BOOLEAN, is_target BOOLEAN, created_at BIGINT",
    "collection_images": "collection_id BIGINT, image_id BIGINT, position BIGINT",
}



@cache
def table(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


#: Primary keys, and (columns, table referred to) of foreign keys.
PRIMARY = {
    "volumes": ["id"], "folders": ["id"], "files": ["id"], "images": ["id"], "edit_states": ["id"], "previews": ["id"],
    "camera_profiles": ["camera_make", "camera_model"], "presets": ["name"], "snapshots": ["image_id", "name"],
    "collections": ["id"], "collection_images": ["collection_id", "image_id"],
}
FOREIGN = {
    "folders": [("volume_id", "volumes"), ("parent_id", "folders")],
    "files": [("folder_id", "folders")],
    "images": [("file_id", "files")],
    "edit_states": [("image_id", "images")],
    "previews": [("image_id", "images")],
    "snapshots": [("image_id", "images")],
    "collections": [("parent_id", "collections")],
    "collection_images": [("collection_id", "collections"), ("image_id", "images")],
}
UNIQUE = {
    "folders": ["volume_id", "path_key"],
    "files": ["folder_id", "filename_key"],
    "edit_states": ["image_id", "version"],
    "previews": ["image_id", "level"],
}

_SHAPE = "kind: STRING, from: ARRAY<FLOAT>, to: ARRAY<FLOAT>, centre: ARRAY<FLOAT>, radii: ARRAY<FLOAT>, angle_deg: FLOAT, feather: FLOAT, strokes: ARRAY<STRUCT<points: ARRAY<ARRAY<FLOAT>>, radius: FLOAT, feather: FLOAT, erase: BOOLEAN>>, low: FLOAT, high: FLOAT, hue: FLOAT, width: FLOAT"
_HSL = "STRUCT<hue: FLOAT, saturation: FLOAT, luminance: FLOAT>"
#: The edit document; from_json() takes it as it is.
EDIT = (
    "schema_version INT, white_balance STRUCT<temperature_k: FLOAT, tint: FLOAT>, "
    "tone STRUCT<exposure_ev: FLOAT, contrast: FLOAT, highlights: FLOAT, shadows: FLOAT, whites: FLOAT, blacks: FLOAT, clarity: FLOAT, texture: FLOAT, dehaze: FLOAT, hue_preservation: FLOAT>, "
    "orientation STRING, crop STRUCT<left: FLOAT, top: FLOAT, right: FLOAT, bottom: FLOAT, angle_deg: FLOAT, vertical: FLOAT, horizontal: FLOAT, aspect: FLOAT>, "
    "detail STRUCT<sharpen_amount: FLOAT, sharpen_radius: FLOAT, chroma_noise: FLOAT, luminance_noise: FLOAT, defringe: FLOAT>, "
    "lens STRUCT<chromatic_red: FLOAT, chromatic_blue: FLOAT, vignette: FLOAT, distortion: STRUCT<knots: ARRAY<SMALLINT>, amount: FLOAT>>, "
    f"colour STRUCT<saturation: FLOAT, vibrance: FLOAT>, hsl ARRAY<{_HSL}>, curve STRUCT<points: ARRAY<ARRAY<FLOAT>>>, "
    f"grade STRUCT<shadows: {_HSL}, midtones: {_HSL}, highlights: {_HSL}, blending: FLOAT, balance: FLOAT>, "
    "effects STRUCT<vignette: FLOAT, midpoint: FLOAT, roundness: FLOAT, feather: FLOAT, grain: FLOAT, grain_size: FLOAT>, "
    "calibration STRUCT<shadow_tint: FLOAT, red: STRUCT<hue: FLOAT, saturation: FLOAT>, green: STRUCT<hue: FLOAT, saturation: FLOAT>, blue: STRUCT<hue: FLOAT, saturation: FLOAT>>, "
    f"masks ARRAY<STRUCT<shape: STRUCT<{_SHAPE}>, refinements: ARRAY<STRUCT<op: STRING, shape: STRUCT<{_SHAPE}>>>, invert: BOOLEAN, exposure_ev: FLOAT, warmth: FLOAT, tint: FLOAT, contrast: FLOAT, saturation: FLOAT, clarity: FLOAT>>, "
    "spots ARRAY<STRUCT<centre: ARRAY<FLOAT>, source: ARRAY<FLOAT>, radius: FLOAT, feather: FLOAT, mode: STRING>>"
)

#: Groups of the document that presets name.
GROUPS = ("white_balance", "tone", "crop", "detail", "lens", "colour", "hsl", "curve", "grade", "effects", "calibration", "masks", "spots")
