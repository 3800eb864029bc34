"""Column -> Column helpers (F1-F6, F8-F15). All built from JVM expressions, so they stay
inside whole-stage code generation and run where the data is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: allowed image extensions and the content-type -> extension table of uploads
ALLOWED_IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp"]
CONTENT_TYPE_TO_EXT = {
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/bmp": ".bmp",
}
MAX_FILENAME_LEN = 255


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------------- F1
def normalize_text(c) -> Column:
    """drop NUL, trim, control characters -> space, collapse whitespace, trim."""
    c = _c(c)
    c = F.regexp_replace(c, "\u0000", "")
    c = strip_ws(c)
    c = F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f]", " ")
    c = F.regexp_replace(c, "(?U)\\s+", " ")
    return F.regexp_replace(c, "^ | $", "")


def text_too_long(c, max_len: int = 10000) -> Column:
    """F1 length guard: the normalised text exceeds ``max_len`` (a violation flag, not an error)."""
    return F.length(normalize_text(c)) > max_len


# ------------------------------------------------------------------------- F2
def sanitize_filename(c) -> Column:
    """basename, unsafe characters -> '_', collapse '_', strip '._ ' at both ends,
    empty -> 'unnamed', cut to 255 characters."""
    c = F.regexp_replace(_c(c), "\u0000", "")
    c = F.regexp_extract(c, "([^/]*)$", 1)
    c = F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_")
    c = F.regexp_replace(c, "_+", "_")
    c = F.regexp_replace(c, "^[._ ]+|[._ ]+$", "")
    return F.when(c.isNull() | (c == ""), F.lit("unnamed")).otherwise(F.substring(c, 1, MAX_FILENAME_LEN))


# ------------------------------------------------------------------------- F3
def split_tags(c) -> Column:
    """plain comma split; null -> empty array."""
    c = _c(c)
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.split(c, ","))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(c), "^(?U)\\s+|(?U)\\s+$", "")


def split_upload_tags(c, max_tags: int = 50, max_len: int = 100) -> Column:
    """F3 upload variant: strip, drop empty, sanitise, cut to 100 characters, keep the first 50."""
    parts = F.transform(split_tags(c), lambda t: strip_ws(t))
    parts = F.filter(parts, lambda t: t != "")
    parts = F.transform(parts, lambda t: F.substring(sanitize_filename(t), 1, max_len))
    return F.slice(parts, 1, max_tags)


# ------------------------------------------------------------------------- F4 / F5
def file_extension(c) -> Column:
    """Lower-cased extension with its dot ('' when none), like os.path.splitext: leading dots
    of the base name do not start an extension."""
    base = F.regexp_replace(F.regexp_extract(_c(c), "([^/]*)$", 1), "^\\.+", "")
    return F.lower(F.regexp_extract(base, "(\\.[^.]*)$", 1))


def is_allowed_image_extension(c) -> Column:
    """extension (with dot) in the allowed list, case-blind."""
    return F.lower(_c(c)).isin(ALLOWED_IMAGE_EXTENSIONS)


def storage_extension(content_type, original) -> Column:
    """F4 extension rule: from the content type (parameters stripped, lower-cased), else the
    allowed extension of the sanitised original name, else '.bin'."""
    ct = F.lower(strip_ws(F.split(_c(content_type), ";").getItem(0)))
    table = F.create_map(*[x for kv in CONTENT_TYPE_TO_EXT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    from_ct = F.try_element_at(table, ct)
    orig_ext = file_extension(sanitize_filename(original))
    from_name = F.when(_c(original).isNotNull() & is_allowed_image_extension(orig_ext), orig_ext)
    return F.coalesce(F.when(_c(content_type).isNotNull(), from_ct), from_name, F.lit(".bin"))


def storage_name(content_type, original, key=None) -> Column:
    """``upload_<32 hex><ext>``; random (uuid) by default, or md5 of ``key`` for a
    reproducible name."""
    token = F.regexp_replace(F.expr("uuid()"), "-", "") if key is None else F.md5(_c(key).cast("string"))
    return F.concat(F.lit("upload_"), token, storage_extension(content_type, original))


# ------------------------------------------------------------------------- F6
def _present(c) -> Column:
    """The value as a string when it is truthy in the reference sense (not null, not empty)."""
    return F.when(c.isNotNull() & (c.cast("string") != ""), c.cast("string"))


def _size_part(width, height) -> Column:
    w, h = _c(width), _c(height)
    return F.when(w.isNotNull() & h.isNotNull() & (w != 0) & (h != 0),
                  F.concat(F.lit("Size: "), w.cast("string"), F.lit("x"), h.cast("string")))


def metadata_text_csv(description, tags, style, category) -> Column:
    """F6 (CSV form): 'Description: … | Tags: … | Style: … | Category: …', empty parts skipped."""
    parts = [("Description: ", description), ("Tags: ", tags), ("Style: ", style), ("Category: ", category)]
    return F.concat_ws(" | ", *[F.concat(F.lit(p), _present(_c(v))) for p, v in parts])


def metadata_text_coco(objects, width, height) -> Column:
    """F6 (COCO form): 'Objects: a, b | Size: WxH', empty parts skipped."""
    objs = F.when(F.size(_c(objects)) > 0, F.concat(F.lit("Objects: "), F.array_join(_c(objects), ", ")))
    return F.concat_ws(" | ", objs, _size_part(width, height))


def metadata_text_db(description, tags, width, height) -> Column:
    """F6 (database form): 'desc | tag | tag | Size: WxH', 'No description available' when empty."""
    parts = F.filter(F.concat(F.array(_present(_c(description))),
                              F.coalesce(_c(tags), F.array().cast("array<string>")),
                              F.array(_size_part(width, height))), lambda x: x.isNotNull())
    return F.when(F.size(parts) == 0, F.lit("No description available")).otherwise(F.array_join(parts, " | "))


# ------------------------------------------------------------------------- F8
def client_id(forwarded_for, host) -> Column:
    """F8: first hop of X-Forwarded-For (trimmed), else the host, else 'unknown'."""
    ff = _c(forwarded_for)
    first = strip_ws(F.split(ff, ",").getItem(0))
    return F.coalesce(F.when(ff.isNotNull() & (ff != ""), first), _c(host), F.lit("unknown"))


# ------------------------------------------------------------------------- F9
def cache_key(model_type, model_name, params=None) -> Column:
    """md5 of 'type:name:json(params with sorted keys)'."""
    parts = [_c(model_type).cast("string"), _c(model_name).cast("string")]
    if params is not None:
        p = _c(params)
        parts.append(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(p)))))
    return F.md5(F.concat_ws(":", *parts))


# ------------------------------------------------------------------------ F10/F11
def json_text(c, key: str) -> Column:
    """``c ->> key`` for a JSON string column."""
    return F.get_json_object(_c(c), f"$.{key}")


def hours_between(later, earlier) -> Column:
    """epoch hours between two timestamps (fractional)."""
    return (F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / 3.6e9


def epoch_seconds_to_ts(c) -> Column:
    return F.timestamp_micros(F.floor(_c(c) * 1_000_000).cast("long"))


def ms_to_seconds(c) -> Column:
    return _c(c) / 1000.0


# ------------------------------------------------------------------------- F12
def coco_description(captions) -> Column:
    """description = captions joined by a space (tags = the captions themselves)."""
    return F.array_join(F.coalesce(_c(captions), F.array().cast("array<string>")), " ")


# ------------------------------------------------------------------------- F13
def output_name(prefix, run_id, index, ext, zero_based: bool = False) -> Column:
    """'%s_%s_%02d.%s' with a 1-based index (0-based for the API variant); the
    extension is lower-cased without its leading dots, 'png' when empty."""
    i = _c(index) if zero_based else _c(index) + 1
    e = F.lower(F.regexp_replace(_c(ext), "^\\.+", ""))
    e = F.when(F.coalesce(e, F.lit("")) == "", F.lit("png")).otherwise(e)
    return F.format_string("%s_%s_%02d.%s", _c(prefix), _c(run_id), i.cast("int"), e)


# ------------------------------------------------------------------------- F14
def prometheus_labels(labels) -> Column:
    """'{k="v",…}' from a map column in key order; empty or null map -> ''."""
    m = _c(labels)
    body = F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return F.when(m.isNull() | (F.size(m) == 0), F.lit("")).otherwise(F.concat(F.lit("{"), body, F.lit("}")))


# ------------------------------------------------------------------------- F15
def split_known_fields(meta, known: list[str]):
    """split a metadata map into the known keys (one column each) and the rest as JSON.
    Returns a list of Columns: the known fields followed by ``extra_json``."""
    m = _c(meta)
    known_cols = [F.try_element_at(m, F.lit(k)).alias(k) for k in known]
    rest = F.map_filter(m, lambda k, v: ~k.isin(known))
    return known_cols + [F.to_json(rest).alias("extra_json")]


def search_document(meta, known: tuple[str, ...] = ("description", "tags", "width", "height")):
    """F15 under its inventory name: known metadata fields as columns, the rest as JSON."""
    return split_known_fields(meta, list(known))
