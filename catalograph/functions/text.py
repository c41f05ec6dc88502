"""Names, ids, paths and dates as text (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalograph import names as N


def stripped(c: Column | str) -> Column:
    """Without white space of any kind at either end; Spark's own trim takes spaces only."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def bare_id(c: Column) -> Column:
    """Any spelling of an identity (bracketed, full IRI, bare) to its last path segment."""
    t = stripped(c)
    inner = F.when(t.startswith("<") & t.endswith(">"), F.substring(t, 2, 1 << 30).substr(F.lit(1), F.length(t) - 2)).otherwise(t)
    return F.substring_index(inner, "/", -1)


def bracket_iri(c: Column, base: str = N.BASE) -> Column:
    return F.when(c.startswith(base), F.concat(F.lit("<"), F.substring(c, len(base) + 1, 1 << 30), F.lit(">"))).otherwise(c)


def iri_from_bracket(c: Column, base: str = N.BASE) -> Column:
    """`<ns/Class/id>` to a full IRI; NULL unless bracketed, ≥ 3 segments, no blanks, no leading slash."""
    inner = F.regexp_extract(stripped(c), "^<([^/\\s][^\\s]*)>$", 1)
    segments = F.size(F.filter(F.split(inner, "/"), lambda x: x != ""))
    return F.when((inner != "") & (segments >= 3), F.concat(F.lit(base), inner))


def media_class(media_type: Column) -> Column:
    major = F.split_part(media_type, F.lit("/"), F.lit(1))
    return F.when(major == "image", "Image").when(major == "video", "Video").otherwise("Media")


def media_kind(media_type: Column) -> Column:
    major = F.split_part(media_type, F.lit("/"), F.lit(1))
    return F.when(major.isin("image", "video", "audio"), major).otherwise("other")


def valid_id(c: Column) -> Column:
    return c.rlike(N.ID_PATTERN)


def valid_index_name(c: Column) -> Column:
    return c.rlike(N.INDEX_PATTERN) & ~c.isin(".", "..")


def store_id(c: Column) -> Column:
    """First six characters of the trimmed declaration, lower case; NULL when nothing is left."""
    return F.nullif(F.lower(F.substring(stripped(c), 1, 6)), F.lit(""))


def model_label(c: Column) -> Column:
    tail = F.substring_index(c, "/", -1)
    return F.regexp_replace(F.regexp_replace(F.lower(tail), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def valid_model_label(c: Column) -> Column:
    return c.rlike(N.MODEL_PATTERN)


def date_shard(created: Column) -> Column:
    """`YYYY/MM/DD` of a text date."""
    day = F.when(F.length(created) >= 10, F.substring(created, 1, 10)).otherwise("0000-00-00")
    return F.translate(day, "-", "/")


def file_stem(created: Column, id_: Column) -> Column:
    digits = F.regexp_replace(F.substring(created, 1, 19), "[^0-9]", "")
    return F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 11), id_)


def media_path(kind: Column, created: Column, id_: Column, ext: Column, sub: str = "source") -> Column:
    return F.concat(kind, F.lit(f"/img/{sub}/"), date_shard(created), F.lit("/"), file_stem(created, id_), F.lit("."), ext)


def rendition_path(kind: Column, created: Column, id_: Column, long_edge: Column, sub: str = "jpg", ext: str = "jpg") -> Column:
    return F.concat(kind, F.lit(f"/img/{sub}/"), date_shard(created), F.lit("/"), file_stem(created, id_),
                    F.lit("_"), long_edge.cast("string"), F.lit(f".{ext}"))


def stem_of(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), "(?<=.)\\.[^.]*$", "")


def enrichment_path(media_path_: Column, created: Column, stage: Column, model: Column, ext: Column) -> Column:
    """`<kind>/enrichment/<stage>/YYYY/MM/DD/<stem>.<stage>.<model>.<ext>`."""
    return F.concat(F.split_part(media_path_, F.lit("/"), F.lit(1)), F.lit("/enrichment/"), stage, F.lit("/"),
                    date_shard(created), F.lit("/"), stem_of(media_path_), F.lit("."), stage, F.lit("."),
                    F.translate(model, "/", "-"), F.lit("."), ext)


def path_segment(c: Column) -> Column:
    """Percent-encode to one IRI segment: unreserved characters stay, all else is %XX."""
    e = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


RFC3339 = ("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt ]([01][0-9]|2[0-3]):[0-5][0-9]:"
           "([0-5][0-9]|60)(\\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$")


def is_zoned_date(c: Column) -> Column:
    """A full RFC 3339 date-time with its zone that names a real instant."""
    return c.rlike(RFC3339) & instant(c).isNotNull()


def instant(c: Column) -> Column:
    """The instant of a zoned RFC 3339 text, else NULL (a zoneless or relative text is no instant)."""
    leap = F.regexp_replace(F.upper(c), "^(.{17})60", "$159")
    return F.when(c.rlike(RFC3339), F.try_to_timestamp(F.translate(leap, "T", " ")))


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(F.substring_index(path, "/", -1), ".\\.([^.]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, m in N.MIME_BY_EXTENSION.items():
        out = F.when(ext == k, m).otherwise(out)
    return out


def date_from_name(stem: Column, zone: str) -> Column:
    """`YYYYMMDD-HHMMSS-<8 hex>` in UTC to an RFC 3339 text in `zone`; NULL when the name is not that."""
    m = F.regexp_extract(stem, "^([0-9]{8}-[0-9]{6})-[0-9a-f]{8}$", 1)
    t = F.try_to_timestamp(F.nullif(m, F.lit("")), F.lit("yyyyMMdd-HHmmss"))
    utc = F.to_utc_timestamp(t, F.current_timezone())
    local = F.from_utc_timestamp(utc, zone)
    minutes = ((F.unix_micros(local) - F.unix_micros(utc)) / 60_000_000).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    hh = F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0")
    mm = F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, hh, F.lit(":"), mm)


def set_from_name(stem: Column, patterns: tuple[str, ...] = ()) -> Column:
    """A set id out of a file name; NULL when the result is not a usable id."""
    if patterns:
        raw = F.coalesce(*[F.when(stem.rlike(f"^(?:{p})"), F.regexp_extract(stem, f"^(?:{p})", 1)) for p in patterns])
    else:
        raw = F.regexp_replace(stem, "__s[0-9]+$", "")
    sid = F.lower(F.regexp_replace(raw, "_+", "-"))
    return F.when(valid_id(sid), sid)


def json_text(value: Column) -> Column:
    """A JSON value as trimmed plain text: strings unquoted, others as written."""
    return stripped(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))


def is_json_string(value: Column) -> Column:
    return stripped(value).startswith('"')


def base32_id(seed: Column, length: int = 16) -> Column:
    """An id of `length` base-32 letters out of md5 bits of a seed (5 bits a letter, 8 letters a 40-bit half)."""
    h = F.md5(seed.cast("binary"))
    letters = []
    for i in range(length):
        half = F.conv(F.substring(h, 1 + 10 * (i // 8), 10), 16, 10).cast("long")
        at = F.shiftright(half, 5 * (i % 8)).bitwiseAND(F.lit(31)).cast("int")
        letters.append(F.substring(F.lit(N.ID_ALPHABET), at + 1, F.lit(1)))
    return F.concat(*letters)
