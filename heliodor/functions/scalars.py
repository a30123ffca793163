"""Scalar functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File types by suffix, text and media suffixes, modalities.
FILE_TYPES = {
    "pdf": "pdf", "doc": "doc", "docx": "docx", "ppt": "ppt", "pptx": "pptx", "xlsx": "xlsx", "csv": "csv", "json": "json",
    "jsonl": "jsonl", "ics": "ics", "eml": "eml", "ipynb": "ipynb", "md": "md", "txt": "txt", "log": "log", "py": "py", "sh": "sh",
    "sqlite": "sqlite", "db": "sqlite", "mp4": "mp4", "mov": "mov", "avi": "avi", "mkv": "mkv", "webm": "webm", "mp3": "mp3",
    "wav": "wav", "flac": "flac", "aac": "aac", "ogg": "ogg", "m4a": "m4a", "wma": "wma", "jpg": "jpg", "jpeg": "jpeg", "png": "png",
    "gif": "gif", "bmp": "bmp", "webp": "webp", "tiff": "tiff", "tif": "tif", "bin": "bin", "pkl": "pkl", "npy": "npy", "pt": "pt", "pth": "pth",
}
TEXT_SUFFIXES = ("txt", "xml", "md", "json", "jsonl", "csv", "log", "ics", "eml", "ipynb", "py", "sh")
MEDIA_SUFFIXES = ("mp4", "mov", "avi", "mkv", "webm", "jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "mp3", "wav", "flac", "aac", "ogg", "m4a", "wma", "pdf", "doc", "docx")
MODALITIES = {
    "Text": ("bin", "ipynb", "log", "npy", "pkl", "pt", "pth", "py", "txt", "md", "pyc", "sh", "xml", "json", "sqlite", "yaml", "yml"),
    "Documents": ("docx", "eml", "pdf", "pptx", "ics", "csv", "doc", "rtf", "xlsx"),
    "Images": ("gif", "jpg", "png", "jpeg", "webp", "tiff", "svg", "heic", "bmp"),
    "Audio": ("mp3",),
    "Video": ("mp4", "mkv"),
}
IMAGE_VIDEO_MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska", "avi": "video/x-msvideo"}


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for key, null if it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_type(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"^\.+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]+$", "")


def file_type(path: Column) -> Column:
    s = suffix(path)
    return F.coalesce(lookup(s, FILE_TYPES), F.when(s.isin(*TEXT_SUFFIXES), s), F.lit("unknown"))


def modality(ext: Column) -> Column:
    return lookup(ext, {e: m for m, group in MODALITIES.items() for e in group})


def is_text_file(path: Column, suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> Column:
    return suffix(path).isin(*suffixes)


def is_media_file(path: Column) -> Column:
    return suffix(path).isin(*MEDIA_SUFFIXES)


def mime_type(path: Column) -> Column:
    return F.coalesce(lookup(suffix(path), IMAGE_VIDEO_MIME), F.lit("application/octet-stream"))


def time_value(c: Column) -> Column:
    """Seconds of a number, numeric string, MM:SS or HH:MM:SS; null for all else."""
    t = F.trim(c.cast("string"))
    part = lambda i: F.split(t, ":")[i].try_cast("double")
    return F.coalesce(
        t.try_cast("double"),
        F.when(F.rlike(t, F.lit(r"^\d+:\d+(\.\d+)?$")), part(0) * 60 + part(1)),
        F.when(F.rlike(t, F.lit(r"^\d+:\d+:\d+(\.\d+)?$")), part(0) * 3600 + part(1) * 60 + part(2)),
    )


def parse_date(c: Column) -> Column:
    """Day-first and year-first dates, with or without a time."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in ("d/M/yyyy H:mm", "d/M/yyyy", "yyyy/M/d H:mm", "yyyy/M/d")])


def normalize_path(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.replace(c, F.lit("\\"), F.lit("/"))), r"^[./]+", "")


def token_count(c: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+|[一-鿿])"), F.lit(1))), F.lit(0)).cast("long")


def parse_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.cast("string").try_cast("int"), F.lit(default))


def safe_list(c: Column) -> Column:
    """A one-item list of a non-blank string; [] for null and blanks."""
    t = F.trim(c)
    return F.when(t.isNotNull() & (t != ""), F.array(t)).otherwise(F.array().cast("array<string>"))


def max_id_or_len(ids: Column) -> Column:
    """The greater of the largest id and the number of items."""
    return F.greatest(F.coalesce(F.array_max(ids), F.lit(0)), F.coalesce(F.size(ids), F.lit(0)))


def distinct_count(items: Column) -> Column:
    return F.size(F.array_distinct(items))


def human_size(c: Column) -> Column:
    size = c.cast("double")
    # C's printf rounds halves, as of 1152 bytes, to even; Java's format would round them up.
    of = lambda unit, power: F.format_string(f"%.2f {unit}", F.bround(size / 1024**power, 2))
    return (
        F.when(size < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B")))
        .when(size < 1024**2, of("KB", 1))
        .when(size < 1024**3, of("MB", 2))
        .otherwise(of("GB", 3))
    )


def slugify(c: Column, most: int = 60) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.substring(F.when((s == "") | s.isNull(), "q").otherwise(s), 1, most)


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^A-Za-z0-9_-]+", "_")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def truncate_words(c: Column, n: int = 350) -> Column:
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("..."))).otherwise(c)


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def is_folder(path: Column) -> Column:
    return F.endswith(path, F.lit("/")) | ~F.contains(basename(path), F.lit("."))


def top_folder(path: Column) -> Column:
    return F.split(path, "/")[0]


def token_estimate(c: Column) -> Column:
    """Tokens of JSON text by its length."""
    return F.ceil(F.length(c) / 3.8).cast("long")


def token_estimate_cjk(c: Column) -> Column:
    """Tokens of prose in which each CJK sign is one; at least 1.2 a word."""
    cjk = F.regexp_count(c, F.lit(r"[一-鿿]"))
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.greatest(((F.length(c) - cjk) / 2.7).cast("int") + cjk, (words * 1.2).cast("int"))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd_HHmmss")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def md5_id(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def sha1_id(*parts: Column) -> Column:
    return F.sha1(F.concat_ws(":", *parts))


def log_scaled(value: Column, p90: Column, p98: Column) -> Column:
    """Log-normalised value, capped a quarter above the 98th percentile's."""
    cap = F.greatest(F.lit(1.0), F.ln(1 + p98) / F.ln(1 + p90))
    return F.greatest(F.lit(0.0), F.least(F.ln(1 + F.greatest(F.lit(0.0), value)) / F.ln(1 + p90), cap + 0.25))


def piecewise_year(days: Column, cut: Column, end: Column, start: Column, share: float) -> Column:
    """0 to 1: `share` of the axis for start..cut, the rest for cut..end."""
    early = (days - start) / (cut - start) * share
    late = share + (days - cut) / (end - cut) * (1 - share)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(days <= cut, early).otherwise(late)))


def base64_bytes(c: Column) -> Column:
    """The bytes of a base64 text; null where it is none."""
    return F.try_to_binary(F.regexp_replace(c, r"\s", ""), F.lit("base64"))


def milliseconds(seconds: Column, digits: int = 2) -> Column:
    """Seconds as milliseconds, halves rounded to even."""
    return F.bround(seconds * 1000, digits)


def sorted_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))
