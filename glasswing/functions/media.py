"""What names, sizes and durations of media files say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glasswing.functions.paths import extension

# Extensions by media type, content types by extension.
IMAGE = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".bmp", ".tiff")
VIDEO = (".mp4", ".webm", ".mkv", ".avi", ".mov", ".wmv", ".flv")
ARCHIVE = (".zip",)
PDF = (".pdf",)
CONTENT_TYPES = {".mkv": "video/x-matroska", ".mp4": "video/mp4", ".webm": "video/webm", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".avif": "image/avif", ".pdf": "application/pdf", ".html": "text/html; charset=utf-8", ".txt": "text/plain; charset=utf-8", ".json": "application/json"}


def media_type(name: Column) -> Column:
    """``image``, ``video``, ``archive``, ``pdf`` or ``other``, by the extension in any case."""
    ext = extension(name)
    return F.when(ext.isin(*IMAGE), "image").when(ext.isin(*VIDEO), "video").when(ext.isin(*ARCHIVE), "archive").when(ext.isin(*PDF), "pdf").otherwise("other")


def has_thumbnail(kind: Column) -> Column:
    return kind.isin("image", "video", "pdf")


def previewable(kind: Column) -> Column:
    return kind.isin("image", "video")


def wanted(kind: Column, videos: bool = True) -> Column:
    """Media that analysers look at."""
    return kind.isin("image", "video") if videos else kind == "image"


def content_type(name: Column) -> Column:
    """The content type of known extensions, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]), extension(name))


def crc32_in_name(name: Column) -> Column:
    """The last eight hex digits in brackets in a name, upper-case; null where there are none."""
    return F.upper(F.try_element_at(F.regexp_extract_all(name, F.lit(r"\[([A-Fa-f0-9]{8})\]"), F.lit(1)), F.lit(-1)))


def crc32_hex(content: Column) -> Column:
    return F.lpad(F.hex(F.crc32(content)), 8, "0")


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def short_hash(hexdigest: Column, digits: int = 12) -> Column:
    """The first digits of a hash, as it is shown."""
    return F.substring(hexdigest, 1, digits)


def version_tag(platform: str, version: Column) -> Column:
    """A result's version: the platform that the engine ran on before the model's own version."""
    return F.concat(F.lit(f"{platform}-"), version)


def cache_key(root: Column, key: Column, mtime: Column, size: Column) -> Column:
    """The content-independent key of a file's cached derivative: 32 hex digits."""
    return F.substring(F.sha2(F.concat_ws(":", root, key, mtime.cast("string"), size.cast("string")), 256), 1, 32)


def cache_path(root: Column, key: Column) -> Column:
    return F.concat(root, F.lit("/"), key, F.lit(".jpg"))


def spaced_positions(duration: Column, count: int) -> Column:
    """``count`` positions that divide a duration evenly; each is 1 where there is no duration."""
    if count <= 0:
        return F.array().cast("array<double>")
    steps = F.sequence(F.lit(1), F.lit(count))
    return F.transform(steps, lambda i: F.when(duration > 0, duration * (i / F.lit(float(count + 1)))).otherwise(F.lit(1.0)))


def seek_position(duration: Column) -> Column:
    """A tenth of a duration with two digits; 0 if that is under a second, ``1`` where there is none."""
    at = duration * 0.1
    return F.when(duration.isNull() | (duration <= 0), F.lit("1")).otherwise(F.format_string("%.2f", F.when(at < 1, F.lit(0.0)).otherwise(at)))


# Offsets from a position that are tried one after the other, in shares of the duration, then in seconds.
NEAR_SHARES = (0.0, 0.02, -0.02, 0.05, -0.05, 0.1, -0.1)
NEAR_SECONDS = (1.0, -1.0, 2.0, -2.0)


def fallback_positions(duration: Column, target: Column) -> Column:
    """Positions to try around a target, inside the duration, in order, each hundredth of a second once."""
    near = [*[F.lit(x) * duration for x in NEAR_SHARES], *[F.lit(x) for x in NEAR_SECONDS]]
    all_ = F.transform(F.array(*near), lambda o: F.greatest(F.lit(0.0), F.least(duration, target + o)))
    ticks = F.transform(all_, lambda x: F.round(x * 100).cast("long"))
    first = F.filter(F.transform(all_, lambda x, i: F.struct(x.alias("x"), (F.array_position(ticks, F.get(ticks, i)) == i + 1).alias("new"))), lambda s: s["new"])
    return F.when(duration <= 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.transform(first, lambda s: s["x"]))


def human_size(size: Column) -> Column:
    unit = lambda n, name: F.format_string(f"%.1f {name}", size / F.lit(float(n)))
    return F.when(size < 1 << 10, F.format_string("%d B", size)).when(size < 1 << 20, unit(1 << 10, "KB")).when(size < 1 << 30, unit(1 << 20, "MB")).otherwise(unit(1 << 30, "GB"))


def shown_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def percent(score: Column) -> Column:
    return F.format_string("%.0f%%", score * 100)


def multiple_of_32(v: Column) -> Column:
    """The nearest multiple of 32, at least 32."""
    return F.greatest(F.lit(32), (F.round(v / 32) * 32).cast("int"))


def clamped(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))
