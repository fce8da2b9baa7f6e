"""Scalar expressions of the catalogue, all from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values the catalogue's rules depend on.
EVENT_WORDS = ["birthday", "wedding", "vacation", "holiday", "christmas", "easter", "graduation", "party", "concert", "trip", "travel", "family"]
COPY_WORDS = [" copy", "-copy", "_copy", "copy of ", " - copy", " (copy)"]
ORIENTATION_DEGREES = {6: 90, 3: 180, 8: 270}
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "heic", "heif", "raw", "cr2", "nef", "arw"]
NO_CATEGORY = "{NO_CAT}"


# vectors
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, empty vectors and zero norms."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """The largest float where the lengths differ."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(squares)).otherwise(F.lit(3.4028234663852886e38))


def unit(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


# duplicates
def quality_score(width: Column, height: Column, size: Column, taken: Column) -> Column:
    pixels = F.coalesce(F.floor(width.cast("bigint") * height.cast("bigint") / 10000), F.lit(0))
    return (pixels + F.floor(F.coalesce(size, F.lit(0)) / 100000) + F.when(taken.isNotNull(), 10).otherwise(0)).cast("bigint")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def copy_suffix(name: Column) -> Column:
    """A counter in brackets or behind - or _ at the end of the stem, or a word for copy in the name."""
    low = F.lower(name)
    words = F.lit(False)
    for w in COPY_WORDS:
        words = words | low.contains(w)
    return stem(low).rlike(r" \([0-9]+\)(?!.* \()") | stem(low).rlike(r"[_-][0-9]+$") | words


def filename_score(path: Column, name: Column) -> Column:
    return (F.when(copy_suffix(name), 1000).otherwise(0) + F.octet_length(path)).cast("bigint")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (x, y, w, h); 0 for an empty union."""
    w = F.greatest(F.lit(0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    both = w * h
    union = a[2] * a[3] + b[2] * b[3] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def padded(start: str, size: str, whole: Column) -> tuple[Column, Column]:
    """(start, size) of a box side with a fifth of its size added at both ends, clamped to the image."""
    pad = F.expr(f"{size} div 5").cast("int")
    first = F.greatest(F.lit(0), F.col(start) - pad)
    return first, F.least(F.col(size) + 2 * pad, whole - first)


def rotation(orientation: Column, user: Column) -> Column:
    turned = F.lit(0)
    for code, degrees in ORIENTATION_DEGREES.items():
        turned = F.when(F.coalesce(orientation, F.lit(1)) == code, degrees).otherwise(turned)
    return F.pmod(turned + F.coalesce(user, F.lit(0)), F.lit(360)).cast("int")


# organising
def sanitise(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def event(tags: Column, description: Column) -> Column:
    """The first event word in the tags, else in the description."""
    chain = lambda c: F.coalesce(*(F.when(F.lower(c).contains(w), F.lit(w)) for w in EVENT_WORDS))
    return F.coalesce(chain(tags), chain(description))


def brief(description: Column, words: int = 4) -> Column:
    first = F.filter(F.split(F.split(description, r"\.")[0], r"\s+"), lambda w: w != "")
    text = sanitise(F.array_join(F.slice(first, 1, words), " "))
    return F.when(text != "", text)


def taken_time(text: Column) -> Column:
    """The wall clock of the two written forms of taken_at, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def destination_folder(root: Column, taken: Column) -> Column:
    return F.concat_ws("/", root, F.coalesce(F.date_format(taken_time(taken), "yyyy/MM"), F.lit("unknown")))


# schedules
def within_hours(hour: Column, start: Column, end: Column) -> Column:
    """Whether an hour lies in a window that may run over midnight; no window means always, an empty one never."""
    day = (hour >= start) & (hour < end)
    night = (hour >= start) | (hour < end)
    return F.when(start.isNull() | end.isNull(), True).otherwise(F.when(start <= end, day).otherwise(night))


# display
def size_text(size: Column, short: bool = False) -> Column:
    units = ["B", "K", "M", "G"] if short else [" bytes", " KB", " MB", " GB"]
    scaled = lambda k: F.format_string(f"%.1f{units[k]}", F.bround(size / float(1024**k), 1))
    return F.when(size >= 1024**3, scaled(3)).when(size >= 1024**2, scaled(2)).when(size >= 1024, scaled(1)).otherwise(F.concat(size.cast("string"), F.lit(units[0])))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def camera_line(aperture: Column, shutter: Column, iso: Column, focal: Column) -> Column:
    return F.concat_ws(
        " | ",
        F.when(aperture.isNotNull(), F.format_string("f/%.1f", aperture)), F.when(shutter.isNotNull(), F.concat(shutter, F.lit("s"))),
        F.when(iso.isNotNull(), F.format_string("ISO %d", iso)), F.when(focal.isNotNull(), F.format_string("%.0fmm", focal)),
    )


def dms(degrees: Column, minutes: Column, seconds: Column, side: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(side).isin("S", "W"), -value).otherwise(value)


# paths and JSON
def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def under(path: Column, directory: str) -> Column:
    """Strictly below a directory."""
    return path.startswith(directory.rstrip("/") + "/")


def string_array(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def long_array(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "array<bigint>"), F.array().cast("array<bigint>"))
