"""Archive metadata, names and paths, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

META_FILE, SUFFIX = "eda_data.txt", ".eda"  # fixed values of the archive format


def codec_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def utc_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def build_meta(codec: Column, name: Column, is_dir: Column, extension: Column, at: Column) -> Column:
    """``key=value`` lines, each with a line feed; the extension only for files.  ``name`` is the
    whole file name; ``at`` is a UTC timestamp."""
    kind = F.when(is_dir, "directory").otherwise("file")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("codec="), codec),
        F.concat(F.lit("source_name="), name),
        F.concat(F.lit("source_type="), kind),
        F.when(~is_dir, F.concat(F.lit("source_extension="), extension)),
        F.concat(F.lit("archived_at="), utc_text(at)),
    )
    return F.concat(lines, F.lit("\n"))


def meta_pairs(text: Column) -> Column:
    """array<struct<key, value>>: lines with ``=`` cut at the first one, trimmed, in order."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.contains(x, F.lit("=")))
    strip = r"^\s+|\s+$"
    return F.transform(lines, lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, r"^([^=]*)=", 1), strip, "").alias("key"), F.regexp_replace(F.regexp_extract(x, r"^[^=]*=(.*)$", 1), strip, "").alias("value")))


def parse_meta(text: Column) -> Column:
    """map<string, string>; of repeated keys the last wins."""
    pairs = meta_pairs(text)
    kept = F.aggregate(pairs, F.lit(None).cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def packed_name(name: Column) -> Column:
    return F.concat(name, F.lit(SUFFIX))


def unpacked_name(archive: Column, is_dir: Column, source_name: Column, extension: Column) -> Column:
    """Directory: the archive's stem.  File: the stored name, with its extension if missing."""
    stem = codec_name(archive)
    name = F.coalesce(source_name, stem)
    ext = F.coalesce(extension, F.lit(""))
    return F.when(is_dir, stem).otherwise(F.when((ext != "") & ~F.endswith(name, ext), F.concat(name, ext)).otherwise(name))


def megabytes(size: Column) -> Column:
    """A number of bytes as text in units of a million, with one digit (half up)."""
    tenths = F.floor((size + 50_000) / 100_000)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))


def is_safe_path(path: Column) -> Column:
    """Relative, and without a step out of the target."""
    return F.coalesce(~F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & (path != "") & ~path.rlike(r"^[A-Za-z]:") & ~F.contains(path, F.lit("\x00")), F.lit(False))


def relative_path(path: Column, root: Column) -> Column:
    return F.substring(path, F.length(root) + F.lit(2), F.length(path))
