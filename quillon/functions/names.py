"""Name and path functions as Spark columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
AUDIO_EXTENSIONS = ("mp3", "flac", "wav", "ogg", "m4a", "alac", "aac", "wma", "opus", "aiff")
PER_VOLUME = 50
NAME_BYTES = 32


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^(?s:.+)\.([^.]*)\z", 1))


def hash8(sha: Column) -> Column:
    return F.substring(F.lower(F.regexp_replace(sha, "[^0-9a-fA-F]", "")), 1, 8)


def hash8_of_name(name: Column) -> Column:
    return null_if_empty(F.regexp_extract(F.lower(name), r"_([0-9a-f]{8})\.mp3\z", 1))


def volume_index(folder: Column) -> Column:
    return null_if_empty(F.regexp_extract(folder, r"^(?:VOL_)+\+?([0-9]+)\z", 1)).try_cast("bigint")


def lenient_index(name: Column) -> Column:
    return null_if_empty(F.regexp_extract(name, r"^\+?([0-9]+)_", 1)).try_cast("bigint")


def strict_digits(name: Column) -> Column:
    return null_if_empty(F.regexp_extract(name, r"^([0-9]{3,4})_", 1))


def safe_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._-]{1,32}\z")


def shell_unsafe(name: Column) -> Column:
    return name.rlike("[;|&$()<>`'\"\\\\\n\r]")


def filename_problem(name: Column) -> Column:
    """Why a file name is refused, or null."""
    return (
        F.when(name == "", "empty")
        .when(name.contains("..") | name.contains("/") | name.contains("\\"), "traversal")
        .when(shell_unsafe(name), "shell")
        .when(F.octet_length(name) > 255, "long")
    )


def hash8_or_zeros(sha: Column) -> Column:
    """The first eight hex digits of a hash, whatever its length; zeros where there are fewer."""
    short = hash8(sha)
    return F.when(F.length(short) == 8, short).otherwise("00000000")


def is_sha256(c: Column) -> Column:
    return c.rlike(r"^[0-9a-fA-F]{64}\z")


def slug_with_hash(raw: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.when(slug == "", "device").otherwise(slug), F.lit("_"), F.substring(F.sha2(raw, 256), 1, 8))


def simple_stem(raw: Column) -> Column:
    """Lower-case ASCII stem: runs of other characters become one underscore, at most 64 characters."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(F.when(stem == "", "audio").otherwise(stem), 1, 64)


def sequential_name(stem: Column, index: Column, ext: str = ".mp3") -> Column:
    prefix = F.format_string("%04d_", index)
    return F.concat(prefix, stem.substr(F.lit(1), F.lit(NAME_BYTES - len(ext)) - F.length(prefix)), F.lit(ext))


def hashed_name(stem: Column, index: Column, sha: Column) -> Column:
    """NNNN_stem padded with underscores, then _hash8.mp3: exactly 32 characters."""
    prefix = F.format_string("%04d_", index)
    room = F.lit(NAME_BYTES - 13) - F.length(prefix)
    padded = F.concat(stem, F.repeat(F.lit("_"), F.lit(NAME_BYTES))).substr(F.lit(1), room)
    return F.concat(prefix, padded, F.lit("_"), hash8_or_zeros(sha), F.lit(".mp3"))


def parent_device(name: Column) -> Column:
    return F.when(name.rlike("^(nvme|mmcblk)"), F.regexp_replace(name, r"p[^p]*\z", "")).otherwise(F.regexp_replace(name, r"[0-9]+\z", ""))


def fat_label(label: Column) -> Column:
    return null_if_empty(F.substring(F.upper(F.regexp_replace(label, "[^A-Za-z0-9_]", "")), 1, 11))


def planned_volume(row: Column, first: int = 1, filled: int = 0) -> Column:
    """Volume of the row-th new file when volume `first` already holds `filled` files."""
    return F.lit(first) + F.floor((F.lit(filled) + row - 1) / PER_VOLUME)


def natural_key(name: Column) -> Column:
    """Sort key of natural order: A-Z without case, digit runs by value, then by their length with zeros.

    Every run is written as 0, the length of its digits, the digits and its length, so against other characters it compares as a digit does.
    """
    low = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def coded(run: Column) -> Column:
        digits = F.coalesce(null_if_empty(F.regexp_replace(run, "^0+", "")), F.lit("0"))
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.format_string("%04d", F.length(digits)), digits, F.format_string("%04d", F.length(run)))).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(low, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), coded), "")


def media_decision(codec: Column, rate: Column, bits: Column, dirty: Column) -> Column:
    safe = (codec == "mp3") & (rate == 44100) & bits.between(120_000, 320_000)
    return F.when(safe & ~dirty, "rename").when(safe, "copy_clean").otherwise("transcode")
