"""Devices, mounts and probe results as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import names as N

# Fixed values.
CLUSTER_BYTES = 32_768
CONFIRM_GB = 64.0
COVER_TAGS = ("apic", "covr", "metadata_block_picture")
TAGS = "map<string,string>"
PROBE = f"struct<streams: array<struct<codec_type: string, codec_name: string, bit_rate: string, sample_rate: string, disposition: struct<attached_pic: int>, tags: {TAGS}>>, format: struct<tags: {TAGS}>>"


def mounts(lines: DataFrame) -> DataFrame:
    """device, mount_point, fs_type from lines (value) of a mount table; loop devices and others are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("_p")).where("size(_p) >= 3")
    rows = rows.select(F.col("_p")[0].alias("device"), F.col("_p")[1].alias("mount_point"), F.col("_p")[2].alias("fs_type"))
    return rows.where(F.col("device").startswith("/dev/") & ~F.col("device").startswith("/dev/loop"))


def joined_identity(devices: DataFrame, identity: DataFrame) -> DataFrame:
    """devices (device) with the columns of identity (block), found by the device's parent block."""
    return devices.withColumn("block", N.parent_device(F.regexp_extract("device", r"([^/]*)\z", 1))).join(identity, "block", "left")


def at_mount(devices: DataFrame, path: str) -> DataFrame:
    """The devices mounted at a path, trailing slashes aside."""
    return devices.where(F.regexp_replace("mount_point", r"(.)/+\z", "$1") == (path.rstrip("/") or "/"))


def little_endian(block: Column, at: int) -> Column:
    """The unsigned 16-bit number at a byte offset."""
    byte = lambda k: F.conv(F.hex(F.substring(block, at + k + 1, 1)), 16, 10).cast("int")
    return byte(0) + byte(1) * 256


def allocation_unit(block: Column) -> Column:
    """Bytes of a cluster from a FAT boot sector, or null where there is no signature or no size."""
    per = F.conv(F.hex(F.substring(block, 14, 1)), 16, 10).cast("int")
    size = (little_endian(block, 11) * per).cast("bigint")
    return F.when((F.octet_length(block) >= 512) & (F.hex(F.substring(block, 511, 2)) == "55AA") & (size > 0), size)


def sectors_per_cluster(sector_bytes: Column) -> Column:
    return F.when((sector_bytes > 0) & (F.lit(CLUSTER_BYTES) % F.nullif(sector_bytes, F.lit(0)) == 0), F.expr(f"{CLUSTER_BYTES}L") / sector_bytes).cast("bigint")


def identity_key(label: Column, vendor: Column, model: Column, serial: Column, uuid: Column, device: Column, total: Column) -> Column:
    parts = [N.null_if_empty(F.regexp_replace(c, r"^\s+|\s+\z", "")) for c in (label, vendor, model, serial, uuid)]
    key = F.concat_ws("__", *parts)
    return F.when(key == "", F.concat_ws("__", device, total.cast("string"))).otherwise(key)


def eligibility(fs_type: Column, removable: Column) -> Column:
    """Why a device is refused, or null."""
    return F.when(~fs_type.isin("vfat", "fat32"), "filesystem").when(~removable, "not_removable")


def needs_reformat(fs_type: Column, unit: Column) -> Column:
    return ~fs_type.isin("vfat", "fat32") | F.coalesce(unit != CLUSTER_BYTES, F.lit(False))


def needs_confirmation(total: Column) -> Column:
    return gigabytes(total) > CONFIRM_GB


def megabytes(size: Column) -> Column:
    return size / float(1 << 20)


def gigabytes(size: Column) -> Column:
    return size / float(1 << 30)


def parsed_probe(json: Column) -> Column:
    return F.from_json(json, PROBE)


def _cover_tag(tags: Column) -> Column:
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: F.lower(k).isin(*COVER_TAGS)), F.lit(False))


def has_cover(probe: Column) -> Column:
    stream = F.exists(probe["streams"], lambda s: F.coalesce(s["disposition"]["attached_pic"] == 1, F.lit(False)) | _cover_tag(s["tags"]))
    return F.coalesce(stream, F.lit(False)) | _cover_tag(probe["format"]["tags"])


def has_video(probe: Column) -> Column:
    return F.coalesce(F.exists(probe["streams"], lambda s: F.coalesce(s["codec_type"] == "video", F.lit(False))), F.lit(False))


def has_tags(probe: Column) -> Column:
    some = lambda tags: F.coalesce(F.cardinality(tags) > 0, F.lit(False))
    return F.coalesce(F.exists(probe["streams"], lambda s: some(s["tags"])), F.lit(False)) | some(probe["format"]["tags"])


def profile(probe: Column) -> dict[str, Column]:
    """codec, bitrate, sample_rate of the first audio stream, else the first stream; null where there is none. Unreadable numbers are 0."""
    sound = F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    stream = F.coalesce(sound, F.get(probe["streams"], F.lit(0)))
    number = lambda c: F.when(stream.isNotNull(), F.coalesce(F.when(c.rlike(r"^\+?[0-9]{1,10}\z"), c.try_cast("bigint")), F.lit(0).cast("bigint")))
    return {"codec": F.when(stream.isNotNull(), F.coalesce(stream["codec_name"], F.lit("unknown"))), "bitrate": number(stream["bit_rate"]), "sample_rate": number(stream["sample_rate"])}


def protected(path: Column, said: Column, complained: Column) -> Column:
    """Whether a file is under rights management, by its name or what a probe wrote to its output and error streams."""
    said, complained = F.lower(F.coalesce(said, F.lit(""))), F.lower(F.coalesce(complained, F.lit("")))
    return F.lower(path).endswith(".m4p") | said.contains("drms") | said.contains("drm_") | said.contains("fairplay") | complained.contains("encrypted")


def size_problem(size: Column, most: int = 5 << 20) -> Column:
    return F.when(size < 1024, "too_small").when(size > most, "too_large")
