"""What the first bytes of audio files say, decoded bit by bit with SQL functions: MPEG frames, RIFF waves and FLAC streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.sanitize import let

# Kilobits a second by the four bits of a frame, for versions 1 and 2 and their layers.
KBPS = {
    "11": (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    "12": (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    "13": (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    "21": (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    "22": (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


def unsigned(block: Column, at: Column | int, n: int) -> Column:
    """The big-endian number of n bytes (seven at most) from a byte offset; null where the block ends before."""
    part = F.substring(block, F.lit(at + 1) if isinstance(at, int) else (at + 1).cast("int"), F.lit(n))
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("bigint"))


def unsigned_little(block: Column, at: int, n: int) -> Column:
    return sum((unsigned(block, at + k, 1) * (1 << 8 * k) for k in range(n)), F.lit(0).cast("bigint"))


def _bits(word: Column, low: int, n: int) -> Column:
    return F.shiftright(word, low).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))


def audio_start(block: Column) -> Column:
    """Bytes of the tag before the first frame: its size is written seven bits a byte, without its head and foot."""
    size = sum((unsigned(block, 6 + k, 1).bitwiseAND(F.lit(127).cast("bigint")) * (1 << 7 * (3 - k)) for k in range(4)), F.lit(0).cast("bigint"))
    foot = F.when(_bits(unsigned(block, 5, 1), 4, 1) == 1, 10).otherwise(0)
    return F.when(F.hex(F.substring(block, 1, 3)) == "494433", size + 10 + foot).otherwise(F.lit(0).cast("bigint"))


def _info(codec: Column, rate: Column, channels: Column, bits: Column, bitrate: Column) -> Column:
    values = {"codec": codec, "sample_rate": rate.cast("int"), "channels": channels.cast("int"), "sample_bits": bits.cast("int"), "bitrate": bitrate.cast("bigint")}
    return F.struct(*[v.alias(k) for k, v in values.items()])


def mpeg(block: Column) -> Column:
    """codec, sample_rate, channels, sample_bits (null), bitrate of the first frame; null where no frame begins."""

    def frame(word: Column) -> Column:
        version, layer = _bits(word, 19, 2), 4 - _bits(word, 17, 2)
        step, pace = _bits(word, 12, 4), _bits(word, 10, 2)
        row = F.when(version == 3, layer - 1).when(layer == 1, 3).otherwise(4)
        kbps = F.get(F.get(F.array(*[F.array(*map(F.lit, r)) for r in KBPS.values()]), row.cast("int")), step.cast("int"))
        rate = F.get(F.array(*map(F.lit, RATES)), pace.cast("int")) / F.when(version == 3, 1).when(version == 2, 2).otherwise(4)
        fits = (_bits(word, 21, 11) == 2047) & (version != 1) & (layer != 4) & (step != 15) & (pace != 3)
        return F.when(fits, _info(F.concat(F.lit("mp"), layer.cast("string")), rate, F.when(_bits(word, 6, 2) == 3, 1).otherwise(2), F.lit(None), kbps * 1000))

    return let(unsigned(block, audio_start(block), 4), frame)


def riff(block: Column) -> Column:
    """The same of a wave file whose format stands first; codec pcm, or wav and the number of another coding."""
    form = unsigned_little(block, 20, 2)
    fits = (F.hex(F.substring(block, 1, 4)) == "52494646") & (F.hex(F.substring(block, 9, 8)) == "57415645666D7420")
    codec = F.when(form == 1, "pcm").otherwise(F.concat(F.lit("wav"), form.cast("string")))
    return F.when(fits, _info(codec, unsigned_little(block, 24, 4), unsigned_little(block, 22, 2), unsigned_little(block, 34, 2), unsigned_little(block, 28, 4) * 8))


def flac(block: Column, size: Column) -> Column:
    """The same of a FLAC file of `size` bytes: its bitrate is the mean over its samples, null where their number is not known."""
    rate, samples = F.shiftright(unsigned(block, 18, 3), 4), unsigned(block, 21, 5).bitwiseAND(F.lit((1 << 36) - 1))
    wide = unsigned(block, 20, 2)
    fits = (F.hex(F.substring(block, 1, 4)) == "664C6143") & (_bits(unsigned(block, 4, 1), 0, 7) == 0)
    bitrate = F.floor(F.try_divide(size * 8 * rate, F.nullif(samples, F.lit(0).cast("bigint"))))
    return F.when(fits, _info(F.lit("flac"), rate, _bits(wide, 9, 3) + 1, _bits(wide, 4, 5) + 1, bitrate))


def stream_info(block: Column, size: Column) -> Column:
    """codec, sample_rate, channels, sample_bits, bitrate of an audio file by its first bytes; null where none of the formats fits."""
    return let(F.struct(block.alias("b"), size.alias("n")), lambda v: F.coalesce(flac(v["b"], v["n"]), riff(v["b"]), mpeg(v["b"])))
