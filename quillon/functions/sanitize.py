"""File names made safe for simple devices, as Spark columns.

Letters with marks are folded to ASCII by their decomposition, some others by name. Greek, Cyrillic, kana, Hangul and symbols
are spelled by their Unicode names; characters of other scripts end up as separators. A null name stays null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import names as N

STEM_CHARS = 64
# Fixed values.
SYMBOL_JUNK = r"^[\s+\-*_]+"
LEADING_INDEX = r"^[0-9]+(?:[\s+\-*_]+)+"
LEADING_AD = r"(?i)^\s*\(?\s*audiomovil(?:[._\s-]*[0-9]{4})\s*\)?(?:[\s+\-*_]+)?"
TRAILING_AD = r"(?i)(?:[-_\s]*\(?\s*audiomovil(?:[._\s-]*[0-9]{4})?(?:\s*\([0-9]+\))?\s*\)?|\s*\[\s*safari music\s*\])\z"
TRAILING_NOISE = r"[\s._\-\(\)\[\]]+\z"
HASHED_STEM = r"^[0-9]{3,4}_[a-z0-9_]+_[0-9a-fA-F]{8}"
SPELLED = {"ß": "ss", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "þ": "th", "Þ": "th"}
STROKED = {"ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ð": "d", "Ð": "d", "ł": "l", "Ł": "l", "ı": "i"}


def _folds() -> tuple[str, str]:
    """Characters and the ASCII ones they become; those of the first without a partner (marks) vanish."""
    single = dict(STROKED)
    for point in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(point)) if ord(c) < 128)
        if len(base) == 1 and base.isalnum():
            single.setdefault(chr(point), base)
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(single) + marks, "".join(single.values())


_FROM, _TO = _folds()


def _spelled(point: int) -> str | None:
    """What a character is written as by its Unicode name: Greek and Cyrillic letters by the consonants that their names begin with or
    their vowel, kana and Hangul by their syllable, symbols by their names between colons."""
    char = chr(point)
    words = unicodedata.name(char, "").lower().split(" with ")[0].split()
    if len(words) > 3 and words[0] in ("greek", "cyrillic") and words[2] == "letter":
        if words[-1] in _LETTERS:
            return _LETTERS[words[-1]]
        if len(words) > 4 and "sign" in words:
            return ""
        head = words[3]
        consonants = head[: len(head) - len(head.lstrip("bcdfghjklmnpqrstvwxyz"))]
        return consonants or head[0]
    if len(words) > 2 and words[0] in ("hiragana", "katakana") and words[1] == "letter":
        return words[-1]
    if len(words) == 3 and words[:2] == ["hangul", "syllable"]:
        return words[2]
    if unicodedata.category(char) == "So" and words and point > 0x2000:
        return ":" + "_".join(words) + ":"
    return None


# Letters whose names do not begin with their sound.
_LETTERS = {"ie": "e", "io": "yo", "yu": "yu", "ya": "ya", "yi": "yi", "i": "i", "e": "e", "yeru": "y", "ha": "kh", "el": "l", "em": "m", "en": "n", "er": "r", "es": "s", "ef": "f", "phi": "f", "rho": "r", "upsilon": "y"}
HANGUL = 0xAC00
#: Blocks of characters that are spelled by name: a character's place in its block finds it at once.
BLOCKS = ((0x370, 0x52F), (0x1F00, 0x1FFF), (0x2600, 0x27BF), (0x3040, 0x30FF), (HANGUL, 0xD7A3), (0x1F300, 0x1FAFF))


def spellings() -> dict[str, str]:
    """Every character of the blocks that has a spelling; letters with marks are spelled as without."""
    out = {}
    for first, last in BLOCKS:
        for point in range(first, last + 1):
            base = unicodedata.normalize("NFD", chr(point))[0] if point < 0x2000 else chr(point)
            text = _spelled(ord(base))
            if text is not None:
                out[chr(point)] = text
    return out


_SPELLINGS = spellings()


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def _other_scripts(c: Column) -> Column:
    def spelled(char: Column) -> Column:
        point, out = F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("int"), char
        for first, last in BLOCKS:
            known = F.array(*[F.lit(_SPELLINGS.get(chr(p))) for p in range(first, last + 1)]) if first != HANGUL else None
            if known is not None:
                out = F.when(point.between(first, last), F.coalesce(F.get(known, point - first), char)).otherwise(out)
            else:  # Hangul syllables are spelled by their three parts
                place = point - first
                parts = [F.get(F.array(*map(F.lit, _jamo(k))), F.floor(place / d).cast("int") % n) for k, (d, n) in enumerate(((588, 19), (28, 21), (1, 28)))]
                out = F.when(point.between(first, last), F.concat(*parts)).otherwise(out)
        return out

    return F.when(c.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(c, ""), spelled), "")).otherwise(c)


def _jamo(part: int) -> list[str]:
    """The spellings of the first, middle or last parts of Hangul syllables, read off the syllables' names."""
    name = lambda a, b, c: _SPELLINGS[chr(HANGUL + 588 * a + 28 * b + c)]
    middle = name(11, 0, 0)  # a syllable without a first part
    if part == 0:
        return [name(a, 0, 0)[: -len(middle)] for a in range(19)]
    return [name(11, b, 0) for b in range(21)] if part == 1 else [name(11, 0, c)[len(middle) :] for c in range(28)]


def ascii_folded(c: Column) -> Column:
    for char, text in SPELLED.items():
        c = F.replace(c, F.lit(char), F.lit(text))
    return _other_scripts(F.translate(c, _FROM, _TO))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def file_stem(name: Column) -> Column:
    """Without the last extension; a leading dot begins none."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*\z", "$1")


def file_extension(name: Column) -> Column:
    """What stands after the last dot, or an empty string."""
    return F.regexp_extract(name, r"(?s)^.+\.([^.]*)\z", 1)


def audio_extension(name: Column) -> Column:
    """The audio extension in lower case, or null."""
    ext = F.lower(file_extension(name))
    return F.when(ext.isin(*N.AUDIO_EXTENSIONS), ext)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _step(c: Column) -> Column:
    """One round of stripping: symbols, an index (unless nothing else is left), advertising tags, trailing noise."""
    bare = F.regexp_replace(c, SYMBOL_JUNK, "")
    short = F.regexp_replace(bare, LEADING_INDEX, "")
    kept = F.when(_trimmed(short) == "", bare).otherwise(short)
    for pattern in (LEADING_AD, TRAILING_AD, TRAILING_NOISE):
        kept = F.regexp_replace(kept, pattern, "")
    return _trimmed(kept)


def clean_stem(stem: Column) -> Column:
    """Stripped until nothing changes. A round that changes anything shortens the name, so there are fewer rounds than characters;
    after the one that changes nothing no more are worked out."""

    def stepped(at: Column) -> Column:
        return let(_step(at["s"]), lambda new: F.struct(new.alias("s"), (new == at["s"]).alias("done")))

    def stripped(stem: Column) -> Column:
        first = F.struct(stem.alias("s"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(0), F.length(stem)), first, lambda at, _: F.when(at["done"], at).otherwise(stepped(at)))["s"]

    words = lambda s: F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), r"^_+|_+\z", "")
    return let(words(let(stem, stripped)), lambda w: F.substring(F.when(w == "", "audio").otherwise(w), 1, STEM_CHARS))


def sanitized(path: Column) -> Column:
    """The clean name of a file, its audio extension kept; names that are final already stay as they are."""

    def made(low: Column) -> Column:
        return let(audio_extension(low), lambda ext: F.concat(clean_stem(F.when(ext.isNotNull(), file_stem(low)).otherwise(low)), F.coalesce(F.concat(F.lit("."), ext), F.lit(""))))

    raw = base_name(path)
    return F.when(raw.rlike(HASHED_STEM + r"\.mp3\z"), raw).otherwise(let(base_name(F.lower(ascii_folded(path))), made))


def prefixed(name: Column, index: Column) -> Column:
    """NNNN_ and the name, at most NAME_BYTES characters, its extension kept."""

    def made(parts: Column) -> Column:
        name, head = parts["name"], parts["head"]
        ext = F.lower(file_extension(name))
        tail = F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))
        room = F.lit(N.NAME_BYTES) - F.length(head) - F.length(tail)
        whole = F.concat(head, file_stem(name), tail)
        return F.when(room < 0, F.substring(whole, 1, N.NAME_BYTES)).otherwise(F.concat(head, file_stem(name).substr(F.lit(1), room), tail))

    return let(F.struct(name.alias("name"), F.format_string("%04d_", index).alias("head")), made)


def hashed(stem: Column, index: Column, sha: Column) -> Column:
    """NNNN_stem, padded with underscores, and _hash8.mp3: exactly NAME_BYTES characters. Final stems keep their numbers."""
    head, tail = F.format_string("%04d_", index), F.concat(F.lit("_"), N.hash8_or_zeros(sha), F.lit(".mp3"))
    room = F.lit(N.NAME_BYTES) - F.length(head) - F.length(tail)
    padded = F.concat(sanitized(stem), F.repeat(F.lit("_"), F.lit(N.NAME_BYTES))).substr(F.lit(1), room)
    made = F.when(room <= 0, F.substring(F.concat(head, tail), 1, N.NAME_BYTES)).otherwise(F.concat(head, padded, tail))
    return F.when(stem.rlike(HASHED_STEM + r"\z"), F.concat(stem, F.lit(".mp3"))).otherwise(made)


def transferred(raw: Column) -> Column:
    """Stem and extension cleaned apart, at most NAME_BYTES characters; a name without an extension gets the default word as one."""

    def made(name: Column) -> Column:
        ext = F.concat(F.lit("."), F.regexp_replace(sanitized(file_extension(name)), "[^A-Za-z0-9_-]", ""))
        parts = F.struct(ext.alias("ext"), sanitized(file_stem(name)).alias("stem"))
        return let(parts, lambda p: F.when(F.length(p["ext"]) >= N.NAME_BYTES, F.substring(p["stem"], 1, N.NAME_BYTES)).otherwise(
            F.concat(p["stem"].substr(F.lit(1), F.lit(N.NAME_BYTES) - F.length(p["ext"])), p["ext"])))

    return let(base_name(raw), made)


def as_mp3(name: Column) -> Column:
    return F.concat(file_stem(name), F.lit(".mp3"))
