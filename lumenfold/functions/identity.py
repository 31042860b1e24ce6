"""Normal forms of digests, identifiers, names and values that stand for no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.timestamps import STRIP

# What people and devices write for "no value" (lower case, outer signs removed).
STAND_INS = (
    "", "n/a", "na", "n.a", "none", "null", "nil", "nan", "unknown", "unknown make", "unknown model", "unknown camera",
    "unspecified", "undefined", "not available", "not set", "not known", "no value", "missing", "empty", "tbd", "default", "void",
)
# The extensions of video containers; every other file counts as an image.
VIDEO_EXTENSIONS = (
    ".3g2", ".3gp", ".avi", ".flv", ".m2t", ".m2ts", ".m4v", ".mkv", ".mov", ".mp4",
    ".mpeg", ".mpg", ".mts", ".mxf", ".ogv", ".qt", ".ts", ".vob", ".webm", ".wmv",
)
# Fixed value: the shape of a generated name (RFC 4122 versions 1 to 5).
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def digest(text: Column) -> Column:
    """SHA-256 in one spelling: no blanks, no ``sha256:`` label, lower case; blank or no digest is null."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(text, STRIP, "")), r"^(?:sha-?256[:=\s]\s*|0x)", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def content_identifier(text: Column) -> Column:
    """Blanks stripped, then NUL and braces, then case folded; nothing left is null."""
    bare = F.regexp_replace(F.regexp_replace(text, STRIP.replace(r"\x00-\x1f", r"\x1c-\x1f"), ""), r"^[\x00{}]+|[\x00{}]+$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def usable(text: Column) -> Column:
    """The text holds a value: a letter or digit is in it and it is not a stand-in for no value."""
    bare = F.lower(F.regexp_replace(text, r"^[\s\x00-\x1f\p{Z}\p{P}\p{S}]+|[\s\x00-\x1f\p{Z}\p{P}\p{S}]+$", ""))
    return F.coalesce(~F.regexp_replace(bare, r"[\s\p{Z}_]+", " ").isin(*STAND_INS), F.lit(False))


def media_type(declared: Column, extension: Column) -> Column:
    """``image`` or ``video``: as declared in any case, else by the extension."""
    said = F.lower(F.regexp_replace(declared, STRIP, ""))
    return F.when(said.isin("image", "video"), said).otherwise(
        F.when(F.lower(F.trim(extension)).isin(*VIDEO_EXTENSIONS), "video").otherwise("image")
    )


def stem(filename: Column) -> Column:
    """The name without its last suffix; a leading dot begins no suffix, a last dot ends none."""
    return F.regexp_replace(filename, r"(?s)^(.+)\.[^.]+$", "$1")


def uuid_name(filename: Column) -> Column:
    return stem(filename).rlike(UUID)


def human_readable(filename: Column) -> Column:
    """A letter of any script in the stem, and no generated name."""
    return stem(filename).rlike(r"\p{L}") & ~uuid_name(filename)
