"""Column functions on paths, names, evidence strings and report figures. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_parent(path: Column) -> Column:
    """All but the last component; empty without a slash."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def path_suffix(name: Column) -> Column:
    """The last suffix with its dot; a leading dot begins none and a last dot ends none."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def normalised_stem(stem: Column) -> Column:
    """Lower case; the edited-photo form img_e123 becomes img_123."""
    return F.regexp_replace(F.lower(stem), r"^img_e([0-9]+)$", "img_$1")


def nearby(a: Column, b: Column) -> Column:
    """Two directories are equal, or have the same parent."""
    return (a == b) | (path_parent(a) == path_parent(b))


def safe_relative(path: Column) -> Column:
    """Relative, and no component is empty, ``.`` or ``..``."""
    return ~path.startswith("/") & ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit(""), F.lit("."), F.lit("..")))


def sanitise_component(text: Column, most: int = 120) -> Column:
    """A safe path component: slashes to ``_``, controls dropped, blanks collapsed, cut before the suffix."""
    clean = F.regexp_replace(F.translate(text, "/\\", "__"), r"[\x00-\x1f\x7f]", "")
    clean = F.trim(F.regexp_replace(clean, r" +", " "))
    clean = F.when(clean.isin("", ".", ".."), "unnamed").otherwise(clean)
    suffix = path_suffix(clean)
    room = F.greatest(F.lit(1), F.lit(most) - F.length(suffix))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, F.lit(1), room), suffix))


def disambiguate(name: Column, mark: Column, most: int = 120) -> Column:
    """``stem__a<mark>.ext``, the stem cut to the room that is left; null if there is none."""
    suffix = path_suffix(name)
    tail = F.concat(F.lit("__a"), mark.cast("string"), suffix)
    room = F.lit(most) - F.length(tail)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    return F.when(room >= 1, F.concat(F.substring(stem, F.lit(1), room), tail))


def import_name(name: Column, ident: Column, again: Column | None = None) -> Column:
    """``stem__import_<8-digit id>.ext``, with ``_1`` repeated for every further clash."""
    suffix = path_suffix(name)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    more = F.lit("") if again is None else F.repeat(F.lit("_1"), again)
    return F.concat(stem, F.lit("__import_"), F.lpad(ident.cast("string"), 8, "0"), more, suffix)


def case_fold(text: Column) -> Column:
    """Case folded as file systems compare names: by way of upper case, with one sigma and ß as ss.

    All in the JVM; of the letters that fold to several only ß does so here (``unicode`` has the others).
    """
    return F.translate(F.regexp_replace(F.lower(F.upper(text)), "[ßẞ]", "ss"), "ς", "σ")


def source_root(path: Column, relative: Column) -> Column:
    """The root above a relative path; null where the path does not end with it."""
    return F.when(F.endswith(path, F.concat(F.lit("/"), relative)), F.substring(path, F.lit(1), F.length(path) - F.length(relative) - 1))


def destination_path(template: str, fields: dict[str, Column]) -> Column:
    """A template such as ``{year}/{month}/{original_name}``, compiled to one concat."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(fields[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def date_fields(wall: Column, fallback: str = "undated") -> dict[str, Column]:
    """Year to second of a wall-clock timestamp; without one the fallback year, 00 and ``undated``."""
    part = lambda f, none: F.coalesce(F.date_format(wall, f), F.lit(none))
    return {
        "year": part("yyyy", fallback), "month": part("MM", "00"), "day": part("dd", "00"), "hour": part("HH", "00"),
        "minute": part("mm", "00"), "second": part("ss", "00"), "timestamp": part("yyyyMMdd_HHmmss", "undated"),
    }


def evidence_value(evidence: Column, key: str) -> Column:
    """The value of the first ``key=`` in ``k=v;k=v``; null without one."""
    return F.when(
        F.concat(F.lit(";"), evidence).contains(f";{key}="), F.regexp_extract(evidence, rf"(?:^|;){key}=([^;]*)", 1)
    )


def format_bytes(size: Column) -> Column:
    """IEC units: bytes whole, below 10 two decimals, else one."""
    out = F.concat(size.cast("bigint").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB")):
        value = size.cast("double") / float(1024 ** (k + 1))
        # tenths and hundredths by integer rounding, the same in any engine
        out = F.when(size >= 1024 ** (k + 1), F.concat(F.format_string("%.2f", F.floor(value * 100 + 0.5) / 100), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """``3h 42m``, ``5m 07s`` or ``12s``; negative counts as 0."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return (
        F.when(s >= 3600, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m")))
        .when(s >= 60, F.concat(m.cast("string"), F.lit("m "), two(s % 60), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )


def frame_rate(text: Column) -> Column:
    """``a/b`` or a number; null if unreadable or divided by zero."""
    parts = F.split(text, "/")
    number = lambda c: F.expr("0.0D") + c.try_cast("double")
    return F.when(F.size(parts) == 2, F.try_divide(number(F.get(parts, F.lit(0))), F.nullif(number(F.get(parts, F.lit(1))), F.lit(0.0)))).otherwise(
        F.when(F.size(parts) == 1, number(text))
    )


def gps_degrees(d: Column, m: Column, s: Column, hemisphere: Column, most: float) -> Column:
    """Degrees, minutes and seconds to signed degrees; null out of range."""
    value = d + m / 60 + s / 3600
    value = F.when(F.upper(hemisphere).isin("S", "W"), -value).otherwise(value)
    return F.when((d >= 0) & m.between(0, 59.999999) & s.between(0, 59.999999) & (F.abs(value) <= most), value)


def altitude(value: Column, below: Column) -> Column:
    """Metres above the sea: negative where the reference is 1, below the sea."""
    return F.when(below == 1, -value).otherwise(value)


# The EXIF tags of capture times, the first valid one counts.
CAPTURE_TAGS = ((36867, "exif_datetime_original"), (36868, "exif_datetime_digitized"), (306, "exif_datetime"))


def exif_capture(tags: dict[int, Column]) -> Column:
    """struct(wall, offset, source) of the first valid time among the EXIF tags; null without one."""
    out = F.lit(None).cast("struct<wall:bigint,offset:bigint,source:string>")
    for tag, label in reversed(CAPTURE_TAGS):
        if tag in tags:
            wall, offset = wall_and_offset(tags[tag])
            out = F.when(wall.isNotNull(), F.struct(wall.alias("wall"), offset.cast("bigint").alias("offset"), F.lit(label).alias("source"))).otherwise(out)
    return out


def wall_and_offset(text: Column) -> tuple[Column, Column]:
    """(wall-clock microseconds, offset seconds) of an EXIF or ISO time; the offset null if it has none.

    ``YYYY:MM:DD HH:MM:SS`` or ISO 8601 with seconds; anything else, and no real time, is null.
    """
    shape = r"^([0-9]{4})[:-]([0-9]{2})[:-]([0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})((?:\.[0-9]{1,6})?)((?:Z|[+-][0-9]{2}:[0-9]{2})?)$"
    iso = F.regexp_replace(text, shape, "$1-$2-$3 $4$5")
    wall = F.when(text.rlike(shape), F.expr("0").cast("bigint") + F.unix_micros(F.try_to_timestamp(F.concat(iso, F.lit("+00:00")))))
    zone = F.when(text.rlike(shape), F.regexp_extract(text, shape, 6))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone == "Z", F.lit(0).cast("bigint")).when(
        zone.rlike("^[+-]"), sign * (F.substring(zone, 2, 2).try_cast("bigint") * 3600 + F.substring(zone, 5, 2).try_cast("bigint") * 60)
    )
    return wall, offset


def timestamp_class(left: tuple[Column, Column], right: tuple[Column, Column], near_s: int = 3) -> Column:
    """How two times agree, in five classes; see ``wall_and_offset`` for the arguments."""
    (lw, lo), (rw, ro) = left, right
    us = 1_000_000
    near = lambda d: F.abs(d) <= near_s * us
    apart = F.abs(lw - rw)
    quarter = F.rint(apart / (900 * us))
    return (
        F.when(lw.isNull() | rw.isNull(), "unavailable")
        .when(lo.isNull() & ro.isNull() & near(lw - rw), "exact_within_3_seconds")
        .when(lo.isNotNull() & ro.isNotNull() & near((lw - lo * us) - (rw - ro * us)), "exact_within_3_seconds")
        .when(near(lw - rw), "same_wall_clock_within_3_seconds")
        .when(
            (lo.isNull() != ro.isNull()) & (apart <= 14 * 3600 * us) & (quarter > 0) & near(apart - quarter * 900 * us),
            "timezone_offset_compatible",
        )
        .otherwise("incompatible")
    )


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(percent, speed, eta_s): held between 0 and 100; speed and time left null where unknown."""
    speed = F.try_divide(done.cast("double"), F.nullif(seconds.cast("double"), F.lit(0.0)))
    percent = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(done.cast("double") * 100, F.nullif(total.cast("double"), F.lit(0.0))))), F.lit(100.0))
    left = F.greatest(total - done, F.lit(0))
    return F.struct(percent.alias("percent"), speed.alias("speed"), F.try_divide(left.cast("double"), F.nullif(speed, F.lit(0.0))).alias("eta_s"))
