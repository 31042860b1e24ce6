"""Inventory reads, exclusions, state changes and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import path_name, path_parent, safe_relative


def scan_filter(
    df: DataFrame, path: str, directories: Sequence[str], prefixes: Sequence[str], suffixes: Sequence[str], extensions: Sequence[str]
) -> DataFrame:
    """Drop excluded directories (exact names), name prefixes and suffixes; keep listed extensions."""
    p, name = F.col(path), path_name(F.col(path))
    none = F.lit(False)
    keep = ~F.arrays_overlap(F.split(path_parent(p), "/"), F.array(*[F.lit(d) for d in directories]))
    for x in prefixes:
        keep &= ~name.startswith(x)
    for x in suffixes:
        keep &= ~name.endswith(x)
    return df.where(F.coalesce(keep, none) & F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)).isin(*extensions))


def changed(a: Column, b: Column) -> Column:
    """Different values; unknown on either side is no change."""
    return F.coalesce(a != b, F.lit(False))


def review(inventory: DataFrame, observed: DataFrame, key: str = "asset_id") -> DataFrame:
    """(key, reason) of rows that no longer match a fresh scan; the first reason holds.

    ``observed`` has the key, obs_size and obs_mtime, and may have ``regular``, false for what is no
    regular file; a row without partner is missing.
    """
    regular = F.col("regular") if "regular" in observed.columns else F.lit(True)
    reason = (
        F.when(~safe_relative(F.col("relative_path")), "unsafe_path")
        .when(F.col("__seen").isNull(), "missing")
        .when(~F.coalesce(regular, F.lit(True)), "non_regular_file")
        .when(changed(F.col("size_bytes"), F.col("obs_size")), "size_changed")
        .when(changed(F.col("mtime_ns"), F.col("obs_mtime")), "mtime_changed")
    )
    seen = observed.withColumn("__seen", F.lit(True))
    return inventory.join(seen, key, "left").select(key, reason.alias("reason")).where("reason is not null")


def upsert(stored: DataFrame, scanned: DataFrame, key: str = "asset_id") -> DataFrame:
    """The next snapshot of an inventory: scanned rows replace stored ones; a changed size or mtime
    resets the digest; rows not scanned stay and count as missing. A full join by key."""
    o, n = stored.alias("o"), scanned.alias("n")
    new, old = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    reset = old & new & (changed(F.col("o.size_bytes"), F.col("n.size_bytes")) | changed(F.col("o.mtime_ns"), F.col("n.mtime_ns")))
    pick = lambda c: F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(
        F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), pick("size_bytes"), pick("mtime_ns"),
        F.when(~old | reset, "pending").otherwise(F.col("o.hash_status")).alias("hash_status"),
        F.when(old & ~reset, F.col("o.sha256")).alias("sha256"),
        F.when(new, "available").otherwise("missing").alias("scan_status"),
    )


def refreshed(stored: DataFrame, written: DataFrame, key: str = "asset_id", fields: Sequence[str] = ("size_bytes", "sha256")) -> DataFrame:
    """(key, fields, refreshed): the identity of stored files after some were written again.

    Files of ``written`` take its values and count as refreshed if any differs; nulls equal nulls.
    """
    new = written.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    rows = stored.join(new, F.col(key) == F.col("__k"), "left")
    known = F.col("__k").isNotNull()
    differs = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"__{f}")) for f in fields])
    return rows.select(key, *[F.when(known, F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in fields], (known & differs).alias("refreshed"))


def missing_at(snapshots: DataFrame, clean: DataFrame, source: str, number: str, key: str) -> DataFrame:
    """(source, number, key): the clean scan at which each record is first found missing, every time it is.

    Only a scan of ``clean`` (source, number), without error, can tell that a record is gone: the next
    one after the last sight of it, in whatever scan that was. A record seen again may go again. One
    window by record, of as many rows as there are snapshots; the clean scans are a small table.
    """
    order = Window.partitionBy(source, key).orderBy(number)
    seen = snapshots.select(source, key, number).dropna().distinct().withColumn("__again", F.lead(number).over(order))
    scans = clean.select(source, number).dropna().distinct()
    every = snapshots.select(source, number).dropna().distinct()
    after = (
        every.join(scans.select(source, F.col(number).alias("__at")), source).where(F.col("__at") > F.col(number))
        .groupBy(source, number).agg(F.min("__at").alias("__at"))
    )
    gone = seen.join(after, [source, number]).where(F.col("__again").isNull() | (F.col("__again") > F.col("__at")))
    return gone.select(source, F.col("__at").alias(number), key)


def inside(df: DataFrame, group: str, folder: str) -> DataFrame:
    """(group, folder, inside): folders of a group that lie inside another of it.

    Every ancestor of a folder is a row, so overlap is an equality and no pairs of folders are compared.
    """
    ups = F.expr(f"transform(sequence(1, size(split(`{folder}`, '/')) - 1), k -> array_join(slice(split(`{folder}`, '/'), 1, k), '/'))")
    up = df.where(F.size(F.split(folder, "/")) > 1).select(group, folder, F.explode(ups).alias("inside"))
    return up.join(df.select(group, F.col(folder).alias("inside")), [group, "inside"]).select(group, folder, "inside")


def counted(**conditions: str) -> list[Column]:
    """Named counts of rows meeting a condition, 0 over no rows."""
    return [F.expr(f"count_if({c})").alias(n) for n, c in conditions.items()]


def missing_fields(df: DataFrame, rules: dict[str, str], key: str = "asset_id") -> DataFrame:
    """(key, missing): the labels of the rules that hold, joined by ``;``; only rows with any."""
    labels = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in rules.items()]))
    return df.select(key, F.array_join(labels, ";").alias("missing")).where("missing != ''")


#: Rules of ``missing_fields`` for the metadata of images and videos.
METADATA = {
    "captured_at": "captured_at is null", "dimensions": "width is null or height is null", "camera": "media_type = 'image' and (camera_make is null or camera_model is null)",
    "gps": "media_type = 'image' and (latitude is null or longitude is null)", "duration": "media_type = 'video' and duration_seconds is null",
    "video_codec": "media_type = 'video' and video_codec is null",
}


def last_write(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """INSERT OR REPLACE: of rows with equal keys the last one."""
    others = [c for c in df.columns if c not in (*keys, *by)]
    best = F.max(F.struct(*by, *others)).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in (*by, *others)])


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page of a report; the limit is held between 1 and 200, the offset at 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))
