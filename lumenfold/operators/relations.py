"""Related assets in ordered stages; a later stage sees only what earlier ones left unpaired.

No stage emits the pairs of a key: the other side is first reduced to its number and its only or
smallest member, so a key with a third of all rows costs one aggregate row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.identity import content_identifier, media_type, stem
from lumenfold.functions.text import normalised_stem, path_parent, timestamp_class, wall_and_offset
from lumenfold.operators.relations_local import greedy
from lumenfold.session import materialise

COLUMNS = ("relationship_type", "status", "primary_id", "secondary_id", "confidence", "candidates")


def inspections(assets: DataFrame) -> DataFrame:
    """(asset_id, source_name, folder, stem_key, kind, identifier, wall, off) of available assets."""
    wall, off = wall_and_offset(F.col("captured_at"))
    return assets.where("scan_status = 'available' and size_bytes is not null and mtime_ns is not null").select(
        "asset_id", "absolute_path", "source_name", path_parent(F.col("absolute_path")).alias("folder"),
        normalised_stem(stem(F.col("filename"))).alias("stem_key"), media_type(F.col("media_type"), F.col("extension")).alias("kind"),
        content_identifier(F.col("apple_content_identifier")).alias("identifier"), wall.alias("wall"), off.alias("off"),
    )


def _edge(df: DataFrame, kind: str, status, primary: str, secondary, confidence, n="n") -> DataFrame:
    return df.select(
        F.lit(kind).alias("relationship_type"), status.alias("status"), F.col(primary).alias("primary_id"),
        secondary.cast("long").alias("secondary_id"), confidence.cast("double").alias("confidence"), F.col(n).cast("long").alias("candidates"),
    )


def exact_pairs(rows: DataFrame) -> DataFrame:
    """Images and videos of one identifier: one video is active, several are ambiguous."""
    videos = rows.where("kind = 'video' and identifier is not null").groupBy("identifier").agg(F.count("*").alias("n"), F.min("asset_id").alias("v"))
    found = rows.where("kind = 'image' and identifier is not null").join(videos, "identifier")
    one = F.col("n") == 1
    return _edge(found, "apple_live_photo", F.when(one, "active").otherwise("ambiguous"), "asset_id", F.when(one, F.col("v")), F.lit(1.0))


def one_sided_pairs(rows: DataFrame) -> DataFrame:
    """A video with an identifier and the only image without one of its source, folder and stem."""
    keys = ["source_name", "folder", "stem_key"]
    only = F.min(F.struct("asset_id", "wall", "off")).alias("i")
    images = rows.where("kind = 'image' and identifier is null").groupBy(*keys).agg(F.count("*").alias("n"), only)
    found = rows.where("kind = 'video' and identifier is not null").join(images, keys)
    found = found.withColumn("class", timestamp_class((F.col("i.wall"), F.col("i.off")), (F.col("wall"), F.col("off"))))
    active = (F.col("n") == 1) & (F.col("class") != "incompatible")
    single = F.col("n") == 1
    found = found.select("*", F.when(active, F.col("i.asset_id")).otherwise(F.col("asset_id")).alias("p"))
    return _edge(
        found, "apple_live_photo", F.when(active, "active").otherwise("ambiguous"), "p", F.when(active, F.col("asset_id")),
        F.when(single & ((F.col("class") == "incompatible") | (F.col("class") == "unavailable")), 0.85).otherwise(0.9),
    )


_CLOSE = ("exact_within_3_seconds", "same_wall_clock_within_3_seconds", "unavailable")


def only_pairs(rows: DataFrame) -> DataFrame:
    """The fallback for keys of one image and one video, by one aggregate a key and no Python."""
    keys = ["source_name", "stem_key", "parent"]
    free = rows.where("identifier is null").withColumn("parent", path_parent(F.col("folder")))
    is_image = F.col("kind") == "image"
    side = lambda c, n: F.min(F.when(c, F.struct("asset_id", "wall", "off"))).alias(n)
    ones = free.groupBy(*keys).agg(F.count_if(is_image).alias("i"), F.count_if(~is_image).alias("v"), side(is_image, "l"), side(~is_image, "r")).where("i = 1 and v = 1")
    close = timestamp_class((F.col("l.wall"), F.col("l.off")), (F.col("r.wall"), F.col("r.off"))).isin(*_CLOSE)
    return ones.where(close).select(F.lit("active").alias("status"), F.col("l.asset_id").alias("primary_id"), F.col("r.asset_id").alias("secondary_id"), F.lit(1).cast("long").alias("candidates"))


def fallback_pairs(rows: DataFrame) -> DataFrame:
    """Image and video without identifiers, of one source and stem, near in folder and time.

    Near folders have the same parent, so a group is one stem of one source below one parent. Groups
    of one image and one video are paired by an aggregate. In the others the order of the image paths
    decides contested videos; they are files of one name in sibling folders, and one task pairs them.
    """
    keys = ["source_name", "stem_key", "parent"]
    free = rows.where("identifier is null").withColumn("parent", path_parent(F.col("folder")))
    is_image = F.col("kind") == "image"
    several = free.groupBy(*keys).agg(F.count_if(is_image).alias("i"), F.count_if(~is_image).alias("v")).where("i > 0 and v > 0 and i + v > 2").select(*keys)
    schema = "status string, primary_id long, secondary_id long, candidates long"
    rest = free.join(several, keys, "left_semi").select(*keys, "absolute_path", "asset_id", "kind", "wall", "off")
    contested = rest.repartition(*keys).sortWithinPartitions(*keys, "absolute_path").mapInArrow(greedy(keys), schema)
    out = only_pairs(rows).unionByName(contested)
    return out.select(F.lit("filename_pair").alias("relationship_type"), "status", "primary_id", "secondary_id", F.lit(0.6).alias("confidence"), "candidates")


def _without(rows: DataFrame, *edges: DataFrame) -> DataFrame:
    ids = [e.select(F.col(c).alias("asset_id")) for e in edges for c in ("primary_id", "secondary_id")]
    return rows.join(reduce(DataFrame.unionByName, ids).where("asset_id is not null"), "asset_id", "left_anti")


def motion_photos(rows: DataFrame) -> DataFrame:
    """Images that hold a video (motion_kind, motion_status): an edge without a second asset."""
    found = rows.where("kind = 'image' and motion_kind is not null").withColumn("n", F.lit(1))
    active = F.col("motion_status") == "active"
    edges = _edge(found, "", F.col("motion_status"), "asset_id", F.lit(None), F.when(active, 0.99).otherwise(0.0))
    kinds = found.select(F.col("asset_id").alias("primary_id"), F.concat("motion_kind", F.lit("_motion_photo")).alias("relationship_type"))
    return edges.drop("relationship_type").join(kinds, "primary_id").select(*COLUMNS)


def detect(rows: DataFrame) -> DataFrame:
    """All stages: motion photos (if the rows tell them), exact, one-sided, filename fallback, orphans.

    The rows and the fallback's result are written to the shared folder, as several stages read them;
    everything else is one plan.
    """
    rows = materialise(rows)
    edges = []
    left = rows
    if "motion_kind" in rows.columns:
        edges.append(motion_photos(rows))
        left = rows.where("not coalesce(kind = 'image' and motion_kind is not null, false)")
    exact = exact_pairs(left)
    by_id = left.where("identifier is not null").groupBy("identifier").agg(F.count_if(F.col("kind") == "image").alias("i"), F.count_if(F.col("kind") == "video").alias("v"))
    paired = by_id.where("i > 0 and v > 0").select("identifier")
    left = left.join(paired, "identifier", "left_anti")
    sided = one_sided_pairs(left)
    free = _without(left, sided)
    named = materialise(fallback_pairs(free))
    rest = _without(free, named.where("status = 'active'")).where("identifier is not null")
    orphans = rest.select(
        F.concat(F.lit("orphan_motion_"), F.col("kind")).alias("relationship_type"), F.lit("orphan").alias("status"),
        F.col("asset_id").alias("primary_id"), F.lit(None).cast("long").alias("secondary_id"), F.lit(0.9).alias("confidence"), F.lit(0).cast("long").alias("candidates"),
    )
    return reduce(DataFrame.unionByName, [*edges, exact, sided, named, orphans])


def report_order(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """The edges with both paths, in the order of the report: type, primary path, secondary or -1."""
    path = lambda side: assets.select(F.col("asset_id").alias(f"{side}_id"), F.col("absolute_path").alias(f"{side}_path"))
    both = edges.join(path("primary"), "primary_id").join(path("secondary"), "secondary_id", "left")
    return both.orderBy("relationship_type", "primary_path", F.coalesce("secondary_id", F.lit(-1)), "status")


def stored_edges(old: DataFrame, new: DataFrame, inspected: DataFrame) -> DataFrame:
    """(keys, change) of stored edges against new ones: an edge is kept if type, both assets and status
    are the same; confidence does not count. Edges of assets that were not inspected are ``kept``."""
    keys = ["relationship_type", "status", "primary_id", "secondary_id"]
    seen = inspected.select(F.col("asset_id").alias("primary_id"), F.lit(True).alias("__seen"))
    rows = edge_changes(old, new, keys).join(seen, "primary_id", "left")
    return rows.select(*keys, F.when((F.col("change") == "stale") & F.col("__seen").isNull(), "kept").otherwise(F.col("change")).alias("change"))


def asset_states(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(asset_id, state): ``failed`` with an error and no edge, ``invalid`` if its last edge is, else ``completed``."""
    last = edges.groupBy(F.col("primary_id").alias("asset_id")).agg(
        F.max(F.struct("relationship_type", F.coalesce("secondary_id", F.lit(-1)).alias("s"), "status"))["status"].alias("last")
    )
    error = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
    state = F.when(error & F.col("last").isNull(), "failed").when(F.col("last") == "invalid", "invalid").otherwise("completed")
    return rows.join(last, "asset_id", "left").select("asset_id", state.alias("state"))


def edge_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): created, reused or stale edges; nulls in keys are equal to nulls."""
    o, n = old.select(*keys).distinct().withColumn("__o", F.lit(1)), new.select(*keys).distinct().withColumn("__n", F.lit(1))
    rows = o.unionByName(n, allowMissingColumns=True).groupBy(*keys).agg(F.max("__o").alias("o"), F.max("__n").alias("n"))
    return rows.select(*keys, F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "stale").otherwise("reused").alias("change"))


def conflicts(bundles: DataFrame) -> DataFrame:
    """(asset_id, bundles) of assets in more than one bundle."""
    return bundles.groupBy("asset_id").agg(F.countDistinct("bundle_id").alias("bundles")).where("bundles > 1")
