"""Best representative of each duplicate group (problem 2).

Records are ranked by trust, completeness and recency with a deterministic tie-break in window
ordering; the top record of each group is kept. Spark prunes ``row_number() = 1`` by a
WindowGroupLimit before the shuffle, so of a group that holds a third of all rows each task sends
at most one record on, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.identity import digest, human_readable, usable, uuid_name
from lumenfold.functions.timestamps import normalise_timestamps
from lumenfold.session import materialise


def top_record(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first record of each group in ``order``, which must end in a unique key."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def representatives(
    records: DataFrame,
    group: str,
    key: str,
    order: Sequence[Column],
    donors: dict[str, tuple[Column, Sequence[Column]]],
) -> DataFrame:
    """(group, key, one column per donor): survivors of groups of at least two records.

    ``donors``: output column -> (condition, order); the key of the best record meeting the
    condition, 0 if there is none. Keys must be unique. Records with a null group are in no group.
    The records are written to the shared folder once, as each ranking reads them.
    """
    rows = materialise(records.where(F.col(group).isNotNull()))
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    out = sizes.join(top_record(rows, [group], order).select(group, key), group)
    for name, (condition, best) in donors.items():
        donor = top_record(rows.where(condition), [group], best).select(group, F.col(key).alias(name))
        out = out.join(donor, group, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out


def planning_representatives(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Problem 2 on ``planning_assets``: (asset_id, captured_from, make_from).

    Defined results: of one asset_id the row with the latest recorded_at counts (ties by the row's
    values); a null priority is that of the source, null there too ranks last; null or blank
    digests and ids form no group; a null filename is not readable; null paths rank last.
    """
    known = sources.select("source_name", F.col("source_priority").alias("__priority"), "time_zone", "date_order")
    rows = normalise_timestamps(
        assets.where(F.col("asset_id").isNotNull()).join(known.dropDuplicates(["source_name"]), "source_name", "left"),
        "captured_at", "__us", fallback_zone=F.col("time_zone"), date_order=F.col("date_order"), readable="__time",
    ).select(
        "asset_id", "recorded_at", digest(F.col("sha256")).alias("content"),
        F.coalesce("source_priority", "__priority").alias("priority"),
        F.coalesce(human_readable(F.col("filename")), F.lit(False)).alias("human"),
        F.coalesce(uuid_name(F.col("filename")), F.lit(False)).alias("generated"),
        F.col("__time").alias("has_time"), usable(F.col("camera_make")).alias("has_make"), usable(F.col("camera_model")).alias("has_model"),
        F.length("relative_path").alias("path_length"), "absolute_path",
    )
    values = [c for c in rows.columns if c not in ("asset_id", "recorded_at")]
    rows = (
        rows.groupBy("asset_id")
        .agg(F.max(F.struct("recorded_at", *values)).alias("b"))
        .select("asset_id", "b.recorded_at", *[f"b.{v}" for v in values])
    )
    c = F.col
    complete = c("has_time").cast("int") + c("has_make").cast("int") + c("has_model").cast("int")
    order = [
        c("priority").desc_nulls_last(), c("human").desc(), c("generated").asc(), complete.desc(),
        c("path_length").asc_nulls_last(), c("absolute_path").asc_nulls_last(), c("asset_id").asc(),
    ]
    donor = [c("priority").desc_nulls_last(), c("recorded_at").desc_nulls_last(), c("asset_id").asc()]
    return representatives(
        rows, "content", "asset_id", order,
        {"captured_from": (c("has_time"), donor), "make_from": (c("has_make"), donor)},
    ).select("asset_id", "captured_from", "make_from")
