"""What changed between full snapshots (problem 1).

Identical rows of two neighbouring snapshots are removed by EXCEPT ALL in both directions; the
residues are full-joined by key, which labels additions, removals and changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.timestamps import STRIP, normalise_timestamps


def latest_rows(df: DataFrame, keys: Sequence[str], by: str, values: Sequence[str]) -> DataFrame:
    """Of several rows of one key the one with the greatest ``by``; ties by the values, greatest first.

    An aggregate with map-side combine, so a key with very many rows shrinks before the shuffle.
    A null ``by`` counts as earlier than any other.
    """
    best = F.max(F.struct(F.col(by).alias("__by"), *[F.col(v) for v in values])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{v}").alias(v) for v in values])


def snapshot_changes(
    rows: DataFrame, pairs: DataFrame, group: str, number: str, key: str, values: Sequence[str]
) -> DataFrame:
    """Changes of each counting snapshot against the group's previous counting one.

    ``rows``: one row per (group, number, key), with the compared ``values`` already in one form.
    ``pairs``: (group, number, previous, following), the counting snapshots of each group in order.

    Defined results: null equals null in values; a null key names no record and is left out;
    snapshots not in ``pairs`` are ignored; the first counting snapshot has no changes; repeated
    equal rows cancel one by one; an empty table gives no rows. Further columns are ignored.
    """
    columns = [group, "__at", key, *values]
    rows = rows.where(F.col(key).isNotNull()).join(pairs, [group, number])
    later = rows.where(F.col("previous").isNotNull()).withColumn("__at", F.col(number)).select(columns)
    earlier = rows.where(F.col("following").isNotNull()).withColumn("__at", F.col("following")).select(columns)
    fresh = later.exceptAll(earlier).groupBy(group, "__at", key).agg(F.lit(True).alias("__new"))
    gone = earlier.exceptAll(later).groupBy(group, "__at", key).agg(F.lit(True).alias("__old"))
    change = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").otherwise("changed")
    )
    return fresh.join(gone, [group, "__at", key], "full").select(
        F.col(group), F.col("__at").alias(number), F.col(key), change.alias("change")
    )


def counting_snapshots(runs: DataFrame, group: str, number: str, status: str, counted: Sequence[str]) -> DataFrame:
    """The finished snapshots of each group with the finished one before and after each.

    A snapshot counts if any of its runs has one of the ``counted`` statuses (case and blanks aside).
    """
    order = Window.partitionBy(group).orderBy(number)
    return (
        runs.where(F.lower(F.trim(F.col(status))).isin(*counted))
        .select(group, number)
        .where(F.col(group).isNotNull() & F.col(number).isNotNull())
        .distinct()
        .withColumn("previous", F.lag(number).over(order))
        .withColumn("following", F.lead(number).over(order))
    )


def one_form(text: Column) -> Column:
    """Blanks stripped, case folded, blank as null."""
    return F.nullif(F.lower(F.regexp_replace(text, STRIP, "")), F.lit(""))


def asset_snapshot_changes(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Problem 1 on ``asset_snapshots``: (snapshot_no, asset_id, change)."""
    values = ["size_bytes", "mtime_ns", "status", "missing"]
    rows = normalise_timestamps(
        snapshots.select(
            "source_name", "snapshot_no", "asset_id", "delivered_at", "size_bytes", "mtime_ns", "scan_status", "missing_since"
        ),
        "missing_since", "missing_us", fallback_zone=F.lit("UTC"),
    )
    # an instant by its microseconds; what names no instant, by its text
    rows = rows.withColumns({
        "status": one_form(F.col("scan_status")),
        "missing": F.coalesce(F.col("missing_us").cast("string"), one_form(F.col("missing_since"))),
    })
    rows = latest_rows(rows, ["snapshot_no", "asset_id"], "delivered_at", ["source_name", *values])
    pairs = counting_snapshots(runs, "source_name", "snapshot_no", "status", ["completed", "completed_with_errors"])
    return snapshot_changes(rows, pairs, "source_name", "snapshot_no", "asset_id", values).select(
        "snapshot_no", "asset_id", "change"
    )
