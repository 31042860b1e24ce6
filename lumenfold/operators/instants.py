"""Mixed timestamp formats and time zones (problem 5) on the catalogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.timestamps import normalise_timestamps


def current_assets(assets: DataFrame, columns: list[str]) -> DataFrame:
    """Of each asset_id the row with the latest last_seen_at; rows without an id are left out.

    The columns become those of that row; equal times are decided by the columns' values.
    """
    best = F.max(F.struct("last_seen_at", *columns)).alias("__b")
    return (
        assets.where(F.col("asset_id").isNotNull())
        .groupBy("asset_id")
        .agg(best)
        .select("asset_id", *[F.col(f"__b.{c}").alias(c) for c in columns])
    )


def asset_instants(assets: DataFrame, sources: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per asset_id with ``utc_micros`` of its captured_at (null if unreadable), and ``keep``.

    ``sources`` is the table of capture sources; its size decides whether Catalyst broadcasts it.
    """
    keep = keep or []
    zones = sources.select("source_name", "time_zone", "date_order").dropDuplicates(["source_name"])
    columns = list(dict.fromkeys(["asset_id", "last_seen_at", "captured_at", "source_name", *keep]))
    rows = normalise_timestamps(
        assets.select(*columns).join(zones, "source_name", "left"),
        "captured_at", "utc_micros", fallback_zone=F.col("time_zone"), date_order=F.col("date_order"),
    )
    return current_assets(rows, ["captured_at", "source_name", "utc_micros", *[k for k in keep if k not in ("captured_at", "source_name")]]).select(
        "asset_id", "utc_micros", *keep
    )


def evidence_instants(evidence: DataFrame, assets: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per evidence_id with ``utc_micros`` of its candidate_timestamp (null if unreadable).

    Repeated rows of one evidence_id count once; of rows that differ the greatest readable instant.
    """
    owner = current_assets(assets, ["source_name"])
    zones = sources.select("source_name", "time_zone", "date_order").dropDuplicates(["source_name"])
    rows = (
        evidence.where(F.col("evidence_id").isNotNull())
        .select("evidence_id", "asset_id", "candidate_timestamp", "timezone")
        .join(owner.join(zones, "source_name", "left"), "asset_id", "left")
    )
    return (
        normalise_timestamps(
            rows, "candidate_timestamp", "utc_micros",
            zone=F.col("timezone"), fallback_zone=F.col("time_zone"), date_order=F.col("date_order"),
        )
        .groupBy("evidence_id")
        .agg(F.max("utc_micros").alias("utc_micros"))
    )


def all_instants(assets: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Problem 5: (record_kind, record_id, utc_micros), one row per readable value."""
    a = asset_instants(assets, sources).select(
        F.lit("asset").alias("record_kind"), F.col("asset_id").alias("record_id"), "utc_micros"
    )
    e = evidence_instants(evidence, assets, sources).select(
        F.lit("evidence").alias("record_kind"), F.col("evidence_id").alias("record_id"), "utc_micros"
    )
    return a.unionByName(e).where(F.col("utc_micros").isNotNull())
