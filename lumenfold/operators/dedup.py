"""Exact duplicates: size pre-filter, digest groups, keepers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.identity import human_readable, uuid_name


def repeated_sizes(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    """(size, copies) of sizes that occur more than once; null sizes are no group."""
    return df.where(F.col(size).isNotNull()).groupBy(size).agg(F.count("*").alias("copies")).where("copies > 1")


def size_candidates(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    """Rows whose size occurs more than once: only these need a digest (a semi join)."""
    return df.join(repeated_sizes(df, size).select(size), size, "left_semi")


def duplicate_groups(df: DataFrame, digest: str = "sha256", size: str = "size_bytes") -> DataFrame:
    """(digest, copies, size_bytes, total_bytes) of digests with more than one row."""
    return (
        df.where(F.col(digest).isNotNull()).groupBy(digest)
        .agg(F.count("*").alias("copies"), F.max(size).alias("size_bytes"), F.sum(size).alias("total_bytes"))
        .where("copies > 1")
    )


def duplicate_files(files: DataFrame, hashed: DataFrame, digest: str = "sha256") -> DataFrame:
    """Files whose digest has a duplicate group among ``hashed``, with the group's figures.

    A join to the aggregate, not a window, so that a group of a third of all rows is no one task's
    work: Catalyst may broadcast the groups or split the skewed partition.
    """
    groups = duplicate_groups(hashed, digest).withColumnsRenamed({"size_bytes": "group_size", "total_bytes": "group_bytes"})
    return files.join(groups, digest)


def members_of_repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur more than once, with ``copies``: a row a member, no list a group."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
    return df.join(groups, keys)


def shared_size_flags(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    """All rows with ``shares_size``: another row has the same size."""
    return df.join(repeated_sizes(df, size).select(size, F.lit(True).alias("shares_size")), size, "left").withColumn(
        "shares_size", F.coalesce("shares_size", F.lit(False))
    )


#: The preferences of a keeper that may be switched off; the source's override always counts.
PREFERENCES = ("relationship_complete", "source_priority", "human_readable", "uuid_name", "metadata_fields", "path_length")


def keeper_order(prefer: Sequence[str] = PREFERENCES) -> list:
    """Nine keys, the smaller the better; the last is unique."""
    c = F.col
    fields = sum(c(x).isNotNull().cast("int") for x in ("captured_at", "camera_make", "camera_model"))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    on = lambda name, key: [key] if name in prefer else []
    return [
        *on("relationship_complete", c("relationship_complete").cast("int").desc()), *on("source_priority", c("source_priority").desc_nulls_last()),
        c("source_override").desc_nulls_last(), *on("human_readable", flag(human_readable(c("filename"))).desc()),
        *on("uuid_name", flag(uuid_name(c("filename"))).asc()), *on("metadata_fields", fields.desc()),
        *on("path_length", F.length("relative_path").asc_nulls_last()), c("absolute_path").asc_nulls_last(), c("asset_id").asc(),
    ]


def keepers(df: DataFrame, digest: str = "sha256", prefer: Sequence[str] = PREFERENCES) -> DataFrame:
    """Of each digest the best row by ``keeper_order``; pruned before the shuffle (WindowGroupLimit)."""
    rows = df.where(F.col(digest).isNotNull())
    window = Window.partitionBy(digest).orderBy(*keeper_order(prefer))
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
