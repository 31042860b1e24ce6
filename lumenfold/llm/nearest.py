"""Matching records by nearest time (problem 3).

Both tables are repartitioned by entity, sorted within partitions and merged by two pointers in a
streaming iterator that holds only the neighbouring right records. So that no entity fills a task,
entities are cut into time cells a little wider than the tolerance; right records near a cell's
edge stand in the next cell too, so each left record meets all its partners in its own cell.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.identity import content_identifier, media_type
from lumenfold.operators.instants import asset_instants

_COLUMNS = ["entity", "cell", "at", "side", "id"]


def merge_nearest(batches: Iterable[pa.RecordBatch], tolerance: int) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge of rows sorted by (entity, cell, at, side, id), side 0 right and 1 left.

    Each left record lies between a right record before it and one after it. At the end of an Arrow
    batch only the last right record is held, and the left ones that the next right record may still
    reach: none older than the tolerance.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        batch = batch.select(_COLUMNS)
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        held, out = _merged(rows, tolerance, False)
        yield out
    if held is not None:
        yield _merged(held, tolerance, True)[1]


def _merged(rows: pa.RecordBatch, tolerance: int, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """(held, found) of one sorted stretch."""
    at, side, ident, cell = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("at", "side", "id", "cell"))
    entity, n = rows.column("entity"), len(at)
    new = np.ones(n, bool)
    new[1:] = pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False) | (np.diff(cell) != 0)
    group = np.cumsum(new)
    right = np.flatnonzero(side == 0)
    # of right records of one instant the first, which has the smallest id
    run = np.ones(len(right), bool)
    run[1:] = (np.diff(at[right]) != 0) | (np.diff(group[right]) != 0)
    right = right[run]
    left = np.flatnonzero(side == 1)
    after = np.searchsorted(right, left)
    before = after - 1
    none = np.array([n])  # stands for no record
    after, before = np.append(right, none)[after], np.append(right, none)[np.where(before < 0, len(right), before)]
    where, when = np.append(group, 0), np.append(at, 0)
    has_after, has_before = where[after] == group[left], where[before] == group[left]
    far = np.iinfo(np.int64).max
    ahead = np.where(has_after, when[after] - at[left], far)
    behind = np.where(has_before, at[left] - when[before], far)
    waits = ~has_after & (group[left] == group[-1]) & (at[left] + tolerance >= at[-1]) & (not last)
    near = ~waits & (np.minimum(ahead, behind) <= tolerance)
    best = np.where(behind <= ahead, before, after)[near]
    found = pa.RecordBatch.from_arrays([pa.array(ident[left[near]]), pa.array(ident[best])], names=["left_id", "right_id"])
    prior = right[-1:][group[right[-1:]] == group[-1]]
    return rows.take(pa.array(np.append(prior, left[waits]))), found


def nearest_of(rows: DataFrame, tolerance_us: int) -> DataFrame:
    """``nearest_in_time`` of one table (entity, at, id, side), side 0 for right records and 1 for left."""
    width = max(1, 4 * tolerance_us)
    cell = lambda shift: F.expr(f"(at + ({shift}) - pmod(at + ({shift}), {width})) div {width}")
    cells = F.when(F.col("side") == 1, F.array(cell(0))).otherwise(F.array_distinct(F.array(cell(-tolerance_us), cell(tolerance_us))))
    return (
        rows.select("entity", "at", "id", F.col("side").cast("int").alias("side")).dropna()
        .withColumn("cell", F.explode(cells)).select(*_COLUMNS)
        .repartition("entity", "cell").sortWithinPartitions(*_COLUMNS)
        .mapInArrow(lambda it: merge_nearest(it, tolerance_us), "left_id long, right_id long")
    )


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int) -> DataFrame:
    """(left_id, right_id): for each left (entity, at, id) the nearest right record of its entity.

    ``at`` in microseconds, ids longs. At most ``tolerance_us`` away, inclusive; ties go to the
    earlier right record, then to the smaller id. Rows with a null in entity, at or id match
    nothing; repeated left rows give repeated matches; an empty side gives no rows.
    """
    side = lambda df, k: df.select("entity", "at", "id", F.lit(k).alias("side"))
    return nearest_of(side(right, 0).unionByName(side(left, 1)), tolerance_us)


def live_pairs(assets: DataFrame, sources: DataFrame, tolerance_us: int = 3_000_000) -> DataFrame:
    """Problem 3: (asset_id_a, asset_id_b) of each video and its nearest image of one identifier."""
    rows = asset_instants(assets, sources, ["apple_content_identifier", "media_type", "extension"])
    # the table is read and its times are parsed once; the side is a column
    rows = rows.select(
        content_identifier(F.col("apple_content_identifier")).alias("entity"), F.col("utc_micros").alias("at"), F.col("asset_id").alias("id"),
        F.when(media_type(F.col("media_type"), F.col("extension")) == "video", 1).otherwise(0).alias("side"),
    )
    pairs = nearest_of(rows, tolerance_us)
    return pairs.select(
        F.least("left_id", "right_id").alias("asset_id_a"), F.greatest("left_id", "right_id").alias("asset_id_b")
    )
