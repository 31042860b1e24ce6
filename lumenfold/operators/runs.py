"""Runs and their items: pending work, totals, latest states, audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items without a finished counterpart (an anti join)."""
    return items.join(done.select(*keys), list(keys), "left_anti")


def latest(df: DataFrame, keys: Sequence[str], by: str, values: Sequence[str]) -> DataFrame:
    """The values at the greatest ``by`` of each key."""
    return df.groupBy(*keys).agg(F.max(F.struct(by, *values)).alias("b")).select(*keys, F.col(f"b.{by}").alias(by), *[F.col(f"b.{v}").alias(v) for v in values])


def stale(runs: DataFrame, status: str, started: str, cutoff: Column) -> DataFrame:
    """Runs still ``running`` that began before the cutoff."""
    return runs.where((F.col(status) == "running") & (F.col(started) < cutoff))


def verified(recorded: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, outcome): size is compared first, then the digest."""
    seen = observed.select(key, F.col("size_bytes").alias("s"), F.col("sha256").alias("d"), F.lit(True).alias("seen"))
    outcome = (
        F.when(F.col("seen").isNull(), "missing").when(~F.col("size_bytes").eqNullSafe(F.col("s")), "size_mismatch")
        .when(~F.col("sha256").eqNullSafe(F.col("d")), "digest_mismatch").otherwise("verified")
    )
    return recorded.join(seen, key, "left").select(key, outcome.alias("outcome"))


def orphans(df: DataFrame, key: str, owners: DataFrame) -> DataFrame:
    """Rows whose non-null reference names no owner."""
    return df.where(F.col(key).isNotNull()).join(owners.select(key), key, "left_anti")


def completeness(items: DataFrame, bundle: str, item: str, ok: Column) -> DataFrame:
    """(bundle, item, done, required, completed, failed, status): each item with the counts of its bundle.

    A bundle is complete if all its items are. Items are rows, so a bundle may be of any size.
    """
    rows = items.select(bundle, item, ok.alias("done"))
    counts = rows.groupBy(bundle).agg(
        F.count("*").alias("required"), F.count_if("done").alias("completed"), F.count_if(~F.col("done")).alias("failed"),
        F.when(F.bool_and("done"), "complete").otherwise("incomplete").alias("status"),
    )
    return rows.join(counts, bundle)


def fingerprints(df: DataFrame, group: str, ident: str, value: Column, width: int = 1000) -> DataFrame:
    """(group, fingerprint): a digest of all (ident, value) of a group, whatever its size.

    A tree of digests: of each ``width`` consecutive ids, of each ``width`` of those, and of these. No
    row holds more than ``width`` items, and ids up to width ** 3 times the last level's rows fit.
    """
    rows = df.select(group, F.col(ident).alias("__i"), value.alias("__v"))
    for level in range(3):
        item = F.struct("__i", F.concat(F.col("__i").cast("string"), F.lit("="), "__v").alias("v"))
        keys = [group] if level == 2 else [group, F.expr(f"__i div {width}").alias("__b")]
        rows = rows.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item))["v"], ";"), 256).alias("__v"))
        if level < 2:
            rows = rows.withColumnRenamed("__b", "__i")
    return rows.withColumnRenamed("__v", "fingerprint")


def affected(plans: DataFrame, items: DataFrame, changed: DataFrame, plan: str, key: str) -> DataFrame:
    """Plans with an item among the changed keys become ``stale``."""
    hit = items.join(changed.select(key).distinct(), key, "left_semi").select(plan).distinct().withColumn("__hit", F.lit(True))
    return plans.join(hit, plan, "left").withColumn("plan_status", F.when(F.col("__hit"), "stale").otherwise("ready")).drop("__hit")


def completed_work(items: DataFrame, runs: DataFrame, run: str, plan: str, dry: str, status: str, size: str) -> DataFrame:
    """(plan, items, written): work done in any real run of a plan, so that a new run need not repeat it.

    Copied and already verified items count as done, copied ones with their bytes; dry runs do nothing.
    """
    done = items.join(runs.where(~F.col(dry)).select(run, plan), run).where(F.col(status).isin("copied", "verified_existing"))
    return done.groupBy(plan).agg(F.count("*").alias("items"), F.coalesce(F.sum(F.when(F.col(status) == "copied", F.col(size))), F.lit(0)).alias("written"))


def reversible(recorded: DataFrame, observed: DataFrame, key: str, owned: Column) -> DataFrame:
    """(key, outcome) of files a run owns: ``planned`` to be taken back if unchanged, else why not."""
    mine = recorded.where(owned).select(key, "sha256")
    seen = observed.select(key, F.col("sha256").alias("d"), F.lit(True).alias("seen"))
    outcome = F.when(F.col("seen").isNull(), "missing").when(F.col("sha256").eqNullSafe(F.col("d")), "planned").otherwise("content_changed")
    return mine.join(seen, key, "left").select(key, outcome.alias("outcome"))


def superseded(plans: DataFrame, group: str, ident: str, status: str) -> DataFrame:
    """(group, ident, status): the latest draft of each group is ``superseded``; all others stay."""
    last = plans.where(F.col(status) == "draft").groupBy(group).agg(F.max(ident).alias("__last"))
    rows = plans.join(last, group, "left")
    return rows.select(group, ident, F.when(F.col(ident) == F.col("__last"), "superseded").otherwise(F.col(status)).alias(status))


def mark_failed(runs: DataFrame, status: str, started: str, cutoff: Column) -> DataFrame:
    """The runs with ``stale`` ones as ``failed``."""
    gone = (F.col(status) == "running") & (F.col(started) < cutoff)
    return runs.withColumn(status, F.when(F.coalesce(gone, F.lit(False)), "failed").otherwise(F.col(status)))


def audit(references: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(reference, orphans): of each named reference (rows, key, owners, owner key) the rows without an owner."""
    counts = [
        rows.where(F.col(key).isNotNull()).join(owners.select(F.col(own).alias(key)).distinct(), key, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("reference"), "orphans")
        for name, (rows, key, owners, own) in references.items()
    ]
    return reduce(DataFrame.unionByName, counts)
