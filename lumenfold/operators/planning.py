"""Import planning: classify candidates, one copy of each content, collision-free destinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import case_fold, import_name, path_name, path_suffix
from lumenfold.operators.dedup import repeated_sizes


def classify(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates with ``action``, and for duplicates the library path and id they repeat.

    One aggregate a size tells whether the size is known and whether an unhashed library file has
    it; one a (size, digest) gives the first matching path. No pairs of equal size are formed.
    """
    done = F.col("hash_status") == "completed"
    sizes = library.where("size_bytes is not null").groupBy("size_bytes").agg(F.max((~F.coalesce(done, F.lit(False))).cast("int")).alias("unhashed"))
    content = (
        library.where(done & F.col("sha256").isNotNull() & F.col("size_bytes").isNotNull()).groupBy("size_bytes", "sha256")
        .agg(F.min(F.struct("absolute_path", "asset_id")).alias("match"))
    )
    shared = repeated_sizes(candidates).select("size_bytes", F.lit(True).alias("shares_size"))
    rows = candidates.join(sizes, "size_bytes", "left").join(shared, "size_bytes", "left").join(content, ["size_bytes", "sha256"], "left")
    hashed = F.coalesce(done & F.col("sha256").isNotNull(), F.lit(False))
    alone = F.col("unhashed").isNull() & F.col("shares_size").isNull()
    action = (
        F.when(alone, "new").when(~hashed, "review").when(F.col("match").isNotNull(), "duplicate_existing")
        .when(F.col("unhashed") == 1, "review").otherwise("new")
    )
    rows = rows.withColumn("action", action)
    same = F.col("action") == "duplicate_existing"
    return rows.select(
        *[F.col(c) for c in candidates.columns], "action", (hashed & ~alone).alias("has_digest"),
        F.when(same, F.col("match.asset_id")).alias("canonical_asset_id"), F.when(same, F.col("match.absolute_path")).alias("matching_path"),
    )


def _first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """(keys, __first): the asset_id first in order of each key, by an aggregate with map-side combine."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, "asset_id"))["asset_id"].alias("__first"))


def single_copies(rows: DataFrame) -> DataFrame:
    """Among new files of one size and digest the one of highest priority stays new.

    The keepers are joined back, so a content that a third of all files share is no one task's work.
    """
    fresh = (F.col("action") == "new") & F.col("has_digest") & F.col("size_bytes").isNotNull()
    # least first: a null priority counts as the lowest
    rank = (-F.coalesce(F.col("source_priority").cast("long"), F.lit(-(1 << 40)))).alias("__r")
    keep = _first(rows.where(fresh), ["size_bytes", "sha256"], [rank, "source_name", "relative_path"])
    joined = rows.join(keep, ["size_bytes", "sha256"], "left")
    later = fresh & (F.col("__first") != F.col("asset_id"))
    action = F.when(F.coalesce(later, F.lit(False)), "duplicate_candidate").otherwise(F.col("action"))
    return joined.withColumn("action", action).select(rows.columns)


def _import_forms(keys: DataFrame) -> DataFrame:
    """(form, taken): taken names of the form ``stem__import_<id>.ext``, and how many ``_1`` each has."""
    shape = r"(?s)^(.*__import_[0-9]{8,})((?:_1)*)((?:\.[^./]+)?)$"
    named = keys.where(F.col("claim_key").rlike(shape))
    form = F.concat(F.regexp_extract("claim_key", shape, 1), F.lit("/"), F.regexp_extract("claim_key", shape, 3))
    return named.groupBy(form.alias("form")).agg(F.collect_set((F.length(F.regexp_extract("claim_key", shape, 2)) / 2).cast("int")).alias("taken"))


def place(rows: DataFrame, occupied: DataFrame, bases: DataFrame | None = None, base: str = "Imported", flat: bool = False) -> DataFrame:
    """Destinations of new files, each of them given once; third pass of the import plan.

    A new file wants its base folder (``bases``: source_name, base; else ``base``) and its relative
    path, if ``flat`` its name alone. Claims go by case-folded path. If the name is occupied by a file
    of the same size and digest the action becomes ``reuse_destination``; if it is occupied otherwise,
    or claimed by a file before it in (source_name, relative_path, asset_id) order, the file gets the
    import suffix, with ``_1`` as often as that name is taken too. ``occupied``: (claim_key) of existing
    files, and if they are to be reused asset_id, absolute_path, size_bytes and sha256.

    No loop: a suffix holds the file's own id, so the names it may meet differ only in the number of
    ``_1``, and an aggregate over the taken names of that form tells the first free one.
    """
    folder = F.lit(base)
    if bases is not None:
        rows, folder = rows.join(bases.select("source_name", F.col("base").alias("__base")), "source_name", "left"), F.coalesce("__base", F.lit(base))
    want = path_name(F.col("relative_path")) if flat else F.col("relative_path")
    rows = rows.withColumn("destination", F.when(F.col("action") == "new", F.concat(folder, F.lit("/"), want))).withColumn("claim_key", case_fold(F.col("destination")))
    fields = [f for f in ("asset_id", "absolute_path", "size_bytes", "sha256") if f in occupied.columns]
    there = F.min(F.struct(*fields)) if fields else F.lit(True)
    taken = occupied.where("claim_key is not null").groupBy("claim_key").agg(there.alias("__there"))
    out = rows.join(taken, "claim_key", "left")
    same = F.lit(False)
    if {"size_bytes", "sha256"} <= set(fields):
        same = F.col("has_digest") & (F.col("__there.size_bytes") == F.col("size_bytes")) & (F.col("__there.sha256") == F.col("sha256"))
    out = out.withColumn("__same", F.coalesce(same, F.lit(False)))
    first = _first(out.where("claim_key is not null and __there is null"), ["claim_key"], ["source_name", "relative_path"])
    out = out.join(first, "claim_key", "left")
    clash = F.col("claim_key").isNotNull() & ~F.col("__same") & (F.col("__there").isNotNull() | (F.col("__first") != F.col("asset_id")))
    out = out.withColumn("__clash", F.coalesce(clash, F.lit(False)))
    name = path_name(F.col("destination"))
    above = F.substring("destination", F.lit(1), F.length("destination") - F.length(name))
    plain = F.concat(above, import_name(name, F.col("asset_id")))
    suffix = path_suffix(plain)
    form = F.when(F.col("__clash"), F.concat(case_fold(F.substring(plain, F.lit(1), F.length(plain) - F.length(suffix))), F.lit("/"), case_fold(suffix)))
    granted = first.select("claim_key").unionByName(taken.select("claim_key"))
    out = out.withColumn("form", form).join(_import_forms(granted), "form", "left")
    free = F.coalesce(F.element_at(F.array_except(F.sequence(F.lit(0), F.size("taken")), "taken"), 1), F.lit(0))
    named = F.concat(above, import_name(name, F.col("asset_id"), free))
    out = out.withColumn("collided", F.col("__clash") | F.col("__same")).withColumn("destination", F.when(F.col("__clash"), named).otherwise(F.col("destination")))
    out = out.withColumn("action", F.when(F.col("__same"), "reuse_destination").otherwise(F.col("action")))
    for column, field in (("canonical_asset_id", "asset_id"), ("matching_path", "absolute_path")):
        if field in fields and column in out.columns:
            out = out.withColumn(column, F.when(F.col("__same"), F.col(f"__there.{field}")).otherwise(F.col(column)))
    return out.drop("__first", "__there", "__same", "__clash", "__base", "claim_key", "form", "taken")


def follow(rows: DataFrame) -> DataFrame:
    """Copies of a candidate that is imported take after it.

    If it stays new they match its destination, if it reuses a file they match that; without it, or if
    it needs review, they need review too. Keepers are joined by content: one row a size and digest.
    """
    kept = rows.where(F.col("has_digest") & F.col("action").isin("new", "reuse_destination")).select(
        "size_bytes", "sha256", F.col("action").alias("__a"), F.col("canonical_asset_id").alias("__i"),
        F.when(F.col("action") == "new", F.col("destination")).otherwise(F.col("matching_path")).alias("__p"),
    ).dropDuplicates(["size_bytes", "sha256"])
    out = rows.join(kept, ["size_bytes", "sha256"], "left")
    copy = F.col("action") == "duplicate_candidate"
    return out.select(
        *[F.col(c) for c in rows.columns if c not in ("action", "canonical_asset_id", "matching_path")],
        F.when(copy & F.col("__a").isNull(), "review").otherwise(F.col("action")).alias("action"),
        F.when(copy, F.col("__i")).otherwise(F.col("canonical_asset_id")).alias("canonical_asset_id"),
        F.when(copy, F.col("__p")).otherwise(F.col("matching_path")).alias("matching_path"),
    )


def report_buckets(rows: DataFrame) -> DataFrame:
    """(asset_id, bucket): the reports an item stands in; renamed items stand in a second one."""
    action = F.col("action")
    bucket = F.when(action == "new", "new_files").when(action == "review", "review_items").otherwise("existing_duplicates")
    renamed = F.when(F.coalesce(F.col("destination").contains("__import_") | (action == "reuse_destination"), F.lit(False)), "name_collisions")
    return rows.select("asset_id", F.explode(F.array_compact(F.array(bucket, renamed))).alias("bucket"))


def collision_numbers(df: DataFrame, key: str, ident: str = "asset_id", width: int = 1000) -> DataFrame:
    """Every row with ``nth``, its place among those of one key by its unique integer id.

    Rows are ranked inside ranges of ``width`` ids, and the ranges of a key by their counts, so no task
    sorts more than ``width`` rows or the ranges of one key.
    """
    rows = df.withColumn("__r", F.expr(f"`{ident}` div {width}"))
    before = Window.partitionBy(key).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, "__r").agg(F.count("*").alias("__c"))
    counts = counts.select(F.col(key).alias("__k"), F.col("__r").alias("__q"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(key, "__r").orderBy(ident))
    ranked = rows.withColumn("__n", inner).join(counts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__r") == F.col("__q")))
    return ranked.withColumn("nth", F.col("__n") + F.col("__before")).select(*df.columns, "nth")
