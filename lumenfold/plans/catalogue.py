"""Queries of the catalogue operators over whole tables, each with its oracle SQL.

``cur`` is the current state of ``assets`` (of one asset_id the latest last_seen_at), ``plan_cur``
that of ``planning_assets`` (latest recorded_at).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions.identity import content_identifier, media_type, stem
from lumenfold.operators import dates, dedup, inventory, planning, relations, runs
from lumenfold.operators.snapshots import latest_rows
from lumenfold.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CUR = "cur AS (SELECT DISTINCT * FROM assets QUALIFY rank() OVER (PARTITION BY asset_id ORDER BY last_seen_at DESC) = 1)"
PLAN = "plan_cur AS (SELECT DISTINCT * FROM planning_assets QUALIFY rank() OVER (PARTITION BY asset_id ORDER BY recorded_at DESC) = 1)"
LIB = "lib AS (SELECT DISTINCT * FROM library_index QUALIFY rank() OVER (PARTITION BY asset_id ORDER BY indexed_at DESC) = 1)"
BATCH = (
    "first_batch AS (SELECT DISTINCT asset_id, batch_no, source_name, absolute_path, size_bytes, sha256, hash_status, chunk_sums"
    " FROM import_batches QUALIFY rank() OVER (PARTITION BY asset_id ORDER BY batch_no, delivered_at) = 1)"
)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _latest(df: DataFrame, by: str) -> DataFrame:
    others = [c for c in df.columns if c not in ("asset_id", by)]
    return latest_rows(df, ["asset_id"], by, [by, *others])


def cur(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(table(spark, folder, "assets"), "last_seen_at")


def plan_cur(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(table(spark, folder, "planning_assets"), "recorded_at")


def lib(spark: SparkSession, folder: str) -> DataFrame:
    return _latest(table(spark, folder, "library_index"), "indexed_at")


def first_batch(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "import_batches")
    cols = ["batch_no", "source_name", "absolute_path", "size_bytes", "sha256", "hash_status", "chunk_sums"]
    best = F.min(F.struct("batch_no", "delivered_at", *cols[1:])).alias("b")
    return df.groupBy("asset_id").agg(best).select("asset_id", *[F.col(f"b.{c}").alias(c) for c in cols])


# -- scans, filters, predicates -------------------------------------------------------------


@query(f"""WITH {CUR} SELECT asset_id, absolute_path FROM cur
WHERE NOT list_has_any(string_split(regexp_replace(absolute_path, '/[^/]*$', ''), '/'), ['misc', 'Unsorted'])
  AND NOT starts_with(filename, 'clip') AND NOT ends_with(filename, '.PNG')
  AND lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) IN ('.jpg', '.jpeg', '.heic', '.mov', '.png')""")
def s2_scan_filter(spark, folder):
    return inventory.scan_filter(
        cur(spark, folder), "absolute_path", ["misc", "Unsorted"], ["clip"], [".PNG"], [".jpg", ".jpeg", ".heic", ".mov", ".png"]
    ).select("asset_id", "absolute_path")


@query(f"""WITH {CUR} SELECT asset_id, source_name, size_bytes FROM cur
WHERE scan_status = 'available' AND asset_role = 'candidate' AND coalesce(hash_status, 'pending') != 'failed'""")
def pred_p1_available_candidates(spark, folder):
    return cur(spark, folder).where(
        "scan_status = 'available' and asset_role = 'candidate' and coalesce(hash_status, 'pending') != 'failed'"
    ).select("asset_id", "source_name", "size_bytes")


def _analysed(spark, folder):
    snaps = table(spark, folder, "asset_snapshots").withColumns({"s": F.col("size_bytes"), "m": F.col("mtime_ns")})
    # nulls sort first in both engines' struct comparison only if made explicit
    best = F.max(F.struct("delivered_at", F.coalesce("s", F.lit(-1)).alias("s"), F.coalesce("m", F.lit(-1)).alias("m"))).alias("b")
    null = lambda c: F.nullif(F.col(c), F.lit(-1).cast("long"))
    return snaps.groupBy("asset_id").agg(best).select("asset_id", null("b.s").alias("obs_size"), null("b.m").alias("obs_mtime"))


_SEEN = """seen AS (SELECT asset_id, nullif(b.s, -1) AS obs_size, nullif(b.m, -1) AS obs_mtime FROM (
  SELECT asset_id, max(struct_pack(d := delivered_at, s := coalesce(size_bytes, -1), m := coalesce(mtime_ns, -1))) AS b
  FROM asset_snapshots GROUP BY asset_id))"""


@query(f"""WITH {CUR}, {_SEEN} SELECT c.asset_id, c.analysis_status FROM cur c LEFT JOIN seen s USING (asset_id)
WHERE c.analysis_status IN ('pending', 'running', 'failed') OR (c.analysis_status = 'completed'
  AND (s.obs_size IS NULL OR s.obs_mtime IS NULL OR s.obs_size != c.size_bytes OR s.obs_mtime != c.mtime_ns))""")
def pred_p3_analysis_candidates(spark, folder):
    return cur(spark, folder).join(_analysed(spark, folder), "asset_id", "left").where(
        "analysis_status in ('pending', 'running', 'failed') or (analysis_status = 'completed' and (obs_size is null or obs_mtime is null"
        " or obs_size != size_bytes or obs_mtime != mtime_ns))"
    ).select("asset_id", "analysis_status")


@query(f"""WITH {CUR}, {_SEEN} SELECT count(*) AS reusable FROM cur c JOIN seen s USING (asset_id)
WHERE c.analysis_status = 'completed' AND s.obs_size = c.size_bytes AND s.obs_mtime = c.mtime_ns""")
def pred_p4_reusable(spark, folder):
    return cur(spark, folder).join(_analysed(spark, folder), "asset_id").where(
        "analysis_status = 'completed' and obs_size = size_bytes and obs_mtime = mtime_ns"
    ).agg(F.count("*").alias("reusable"))


@query(f"""WITH {CUR} SELECT s.source_name, count(*) AS under_root FROM cur c JOIN capture_sources s USING (source_name)
WHERE starts_with(c.absolute_path, s.root_path || '/') GROUP BY s.source_name""")
def pred_p5_path_prefix(spark, folder):
    roots = table(spark, folder, "capture_sources").select("source_name", "root_path")
    return cur(spark, folder).join(roots, "source_name").where(F.expr("startswith(absolute_path, concat(root_path, '/'))")).groupBy(
        "source_name"
    ).agg(F.count("*").alias("under_root"))


@query(f"""WITH {CUR} SELECT asset_id, NOT starts_with(relative_path, '/') AND NOT list_has_any(string_split(relative_path, '/'), ['', '.', '..']) AS safe FROM cur""")
def pred_p6_safe_paths(spark, folder):
    return cur(spark, folder).select("asset_id", T.safe_relative(F.col("relative_path")).alias("safe"))


_REVIEW = """CASE WHEN starts_with(c.relative_path, '/') OR list_has_any(string_split(c.relative_path, '/'), ['', '.', '..']) THEN 'unsafe_path'
  WHEN s.asset_id IS NULL THEN 'missing' WHEN s.obs_size != c.size_bytes THEN 'size_changed' WHEN s.obs_mtime != c.mtime_ns THEN 'mtime_changed' END"""


@query(f"""WITH {CUR}, {_SEEN} SELECT * FROM (SELECT c.asset_id, {_REVIEW} AS reason FROM cur c LEFT JOIN seen s USING (asset_id)) WHERE reason IS NOT NULL""")
def pred_p8_stat_review(spark, folder):
    return inventory.review(cur(spark, folder), _analysed(spark, folder))


@query(f"""WITH {CUR} SELECT * FROM (SELECT asset_id, concat_ws(';', CASE WHEN captured_at IS NULL THEN 'captured_at' END,
  CASE WHEN lower(media_type) = 'image' AND (camera_make IS NULL OR camera_model IS NULL) THEN 'camera' END,
  CASE WHEN lower(media_type) = 'video' AND apple_content_identifier IS NULL THEN 'identifier' END) AS missing FROM cur) WHERE missing != ''""")
def pred_p9_missing_metadata(spark, folder):
    return inventory.missing_fields(cur(spark, folder), {
        "captured_at": "captured_at is null",
        "camera": "lower(media_type) = 'image' and (camera_make is null or camera_model is null)",
        "identifier": "lower(media_type) = 'video' and apple_content_identifier is null",
    })


# -- duplicates ----------------------------------------------------------------------------


@query(f"""WITH {BATCH}, g AS (SELECT size_bytes FROM first_batch WHERE size_bytes IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT asset_id, size_bytes FROM first_batch WHERE size_bytes IN (FROM g)""")
def j1_size_candidates(spark, folder):
    return dedup.size_candidates(first_batch(spark, folder)).select("asset_id", "size_bytes")


_GROUPS = "g AS (SELECT sha256, count(*) AS copies, max(size_bytes) AS size_bytes, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM plan_cur WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


@query(f"WITH {PLAN}, {_GROUPS} SELECT * FROM g")
def a1_duplicate_groups(spark, folder):
    return dedup.duplicate_groups(plan_cur(spark, folder))


@query(f"WITH {PLAN}, {_GROUPS} SELECT count(*) AS files FROM plan_cur WHERE sha256 IN (SELECT sha256 FROM g)")
def j2_duplicate_file_count(spark, folder):
    rows = plan_cur(spark, folder)
    return rows.join(dedup.duplicate_groups(rows).select("sha256"), "sha256", "left_semi").agg(F.count("*").alias("files"))


@query(f"WITH {PLAN}, {_GROUPS} SELECT p.asset_id, p.absolute_path, g.copies, g.total_bytes AS group_bytes FROM plan_cur p JOIN g USING (sha256)")
def j3_duplicate_files(spark, folder):
    rows = plan_cur(spark, folder)
    return dedup.duplicate_files(rows, rows).select("asset_id", "absolute_path", "copies", "group_bytes")


@query(f"WITH {LIB} SELECT size_bytes, count(*) AS copies FROM lib WHERE size_bytes IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a2_size_groups(spark, folder):
    return dedup.repeated_sizes(lib(spark, folder))


@query(f"""WITH {LIB} SELECT sha256, size_bytes, asset_id, absolute_path, count(*) OVER (PARTITION BY sha256, size_bytes) AS copies
FROM lib WHERE sha256 IS NOT NULL QUALIFY copies > 1""")
def a3_canonical_duplicates(spark, folder):
    rows = lib(spark, folder).where("sha256 is not null")
    return dedup.members_of_repeated(rows, ["sha256", "size_bytes"]).select("sha256", "size_bytes", "asset_id", "absolute_path", "copies")


@query(f"WITH {PLAN}, {_GROUPS} SELECT coalesce(max(copies), 0) AS largest FROM g")
def a17_largest_group(spark, folder):
    return dedup.duplicate_groups(plan_cur(spark, folder)).agg(F.coalesce(F.max("copies"), F.lit(0)).alias("largest"))


@query(f"""WITH {BATCH} SELECT asset_id, size_bytes IS NOT NULL AND count(*) OVER (PARTITION BY size_bytes) > 1 AS shares_size FROM first_batch""")
def a18_shared_sizes(spark, folder):
    return dedup.shared_size_flags(first_batch(spark, folder)).select("asset_id", "shares_size")


_UUID = "regexp_matches(stem, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$')"


@query(f"""WITH {PLAN}, s AS (SELECT *, regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1') AS stem, coalesce(len(relationship_ids), 0) > 0 AS complete FROM plan_cur WHERE sha256 IS NOT NULL),
k AS (SELECT *, {_UUID} AS u FROM s)
SELECT sha256, asset_id FROM k QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY complete DESC, source_priority DESC NULLS LAST,
  (regexp_matches(stem, '\\p{{L}}') AND NOT u) DESC, u, (captured_at IS NOT NULL)::INT + (camera_make IS NOT NULL)::INT + (camera_model IS NOT NULL)::INT DESC,
  length(relative_path), absolute_path, asset_id) = 1""")
def w1_keepers(spark, folder):
    rows = plan_cur(spark, folder).withColumns({
        "relationship_complete": F.coalesce(F.size("relationship_ids"), F.lit(0)) > 0, "source_override": F.col("source_priority"),
    })
    return dedup.keepers(rows).select("sha256", "asset_id")


# -- statistics ----------------------------------------------------------------------------

_STATS = {
    "total": "true", "available": "scan_status = 'available'", "missing": "scan_status = 'missing'", "errors": "scan_status = 'error'",
    "images": "lower(media_type) = 'image'", "videos": "lower(media_type) = 'video'", "hashed": "hash_status = 'completed'",
    "hash_pending": "hash_status = 'pending'", "hash_failed": "hash_status = 'failed'", "analysed": "analysis_status = 'completed'",
    "dated": "captured_at is not null",
}


@query(f"WITH {CUR} SELECT {', '.join(f'CAST(count_if({c}) AS BIGINT) AS {n}' for n, c in _STATS.items())}, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, (SELECT max_by(error_count, run_id) FROM scan_runs) AS run_errors FROM cur")
def a4_inventory_stats(spark, folder):
    # the errors are those that the latest scan has counted
    last = table(spark, folder, "scan_runs").agg(F.max(F.struct("run_id", "error_count"))["error_count"].alias("run_errors")).withColumn("k", F.lit(1))
    totals = cur(spark, folder).agg(*inventory.counted(**_STATS), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).withColumn("k", F.lit(1))
    return totals.join(last, "k").drop("k")


@query(f"""WITH {CUR} SELECT asset_role, CAST(count_if(hash_status = 'completed') AS BIGINT) AS hashed, count(*) AS files,
  CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM cur GROUP BY 1""")
def a5_role_stats(spark, folder):
    return cur(spark, folder).groupBy("asset_role").agg(
        *inventory.counted(hashed="hash_status = 'completed'"), F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )


@query(f"WITH {CUR} SELECT source_name, lower(extension) AS extension, count(*) AS files FROM cur GROUP BY 1, 2")
def a8_counts(spark, folder):
    return cur(spark, folder).groupBy("source_name", F.lower("extension").alias("extension")).agg(F.count("*").alias("files"))


@query(f"WITH {CUR} SELECT coalesce(camera_make, '') AS make, coalesce(camera_model, '') AS model, n AS files FROM (SELECT camera_make, camera_model, count(*) AS n FROM cur GROUP BY 1, 2)")
def a9_camera_stats(spark, folder):
    return cur(spark, folder).groupBy("camera_make", "camera_model").agg(F.count("*").alias("files")).select(
        F.coalesce("camera_make", F.lit("")).alias("make"), F.coalesce("camera_model", F.lit("")).alias("model"), "files"
    )


_COVERAGE = {"analysed": "analysis_status = 'completed'", "dated": "captured_at is not null", "camera": "camera_make is not null and camera_model is not null",
             "identified": "apple_content_identifier is not null", "failed": "analysis_status = 'failed'", "unsupported": "analysis_status = 'unsupported'"}


@query(f"WITH {CUR} SELECT {', '.join(f'CAST(count_if({c}) AS BIGINT) AS {n}' for n, c in _COVERAGE.items())} FROM cur")
def a10_coverage(spark, folder):
    return cur(spark, folder).agg(*inventory.counted(**_COVERAGE))


@query(f"""WITH {LIB} SELECT count(*) AS files, count(DISTINCT source_name) AS sources, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes,
  CAST(count_if(hash_status = 'completed') AS BIGINT) AS hashed, CAST(coalesce(sum(size_bytes) FILTER (hash_status = 'completed'), 0) AS BIGINT) AS hashed_bytes,
  CAST(count_if(hash_status != 'completed') AS BIGINT) AS remaining FROM lib""")
def a13_library_summary(spark, folder):
    done = F.col("hash_status") == "completed"
    return lib(spark, folder).agg(
        F.count("*").alias("files"), F.countDistinct("source_name").alias("sources"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.count_if(done).alias("hashed"), F.coalesce(F.sum(F.when(done, F.col("size_bytes"))), F.lit(0)).alias("hashed_bytes"), F.count_if(~done).alias("remaining"),
    )


@query(f"""WITH {PLAN}, {_GROUPS} SELECT (SELECT count(DISTINCT sha256) FROM plan_cur) AS contents, count(*) AS groups,
  CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS redundant, CAST(coalesce(sum((copies - 1) * size_bytes), 0) AS BIGINT) AS redundant_bytes FROM g""")
def a14_plan_summary(spark, folder):
    per = plan_cur(spark, folder).where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"), F.max("size_bytes").alias("s"))
    return per.agg(
        F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"),
        F.coalesce(F.sum((F.col("n") - 1) * F.col("s")), F.lit(0)).alias("redundant_bytes"),
    )


# -- relations -----------------------------------------------------------------------------

#: The number that ends a file's name.
NUMBER = "([0-9]+)\\.[^.]*$"

_SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
_ID = f"nullif(lower(regexp_replace(regexp_replace(apple_content_identifier, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '^[\\x00{{}}]+|[\\x00{{}}]+$', '', 'g')), '')"
_KIND = "CASE WHEN lower(trim(media_type)) IN ('image', 'video') THEN lower(trim(media_type)) WHEN lower(extension) IN ('.mov', '.mp4', '.m4v', '.avi', '.mkv', '.mts') THEN 'video' ELSE 'image' END"
_STEM = "regexp_replace(lower(regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1')), '^img_e([0-9]+)$', 'img_\\1')"
_SHAPE = "^([0-9]{4})[:-]([0-9]{2})[:-]([0-9]{2})[ T]([0-9]{2}:[0-9]{2}:[0-9]{2})((?:\\.[0-9]{1,6})?)((?:Z|[+-][0-9]{2}:[0-9]{2})?)$"
_WALL = f"CASE WHEN regexp_matches(captured_at, '{_SHAPE}') THEN epoch_us(try_cast(regexp_replace(captured_at, '{_SHAPE}', '\\1-\\2-\\3 \\4\\5') AS TIMESTAMP)) END"
_ZONE = f"CASE WHEN regexp_matches(captured_at, '{_SHAPE}') THEN regexp_extract(captured_at, '{_SHAPE}', 6) END"
_OFF = f"CASE WHEN {_ZONE} = 'Z' THEN 0 WHEN {_ZONE} != '' THEN (CASE WHEN {_ZONE}[1] = '-' THEN -1 ELSE 1 END) * (CAST({_ZONE}[2:3] AS INT) * 3600 + CAST({_ZONE}[5:6] AS INT) * 60) END"
_INSPECT = f"""{CUR}, ins AS (SELECT asset_id, source_name, regexp_extract(absolute_path, '^(.*)/[^/]*$', 1) AS folder, {_STEM} AS stem_key,
  {_KIND} AS kind, {_ID} AS identifier, {_WALL} AS wall, {_OFF} AS off FROM cur
  WHERE scan_status = 'available' AND size_bytes IS NOT NULL AND mtime_ns IS NOT NULL)"""


_NUMBERED = f"""{_INSPECT.replace('), ins AS', '), ins0 AS')}, ins AS (SELECT ins0.* REPLACE (ins0.source_name AS folder, CAST(CAST(regexp_extract(cur.filename, '([0-9]+)\\.[^.]*$', 1) AS BIGINT) // 50 AS VARCHAR) AS stem_key)
  FROM ins0 JOIN cur USING (asset_id))"""


def _inspect(spark, folder):
    return relations.inspections(cur(spark, folder))


def numbered(spark, folder):
    """The assets as if each source were one folder and each file had for a name its number without the
    last digits: in the tables no two files of a folder have one stem, and the stages by names find nothing."""
    rows = cur(spark, folder)
    number = F.expr(f"cast(regexp_extract(filename, r'{NUMBER}', 1) as bigint) div 50").cast("string")
    return relations.inspections(rows.withColumns({
        "filename": F.concat(number, F.lower("extension")), "absolute_path": F.concat("source_name", F.lit("/"), number, F.lit("-"), "asset_id", F.lower("extension")),
    }))


@query(f"WITH {_INSPECT} SELECT asset_id, folder, stem_key, kind, identifier, wall, off FROM ins")
def f_inspections(spark, folder):
    return _inspect(spark, folder).select("asset_id", "folder", "stem_key", "kind", "identifier", "wall", "off")


@query(f"""WITH {_INSPECT}, v AS (SELECT identifier, count(*) AS n, min(asset_id) AS v FROM ins WHERE kind = 'video' AND identifier IS NOT NULL GROUP BY 1)
SELECT 'apple_live_photo' AS relationship_type, CASE WHEN n = 1 THEN 'active' ELSE 'ambiguous' END AS status, asset_id AS primary_id,
  CASE WHEN n = 1 THEN v END AS secondary_id, CAST(1.0 AS DOUBLE) AS confidence, n AS candidates FROM ins JOIN v USING (identifier) WHERE kind = 'image'""")
def j13_identifier_pairs(spark, folder):
    return relations.exact_pairs(_inspect(spark, folder))


_CLASS = """CASE WHEN {l}.wall IS NULL OR {r}.wall IS NULL THEN 'unavailable'
  WHEN {l}.off IS NULL AND {r}.off IS NULL AND abs({l}.wall - {r}.wall) <= 3000000 THEN 'exact_within_3_seconds'
  WHEN {l}.off IS NOT NULL AND {r}.off IS NOT NULL AND abs(({l}.wall - {l}.off * 1000000::BIGINT) - ({r}.wall - {r}.off * 1000000::BIGINT)) <= 3000000 THEN 'exact_within_3_seconds'
  WHEN abs({l}.wall - {r}.wall) <= 3000000 THEN 'same_wall_clock_within_3_seconds'
  WHEN ({l}.off IS NULL) != ({r}.off IS NULL) AND abs({l}.wall - {r}.wall) <= 50400000000 AND round_even(abs({l}.wall - {r}.wall) / 900000000.0, 0) > 0
    AND abs(abs({l}.wall - {r}.wall) - round_even(abs({l}.wall - {r}.wall) / 900000000.0, 0) * 900000000) <= 3000000 THEN 'timezone_offset_compatible'
  ELSE 'incompatible' END"""


@query(f"""WITH {_NUMBERED}, i AS (SELECT source_name, folder, stem_key, count(*) AS n, min(asset_id) AS asset_id FROM ins WHERE kind = 'image' AND identifier IS NULL GROUP BY 1, 2, 3),
p AS (SELECT v.asset_id AS video, i.asset_id AS image, i.n, {_CLASS.format(l='im', r='v')} AS class FROM ins v JOIN i ON v.source_name = i.source_name AND v.folder = i.folder AND v.stem_key = i.stem_key
  JOIN ins im ON im.asset_id = i.asset_id WHERE v.kind = 'video' AND v.identifier IS NOT NULL)
SELECT 'apple_live_photo' AS relationship_type, CASE WHEN n = 1 AND class != 'incompatible' THEN 'active' ELSE 'ambiguous' END AS status,
  CASE WHEN n = 1 AND class != 'incompatible' THEN image ELSE video END AS primary_id, CASE WHEN n = 1 AND class != 'incompatible' THEN video END AS secondary_id,
  CAST(CASE WHEN n = 1 AND class IN ('incompatible', 'unavailable') THEN 0.85 ELSE 0.9 END AS DOUBLE) AS confidence, n AS candidates FROM p""")
def j14_one_sided_pairs(spark, folder):
    return relations.one_sided_pairs(numbered(spark, folder))


@query(f"""WITH {_NUMBERED}, k AS (SELECT source_name, stem_key, count_if(kind = 'image') AS i, count_if(kind = 'video') AS v, min(asset_id) FILTER (kind = 'image') AS a, min(asset_id) FILTER (kind = 'video') AS b
  FROM ins WHERE identifier IS NULL GROUP BY 1, 2)
SELECT 'active' AS status, a AS primary_id, b AS secondary_id FROM k JOIN ins l ON l.asset_id = a JOIN ins r ON r.asset_id = b
WHERE i = 1 AND v = 1 AND {_CLASS.format(l='l', r='r')} IN ('exact_within_3_seconds', 'same_wall_clock_within_3_seconds', 'unavailable')""")
def j15_unambiguous_pairs(spark, folder):
    # keys with one image and one video: the part of the fallback that SQL can say
    return relations.only_pairs(numbered(spark, folder)).select("status", "primary_id", "secondary_id")


@query()
def j15_fallback_pairs(spark, folder):
    return relations.fallback_pairs(numbered(spark, folder))


@query()
def relations_detected(spark, folder):
    return relations.detect(numbered(spark, folder))


@query(f"""WITH {_INSPECT}, x AS (SELECT identifier, min(asset_id) FILTER (kind = 'image') AS i, min(asset_id) FILTER (kind = 'video') AS v FROM ins WHERE identifier IS NOT NULL GROUP BY 1)
SELECT l.asset_id, r.asset_id AS other_id, {_CLASS.format(l='l', r='r')} AS class FROM ins l JOIN x USING (identifier) JOIN ins r ON r.asset_id = CASE WHEN l.kind = 'image' THEN x.v ELSE x.i END""")
def f13_timestamp_class(spark, folder):
    # every asset with an identifier against the first of the other kind
    rows = _inspect(spark, folder).where("identifier is not null")
    first = lambda k, n: F.min(F.when(F.col("kind") == k, F.struct("asset_id", "wall", "off"))).alias(n)
    firsts = rows.groupBy("identifier").agg(first("image", "i"), first("video", "v"))
    pairs = rows.join(firsts, "identifier").withColumn("o", F.when(F.col("kind") == "image", F.col("v")).otherwise(F.col("i"))).where("o is not null")
    return pairs.select("asset_id", F.col("o.asset_id").alias("other_id"), T.timestamp_class((F.col("wall"), F.col("off")), (F.col("o.wall"), F.col("o.off"))).alias("class"))


_EDGES = "SELECT DISTINCT asset_id, r AS bundle_id FROM (SELECT asset_id, unnest(relationship_ids) AS r FROM {t})"


_FIRST = "plan_first AS (SELECT DISTINCT * FROM planning_assets QUALIFY rank() OVER (PARTITION BY asset_id ORDER BY recorded_at) = 1)"


def plan_first(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "planning_assets")
    others = [c for c in df.columns if c not in ("asset_id", "recorded_at")]
    return df.groupBy("asset_id").agg(F.min(F.struct("recorded_at", *others)).alias("b")).select("asset_id", *[F.col(f"b.{c}").alias(c) for c in others])


def _edges(df: DataFrame) -> DataFrame:
    return df.select("asset_id", F.explode("relationship_ids").alias("bundle_id")).distinct()


@query(f"WITH {PLAN}, e AS ({_EDGES.format(t='plan_cur')}) SELECT asset_id, count(DISTINCT bundle_id) AS bundles FROM e GROUP BY 1 HAVING count(DISTINCT bundle_id) > 1")
def j16_bundle_conflicts(spark, folder):
    return relations.conflicts(_edges(plan_cur(spark, folder)))


@query(f"""WITH {PLAN}, e AS ({_EDGES.format(t='plan_cur')}) SELECT e.bundle_id, e.asset_id, p.absolute_path, s.root_path FROM e JOIN plan_cur p USING (asset_id)
LEFT JOIN capture_sources s ON p.source_name = s.source_name""")
def j7_relationship_report(spark, folder):
    rows = plan_cur(spark, folder)
    roots = table(spark, folder, "capture_sources").select("source_name", "root_path")
    return _edges(rows).join(rows.select("asset_id", "absolute_path", "source_name"), "asset_id").join(roots, "source_name", "left").select(
        "bundle_id", "asset_id", "absolute_path", "root_path"
    )


@query(f"""WITH {PLAN}, {_FIRST}, o AS ({_EDGES.format(t='plan_first')}), n AS ({_EDGES.format(t='plan_cur')})
SELECT coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(o.bundle_id, n.bundle_id) AS bundle_id,
  CASE WHEN o.asset_id IS NULL THEN 'created' WHEN n.asset_id IS NULL THEN 'stale' ELSE 'reused' END AS change
FROM o FULL JOIN n ON o.asset_id = n.asset_id AND o.bundle_id = n.bundle_id""")
def j8_edge_changes(spark, folder):
    # the edges as first recorded against the latest
    return relations.edge_changes(_edges(plan_first(spark, folder)), _edges(plan_cur(spark, folder)), ["asset_id", "bundle_id"])


# -- planning ------------------------------------------------------------------------------

_CLASSIFY = f"""{LIB}, {BATCH}, cand AS (SELECT b.*, s.source_priority, substr(b.absolute_path, length(s.root_path) + 2) AS relative_path FROM first_batch b JOIN capture_sources s USING (source_name)),
sz AS (SELECT size_bytes, bool_or(coalesce(hash_status, '') != 'completed') AS unhashed FROM lib WHERE size_bytes IS NOT NULL GROUP BY 1),
ct AS (SELECT size_bytes, sha256, min(struct_pack(p := absolute_path, i := asset_id)) AS m FROM lib WHERE hash_status = 'completed' AND sha256 IS NOT NULL AND size_bytes IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT size_bytes FROM cand WHERE size_bytes IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
cl AS (SELECT c.*, CASE WHEN sz.size_bytes IS NULL AND sh.size_bytes IS NULL THEN 'new' WHEN NOT coalesce(c.hash_status = 'completed' AND c.sha256 IS NOT NULL, false) THEN 'review'
    WHEN ct.m IS NOT NULL THEN 'duplicate_existing' WHEN sz.unhashed THEN 'review' ELSE 'new' END AS action,
  coalesce(c.hash_status = 'completed' AND c.sha256 IS NOT NULL, false) AND NOT (sz.size_bytes IS NULL AND sh.size_bytes IS NULL) AS has_digest, ct.m AS m
  FROM cand c LEFT JOIN sz ON c.size_bytes = sz.size_bytes LEFT JOIN sh ON c.size_bytes = sh.size_bytes LEFT JOIN ct ON c.size_bytes = ct.size_bytes AND c.sha256 = ct.sha256)"""
_SINGLE = """one AS (SELECT * REPLACE (CASE WHEN action = 'new' AND has_digest AND row_number() OVER (PARTITION BY action = 'new' AND has_digest, size_bytes, sha256
  ORDER BY source_priority DESC NULLS LAST, source_name, relative_path, asset_id) > 1 THEN 'duplicate_candidate' ELSE action END AS action) FROM cl)"""


def _candidates(spark, folder):
    src = table(spark, folder, "capture_sources").select("source_name", "source_priority", "root_path")
    rows = first_batch(spark, folder).drop("chunk_sums").join(src, "source_name")
    return rows.withColumn("relative_path", F.expr("substr(absolute_path, length(root_path) + 2)")).drop("root_path")


@query(f"""WITH {_CLASSIFY} SELECT asset_id, action, CASE WHEN action = 'duplicate_existing' THEN m.i END AS canonical_asset_id,
  CASE WHEN action = 'duplicate_existing' THEN m.p END AS matching_path FROM cl""")
def j4_import_classify(spark, folder):
    return planning.classify(_candidates(spark, folder), lib(spark, folder)).select("asset_id", "action", "canonical_asset_id", "matching_path")


@query(f"WITH {_CLASSIFY}, {_SINGLE} SELECT asset_id, action FROM one WHERE has_digest AND action IN ('new', 'duplicate_candidate')")
def w2_import_keepers(spark, folder):
    rows = planning.single_copies(planning.classify(_candidates(spark, folder), lib(spark, folder)))
    return rows.where("has_digest and action in ('new', 'duplicate_candidate')").select("asset_id", "action")


_PLACE = """occ AS (SELECT DISTINCT lower('Imported/' || substr(l.absolute_path, length(s.root_path) + 2)) AS k FROM lib l JOIN capture_sources s USING (source_name)),
pl AS (SELECT o.*, 'Imported/' || relative_path AS want, row_number() OVER (PARTITION BY lower('Imported/' || relative_path), action = 'new' ORDER BY source_name, relative_path, asset_id) AS n FROM one o),
dest AS (SELECT pl.*, action = 'new' AND (n > 1 OR occ.k IS NOT NULL) AS collided,
  CASE WHEN action != 'new' THEN NULL WHEN n > 1 OR occ.k IS NOT NULL THEN regexp_replace(want, '(\\.[^./]+)$', '') || '__import_' || lpad(CAST(asset_id AS VARCHAR), 8, '0') || regexp_extract(want, '[^/](\\.[^./]+)$', 1)
    ELSE want END AS destination FROM pl LEFT JOIN occ ON lower(want) = occ.k)"""


@query(f"""WITH {_CLASSIFY}, {_SINGLE}, {_PLACE} SELECT asset_id, action, destination, collided, size_bytes AS expected_size_bytes, sha256 AS expected_sha256 FROM dest""")
def import_plan(spark, folder):
    known = lib(spark, folder)
    rows = planning.single_copies(planning.classify(_candidates(spark, folder), known))
    roots = table(spark, folder, "capture_sources").select("source_name", "root_path")
    taken = known.join(roots, "source_name").select(F.lower(F.concat(F.lit("Imported/"), F.expr("substr(absolute_path, length(root_path) + 2)"))).alias("claim_key"))
    return planning.place(rows, taken).select(
        "asset_id", "action", "destination", "collided", F.col("size_bytes").alias("expected_size_bytes"), F.col("sha256").alias("expected_sha256")
    )


@query(f"""WITH {_CLASSIFY}, {_SINGLE} SELECT action, count(*) AS items, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM one GROUP BY 1""")
def a7_action_counts(spark, folder):
    rows = planning.single_copies(planning.classify(_candidates(spark, folder), lib(spark, folder)))
    return rows.groupBy("action").agg(F.count("*").alias("items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query(f"""WITH {_CLASSIFY}, {_SINGLE} SELECT CAST(count_if(action = 'new') AS BIGINT) AS planned, CAST(count_if(action IN ('duplicate_existing', 'duplicate_candidate')) AS BIGINT) AS skipped,
  CAST(count_if(action = 'review') AS BIGINT) AS review, CAST(coalesce(sum(size_bytes) FILTER (action LIKE 'duplicate%'), 0) AS BIGINT) AS bytes_avoided FROM one""")
def a11_import_totals(spark, folder):
    rows = planning.single_copies(planning.classify(_candidates(spark, folder), lib(spark, folder)))
    dup = F.col("action").startswith("duplicate")
    return rows.agg(
        F.count_if(F.col("action") == "new").alias("planned"), F.count_if(dup).alias("skipped"), F.count_if(F.col("action") == "review").alias("review"),
        F.coalesce(F.sum(F.when(dup, F.col("size_bytes"))), F.lit(0)).alias("bytes_avoided"),
    )


@query(f"WITH {CUR} SELECT asset_id, row_number() OVER (PARTITION BY lower(filename) ORDER BY asset_id) AS nth FROM cur")
def w9_collision_numbers(spark, folder):
    return planning.collision_numbers(cur(spark, folder).withColumn("k", F.lower("filename")), "k").select("asset_id", F.col("nth").cast("long").alias("nth"))


@query(f"""WITH {CUR}, w AS (SELECT *, {_WALL} AS us FROM cur), t AS (SELECT *, make_timestamp(us) AS ts FROM w)
SELECT asset_id, coalesce(strftime(ts, '%Y'), 'undated') || '/' || coalesce(strftime(ts, '%m'), '00') || '/' || source_name || '_' || coalesce(strftime(ts, '%Y%m%d_%H%M%S'), 'undated') || '_' || filename AS destination FROM t""")
def f16_destination_paths(spark, folder):
    wall, _ = T.wall_and_offset(F.col("captured_at"))
    rows = cur(spark, folder).withColumn("at", F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=(wall / 1000000).cast("decimal(18,6)")))
    fields = {**T.date_fields(F.col("at")), "source": F.col("source_name"), "original_name": F.col("filename")}
    return rows.select("asset_id", T.destination_path("{year}/{month}/{source}_{timestamp}_{original_name}", fields).alias("destination"))


# -- dates ---------------------------------------------------------------------------------

_DATED = "(?:^|[_ -])([0-9]{4})[-_]?(0[1-9]|1[0-2])[-_]?(0[1-9]|[12][0-9]|3[01])(?:$|[_ -])"


@query(f"""WITH {PLAN}, d AS (SELECT asset_id, size_bytes, sha256, absolute_path, captured_at FROM plan_cur WHERE size_bytes IS NOT NULL AND sha256 IS NOT NULL),
k AS (SELECT size_bytes, sha256, max(struct_pack(p := absolute_path, c := captured_at)) AS m FROM d WHERE captured_at IS NOT NULL GROUP BY 1, 2)
SELECT d.asset_id, m.p AS from_path, m.c AS captured_at FROM d JOIN k USING (size_bytes, sha256) WHERE d.captured_at IS NULL""")
def j11_duplicate_dates(spark, folder):
    return dates.counterparts(plan_cur(spark, folder), [F.col("size_bytes"), F.col("sha256")], "captured_at")


@query(f"""WITH {CUR}, d AS (SELECT asset_id, source_name || '/' || regexp_extract(filename, '([0-9]+)\\.[^.]*$', 1)::BIGINT // 50 AS k, absolute_path, captured_at,
  CASE WHEN lower(extension) = '.dng' THEN 'raw' WHEN lower(extension) IN ('.jpg', '.jpeg') THEN 'jpeg' END AS f FROM cur),
k AS (SELECT k, f, max(struct_pack(p := absolute_path, c := captured_at)) AS m FROM d WHERE captured_at IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2)
SELECT d.asset_id, m.p AS from_path, m.c AS captured_at FROM d JOIN k ON d.k = k.k AND k.f != d.f WHERE d.captured_at IS NULL""")
def j11_raw_pair_dates(spark, folder):
    # as if each source were one folder and each file had its number for a name
    rows = cur(spark, folder).withColumn("k", F.concat("source_name", F.lit("/"), F.expr(f"cast(regexp_extract(filename, r'{NUMBER}', 1) as bigint) div 50")))
    return dates.raw_counterparts(rows, [F.col("k")], "captured_at")


@query(f"""WITH {CUR}, r AS (SELECT asset_id, source_name AS folder, absolute_path AS path, regexp_extract(filename, '([0-9]+)\\.[^.]*$', 1)::BIGINT AS n, {_WALL} AS us FROM cur),
w AS (SELECT *, max(CASE WHEN us IS NOT NULL THEN struct_pack(n := n, p := path, a := us) END) OVER (PARTITION BY folder ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
  min(CASE WHEN us IS NOT NULL THEN struct_pack(n := n, p := path, a := us) END) OVER (PARTITION BY folder ORDER BY n RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM r)
SELECT asset_id, lo.a + (hi.a - lo.a) * (n - lo.n) // (hi.n - lo.n) AS utc_micros, lo.p AS before_path, hi.p AS after_path FROM w
WHERE us IS NULL AND hi.n - lo.n <= 5 AND hi.a - lo.a BETWEEN 0 AND 86400000000""")
def j12_neighbours(spark, folder):
    # as if each source were one folder and each file had its number for a name; the operator's own limits
    wall, _ = T.wall_and_offset(F.col("captured_at"))
    rows = cur(spark, folder).select(
        "asset_id", F.col("source_name").alias("folder"), F.lit("").alias("prefix"), F.regexp_extract("filename", NUMBER, 1).cast("bigint").alias("n"),
        F.col("absolute_path").alias("path"), wall.alias("at"),
    )
    return dates.between_numbers(rows)


@query(f"""WITH {PLAN}, t AS (SELECT asset_id, regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1') AS s FROM plan_cur),
m AS (SELECT asset_id, regexp_extract(s, '{_DATED}', ['y', 'm', 'd']) AS g FROM t WHERE regexp_matches(s, '{_DATED}'))
SELECT asset_id, 'filename_date' AS kind, g.y || '-' || g.m || '-' || g.d || 'T00:00:00' AS at, 90 AS confidence FROM m
WHERE try_cast(g.y || '-' || g.m || '-' || g.d AS DATE) IS NOT NULL AND g.y BETWEEN '1970' AND '2100'""")
def f21_filename_dates(spark, folder):
    rows = plan_cur(spark, folder).select("asset_id", dates.filename_evidence(F.col("filename")).alias("e")).where("e is not null")
    return rows.select("asset_id", "e.kind", "e.at", "e.confidence")


@query(f"""WITH {CUR}, p AS (SELECT asset_id, list_reverse(string_split(regexp_extract(absolute_path, '^(.*)/[^/]*$', 1), '/')) AS f FROM cur),
u AS (SELECT asset_id, unnest(f) AS name, generate_subscripts(f, 1) AS i FROM p),
e AS (SELECT asset_id, i, CASE WHEN regexp_matches(name, '^[0-9]{{4}}[-_][0-9]{{2}}[-_][0-9]{{2}}$') AND try_cast(replace(name, '_', '-') AS DATE) IS NOT NULL AND name[1:4] BETWEEN '1970' AND '2100'
    THEN struct_pack(kind := 'folder_date', at := replace(name, '_', '-') || 'T00:00:00', confidence := 88)
  WHEN regexp_matches(name, '^[0-9]{{4}}[-_](0[1-9]|1[0-2])$') THEN struct_pack(kind := 'folder_month', at := name[1:4] || '-' || name[6:7] || '-15T12:00:00', confidence := 70)
  WHEN regexp_matches(name, '^[0-9]{{4}}($|\\s+[^0-9])') AND name[1:4] BETWEEN '1970' AND '2100' THEN struct_pack(kind := 'folder_year', at := name[1:4] || '-07-01T12:00:00', confidence := 60) END AS e FROM u)
SELECT asset_id, e.kind AS kind, e.at AS at, e.confidence AS confidence FROM e WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY i) = 1""")
def f22_folder_dates(spark, folder):
    rows = cur(spark, folder).select("asset_id", dates.folder_evidence(F.col("absolute_path")).alias("e"))
    return rows.where("e is not null").select("asset_id", "e.kind", "e.at", "e.confidence")


_EVID = """ev AS (SELECT DISTINCT asset_id, evidence_type AS kind, coalesce(source, '') AS source, confidence, CAST(epoch_us(try_strptime(candidate_timestamp, '%Y-%m-%dT%H:%M:%S')) AS BIGINT) AS us
  FROM date_evidence WHERE try_strptime(candidate_timestamp, '%Y-%m-%dT%H:%M:%S') IS NOT NULL AND regexp_matches(candidate_timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$'))"""


@query(f"""WITH {_EVID}, p AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, kind, source, us) = 1)
SELECT p.asset_id, p.kind, p.us AS utc_micros, CAST(least(99, p.confidence + least(2 * (count_if(abs(e.us - p.us) <= 120000000) - 1), 4)) AS INT) AS confidence,
  coalesce(bool_or(abs(e.us - p.us) > 120000000 AND e.confidence >= 88), false) AS conflict
FROM p JOIN ev e USING (asset_id) GROUP BY p.asset_id, p.kind, p.us, p.confidence""")
def w5_resolve_evidence(spark, folder):
    shape = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"
    us = F.unix_micros(F.try_to_timestamp(F.concat("candidate_timestamp", F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))
    rows = table(spark, folder, "date_evidence").select(
        "asset_id", F.col("evidence_type").alias("kind"), F.coalesce("source", F.lit("")).alias("source"), "confidence",
        F.when(F.col("candidate_timestamp").rlike(shape), us).alias("utc_micros"),
    ).distinct()
    return dates.resolve(rows)


# -- runs and audits -----------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey WHERE o_orderstatus != 'F'
AND NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber AND d.l_linestatus = 'F')""")
def j5_pending_items(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    open_ = table(spark, folder, "orders").where("o_orderstatus != 'F'").select("o_orderkey")
    planned = items.join(open_, items.l_orderkey == open_.o_orderkey, "left_semi").select("l_orderkey", "l_linenumber")
    return runs.pending(planned, items.where("l_linestatus = 'F'"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey AS run_id, o_orderstatus AS status, count(*) AS items, CAST(count_if(l_linestatus = 'F') AS BIGINT) AS done
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def a12_run_totals(spark, folder):
    per = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return o.join(per, o.run_id == per.l_orderkey).select("run_id", "status", "items", "done")


@query("""SELECT l_orderkey, l_linenumber, l_linestatus = 'F' AS done, count(*) OVER w AS required, count_if(l_linestatus = 'F') OVER w AS completed, count_if(l_linestatus != 'F') OVER w AS failed,
  CASE WHEN bool_and(l_linestatus = 'F') OVER w THEN 'complete' ELSE 'incomplete' END AS status FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def a15_bundle_completeness(spark, folder):
    return runs.completeness(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_linestatus") == "F")


@query("SELECT source_name, max(run_id) AS run_id, max_by(status, run_id) AS status FROM scan_runs GROUP BY 1")
def w3_latest_runs(spark, folder):
    return runs.latest(table(spark, folder, "scan_runs"), ["source_name"], "run_id", ["status"])


@query("""SELECT source_name, max_by(status, run_id) FILTER (status LIKE 'completed%') AS finished, max_by(status, run_id) FILTER (status NOT LIKE 'completed%') AS unfinished FROM scan_runs GROUP BY 1""")
def w4_latest_by_state(spark, folder):
    ok = F.col("status").startswith("completed")
    return table(spark, folder, "scan_runs").groupBy("source_name").agg(
        F.max_by(F.when(ok, F.col("status")), F.when(ok, F.col("run_id"))).alias("finished"),
        F.max_by(F.when(~ok, F.col("status")), F.when(~ok, F.col("run_id"))).alias("unfinished"),
    )


@query(f"WITH {CUR} SELECT asset_id, absolute_path FROM cur ORDER BY absolute_path, asset_id LIMIT 200 OFFSET 100")
def w8_page(spark, folder):
    return inventory.page(cur(spark, folder), [F.col("absolute_path"), F.col("asset_id")], 100, 500).select("asset_id", "absolute_path")


@query("SELECT status, count(*) AS n FROM scan_runs WHERE status IN ('running', 'failed') GROUP BY 1")
def a19_open_runs(spark, folder):
    return table(spark, folder, "scan_runs").where(F.col("status").isin("running", "failed")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT run_id, source_name FROM scan_runs WHERE status = 'running' AND started_at < TIMESTAMP '2024-05-01'")
def l7_stale_runs(spark, folder):
    return runs.stale(table(spark, folder, "scan_runs"), "status", "started_at", F.expr("timestamp_ntz'2024-05-01'")).select("run_id", "source_name")


_UPSERT = """u AS (SELECT coalesce(n.asset_id, o.asset_id) AS asset_id, CASE WHEN n.asset_id IS NOT NULL THEN n.obs_size ELSE o.size_bytes END AS size_bytes,
  CASE WHEN n.asset_id IS NOT NULL THEN n.obs_mtime ELSE o.mtime_ns END AS mtime_ns,
  o.asset_id IS NOT NULL AND n.asset_id IS NOT NULL AND (coalesce(o.size_bytes != n.obs_size, false) OR coalesce(o.mtime_ns != n.obs_mtime, false)) AS reset, o.asset_id IS NULL AS fresh,
  n.asset_id IS NOT NULL AS seen, o.hash_status AS h, o.sha256 AS d FROM cur o FULL JOIN seen n ON o.asset_id = n.asset_id)"""


@query(f"""WITH {CUR}, {_SEEN}, {_UPSERT} SELECT asset_id, size_bytes, mtime_ns, CASE WHEN fresh OR reset THEN 'pending' ELSE h END AS hash_status,
  CASE WHEN NOT fresh AND NOT reset THEN d END AS sha256, CASE WHEN seen THEN 'available' ELSE 'missing' END AS scan_status FROM u""")
def l1_upsert(spark, folder):
    scanned = _analysed(spark, folder).withColumnsRenamed({"obs_size": "size_bytes", "obs_mtime": "mtime_ns"})
    return inventory.upsert(cur(spark, folder), scanned)


@query("""WITH clean AS (SELECT DISTINCT source_name, snapshot_no FROM scan_runs WHERE status = 'completed'),
seen AS (SELECT DISTINCT source_name, asset_id, snapshot_no FROM asset_snapshots),
w AS (SELECT *, lead(snapshot_no) OVER (PARTITION BY source_name, asset_id ORDER BY snapshot_no) AS again,
  (SELECT min(c.snapshot_no) FROM clean c WHERE c.source_name = seen.source_name AND c.snapshot_no > seen.snapshot_no) AS told FROM seen)
SELECT CAST(told AS BIGINT) AS snapshot_no, asset_id FROM w WHERE told IS NOT NULL AND (again IS NULL OR again > told)""")
def j18_missing(spark, folder):
    clean = table(spark, folder, "scan_runs").where("status = 'completed'").select("source_name", "snapshot_no")
    return inventory.missing_at(table(spark, folder, "asset_snapshots"), clean, "source_name", "snapshot_no", "asset_id").select(F.col("snapshot_no").cast("long").alias("snapshot_no"), "asset_id")


@query("""SELECT c.asset_id, CASE WHEN p.asset_id IS NULL THEN 'missing' WHEN c.size_bytes IS DISTINCT FROM p.size_bytes THEN 'size_mismatch'
  WHEN c.sha256 IS DISTINCT FROM p.sha256 THEN 'digest_mismatch' ELSE 'verified' END AS outcome
FROM (SELECT DISTINCT * FROM planning_assets QUALIFY rank() OVER (PARTITION BY asset_id ORDER BY recorded_at) = 1) c
LEFT JOIN (SELECT DISTINCT * FROM planning_assets QUALIFY rank() OVER (PARTITION BY asset_id ORDER BY recorded_at DESC) = 1) p USING (asset_id)""")
def l8_verify(spark, folder):
    # the first recorded state of each asset against the latest
    df = table(spark, folder, "planning_assets")
    first = df.groupBy("asset_id").agg(F.min(F.struct("recorded_at", "size_bytes", "sha256")).alias("b")).select("asset_id", "b.size_bytes", "b.sha256")
    return runs.verified(first, plan_cur(spark, folder), "asset_id")


@query("SELECT evidence_id FROM date_evidence WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM assets WHERE scan_status = 'available') GROUP BY 1")
def j10_orphan_references(spark, folder):
    owners = table(spark, folder, "assets").where("scan_status = 'available'")
    return runs.orphans(table(spark, folder, "date_evidence"), "asset_id", owners).select("evidence_id").distinct()


@query(f"""WITH {CUR} SELECT p.source_name, CASE WHEN EXISTS (SELECT 1 FROM cur b JOIN date_evidence e USING (asset_id) WHERE b.source_name = p.source_name AND e.evidence_type = 'google_json' AND e.confidence >= 99)
  THEN 'stale' ELSE 'ready' END AS plan_status FROM capture_sources p""")
def j17_stale_plans(spark, folder):
    # a source's plan is stale if a sidecar has given one of its assets a new date
    items = cur(spark, folder).select("source_name", "asset_id")
    changed = table(spark, folder, "date_evidence").where("evidence_type = 'google_json' and confidence >= 99")
    return runs.affected(table(spark, folder, "capture_sources").select("source_name"), items, changed, "source_name", "asset_id")


@query("SELECT asset_id, max(batch_no) AS batch_no, max_by(hash_status, batch_no) AS hash_status FROM import_batches GROUP BY 1")
def k5_last_write(spark, folder):
    return inventory.last_write(table(spark, folder, "import_batches").select("asset_id", "batch_no", "hash_status"), ["asset_id"], ["batch_no"])


# -- scalar functions ----------------------------------------------------------------------


@query(f"""WITH {CUR} SELECT asset_id, {_KIND} AS kind, regexp_extract(absolute_path, '[^/]*$') AS name, regexp_extract(absolute_path, '^(.*)/[^/]*$', 1) AS parent,
  regexp_extract(filename, '^.+(\\.[^.]+)$', 1) AS suffix, {_STEM} AS stem_key, {_ID} AS identifier FROM cur""")
def f2_path_functions(spark, folder):
    c = F.col
    return cur(spark, folder).select(
        "asset_id", media_type(c("media_type"), c("extension")).alias("kind"), T.path_name(c("absolute_path")).alias("name"),
        T.path_parent(c("absolute_path")).alias("parent"), T.path_suffix(c("filename")).alias("suffix"),
        T.normalised_stem(stem(c("filename"))).alias("stem_key"), content_identifier(c("apple_content_identifier")).alias("identifier"),
    )


@query(f"""WITH {CUR}, t AS (SELECT asset_id, trim(regexp_replace(regexp_replace(translate(absolute_path, '/\\', '__'), '[\\x00-\\x1f\\x7f]', '', 'g'), ' +', ' ', 'g')) AS s FROM cur),
x AS (SELECT asset_id, s, regexp_extract(s, '^.+(\\.[^.]+)$', 1) AS e FROM t)
SELECT asset_id, CASE WHEN length(s) <= 30 THEN s ELSE substr(s, 1, greatest(1, 30 - length(e))) || e END AS component FROM x""")
def f15_sanitised(spark, folder):
    return cur(spark, folder).select("asset_id", T.sanitise_component(F.col("absolute_path"), 30).alias("component"))


@query(f"""WITH {CUR}, x AS (SELECT asset_id, filename AS f, regexp_extract(filename, '^.+(\\.[^.]+)$', 1) AS e FROM cur),
y AS (SELECT *, substr(f, 1, length(f) - length(e)) AS s, '__a' || asset_id || e AS t FROM x)
SELECT asset_id, CASE WHEN 20 - length(t) >= 1 THEN substr(s, 1, 20 - length(t)) || t END AS short, s || '__import_' || lpad(CAST(asset_id AS VARCHAR), 8, '0') || '_1' || e AS imported FROM y""")
def f18_disambiguated(spark, folder):
    name, i = F.col("filename"), F.col("asset_id")
    return cur(spark, folder).select("asset_id", T.disambiguate(name, i, 20).alias("short"), T.import_name(name, i, F.lit(1)).alias("imported"))


@query(f"""WITH {CUR}, e AS (SELECT asset_id, 'fallback=x;source=' || source_name || ';ext=' || extension || ';source=second' AS v FROM cur)
SELECT asset_id, regexp_extract(v, '(?:^|;)source=([^;]*)', 1) AS source, CAST(NULL AS VARCHAR) AS absent FROM e""")
def f25_evidence_values(spark, folder):
    v = F.concat(F.lit("fallback=x;source="), F.col("source_name"), F.lit(";ext="), F.col("extension"), F.lit(";source=second"))
    return cur(spark, folder).select("asset_id", T.evidence_value(v, "source").alias("source"), T.evidence_value(v, "gone").alias("absent"))


@query(f"""WITH {PLAN}, d1 AS (SELECT source_name, asset_id // 1000 AS b, sha256(string_agg(CAST(asset_id AS VARCHAR) || '=' || coalesce(sha256, ''), ';' ORDER BY asset_id)) AS d FROM plan_cur GROUP BY 1, 2),
d2 AS (SELECT source_name, b // 1000 AS b, sha256(string_agg(b || '=' || d, ';' ORDER BY b)) AS d FROM d1 GROUP BY 1, 2)
SELECT source_name, sha256(string_agg(b || '=' || d, ';' ORDER BY b)) AS fingerprint FROM d2 GROUP BY 1""")
def f26_fingerprints(spark, folder):
    return runs.fingerprints(plan_cur(spark, folder), "source_name", "asset_id", F.coalesce("sha256", F.lit("")))


@query("""WITH s AS (SELECT DISTINCT o_orderkey AS k, CAST(o_totalprice * 1000 AS BIGINT) AS b FROM orders)
SELECT k, CASE WHEN b >= 1073741824 THEN printf('%.2f', floor(b / 1073741824.0::DOUBLE * 100 + 0.5) / 100) || ' GiB' WHEN b >= 1048576 THEN printf('%.2f', floor(b / 1048576.0::DOUBLE * 100 + 0.5) / 100) || ' MiB'
  WHEN b >= 1024 THEN printf('%.2f', floor(b / 1024.0::DOUBLE * 100 + 0.5) / 100) || ' KiB' ELSE b || ' B' END AS size,
  CASE WHEN k % 100000 >= 3600 THEN (k % 100000) // 3600 || 'h ' || lpad(CAST(((k % 100000) // 60) % 60 AS VARCHAR), 2, '0') || 'm' WHEN k % 100000 >= 60 THEN (k % 100000) // 60 || 'm ' || lpad(CAST((k % 100000) % 60 AS VARCHAR), 2, '0') || 's' ELSE (k % 100000) || 's' END AS duration FROM s""")
def f27_formats(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") * 1000).cast("bigint").alias("b")).distinct()
    return rows.select("k", T.format_bytes(F.col("b")).alias("size"), T.format_duration(F.col("k") % 100000).alias("duration"))


# -- further operators ---------------------------------------------------------------------


@query(f"""WITH {CUR} SELECT e.evidence_id, c.absolute_path, c.size_bytes, c.sha256 FROM (SELECT DISTINCT evidence_id, asset_id FROM date_evidence) e
LEFT JOIN cur c USING (asset_id) WHERE c.absolute_path IS NOT NULL AND c.size_bytes IS NOT NULL AND c.sha256 IS NOT NULL""")
def j9_buildable_items(spark, folder):
    items = table(spark, folder, "date_evidence").select("evidence_id", "asset_id").distinct()
    fields = ["absolute_path", "size_bytes", "sha256"]
    return items.join(cur(spark, folder).select("asset_id", *fields), "asset_id", "left").dropna(subset=fields).select("evidence_id", *fields)


@query(f"""WITH {CUR} SELECT e.evidence_id, e.asset_id, c.filename FROM (SELECT DISTINCT evidence_id, asset_id FROM date_evidence) e JOIN cur c USING (asset_id)
ORDER BY e.evidence_id, e.asset_id LIMIT 50 OFFSET 20""")
def j19_item_page(spark, folder):
    items = table(spark, folder, "date_evidence").select("evidence_id", "asset_id").distinct()
    rows = items.join(cur(spark, folder).select("asset_id", "filename"), "asset_id")
    return inventory.page(rows, [F.col("evidence_id"), F.col("asset_id")], 20, 50).select("evidence_id", "asset_id", "filename")


@query(f"""WITH {_INSPECT}, v AS (SELECT identifier, count(*) AS n FROM ins WHERE kind = 'video' AND identifier IS NOT NULL GROUP BY 1)
SELECT 'apple_live_photo' AS relationship_type, CASE WHEN n = 1 THEN 'active' ELSE 'ambiguous' END AS status, CAST(count_if(true) AS BIGINT) AS edges
FROM ins JOIN v USING (identifier) WHERE kind = 'image' GROUP BY 1, 2""")
def a6_relationship_counts(spark, folder):
    return relations.exact_pairs(_inspect(spark, folder)).groupBy("relationship_type", "status").agg(F.count("*").alias("edges"))


@query(f"""WITH {CUR}, e AS (SELECT asset_id, max(confidence) AS best, bool_and(derivation = 'estimated') AS estimated FROM date_evidence GROUP BY 1)
SELECT count(*) AS scanned, CAST(count_if(captured_at IS NOT NULL) AS BIGINT) AS dated, CAST(count_if(captured_at IS NULL) AS BIGINT) AS missing,
  CAST(count_if(captured_at IS NULL AND best >= 95) AS BIGINT) AS high_confidence, CAST(count_if(captured_at IS NULL AND estimated) AS BIGINT) AS estimated,
  CAST(count_if(captured_at IS NULL AND best IS NULL) AS BIGINT) AS no_evidence FROM cur LEFT JOIN e USING (asset_id)""")
def a20_date_summary(spark, folder):
    ev = table(spark, folder, "date_evidence").groupBy("asset_id").agg(F.max("confidence").alias("best"), F.bool_and(F.col("derivation") == "estimated").alias("estimated"))
    return cur(spark, folder).join(ev, "asset_id", "left").agg(F.count("*").alias("scanned"), *inventory.counted(
        dated="captured_at is not null", missing="captured_at is null", high_confidence="captured_at is null and best >= 95",
        estimated="captured_at is null and estimated", no_evidence="captured_at is null and best is null",
    ))


@query(f"""WITH {CUR}, {_SEEN} SELECT c.asset_id, c.sha256 FROM cur c JOIN seen s USING (asset_id)
WHERE c.hash_status = 'completed' AND c.size_bytes = s.obs_size AND c.mtime_ns = s.obs_mtime""")
def l2_reusable_hashes(spark, folder):
    return cur(spark, folder).where("hash_status = 'completed'").join(_analysed(spark, folder), "asset_id").where(
        "size_bytes = obs_size and mtime_ns = obs_mtime"
    ).select("asset_id", "sha256")


@query("""SELECT o_custkey AS plan_id, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS run_id,
  max_by(o_orderstatus, o_orderkey) IN ('O', 'P') AS resumable FROM orders GROUP BY 1""")
def l4_resumable_runs(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"))
    return runs.latest(o, ["plan_id"], "run_id", ["status"]).withColumn("resumable", F.col("status").isin("O", "P"))


@query("""SELECT DISTINCT o_custkey AS plan_id FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P')""")
def l5_gated_plans(spark, folder):
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("plan_id"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("plan_id").distinct().join(o.where("o_orderstatus = 'P'"), "plan_id", "left_anti")


@query(f"""WITH {CUR}, f AS (SELECT DISTINCT source_name, regexp_extract(absolute_path, '^(.*)/[^/]*$', 1) AS folder FROM cur UNION SELECT source_name, root_path FROM capture_sources)
SELECT a.source_name, a.folder, b.folder AS inside FROM f a JOIN f b ON a.source_name = b.source_name AND starts_with(a.folder, b.folder || '/')""")
def l10_overlapping_folders(spark, folder):
    f = cur(spark, folder).select("source_name", T.path_parent(F.col("absolute_path")).alias("folder"))
    f = f.unionByName(table(spark, folder, "capture_sources").select("source_name", F.col("root_path").alias("folder"))).distinct()
    return inventory.inside(f, "source_name", "folder")


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents WHERE text IS NOT NULL")
def f1_content_digests(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes")
    )


@query("""SELECT DISTINCT l_quantity AS q, l_linenumber AS n, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / l_linenumber END AS rate
FROM (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_linenumber FROM lineitem)""")
def f10_frame_rates(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_linenumber").alias("n")).distinct()
    text = F.concat(F.col("q").cast("string"), F.lit("/"), F.when(F.col("n") == 7, "0").otherwise(F.col("n").cast("string")))
    return rows.select("q", "n", T.frame_rate(text).alias("rate"))


@query("""WITH s AS (SELECT l_orderkey AS k, count_if(l_linestatus = 'F') AS d, count(*) AS t FROM lineitem GROUP BY 1)
SELECT k, 100.0::DOUBLE * d / t AS percent, d / 8.0::DOUBLE AS speed, CASE WHEN d > 0 THEN (t - d) / (d / 8.0::DOUBLE) END AS eta_s FROM s""")
def f29_progress(spark, folder):
    per = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("d"), F.count("*").alias("t"))
    return per.select(F.col("l_orderkey").alias("k"), T.progress(F.col("d"), F.col("t"), F.lit(8)).alias("p")).select("k", "p.percent", "p.speed", "p.eta_s")


@query("""SELECT evidence_id, evidence_type, CASE WHEN evidence_type = 'google_json' THEN try_cast(candidate_timestamp AS BIGINT) * 1000000 END AS utc_micros,
  CASE WHEN evidence_type = 'xmp_sidecar' THEN nullif(candidate_timestamp, '') END AS stated
FROM date_evidence WHERE evidence_type IN ('google_json', 'xmp_sidecar') AND regexp_matches(candidate_timestamp, '^[0-9A-Za-z:+./ -]*\\z')""")
def s7_sidecar_times(spark, folder):
    # the sidecars the evidence was read from, written again from it and read
    from lumenfold.sources.media import takeout_micros, xmp_capture

    value = F.col("candidate_timestamp")
    json = F.to_json(F.struct(F.struct(value.alias("timestamp")).alias("photoTakenTime")))
    xmp = F.concat(F.lit("<rdf:Description photoshop:DateCreated='"), value, F.lit("' xmp:Rating='3'/>"))
    rows = table(spark, folder, "date_evidence").where("evidence_type in ('google_json', 'xmp_sidecar')").where(value.rlike("^[0-9A-Za-z:+./ -]*\\z"))
    google = F.col("evidence_type") == "google_json"
    return rows.select("evidence_id", "evidence_type", F.when(google, takeout_micros(json)).alias("utc_micros"), F.when(~google, xmp_capture(xmp)).alias("stated"))