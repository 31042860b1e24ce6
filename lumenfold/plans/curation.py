"""Further queries of the catalogue operators over whole tables, each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions.unicode import collision_key
from lumenfold.operators import dates, dedup, inventory, planning, relations, runs
from lumenfold.plans import catalogue as C
from lumenfold.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- import plan with occupied names -----------------------------------------------------------

_NAMES = f"""{C.PLAN}, p AS (SELECT c.* EXCLUDE (source_priority), coalesce(c.source_priority, s.source_priority) AS source_priority FROM plan_cur c LEFT JOIN capture_sources s USING (source_name)),
occ AS (SELECT lower('Imported/' || filename) AS k, min(struct_pack(asset_id := asset_id, absolute_path := absolute_path, size_bytes := size_bytes, sha256 := sha256)) AS o FROM p WHERE source_priority >= 80 GROUP BY 1),
c AS (SELECT *, sha256 IS NOT NULL AND size_bytes IS NOT NULL AS has_digest FROM p WHERE NOT coalesce(source_priority >= 80, false)),
one AS (SELECT *, CASE WHEN has_digest AND row_number() OVER (PARTITION BY has_digest, size_bytes, sha256 ORDER BY source_priority DESC NULLS LAST, source_name, relative_path, asset_id) > 1 THEN 'duplicate_candidate' ELSE 'new' END AS first_action FROM c),
pl AS (SELECT one.*, CASE WHEN first_action = 'new' THEN 'Imported/' || filename END AS want, occ.o, coalesce(first_action = 'new' AND has_digest AND occ.o.size_bytes = one.size_bytes AND occ.o.sha256 = one.sha256, false) AS same
  FROM one LEFT JOIN occ ON first_action = 'new' AND lower('Imported/' || filename) = occ.k),
nm AS (SELECT *, want IS NOT NULL AND NOT same AND (o IS NOT NULL OR row_number() OVER (PARTITION BY lower(want), o IS NULL ORDER BY source_name, relative_path, asset_id) > 1) AS clash FROM pl),
ds AS (SELECT *, CASE WHEN same THEN 'reuse_destination' ELSE first_action END AS a2, CASE WHEN clash THEN regexp_replace(want, '(\\.[^./]+)$', '') || '__import_' || lpad(CAST(asset_id AS VARCHAR), 8, '0') || regexp_extract(want, '[^/](\\.[^./]+)$', 1) ELSE want END AS destination FROM nm),
kept AS (SELECT size_bytes, sha256, a2 AS ka, CASE WHEN same THEN o.asset_id END AS ki, CASE WHEN same THEN o.absolute_path ELSE destination END AS kp FROM ds WHERE has_digest AND a2 IN ('new', 'reuse_destination')),
fin AS (SELECT ds.*, CASE WHEN a2 = 'duplicate_candidate' AND ka IS NULL THEN 'review' ELSE a2 END AS action, CASE WHEN a2 = 'duplicate_candidate' THEN ki WHEN same THEN o.asset_id END AS canonical_asset_id,
  CASE WHEN a2 = 'duplicate_candidate' THEN kp WHEN same THEN o.absolute_path END AS matching_path, clash OR same AS collided FROM ds LEFT JOIN kept USING (size_bytes, sha256))"""


def _named(spark, folder) -> DataFrame:
    src = table(spark, folder, "capture_sources").select("source_name", F.col("source_priority").alias("__p"))
    rows = C.plan_cur(spark, folder).join(src, "source_name", "left").withColumn("source_priority", F.coalesce("source_priority", "__p")).drop("__p")
    high = F.coalesce(F.col("source_priority") >= 80, F.lit(False))
    occupied = rows.where(high).withColumn("claim_key", T.case_fold(F.concat(F.lit("Imported/"), F.col("filename"))))
    new = rows.where(~high).withColumns({
        "action": F.lit("new"), "has_digest": F.col("sha256").isNotNull() & F.col("size_bytes").isNotNull(),
        "canonical_asset_id": F.lit(None).cast("long"), "matching_path": F.lit(None).cast("string"),
    }).drop("relationship_ids")
    return planning.follow(planning.place(planning.single_copies(new), occupied, flat=True))


@query(f"WITH {_NAMES} SELECT asset_id, action, destination, collided, canonical_asset_id, matching_path FROM fin")
def import_names(spark, folder):
    # the files of the best sources lie in one folder already; all others are to join them there
    return _named(spark, folder).select("asset_id", "action", "destination", "collided", "canonical_asset_id", "matching_path")


@query(f"""WITH {_NAMES} SELECT asset_id, unnest(list_filter([CASE action WHEN 'new' THEN 'new_files' WHEN 'review' THEN 'review_items' ELSE 'existing_duplicates' END,
  CASE WHEN coalesce(contains(destination, '__import_'), false) OR action = 'reuse_destination' THEN 'name_collisions' END], lambda b: b IS NOT NULL)) AS bucket FROM fin""")
def pred_p10_report_buckets(spark, folder):
    return planning.report_buckets(_named(spark, folder))


@query(f"""WITH {_NAMES} SELECT CAST(count_if(action = 'new') AS BIGINT) AS planned, CAST(count_if(action LIKE 'duplicate%') AS BIGINT) AS skipped, CAST(count_if(action = 'reuse_destination') AS BIGINT) AS reused,
  CAST(count_if(collided) AS BIGINT) AS collisions, CAST(coalesce(sum(size_bytes) FILTER (action != 'new'), 0) AS BIGINT) AS bytes_avoided FROM fin""")
def a11_name_totals(spark, folder):
    action = F.col("action")
    return _named(spark, folder).agg(
        F.count_if(action == "new").alias("planned"), F.count_if(action.startswith("duplicate")).alias("skipped"), F.count_if(action == "reuse_destination").alias("reused"),
        F.count_if("collided").alias("collisions"), F.coalesce(F.sum(F.when(action != "new", F.col("size_bytes"))), F.lit(0)).alias("bytes_avoided"),
    )


# -- relations ---------------------------------------------------------------------------------

_INS_OLD = C._INSPECT.replace("cur AS", "cur0 AS").replace("ORDER BY last_seen_at DESC", "ORDER BY last_seen_at").replace("FROM cur\n", "FROM cur0\n").replace("ins AS", "old AS")
_EXACT = "SELECT 'apple_live_photo' AS relationship_type, CASE WHEN n = 1 THEN 'active' ELSE 'ambiguous' END AS status, asset_id AS primary_id, CASE WHEN n = 1 THEN v END AS secondary_id FROM {t} JOIN (SELECT identifier, count(*) AS n, min(asset_id) AS v FROM {t} WHERE kind = 'video' AND identifier IS NOT NULL GROUP BY 1) USING (identifier) WHERE kind = 'image'"


@query(f"""WITH {C._INSPECT}, {_INS_OLD}, o AS ({_EXACT.format(t='old')}), n AS ({_EXACT.format(t='ins')})
SELECT coalesce(o.relationship_type, n.relationship_type) AS relationship_type, coalesce(o.status, n.status) AS status, coalesce(o.primary_id, n.primary_id) AS primary_id, CASE WHEN n.status IS NULL THEN o.secondary_id ELSE n.secondary_id END AS secondary_id,
  CASE WHEN o.status IS NULL THEN 'created' WHEN n.status IS NOT NULL THEN 'reused' WHEN coalesce(o.primary_id, n.primary_id) IN (SELECT asset_id FROM ins) THEN 'stale' ELSE 'kept' END AS change
FROM o FULL JOIN n ON o.status = n.status AND o.primary_id = n.primary_id AND o.secondary_id IS NOT DISTINCT FROM n.secondary_id""")
def j8_stored_relations(spark, folder):
    # the pairs of the assets as first delivered against those of their latest state
    assets = table(spark, folder, "assets")
    others = [c for c in assets.columns if c not in ("asset_id", "last_seen_at")]
    first = assets.groupBy("asset_id").agg(F.min(F.struct("last_seen_at", *others)).alias("b")).select("asset_id", *[F.col(f"b.{c}").alias(c) for c in others])
    rows = relations.inspections(C.cur(spark, folder))
    return relations.stored_edges(relations.exact_pairs(relations.inspections(first)), relations.exact_pairs(rows), rows)


@query(f"""WITH {C._INSPECT}, e AS ({_EXACT.format(t='ins')}) SELECT e.*, p.absolute_path AS primary_path, s.absolute_path AS secondary_path
FROM e JOIN cur p ON p.asset_id = primary_id LEFT JOIN cur s ON s.asset_id = secondary_id""")
def j7_relation_report(spark, folder):
    assets = C.cur(spark, folder)
    edges = relations.exact_pairs(relations.inspections(assets))
    return relations.report_order(edges, assets).select("relationship_type", "status", "primary_id", "secondary_id", "primary_path", "secondary_path")


@query(f"""WITH {C._INSPECT}, v AS (SELECT identifier, count_if(kind = 'image') AS i, count_if(kind = 'video') AS v FROM ins WHERE identifier IS NOT NULL GROUP BY 1)
SELECT kind, count(*) AS assets, CAST(count_if(identifier IS NULL) AS BIGINT) AS without, CAST(count_if(coalesce(i > 0 AND v > 0, false)) AS BIGINT) AS paired FROM ins LEFT JOIN v USING (identifier) GROUP BY 1""")
def u2_paired_ids(spark, folder):
    # the union of all assets that an exact pair has taken, images and videos
    rows = relations.inspections(C.cur(spark, folder))
    both = rows.where("identifier is not null").groupBy("identifier").agg(F.count_if(F.col("kind") == "image").alias("i"), F.count_if(F.col("kind") == "video").alias("v"))
    paired = rows.join(both.where("i > 0 and v > 0").select("identifier", F.lit(True).alias("p")), "identifier", "left")
    return paired.groupBy("kind").agg(F.count("*").alias("assets"), F.count_if(F.col("identifier").isNull()).alias("without"), F.count_if(F.coalesce("p", F.lit(False))).alias("paired"))


# -- dates -------------------------------------------------------------------------------------


@query(f"""WITH {C.CUR}, w AS (SELECT *, {C._WALL} AS us FROM cur), un AS (SELECT * FROM w WHERE us IS NULL),
p AS (SELECT asset_id, absolute_path, list_reverse(string_split(regexp_extract(absolute_path, '^(.*)/[^/]*$', 1), '/')) AS f FROM un),
u AS (SELECT asset_id, absolute_path, unnest(f) AS name, generate_subscripts(f, 1) AS i FROM p),
e AS (SELECT asset_id, absolute_path, i, CASE WHEN regexp_matches(name, '^[0-9]{{4}}[-_][0-9]{{2}}[-_][0-9]{{2}}$') AND try_cast(replace(name, '_', '-') AS DATE) IS NOT NULL AND name[1:4] BETWEEN '1970' AND '2100'
    THEN struct_pack(kind := 'folder_date', at := replace(name, '_', '-') || ' 00:00:00', c := 88)
  WHEN regexp_matches(name, '^[0-9]{{4}}[-_](0[1-9]|1[0-2])$') THEN struct_pack(kind := 'folder_month', at := name[1:4] || '-' || name[6:7] || '-15 12:00:00', c := 70)
  WHEN regexp_matches(name, '^[0-9]{{4}}($|\\s+[^0-9])') AND name[1:4] BETWEEN '1970' AND '2100' THEN struct_pack(kind := 'folder_year', at := name[1:4] || '-07-01 12:00:00', c := 60) END AS e FROM u),
g AS (SELECT asset_id, e.kind AS kind, absolute_path AS source, e.c AS confidence, epoch_us(CAST(e.at AS TIMESTAMP)) AS utc_micros FROM e WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY i) = 1
  UNION ALL SELECT asset_id, 'filesystem_mtime', absolute_path, 40, mtime_ns // 1000000000 * 1000000 FROM un WHERE mtime_ns IS NOT NULL)
SELECT asset_id, kind, source, CAST(confidence AS INT) AS confidence, CAST(utc_micros AS BIGINT) AS utc_micros FROM g""")
def date_evidence_gathered(spark, folder):
    # no asset of the tables shares its content, its stem or its numbers' folder, so these kinds are tested on literal cases
    return dates.gather(C.cur(spark, folder))


# -- runs --------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS plan_id, count(*) AS items, CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) END), 0) AS BIGINT) AS written
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority NOT LIKE '5%' AND l_returnflag IN ('R', 'A') GROUP BY 1""")
def j6_completed_work(spark, folder):
    # orders stand for runs of customers' plans, low priority for dry runs; returned items for copied ones, accepted for verified
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_quantity").cast("bigint").alias("bytes"),
        F.when(F.col("l_returnflag") == "R", "copied").when(F.col("l_returnflag") == "A", "verified_existing").otherwise("failed").alias("status"),
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("plan_id"), F.col("o_orderpriority").startswith("5").alias("dry"))
    return runs.completed_work(items, orders, "run_id", "plan_id", "dry", "status", "bytes")


@query(f"""WITH {C.PLAN}, {C._FIRST} SELECT f.asset_id, CASE WHEN c.asset_id IS NULL THEN 'missing' WHEN f.sha256 IS NOT DISTINCT FROM c.sha256 THEN 'planned' ELSE 'content_changed' END AS outcome
FROM plan_first f LEFT JOIN plan_cur c USING (asset_id) WHERE f.camera_make IS NOT NULL""")
def l9_reversible(spark, folder):
    return runs.reversible(C.plan_first(spark, folder), C.plan_cur(spark, folder), "asset_id", F.col("camera_make").isNotNull())


@query("SELECT evidence_id, asset_id FROM date_evidence WHERE starts_with(explanation, 'exact duplicate') GROUP BY ALL")
def pred_p7_evidence_prefix(spark, folder):
    return table(spark, folder, "date_evidence").where(F.col("explanation").startswith("exact duplicate")).select("evidence_id", "asset_id").distinct()


# -- functions ---------------------------------------------------------------------------------


@query(f"WITH {C.CUR} SELECT asset_id, lower(nfc_normalize(filename)) AS collision_key, lower(filename) AS claim_key, nullif(substr(absolute_path, 1, length(absolute_path) - length(relative_path) - 1), '') AS root FROM cur")
def f17_name_keys(spark, folder):
    return C.cur(spark, folder).select(
        "asset_id", collision_key("filename").alias("collision_key"), T.case_fold(F.col("filename")).alias("claim_key"), T.source_root(F.col("absolute_path"), F.col("relative_path")).alias("root")
    )


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 1 THEN -c_acctbal ELSE c_acctbal END AS altitude, CASE WHEN c_nationkey * 4 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 59) / 3600.0::DOUBLE <= 90
  THEN round((CASE WHEN c_nationkey % 2 = 1 THEN -1 ELSE 1 END) * (c_nationkey * 4 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 59) / 3600.0::DOUBLE), 9) END AS latitude FROM (SELECT * REPLACE (CAST(c_acctbal AS DOUBLE) AS c_acctbal) FROM customer)""")
def f8_f9_positions(spark, folder):
    # degrees, minutes, seconds and altitude made from the keys of customers
    south = F.col("c_nationkey") % 2
    parts = [F.col("c_nationkey") * 4, F.col("c_custkey") % 60, F.col("c_custkey") % 59]
    degrees = T.gps_degrees(*[p.cast("double") for p in parts], F.when(south == 1, "S").otherwise("N"), 90.0)
    return table(spark, folder, "customer").select("c_custkey", T.altitude(F.col("c_acctbal").cast("double"), south).alias("altitude"), F.round(degrees, 9).alias("latitude"))


@query(f"""WITH {C.CUR}, x AS (SELECT asset_id, {C._WALL} AS us, strftime(first_seen_at, '%Y:%m:%d %H:%M:%S') AS t FROM cur)
SELECT asset_id, coalesce(us, epoch_us(strptime(t, '%Y:%m:%d %H:%M:%S'))) AS wall, CASE WHEN us IS NOT NULL THEN 'exif_datetime_original' WHEN t IS NOT NULL THEN 'exif_datetime' END AS source FROM x""")
def f12_exif_capture(spark, folder):
    # captured_at as the first tag and the first sight of the file as the last
    last = F.date_format("first_seen_at", "yyyy:MM:dd HH:mm:ss")
    rows = C.cur(spark, folder).select("asset_id", T.exif_capture({36867: F.col("captured_at"), 306: last}).alias("e"))
    return rows.select("asset_id", "e.wall", "e.source")


_PARENT = "regexp_extract({p}, '^(.*)/[^/]*$', 1)"


@query(f"""WITH {C.PLAN}, k AS (SELECT sha256, min(absolute_path) AS kept FROM plan_cur WHERE sha256 IS NOT NULL GROUP BY 1),
x AS (SELECT asset_id, {_PARENT.format(p='absolute_path')} AS a, {_PARENT.format(p='kept')} AS b FROM plan_cur JOIN k USING (sha256))
SELECT asset_id, a = b OR {_PARENT.format(p='a')} = {_PARENT.format(p='b')} AS near FROM x""")
def f14_near_copies(spark, folder):
    rows = C.plan_cur(spark, folder).where("sha256 is not null")
    kept = rows.groupBy("sha256").agg(F.min("absolute_path").alias("kept"))
    return rows.join(kept, "sha256").select("asset_id", T.nearby(T.path_parent(F.col("absolute_path")), T.path_parent(F.col("kept"))).alias("near"))


@query(f"""WITH {C.LIB} SELECT count(*) AS assets, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, CAST(count_if(hash_status = 'completed') AS BIGINT) AS hashed, CAST(coalesce(sum(size_bytes) FILTER (hash_status = 'completed'), 0) AS BIGINT) AS hashed_bytes,
  CAST(count_if(hash_status IS DISTINCT FROM 'completed') AS BIGINT) AS remaining, (SELECT count(*) FROM (SELECT DISTINCT asset_id FROM import_batches)) AS candidates FROM lib""")
def a21_index_totals(spark, folder):
    done = F.coalesce(F.col("hash_status") == "completed", F.lit(False))
    known = table(spark, folder, "import_batches").agg(F.countDistinct("asset_id").alias("candidates")).withColumn("k", F.lit(1))
    totals = C.lib(spark, folder).agg(
        F.count("*").alias("assets"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.count_if(done).alias("hashed"),
        F.coalesce(F.sum(F.when(done, F.col("size_bytes"))), F.lit(0)).alias("hashed_bytes"), F.count_if(~done).alias("remaining"),
    )
    return totals.withColumn("k", F.lit(1)).join(known, "k").drop("k")


@query(f"""WITH {C.PLAN}, r AS (SELECT *, {C._UUID.replace('stem', "regexp_replace(filename, '^(.+)\\.[^.]+$', '\\1')")} AS u FROM plan_cur WHERE sha256 IS NOT NULL)
SELECT sha256, asset_id FROM r QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY u, absolute_path, asset_id) = 1""")
def w1_keepers_by_name(spark, folder):
    # all preferences off but that against generated names
    rows = C.plan_cur(spark, folder).withColumns({"relationship_complete": F.lit(False), "source_override": F.lit(0)})
    return dedup.keepers(rows, prefer=("uuid_name",)).select("sha256", "asset_id")


@query(f"""WITH {C.CUR}, seen AS (SELECT absolute_path, nullif(b.s, -1) AS obs_size, nullif(b.m, -1) AS obs_mtime FROM (
  SELECT absolute_path, max(struct_pack(d := delivered_at, s := coalesce(size_bytes, -1), m := coalesce(mtime_ns, -1))) AS b FROM asset_snapshots WHERE absolute_path IS NOT NULL GROUP BY 1)),
{C._UPSERT.replace('asset_id', 'absolute_path')} SELECT absolute_path, size_bytes, mtime_ns, CASE WHEN fresh OR reset THEN 'pending' ELSE h END AS hash_status,
  CASE WHEN NOT fresh AND NOT reset THEN d END AS sha256, CASE WHEN seen THEN 'available' ELSE 'missing' END AS scan_status FROM u""")
def k4_upsert_by_path(spark, folder):
    snaps = table(spark, folder, "asset_snapshots").where("absolute_path is not null")
    best = F.max(F.struct("delivered_at", F.coalesce("size_bytes", F.lit(-1)).alias("s"), F.coalesce("mtime_ns", F.lit(-1)).alias("m"))).alias("b")
    null = lambda c: F.nullif(F.col(c), F.lit(-1).cast("long"))
    scanned = snaps.groupBy("absolute_path").agg(best).select("absolute_path", null("b.s").alias("size_bytes"), null("b.m").alias("mtime_ns"))
    return inventory.upsert(C.cur(spark, folder), scanned, "absolute_path")


_DRAFT = "CASE WHEN status = 'running' THEN 'draft' ELSE status END"


@query(f"""SELECT source_name, run_id, CASE WHEN {_DRAFT} = 'draft' AND run_id = max(run_id) FILTER ({_DRAFT} = 'draft') OVER (PARTITION BY source_name) THEN 'superseded' ELSE {_DRAFT} END AS status FROM scan_runs""")
def l6_superseded(spark, folder):
    # runs that never ended stand for drafts
    plans = table(spark, folder, "scan_runs").select("source_name", "run_id", F.when(F.col("status") == "running", "draft").otherwise(F.col("status")).alias("status"))
    return runs.superseded(plans, "source_name", "run_id", "status")


@query("SELECT run_id, CASE WHEN coalesce(status = 'running' AND started_at < TIMESTAMP '2024-05-01', false) THEN 'failed' ELSE status END AS status FROM scan_runs")
def l7_marked_failed(spark, folder):
    return runs.mark_failed(table(spark, folder, "scan_runs"), "status", "started_at", F.expr("timestamp_ntz'2024-05-01'")).select("run_id", "status")


@query("""SELECT 'evidence' AS reference, count(*) AS orphans FROM date_evidence WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM assets WHERE scan_status = 'available')
UNION ALL SELECT 'snapshots', count(*) FROM asset_snapshots WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM assets)
UNION ALL SELECT 'batches', count(*) FROM import_batches WHERE source_name IS NOT NULL AND source_name NOT IN (SELECT source_name FROM scan_runs WHERE status = 'completed_with_errors')""")
def l11_audit(spark, folder):
    assets, scans = table(spark, folder, "assets"), table(spark, folder, "scan_runs")
    return runs.audit({
        "evidence": (table(spark, folder, "date_evidence"), "asset_id", assets.where("scan_status = 'available'"), "asset_id"),
        "snapshots": (table(spark, folder, "asset_snapshots"), "asset_id", assets, "asset_id"),
        "batches": (table(spark, folder, "import_batches"), "source_name", scans.where("status = 'completed_with_errors'"), "source_name"),
    })


@query(f"""WITH {C.CUR}, {C._EVID}, p AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, kind, source, us) = 1),
r AS (SELECT asset_id, coalesce(bool_or(abs(e.us - p.us) > 120000000 AND e.confidence >= 88), false) AS conflict, any_value(p.confidence) AS c FROM p JOIN ev e USING (asset_id) GROUP BY 1)
SELECT count(*) AS scanned, CAST(count_if(r.asset_id IS NOT NULL) AS BIGINT) AS resolved, CAST(count_if(coalesce(conflict, false)) AS BIGINT) AS conflicts, CAST(count_if(r.asset_id IS NULL) AS BIGINT) AS no_evidence FROM cur LEFT JOIN r USING (asset_id)""")
def a20_conflicts(spark, folder):
    resolved = C.QUERIES["w5_resolve_evidence"](spark, folder).select("asset_id", "conflict", F.lit(True).alias("resolved"))
    return C.cur(spark, folder).select("asset_id").join(resolved, "asset_id", "left").agg(
        F.count("*").alias("scanned"), F.count_if(F.col("resolved").isNotNull()).alias("resolved"), F.count_if(F.coalesce("conflict", F.lit(False))).alias("conflicts"),
        F.count_if(F.col("resolved").isNull()).alias("no_evidence"),
    )


@query(f"""WITH {C.PLAN}, e AS ({C._EDGES.format(t='plan_cur')}), b AS (SELECT bundle_id, count(*) AS n FROM e GROUP BY 1)
SELECT count(*) AS bundles, CAST(count_if(n = 1) AS BIGINT) AS single, CAST(count_if(n > 1) AS BIGINT) AS shared, CAST(coalesce(max(n), 0) AS BIGINT) AS largest FROM b""")
def a14_bundle_counts(spark, folder):
    sizes = C._edges(C.plan_cur(spark, folder)).groupBy("bundle_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("bundles"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("shared"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


@query(f"""WITH {C.PLAN}, {C._FIRST} SELECT f.asset_id, c.size_bytes, c.sha256, f.size_bytes IS DISTINCT FROM c.size_bytes OR f.sha256 IS DISTINCT FROM c.sha256 AS refreshed
FROM plan_first f JOIN plan_cur c USING (asset_id)""")
def l14_identity_refresh(spark, folder):
    # the states first recorded, written again as the latest ones
    return inventory.refreshed(C.plan_first(spark, folder), C.plan_cur(spark, folder))


_SIDED = C.ORACLE["j14_one_sided_pairs"].replace("SELECT 'apple_live_photo' AS relationship_type", ", x AS (SELECT 'apple_live_photo' AS relationship_type", 1)


@query(f"""{_SIDED}), e AS ({_EXACT.format(t='ins')}) SELECT relationship_type, status, exact, count(*) AS edges FROM (SELECT relationship_type, status, false AS exact FROM x UNION ALL SELECT relationship_type, status, true FROM e) GROUP BY ALL""")
def a6_exact_and_sided_counts(spark, folder):
    rows = C.numbered(spark, folder)
    both = relations.exact_pairs(rows).unionByName(relations.one_sided_pairs(rows))
    return both.groupBy("relationship_type", "status", (F.col("confidence") == 1.0).alias("exact")).agg(F.count("*").alias("edges"))
