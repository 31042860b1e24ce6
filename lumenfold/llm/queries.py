"""Queries of the training-data problems tagged llm, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm.forest import batch_matches
from lumenfold.llm.mixing import mix_sources
from lumenfold.llm.nearest import live_pairs
from lumenfold.llm.personal import find_items, redact
from lumenfold.llm.representatives import planning_representatives
from lumenfold.llm.tokens import encode_texts
from lumenfold.plans.problems import instants_sql
from lumenfold.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return planning_representatives(table(spark, folder, "planning_assets"), table(spark, folder, "capture_sources"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return live_pairs(table(spark, folder, "assets"), table(spark, folder, "capture_sources"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return batch_matches(table(spark, folder, "library_index"), table(spark, folder, "import_batches"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents").select("doc_id", "text"), "text", "ids")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_items(table(spark, folder, "documents"), "doc_id", "text")


def p8_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact(table(spark, folder, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p3_found, p4_found, p6_ids, p7_mix, p7_shares, p8_found, p8_redacted)
}
_USABLE = "coalesce(lower(regexp_replace({c}, '^[\\s\\x00-\\x1f\\p{{Z}}\\p{{P}}\\p{{S}}]+|[\\s\\x00-\\x1f\\p{{Z}}\\p{{P}}\\p{{S}}]+$', '', 'g')) NOT IN ('', 'n/a', 'na', 'none', 'null', 'unknown', 'unknown make'), false)"
_SPACE = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"
_ENTITY = f"nullif(lower(regexp_replace(regexp_replace(apple_content_identifier, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '^[\\x00{{}}]+|[\\x00{{}}]+$', '', 'g')), '')"
_VIDEO = "CASE WHEN lower(trim(media_type)) IN ('image', 'video') THEN lower(trim(media_type)) = 'video' ELSE lower(trim(extension)) IN ('.mov', '.mp4', '.m4v', '.avi', '.mkv', '.mts') END"
ORACLE: dict[str, str] = {
    "p3_found": f"""
WITH {instants_sql()}, cur AS (
  SELECT * FROM assets WHERE asset_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY last_seen_at DESC NULLS LAST, captured_at DESC NULLS LAST) = 1
), r AS (
  SELECT asset_id, {_ENTITY} AS entity, {_VIDEO} AS video, us FROM cur JOIN inst ON kind = 'asset' AND id = asset_id WHERE us IS NOT NULL
)
SELECT least(v.asset_id, i.asset_id) AS asset_id_a, greatest(v.asset_id, i.asset_id) AS asset_id_b
FROM r v JOIN r i ON v.entity = i.entity AND v.video AND NOT i.video AND abs(v.us - i.us) <= 3000000
QUALIFY row_number() OVER (PARTITION BY v.asset_id ORDER BY abs(v.us - i.us), i.us, i.asset_id) = 1
""",
    "p2_found": f"""
WITH p AS (
  SELECT DISTINCT * FROM planning_assets QUALIFY rank() OVER (PARTITION BY asset_id ORDER BY recorded_at DESC) = 1
), n AS (
  SELECT p.asset_id, p.recorded_at, coalesce(p.source_priority, s.source_priority) AS priority, p.relative_path, p.absolute_path,
    regexp_replace(lower(regexp_replace(p.sha256, '^\\s+|\\s+$', '', 'g')), '^(?:sha-?256[:=]|0x)', '') AS content,
    regexp_replace(p.filename, '^(.+)\\.[^.]+$', '\\1') AS stem, regexp_replace(p.captured_at, '^\\s+|\\s+$', '', 'g') AS t,
    {_USABLE.format(c="p.camera_make")} AS make, {_USABLE.format(c="p.camera_model")} AS model
  FROM p LEFT JOIN capture_sources s ON p.source_name = s.source_name
), r AS (
  SELECT *, regexp_matches(stem, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[1-5][0-9a-fA-F]{{3}}-[89abAB][0-9a-fA-F]{{3}}-[0-9a-fA-F]{{12}}$') AS generated,
    coalesce(regexp_matches(t, '^[0-9]{{4}}[:-][0-9]{{2}}[:-][0-9]{{2}}[ T][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?$')
      AND t[1:4] != '0000' AND try_cast(t[1:4] || '-' || t[6:7] || '-' || t[9:10] || ' ' || t[12:19] AS TIMESTAMP) IS NOT NULL, false) AS dated
  FROM n WHERE regexp_matches(content, '^[0-9a-f]{{64}}$')
), g AS (
  SELECT content FROM r GROUP BY 1 HAVING count(*) > 1
), best AS (
  SELECT content, asset_id FROM r QUALIFY row_number() OVER (PARTITION BY content ORDER BY priority DESC NULLS LAST,
    (regexp_matches(stem, '\\p{{L}}') AND NOT generated) DESC, generated, dated::INT + make::INT + model::INT DESC, length(relative_path), absolute_path, asset_id) = 1
), c AS (
  SELECT content, asset_id FROM r WHERE dated QUALIFY row_number() OVER (PARTITION BY content ORDER BY priority DESC NULLS LAST, recorded_at DESC, asset_id) = 1
), m AS (
  SELECT content, asset_id FROM r WHERE make QUALIFY row_number() OVER (PARTITION BY content ORDER BY priority DESC NULLS LAST, recorded_at DESC, asset_id) = 1
)
SELECT best.asset_id, coalesce(c.asset_id, 0) AS captured_from, coalesce(m.asset_id, 0) AS make_from
FROM g JOIN best USING (content) LEFT JOIN c USING (content) LEFT JOIN m USING (content)
""",
}
