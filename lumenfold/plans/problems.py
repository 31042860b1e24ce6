"""Queries of the general training-data problems (1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.functions.timestamps import ABBREVIATIONS, MONTHS
from lumenfold.operators.instants import all_instants
from lumenfold.operators.snapshots import asset_snapshot_changes
from lumenfold.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return asset_snapshot_changes(table(spark, folder, "asset_snapshots"), table(spark, folder, "scan_runs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return all_instants(
        table(spark, folder, "assets"), table(spark, folder, "date_evidence"), table(spark, folder, "capture_sources")
    )


def instants_sql() -> str:
    """CTEs for an engine with RE2 and named zones: ``inst`` (kind, id, us), one row per readable value or more.

    Field by field: each component is what any of the ten forms has in its place.
    """
    sp = r"[\s\p{Z}]"
    clock = r"([0-9]{1,2})[:.\-]([0-9]{2})(?:[:.\-]([0-9]{2})(?:[.,]([0-9]{1,12}))?)?"
    zone = rf"(?:{sp}*([A-Za-z]{{1,5}}|[+\-][0-9]{{2}}:?[0-9]{{2}}|[+\-][0-9]{{2}}))?"
    tail = rf"{clock}(?:{sp}*([AaPp]\.?[Mm]\.?))?{zone}"
    names = "|".join(f"{m}|{m[:3]}" for m in reversed(MONTHS)) + "|sept"
    day = rf"(?:[A-Za-z]{{2,9}}\.?,?{sp}+)?"
    late = f"(?:,?{sp}+{tail})?"
    forms = (
        ("ynd hisfaz", rf"([0-9]{{4}})[-:/.]([0-9]{{1,2}})[-:/.]([0-9]{{1,2}})(?:(?:T|{sp}+|[-_]){tail})?"),
        ("ynd hisfz", rf"([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(?:[T_\-\s]?([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})(?:\.([0-9]{{1,12}}))?{zone})?"),
        ("yn", r"([0-9]{4})[-:/.]([0-9]{1,2})"), ("y", r"([0-9]{4})"),
        ("xwy hisfaz", rf"([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}){late}"), ("dny hisfaz", rf"([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}){late}"),
        ("dmy hisfaz", rf"{day}([0-9]{{1,2}})\.?[\s\p{{Z}}-]+({names})\.?[\s\p{{Z}}-]+([0-9]{{4}}){late}"), ("mdy hisfaz", rf"{day}({names})\.?{sp}+([0-9]{{1,2}}),?{sp}+([0-9]{{4}}){late}"),
        ("e", "(-?(?:[0-9]{9,10}|[0-9]{13}|[0-9]{16}|[0-9]{19}))"), ("eg", r"(-?[0-9]{9,10})\.([0-9]{1,12})"),
    )

    def field(f: str) -> str:
        found = [f"nullif(regexp_extract(t, '(?i)^(?:{p})$', {fs.replace(' ', '').index(f) + 1}), '')" for fs, p in forms if f in fs]
        return f"coalesce({', '.join(found)}, NULL)"

    fields = ", ".join(f"{field(f)} AS {'f' + f}" for f in "ynmxwdhisfazeg")
    abbreviations = ", ".join(f"('{k}', {v})" for k, v in ABBREVIATIONS.items())
    strip = "[\\s\\x00-\\x1f\\x85\\p{Z}\\x{feff}]+"
    micros = "CAST(rpad(substr({c}, 1, 6), 6, '0') AS BIGINT)"
    return f"""
ac AS (SELECT asset_id, captured_at, source_name FROM assets WHERE asset_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY last_seen_at DESC NULLS LAST, captured_at DESC NULLS LAST) = 1),
raw AS (
  SELECT 'asset' AS kind, asset_id AS id, captured_at AS v, CAST(NULL AS VARCHAR) AS zone, s.time_zone AS fall, s.date_order FROM ac LEFT JOIN capture_sources s USING (source_name)
  UNION ALL SELECT 'evidence', evidence_id, candidate_timestamp, trim(timezone), s.time_zone, s.date_order FROM date_evidence e LEFT JOIN ac ON e.asset_id = ac.asset_id LEFT JOIN capture_sources s USING (source_name) WHERE evidence_id IS NOT NULL
), txt AS (SELECT *, regexp_replace(v, '^{strip}|{strip}$', '', 'g') AS t, coalesce(lower(trim(date_order)) = 'mdy', false) AS mdy FROM raw),
got AS (SELECT *, {fields} FROM txt),
num AS (SELECT kind, id, zone, fall, lower(fz) AS z, fe AS e, length(ltrim(fe, '-')) AS el, coalesce({micros.format(c='fg')}, 0) AS g, coalesce({micros.format(c='ff')}, 0) AS f,
  CAST(fy AS INT) AS y, coalesce(CAST(fn AS INT), list_position([{', '.join(repr(m[:3]) for m in MONTHS)}], lower(substr(fm, 1, 3))), CAST(CASE WHEN mdy THEN fx ELSE fw END AS INT)) AS n,
  coalesce(CAST(fd AS INT), CAST(CASE WHEN mdy THEN fw ELSE fx END AS INT)) AS d, CAST(fi AS INT) AS i, coalesce(CAST(fs AS INT), 0) AS s,
  CASE WHEN fa IS NULL THEN CAST(fh AS INT) WHEN CAST(fh AS INT) BETWEEN 1 AND 12 THEN CAST(fh AS INT) % 12 + CASE WHEN lower(fa) LIKE 'p%' THEN 12 ELSE 0 END ELSE 99 END AS h FROM got),
loc AS (SELECT *, CASE WHEN y >= 1 AND coalesce(h, 0) <= 23 AND coalesce(i, 0) <= 59 AND s <= 59 THEN epoch_us(try_cast(lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(coalesce(n, 7) AS VARCHAR), 2, '0') || '-'
    || lpad(CAST(coalesce(d, CASE WHEN n IS NULL THEN 1 ELSE 15 END) AS VARCHAR), 2, '0') AS TIMESTAMP)) + (CASE WHEN h IS NULL THEN 43200 ELSE h * 3600 + i * 60 + s END) * 1000000::BIGINT + f END AS us,
  replace(z, ':', '') AS zz, CASE WHEN zone IN (SELECT name FROM pg_timezone_names()) THEN zone ELSE fall END AS region FROM num),
off AS (SELECT loc.*, CASE WHEN regexp_matches(z, '^[+-]') THEN (CASE WHEN z[1] = '-' THEN -60 ELSE 60 END) * (CAST(zz[2:3] AS INT) * 60 + coalesce(CAST(nullif(zz[4:5], '') AS INT), 0)) ELSE ab.o END AS o,
  CASE WHEN regexp_matches(zone, '^[+-][0-9]{{2}}:?[0-9]{{2}}$') THEN (CASE WHEN zone[1] = '-' THEN -60 ELSE 60 END) * (CAST(zone[2:3] AS INT) * 60 + CAST(right(zone, 2) AS INT)) END AS zo,
  epoch_us(timezone(region, make_timestamp(us))) AS late FROM loc LEFT JOIN (VALUES {abbreviations}) ab(k, o) ON z = k),
inst AS (SELECT kind, id, CAST(CASE WHEN e IS NOT NULL THEN CASE WHEN el <= 10 THEN CAST(e AS BIGINT) * 1000000 + (CASE WHEN e[1] = '-' THEN -1 ELSE 1 END) * g WHEN el = 13 THEN CAST(e AS BIGINT) * 1000 WHEN el = 16 THEN CAST(e AS BIGINT) ELSE CAST(e AS BIGINT) // 1000 END
  WHEN z IS NOT NULL THEN us - o * 1000000::BIGINT WHEN zo IS NOT NULL THEN us - zo * 1000000::BIGINT
  WHEN epoch_us(timezone(region, timezone('UTC', make_timestamp(late - 3600000000)))) = us THEN late - 3600000000
  WHEN epoch_us(timezone(region, timezone('UTC', make_timestamp(late - 1800000000)))) = us THEN late - 1800000000 ELSE late END AS BIGINT) AS us FROM off)"""


QUERIES = {"p1_found": p1_found, "p5_found": p5_found}
ORACLE = {
    "p5_found": f"WITH {instants_sql()} SELECT kind AS record_kind, id AS record_id, max(us) AS utc_micros FROM inst WHERE us IS NOT NULL GROUP BY 1, 2",
    "p1_found": """
WITH runs AS (
  SELECT DISTINCT source_name, snapshot_no FROM scan_runs
  WHERE lower(trim(status)) IN ('completed', 'completed_with_errors')
), pairs AS (
  SELECT source_name, snapshot_no,
    lag(snapshot_no) OVER (PARTITION BY source_name ORDER BY snapshot_no) AS previous
  FROM runs
), typed AS (
  SELECT snapshot_no, asset_id, source_name, delivered_at, size_bytes, mtime_ns,
    nullif(lower(trim(scan_status)), '') AS status,
    epoch_us(CAST(CASE WHEN regexp_matches(trim(missing_since), '(Z|[+-][0-9]{2}:?[0-9]{2})$')
      THEN regexp_replace(nullif(trim(missing_since), ''), '([+-][0-9]{2})([0-9]{2})$', '\\1:\\2')
      ELSE nullif(trim(missing_since), '') || 'Z' END AS TIMESTAMPTZ)) AS missing
  FROM asset_snapshots
), latest AS (
  SELECT * FROM typed
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, asset_id ORDER BY delivered_at DESC) = 1
), later AS (
  SELECT p.source_name, p.snapshot_no AS at, asset_id, size_bytes, mtime_ns, status, missing
  FROM latest l JOIN pairs p ON l.source_name = p.source_name AND l.snapshot_no = p.snapshot_no
  WHERE p.previous IS NOT NULL
), earlier AS (
  SELECT p.source_name, p.snapshot_no AS at, asset_id, size_bytes, mtime_ns, status, missing
  FROM latest l JOIN pairs p ON l.source_name = p.source_name AND l.snapshot_no = p.previous
)
SELECT coalesce(n.at, o.at) AS snapshot_no, coalesce(n.asset_id, o.asset_id) AS asset_id,
  CASE WHEN o.asset_id IS NULL THEN 'added' WHEN n.asset_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM later n FULL JOIN earlier o
  ON n.source_name = o.source_name AND n.at = o.at AND n.asset_id = o.asset_id
WHERE o.asset_id IS NULL OR n.asset_id IS NULL
  OR n.size_bytes IS DISTINCT FROM o.size_bytes OR n.mtime_ns IS DISTINCT FROM o.mtime_ns
  OR n.status IS DISTINCT FROM o.status OR n.missing IS DISTINCT FROM o.missing
""",
}
