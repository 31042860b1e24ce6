"""The families of reports: each a named query, and the total order in which it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.plans import catalogue, curation
from lumenfold.sources import reports

#: family -> file -> (query, order, condition or None)
FAMILIES: dict[str, dict[str, tuple[str, tuple[str, ...], str | None]]] = {
    "hash": {"duplicate_groups": ("a1_duplicate_groups", ("sha256",), None), "duplicate_files": ("j3_duplicate_files", ("asset_id",), None)},
    "metadata": {
        "missing_metadata": ("pred_p9_missing_metadata", ("asset_id",), None), "cameras": ("a9_camera_stats", ("make", "model", "files"), None),
        "coverage": ("a10_coverage", ("analysed",), None),
    },
    "relationships": {
        "pairs": ("j7_relation_report", ("relationship_type", "primary_path", "secondary_id"), "status = 'active'"),
        "ambiguous": ("j7_relation_report", ("relationship_type", "primary_path"), "status = 'ambiguous'"),
        "counts": ("a6_relationship_counts", ("relationship_type", "status"), None), "conflicts": ("j16_bundle_conflicts", ("asset_id",), None),
    },
    "library": {"summary": ("a13_library_summary", ("files",), None), "duplicates": ("a3_canonical_duplicates", ("sha256", "size_bytes", "absolute_path", "asset_id"), None)},
    "review": {"stat_review": ("pred_p8_stat_review", ("asset_id",), None)},
    "import_plan": {
        name: ("pred_p10_report_buckets", ("asset_id",), f"bucket = '{name}'") for name in ("new_files", "existing_duplicates", "name_collisions", "review_items")
    },
    "import_run": {"totals": ("a11_name_totals", ("planned",), None), "items": ("import_names", ("asset_id",), None)},
    "date_scan": {"evidence": ("date_evidence_gathered", ("asset_id", "kind", "source"), None), "summary": ("a20_date_summary", ("scanned",), None)},
    "verification": {"outcomes": ("l8_verify", ("asset_id",), None), "reversible": ("l9_reversible", ("asset_id",), None)},
}


def report(spark: SparkSession, folder: str, family: str, name: str) -> tuple[DataFrame, tuple[str, ...]]:
    query, order, condition = FAMILIES[family][name]
    df = {**catalogue.QUERIES, **curation.QUERIES}[query](spark, folder)
    return (df.where(F.expr(condition)) if condition else df), order


def write_family(spark: SparkSession, folder: str, family: str, out: str) -> list[str]:
    """Write all reports of a family below ``out``; their paths."""
    paths = []
    for name in FAMILIES[family]:
        df, order = report(spark, folder, family, name)
        paths.append(f"{out}/{family}/{name}")
        reports.write_csv(df, paths[-1], order)
    return paths
