"""Every query with oracle SQL, on the smallest tables."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lumenfold.operators import relations
from lumenfold.plans import catalogue, curation, problems
from tests.oracle import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {**catalogue.ORACLE, **curation.ORACLE, **problems.ORACLE}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, FOLDER, entry.queries()[name], SQL[name]) == ""


def test_entry_is_the_import_plan(spark):
    assert entry.entry(spark).columns == ["asset_id", "action", "destination", "collided", "expected_size_bytes", "expected_sha256"]


def test_llm_queries_are_optional():
    assert set(SQL) <= set(entry.queries())


def test_report_families(spark, tmp_path):
    from lumenfold.plans import reports

    for family in reports.FAMILIES:
        for path in reports.write_family(spark, FOLDER, family, str(tmp_path)):
            files = sorted(Path(path).glob("part-*.csv"))
            heads = {f.read_text().splitlines()[0] for f in files}
            assert len(heads) == 1 and (Path(path) / "_SUCCESS").exists()
    df, order = reports.report(spark, FOLDER, "library", "duplicates")
    rows = spark.read.csv(f"{tmp_path}/library/duplicates", header=True)
    assert rows.count() == df.count() and order[0] in rows.columns


def _agree(a, b):
    """The class of two (wall, offset) times, by the rules as stated."""
    (x, p), (y, q) = a, b
    if x is None or y is None:
        return "unavailable"
    if p is None and q is None and abs(x - y) <= 3e6 or None not in (p, q) and abs((x - p * 10**6) - (y - q * 10**6)) <= 3e6:
        return "exact"
    if abs(x - y) <= 3e6:
        return "wall"
    quarter = round(abs(x - y) / 9e8)
    if (p is None) != (q is None) and abs(x - y) <= 14 * 36e8 and quarter and abs(abs(x - y) - quarter * 9e8) <= 3e6:
        return "offset"
    return "incompatible"


def test_relations_against_plain_loops(spark):
    rows = sorted(catalogue.numbered(spark, FOLDER).collect(), key=lambda r: r.absolute_path)
    images, videos = [r for r in rows if r.kind == "image"], [r for r in rows if r.kind == "video"]
    when, out, gone = (lambda r: (r.wall, r.off)), [], set()
    for i in images:
        same = [v for v in videos if i.identifier and v.identifier == i.identifier]
        if same:
            out.append(("apple_live_photo", "active" if len(same) == 1 else "ambiguous", i.asset_id, same[0].asset_id if len(same) == 1 else None, 1.0))
            gone |= {i.asset_id, *(v.asset_id for v in same)}
    place = lambda r: (r.source_name, r.folder, r.stem_key)
    sided = set()
    for v in videos:
        near = [i for i in images if v.identifier and v.asset_id not in gone and not i.identifier and place(i) == place(v)]
        if len(near) == 1:
            c = _agree(when(near[0]), when(v))
            active = c != "incompatible"
            out.append(("apple_live_photo", "active" if active else "ambiguous", near[0].asset_id if active else v.asset_id, v.asset_id if active else None, 0.85 if c in ("incompatible", "unavailable") else 0.9))
            sided |= {near[0].asset_id, v.asset_id} if active else {v.asset_id}
        elif near:
            out.append(("apple_live_photo", "ambiguous", v.asset_id, None, 0.9))
            sided.add(v.asset_id)
    gone |= sided
    for i in images:
        if i.identifier or i.asset_id in gone:
            continue
        near = [v for v in videos if not v.identifier and v.asset_id not in gone and place(v) == place(i) and _agree(when(i), when(v)) in ("exact", "wall", "unavailable")]
        if len(near) == 1:
            out.append(("filename_pair", "active", i.asset_id, near[0].asset_id, 0.6))
            gone |= {i.asset_id, near[0].asset_id}
        elif near:
            out.append(("filename_pair", "ambiguous", i.asset_id, None, 0.6))
    out += [(f"orphan_motion_{r.kind}", "orphan", r.asset_id, None, 0.9) for r in rows if r.identifier and r.asset_id not in gone]
    got = [(r.relationship_type, r.status, r.primary_id, r.secondary_id, r.confidence) for r in relations.detect(catalogue.numbered(spark, FOLDER)).collect()]
    assert sorted(got, key=str) == sorted(out, key=str) and len({g[:2] for g in got}) > 4
