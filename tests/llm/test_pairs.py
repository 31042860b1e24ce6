"""Representatives, nearest times and the hash forest against brute force."""

import datetime as dt
import pathlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm.forest import ForestConfig, HashForest, batch_matches, content_classes, forest_labels
from lumenfold.llm.nearest import _merged, merge_nearest, nearest_in_time
from lumenfold.llm.representatives import planning_representatives
from lumenfold.session import scratch_path

AT = "entity string, at long, id long"


def test_nearest_brute_force(spark):
    rng = random.Random(2)
    # one entity holds a third of all rows; times tie and repeat
    row = lambda i: (rng.choice(["hot"] * 4 + [f"e{k}" for k in range(8)]), rng.randrange(0, 4000) * 5, i)
    left, right = [row(i) for i in range(600)], [row(1000 + i) for i in range(500)]
    left += [left[0], (None, 5, 1), ("hot", None, 2)]
    right += [right[0], (None, 5, 1), ("hot", None, 2)]
    got = sorted(tuple(r) for r in nearest_in_time(spark.createDataFrame(left, AT), spark.createDataFrame(right, AT), 30).collect())
    want = []
    for e, t, i in left:
        near = [(abs(t - u), u, j) for f, u, j in right if None not in (e, t, u) and f == e and abs(t - u) <= 30]
        if near:
            want.append((i, min(near)[2]))
    assert got == sorted(want)


def test_nearest_edges(spark):
    one = lambda *rows: spark.createDataFrame(list(rows), AT)
    pairs = lambda a, b: [tuple(r) for r in nearest_in_time(a, b, 3).collect()]
    assert pairs(one(("e", 100, 1)), one(("e", 97, 5), ("e", 103, 4))) == [(1, 5)]  # a tie goes to the earlier
    assert pairs(one(("e", 100, 1)), one(("e", 103, 9), ("e", 103, 4))) == [(1, 4)]  # then to the smaller id
    assert pairs(one(("e", 100, 1)), one(("e", 104, 4))) == []
    assert pairs(one(("e", -1, 1)), one(("e", 1, 4))) == [(1, 4)]
    assert pairs(one().limit(0), one(("e", 1, 4))) == [] and pairs(one(("e", 1, 4)), one()) == []


def test_merge_over_batches_of_any_size():
    # every cut of the sorted rows into Arrow batches gives the same pairs, and little is held
    rng = random.Random(3)
    rows = sorted((rng.choice("ab"), 0, rng.randrange(0, 400), rng.randrange(2), i) for i in range(500))
    rows += [("c", 0, 10 * i, 1, 1000 + i) for i in range(500)] + [("d", 0, 7, 0, 1), ("d", 0, 7, 0, 2), ("d", 0, 8, 1, 3)]
    table = pa.table({c: pa.array([r[k] for r in rows]) for k, c in enumerate(("entity", "cell", "at", "side", "id"))})
    want = None
    for size in (len(rows), 1, 2, 7, 100):
        out = list(merge_nearest(table.to_batches(size), 5))
        got = sorted((a, b) for r in out for a, b in zip(*(r.column(k).to_pylist() for k in range(2))))
        want = want or got
        assert got == want and (3, 1) in got
    held = None
    for k in range(0, 500, 50):  # left records alone: only those the tolerance still reaches wait
        part = table.slice(500 + k, 50).combine_chunks().to_batches()[0]
        held = _merged(part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0], 30, False)[0]
        assert held.num_rows <= 4


LIB = "asset_id long, size_bytes long, sha256 string, hash_status string, chunk_sums array<long>, indexed_at timestamp_ntz"
NEW = "asset_id long, batch_no int, delivered_at timestamp_ntz, size_bytes long, sha256 string, hash_status string, chunk_sums array<long>"
T0 = dt.datetime(2024, 1, 1)


def files(rng, n, pool):
    for _ in range(n):
        base = rng.choice(pool)
        pieces = [p if rng.random() < 0.8 else rng.randrange(10**9) for p in base]
        pieces = rng.choice([pieces, pieces, pieces + [7], pieces + [7, 7], [7] * 3, [7, 8], [7, 8, rng.randrange(10**9)], None, [], [None, 1, 2]])
        yield rng.choice([None, f"{rng.randrange(300):064x}", f"SHA256={rng.randrange(300):064X}"]), rng.choice(["completed", "completed", "failed"]), pieces


def brute(library, batches):
    key = lambda d, s: None if d is None or s != "completed" else d.lower().replace("sha256=", "")
    accepted = [(i, key(d, s), frozenset(x for x in p or [] if x is not None)) for i, d, s, p in library]
    out = set()
    for i, d, s, p in batches:
        k, q = key(d, s), frozenset(x for x in p or [] if x is not None)
        hits = [j for j, l, r in accepted if (k and k == l) or (q and r and 2 * len(q & r) >= len(q | r))]  # noqa: E741
        out |= {(min(i, j), max(i, j)) for j in hits}
        if not hits:
            accepted.append((i, k, q))
    return out


@pytest.mark.parametrize("common", [5, 10**6])
def test_forest_brute_force(spark, common):
    rng = random.Random(common)
    pool = [[rng.randrange(10**9) for _ in range(rng.randrange(2, 9))] for _ in range(60)]
    library = [(i, *f) for i, f in enumerate(files(rng, 250, pool))]
    batch = [(1000 + i, *f) for i, f in enumerate(files(rng, 250, pool))]
    number = lambda i: (i - 1000) * 3 // 250 + 1
    lib = spark.createDataFrame([(i, 1, d, s, p, T0) for i, d, s, p in library] + [(0, *library[0][1:1], 1, *library[0][1:], T0)], LIB)
    new = spark.createDataFrame([(i, number(i), T0, 1, d, s, p) for i, d, s, p in batch], NEW)
    # delivered again later: the first batch counts; rows without an id say nothing
    again = spark.createDataFrame([(1000, 3, T0, 1, None, None, [1, 2, 3]), (None, 1, T0, 1, None, None, None)], NEW)
    for backlog in (False, True):
        got = [tuple(r) for r in batch_matches(lib, new.unionByName(again), ForestConfig(common=common, fanout=2), backlog).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(library, batch)


def test_forest_batch_by_batch_equals_one_call(spark):
    rng = random.Random(9)
    pool = [[rng.randrange(10**9) for _ in range(5)] for _ in range(12)]
    row = lambda i, f: (i, None, [p for p in f[2] or [] if p is not None] or None)
    schema = "id long, digest string, pieces array<long>"
    lib = [row(i, f) for i, f in enumerate(files(rng, 40, pool))]
    new = [row(100 + i, f) for i, f in enumerate(files(rng, 80, pool))]
    df = lambda rows: spark.createDataFrame(rows, schema)
    folder = scratch_path(spark, "t")
    HashForest(spark, folder, ForestConfig(fanout=2)).build(df(lib))
    steps = []
    for a in range(0, 80, 20):
        forest = HashForest.open(spark, folder)  # a later session goes on with what is stored
        steps += [tuple(r) for r in forest.check(df(new[a : a + 20])).collect()]
        levels = [r["level"] for r in forest.runs]
        assert len(set(levels)) == len(levels)  # two of one level are merged
    stored = {p.name for p in pathlib.Path(folder.removeprefix("file:")).glob("run-*")}
    assert stored == {r["name"] for r in forest.runs}  # what was merged is deleted
    once = HashForest(spark, scratch_path(spark, "t")).build(df(lib)).check(df(new)).collect()
    assert sorted(steps) == sorted(tuple(r) for r in once)


def test_forest_contained_sets_with_several_common_pieces(spark):
    # the library's sets are common but for one piece and contained in the batch's, which are just under half common
    rng = random.Random(12)
    library, batch = [], []
    for i in range(240):
        h = (3, 5, 7, 9)[i % 4]
        rare = [rng.randrange(100, 10**9) for _ in range(h + 2)]  # 2 (h + 1) pieces in all
        library.append((i, None, None, [*range(h), rare[0]]))
        batch.append((1000 + i, None, None, [*range(h), *rare]))
    lib = spark.createDataFrame([(i, 1, d, s, p, T0) for i, d, s, p in library], LIB)
    new = spark.createDataFrame([(i, 1, T0, 1, d, s, p) for i, d, s, p in batch], NEW)
    got = [tuple(r) for r in batch_matches(lib, new, ForestConfig(common=20)).collect()]
    want = brute(library, batch)
    assert len(got) == len(set(got)) and set(got) == want and {(i, 1000 + i) for i in range(240)} <= want


@pytest.mark.parametrize("sizes", [(1, 2, 3, 4), (5, 9, 13, 24), (13, 20, 25, 40)])
def test_forest_sets_of_common_pieces_alone(spark, sizes):
    # all pieces come from a pool of which each is common
    rng = random.Random(sizes[0])
    pool = [rng.randrange(10**12) for _ in range(12 * sizes[-1])]
    bases = [rng.sample(pool, rng.choice(sizes)) for _ in range(150)]
    change = lambda b: sorted({p if rng.random() < 0.85 else rng.choice(pool) for p in b})
    library = [(i, None, None, change(rng.choice(bases))) for i in range(400)]
    batch = [(1000 + i, None, None, change(rng.choice(bases))) for i in range(200)]
    lib = spark.createDataFrame([(i, 1, d, s, p, T0) for i, d, s, p in library], LIB)
    new = spark.createDataFrame([(i, 1, T0, 1, d, s, p) for i, d, s, p in batch], NEW)
    got = {tuple(r) for r in batch_matches(lib, new, ForestConfig(common=0)).collect()}
    assert got == brute(library, batch) and len(got) > 50


def test_one_common_piece_forms_no_pairs(spark):
    rows = [(i, None, [7, 1000 + i], 0) for i in range(600)] + [(600 + i, None, [7, *range(10**6 + 20 * i, 10**6 + 20 * i + 9)], 0) for i in range(300)] + [(900, None, [7], 0)]
    forest = HashForest(spark, scratch_path(spark, "t"))
    files = content_classes(spark.createDataFrame(rows, "id long, digest string, pieces array<long>, batch_no int"), F.col("batch_no").alias("n"))
    forest._write_classes("run-1", files.withColumn("i", F.col("id")), len(rows))
    found = forest._candidates(forest._read("run-1", "classes"), ["run-1"]).where("q != ckey").count()
    assert found == 2 * 600  # the set of that piece alone with each of two, both ways


@pytest.mark.parametrize("k, share", [(1, 1 / 3), (2, 1 / 3), (2, 1 / 2)])
def test_recall_of_the_trees_is_as_expected(k, share):
    # pairs of sets of 30 pieces with the given similarity, found by a prefix of k values in any of a few trees
    cfg, rng = ForestConfig(), np.random.default_rng(k)
    same = round(30 * 2 * share / (1 + share))
    sets = rng.integers(0, 1 << 62, (4000, 30)).astype(np.uint64)
    others = sets.copy()
    others[:, same:] = rng.integers(0, 1 << 62, (4000, 30 - same)).astype(np.uint64)
    offsets = np.arange(4001) * 30
    free = 56 - sum(cfg.widths()[:k])
    agree = (forest_labels(sets.ravel(), offsets, cfg)[1] >> free) == (forest_labels(others.ravel(), offsets, cfg)[1] >> free)
    real = same / (60 - same)
    for trees in (4, 10, 20):
        assert abs(agree[:, :trees].any(1).mean() - (1 - (1 - real**k) ** trees)) < 0.03


def test_forest_empty_tables(spark):
    lib, new = spark.createDataFrame([], LIB), spark.createDataFrame([], NEW)
    assert batch_matches(lib, new).count() == 0
    one = spark.createDataFrame([(1, 1, T0, 1, None, None, [1, 2]), (2, 1, T0, 1, None, None, [1, 2])], NEW)
    assert [tuple(r) for r in batch_matches(lib, one).collect()] == [(1, 2)]


def test_recall_target_widens_the_prefix():
    assert ForestConfig(threshold=0.95, recall=0.9).prefix(20) > 1
    cfg = ForestConfig()
    assert cfg.prefix(8) == 2 and cfg.prefix(8, True) == 1  # a set with a common piece needs the wider prefix
    for n in range(1, 200):
        for shared in (False, True):
            assert cfg.expected(cfg.least(n, shared), cfg.prefix(n, shared)) >= cfg.recall
    with pytest.raises(ValueError):
        ForestConfig(trees=8)


PLAN = ("asset_id long, source_name string, source_priority int, absolute_path string, relative_path string, filename string, sha256 string,"
        " captured_at string, camera_make string, camera_model string, recorded_at timestamp_ntz, priority int")  # fmt: skip


def test_representatives(spark):
    sources = spark.createDataFrame([("a", 50, "UTC", "dmy"), ("b", 90, "UTC", "dmy")], "source_name string, source_priority int, time_zone string, date_order string")
    d, at = "ab" * 32, lambda k: T0 + dt.timedelta(days=k)
    uuid = "d1e3f440-1dc7-40b9-a4fa-86bdb83463fa.jpg"
    rows = [
        (1, "a", 50, "/a/x", "x", "IMG.jpg", d, "2020-01-01T00:00:00", "N/A", "m", at(1), 0),
        (2, "b", None, "/b/long", "long", uuid, f" SHA256:{d.upper()}\n", "2021-02-30T00:00:00", "Ost", None, at(2), 0),
        (3, "b", 90, "/b/s", "s", "123.jpg", f"0x{d}", None, "Ost", "--", at(3), 0),
        (3, "b", 90, "/b/old", "a much older name", "old.jpg", d, "2020-01-01T00:00:00", "Old", "m", at(0), 0),
        (4, "a", 50, "/a/y", "y", "y.jpg", "cd" * 32, None, None, None, at(1), 0), (5, "a", 50, "/a/z", "z", "z.jpg", " ", None, None, None, at(1), 0),
        (6, "a", 50, "/a/w", "w", "w.jpg", None, None, None, None, at(1), 0), (None, "a", 50, "/a/y", "y", "y.jpg", "cd" * 32, None, None, None, at(1), 0),
        (7, "a", None, None, None, None, "ef" * 32, None, "unknown", None, None, 0), (8, "zz", None, None, None, None, "ef" * 32, None, " ", None, None, 0),
    ]
    rows.append(rows[0])
    got = sorted(tuple(r) for r in planning_representatives(spark.createDataFrame(rows, PLAN), sources).collect())
    assert got == [(3, 1, 3), (7, 0, 0)]
    assert planning_representatives(spark.createDataFrame([], PLAN), sources).count() == 0
