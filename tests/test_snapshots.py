import datetime as dt
import random

from lumenfold.operators.snapshots import asset_snapshot_changes

ROWS = "source_name string, snapshot_no int, asset_id long, delivered_at timestamp_ntz, size_bytes long, mtime_ns long, scan_status string, missing_since string"
RUNS = "source_name string, snapshot_no int, status string"


def at(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)


def changes(spark, rows, runs):
    out = asset_snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(runs, RUNS))
    assert out.columns == ["snapshot_no", "asset_id", "change"]
    return sorted(tuple(r) for r in out.collect())


def test_labels_and_spellings(spark):
    rows = [
        ("a", 1, 1, at(0), 5, 5, "available", None), ("a", 2, 1, at(1), 5, 5, " AVAILABLE", ""),
        ("a", 1, 2, at(0), 5, 5, "available", None), ("a", 2, 2, at(1), 6, 5, "available", None),
        ("a", 1, 3, at(0), None, None, None, None), ("a", 2, 3, at(1), None, None, None, None),
        ("a", 1, 4, at(0), 1, 1, "missing", "2024-01-01T06:00:00+06:00"), ("a", 2, 4, at(1), 1, 1, "Missing", "2024-01-01 00:00:00+00:00"),
        ("a", 1, 5, at(0), 1, 1, "available", None), ("a", 2, 6, at(1), 1, 1, "available", None), ("a", 2, None, at(1), 1, 1, "available", None),
    ]
    runs = [("a", 1, "completed"), ("a", 2, "failed"), ("a", 2, "completed_with_errors")]
    assert changes(spark, rows, runs) == [(2, 2, "changed"), (2, 5, "removed"), (2, 6, "added")]


def test_unfinished_snapshots_are_skipped_and_late_rows_count(spark):
    rows = [
        ("a", 1, 1, at(0), 5, 5, "available", None), ("a", 2, 1, at(1), 9, 9, "available", None), ("a", 3, 1, at(2), 7, 5, "available", None),
        ("a", 3, 1, at(9), 5, 5, "available", None), ("a", 3, 1, at(9), 5, 5, "available", None), ("b", 1, 8, at(0), 5, 5, "available", None),
    ]
    assert changes(spark, rows, [("a", 1, "completed"), ("a", 2, "running"), ("a", 3, "completed"), ("b", 1, "completed")]) == []
    assert changes(spark, [], []) == []


def test_brute_force(spark):
    rng = random.Random(5)
    rows, runs, state = [], [], {}
    for n in range(1, 6):
        ok = n != 3
        runs.append(("s", n, "completed" if ok else "failed"))
        snap = {i: (rng.randrange(3), rng.choice(["available", "error"])) for i in range(60) if rng.random() < 0.7}
        rows += [("s", n, i, at(n), v[0], 1, v[1], None) for i, v in snap.items()]
        if ok:
            state[n] = snap
    want, order = [], sorted(state)
    for p, n in zip(order, order[1:]):
        for i in set(state[p]) | set(state[n]):
            if state[p].get(i) != state[n].get(i):
                want.append((n, i, "added" if i not in state[p] else "removed" if i not in state[n] else "changed"))
    assert changes(spark, rows, runs) == sorted(want)
