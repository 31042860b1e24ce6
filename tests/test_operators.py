"""Relations, planning, dates, runs, sources, reports and streaming on small literal tables."""

import datetime as dt

from pyspark.sql import functions as F

from lumenfold.operators import dates, dedup, inventory, planning, relations, runs
from lumenfold.sources import media, reports
from lumenfold.streaming import inventory as streaming

ASSET = ("asset_id long, source_name string, absolute_path string, filename string, extension string, media_type string, size_bytes long, mtime_ns long,"
         " scan_status string, captured_at string, apple_content_identifier string, kind string")  # fmt: skip


def asset(i, path, ident=None, at=None, source="s"):
    name = path.rpartition("/")[2]
    return (i, source, path, name, "." + name.rpartition(".")[2].lower(), None, 1, 1, "available", at, ident, "clash")


def edges(spark, *rows):
    found = relations.detect(relations.inspections(spark.createDataFrame(list(rows), ASSET)))
    return sorted((r.relationship_type, r.status, r.primary_id, r.secondary_id, r.confidence) for r in found.collect())


def test_one_sided_pairs(spark):
    pair = lambda a, b: edges(spark, asset(1, "/d/IMG_1.HEIC", None, a), asset(2, "/d/IMG_1.MOV", "id", b))
    assert pair(None, None) == [("apple_live_photo", "active", 1, 2, 0.85)]
    assert pair("2020-01-01T12:00:00", "2020-01-01T06:00:00Z") == [("apple_live_photo", "active", 1, 2, 0.9)]
    assert pair("2020-01-01T12:00:00", "2020-01-01T12:00:04") == [("apple_live_photo", "ambiguous", 2, None, 0.85)]
    assert edges(spark, asset(1, "/d/IMG_1.HEIC"), asset(2, "/e/IMG_1.MOV", "id")) == [("orphan_motion_video", "orphan", 2, None, 0.9)]
    assert edges(spark, asset(1, "/d/IMG_1.HEIC"), asset(3, "/d/IMG_1.JPG"), asset(2, "/d/IMG_1.MOV", "id")) == [("apple_live_photo", "ambiguous", 2, None, 0.9)]
    assert edges(spark) == []


def test_shared_identifier_beats_the_name(spark):
    got = edges(spark, asset(1, "/d/a.heic", "{X}"), asset(2, "/e/b.mov", "x "), asset(3, "/d/a.mov"))
    assert got == [("apple_live_photo", "active", 1, 2, 1.0)]
    several = edges(spark, asset(1, "/d/a.heic", "x"), asset(2, "/e/b.mov", "x"), asset(3, "/e/c.mov", "x"))
    assert several == [("apple_live_photo", "ambiguous", 1, None, 1.0)]


def test_filename_fallback(spark):
    assert edges(spark, asset(1, "/p/d/IMG_E7.jpg"), asset(2, "/p/e/IMG_7.mov")) == [("filename_pair", "active", 1, 2, 0.6)]
    two = edges(spark, asset(1, "/p/d/a.jpg"), asset(2, "/p/d/a.mov"), asset(3, "/p/e/a.mp4"))
    assert two == [("filename_pair", "ambiguous", 1, None, 0.6)]
    # a contested video goes to the first image by path; the other is left alone
    contested = edges(spark, asset(1, "/p/d/b.heic"), asset(4, "/p/d/b.jpg"), asset(2, "/p/d/b.mov"))
    assert contested == [("filename_pair", "active", 1, 2, 0.6)]
    assert edges(spark, asset(1, "/p/d/b.heic"), asset(2, "/q/r/b.mov")) == []


def test_many_pairs(spark):
    rows = []
    for k in range(600):
        rows += [asset(2 * k, f"/r/{k}/IMG_1.heic", None, "2020-01-01T12:00:00"), asset(2 * k + 1, f"/r/{k}/IMG_1.mov", f"id{k}", "2020-01-01T06:00:00Z")]
    assert {e[:2] for e in edges(spark, *rows)} == {("apple_live_photo", "active")}


CAND = ("asset_id long, source_name string, source_priority int, absolute_path string, relative_path string, size_bytes long, sha256 string, hash_status string")
LIB = "asset_id long, absolute_path string, size_bytes long, sha256 string, hash_status string"


def plan(spark, cand, lib, occupied=()):
    rows = planning.single_copies(planning.classify(spark.createDataFrame(cand, CAND), spark.createDataFrame(lib, LIB)))
    taken = spark.createDataFrame([(o,) for o in occupied], "claim_key string")
    return {r.asset_id: (r.action, r.destination) for r in planning.place(rows, taken).collect()}


def test_import_plan(spark):
    got = plan(spark, [(1, "alpha", 10, "/a/copy.jpg", "copy.jpg", 4, "d", "completed"), (2, "beta", 90, "/b/original.jpg", "original.jpg", 4, "d", "completed")], [])
    assert got == {1: ("duplicate_candidate", None), 2: ("new", "Imported/original.jpg")}
    lib = [(9, "/c/z.jpg", 4, "d", "completed"), (8, "/c/a.jpg", 4, "d", "completed"), (7, "/c/u.jpg", 6, None, "pending")]
    cand = [(1, "a", 1, "/a/x.jpg", "x.jpg", 4, "d", "completed"), (2, "a", 1, "/a/y.jpg", "y.jpg", 6, "e", "completed"), (3, "a", 1, "/a/w.jpg", "w.jpg", 5, None, "failed"),
            (4, "a", 1, "/a/v.jpg", "v.jpg", 4, None, "failed"), (5, "a", 1, "/a/n.jpg", "n.jpg", None, None, None), (6, "a", 1, "/a/q.jpg", "Q.jpg", 7, None, None)]
    got = plan(spark, cand, lib, ["imported/q.jpg"])
    assert {k: v[0] for k, v in got.items()} == {1: "duplicate_existing", 2: "review", 3: "new", 4: "review", 5: "new", 6: "new"}
    assert got[6][1] == "Imported/Q__import_00000006.jpg"
    names = [(i, s, 1, f"/{s}/{n}", n, 100 + i, None, None) for i, (s, n) in enumerate([("a", "IMG_0001.jpg"), ("b", "IMG_0001.jpg"), ("c", "img_0001.JPG")])]
    dest = [v[1].lower() for v in plan(spark, names, []).values()]
    assert len(set(dest)) == 3 and plan(spark, [], []) == {}


def test_no_name_is_given_twice(spark):
    # suffixed names that exist already, or that another candidate bears, are passed over
    rows = [(i, s, 1, f"/{s}/{n}", n, 100 + i, None, None) for i, s, n in [(1, "a", "x.jpg"), (2, "b", "x.jpg"), (3, "c", "X.JPG"), (4, "d", "x__import_00000002.jpg"), (5, "e", "straße.jpg"), (6, "f", "STRASSE.jpg"), (7, "g", "noext"), (8, "h", "noext")]]
    got = plan(spark, rows, [], ["imported/x__import_00000003.jpg", "imported/x__import_00000003_1.jpg", "imported/x__import_00000003_1_1_1.jpg"])
    assert {k: v[1] for k, v in got.items()} == {
        1: "Imported/x.jpg", 2: "Imported/x__import_00000002_1.jpg", 3: "Imported/X__import_00000003_1_1.JPG", 4: "Imported/x__import_00000002.jpg",
        5: "Imported/straße.jpg", 6: "Imported/STRASSE__import_00000006.jpg", 7: "Imported/noext", 8: "Imported/noext__import_00000008",
    }


def test_reuse_and_followers(spark):
    cand = [(1, "a", 90, "/a/x.jpg", "d/x.jpg", 4, "d", "completed"), (2, "b", 5, "/b/y.jpg", "y.jpg", 4, "d", "completed"), (3, "a", 9, "/a/z.jpg", "z.jpg", 5, "e", "completed"),
            (4, "b", 5, "/b/w.jpg", "w.jpg", 5, "e", "completed"), (5, "b", 5, "/b/v.jpg", "v.jpg", 4, "f", "completed")]
    rows = planning.single_copies(planning.classify(spark.createDataFrame(cand, CAND), spark.createDataFrame([], LIB)))
    there = spark.createDataFrame([("base a/d/x.jpg", 77, "/lib/x.jpg", 4, "d"), ("imported/v.jpg", 78, "/lib/v.jpg", 4, "other")], "claim_key string, asset_id long, absolute_path string, size_bytes long, sha256 string")
    bases = spark.createDataFrame([("a", "Base A")], "source_name string, base string")
    got = {r.asset_id: (r.action, r.destination, r.canonical_asset_id, r.matching_path, r.collided) for r in planning.follow(planning.place(rows, there, bases)).collect()}
    assert got == {
        1: ("reuse_destination", "Base A/d/x.jpg", 77, "/lib/x.jpg", True), 2: ("duplicate_candidate", None, 77, "/lib/x.jpg", False), 3: ("new", "Base A/z.jpg", None, None, False),
        4: ("duplicate_candidate", None, None, "Base A/z.jpg", False), 5: ("new", "Imported/v__import_00000005.jpg", None, None, True),
    }


def test_motion_photos_come_first(spark):
    rows = relations.inspections(spark.createDataFrame([asset(1, "/d/a.jpg", "id"), asset(2, "/d/b.mov", "id"), asset(3, "/d/c.jpg"), asset(4, "/d/d.jpg", "x")], ASSET))
    told = spark.createDataFrame([(1, "google", "active", None), (3, "samsung", "invalid", None), (4, None, None, "unreadable")], "asset_id long, motion_kind string, motion_status string, error string")
    rows = rows.join(told, "asset_id", "left")
    found = relations.detect(rows)
    assert sorted((r.relationship_type, r.status, r.primary_id, r.confidence) for r in found.collect()) == [
        ("google_motion_photo", "active", 1, 0.99), ("orphan_motion_image", "orphan", 4, 0.9), ("orphan_motion_video", "orphan", 2, 0.9), ("samsung_motion_photo", "invalid", 3, 0.0)]
    states = {r.asset_id: r.state for r in relations.asset_states(rows, found.where("primary_id != 4")).collect()}
    assert states == {1: "completed", 2: "completed", 3: "invalid", 4: "failed"}
    ordered = relations.report_order(found, rows).collect()
    assert [r.primary_id for r in ordered] == [1, 4, 2, 3]


def test_stored_edges(spark):
    schema = "relationship_type string, status string, primary_id long, secondary_id long, confidence double"
    old = spark.createDataFrame([("p", "active", 1, 2, 1.0), ("p", "active", 3, None, 1.0), ("p", "active", 9, None, 1.0)], schema)
    new = spark.createDataFrame([("p", "active", 1, 2, 0.5), ("p", "ambiguous", 3, None, 1.0)], schema)
    seen = spark.createDataFrame([(1,), (3,)], "asset_id long")
    got = {(r.status, r.primary_id): r.change for r in relations.stored_edges(old, new, seen).collect()}
    assert got == {("active", 1): "reused", ("active", 3): "stale", ("ambiguous", 3): "created", ("active", 9): "kept"}


def test_gathered_dates(spark):
    row = lambda i, path, size=None, sha=None, mtime=None, at=None: (i, path, path.rpartition("/")[2], "." + path.rpartition(".")[2], size, sha, mtime, at)
    rows = [row(1, "/d/IMG_0001.dng", 5, "x"), row(2, "/d/IMG_0001.jpg", 6, "y", None, "2020-01-01T00:00:00"), row(3, "/e/copy.jpg", 5, "x", None, "2021-01-01T00:00:00"),
            row(4, "/2019-05-06/IMG_20180102_030405.jpg", None, None, 5_000_000_000), row(5, "/f/P0002.jpg"), row(6, "/f/P0001.jpg", None, None, None, "2020-01-01T00:00:00"),
            row(7, "/f/P0003.jpg", None, None, None, "2020-01-01T00:02:00")]
    df = spark.createDataFrame(rows, "asset_id long, absolute_path string, filename string, extension string, size_bytes long, sha256 string, mtime_ns long, captured_at string")
    got = {(r.asset_id, r.kind): r.confidence for r in dates.gather(df).collect()}
    assert got == {(1, "exact_duplicate"): 99, (1, "raw_jpeg_pair"): 98, (4, "filename_datetime"): 95, (4, "folder_date"): 88, (4, "filesystem_mtime"): 40, (5, "neighbor_interpolation"): 93}
    assert dates.gather(df.limit(0)).count() == 0


def test_dates(spark):
    names = ["IMG_20210517_123456.jpg", "2021-05-17 12.34.56.jpg", "Screenshot_2021-05-17-12-34-56.png", "PXL_20210517_123456789.jpg", "holiday 2021-05-17.jpg", "invoice_123456789.pdf", "IMG_20210230_123456.jpg"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("i", dates.filename_evidence(F.col("n")).alias("e")).orderBy("i")
    got = [tuple(r.e) if r.e else None for r in df.collect()]
    assert got[:4] == [("filename_datetime", "2021-05-17T12:34:56", 95)] * 4 and got[4] == ("filename_date", "2021-05-17T00:00:00", 90) and got[5:] == [None, None]
    paths = ["/a/2021-05-17/x.jpg", "/a/2021-05/x.jpg", "/2018 Wedding/b/x.jpg", "/a/b/x.jpg", "/2018/2021-13-01/x.jpg"]
    df = spark.createDataFrame(list(enumerate(paths)), "i int, n string").select("i", dates.folder_evidence(F.col("n")).alias("e")).orderBy("i")
    assert [tuple(r.e) if r.e else None for r in df.collect()] == [
        ("folder_date", "2021-05-17T00:00:00", 88), ("folder_month", "2021-05-15T12:00:00", 70), ("folder_year", "2018-07-01T12:00:00", 60), None, ("folder_year", "2018-07-01T12:00:00", 60)]


def test_neighbours(spark):
    rows = [(1, "/d/IMG_5341.jpg", 0), (2, "/d/IMG_5342.jpg", None), (3, "/d/IMG_5343.jpg", 180_000_000), (4, "/d/DSC_5342.jpg", None), (5, "/e/IMG_5342.jpg", None),
            (6, "/d/IMG_5999.jpg", 10), (7, "/d/IMG_6000.jpg", None), (8, "/d/IMG_6001.jpg", 20), (9, None, None)]
    df = spark.createDataFrame(rows, "asset_id long, path string, at long")
    assert sorted((r.asset_id, r.utc_micros) for r in dates.neighbours(df, "path", "at").collect()) == [(2, 90_000_000), (7, 15)]
    assert dates.neighbours(df, "path", "at", sequence_gap=1).count() == 0


def test_resolution(spark):
    s, m = 1_000_000, 60_000_000
    rows = [(1, "filename", None, 95, 0), (1, "folder", None, 88, m), (2, "a", "x", 95, 0), (2, "b", "y", 99, 400 * 86400 * s), (3, "a", None, None, 5), (4, "a", None, 40, 0)]
    got = {r.asset_id: (r.kind, r.confidence, r.conflict) for r in dates.resolve(spark.createDataFrame(rows, "asset_id long, kind string, source string, confidence int, utc_micros long")).collect()}
    assert got == {1: ("filename", 97, False), 2: ("b", 99, True), 4: ("a", 40, False)}


def test_duplicates_and_keepers(spark):
    df = spark.createDataFrame([(1, 9, "d"), (2, 9, "d"), (3, 9, "e"), (4, 5, None), (5, None, None)], "asset_id long, size_bytes long, sha256 string")
    assert sorted(r.asset_id for r in dedup.size_candidates(df).collect()) == [1, 2, 3]
    assert [tuple(r) for r in dedup.duplicate_groups(df).collect()] == [("d", 2, 9, 18)]
    flags = {r.asset_id: r.shares_size for r in dedup.shared_size_flags(df).collect()}
    assert flags == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_inventory(spark):
    old = spark.createDataFrame([(1, 5, 5, "completed", "d"), (2, 5, 5, "completed", "e"), (3, 5, None, "completed", "f")], "asset_id long, size_bytes long, mtime_ns long, hash_status string, sha256 string")
    new = spark.createDataFrame([(1, 5, 5), (2, 6, 5), (4, 1, 1)], "asset_id long, size_bytes long, mtime_ns long")
    got = {r.asset_id: (r.hash_status, r.sha256, r.scan_status) for r in inventory.upsert(old, new).collect()}
    assert got == {1: ("completed", "d", "available"), 2: ("pending", None, "available"), 3: ("completed", "f", "missing"), 4: ("pending", None, "available")}
    last = inventory.last_write(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, run int, v string"), ["k"], ["run"])
    assert [tuple(r) for r in last.collect()] == [(1, 2, "b")]


def test_runs(spark):
    rec = spark.createDataFrame([(1, 5, "d"), (2, 5, "d"), (3, 5, "d"), (4, None, None)], "asset_id long, size_bytes long, sha256 string")
    obs = spark.createDataFrame([(1, 5, "d"), (2, 6, "d"), (4, None, "x")], "asset_id long, size_bytes long, sha256 string")
    assert {r.asset_id: r.outcome for r in runs.verified(rec, obs, "asset_id").collect()} == {1: "verified", 2: "size_mismatch", 3: "missing", 4: "digest_mismatch"}


def test_files_and_markers(spark, tmp_path):
    xmp = b'<x GCamera:MotionPhoto="1" GCamera:MicroVideoOffset="%d"/>' + b"." * 50
    (tmp_path / "sub").mkdir()
    cases = {"good.jpg": xmp % 5, "bad.jpg": xmp % 999, "plain.jpg": b"trailing bytes", "sam.jpg": b"MotionPhoto_Data" + b"vv", "cut.jpg": b"..SEF\x00"}
    cases["sub/tail.MOV"] = b"." * (5 << 20) + b"Samsung_Motion_Photo" + b"vvv"
    cases["id.heic"] = b"..com.apple.quicktime.content.identifier\x00 0007B23C-93B8-4D35-A947-6221F6554AEB.."
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    df = media.files(spark, str(tmp_path), content=True)
    rows = {r.name: r for r in df.select("name", "size_bytes", "media_type", media.motion_photo(F.col("content")).alias("m"), media.embedded_identifier(F.col("content")).alias("id")).collect()}
    state = {n: tuple(r.m) if r.m else None for n, r in rows.items()}
    assert state["good.jpg"] == ("google", "active", 5) and state["bad.jpg"] == ("google", "invalid", 999) and state["plain.jpg"] is None
    assert state["sam.jpg"] == ("samsung", "active", 16) and state["cut.jpg"][:2] == ("samsung", "invalid")
    assert state["tail.MOV"] == ("samsung", "active", (5 << 20) + 20) and rows["tail.MOV"].media_type == "video"
    assert rows["id.heic"].id == "0007b23c-93b8-4d35-a947-6221f6554aeb" and rows["good.jpg"].id is None
    import hashlib

    got = {r.name: r.sha256 for r in media.digests(df).select("name", "sha256").collect()}
    assert got["plain.jpg"] == hashlib.sha256(b"trailing bytes").hexdigest()


def test_streamed_files(spark, tmp_path):
    import hashlib
    import io

    # markers across the ends of reads; results equal those of the whole value
    xmp = b'<x GCamera:MotionPhoto="1" GCamera:MicroVideoOffset="7"/>'
    uuid = b"com.apple.quicktime.content.identifier\x00 0007B23C-93B8-4D35-A947-6221F6554AEB"
    for shift in range(0, 120, 7):
        data = b"." * (4096 - shift) + xmp + b"MotionPhoto_Data" + b"." * 3000 + uuid + b"." * 50
        got = media.scan_stream(io.BytesIO(data), 4096)
        assert got["sha256"] == hashlib.sha256(data).hexdigest() and got["size_bytes"] == len(data) and got["flag"] and got["stated"] == 7
        assert got["samsung_end"] == data.index(b"MotionPhoto_Data") + 16 and got["identifier"] == "0007B23C-93B8-4D35-A947-6221F6554AEB"
    (tmp_path / "a b.jpg").write_bytes(data)
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "ü%20.mov").write_bytes(b"x" * 10)
    rows = {r.path.rpartition("/")[2]: r for r in media.inspect_files(media.scan_tree(spark, str(tmp_path))).collect()}
    assert len(rows) == 3 and all(r.error is None for r in rows.values()), rows
    one = next(r for r in rows.values() if r.size_bytes == len(data))
    assert tuple(one.motion) == ("google", "active", 7) and one.identifier == "0007b23c-93b8-4d35-a947-6221f6554aeb"
    assert next(r for r in rows.values() if r.size_bytes == 0).sha256 == hashlib.sha256(b"").hexdigest()


def test_scan_of_a_tree(spark, tmp_path):
    import os

    (tmp_path / "root/a/b").mkdir(parents=True)
    (tmp_path / "other").mkdir()
    for name in ("root/x.JPG", "root/a/.hidden", "root/a/b/clip 1.MOV", "other/secret.jpg"):
        (tmp_path / name).write_bytes(b"12345" if "x" in name else b"")
    (tmp_path / "root/link").symlink_to(tmp_path / "other")
    (tmp_path / "root/file.jpg").symlink_to(tmp_path / "other/secret.jpg")
    os.utime(tmp_path / "root/x.JPG", ns=(5, 1_600_000_000_123_456_789))
    rows = {r.relative_path: r for r in media.scan_tree(spark, str(tmp_path / "root")).collect()}
    assert set(rows) == {"x.JPG", "a/.hidden", "a/b/clip 1.MOV"}
    x = rows["x.JPG"]
    assert (x.size_bytes, x.mtime_ns, x.extension, x.media_type, x.error) == (5, 1_600_000_000_123_456_789, ".jpg", "image", None) and x.inode == os.stat(tmp_path / "root/x.JPG").st_ino
    assert rows["a/.hidden"].extension == "" and rows["a/b/clip 1.MOV"].media_type == "video"
    gone = media.scan_tree(spark, str(tmp_path / "nowhere")).collect()
    assert len(gone) == 1 and gone[0].error and media.inspect_files(spark.createDataFrame([(str(tmp_path / "nowhere"),)], "path string")).first().error


def test_tool_output(spark):
    probe = '{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":4,"avg_frame_rate":"30000/1001","tags":{"creation_time":"2021-01-01T00:00:00Z"}}],"format":{"duration":"1.5","bit_rate":"x","tags":{"creation_time":"2020-01-02T03:04:05Z"}}}'
    df = spark.createDataFrame([(probe,), ("{}",), ("nonsense",), (None,)], "j string")
    rows = [r.p for r in df.select(media.probe_metadata(F.col("j")).alias("p")).collect()]
    assert (rows[0].captured_at, rows[0].captured_at_source, rows[0].audio_codec, rows[0].bitrate, rows[0].duration_seconds) == ("2020-01-02T03:04:05Z", "video_format_creation_time", "aac", None, 1.5)
    assert all(r.captured_at is None and r.captured_at_source == "none" for r in rows[1:])
    tags = '{"CreateDate":"2021:01:02 03:04:05","DateTimeOriginal":"0000:00:00 00:00:00"}'  # the first that names a real time counts
    df = spark.createDataFrame([(tags, '<x CreateDate="c">', '{"photoTakenTime":{"timestamp":"12"}}')], "a string, b string, c string")
    assert tuple(df.select(media.capture_value(F.col("a")), media.xmp_capture(F.col("b")), media.takeout_micros(F.col("c"))).first()) == ("2021:01:02 03:04:05", "c", 12_000_000)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi"', [1, 2]), (1, "a,b", [])], "id int, text string, ids array<int>")
    reports.write_csv(df, str(tmp_path / "r"), ["id"])
    text = next((tmp_path / "r").glob("part-*.csv")).read_text()
    assert text == 'id,text,ids\n1,"a,b",""\n2,"say ""hi""",1;2\n'
    reports.write_csv(df.limit(0), str(tmp_path / "e"), ["id"])
    assert next((tmp_path / "e").glob("part-*.csv")).read_text() == "id,text,ids\n"


    reports.write_json(df, str(tmp_path / "j"), ["id"])
    assert next((tmp_path / "j").glob("part-*.json")).read_text().splitlines()[0] == '{"id":1,"text":"a,b","ids":[]}'
    reports.write_text(df, str(tmp_path / "t"), "text", ["id"])
    assert next((tmp_path / "t").glob("part-*.txt")).read_text() == 'a,b\nsay "hi"\n'
    reports.write_rows(spark.range(0).select(), str(tmp_path / "n"), [])
    assert next((tmp_path / "n").glob("part-*.csv")).read_text() == "path,status\n"


def test_streaming_inventory(spark, tmp_path):
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    schema = "asset_id long, source_name string, size_bytes long, delivered_at timestamp"
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    deliver = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    deliver([(1, "s", 5, at(0)), (1, "s", 6, at(1)), (2, "s", 1, at(0))])
    df = spark.createDataFrame([], schema)
    start = lambda: streaming.keep_current(streaming.deliveries(spark, source, df.schema), out, check, ["asset_id"], "delivered_at").awaitTermination()
    start()
    deliver([(1, "s", 7, at(2)), (2, "s", 9, at(-5))])
    start()
    got = {r.asset_id: r.size_bytes for r in streaming.current(spark, out, ["asset_id"], "delivered_at").collect()}
    assert got == {1: 7, 2: 1}
    windows = streaming.arrivals_by_window(streaming.deliveries(spark, source, df.schema))
    query = windows.writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r)[1:] for r in spark.sql("select * from arrivals").collect()) == [("s", 1, 9), ("s", 4, 19)]


def tiff(order="<"):
    """A TIFF block with two times, a camera and a position."""
    import struct

    def directory(at, entries, extra_at):
        out, extra = struct.pack(order + "H", len(entries)), b""
        for tag, kind, n, value in entries:
            if len(value) > 4:
                out += struct.pack(order + "HHII", tag, kind, n, extra_at + len(extra))
                extra += value
            else:
                out += struct.pack(order + "HHI", tag, kind, n) + value.ljust(4, b"\0")
        return (out + b"\0" * 4).ljust(extra_at - at, b"\0") + extra

    long, ratio = (lambda v: struct.pack(order + "I", v)), (lambda *v: b"".join(struct.pack(order + "II", *x) for x in v))
    image = directory(8, [(271, 2, 4, b"Ost\0"), (306, 2, 20, b"2020:01:02 03:04:05\0"), (34665, 4, 1, long(200)), (34853, 4, 1, long(300)), (65000, 3, 1, b"\1\0")], 100)
    exif = directory(200, [(36867, 2, 20, b"0000:00:00 00:00:00\0"), (36868, 2, 20, b"2019:05:06 07:08:09\0")], 250)
    gps = directory(300, [(1, 2, 2, b"S\0"), (2, 5, 3, ratio((10, 1), (30, 1), (0, 1))), (3, 2, 2, b"E\0"), (4, 5, 3, ratio((20, 1), (15, 1), (0, 1))), (5, 1, 1, b"\1"), (6, 5, 1, ratio((55, 10)))], 400)
    head = (b"II*\0" if order == "<" else b"MM\0*") + long(8)
    return ((head + image).ljust(200, b"\0") + exif).ljust(300, b"\0") + gps


def test_exif(spark, tmp_path):
    import struct

    from lumenfold.sources.exif import exif_tags, image_metadata

    segment = lambda mark, body: b"\xff" + mark + struct.pack(">H", len(body) + 2) + body
    jpeg = b"\xff\xd8" + segment(b"\xe0", b"JFIF") + segment(b"\xe2", b"x" * 60000) + segment(b"\xe1", b"Exif\0\0" + tiff()) + b"\xff\xda.."
    cases = {"a.jpg": jpeg, "b.tif": tiff(">"), "cut.jpg": jpeg[:60500], "none.jpg": b"\xff\xd8\xff\xda", "text.jpg": b"hello", "empty.jpg": b"", "bad.tif": b"II*\0" + b"\xff" * 20}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rpartition("/")[2]: r for r in image_metadata(media.scan_tree(spark, str(tmp_path))).collect()}
    for name in ("a.jpg", "b.tif"):
        r = rows[name]
        assert (r.make, r.captured_from, r.latitude, r.longitude, r.altitude) == ("Ost", "exif_datetime_digitized", -10.5, 20.25, -5.5), r
        assert r.wall == 1557126489 * 1_000_000 and r.offset is None and r.error is None
    assert len(rows) == len(cases) and all(r.wall is None and r.latitude is None for n, r in rows.items() if n not in ("a.jpg", "b.tif", "cut.jpg"))
    assert exif_tags(b"II*\0") == {}


def test_runs_and_missing_fields(spark):
    plans = spark.createDataFrame([("a", 1, "draft"), ("a", 2, "draft"), ("a", 3, "ready"), ("b", 4, "ready")], "g string, i long, status string")
    assert {r.i: r.status for r in runs.superseded(plans, "g", "i", "status").collect()} == {1: "draft", 2: "superseded", 3: "ready", 4: "ready"}
    rows = spark.createDataFrame([(1, "image", None, 4, 4, "m", "n", 1.0, None, None, None), (2, "video", "t", None, 4, None, None, None, None, None, "h264")],
                                 "asset_id long, media_type string, captured_at string, width long, height long, camera_make string, camera_model string, latitude double, longitude double, duration_seconds double, video_codec string")
    assert {r.asset_id: r.missing for r in inventory.missing_fields(rows, inventory.METADATA).collect()} == {1: "captured_at;gps", 2: "dimensions;duration"}
    seen = spark.createDataFrame([(1, 5, 5, True), (2, 5, 5, False), (3, 6, 5, True)], "asset_id long, obs_size long, obs_mtime long, regular boolean")
    mine = spark.createDataFrame([(1, "a/..", 5, 5), (2, "b", 5, 5), (3, "c", 5, 5), (4, "d", 5, 5), (5, None, 5, 5)], "asset_id long, relative_path string, size_bytes long, mtime_ns long")
    assert {r.asset_id: r.reason for r in inventory.review(mine, seen).collect()} == {1: "unsafe_path", 2: "non_regular_file", 3: "size_changed", 4: "missing", 5: "missing"}
    f = spark.createDataFrame([("g", i, f"v{i}") for i in (1, 999, 1000, 2_000_000)] + [("h", 1, "v1")], "g string, i long, v string")
    one = {r.g: r.fingerprint for r in runs.fingerprints(f, "g", "i", F.col("v")).collect()}
    assert one == {r.g: r.fingerprint for r in runs.fingerprints(f.orderBy(F.desc("i")), "g", "i", F.col("v")).collect()} and one["g"] != one["h"]
