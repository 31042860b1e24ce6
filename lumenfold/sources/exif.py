"""EXIF of JPEG and TIFF files, by the published TIFF structure; no image is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import altitude, exif_capture, gps_degrees
from lumenfold.sources.media import open_file

# EXIF tags by number, of the image, its EXIF and its GPS directories.
IMAGE = {271: "make", 272: "model", 306: "t306", 256: "width", 257: "height", 34665: "exif", 34853: "gps"}
EXIF = {36867: "t36867", 36868: "t36868", 40962: "width", 40963: "height"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt"}
#: Bytes of one value, by type: byte, text, short, long, ratio, and the signed ones.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
_FORMS = {1: "B", 3: "H", 4: "I", 9: "i"}
#: Entries of a directory at most: their number has 16 bits, so this leaves out nothing.
_ENTRIES = 1 << 16


def find_tiff(stream) -> bytes | None:
    """The TIFF block of a file: that of a JPEG's EXIF segment, found by walking its segments, or the file itself."""
    head = stream.read(4)
    if head[:4] in (b"II*\0", b"MM\0*"):
        return head + stream.read()
    if head[:2] != b"\xff\xd8":
        return None
    pending = head[2:]
    while True:
        pending += stream.read(4 - len(pending))
        if len(pending) < 4 or pending[0] != 0xFF or pending[1] in (0xDA, 0xD9):
            return None
        if pending[1] == 0xFF:  # a fill byte
            pending = pending[1:]
            continue
        body = stream.read(max(0, struct.unpack(">H", pending[2:4])[0] - 2))
        if pending[1] == 0xE1 and body[:6] == b"Exif\0\0":
            return body[6:]
        pending = b""


def _directory(data: bytes, at: int, order: str, names: dict[int, str]) -> dict:
    out = {}
    count = struct.unpack_from(order + "H", data, at)[0]
    for i in range(min(count, _ENTRIES)):
        place = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(order + "HHI", data, place)
        if tag not in names or kind not in SIZES:
            continue
        size = n * SIZES[kind]
        where = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if where + size > len(data):
            continue
        if kind in (2, 7):
            value = data[where : where + size].split(b"\0")[0].decode("utf-8", "replace").strip() or None
        elif kind in (5, 10):
            pairs = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", data, where)
            value = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2])]
        else:
            value = list(struct.unpack_from(f"{order}{n}{_FORMS[kind]}", data, where))
        out[names[tag]] = value if isinstance(value, str) or value is None or len(value) != 1 else value[0]
    return out


def exif_tags(data: bytes) -> dict:
    """The known tags of a TIFF block; a damaged directory has none."""
    order = "<" if data[:2] == b"II" else ">"
    out: dict = {}
    try:
        out = _directory(data, struct.unpack_from(order + "I", data, 4)[0], order, IMAGE)
        for pointer, names in (("exif", EXIF), ("gps", GPS)):
            if isinstance(out.get(pointer), int):
                try:
                    out |= _directory(data, out[pointer], order, names)
                except struct.error:
                    continue
    except struct.error:
        pass
    return out


_READ = pa.schema([
    ("path", pa.string()), *[(c, pa.string()) for c in ("make", "model", "t306", "t36867", "t36868", "lat_ref", "lon_ref")], ("width", pa.int64()), ("height", pa.int64()),
    ("lat", pa.list_(pa.float64())), ("lon", pa.list_(pa.float64())), ("alt", pa.float64()), ("alt_ref", pa.int64()), ("error", pa.string()),
])
_SCHEMA = (
    "path string, make string, model string, t306 string, t36867 string, t36868 string, lat_ref string, lon_ref string, width long, height long,"
    " lat array<double>, lon array<double>, alt double, alt_ref long, error string"
)


def _row(path: str) -> dict:
    try:
        with open_file(path) as stream:
            data = find_tiff(stream)
    except Exception as error:  # noqa: BLE001 any trouble with one file is its own
        return {"path": path, "error": f"{type(error).__name__}: {error}"}
    tags = exif_tags(data) if data else {}
    fits = lambda name, v: isinstance(v, {"string": str, "int64": int, "double": float, "list<item: double>": list, "list<element: double>": list}.get(str(_READ.field(name).type), object))
    return {"path": path, **{k: v for k, v in tags.items() if k in _READ.names and fits(k, v)}}


def image_metadata(listed: DataFrame) -> DataFrame:
    """(path, make, model, width, height, wall, offset, captured_from, latitude, longitude, altitude, error) of files.

    The time is the first valid one of the three EXIF tags. A position counts only if both degrees
    are readable and in range. Files without EXIF have nulls.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_row(p) for p in batch.column("path").to_pylist()], _READ)

    rows = listed.select("path").where("path is not null").repartition("path").mapInArrow(run, _SCHEMA)
    when = exif_capture({36867: F.col("t36867"), 36868: F.col("t36868"), 306: F.col("t306")})
    degrees = lambda c, most: gps_degrees(F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2)), F.col(f"{c}_ref"), most)
    lat, lon = degrees("lat", 90.0), degrees("lon", 180.0)
    both = lat.isNotNull() & lon.isNotNull()
    return rows.withColumn("w", when).select(
        "path", "make", "model", "width", "height", "w.wall", "w.offset", F.col("w.source").alias("captured_from"), F.when(both, lat).alias("latitude"), F.when(both, lon).alias("longitude"),
        altitude(F.col("alt"), F.coalesce("alt_ref", F.lit(0))).alias("altitude"), "error",
    )
