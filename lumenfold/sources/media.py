"""Files and their metadata: inventory scans, digests, markers inside files, sidecars, tool output.

Listings, JSON and sidecars are native expressions, and a scan that does not ask for the content never
reads it. ``inspect_files`` streams whole files of any size, once, for digest and markers together.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.identity import VIDEO_EXTENSIONS, content_identifier
from lumenfold.functions.text import frame_rate, path_name, path_suffix, wall_and_offset
from lumenfold.session import materialise

# Keys and markers written by cameras, in the names of the published metadata schemas.
IDENTIFIER_KEYS = ("com.apple.quicktime.content.identifier", "content.identifier", "assetidentifier", "asset identifier")
SAMSUNG_MARKERS = ("MotionPhoto_Data", "Samsung_Motion_Photo", "SEF\x00")
CAPTURE_KEYS = ("EXIF:DateTimeOriginal", "DateTimeOriginal", "EXIF:CreateDate", "CreateDate", "XMP:DateCreated", "XMP:CreateDate")
XMP_CAPTURE = ("DateTimeOriginal", "DateCreated", "CreateDate")
MOTION_FLAGS = ("GCamera:MotionPhoto", "GCamera:MicroVideo")
OFFSET_KEYS = ("GCamera:MicroVideoOffset", "Item:Length")
#: Bytes read at once, and those of the last read that are looked at again, so that no marker is cut.
CHUNK, OVERLAP = 1 << 20, 1 << 10


def attribute(names: tuple[str, ...], value: str) -> str:
    """The pattern of an XML attribute of one of the names, with one group for its value."""
    return "(?:" + "|".join(names) + ")" + r"\s*=\s*[\"']" + f"({value})" + r"[\"']"


GOOGLE_FLAG = attribute(MOTION_FLAGS, "1")


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, size_bytes, mtime, name, extension, media_type[, content]) of all files below a root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = path_name(F.col("path"))
    suffix = F.lower(path_suffix(name))
    kept = [F.col("content")] if content else []
    return df.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), name.alias("name"),
        suffix.alias("extension"), F.when(suffix.isin(*VIDEO_EXTENSIONS), "video").otherwise("image").alias("media_type"), *kept,
    )


def digests(df: DataFrame) -> DataFrame:
    """The rows with ``sha256`` in place of ``content``; larger files than one value holds go through ``inspect_files``."""
    return df.withColumn("sha256", F.sha2("content", 256)).drop("content")


def _latin(content: Column) -> Column:
    """Bytes as text, one character each, so that offsets are byte offsets."""
    return F.decode(content, "ISO-8859-1")


_MOTION = "struct<kind:string,status:string,offset:bigint>"


def motion_state(size: Column, flag: Column, stated: Column, samsung_end: Column) -> Column:
    """struct(kind, status, offset) of what the markers of a file say; null without one.

    An offset outside the file, or none, is ``invalid``, and so is a marker with nothing after it.
    """
    result = lambda kind, ok, at: F.struct(F.lit(kind).alias("kind"), F.when(ok, "active").otherwise("invalid").alias("status"), at.cast("bigint").alias("offset"))
    google = result("google", F.coalesce((stated > 0) & (stated < size), F.lit(False)), stated)
    samsung = F.when(samsung_end.isNotNull(), result("samsung", samsung_end < size, samsung_end)).otherwise(F.lit(None).cast(_MOTION))
    return F.when(flag | stated.isNotNull(), google).otherwise(samsung)


def motion_photo(content: Column) -> Column:
    """``motion_state`` of a file held as one value; the whole of it is searched."""
    text = _latin(content)
    stated = F.coalesce(*[F.nullif(F.regexp_extract(text, attribute((k,), "[0-9]+"), 1), F.lit("")) for k in OFFSET_KEYS]).try_cast("bigint")
    ends = [F.when(F.instr(text, m) > 0, F.instr(text, m) - 1 + len(m)) for m in SAMSUNG_MARKERS]
    return motion_state(F.length(content), text.rlike(GOOGLE_FLAG), stated, F.coalesce(*ends))


def embedded_identifier(content: Column) -> Column:
    """The content identifier within 512 bytes of a known key, normalised; the whole value is searched."""
    text = _latin(content)
    lower = F.lower(text)
    found = F.lit(None).cast("string")
    for key in reversed(IDENTIFIER_KEYS):
        at = F.instr(lower, key)
        uuid = F.regexp_extract(F.substring(text, at, F.lit(512)), "[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,40}", 0)
        found = F.when((at > 0) & (uuid != ""), content_identifier(uuid)).otherwise(found)
    return found


def scan_stream(stream, chunk: int = CHUNK) -> dict:
    """One pass over a file of any size: its digest, its size and the first of each marker.

    Two reads overlap by ``OVERLAP`` bytes, more than any marker and what belongs to it.
    """
    flag = re.compile(GOOGLE_FLAG.encode())
    offsets = [re.compile(attribute((k,), "[0-9]+").encode()) for k in OFFSET_KEYS]
    keys = [k.encode() for k in IDENTIFIER_KEYS]
    uuid = re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27,40}")
    digest, size, tail = hashlib.sha256(), 0, b""
    flagged, stated, ends, ids = False, [None] * len(offsets), [None] * len(SAMSUNG_MARKERS), [None] * len(keys)
    while data := stream.read(chunk):
        digest.update(data)
        window, begin = tail + data, size - len(tail)
        size += len(data)
        flagged = flagged or flag.search(window) is not None
        for i, p in enumerate(offsets):
            if stated[i] is None and (m := p.search(window)):
                stated[i] = int(m[1])
        for i, marker in enumerate(SAMSUNG_MARKERS):
            if ends[i] is None and (at := window.find(marker.encode())) >= 0:
                ends[i] = begin + at + len(marker)
        low = window.lower()
        for i, key in enumerate(keys):
            if ids[i] is None and (at := low.find(key)) >= 0 and (m := uuid.search(window[at : at + 512])):
                ids[i] = m[0].decode()
        tail = window[-OVERLAP:]
    first = lambda some: next((x for x in some if x is not None), None)
    return {"size_bytes": size, "sha256": digest.hexdigest(), "flag": flagged, "stated": first(stated), "samsung_end": first(ends), "identifier": first(ids)}


def open_file(path: str):
    """A stream of a file named as Spark names it: the name as it is, not as a URI writes it."""
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem().open_input_stream(re.sub("^file:/+", "/", path), compression=None)
    fs, at = pafs.FileSystem.from_uri(quote(path, safe=":/"))
    return fs.open_input_stream(at, compression=None)


def inspect_files(listed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(path, size_bytes, sha256, motion, identifier, error) of the files listed by ``path``.

    The listing reads no content; each file is then streamed by a worker, so its size is no limit.
    A file that cannot be read has an ``error`` and nothing else.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    with open_file(path) as stream:
                        rows.append({"path": path, "error": None, **scan_stream(stream, chunk)})
                except Exception as error:  # noqa: BLE001 any trouble with one file is its own
                    rows.append({"path": path, "error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_pylist(rows, _SCANNED)

    # big files apart from one another: dealt out by path, not as listed
    found = listed.select("path").where("path is not null").repartition("path").mapInArrow(run, "path string, size_bytes long, sha256 string, flag boolean, stated long, samsung_end long, identifier string, error string")
    motion = motion_state(F.col("size_bytes"), F.coalesce("flag", F.lit(False)), F.col("stated"), F.col("samsung_end"))
    return found.select("path", "size_bytes", "sha256", motion.alias("motion"), content_identifier(F.col("identifier")).alias("identifier"), "error")


_LISTED = pa.schema([
    ("path", pa.string()), ("folder", pa.bool_()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()), ("device_id", pa.int64()), ("inode", pa.int64()), ("error", pa.string()),
])


def _list_folders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The regular files and folders in each folder; links are neither, and are not followed."""
    for batch in batches:
        rows = []
        for folder in batch.column("path").to_pylist():
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        path = os.path.join(folder, e.name)
                        try:
                            if e.is_dir(follow_symlinks=False):
                                rows.append({"path": path, "folder": True})
                            elif e.is_file(follow_symlinks=False):
                                s = e.stat(follow_symlinks=False)
                                # inodes are unsigned, and some file systems use all 64 bits
                                inode = s.st_ino - (1 << 64) if s.st_ino >> 63 else s.st_ino
                                rows.append({"path": path, "folder": False, "size_bytes": s.st_size, "mtime_ns": s.st_mtime_ns, "device_id": s.st_dev, "inode": inode})
                        except OSError as error:
                            rows.append({"path": path, "folder": False, "error": str(error)})
            except OSError as error:
                rows.append({"path": folder, "folder": False, "error": str(error)})
        yield pa.RecordBatch.from_pylist(rows, _LISTED)


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative_path, name, extension, media_type, size_bytes, mtime_ns, device_id, inode, error) of all
    regular files below a root that every worker has mounted, empty ones too.

    Folders are listed level by level, each level by all workers; links are not followed, so nothing
    outside the root is reached. What cannot be read is a row with an ``error``.
    """
    root = root.rstrip("/") or "/"
    level, found = spark.createDataFrame([(root,)], "path string"), []
    while True:
        step = materialise(level.repartition("path").mapInArrow(_list_folders, "path string, folder boolean, size_bytes long, mtime_ns long, device_id long, inode long, error string"))
        found.append(step.where("not folder"))
        level = step.where("folder").select("path")
        if level.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, found).drop("folder")
    name = path_name(F.col("path"))
    suffix = F.lower(path_suffix(name))
    return rows.select(
        "path", F.substring("path", F.lit(len(root.rstrip("/")) + 2), F.length("path")).alias("relative_path"), name.alias("name"), suffix.alias("extension"),
        F.when(suffix.isin(*VIDEO_EXTENSIONS), "video").otherwise("image").alias("media_type"), "size_bytes", "mtime_ns", "device_id", "inode", "error",
    )


_SCANNED = pa.schema([
    ("path", pa.string()), ("size_bytes", pa.int64()), ("sha256", pa.string()), ("flag", pa.bool_()), ("stated", pa.int64()),
    ("samsung_end", pa.int64()), ("identifier", pa.string()), ("error", pa.string()),
])


PROBE = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,width:bigint,height:bigint,duration:string,bit_rate:string,"
    "avg_frame_rate:string,color_space:string,tags:struct<creation_time:string>>>,"
    "format:struct<format_name:string,duration:string,bit_rate:string,tags:struct<creation_time:string>>>"
)


def probe_metadata(json: Column) -> Column:
    """struct of the first video and audio stream and the container of ffprobe JSON; blanks count as absent."""
    p = F.from_json(json, PROBE)
    stream = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    video, audio = stream("video"), stream("audio")
    some = lambda c: F.nullif(c, F.lit(""))
    real = lambda c: F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"), c)
    whole, part = real(p["format"]["tags"]["creation_time"]), real(video["tags"]["creation_time"])
    return F.struct(
        F.coalesce(whole, part).alias("captured_at"),
        F.when(whole.isNotNull(), "video_format_creation_time").when(part.isNotNull(), "video_stream_creation_time").otherwise("none").alias("captured_at_source"),
        video["width"].alias("width"), video["height"].alias("height"), video["codec_name"].alias("video_codec"), audio["codec_name"].alias("audio_codec"),
        F.coalesce(some(p["format"]["duration"]), some(video["duration"])).try_cast("double").alias("duration_seconds"),
        F.coalesce(some(p["format"]["bit_rate"]), some(video["bit_rate"])).try_cast("bigint").alias("bitrate"),
        frame_rate(video["avg_frame_rate"]).alias("frame_rate"), p["format"]["format_name"].alias("container_format"), video["color_space"].alias("color_space"),
    )


def capture_value(json: Column, keys: tuple[str, ...] = CAPTURE_KEYS) -> Column:
    """The first capture time of a tool's flat JSON that names a real time, in the fixed order of keys."""
    tags = F.from_json(json, "map<string,string>")
    value = lambda k: F.try_element_at(tags, F.lit(k))
    return F.coalesce(*[F.when(wall_and_offset(value(k))[0].isNotNull(), value(k)) for k in keys])


def xmp_capture(text: Column) -> Column:
    """The first capture time among the attributes of an XMP sidecar."""
    return F.nullif(F.regexp_extract(text, attribute(XMP_CAPTURE, "[^\"']+"), 1), F.lit(""))


def takeout_micros(json: Column) -> Column:
    """Microseconds of the photoTakenTime of an exported sidecar; null if unreadable."""
    return F.get_json_object(json, "$.photoTakenTime.timestamp").try_cast("bigint") * 1_000_000
