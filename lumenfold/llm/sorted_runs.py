"""Sorted runs on the shared folder: tables sorted by a 62-bit ``key``, in range-partitioned files.

The bounds of each file are in its footer. A search deals its ranges out to the files they fall into,
and a worker reads only the row groups a range touches: what is searched is never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a file at most (about), and bytes a row group.
ROWS_A_FILE = 1 << 20
GROUP_BYTES = 4 << 20
#: Rows a worker emits at once.
EMITTED = 1 << 17
#: Ranges for one file are dealt out to so many tasks.
SALT = 4


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def delete(path: str) -> None:
    fs, at = file_system(path)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        fs.delete_dir(at)


def folders(path: str, column: str) -> list[int]:
    """The values of the integer column by which a table was partitioned when written."""
    fs, at = file_system(path)
    found = [f.base_name for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.Directory]
    return [int(n.split("=")[1]) for n in found if re.fullmatch(rf"{column}=-?\d+", n)]


def rows_of(path: str, column: str | None = None) -> int:
    """Rows of a written table, of a column those that are not null; from the footers alone."""
    fs, at = file_system(path)
    total = 0
    for file in _files(fs, at):
        meta = pq.read_metadata(file, filesystem=fs)
        total += meta.num_rows
        if column is not None:
            k = meta.schema.names.index(column)
            total -= sum(meta.row_group(g).column(k).statistics.null_count for g in range(meta.num_row_groups))
    return total


def _files(fs: pafs.FileSystem, at: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet"))


def write_sorted(df: DataFrame, path: str, rows: int, *ties: str) -> None:
    """Write ``df`` sorted by (key, ties) into files of disjoint ranges; rows of one key may span files."""
    parts = -(-rows // ROWS_A_FILE)
    df = df.repartition(1) if parts <= 1 else df.repartitionByRange(parts, "key", *ties)
    df.sortWithinPartitions("key", *ties).write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def index_of(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(files, least keys, greatest keys) in order of the ranges."""
    fs, at = file_system(path)
    out = []
    for file in _files(fs, at):
        meta = pq.read_metadata(file, filesystem=fs)
        if meta.num_rows:
            k = meta.schema.names.index("key")
            stats = [meta.row_group(g).column(k).statistics for g in range(meta.num_row_groups)]
            out.append((min(s.min for s in stats), max(s.max for s in stats), file))
    out.sort()
    return [o[2] for o in out], np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)


def assign(lo: np.ndarray, hi: np.ndarray, mins: np.ndarray, maxs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, file): the files each inclusive range falls into."""
    first, last = np.searchsorted(maxs, lo, "left"), np.searchsorted(mins, hi, "right")
    n = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(lo)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def search(ranges: DataFrame, folder: str, runs: dict[int, tuple], carry: list[str], payload: list[str], schema: str) -> DataFrame:
    """Rows of sorted runs within ranges: ``run``, the carried columns and the payload of each row found.

    ``ranges``: run, file, lo, hi (inclusive) and the carried columns, see ``assign``. ``schema`` is
    that of (run, *carry, *payload). Only the ranges are shuffled; each file goes to ``SALT`` tasks,
    so that many ranges in one file are no one task's work. A task goes through its ranges in order of
    ``lo`` alone, one number to sort by, and so through each of its files in order.
    """
    names = {r: files for r, (files, _, _) in runs.items()}
    columns = ["run", "file", "lo", "hi", *carry]
    dealt = ranges.select(*columns).repartition("run", "file", F.pmod(F.xxhash64(*carry), F.lit(SALT))).sortWithinPartitions("lo")
    return dealt.mapInArrow(_reader(folder, names, carry, payload), schema)


def _reader(folder: str, names: dict[int, list[str]], carry: list[str], payload: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        kept: dict[tuple[str, int], pa.Table] = {}

        def group(file: pq.ParquetFile, path: str, g: int) -> pa.Table:
            if (path, g) not in kept:
                if len(kept) >= max(4, 2 * len(names)):
                    kept.pop(next(iter(kept)))
                kept[path, g] = file.read_row_group(g, columns=list(dict.fromkeys(["key", *payload])))
            return kept[path, g]

        opened: dict[str, pq.ParquetFile] = {}

        def file_at(path: str) -> pq.ParquetFile:
            if path not in opened:
                if len(opened) >= max(4, 2 * len(names)):
                    opened.pop(next(iter(opened)))
                opened[path] = pq.ParquetFile(path, filesystem=fs)
            return opened[path]

        for batch in batches:
            order = np.lexsort([batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "run")])  # stable: by lo in each file
            batch = batch.take(pa.array(order))
            run_, file_, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("run", "file", "lo", "hi"))
            if not len(run_):
                continue
            cuts = [0, *(np.flatnonzero((np.diff(run_) != 0) | (np.diff(file_) != 0)) + 1).tolist(), len(run_)]
            for a, b in zip(cuts, cuts[1:]):
                path = names[int(run_[a])][int(file_[a])]
                file = file_at(path)
                meta = file.metadata
                k = meta.schema.names.index("key")
                for g in range(meta.num_row_groups):
                    stats = meta.row_group(g).column(k).statistics
                    hit = a + np.flatnonzero((lo[a:b] <= stats.max) & (hi[a:b] >= stats.min))
                    if not len(hit):
                        continue
                    table = group(file, path, g)
                    keys = table.column("key").to_numpy()
                    i, j = np.searchsorted(keys, lo[hit], "left"), np.searchsorted(keys, hi[hit], "right")
                    yield from _emit(batch, table, hit, i, j - i, carry, payload)

    return run


def _emit(batch: pa.RecordBatch, table: pa.Table, hit: np.ndarray, begin: np.ndarray, n: np.ndarray, carry: list[str], payload: list[str]) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(n)
    total = int(ends[-1])
    for a in range(0, total, EMITTED):
        place = np.arange(a, min(total, a + EMITTED))
        owner = np.searchsorted(ends, place, "right")
        rows = pa.array(begin[owner] + place - (ends[owner] - n[owner]))
        entry = pa.array(hit[owner])
        out = [batch.column(c).take(entry) for c in ("run", *carry)]
        for c in payload:
            column = table.column(c).take(rows)
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            out.append(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        yield pa.RecordBatch.from_arrays(out, names=["run", *carry, *payload])
