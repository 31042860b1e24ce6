"""Order-dependent pairing inside one key, on rows streamed in order of the key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

_OUT = pa.schema([("status", pa.string()), ("primary_id", pa.int64()), ("secondary_id", pa.int64()), ("candidates", pa.int64())])
_NEAR = 3_000_000


def _close(a: tuple, b: tuple) -> bool:
    """Times within 3 s by instant or wall clock, or unknown on a side; (wall, offset) each."""
    if a[0] is None or b[0] is None:
        return True
    if a[1] is not None and b[1] is not None and abs((a[0] - a[1] * 1_000_000) - (b[0] - b[1] * 1_000_000)) <= _NEAR:
        return True
    return abs(a[0] - b[0]) <= _NEAR


def _pair(images: list[tuple], videos: dict[int, tuple]) -> Iterator[tuple]:
    """Images in order; each takes its only free close video, several are ambiguous. All are near one another in folder."""
    for ident, when in images:
        near = [v for v, at in videos.items() if _close(when, at)]
        if len(near) == 1:
            yield "active", ident, near[0], 1
            del videos[near[0]]
        elif near:
            yield "ambiguous", ident, None, len(near)


def greedy(keys: list[str]):
    """Pairs of rows sorted by (keys, absolute_path); only the rows of one key are held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, images, videos = None, [], {}
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*keys, "asset_id", "kind", "wall", "off")]
            for *key, ident, kind, wall, off in zip(*columns):
                if key != at:
                    out += _pair(images, videos)
                    at, images, videos = key, [], {}
                if kind == "video":
                    videos[ident] = (wall, off)
                else:
                    images.append((ident, (wall, off)))
            yield _batch(out)
        yield _batch(list(_pair(images, videos)))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r)) for r in rows], _OUT)
