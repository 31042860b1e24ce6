"""Encoding of the whole corpus with a public tokenizer (problem 6).

A sentencepiece BPE model is serialised straight from the byte-level vocabulary: each piece is a
token's bytes mapped to printable characters, its score the negative rank, with identity
normalisation. Merging by best score then equals merging by lowest rank. Texts are cut into
pre-tokens by array operations on the code points of a whole Arrow batch; the distinct pre-tokens
of a batch are encoded once by the model and the ids gathered back by index. Decoding goes the
mapping backwards.

Null and empty texts have the empty list of ids. Strings of special tokens are ordinary text.
Texts of any length are encoded whole; a batch is cut between texts into parts of bounded size,
so the memory of a task is bound by ``PART_BYTES`` and the longest single text.
"""

from __future__ import annotations

import base64
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PART_BYTES = 4 << 20
#: Distinct pre-tokens a worker remembers; it then starts afresh (they are only encoded again).
REMEMBERED = 1_000_000

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
# The white space of the Unicode standard.
_WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The tokens in order of rank from a file of base64 tokens and ranks."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [r for r, _ in tokens] != list(range(len(tokens))):
        raise ValueError("the ranks of a vocabulary must be 0, 1, 2, ...")
    return [t for _, t in tokens]


@lru_cache(1)
def byte_characters() -> str:
    """A printable character for each byte: printable Latin-1 stands for itself, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(spare)) for b in range(256))


def _field(number: int, payload: bytes | int | float) -> bytes:
    """One protobuf field: bytes length-delimited, floats as 32 bits, ints as varints."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while True:
            out.append((n & 127) | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    if isinstance(payload, bytes):
        return varint(number << 3 | 2) + varint(len(payload)) + payload
    if isinstance(payload, float):
        return varint(number << 3 | 5) + struct.pack("<f", payload)
    return varint(number << 3) + varint(payload)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model (the protobuf of its public schema) of a byte-level BPE vocabulary."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-rank)) + _field(3, normal))
        for rank, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    off = (1 << 64) - 1  # -1 as a varint: the model has no such token
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, off) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    table[list(_WHITE)] = _SPACE
    return table


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for the code points of texts laid end to end.

    Runs of letters, of numbers and of other signs are pre-tokens, with one space before them; of
    white space before a run the last character is left to it (a space) or stands alone; the
    endings 's 'd 'm 't 'll 've 're are pre-tokens where their apostrophe begins one.
    """
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 4, bool)
    first[text_starts] = True
    first[n:] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 32]] = False
    marks = np.flatnonzero((points == 39) & start[:n])
    if len(marks):
        padded = np.concatenate([points, np.zeros(4, points.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        in1, in2 = ~first[marks + 1], ~first[marks + 1] & ~first[marks + 2]
        short = in1 & np.isin(one, [ord(c) for c in "sdmt"])
        pair = one.astype(np.int64) << 32 | two
        long = in2 & np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("ll", "ve", "re")])
        start[marks[short | long] + 1] = False
        start[marks[short] + 2] = True
        start[marks[long] + 2] = False
        start[marks[long] + 3] = True
    return start[:n]


class Encoder:
    """Encodes Arrow string arrays; made in each worker from the serialised model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known: dict[bytes, np.ndarray] = {}
        self.map = {b: c for b, c in enumerate(byte_characters())}

    def _ids(self, pieces: list[bytes]) -> list[np.ndarray]:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = pieces
        if new:
            mapped = [p.decode("latin-1").translate(self.map) for p in new]
            self.known.update(zip(new, (np.array(x, np.int32) for x in self.model.encode(mapped, out_type=int, num_threads=1))))
        return [self.known[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if not len(data):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            at, text_at = None, ends
        else:
            at = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
            text_at = np.searchsorted(at, ends)
        starts = np.flatnonzero(token_starts(points, text_at[:-1][ends[:-1] < ends[1:]]))
        offsets = np.append(starts if at is None else at[starts], len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, begins = np.concatenate(ids), np.cumsum(sizes) - sizes
        which = words.indices.to_numpy()
        lengths = sizes[which]
        ends_of = np.cumsum(lengths)
        out = flat[np.repeat(begins[which] - (ends_of - lengths), lengths) + np.arange(ends_of[-1])]
        return np.append(0, ends_of)[np.searchsorted(offsets[:-1], ends)], out


def parts(batch: pa.RecordBatch, column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows into parts of about ``most`` bytes of text."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _encoding(model: bytes, text: str, finish: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for part in parts(batch, text):
                offsets, ids = encoder.encode(part.column(text))
                others = [part.column(i) for i, n in enumerate(part.schema.names) if n != text]
                names = [n for n in part.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*others, finish(offsets, ids)], names=[*names, "result"])

    return run


def encode_texts(df: DataFrame, text: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``out`` (array of int ids) in place of ``text``. All other columns pass through."""
    model = serialise_model(read_vocabulary(vocabulary))
    finish = lambda offsets, ids: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
    return _apply(df, text, out, "array<int>", model, finish)


def count_tokens(df: DataFrame, text: str, out: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``out`` (the number of ids) in place of ``text``."""
    model = serialise_model(read_vocabulary(vocabulary))
    return _apply(df, text, out, "bigint", model, lambda offsets, ids: pa.array(np.diff(offsets)))


def _apply(df: DataFrame, text: str, out: str, kind: str, model: bytes, finish: Callable) -> DataFrame:
    others = [c for c in df.columns if c != text]
    # own names inside, so that columns may have any names
    inner = df.select(*[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)], df[f"`{text}`"].alias("text"))
    schema = ", ".join([*(f"c{i} {inner.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(others))), f"result {kind}"])
    done = inner.mapInArrow(_encoding(model, "text", finish), schema)
    return done.toDF(*others, out)


def decode_ids(ids: Iterable[int], tokens: list[bytes]) -> str:
    """The text of a list of ids: pieces back to bytes, bytes to text."""
    return b"".join(tokens[i] for i in ids).decode("utf-8")
