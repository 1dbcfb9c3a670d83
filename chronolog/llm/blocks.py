"""Texts as blocks: a dictionary of the distinct words of many texts, and the texts as codes in it.

A task packs the texts it reads into blocks. A block is written as one row per text, which holds the
words' codes in order, and one row per part of its dictionary, whose words are spread over a fixed
number of buckets by hash. So a word that occurs a million times in a block travels once. The table is
bucketed by block: what comes back for the dictionaries meets the texts where they lie, and the texts
never travel. Codes count from the most frequent word, in byte planes that compress well.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from chronolog.llm import spans
from chronolog.llm.shared import arrow_rows, bucketed

#: A block ends after about this many code points; a longer text fills a block alone.
BLOCK = 8 << 20
#: Texts are split in lots of so many code points, so that a worker's arrays stay far smaller than its block.
LOT = 1 << 17
#: Rows of texts that a task is handed at once.
BATCH = 1000
SCHEMA = "block bigint, id string, learn boolean, c0 binary, c1 binary, c2 binary, bucket int, places binary, words binary, counts binary"
ARROW = pa.schema(
    [("block", pa.int64()), ("id", pa.string()), ("learn", pa.bool_())]
    + [(c, pa.binary()) for c in ("c0", "c1", "c2")]
    + [("bucket", pa.int32())]
    + [(c, pa.binary()) for c in ("places", "words", "counts")]
)
Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes; ``unpacked`` gives them back."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    planes = numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + zstandard.ZstdCompressor(3).compress(np.ascontiguousarray(planes.T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), dtype=np.uint8).reshape(blob[0], -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, : blob[0]] = planes.T
    return wide.view("<i8").reshape(-1)


def packed_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), dtype="<u4", count=len(words)).tobytes()
    return zstandard.ZstdCompressor(3).compress(len(words).to_bytes(4, "little") + sizes + b"".join(words))


def unpacked_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=4), dtype=np.int64).tolist()
    body = raw[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def planes(codes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return (
        (codes & 255).astype(np.uint8).tobytes(),
        (codes >> 8 & 255).astype(np.uint8).tobytes(),
        (codes >> 16).astype("<u2").tobytes(),
    )


def joined_planes(c0: bytes, c1: bytes, c2: bytes) -> np.ndarray:
    low, mid, high = np.frombuffer(c0, np.uint8), np.frombuffer(c1, np.uint8), np.frombuffer(c2, "<u2")
    return low.astype(np.int64) | mid.astype(np.int64) << 8 | high.astype(np.int64) << 16


class _Block:
    """The block being filled: the dictionary so far, how often its words occur, and each text's codes."""

    def __init__(self) -> None:
        self.code: dict[bytes, int] = {}
        self.texts: list[tuple[str, bool, np.ndarray]] = []
        self.size = 0
        #: Occurrences by code, in texts to learn from and in others.
        self.times = np.zeros((2, 1 << 12), dtype=np.int64)

    def add(self, ids: list[str], learn: list[bool], texts: list[str], split: Split, lower: bool) -> None:
        for a, b in spans.lots(texts, LOT):
            chars, after = spans.code_points(texts[a:b])
            if lower:
                chars = spans.lowered(chars)
            start, end = split(chars, after)
            code, words = spans.distinct(chars, start, end)
            encoded = (w.encode() for w in words)
            known = np.fromiter((self.code.setdefault(w, len(self.code)) for w in encoded), dtype=np.int32, count=len(words))
            coded = known[code]
            cuts = np.searchsorted(start, after)
            if len(self.code) > self.times.shape[1]:
                self.times = np.pad(self.times, ((0, 0), (0, len(self.code))))
            learnt = np.repeat(np.array(learn[a:b], dtype=bool), np.diff(cuts, prepend=0))
            for side, chosen in enumerate((learnt, ~learnt)):
                self.times[side, known] += np.bincount(code[chosen], minlength=len(words))
            for k, (x, y) in enumerate(zip([0, *cuts], cuts)):
                self.texts.append((ids[a + k], learn[a + k], coded[x:y]))
            self.size += len(chars)

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The rows of the full block, which is empty then."""
        block = uuid.uuid4().int >> 65
        n = len(self.code)
        words = list(self.code)
        self.code = {}
        learnt, total = self.times[0, :n], self.times[:, :n].sum(axis=0)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        for a in range(0, len(self.texts), 2000):
            part = self.texts[a : a + 2000]
            cut = [planes(rank[codes]) for _, _, codes in part]
            m, none = len(part), [None] * len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * m, pa.int64()),
                    pa.array([p[0] for p in part], pa.string()),
                    pa.array([p[1] for p in part], pa.bool_()),
                    *[pa.array([c[k] for c in cut], pa.binary()) for k in range(3)],
                    pa.array(none, pa.int32()),
                    *[pa.array(none, pa.binary())] * 3,
                ],
                schema=ARROW,
            )
        self.texts = []
        where = np.fromiter((zlib.crc32(w) % buckets for w in words), dtype=np.int64, count=n)
        by = np.lexsort((rank, where))
        edges = np.flatnonzero(np.diff(where[by], prepend=-1))
        parts = np.split(by, edges[1:]) if n else []
        m, none = len(parts), [None] * len(parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block] * m, pa.int64()),
                pa.array(none, pa.string()),
                pa.array(none, pa.bool_()),
                *[pa.array(none, pa.binary())] * 3,
                pa.array([int(where[p[0]]) for p in parts], pa.int32()),
                pa.array([packed(np.diff(rank[p], prepend=0)) for p in parts], pa.binary()),
                pa.array([packed_words([words[i] for i in p.tolist()]) for p in parts], pa.binary()),
                pa.array([packed(learnt[p]) for p in parts], pa.binary()),
            ],
            schema=ARROW,
        )


def block_table(texts: DataFrame, split: Split, lower: bool = False) -> DataFrame:
    """``texts(id string, text, learn boolean)`` as a written table of blocks; null texts are empty.

    The number of buckets of a dictionary is four times ``spark.sql.shuffle.partitions``.
    """
    spark = texts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for a in range(0, len(batch), 200):
                ids, texts, learn = (batch.slice(a, 200).column(k).to_pylist() for k in range(3))
                block.add(ids, learn, [t or "" for t in texts], split, lower)
                if block.size >= BLOCK:
                    yield from block.rows(buckets)
                    block = _Block()
        if block.texts:
            yield from block.rows(buckets)

    with arrow_rows(spark, BATCH):
        return bucketed(texts.select("id", "text", "learn").mapInArrow(pack, SCHEMA), "block")


def text_rows(table: DataFrame) -> DataFrame:
    return table.where("bucket IS NULL").select("block", "id", "learn", "c0", "c1", "c2")


def dictionary_rows(table: DataFrame) -> DataFrame:
    return table.where("bucket IS NOT NULL").select("bucket", "block", "places", "words", "counts")
