"""Blocks of documents as word numbers plus the block's own word list.

A block is what one task reads (up to a size). Words travel once per block instead of once per
occurrence, so a word in every document costs a word per block. A block's words are dealt into
buckets by hash; where the rows of a bucket meet, each distinct word is handled once and the
results are joined back to every row. Positions travel as the sequence of word numbers of a
document, byte plane by byte plane, compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "block long, bucket int, words binary, counts binary, ids array<long>, flags array<boolean>, lengths array<int>, numbers binary"
SCHEMA = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("numbers", pa.binary()),
])


class Numbers:
    """Word numbers of a block, in order of first use."""

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            n = self[word] = len(self)
            return n

    def __init__(self):
        self.known: dict[bytes, int] = self.Known()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words))


def squeezed(numbers: np.ndarray) -> bytes:
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def packed_bytes(values: list[bytes]) -> bytes:
    """A list of byte strings, compressed: count, lengths, bytes."""
    sizes = np.array([len(v) for v in values], "<u4")
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(values)], "<u4").tobytes() + sizes.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(values))


def unpacked_bytes(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n).T).view("<u4").reshape(-1)
    ends = (np.cumsum(sizes, dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def in_blocks(docs: DataFrame, numbering: Callable[[], tuple[Numbers, Callable[[str], np.ndarray]]], counted: Callable[[int | None], bool] = lambda _: True, most_bytes: int = 64 << 20) -> DataFrame:
    """docs (doc_id, text) as rows of BLOCKS: rows with words (bucket set), rows with documents.

    numbering() gives a fresh pair (Numbers, text -> word numbers) for each block. counts hold the
    occurrences in documents whose id is `counted`, which is kept as their flag.
    """
    buckets = min(16_384, max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        own: tuple = ()
        size, counts = 0, np.zeros(0, np.int64)

        def rows(values: list[dict]) -> pa.RecordBatch:
            none = dict.fromkeys(SCHEMA.names)
            return pa.RecordBatch.from_pylist([none | {"block": (part << 24) + block} | v for v in values], SCHEMA)

        def closed() -> pa.RecordBatch:
            words = list(own[0].known)
            bucket = np.array([xxhash.xxh32_intdigest(w) for w in words], np.uint32) % buckets
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            out = []
            for at in np.split(order, cuts) if words else []:
                out.append({"bucket": int(bucket[at[0]]), "words": packed_bytes([words[k] for k in at.tolist()]), "counts": squeezed(counts[at]), "numbers": squeezed(np.diff(at, prepend=0))})
            return rows(out)

        for batch in batches:
            docs_, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(docs_), 256):
                if not own:
                    own, size, counts = numbering(), 0, np.zeros(0, np.int64)
                chunk = [own[1](t or "") for t in texts[at : at + 256]]
                ids = docs_[at : at + 256]
                flags = [bool(counted(i)) for i in ids]
                counts = np.append(counts, np.zeros(len(own[0].known) - len(counts), np.int64))
                seen = [c for c, f in zip(chunk, flags, strict=True) if f]
                if seen and (joined := np.concatenate(seen)).size:
                    counts += np.bincount(joined, minlength=len(counts))
                yield rows([{"ids": ids, "flags": flags, "lengths": [len(c) for c in chunk], "numbers": squeezed(np.concatenate(chunk))}])
                size += sum(len(t or "") for t in texts[at : at + 256])
                if size >= most_bytes:
                    yield closed()
                    own, block = (), block + 1
        if own:
            yield closed()

    return docs.select("doc_id", "text").mapInArrow(task, BLOCKS)


def by_bucket(blocks: DataFrame, solve: Callable[[int, list[tuple[list[bytes], np.ndarray]]], tuple[list[bytes], bytes | None]]) -> DataFrame:
    """(block, bucket, payload): solve(bucket, rows of words with counts) gives a payload for each
    row; and one for the whole bucket, which goes out with a null block."""

    def words_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch.column("bucket").is_valid()).select(["block", "bucket", "words", "counts"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            each, whole = solve(bucket, [(unpacked_bytes(w), opened(c)) for _, w, c in held])
            names = [h[0] for h in held] + [None] * (whole is not None)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([bucket] * len(names), pa.int32()), pa.array(each + [whole] * (whole is not None), pa.binary())], names=["block", "bucket", "payload"])

        own, held = None, []
        for batch in batches:
            for block, bucket, words, counts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != own:
                    if held:
                        yield out(own, held)
                    own, held = bucket, []
                held.append((block, words, counts))
        if held:
            yield out(own, held)

    rows = blocks.mapInArrow(words_only, "block long, bucket int, words binary, counts binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(task, "block long, bucket int, payload binary")


def numbered(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
    """(word numbers, packed words, payload) of the buckets of one block."""
    payloads = dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
    for bucket, words, numbers in zip(*(left.column(c) for c in ("bucket", "words", "numbers")), strict=True):
        if bucket.is_valid:
            yield np.cumsum(opened(numbers.as_py()), dtype=np.uint32), words.as_py(), payloads[bucket.as_py()]


def documents_of(left: pa.Table) -> Iterator[tuple[int | None, bool, np.ndarray]]:
    """(doc_id, flag, word numbers) of the documents of one block."""
    for bucket, ids, flags, lengths, numbers in zip(*(left.column(c) for c in ("bucket", "ids", "flags", "lengths", "numbers")), strict=True):
        if not bucket.is_valid:
            parts = np.split(opened(numbers.as_py()), np.cumsum(lengths.as_py())[:-1])
            yield from zip(ids.as_py(), flags.as_py(), parts, strict=True)


def assembled(blocks: DataFrame, payloads: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """function(rows of a block, its payloads) for each block."""
    return blocks.groupBy("block").cogroup(payloads.where(F.col("block").isNotNull()).groupBy("block")).applyInArrow(function, schema)
