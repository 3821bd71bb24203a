"""Helpers shared by the operators: written tables, word hashes, bit filters, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", f"file://{found}")
    return f"file://{found}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder; cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(batch: pa.RecordBatch | pa.Table, name: str) -> list:
    return batch.column(name).to_pylist()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def rows_out(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit words spread evenly (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd factor of the polynomial hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


#: Words up to LONG bytes are hashed from sums over PIECE bytes of text, longer ones by themselves.
LONG, PIECE = 64, 1 << 16
SPACES = b" \t\n\v\f\r"
IN_WORD = np.isin(np.arange(256), list(SPACES), invert=True)
#: A random 64-bit value for each byte, A-Z as a-z.
BYTE_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]).lower()) for b in range(256)], np.uint64)
POWERS = np.cumprod(np.append(np.uint64(1), np.full(PIECE + LONG, FACTOR)))
INVERSE = np.cumprod(np.append(np.uint64(1), np.full(PIECE, pow(int(FACTOR), -1, 1 << 64), np.uint64)))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, 64-bit hashes) of the words of data, A-Z lower-cased. data begins and ends with a space.

    A word's hash is the sum of its bytes' values times powers of FACTOR: a difference of two running
    sums, moved to power 0.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edges[::2], edges[1::2]
    out = np.empty(len(start), np.uint64)
    size = np.minimum(stop - start, LONG)
    for at in range(0, len(raw), PIECE):
        s, e = np.searchsorted(start, (at, at + PIECE)).tolist()
        if s < e:
            values = BYTE_VALUES[raw[at : at + PIECE + LONG]]
            values *= POWERS[: len(values)]
            sums = np.append(np.uint64(0), np.cumsum(values))
            first = start[s:e] - at
            out[s:e] = (sums[first + size[s:e]] - sums[first]) * INVERSE[first]
    for k in np.flatnonzero(stop - start > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : stop[k]].lower())
    return start, mixed(out)


def shingle_sets(texts: list[bytes], n: int = 5, most_bytes: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, sizes) of runs of texts: each text's sorted distinct 64-bit hashes of n-word shingles, one
    after the other, and how many each text has. A text with fewer words is one shingle."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most_bytes)))
        yield _sets(texts[first:last], n)
        first = last


def _sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    starts, h = word_hashes(b" " + b" ".join(texts) + b" ")
    cuts = np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts]))
    first, words = cuts[:-1], np.diff(cuts)
    sizes = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    begin = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint64)
    for k in range(1, n + 1):
        some = np.flatnonzero(words == k if k < n else words >= n)
        if len(some):
            to = spread(begin[some], sizes[some])
            at = spread(first[some], sizes[some])
            x = h[at]
            for i in range(1, k):
                x = x * FACTOR + h[at + i]
            out[to] = mixed(x + np.uint64(k))
    for a, b in zip(begin.tolist(), (begin + sizes).tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[sizes > 0]] = True
    return out[new], sums_of(new, sizes)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def sums_of(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of so many values, 64 bits wide; an empty run has 0."""
    kind = np.uint64 if values.dtype == np.uint64 else np.int64
    out = np.zeros(len(sizes), kind)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], dtype=kind)
    return out


def filter_bits(keys: int) -> int:
    """Bits of a filter for so many keys, 16 each: 1 MB to 64 MB. Beyond some 30 million keys it lets more
    rows through to the join."""
    return 1 << min(29, max(23, (16 * keys - 1).bit_length()))


def bit_filter(ids: DataFrame, key: str, bits: int = 1 << 23) -> np.ndarray:
    """A Bloom filter of fixed size (two bits a key) over a long column, as packed bytes.

    It only thins out rows before a join: saturation costs time, never results.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for bit in _bits(batch.column(0).drop_null().to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(seen, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at].view(np.int64))], names=["at", "word"])

    rows = (
        ids.select(F.col(key).cast("long")).mapInArrow(partial, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    ).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("word").to_numpy().view(np.uint64)
    return out


def _bits(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(values.astype(np.int64).view(np.uint64))
    low = np.uint64(bits - 1)  # bits is a power of two
    return x & low, (x >> np.uint64(32)) & low


def maybe_in(seen: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    for bit in _bits(values, len(seen) * 64):
        out &= (seen[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one partition: an edge from each node to its smallest."""
    up: dict = {}

    def root(x):
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    names = ["a", "b"]
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(column(batch, "a"), column(batch, "b"), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=names)


def components(edges: DataFrame, kind: str = "long", most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b); component is the smallest node.

    Distributed union-find: each partition joins its own edges, then rounds of large and small
    stars (aggregate, join back) shrink the forest. A hot node is pre-aggregated for its minimum
    and its join can be split. Each round is written to the shared folder. Nulls are left out.
    """
    now = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).where("a != b").mapInArrow(_local_forest, f"a {kind}, b {kind}")
    now = written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = written(small.where("a != b").distinct(), "edges")
        # A star forest: nobody is both a member and a root, and each member has one root.
        open_ends = new.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        done = open_ends.where("n > 1").isEmpty() and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        now = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
