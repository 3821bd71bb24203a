"""Removal of repeated byte strings by sorted suffixes (deep-shallow sorting).

Equal strings of `length` bytes choose the same anchors: the smallest gram hash among the grams
inside. Only anchors whose gram occurs elsewhere are kept, each with the bytes around it. Suffixes
that start at equal grams are sorted in one group: multikey quicksort to a shallow depth, blind
tries for what still is equal there. So are the reversed bytes before the gram. A node of the left
order shares d bytes before; inside it, neighbours of the right order give the longest match after.
A match of d + r >= length bytes removes these bytes. Every repeated string has an anchor, so
nothing is lost, and all is judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import FACTOR, bit_filter, column, maybe_in, mixed, texts_of, written

GRAM = 32
SHALLOW = 24


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def blind_trie(group: list[int], text: list[bytes]) -> list[int]:
    """Sorts strings that share a long prefix: a search looks at branching bytes only, then one
    comparison with the leaf that it meets tells where the new string branches off."""
    # A leaf is a list of equal strings; a node is [depth, {byte or -1: child}].
    root: list | tuple = [group[0]]

    def byte(k: int, at: int) -> int:
        return text[k][at] if at < len(text[k]) else -1

    for k in group[1:]:
        node = root
        while isinstance(node, tuple):
            node = node[1].get(byte(k, node[0])) or next(iter(node[1].values()))
        same = common_prefix(text[k], text[node[0]])
        if same == len(text[k]) == len(text[node[0]]):
            node.append(k)
            continue
        other = byte(node[0], same)
        parent, edge, node = None, 0, root
        while isinstance(node, tuple) and node[0] < same:
            parent, edge = node, byte(k, node[0])
            node = node[1][edge]
        if isinstance(node, tuple) and node[0] == same:
            node[1][byte(k, same)] = [k]
        else:
            new = (same, {other: node, byte(k, same): [k]})
            if parent is None:
                root = new
            else:
                parent[1][edge] = new
    out: list[int] = []
    stack: list = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(text: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Order of the strings: ternary partitions on 8-byte keys, then blind tries."""
    out: list[int] = []
    stack = [(list(range(len(text))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            out += blind_trie(group, text)
        else:
            keys = [text[k][depth : depth + 8] for k in group]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            parts: tuple[list, list, list] = ([], [], [])
            for k, x in zip(group, keys, strict=True):
                parts[0 if x < pivot else 1 if x == pivot else 2].append(k)
            if parts[2]:
                stack.append((parts[2], depth))
            stack.append((parts[1], depth + 8 if len(pivot) == 8 else 1 << 30))
            if parts[0]:
                stack.append((parts[0], depth))
    return out


def prefixes(order: list[int], text: list[bytes]) -> np.ndarray:
    """Common prefix of each string with the next in order."""
    return np.array([common_prefix(text[a], text[b]) for a, b in zip(order, order[1:], strict=False)], np.int32)


def group_matches(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(k, d, r): element k has d bytes before and r from its gram on equal to another's, d + r >= length.

    lefts are reversed. Together the spans cover all bytes of the element's repeated strings.
    """
    n = len(lefts)
    if n == 2:
        d, r = common_prefix(*lefts), common_prefix(*rights)
        if d + r >= length:
            yield from ((0, d, r), (1, d, r))
        return
    order = deep_shallow(rights)
    lcp = prefixes(order, rights)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    left_order = np.array(deep_shallow(lefts))
    left_lcp = prefixes(left_order.tolist(), lefts)
    most_d, most_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        inner = left_lcp[a : b - 1]
        d = int(inner.min())
        cuts = (np.flatnonzero(inner == d) + a + 1).tolist()
        stack += zip([a, *cuts], [*cuts, b], strict=True)
        members = left_order[a:b]
        members = members[np.argsort(rank[members])]
        at = rank[members]
        if b - a <= 8:
            pair = np.array([common_prefix(rights[x], rights[y]) for x, y in zip(members[:-1], members[1:], strict=True)])
        else:
            pair = np.minimum.reduceat(lcp, at[:-1])
            pair[-1] = lcp[at[-2] : at[-1]].min()
        best = np.maximum(np.append(pair, 0), np.insert(pair, 0, 0))
        hit = best + d >= length
        most_d[members[hit]] = np.maximum(most_d[members[hit]], d)
        most_r[members[hit]] = np.maximum(most_r[members[hit]], best[hit])
    # All matches of an element hold its gram's first byte, so together they are one span.
    for k in np.flatnonzero(most_r).tolist():
        yield k, int(most_d[k]), int(most_r[k])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all GRAM-byte strings, doubled up from single bytes."""
    h, power, width = data.astype(np.uint64) + np.uint64(1), FACTOR, 1
    while width < GRAM:
        h = h[:-width] * power + h[width:]
        power, width = power * power, 2 * width
    return mixed(h)


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): for each `length`-byte string the first smallest gram in it."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    width = length - GRAM + 1
    keys = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    full = -(-len(keys) // width) * width
    blocks = np.full(full, ~np.uint64(0))
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(keys) - width + 1
    at = np.unique(np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, hashes[at]


def keys_of(text: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(text)
    return (x >> 64) - (1 << 63), (x & (2**64 - 1)) - (1 << 63)


def distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """Each text that a task meets, once."""
    met: set[tuple[int, int]] = set()
    for batch in batches:
        for text in texts_of(batch):
            if (key := keys_of(text)) not in met:
                met.add(key)
                yield key, text


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, n_bytes, whole_sha256): 128-bit key of the text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            keys = [keys_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "t1", "t2", "n_bytes", "whole_sha256"],
            )

    return docs.mapInArrow(task, "doc_id long, t1 long, t2 long, n_bytes long, whole_sha256 string")


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(hash, t1, t2, at) of the anchors of each text."""

    def out(rows: list) -> pa.RecordBatch:
        at, hashes = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        t1, t2 = (np.repeat(np.array([r[0][i] for r in rows], np.int64), [len(r[1]) for r in rows]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(t1), pa.array(t2), pa.array(at.astype(np.int32))], names=["hash", "t1", "t2", "at"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, text in distinct_texts(batches):
            rows.append((key, *anchors(text, length)))
            if len(rows) == 2_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    return docs.select("text").mapInArrow(task, "hash long, t1 long, t2 long, at int")


def some_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(t1, t2, text binary): each distinct text whose key may be in keys."""
    seen = docs.sparkSession.sparkContext.broadcast(bit_filter(keys, "t1"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            t1 = np.array([r[0][0] for r in rows], np.int64)
            keep = maybe_in(seen.value, t1)
            return pa.RecordBatch.from_arrays([pa.array(t1), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["t1", "t2", "text"]).filter(pa.array(keep))

        rows, held = [], 0
        for row in distinct_texts(batches):
            rows.append(row)
            held += len(row[1])
            if held > 4 << 20:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)

    return docs.select("text").mapInArrow(task, "t1 long, t2 long, text binary").groupBy("t1", "t2").agg(F.min("text").alias("text"))


def contexts(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """(hash, t1, t2, at, left, right): bytes around each place; left is reversed."""
    reach = length - GRAM
    rows = texts.join(places.groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "hash")).alias("places")), ["t1", "t2"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t1, t2, text, where in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, at, hashes = text.as_py(), where.values.field("at").to_pylist(), where.values.field("hash")
                for s in range(0, len(at), 2_000):
                    some = at[s : s + 2_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            hashes[s : s + 2_000], pa.array([t1.as_py()] * len(some), pa.int64()), pa.array([t2.as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()),
                            pa.array([text[max(0, a - reach) : a][::-1] for a in some], pa.binary()), pa.array([text[a : a + length] for a in some], pa.binary()),
                        ],
                        names=["hash", "t1", "t2", "at", "left", "right"],
                    )

    return rows.select("t1", "t2", "text", "places").mapInArrow(task, "hash long, t1 long, t2 long, at int, left binary, right binary")


def repeated_spans(around: DataFrame, length: int) -> DataFrame:
    """(t1, t2, start, stop) of repeated bytes, not yet merged.

    Places with equal bytes around them are collapsed first, wherever they are, so a passage that
    fills its contexts costs one row of its group however often it occurs; `copies` says it is
    repeated. The groups that are sorted hold different contexts only.
    """
    named = around.withColumn("kind", F.xxhash64("left", "right"))
    kinds = named.groupBy("hash", "kind", "left", "right").agg(F.count("*").alias("copies"))
    cut = kinds.repartition("hash").sortWithinPartitions("hash").select("hash", "kind", "left", "right", "copies")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(key: int, names: list, lefts: list, rights: list, copies: list) -> Iterator[tuple[int, int, int, int]]:
            for k, n in enumerate(copies):
                if n > 1 and len(lefts[k]) + len(rights[k]) >= length:
                    yield key, names[k], len(lefts[k]), len(rights[k])
            if len(lefts) > 1:
                for k, d, r in group_matches(lefts, rights, length):
                    yield key, names[k], d, r

        def out(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["hash", "kind", "d", "r"])

        own, group, rows = None, ([], [], [], []), []
        for batch in batches:
            for key, *row in zip(*(column(batch, c) for c in ("hash", "kind", "left", "right", "copies")), strict=True):
                if key != own:
                    if own is not None:
                        rows += solved(own, *group)
                    own, group = key, ([], [], [], [])
                    if len(rows) > 5_000:
                        yield out(rows)
                        rows = []
                for values, x in zip(group, row, strict=True):
                    values.append(x)
        if own is not None:
            rows += solved(own, *group)
        if rows:
            yield out(rows)

    found = cut.mapInArrow(task, "hash long, kind long, d int, r int")
    rows = named.select("hash", "kind", "t1", "t2", "at").join(found, ["hash", "kind"])
    return rows.select("t1", "t2", (F.col("at") - F.col("d")).alias("start"), (F.col("at") + F.col("r")).alias("stop"))


def without(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(t1, t2, n_removed, n_spans, kept_sha256, kept): texts without the bytes of their spans."""
    rows = texts.join(spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans")), ["t1", "t2"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, kept = [], [], []
            for text, spans in zip(column(batch, "text"), column(batch, "spans"), strict=True):
                parts, at, n, end = [], 0, 0, -1
                for s in spans:
                    start, stop = s["start"], s["stop"]
                    n += start > end
                    if start > at:
                        parts.append(text[at:start])
                    at, end = max(at, stop), max(end, stop)
                parts.append(text[at:])
                kept.append(b"".join(parts))
                removed.append(len(text) - len(kept[-1]))
                runs.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t1"), batch.column("t2"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
                names=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rows.select("t1", "t2", "text", "spans").mapInArrow(task, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def removed(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text).

    Null is empty; texts under `length` bytes keep all. A text that is there twice goes whole.
    Repeated rows are documents of their own; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(text_rows(docs), "texts")
    copies = rows.groupBy("t1", "t2").agg(F.count("*").alias("copies")).where("copies > 1")
    marks = written(anchor_rows(docs, length), "anchors")
    place = F.struct("t1", "t2", "at")
    again = marks.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").select("hash")
    places = written(marks.join(again, "hash"), "places")
    around = written(contexts(some_texts(docs, places), places, length), "contexts")
    spans = written(repeated_spans(around, length), "spans")
    cut = without(some_texts(docs, spans), spans).drop("kept")
    out = rows.join(cut, ["t1", "t2"], "left").join(copies, ["t1", "t2"], "left")
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )
