"""Fuzzy line dedup over a whole corpus by MinHash.

Each distinct line of a task gets a signature of its character shingles (one hash a shingle, dealt
to bins, the least of each bin) and band keys. Only bands that several lines share are kept. A line
is paired with the band's first line and with the line before, which is linear in a band's size.
Pairs are verified by the exact Jaccard similarity of the lines' shingles, links are joined by
distributed union-find. Then bands whose lines are in several components are read once more, with
the lines' texts: a task counts the shingles that each line shares with the lines before it, and
only the links that join components leave it. Of each component one line stays: the first by
(doc_id, line number).

Joins are merge joins at every size: no side of them has a bound that would allow a broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import FACTOR, bit_filter, column, components, maybe_in, mixed, texts_of, written
from logsluice.llm.jaccard import groups

#: A link of similarity 0.75 meets in no band with (1 - 0.75^4)^16 = 0.0023 if hashes are independent.
SHINGLE, BANDS, ROWS = 8, 16, 4
#: A band of more lines is read as pairs of parts of so many.
PART = 20_000
#: Text bytes that are hashed at once (so that arrays stay in a core's cache), band rows that a task
#: holds, text bytes of a bucket of bands.
CHUNK, HELD, BUCKET = 256 << 10, 4 << 20, 32 << 20
#: Lines times shingles of a band that are compared as one table.
DENSE = 4 << 20
#: An empty bin of a signature looks at the others fewer times than this.
TRIES = 400
#: Lines link at UP * intersection >= DOWN * union.
UP, DOWN = 100, 75


def key_of(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def short_key(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def worded(text: bytes) -> list[tuple[int, bytes]]:
    """(number, line) of the lines that have a word."""
    return [(i, x) for i, x in enumerate(text.split(b"\n")) if x and not x.isspace()]


def characters(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines in a row, and their starts."""
    points = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4")
    return points, np.concatenate([[0], np.cumsum([len(x) for x in lines], dtype=np.int64)])


def shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, owner): all character shingles of the lines; shorter lines are one shingle."""
    points, start = characters([x.decode().ljust(SHINGLE, "\0") for x in lines])
    h = np.zeros(len(points) + SHINGLE, np.uint64)
    h[: len(points)] = points
    h[: len(points)] += np.uint64(1)
    factor, width = int(FACTOR), 1
    while width < SHINGLE:  # polynomials of twice the length
        longer = h[:-width] * np.uint64(factor)
        longer += h[width:]
        h, factor, width = longer, factor * factor % (1 << 64), 2 * width
    # None starts at the last places of a line.
    inside = np.ones(len(points), bool)
    inside[(start[1:, None] - np.arange(1, SHINGLE)).reshape(-1)] = False
    return mixed(h[: len(points)][inside]), np.repeat(np.arange(len(lines)), np.diff(start) - (SHINGLE - 1))


def distinct_shingles(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sorted distinct (owner, hash) as one number: 22 bits of owner and 42 of hash."""
    names = owner.astype(np.uint64)
    names <<= np.uint64(42)
    names |= hashes >> np.uint64(22)
    names.sort()
    return names[np.concatenate([[True], names[1:] != names[:-1]])[: len(names)]]


@functools.cache
def other_bins(bins: int) -> np.ndarray:
    """(tries, bins): the bin that a hash of a bin's number and a try points to; from the first try on."""
    tries = np.arange(1, TRIES, dtype=np.uint64) << np.uint64(20)
    return (mixed(np.arange(bins, dtype=np.uint64) + tries[:, None]) % np.uint64(bins)).astype(np.int64)


def least_hashes(lines: list[bytes], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(the least hash of each bin, a row a line; number of distinct shingles of each line). bins: a power of two.

    One sort gives both: by 22 bits of owner, the bin (leading bits of the hash), its lower half, and what bits are left."""
    hashes, owner = shingles(lines)
    n, high = len(lines), bins.bit_length() - 1
    names = owner.astype(np.uint64)
    names <<= np.uint64(high)
    names |= hashes >> np.uint64(64 - high)
    names <<= np.uint64(32)
    names |= hashes & np.uint64(0xFFFFFFFF)
    names <<= np.uint64(10 - high)
    hashes <<= np.uint64(high)
    names |= hashes >> np.uint64(54 + high)
    names.sort()
    names = names[np.concatenate([[True], names[1:] != names[:-1]])[: len(names)]]
    own = (names >> np.uint64(42 - high)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    sizes = np.bincount((own[first] >> high), np.diff(np.append(first, len(own))), minlength=n).astype(np.int64)
    least = np.full(n * bins, ~np.uint64(0))
    least[own[first]] = (names[first] >> np.uint64(10 - high)) & np.uint64(0xFFFFFFFF)
    # An empty bin takes the value of the first full bin that its tries point to; ever more tries are looked at at once.
    filled = least != ~np.uint64(0)
    empty, tries, at, many = np.flatnonzero(~filled), other_bins(bins), 0, 1
    while len(empty) and at < len(tries):
        to = (empty & -bins) + tries[at : at + many, empty & (bins - 1)]
        full = filled[to]
        step, found = full.argmax(axis=0), full.any(axis=0)
        took = np.flatnonzero(found)
        least[empty[took]] = least[to[step[took], took]] + ((step[took] + at + 1).astype(np.uint64) << np.uint64(32))
        empty, at, many = empty[~found], at + many, min(2 * many, 32)
    return least.reshape(n, bins), sizes


def bands(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, one row a line; number of shingles of each line)."""
    least, sizes = least_hashes(lines, BANDS * ROWS)
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        keys = keys * FACTOR + mixed(least[:, r::ROWS] + np.uint64(r))
    return mixed(keys + np.arange(BANDS, dtype=np.uint64)), sizes


_BAND = np.dtype([("band", "<u8"), ("n", "<u4"), ("line", "<i8")])


def band_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, rows): band, size and name of each distinct line of a task, as packed rows of a range of
    bands; the name of a line is a 64-bit hash that only finds candidates."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held: dict[int, bytes] = {}
        ready: list[np.ndarray] = []
        size = 0

        def hashed() -> None:
            keys, n = bands(list(held.values()))
            rows = np.empty(keys.size, _BAND)
            rows["band"], rows["n"] = keys.reshape(-1), np.repeat(n, BANDS)
            rows["line"] = np.repeat(np.fromiter(held, np.int64, len(held)), BANDS)
            ready.append(rows)
            held.clear()

        def out() -> pa.RecordBatch:
            rows = np.concatenate(ready)
            ready.clear()
            own = ((rows["band"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(own, kind="stable")
            rows, own = rows[order], own[order]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            packed = [rows[a:b].tobytes() for a, b in zip(start.tolist(), np.append(start[1:], len(rows)).tolist())]
            return pa.RecordBatch.from_arrays([pa.array(own[start].astype(np.int64)), pa.array(packed, pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            for text in texts_of(batch):
                for _, line in worded(text):
                    key = short_key(line)
                    if key not in met:
                        met.add(key)
                        held[key] = line
                        size += len(line)
                        if size > CHUNK:
                            hashed()
                            size = 0
                if sum(map(len, ready)) > HELD:
                    yield out()
        if held:
            hashed()
        if ready:
            yield out()

    return docs.select("text").mapInArrow(task, "bucket long, rows binary")


def sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return UP * np.minimum(a, b).astype(np.int64) >= DOWN * np.maximum(a, b)


def shared_bands(rows: DataFrame) -> DataFrame:
    """(band, line, n) of the bands that several lines share, each line once; and, without band,
    (line, other): the pairs of a line with the band's first line and with the line before it whose
    sizes allow a link."""
    schema = pa.schema([("band", pa.int64()), ("line", pa.int64()), ("n", pa.int32()), ("other", pa.int64())])

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Rows alone in their band go before the rest is sorted.
        order = np.argsort(rows["band"])
        band = rows["band"][order]
        alone = np.concatenate([[True], band[1:] != band[:-1], [True]])
        rows = rows[order[~(alone[1:] & alone[:-1])]]
        if not len(rows):
            return
        rows = rows[np.lexsort((rows["line"], rows["n"], rows["band"]))]
        band, line, n = rows["band"], rows["line"], rows["n"].astype(np.int64)
        # A line that several tasks sent stands in a row.
        once = np.concatenate([[True], (band[1:] != band[:-1]) | (line[1:] != line[:-1])])
        band, line, n = band[once], line[once], n[once]
        new = np.concatenate([[True], band[1:] != band[:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(band)))
        many = np.repeat(size > 1, size)
        first = np.maximum.accumulate(np.where(new, np.arange(len(band)), 0))
        at = np.flatnonzero(~new)
        x, y = np.concatenate([first[at], at - 1]), np.concatenate([at, at])
        fits = sizes_allow(n[x], n[y])
        pairs = np.sort(np.stack([line[x[fits]], line[y[fits]]]), axis=0)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        pairs = pairs[:, np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])[: pairs.shape[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(band[many].view(np.int64)), pa.array(line[many]), pa.array(n[many].astype(np.int32)), pa.nulls(int(many.sum()), pa.int64())], schema=schema)
        none = pairs.shape[1]
        yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int64()), pa.array(pairs[0]), pa.nulls(none, pa.int32()), pa.array(pairs[1])], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            for bucket, packed in zip(column(batch, "bucket"), column(batch, "rows"), strict=True):
                if bucket != own and held:
                    yield from found(np.concatenate(held))
                    held = []
                own = bucket
                held.append(np.frombuffer(packed, _BAND))
        if held:
            yield from found(np.concatenate(held))

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task, "band long, line long, n int, other long")


def some_lines(docs: DataFrame, lines: DataFrame, column: Callable[[list[bytes]], pa.Array]) -> DataFrame:
    """(line, value) of the distinct lines named by ``lines``, and of few others; value: column(texts)."""
    seen = docs.sparkSession.sparkContext.broadcast(bit_filter(lines, "line"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            texts = [x for text in texts_of(batch) for _, x in worded(text)]
            keys = np.fromiter(map(short_key, texts), np.int64, len(texts))
            some = []
            for k in np.flatnonzero(maybe_in(seen.value, keys)).tolist():
                name = key_of(texts[k])
                if name not in met:
                    met.add(name)
                    some.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), column([texts[k] for k in some])], names=["line", "value"])

    found = docs.select("text").mapInArrow(task, "line long, value binary")
    return found.join(lines.select("line").distinct().hint("merge"), "line", "left_semi").distinct()


def named_lines(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(line, text) of the lines that pairs name."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("line"))
    return some_lines(docs, named, lambda texts: pa.array(texts, pa.binary())).withColumnRenamed("value", "text")


def alike(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Whether the lines x[i] and y[i] link, by their whole sets of shingles."""
    one, two = distinct_shingles(*shingles(x)), distinct_shingles(*shingles(y))
    both = np.concatenate([one, two])
    both.sort()
    count = lambda names: np.bincount((names >> np.uint64(42)).astype(np.int64), minlength=len(x))
    common = count(both[1:][both[1:] == both[:-1]])
    return UP * common >= DOWN * (count(one) + count(two) - common)


_LINKS = "a binary, b binary, line_a long, line_b long"


def links_out(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """128-bit and 64-bit keys of linked lines."""
    columns = [pa.array([key_of(a) for a, _ in pairs], pa.binary()), pa.array([key_of(b) for _, b in pairs], pa.binary())]
    columns += [pa.array([short_key(a) for a, _ in pairs], pa.int64()), pa.array([short_key(b) for _, b in pairs], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "line_a", "line_b"])


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b, line_a, line_b): keys of the lines whose exact similarity links them."""
    both = pairs.join(lines.select(F.col("line").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    both = both.join(lines.select(F.col("line").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("text_a", "text_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = column(batch, "text_a"), column(batch, "text_b")
            at, size, found = 0, 0, []
            for i in range(len(a)):
                size += len(a[i]) + len(b[i])
                if size > CHUNK or i + 1 == len(a):
                    keep = alike(a[at : i + 1], b[at : i + 1])
                    found += [(a[at + k], b[at + k]) for k in np.flatnonzero(keep).tolist()]
                    at, size = i + 1, 0
            yield links_out(found)

    return both.mapInArrow(task, _LINKS)


def open_bands(shared: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """(band, part, text) of the bands whose lines are in several components.

    Of a band of up to three lines each is the first, or before or after each other one: all its
    pairs have been compared. Bands of the same lines are read once. The lines of a large band are
    dealt to parts, and each pair of parts is a band.
    """
    named = shared.join(known.select(F.col("node").alias("line"), "component").hint("merge"), "line", "left")
    named = named.withColumn("part", F.coalesce("component", "line")).drop("component")
    same = [F.bit_xor(F.xxhash64("line", F.lit(k))).alias(f"same{k}") for k in range(2)]
    several = named.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size"), *same).where("low != high and size > 3")
    several = several.groupBy("same0", "same1", "size").agg(F.min("band").alias("band"))
    several = several.select("band", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    rows = written(named.join(several.hint("merge"), "band"), "open")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("line"), "parts")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    band = F.when(F.col("parts") == 1, F.col("band")).otherwise(F.xxhash64("band", F.least("own", "other"), F.greatest("own", "other")))
    texts = some_lines(docs, rows.select("line"), lambda texts: pa.array(texts, pa.binary()))
    return dealt.join(texts.hint("merge"), "line").select(band.alias("band"), "part", F.col("value").alias("text"))


def joining_links(rows: DataFrame) -> DataFrame:
    """The links between lines of a band that join their components: fewer than the band has lines.

    Each line counts the shingles that it shares with every line before it: by a product of a small
    table of the shingles that several lines have, else from lists of the lines that have a shingle.
    Lines that are joined by then are not looked at.
    """

    def shared_with(token: np.ndarray, owner: np.ndarray, lines: int) -> Callable[[int], np.ndarray]:
        """A function of i: how many shingles line i shares with each line before it. token: sorted."""
        kinds = int(token[-1]) + 1 if len(token) else 0
        if lines * kinds <= DENSE:
            table = np.zeros((lines, kinds), np.float32)
            table[owner, token] = 1
            counts = (table @ table.T).astype(np.int64)
            return lambda i: counts[i, :i]
        start, order = np.searchsorted(token, np.arange(kinds + 1)), np.argsort(owner, kind="stable")
        by_line, first = token[order], np.searchsorted(owner[order], np.arange(lines + 1))

        def one(i: int) -> np.ndarray:
            own = by_line[first[i] : first[i + 1]].tolist()
            return np.bincount(np.concatenate([owner[:0], *(owner[start[t] : start[t + 1]] for t in own)]), minlength=lines)[:i]

        return one

    def probe(names: np.ndarray, first: np.ndarray, part: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of lines of a band; names: their distinct shingles, from first[i] on those of line i."""
        size = np.diff(first)
        names = names & np.uint64((1 << 42) - 1)
        order = np.argsort(names)
        ordered = names[order]
        ends = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
        several = np.flatnonzero(~(ends[1:] & ends[:-1]))
        token, owner = np.cumsum(ends[several]) - 1, np.repeat(np.arange(len(size)), size)[order[several]]
        shared, root, found = shared_with(token, owner, len(size)), np.unique(part, return_inverse=True)[1], []
        for i in range(1, len(size)):
            other = root[:i] != root[i]
            if other.any():
                common = shared(i)
                for j in np.flatnonzero(other & (UP * common >= DOWN * (size[:i] + size[i] - common))).tolist():
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        found.append((j, i))
        return found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, part, text), _ in groups(batches, 1 << 40):
            start = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])).tolist()
            ends = [*start[1:], len(band)]
            found, at = [], 0
            while at < len(start):
                # Shingles of several bands at once, up to a chunk of text.
                to, size = at, 0
                while to < len(start) and (to == at or size < CHUNK):
                    size += sum(map(len, text[start[to] : ends[to]]))
                    to += 1
                base = start[at]
                names = distinct_shingles(*shingles(text[base : ends[to - 1]].tolist()))
                first = np.searchsorted(names >> np.uint64(42), np.arange(ends[to - 1] - base + 1, dtype=np.uint64))
                for a, b in zip(start[at:to], ends[at:to]):
                    own = first[a - base : b - base + 1]
                    found += [(text[a + i], text[a + j]) for i, j in probe(names[own[0] : own[-1]], own - own[0], part[a:b])]
                at = to
            yield links_out(found)

    return rows.repartition("band").sortWithinPartitions("band").mapInArrow(task, _LINKS)


def all_links(docs: DataFrame) -> DataFrame:
    """(a, b, line_a, line_b): links that join the lines of each component."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    bands_ = written(shared_bands(band_rows(docs, buckets)), "bands")
    pairs = written(bands_.where("band is null").select(F.col("line").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    links = written(verified(pairs, named_lines(docs, pairs)), "links")
    known = written(components(links.select(F.col("line_a").alias("a"), F.col("line_b").alias("b"))), "known")
    shared = bands_.where("band is not null").select("band", "line", "n")
    return links.union(written(joining_links(open_bands(shared, known, docs)), "links"))


def places(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, number, line): each line with a word by its 128-bit key; those named by ``only``, and few others."""
    seen = None
    if only is not None:
        seen = docs.sparkSession.sparkContext.broadcast(bit_filter(only.select(F.conv(F.hex(F.substring("line", 1, 7)), 16, 10).cast("long").alias("id")), "id"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, i, key_of(x)) for doc, text in zip(column(batch, "doc_id"), texts_of(batch), strict=True) for i, x in worded(text)]
            if seen is not None and rows:
                keep = maybe_in(seen.value, np.array([int.from_bytes(r[2][:7], "big") for r in rows], np.int64))
                rows = [rows[k] for k in np.flatnonzero(keep).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "number", "line"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, number int, line binary")


def doubled_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, numbers): the lines of each document that another line stands for."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    links = all_links(narrow).select("a", "b")
    known = components(links, "binary").select(F.col("node").alias("line"), "component")
    at = places(narrow)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")
    first = at.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(known, "line", "left")
    first = written(first.select("line", "first", "n", F.coalesce("component", "line").alias("component")).where("n > 1 or component is not null"), "first")
    keeper = first.groupBy("component").agg(F.min("first").alias("keeper"), F.sum("n").alias("total")).where("total > 1")
    doubled = written(first.join(keeper.hint("merge"), "component").select("line", "keeper"), "doubled")
    gone = places(narrow, doubled).join(doubled.hint("merge"), "line").where(~(place.eqNullSafe(F.col("keeper")))).select("doc_id", "number")
    return gone.groupBy("doc_id").agg(F.collect_set("number").alias("numbers"))


def without_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with their columns and without the numbered lines; a document left without lines stays
    with an empty text."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("key"))
    rows = rows.join(gone.select(F.col("doc_id").alias("gone_id"), "numbers").hint("merge"), F.col("key").eqNullSafe(F.col("gone_id")), "left")
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("numbers", i))
    text = F.when(F.col("numbers").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(*((text.alias(n) if n == "text" else F.col("row").getField(n).alias(n)) for n in names))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with one line of each component of equal and similar lines in the whole corpus.

    Lines without a word are not compared and stay. Null texts stay null. Rows that share an id
    are one document: a line at the same place in each stays in each. Other lines, in whatever
    document, stay only at their first place by (doc_id, line number); null ids come last.
    """
    return without_lines(docs, written(doubled_lines(docs), "gone"))
