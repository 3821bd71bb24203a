"""Exact N-gram Jaccard join by set relations: skipped index lists and derived answers.

Sets are indexed by prefix (the tokens that a partner must share), in one global order: tokens
that are frequent anywhere last, others by hash. An index list has its entries in blocks by the
number of tokens that follow; a block whose best entry cannot reach the overlap is skipped.

Answers are derived, not computed again. Each set is first compared with the one set that shares
most of its lists; linked sets are one component. Sets whose lists still hold several components are
compared once with a pivot, the root of the largest component in their lists, and keep the difference
to it. Sets of one pivot derive their answers from those differences: |x & y| = |z| - |z - x| - |z - y|
+ what the two differences share; most pairs are settled by the sizes alone. Only pairs of different
pivots are left to be compared by themselves, and those are first bounded by a third of each set.
No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import bit_filter, column, components, filter_bits, maybe_in, mixed, shingle_sets, spread, sums_of, texts_of, written

#: Two sets link when UP * intersection >= DOWN * union.
UP, DOWN = 100, 75
HEAVY_HERE, FLUSH = 4, 4_000_000
BLOCK = 128
#: A sketch is the first SKETCH-th of a set in the order of its hashes. A pivot is kept where it may share
#: half of what a link needs. Differences that a task compares at once, in bytes.
SKETCH, NEAR, PART_BYTES = 3, 0.5, 32 << 20


def signs(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of sets that lie one after the other."""
    return sums_of(mixed(tokens), sizes).view(np.int64), sums_of(mixed(tokens ^ np.uint64(0x5BD1E995)), sizes).view(np.int64)


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """Per document its set size, 128-bit set hash and sketch (the first hashes, 32 bits of each); and
    rows (token, count) of tokens that are frequent in a task (those have no size)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()), ("token", pa.int64()), ("count", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(kept), return_counts=True)
            at = np.flatnonzero(counts >= HEAVY_HERE)
            at = at[np.argsort(-counts[at], kind="stable")[:20_000]]
            none = pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(at), pa.binary()), pa.array(tokens[at].view(np.int64)), pa.array(counts[at])], schema=schema)

        for batch in batches:
            done = 0
            for tokens, sizes in shingle_sets(texts_of(batch), n):
                few = -(-sizes // SKETCH)
                sketch = (tokens[spread(np.cumsum(sizes) - sizes, few)] >> np.uint64(32)).astype("<u4")
                ends = np.append(0, 4 * np.cumsum(few)).astype(np.int32)
                sketches = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(sketch)])
                none = pa.nulls(len(sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(sizes)), pa.array(sizes), *map(pa.array, signs(tokens, sizes)), sketches, none, none], schema=schema)
                done += len(sizes)
                kept.append(tokens)
                held += len(tokens)
                if held >= FLUSH:
                    yield frequent()
                    kept, held = [], 0
        if kept:
            yield frequent()

    return docs.mapInArrow(task, "doc_id long, n_shingles long, s1 long, s2 long, sketch binary, token long, count long")


def prefix_length(n):
    """A partner shares one of so many first tokens: it has at least ceil(0.75 n) of all."""
    return n - -(-DOWN * n // UP) + 1


def index_rows(docs: DataFrame, heavy: np.ndarray, ranks: np.ndarray, n: int) -> DataFrame:
    """(token, doc_id, n, rest): prefix entries; rest counts the tokens after it in the set.

    heavy: frequent tokens, sorted (100,000 at most), with ranks by count; they come last. Sets that a task has met before are left to the exact groups.
    """
    names = ["token", "doc_id", "n", "rest"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int, int]] = set()
        # By their first bits, most tokens are known not to be frequent.
        some = np.zeros(1 << 20, bool)
        some[heavy >> np.uint64(44)] = True
        for batch in batches:
            docs_, done = column(batch, "doc_id"), 0
            for tokens, sizes in shingle_sets(texts_of(batch), n):
                own = docs_[done : done + len(sizes)]
                done += len(sizes)
                new = np.zeros(len(sizes), bool)
                for k, (doc, *sign) in enumerate(zip(own, sizes.tolist(), *(x.tolist() for x in signs(tokens, sizes)), strict=True)):
                    if sign[0] and doc is not None and (sign := tuple(sign)) not in met:
                        met.add(sign)
                        new[k] = True
                if not new.any():
                    continue
                tokens, sizes = tokens[np.repeat(new, sizes)], sizes[new]
                doc = np.array([d for d, x in zip(own, new.tolist(), strict=True) if x], np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                rank = np.zeros(len(tokens), np.int64)
                maybe = np.flatnonzero(some[tokens >> np.uint64(44)])
                if len(maybe):
                    at = np.minimum(np.searchsorted(heavy, tokens[maybe]), len(heavy) - 1)
                    rank[maybe] = np.where(heavy[at] == tokens[maybe], ranks[at], 0)
                rare, often = np.flatnonzero(rank == 0), np.flatnonzero(rank)
                often = often[np.lexsort((rank[often], owner[often]))]
                # Place of each token in its set's order, rare ones first.
                n_rare = np.bincount(owner[rare], minlength=len(sizes))
                order = np.concatenate([rare, often])
                place = np.concatenate([spread(np.zeros(len(sizes), np.int64), n_rare), spread(n_rare, sizes - n_rare)])
                kept = place < prefix_length(sizes)[owner[order]]
                order, place = order[kept], place[kept]
                k = sizes[owner[order]]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[order].view(np.int64)), pa.array(doc[owner[order]]), pa.array(k.astype(np.int32)), pa.array((k - 1 - place).astype(np.int32))], names=names)

    return docs.mapInArrow(task, "token long, doc_id long, n int, rest int")


def groups(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of whole groups (equal first column in sorted rows); a group over `most` rows comes
    in parts, each marked True."""
    held: list[np.ndarray] = []
    cut = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
        if cut is not None and len(held[0]) and held[0][-1] != cut:
            end = int(np.searchsorted(held[0], cut, side="right"))
            if end:
                yield [x[:end] for x in held], True
            held, cut = [x[end:] for x in held], None
        if not len(held[0]):
            continue
        start = int(np.searchsorted(held[0], held[0][-1]))
        if start:
            yield [x[:start] for x in held], False
            held = [x[start:] for x in held]
        elif len(held[0]) > most:
            cut = held[0][-1]
            yield held, True
            held = [x[:0] for x in held]
    if held and len(held[0]):
        yield held, cut is not None


def may_link(n1, n2, r1, r2):
    """Length and position filter of two entries of a list."""
    need = -(-DOWN * (n1.astype(np.int64) + n2) // (UP + DOWN))
    return (UP * np.minimum(n1, n2).astype(np.int64) >= DOWN * np.maximum(n1, n2)) & (1 + np.minimum(r1, r2) >= need)


def index_lists(rows: DataFrame) -> DataFrame:
    """(list, doc_id, n, rest) of the lists with two sets or more. Equal lists get one id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (token, doc, n, rest), partial in groups(batches):
            new = np.concatenate([[True], token[1:] != token[:-1]])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(token)))
            many = np.repeat((size > 1) | partial, size)
            # A list's id is the sum of its documents' hashes; a list in parts has its token's.
            sums = np.add.reduceat(mixed(mixed(doc.view(np.uint64)) + np.uint64(1)), start)
            ids = np.repeat(sums if not partial else mixed(token[start].view(np.uint64)), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[many]), pa.array(doc[many]), pa.array(n[many]), pa.array(rest[many])], names=["list", "doc_id", "n", "rest"])

    cut = rows.repartition("token").sortWithinPartitions("token", "n", "doc_id")
    lists = cut.mapInArrow(task, "list long, doc_id long, n int, rest int")
    return lists.groupBy("list", "doc_id").agg(F.max("n").alias("n"), F.max("rest").alias("rest"), F.count("*").alias("times"))


def nearest_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): for each set b the set a that shares most of the lists that b has a candidate in.

    Candidates are the list's first set and the set before: two pairs per entry at most.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, doc, n, rest, times), _ in groups(batches):
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            at = np.flatnonzero(~new)
            a, b = np.concatenate([first[at], at - 1]), np.concatenate([at, at])
            keep = may_link(n[a], n[b], rest[a], rest[b])
            a, b = a[keep], b[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[a], doc[b])), pa.array(np.maximum(doc[a], doc[b])), pa.array(times[b])], names=["a", "b", "times"])

    ordered = lists.repartition("list").sortWithinPartitions("list", "n", "doc_id").select("list", "doc_id", "n", "rest", "times")
    pairs = ordered.mapInArrow(task, "a long, b long, times long").groupBy("a", "b").agg(F.sum("times").alias("times"))
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).where("a != b").select("a", "b")


def pairs_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def with_parts(lists: DataFrame, known: DataFrame) -> DataFrame:
    """lists with part: the component of each set as known so far."""
    named = lists.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return named.withColumn("part", F.coalesce("component", "doc_id")).drop("component")


def unsettled(lists: DataFrame, known: DataFrame) -> DataFrame:
    """Lists of more than one part, with the size of each set's part and the list's number of
    pairs between parts, shared among its rows."""
    named = with_parts(lists, known)
    per_part = named.groupBy("list", "part").agg(F.count("*").alias("c"))
    per_list = per_part.groupBy("list").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("same")).where("size * size > same")
    weights = known.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("weight"))
    out = named.join(per_list.select("list", F.expr("(size * size - same) / 2.0 / size").alias("pairs")), "list").join(weights, "part", "left")
    return out.select("list", "doc_id", "n", "rest", "times", "part", F.coalesce("weight", F.lit(1)).alias("weight"), "pairs")


def pivots(lists: DataFrame) -> DataFrame:
    """(a, b): for each set b of unsettled() lists its pivot a, the root of the largest component in the
    lists that it has most of. A root may be its own pivot."""
    heavy = lists.groupBy("list").agg(F.max_by("part", F.struct("weight", -F.col("part"))).alias("a"))
    pairs = lists.join(heavy, "list").groupBy(F.col("doc_id").alias("b"), "a").agg(F.sum("times").alias("times"))
    return pairs.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).where("a != b").select("a", "b")


def most_shared(x: np.ndarray, n_x: int, y: np.ndarray, n_y: int) -> int:
    """What two sets share at most, by their sketches. Both hold all hashes below the smaller of their last ones."""
    if not len(x) or not len(y):
        return 0
    last = min(x[-1], y[-1])
    x, y = x[: np.searchsorted(x, last)], y[: np.searchsorted(y, last)]
    at = np.searchsorted(y, x)
    same = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return same + min(n_x - len(x), n_y - len(y))


def needed(n_x, n_y):
    """The overlap of a link."""
    return -(-DOWN * (n_x + n_y) // (UP + DOWN))


def sketched(pairs: DataFrame, sets: DataFrame, share: float = 1.0) -> DataFrame:
    """The pairs (a, b) whose sketches allow `share` of the overlap of a link."""
    own = named_by(pairs, sets.select("doc_id", "n_shingles", "sketch")).dropDuplicates(["doc_id"])
    side = lambda x: own.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, x, y = (column(batch, c) for c in ("n_a", "n_b", "sketch_a", "sketch_b"))
            keep = [most_shared(np.frombuffer(p, "<u4"), i, np.frombuffer(q, "<u4"), j) >= share * needed(i, j) for i, j, p, q in zip(n_a, n_b, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(task, "a long, b long")


def settled_by_pivot(rows: DataFrame) -> DataFrame:
    """(a, b): the links that join components of sets with one pivot, from their differences alone; fewer
    than the group has sets.

    rows: those of differences() with part, the component of the set. The sets of a large group are
    dealt to parts, and each pair of parts is a group.
    """

    def probe(doc: np.ndarray, n: np.ndarray, minus: np.ndarray, n_pivot: int, tokens: list[np.ndarray], part: np.ndarray) -> list[tuple[int, int]]:
        order = np.argsort(n, kind="stable")
        doc, n, minus, part = doc[order], n[order], minus[order], part[order]
        size = np.array([len(tokens[k]) for k in order])
        first = np.concatenate([[0], np.cumsum(size)])
        _, token = np.unique(np.concatenate([tokens[k] for k in order]), return_inverse=True)
        by_token = np.argsort(token, kind="stable")
        owner = np.repeat(np.arange(len(doc)), size)[by_token]
        start = np.searchsorted(token[by_token], np.arange((int(token.max()) if len(token) else -1) + 2))
        root, found = np.unique(part, return_inverse=True)[1], []
        for i in range(1, len(doc)):
            before = np.arange(int(np.searchsorted(UP * n[:i], DOWN * n[i])), i)
            before = before[root[before] != root[i]]
            if not len(before):
                continue
            least = n_pivot - minus[before] - minus[i]
            need = needed(n[before], n[i])
            linked, open_ = least >= need, (least < need) & (least + np.minimum(size[before], size[i]) >= need)
            if open_.any():
                lists = [owner[start[t] : start[t + 1]] for t in token[first[i] : first[i + 1]].tolist()]
                common = np.bincount(np.concatenate(lists), minlength=len(doc))[before] if lists else np.zeros(len(before), np.int64)
                linked |= open_ & (least + common >= need)
            for j in before[linked].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    found.append((int(doc[j]), int(doc[i])))
        return found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, doc, part, n, minus, n_pivot, tokens), _ in groups(batches, 1 << 40):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            for s, e in zip(start, [*start[1:], len(key)], strict=True):
                found = probe(doc[s:e], n[s:e], minus[s:e], int(n_pivot[s]), [np.frombuffer(x, np.uint64) for x in tokens[s:e]], part[s:e])
                if found:
                    yield pairs_out(found)

    several = rows.groupBy("pivot").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.sum(F.octet_length("tokens")).alias("bytes")).where("low != high")
    split = rows.join(several.select("pivot", F.ceil((F.col("bytes") + 1) / PART_BYTES).cast("int").alias("parts")), "pivot").withColumn("own", F.pmod(F.xxhash64("doc_id"), "parts"))
    split = split.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    key = F.when(F.col("parts") == 1, F.col("pivot")).otherwise(F.xxhash64("pivot", F.least("own", "other"), F.greatest("own", "other")))
    ordered = split.select(key.alias("group"), "doc_id", "part", "n", "minus", "n_pivot", "tokens").repartition("group").sortWithinPartitions("group", "doc_id")
    return ordered.mapInArrow(task, "a long, b long")


def open_pairs(lists: DataFrame, known: DataFrame, settled: DataFrame, most: int = 50_000) -> DataFrame:
    """Pairs of a list whose sets are in different components and have not the same pivot, blocks of
    entries skipped. settled: (doc_id, pivot).

    A list of more than `most` sets is read as pairs of its parts.
    """

    def probe(doc, n, rest, part, pivot, has) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(-rest, kind="stable")
        doc, n, rest, part, pivot, has = doc[order], n[order], rest[order], part[order], pivot[order], has[order]
        starts = np.arange(0, len(doc), BLOCK)
        low = np.minimum.reduceat(n, starts)
        for i in range(1, len(doc)):
            # Entries before i have as many tokens left or more, so those of i bound the overlap;
            # blocks whose shortest set asks for more are skipped.
            need = -(-DOWN * (low[: i // BLOCK + 1].astype(np.int64) + int(n[i])) // (UP + DOWN))
            for s in starts[: i // BLOCK + 1][1 + rest[i] >= need]:
                e = min(s + BLOCK, i)
                hit = (part[s:e] != part[i]) & ~(has[s:e] & has[i] & (pivot[s:e] == pivot[i])) & may_link(n[s:e], n[i], rest[s:e], rest[i])
                if hit.any():
                    other = doc[s:e][hit]
                    yield np.minimum(other, doc[i]), np.maximum(other, doc[i])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        found: list[tuple[int, int]] = []
        for (key, *rest_), _ in groups(batches, 1 << 40):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            part = rest_[3]
            low, high = np.minimum.reduceat(part, start), np.maximum.reduceat(part, start)
            ends = np.append(start[1:], len(key))
            for k in np.flatnonzero(low != high):
                for a, b in probe(*(x[start[k] : ends[k]] for x in rest_)):
                    new = [p for p in zip(a.tolist(), b.tolist(), strict=True) if p not in done]
                    if len(done) > 2_000_000:  # met pairs come out once more, distinct() drops them
                        done.clear()
                    done.update(new)
                    found += new
                if len(found) > 10_000:
                    yield pairs_out(found)
                    found = []
            if found:
                yield pairs_out(found)
                found = []

    named = with_parts(lists, known).select("list", "doc_id", "n", "rest", "part").join(settled, "doc_id", "left")
    named = named.withColumn("has", F.col("pivot").isNotNull()).withColumn("pivot", F.coalesce("pivot", "doc_id"))
    # Lists inside one component are settled: they go before anything is gathered by list. A long
    # list is split: its sets are dealt into parts, and each pair of parts is a list.
    mixed_lists = named.groupBy("list").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("size")).where("low != high")
    split = named.join(mixed_lists.select("list", F.ceil(F.col("size") / most).cast("int").alias("parts")), "list").withColumn("own", F.pmod(F.xxhash64("doc_id"), "parts"))
    split = split.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    key = F.when(F.col("parts") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")))
    ordered = split.select(key.alias("list"), "doc_id", "n", "rest", "part", "pivot", "has").repartition("list").sortWithinPartitions("list", "doc_id")
    return ordered.mapInArrow(task, "a long, b long").distinct()


def set_list(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The shingle hashes of each text, sorted."""
    return [x for tokens, sizes in shingle_sets(texts, n) for x in np.split(tokens, np.cumsum(sizes)[:-1])]


def compared(pairs: DataFrame, docs: DataFrame, n: int, judge: Callable, schema: str) -> DataFrame:
    """Rows of judge((a, b, set of a, set of b) of a batch's pairs), with schema. docs: (doc_id, text)."""
    texts = named_by(pairs, docs).groupBy("doc_id").agg(F.min("text").alias("text"))
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
            last, own = None, np.empty(0, np.uint64)
            for s in range(0, batch.num_rows, 256):
                some = batch.slice(s, 256)
                a, x = column(some, "a"), texts_of(some, "text_a")
                new = [p != q for p, q in zip(a, [last, *a], strict=False)]
                found = iter(set_list([t for t, is_new in zip(x, new, strict=True) if is_new] + texts_of(some, "text_b"), n))
                owns = iter([next(found) for is_new in new if is_new])
                for i, j, is_new, y in zip(a, column(some, "b"), new, found, strict=True):
                    if is_new:
                        last, own = i, next(owns)
                    yield i, j, own, y

        for batch in batches:
            yield judge(sets(batch))

    return both.mapInArrow(task, schema)


def linked(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def judge(rows: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keep = []
        for a, b, x, y in rows:
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common > 0 and UP * common >= DOWN * (len(x) + len(y) - common):
                keep.append((a, b))
        return pairs_out(keep)

    return compared(pairs, docs, n, judge, "a long, b long")


def differences(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(pivot, doc_id, n, minus, n_pivot, tokens): for pairs (pivot, set) that share NEAR of what a link
    needs, the hashes that one of both has; the first `minus` of them are the pivot's. Pivots come too."""
    schema = pa.schema([("pivot", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("minus", pa.int64()), ("n_pivot", pa.int64()), ("tokens", pa.binary())])

    def judge(rows: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out: list[tuple] = []
        last = None
        for a, b, x, y in rows:
            less, more = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            if len(x) - len(less) >= NEAR * needed(len(x), len(y)):
                if a != last:
                    out.append((a, a, len(x), 0, len(x), b""))
                    last = a
                out.append((a, b, len(y), len(less), len(x), np.concatenate([less, more]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    return compared(pairs, docs, n, judge, "pivot long, doc_id long, n long, minus long, n_pivot long, tokens binary").dropDuplicates(["pivot", "doc_id"])


def named_by(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose doc_id is in pairs, and few others: thinned out by a filter sized by the pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    seen = rows.sparkSession.sparkContext.broadcast(bit_filter(ids, "id", filter_bits(2 * pairs.count())))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(maybe_in(seen.value, ids)))

    return rows.mapInArrow(task, rows.schema)


def grown(links: DataFrame, known: DataFrame) -> DataFrame:
    """known with the components that links join."""
    old = known.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return written(components(written(links.union(old), "links")), "known")


def by_key(docs: DataFrame, n: int) -> DataFrame:
    """jaccard_components of rows of which some share an id but not the set: each (id, text) is a node,
    and nodes of one id are one document."""
    rows = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    found = jaccard_components(rows.groupBy("key").agg(F.first("text").alias("text")).select(F.col("key").alias("doc_id"), "text"), n)
    rows = written(rows.select("doc_id", "key").join(found.select(F.col("doc_id").alias("key"), "n_shingles", F.col("component_id").alias("class")), "key"), "rows")
    some = rows.where("doc_id is not null and n_shingles > 0")
    least = some.groupBy("class").agg(F.min("doc_id").alias("a"))
    known = components(some.join(least, "class").select("a", F.col("doc_id").alias("b"))).withColumnRenamed("node", "doc_id")
    return rows.join(known, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    Null and empty texts have empty sets and link with nothing. Rows that share an id are one
    node, which links where one of its texts does; rows with a null id keep a null component. An
    empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(set_rows(docs, n), "sets")
    sets = rows.where("token is null")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    if not full.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("x"), F.max(F.struct("s1", "s2")).alias("y")).where("x != y").isEmpty():
        return by_key(docs, n)
    top = rows.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(100_000).toArrow()
    heavy, counts = top.column("token").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(heavy)
    heavy, ranks = heavy[order], counts[order]
    lists = written(index_lists(index_rows(docs, heavy, ranks, n)), "lists")

    least = full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("a"), F.count("*").alias("rows")).where("rows > 1")
    copies = full.select("s1", "s2", "n_shingles", F.col("doc_id").alias("b")).join(least, ["s1", "s2", "n_shingles"]).select("a", "b").where("a != b")

    first = written(sketched(written(nearest_pairs(lists), "pairs"), full), "pairs")
    known = written(components(written(linked(first, docs, n).union(copies), "links")), "known")
    open_lists = written(unsettled(lists, known), "open")
    to_pivots = written(sketched(written(pivots(open_lists), "pairs"), full, NEAR), "pairs")
    apart = written(differences(to_pivots, docs, n), "differences")
    own = apart.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    known = grown(settled_by_pivot(own.select("pivot", "doc_id", F.coalesce("component", "doc_id").alias("part"), "n", "minus", "n_pivot", "tokens")), known)
    # A pivot may also have another one; then its pairs with its own sets are compared once more.
    settled = apart.groupBy("doc_id").agg(F.max_by("pivot", F.struct(F.col("pivot") != F.col("doc_id"), "pivot")).alias("pivot"))
    left = written(open_pairs(lists, known, settled), "pairs")
    more = written(sketched(left, full), "pairs")
    if not more.isEmpty():
        known = grown(linked(more, docs, n), known)
    out = sets.select("doc_id", "n_shingles").join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """docs without the rows of a component that are not its smallest id, with docs' columns."""
    found = jaccard_components(docs, n)
    drop = found.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


#: The same rows by SQL, over all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, class) AS (SELECT doc_id, doc_id FROM documents UNION SELECT edges.b, reached.class FROM reached JOIN edges ON edges.a = reached.doc_id)
SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(class) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
