"""Best-fit packing of token sequences, improved by swaps between underfull bins.

Only the histogram of piece lengths meets on the driver: at most `capacity` numbers, whatever the
corpus. Bins with the same lengths in them are one pattern with a count, so best fit and the
swaps act on whole runs of bins at once. Pieces find their place by their rank among pieces of
equal length; ranks come from counts per (length, salt) and a window inside each salt.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import column, written
from logsluice.llm.pretokens import Chunks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
Pattern = tuple[int, ...]


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies in JSON write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def json_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizer JSON file; its ids must be in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_letters(), {x["content"] for x in spec["added_tokens"]}
    ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    if [ids[m] for m in merges] != sorted(ids[m] for m in merges):
        raise ValueError("ids are not in the order of the merges")
    return tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in ids.items()}, special_tokens={})


def added_ids(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer JSON file, which stand for themselves wherever a text has them."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is beside them are not known")
    return {x["content"]: x["id"] for x in added}


def pieces_of(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 2, added: bool = False) -> DataFrame:
    """One row per piece of each whole text with the end id; null is empty, so has one id.

    Longer documents are cut into pieces of `capacity`, of which the first may be shorter. With
    `added`, added tokens in a text get their ids, as the tokenizers library does unless
    encode_special_tokens is set; without, they are plain text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = json_encoding(path, pattern)
        chunks = Chunks(lambda part: np.array(encoding.encode_ordinary(part), "<u4").tobytes())
        end = np.array([end_id], "<u4").tobytes()
        own = {t: np.array([i], "<u4").tobytes() for t, i in added_ids(path).items()} if added else {}
        marks = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")") if own else None

        def encoded(text: str) -> bytes:
            if marks is None:
                return chunks.encode(text)
            return b"".join(own[x] if k % 2 else chunks.encode(x) for k, x in enumerate(marks.split(text)))

        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                ids = encoded(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for name, x in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        out[name].append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit decreasing over (length -> count); runs of equal bins are one pattern."""
    room: dict[int, Counter[Pattern]] = defaultdict(Counter)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = [r for r, group in room.items() if r >= size and group]
            if fits:
                r = min(fits)
                pattern, n = max(room[r].items())
                n = min(n, left)
                room[r][pattern] -= n
                if not room[r][pattern]:
                    del room[r][pattern]
                room[r - size][(*pattern, size)] += n
                left -= n
            else:
                each = min(capacity // size, left)
                n = left // each
                room[capacity - each * size][(size,) * each] += n
                left -= n * each
    return sum(room.values(), Counter())


def _moves(a: Pattern, b: Pattern) -> Iterator[tuple[int, Pattern, Pattern]]:
    """(what b gains, lengths from a, lengths from b): a move, one for one, two for one."""
    for i in set(a):
        yield i, (i,), ()
        for j in set(b):
            if i > j:
                yield i - j, (i,), (j,)
    for x in range(len(a)):
        for y in range(x):
            for j in set(b):
                if (d := a[x] + a[y] - j) > 0:
                    yield d, (a[x], a[y]), (j,)


def _changed(pattern: Pattern, out: Pattern, into: Pattern) -> Pattern:
    left = list(pattern)
    for x in out:
        left.remove(x)
    return tuple(sorted((*left, *into), reverse=True))


def swap_search(bins: Counter[Pattern], capacity: int, most_steps: int = 2_000, most_tries: int = 64) -> Counter[Pattern]:
    """Exchanges and moves between underfull bins while the sum of squared fills grows.

    Starts from the emptiest pattern, which gives to the fullest it can: each step is done for as
    many pairs of bins as the two patterns have. Bins that get empty go. The bounds limit the
    steps over patterns, not the documents: what isn't improved stays packed as it is.
    """
    bins = Counter(bins)
    stuck: set[Pattern] = set()
    for _ in range(most_steps):
        under = sorted((p for p in bins if sum(p) < capacity), key=lambda p: (sum(p), p))
        giver = next((p for p in under if p not in stuck), None)
        if giver is None:
            break
        fill, best = sum(giver), None
        for taker in reversed(under[-most_tries:]):
            if taker == giver and bins[giver] < 2:
                continue
            room = capacity - sum(taker)
            for d, out, into in _moves(giver, taker):
                # (b + d)^2 + (a - d)^2 > a^2 + b^2 where b + d > a
                if d <= room and sum(taker) + d > fill and (best is None or (sum(taker) + d, d) > best[0]):
                    best = (sum(taker) + d, d), taker, out, into
            if best and best[0][0] == capacity:
                break
        if best is None:
            stuck.add(giver)
            continue
        _, taker, out, into = best
        n = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
        for p in (giver, taker):
            bins[p] -= n
        for p in (_changed(giver, out, into), _changed(taker, into, out)):
            if p:
                bins[p] += n
        bins = +bins
        stuck.clear()
    return bins


def slots(bins: Counter[Pattern]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, offset) in order of rank."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: Counter[int] = Counter()
    first = 0
    for pattern, n in sorted(bins.items(), reverse=True):
        at = 0
        for size in pattern:
            out[size].append((taken[size], first, at))
            taken[size] += n
            at += size
        first += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset; a written table, as its ranks are used twice.

    Repeated and null ids are pieces of their own. An empty table gives no rows.
    """
    total = pieces.count()
    salts = min(4096, max(16, total // 2_000_000))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    # Ranks of a length go on from salt to salt; only the histogram of lengths reaches the driver.
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    starts = counts.select("length", "salt", before.alias("before"))
    sizes = Counter({r.length: r.n for r in salted.groupBy("length").agg(F.count("*").alias("n")).collect()})
    places = slots(swap_search(best_fit(sizes, capacity), capacity))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                own, ranks = places[int(size)], rank[at]
                k = np.searchsorted(own[:, 0], ranks, side="right") - 1
                sequence[at], offset[at] = own[k, 1] + ranks - own[k, 0], own[k, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", (F.row_number().over(order) - 1).cast("long").alias("rank"))
    ranked = ranked.join(starts, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(task, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 2, added: bool = False) -> DataFrame:
    """Best-fit packing of whole documents into sequences of at most `capacity` tokens."""
    return packed(written(pieces_of(docs, path, pattern, capacity, end_id, added), "pieces"), capacity)
