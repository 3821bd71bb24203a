"""Phrase collocations by SON partitioning.

The corpus is dealt to shards. A phrase that occurs MIN times occurs MIN / SHARDS times, rounded
up, in one of them, so each shard is mined completely at that local support and the union of the
shards' phrases holds all that can be frequent. This first pass counts 64-bit hashes only, in
bucketed rows; a shard is mined by many tasks, one a bucket. The second pass counts the text of the
union's phrases over the whole corpus, which is exact: what hashes let through too much goes there.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsluice.llm.common import FACTOR, bit_filter, column, maybe_in, mixed, texts_of, written

MIN, WORDS, TOP = 10, 3, 2000
SHARDS = 4
#: Text bytes that are scanned at once; n-grams and phrases that a task holds; text bytes of a bucket.
WINDOW, HELD, PHRASES, BUCKET = 1 << 20, 4 << 20, 200_000, 32 << 20
#: The filter of the second pass has 16 bits a phrase of the union, up to 16 MB; beyond that it
#: lets more phrases through to the exact count.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
NO_LANG = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[ord("\t")] = ord(" ")  # a tab is no part of a word
WORD, BLANK, BORDER = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = BORDER


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for i, base in enumerate(self.bases):
            while len(self.tables[i]) < n:
                known = self.tables[i]
                self.tables[i] = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
        return self.tables[0][:n], self.tables[1][:n]


_POWERS = _Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F)


@dataclass
class Segment:
    """A stretch of a text. Its first ``skip`` words were seen in the stretch before."""

    data: np.ndarray
    skip: int
    group: int  # number of the language
    shard: int


def segments(data: np.ndarray, group: int, shard: int, window: int) -> Iterator[Segment]:
    """A text in stretches that end at piece borders, else between words, two words before the next begins."""
    at, skip = 0, 0
    while at < len(data):
        stop = min(len(data), at + window)
        following = stop
        kind = _KIND[data[at:stop]]
        next_skip = 0
        if stop < len(data):
            border = np.flatnonzero(kind == BORDER)
            if len(border) and skip == 0 or len(border) > 1:
                stop = following = at + int(border[-1]) + 1
            else:
                begins = np.flatnonzero((kind == WORD) & np.concatenate([[True], kind[:-1] != WORD]))
                if len(begins) > max(4, skip + 1):
                    # The last word may go on; the two before it are whole.
                    stop, following, next_skip = at + int(begins[-1]), at + int(begins[-3]), 2
                else:  # a word longer than the window
                    window *= 2
                    continue
        yield Segment(data[at:stop], skip, group, shard)
        at, skip = following, next_skip


class Scan:
    """Words and phrases of several stretches at once, as arrays."""

    def __init__(self, parts: list[Segment], salts: np.ndarray):
        self.data = np.concatenate([p.data for p in parts])
        sizes = np.array([len(p.data) for p in parts])
        start = np.cumsum(sizes) - sizes
        kind = _KIND[self.data]
        first = np.zeros(len(self.data), bool)
        first[start] = True
        word = kind == WORD
        before = np.concatenate([[False], word[:-1]]) & ~first
        self.begin = np.flatnonzero(word & ~before)
        after = np.concatenate([word[1:] & ~first[1:], [False]])
        self.end = np.flatnonzero(word & ~after) + 1
        self.piece = np.cumsum((kind == BORDER) | first)[self.begin]
        own = np.searchsorted(start, self.begin, side="right") - 1
        skip = np.array([p.skip for p in parts])[own]
        number = np.arange(len(own)) - np.searchsorted(own, own)
        self.fresh = number >= skip
        self.group = np.array([p.group for p in parts])[own]
        self.shard = np.array([p.shard for p in parts])[own]
        self.salt = salts[self.group]
        self.letters = _LOWER[self.data]

    def word_hashes(self, which: int) -> np.ndarray:
        power, inverse = _POWERS[which](len(self.data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.letters.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        return mixed((sums[self.end] - sums[self.begin]) * inverse[self.begin] + self.salt)

    def places(self, n: int) -> np.ndarray:
        """Numbers of the first words of the n-word phrases inside pieces that end in a fresh word."""
        m = max(0, len(self.begin) - n + 1)
        return np.flatnonzero((self.piece[:m] == self.piece[n - 1 : n - 1 + m]) & self.fresh[n - 1 : n - 1 + m])


def phrase_hashes(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word phrases that begin at words ``at``."""
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = out * FACTOR + words[at + i]
    return mixed(out)


def scans(batches: Iterator[pa.RecordBatch], groups: dict[str, int], salts: list[int]) -> Iterator[Scan]:
    """All texts of a task, a window at a time. groups and salts grow with the languages met."""
    held: list[Segment] = []
    size = 0
    for batch in batches:
        for doc, lang, text in zip(column(batch, "doc_id"), column(batch, "lang"), texts_of(batch), strict=True):
            if lang not in groups:
                groups[lang] = len(groups)
                salts.append(xxhash.xxh3_64_intdigest(lang))
            shard = (zlib.crc32(text) + (doc or 0)) % SHARDS
            for part in segments(np.frombuffer(text, np.uint8), groups[lang], shard, WINDOW):
                held.append(part)
                size += len(part.data)
                if size >= WINDOW:
                    yield Scan(held, np.array(salts, np.uint64))
                    held, size = [], 0
    if held:
        yield Scan(held, np.array(salts, np.uint64))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash: sorted hashes lie in order of their bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def summed(hashes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes with their counts, at most ``most``. Sorts its input in place."""
    hashes.sort()
    new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[new], np.minimum(np.diff(np.append(new, len(hashes))), most).astype(np.uint8)


def added_up(rows: list[np.ndarray], most: int) -> np.ndarray:
    """Sorted rows of 48 bits of hash and 8 bits of count, the counts of a hash added up, at most ``most``."""
    every = np.concatenate(rows)
    rows.clear()
    every.sort()
    hashes = every >> np.uint64(8)
    new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    counts = np.minimum(np.add.reduceat((every & np.uint64(255)).astype(np.uint8), new, dtype=np.uint32), most)
    return (hashes[new] << np.uint64(8)) | counts.astype(np.uint64)


def keys(low: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """Names of hashes by their bucket and low 48 bits, which is what rows of a bucket hold."""
    return mixed(low + np.asarray(bucket, np.uint64) * FACTOR)


_LOW = np.uint64((1 << 48) - 1)


def local_counts(docs: DataFrame, buckets: int, support: int) -> DataFrame:
    """(bucket, shard, hashes, counts): phrases of 1 to 3 words of each shard, added up in a task.

    Counts stop at the local support, which is all that mining asks of them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(SHARDS)]
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for shard in range(SHARDS):
                every = np.concatenate(held[shard]) if held[shard] else np.empty(0, np.uint64)
                if len(every):
                    hashes, counts = summed(every, support)
                    own = bucket_of(hashes, buckets)
                    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
                    low = (hashes & _LOW).view(np.uint8).reshape(-1, 8)[:, :6]
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        row = [pa.array([int(own[a])], pa.int64()), pa.array([shard], pa.int32()), pa.array([low[a:b].tobytes()], pa.binary()), pa.array([counts[a:b].tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(row, names=["bucket", "shard", "hashes", "counts"])
                    held[shard] = []

        for scan in scans(batches, {}, []):
            words = scan.word_hashes(0)
            for n in range(1, WORDS + 1):
                at = scan.places(n)
                hashes, shards = phrase_hashes(words, at, n), scan.shard[at]
                for shard in range(SHARDS):
                    held[shard].append(hashes[shards == shard])
                size += len(hashes)
            if size >= HELD:
                yield from out()
                size = 0
        yield from out()

    return docs.mapInArrow(task, "bucket long, shard int, hashes binary, counts binary")


def mined(local: DataFrame, support: int) -> DataFrame:
    """(key): the union of the phrases that reach the local support in a shard. A task reads a
    bucket at a time and adds rows up as they come."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: int | None = None
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [added_up(own_rows, support) for own_rows in held.values()]
            held.clear()
            found = [r[(r & np.uint64(255)) >= support] >> np.uint64(8) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(keys(np.unique(np.concatenate(found)), own).view(np.int64))], names=["key"])

        for batch in batches:
            for bucket, shard, hashes, counts in zip(*(batch.column(i) for i in range(4)), strict=True):
                if bucket.as_py() != own:
                    if own is not None:
                        yield out()
                    own, size = bucket.as_py(), 0
                n = len(counts.as_py())
                row = np.zeros((n, 8), np.uint8)
                row[:, 0] = np.frombuffer(counts.as_py(), np.uint8)
                row[:, 1:7] = np.frombuffer(hashes.as_py(), np.uint8).reshape(-1, 6)
                held.setdefault(shard.as_py(), []).append(row.view(np.uint64)[:, 0])
                size += n
                if size >= HELD:
                    for rows in held.values():
                        rows[:] = [added_up(rows, support)]
                    size = 0
        if own is not None:
            yield out()

    return local.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task, "key long")


def phrase_counts(docs: DataFrame, seen: np.ndarray, buckets: int) -> DataFrame:
    """(lang, phrase, count) of the phrases that the filter lets through, added up in a task; with a
    null phrase, the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("count", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, int] = {}
        salts: list[int] = []
        counts: dict[int, dict[bytes | None, int]] = defaultdict(lambda: defaultdict(int))

        def out() -> pa.RecordBatch:
            names = list(groups)
            own = [(names[group], phrase, n) for group, found in counts.items() for phrase, n in found.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in own], f.type) for k, f in enumerate(schema)], schema=schema)

        for scan in scans(batches, groups, salts):
            for group, n in enumerate(np.bincount(scan.group[scan.fresh], minlength=len(groups)).tolist()):
                if n:
                    counts[group][None] += n
            one, two = scan.word_hashes(0), scan.word_hashes(1)
            text = scan.letters.tobytes()
            for n in range(1, WORDS + 1):
                at = scan.places(n)
                hashes = phrase_hashes(one, at, n)
                some = maybe_in(shared.value, keys(hashes & _LOW, bucket_of(hashes, buckets)).view(np.int64))
                hashes, at = hashes[some], at[some]
                other = phrase_hashes(two, at, n)
                if not len(at):
                    continue
                order = np.lexsort((other, hashes))
                hashes, other, at = hashes[order], other[order], at[order]
                # Equal by both hashes: the same phrase.
                cuts = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (other[1:] != other[:-1])]))
                at = at[cuts]
                begin, end = scan.begin[at], scan.end[at + n - 1]
                # Words with one blank between them are cut out as they stand.
                tight = scan.end[at] == end if n == 1 else np.logical_and.reduce([scan.begin[at + k] - scan.end[at + k - 1] == 1 for k in range(1, n)])
                several = np.diff(np.append(cuts, len(hashes)))
                for group, a, b, whole, count in zip(scan.group[at].tolist(), begin.tolist(), end.tolist(), tight.tolist(), several.tolist()):
                    counts[group][text[a:b] if whole else b" ".join(text[a:b].split())] += count
            if sum(map(len, counts.values())) >= PHRASES:
                yield out()
        yield out()

    return docs.mapInArrow(task, "lang string, phrase binary, count long")


def frequent_phrases(docs: DataFrame) -> DataFrame:
    """(lang, phrase, count): exact counts of the phrases of 1 to 3 words that occur MIN times in a
    language; with a null phrase, the language's words."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Buckets grow with the text, so that each stays of bounded size.
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    support = -(-MIN // SHARDS)
    union = written(mined(local_counts(texts, buckets, support), support), "phrases")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * union.count()).bit_length()))
    counted = phrase_counts(texts, bit_filter(union, "key", bits), buckets)
    counted = counted.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("count").alias("count"))
    return written(counted.where(F.col("phrase").isNull() | (F.col("count") >= MIN)), "counts")


def collocations(docs: DataFrame) -> DataFrame:
    """Each language's best phrases of 2 to 3 words: lang, rank, phrase, a, l, r, n, score.

    Null languages are ``und``; null and empty texts have no words. Repeated rows and ids count as
    often as they occur. Equal scores and counts are ranked by the phrase's bytes. Other columns
    play no part. An empty table has no rows.
    """
    counts = frequent_phrases(docs)
    known = counts.where(F.col("phrase").isNotNull())
    words = F.split("phrase", " ")
    phrases = known.select("lang", "phrase", F.col("count").alias("a"), words.alias("w")).where(F.size("w") > 1)

    def cut(k: int) -> Column:
        first, rest = F.slice("w", 1, k), F.slice("w", F.lit(k + 1), F.size("w") - k)
        return F.struct(F.lit(k).alias("k"), F.array_join(first, " ").alias("first"), F.array_join(rest, " ").alias("rest"))

    cuts = F.filter(F.array(*(cut(k) for k in range(1, WORDS))), lambda c: c["rest"] != "")
    parts = phrases.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    for side, name in (("first", "l"), ("rest", "r")):
        parts = parts.join(known.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    score = F.expr("cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * 1000000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    least = parts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = least.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # Phrases inside a longer candidate that occurs at least half as often.
    inner = F.explode(F.array(F.array_join(F.slice("w", 1, 2), " "), F.array_join(F.slice("w", 2, 2), " ")))
    longer = phrases.where(F.size("w") == 3).select("lang", inner.alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (2 * F.col("longer") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    n = counts.where(F.col("phrase").isNull()).select("lang", F.col("count").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


#: The same in DuckDB.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda x: x <> '') AS w FROM pieces),
occurring AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded),
counted AS (SELECT lang, size, phrase, count(*) AS f FROM occurring GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM candidates
  UNION ALL SELECT lang, size, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE size = 3),
scores AS (
  SELECT c.lang, c.size, c.phrase, c.a, k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE g.most IS NULL OR 100 * g.most < 50 * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
