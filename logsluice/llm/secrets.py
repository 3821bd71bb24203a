"""Secret scans: candidate strings by pattern, false positives removed by a random forest.

A candidate is a run of key characters with a digit or a capital inside, or any value beside a key
name. The forest (numpy) judges its length, its
character transitions, how much of it dictionary words cover, its path, and the words beside it.
It is fitted on a bounded sample of labelled findings; every document is scanned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import column, written

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_@-])(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9@])")
NAME = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|(?<=[?&])key)"
#: A value beside a key name, also a short one or one without a digit.
VALUE = re.compile(rf"""(?i){NAME}["']?\s*(?::=|[:=]>?)\s*["'`]?([^\s"'`,;&<>(){{}}\[\]]{{6,}})""")
#: Names that a key is assigned to.
NAMES = re.compile(r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)[\"']?$")
FEATURES = ("length", "transitions", "digits", "upper", "hexadecimal", "spread", "coverage", "named", "assigned", "quoted", "before_word", "after_word", "path_parts", "path_test", "slashes")
FINDING = "doc_id long, start int, length int, candidate string, before string, after string, path string"


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates in order; those that overlap are one."""
    spans = sorted([m.span() for m in CANDIDATE.finditer(text)] + [m.span(1) for m in VALUE.finditer(text)])
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def findings(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, start, length, candidate, before, after, path) of each candidate; start counts code points."""
    if path not in docs.columns:
        docs = docs.withColumn(path, F.lit(""))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(7))
            for doc, text, where in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for a, b in candidates(text or ""):
                    for values, x in zip(out, (doc, a, b - a, text[a:b], text[max(0, a - 40) : a], text[b : b + 40], where or ""), strict=True):
                        values.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "candidate", "before", "after", "path"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(path).cast("string")).mapInArrow(task, FINDING)


def dictionary(docs: DataFrame, size: int = 5_000) -> frozenset[str]:
    """The most frequent words of 3 to 12 letters: counts over all documents, per task first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update((text or "").split())
        words: Counter[str] = Counter()
        for w, n in counts.items():
            if w.isalpha() and 3 <= len(w) <= 12:
                words[w.lower()] += n
        yield pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r.word for r in rows.orderBy(F.desc("n"), "word").limit(size).collect())


def covered(text: str, words: frozenset[str]) -> float:
    """Share of the letters that the longest dictionary words from left to right take."""
    low, at, hit = text.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at : at + n] in words), 0)
        hit += n
        at += n or 1
    return hit / len(low)


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features_of(candidate: str, before: str, after: str, path: str, words: frozenset[str]) -> tuple[float, ...]:
    kinds = [kind(c) for c in candidate]
    n, counts = len(candidate), np.array(list(Counter(candidate).values()))
    share = counts / n
    head = re.sub(r"[\s\"'`]*(:=|[:=]>?)[\s\"'`]*$", "", before)
    last = before.rstrip("\"'` =:").split()[-1:] or [""]
    following = after.lstrip("\"'`;,.) ").split()[:1] or [""]
    return (
        n, sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), kinds.count(2) / n, kinds.count(1) / n,
        sum(c in "0123456789abcdefABCDEF" for c in candidate) / n, float(-(share * np.log2(share)).sum()), covered(candidate, words),
        bool(NAMES.search(head)), head != before, before[-1:] in ("'", '"', "`") and after[:1] == before[-1:], last[0].isalpha(), following[0].isalpha(),
        path.count("/"), bool(re.search(r"(?i)test|example|sample|mock|fixture|docs?/", path)), candidate.count("/") / n,
    )


@dataclass
class Forest:
    """Trees as arrays (feature, threshold, left, right, value); leaves have feature -1."""

    trees: list[tuple[np.ndarray, ...]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, at, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (live := feature[node] >= 0).any():
                rows = np.flatnonzero(live)
                k = node[rows]
                node[rows] = np.where(x[rows, feature[k]] <= at[k], left[k], right[k])
            out += value[node]
        return out / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        p = float(y[rows].mean())
        nodes.append([-1, 0, 0, 0, p])
        if level == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return me
        best = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            values = x[rows, f]
            for at in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 12))):
                low = values <= at
                a, b = y[rows[low]], y[rows[~low]]
                if min(len(a), len(b)) >= least:
                    mixed = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                    best = min(best, (mixed, int(f), float(at)))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            nodes[me][:4] = [best[1], best[2], grow(rows[low], level + 1), grow(rows[~low], level + 1)]
        return me

    grow(np.arange(len(y)), 0)
    table = np.array(nodes)
    return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 8, least: int = 2, seed: int = 7) -> Forest:
    """Bootstrap trees on random features. Without findings of both labels all get the one label."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return Forest([])
    picks = [rng.integers(0, len(y), len(y)) for _ in range(trees)]
    return Forest([_tree(x[p], y[p].astype(float), rng, depth, least) for p in picks])


def labelled(found: DataFrame) -> DataFrame:
    """Findings with a label by independent evidence, for corpora without reviewed findings: 1 for
    values assigned to a key name, keys with an issuer's prefix, web tokens and bearers; 0 for hashes
    named as such, numbers, UUIDs, paths and plain words; else null. Reviewed labels can take its place."""
    before, text = F.col("before"), F.col("candidate")
    named = before.rlike(rf"""(?i){NAME}["']?\s*(:=|[:=]>?)\s*["'`]?$""")
    assigned = named & (before.rlike("""["'`=]$""")) & (text.rlike("[0-9]") | F.col("after").rlike("""^["'`]"""))
    issued = text.rlike(r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}|^(sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|^xox[abprs]-|^AIza[A-Za-z0-9_-]{30,}|^eyJ[A-Za-z0-9_-]{12,}")
    bearer = before.rlike(r"(?i)\bbearer\s+$")
    hashed = before.rlike(r"(?i)(commit|sha-?[0-9]*|md5|checksum|digest|revision|etag|integrity)[\s:=\"']*$")
    form = text.rlike(r"^[0-9_+/-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^/?(?:[a-z0-9_-]++/){2,}+[a-z0-9_-]*+$|^\p{Ll}++$")
    return found.withColumn("label", F.when(assigned | issued | bearer, 1).when(hashed | ((F.length(text) <= 512) & form), 0))


def fit(findings_with_label: DataFrame, words: frozenset[str], most_labelled: int = 20_000) -> Forest:
    """Forest of at most `most_labelled` labelled findings: of each label those with the smallest
    hashes, up to half of it, so that a rare label is never left out."""
    half, rows = most_labelled // 2, []
    sizes = {r.label: r.n for r in findings_with_label.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64("doc_id", "start", "candidate")
    for label in (0, 1):
        own = findings_with_label.where(F.col("label") == label)
        # About twice the rows wanted have a hash below this, so tasks send no more than that to the driver.
        bound = -(1 << 63) + (1 << 64) * 2 * half // max(1, sizes.get(label, 0))
        near = own.where(key < F.lit(bound)) if bound < 1 << 62 else own
        best = lambda some: some.orderBy(key, "doc_id", "start").select("candidate", "before", "after", "path", "label").limit(half).collect()
        found = best(near)
        rows += found if len(found) == min(half, sizes.get(label, 0)) else best(own)
    x = np.array([features_of(r.candidate, r.before, r.after, r.path, words) for r in rows], float).reshape(-1, len(FEATURES))
    return fit_forest(x, np.array([r.label for r in rows], float))


def judged(found: DataFrame, forest: Forest, words: frozenset[str], threshold: float = 0.5) -> DataFrame:
    """findings with score (mean of the trees) and is_secret; no candidate text goes out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(column(batch, c) for c in ("candidate", "before", "after", "path")), strict=True))
            score = forest.score(np.array([features_of(*r, words) for r in rows], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length")), pa.array(score), pa.array(score >= threshold)], names=["doc_id", "start", "length", "score", "is_secret"])

    return found.mapInArrow(task, "doc_id long, start int, length int, score double, is_secret boolean")


def model_of(docs: DataFrame) -> tuple[Forest, frozenset[str], DataFrame]:
    """Forest, dictionary and the labelled findings, which are written once to the shared folder."""
    words = dictionary(docs)
    found = written(labelled(findings(docs)), "findings")
    return fit(found, words), words, found


def scan(docs: DataFrame) -> DataFrame:
    """Judged candidates of every whole text; null and empty texts and tables give none."""
    forest, words, found = model_of(docs)
    return judged(found, forest, words)


def redact(docs: DataFrame, mark: str = "[secret]", threshold: float = 0.5) -> DataFrame:
    """docs with their columns; candidates judged secret are replaced by `mark` in text."""
    forest, words, _ = model_of(docs)
    names = docs.columns
    where = F.col("source").cast("string") if "source" in names else F.lit("")
    rows = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string").alias("text"), where.alias("path"))
    row = rows.schema["row"].dataType

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for text, path in zip(column(batch, "text"), column(batch, "path"), strict=True):
                hits = candidates(text or "")
                if hits:
                    x = [features_of(text[a:b], text[max(0, a - 40) : a], text[b : b + 40], path or "", words) for a, b in hits]
                    for (a, b), bad in zip(reversed(hits), reversed(forest.score(np.array(x, float)) >= threshold), strict=True):
                        if bad:
                            text = text[:a] + mark + text[b:]
                clean.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(clean, pa.string())], names=["row", "text"])

    out = rows.mapInArrow(task, f"row {row.simpleString()}, text string")
    return out.select(*(F.col("text") if n == "text" else F.col("row").getField(n).alias(n) for n in names))
