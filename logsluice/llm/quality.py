"""Quality rules: decision lists by sequential covering, emitted as ordered Spark conditions.

Statistics are one row per document (Arrow batches, no shuffle). The list is learned on a bounded
sample of labelled documents, chosen by hash of the id; the rules then are plain column
expressions over the statistics of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import column, rows_out, texts_of

SYMBOLS = b"#*$%&|<>"
#: White space of words `[^\x20\x09-\x0D]+`, which bytes.split() splits at.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_letters", "n_marks", "n_distinct", "n_lines")
STATS = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in COUNTS + MORE)])
DDL = "doc_id long, " + ", ".join(f"{x} long" for x in COUNTS + MORE)
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    n = len(known)
    if n < 2_000_000:
        windows = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:  # the code would leave 63 bits: number the pairs first
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def statistics_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n_bytes = sum(map(len, words))
    code_points = len(text.decode()) - (len(text) - n_bytes)
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    upper = len(text) - len(text.translate(None, UPPER))
    return (
        len(words),
        code_points,
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        upper,
        upper + len(text) - len(text.translate(None, LOWER)),
        text.count(b"!") + text.count(b"?"),
        len(set(words)),
        len(lines),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id with counts of each whole text. Null texts count as empty, null ids stay null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = zip(*map(statistics_of, texts_of(batch)), strict=True) if batch.num_rows else [[]] * 10
            yield rows_out(STATS, doc_id=batch.column("doc_id"), **dict(zip(COUNTS + MORE, counts, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, DDL)


def _ratio(top: str, below: str) -> Column:
    return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """Features of the rules as column expressions over the counts."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": _ratio("word_chars", "n_words"),
        "symbol_rate": _ratio("n_symbols", "n_words"),
        "dup_line_rate": _ratio("n_dup_lines", "n_lines"),
        "repeat_rate": _ratio("n_repeat_words", "n_words"),
        "upper_rate": _ratio("n_upper", "n_letters"),
        "mark_rate": _ratio("n_marks", "n_words"),
        "distinct_rate": _ratio("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is_at_least, threshold) that rejects."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, up, at in self.tests:
            out &= x[name] >= at if up else x[name] <= at
        return out

    def text(self) -> str:
        return " AND ".join(f"{n} {'>=' if up else '<='} {at:.6g}" for n, up, at in self.tests) or "true"

    def column(self) -> Column:
        out, known = F.lit(True), features()
        for name, up, at in self.tests:
            out &= known[name] >= F.lit(at) if up else known[name] <= F.lit(at)
        return out


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's information gain."""
    return p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p0 / (p0 + n0))) if p1 else -1.0


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> Rule:
    tests: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < most_tests and bad[inside].any() and not bad[inside].all():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best: tuple[float, tuple[str, bool, float] | None] = (1e-9, None)
        for name in sorted(x):
            values = x[name][inside]
            for at in np.unique(np.quantile(values, np.linspace(0.01, 0.99, 99))):
                for up in (True, False):
                    hit = values >= at if up else values <= at
                    gain = _gain(p0, n0, int((hit & bad[inside]).sum()), int((hit & ~bad[inside]).sum()))
                    if gain > best[0]:
                        best = (gain, (name, up, float(at)))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(tests))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops last tests while (p - n) / (p + n) on held-out rows does not fall."""

    def worth(r: Rule) -> float:
        hit = r.covers(x)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for k in range(len(rule.tests) - 1, 0, -1):
        if worth(short := Rule(rule.tests[:k])) >= worth(best):
            best = short
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.97) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, remove what is covered.

    A rule that rejects with less than the given precision on either part, or covers under five
    rejected rows, ends the list. Rows with equal statistics are all kept: ties change no threshold.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and bad[left].sum() >= 5:
        rows = np.flatnonzero(left)
        held = np.arange(len(rows)) % 3 == 2
        part = lambda keep: ({k: v[rows[keep]] for k, v in x.items()}, bad[rows[keep]])  # noqa: B023, E731
        rule = _prune(_grow(*part(~held), most_tests), *part(held))
        hit = rule.covers({k: v[rows] for k, v in x.items()})
        good_hits = [(bad[rows] & hit & m).sum() / max(1, (hit & m).sum()) for m in (held, ~held)]
        if not rule.tests or (bad[rows] & hit).sum() < 5 or good_hits[1] < precision or ((hit & held).any() and good_hits[0] < precision):
            break
        rules.append(rule)
        left[rows[hit]] = False
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_rules(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> list[Rule]:
    """Rules from labelled documents that pass the base rules; quality 0 is bad, null labels go.

    At most `most_labelled` labels are taken, those with the smallest hash of their id.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = statistics(known).where(~base_failed()).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", *(c.alias(k) for k, c in features().items())).toArrow()
    if not rows.num_rows:
        return []
    order = np.argsort(rows.column("doc_id").to_numpy() * 2654435761 % 4294967291, kind="stable")
    x = {k: rows.column(k).to_numpy()[order] for k in features()}
    return learn(x, np.array(column(rows, "quality"))[order] == 0)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects (from 1), 0 where none does, as one ordered CASE."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules, 1):
        out = out.when(rule.column(), F.lit(i))
    return out.otherwise(F.lit(0))


def judged(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """Statistics of each document with base_failed, rule (0: none) and kept.

    Null and empty texts have no words and fail the base rules. Without labels no rule is learned
    and the base rules decide. Repeated rows are judged row by row.
    """
    rules = fit_rules(docs, labels, most_labelled)
    return statistics(docs).select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that the rules keep, with docs' columns.

    Statistics are computed beside the row in the same pass, so nothing is joined back.
    """
    rules = fit_rules(docs, labels)
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("row"), F.col("text").cast("string"))
    schema = packed.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = list(zip(*map(statistics_of, texts_of(batch)), strict=True)) if batch.num_rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.int64()) for c in counts)], names=["row", *COUNTS, *MORE])

    out = packed.mapInArrow(task, f"row {schema['row'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in COUNTS + MORE))
    return out.where(~base_failed() & (verdict(rules) == 0)).select("row.*")

