"""Collocations against a plain count and against SQL."""

import glob
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from logsluice.llm import collocations
from logsluice.llm.collocations import Scan, segments

SCHEMA = "doc_id long, text string, lang string"
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def pieces_of(text):
    for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
        yield [w for w in re.split("[ \t]", piece) if w]


def plain(rows):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for words in pieces_of(text):
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    f[lang or "und"][tuple(words[i : i + n])] += 1
    out = {}
    for lang, counts in f.items():
        total = sum(c for p, c in counts.items() if len(p) == 1)
        found = {p: c for p, c in counts.items() if len(p) > 1 and c >= 10}
        best = []
        for p, a in found.items():
            score, _, left, right = min(((10**6 * a * a) // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if not any(len(q) > len(p) and p in (q[:2], q[1:]) and 2 * c >= a for q, c in found.items()):
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:2000], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, total, -score)
    return out


def found(spark, rows, parts=3):
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = collocations.collocations(table).collect()
    out = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture
def corpus():
    rng = random.Random(6)
    words = ["red", "Big", "dog", "é", "the", "x\x1cy", "\U0001f600", "ZÄ", "ä"]
    borders = [" ", "  ", "\t", " ", " ", " ", ". ", ",", "\n", "\r\n", "?"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice(borders) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "de", None, "und"])))
    rows += [(7, "new york city hall", "en")] * 30 + [(8, None, "en"), (9, "", "fr"), (None, "alone", "fr"), (None, None, None)]
    return rows


def test_equals_a_plain_count(spark, corpus):
    expected = plain(corpus)
    assert len(expected) > 100
    assert found(spark, corpus) == expected


def test_small_windows_and_flushes_change_nothing(spark, corpus, monkeypatch):
    rows = [*corpus, (50, " ".join(["one", "two", "three"] * 400), "en"), (51, "y" * 5000 + " end", "en"), (52, "the red " * 300, "de")]
    for name, value in (("WINDOW", 300), ("HELD", 500), ("PHRASES", 20), ("BUCKET", 2000)):
        monkeypatch.setattr(collocations, name, value)
    assert found(spark, rows) == plain(rows)


def test_hot_text(spark):
    rows = [(i, "very common passage here, and again", "en") for i in range(3000)] + [(i, f"word{i} other{i % 7} third", "en") for i in range(3000)]
    assert found(spark, rows, 8) == plain(rows)


@pytest.mark.parametrize("window", [40, 100, 1000])
def test_segments_hold_each_phrase_once(window):
    rng = random.Random(window)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb", "ccccccc", "d" * 30]) + rng.choice([" ", "  ", "\t", " ", " ", "."]) for _ in range(rng.randint(0, 200)))
        expected = {n: Counter(tuple(w[i : i + n]) for w in pieces_of(text) for i in range(len(w) - n + 1)) for n in (1, 2, 3)}
        got = {n: Counter() for n in (1, 2, 3)}
        for part in segments(np.frombuffer(text.encode(), np.uint8), 0, 0, window):
            scan = Scan([part], np.array([5], np.uint64))
            for n in got:
                for i in scan.places(n).tolist():
                    got[n][tuple(scan.letters[a:b].tobytes().decode() for a, b in zip(scan.begin[i : i + n], scan.end[i : i + n]))] += 1
        assert got == expected


def test_score_beyond_64_bits(spark):
    big = 4_000_000_000
    rows = spark.createDataFrame([("en", None, 10**11), ("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 1)], "lang string, phrase string, count long")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(collocations, "frequent_phrases", lambda docs: rows)
        got = collocations.collocations(rows).collect()
    assert [r.score for r in got] == [10**6 * (big - 1) ** 2 // (big * (big + 1))]


def test_empty_and_clashing_columns(spark, corpus):
    assert found(spark, []) == {}
    table = spark.createDataFrame([(*r, "k", 1, 2) for r in corpus], SCHEMA + ", phrase string, count int, n int")
    got = {(r.lang, r["rank"]): r.phrase for r in collocations.collocations(table).collect()}
    assert got == {k: v[0] for k, v in plain(corpus).items()}


def test_sql_and_query_agree(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    expected = sorted(con.execute(collocations.SQL).fetchall())
    rows = collocations.collocations(spark.read.parquet(f"{folder}/documents.parquet"))
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows.collect()) == expected
    assert len(expected) > 50
