"""Quality statistics, byte-level BPE and packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from logsluice.llm import bpe, packing, quality, queries

TEXTS = [
    None, "", " ", "\n\n", "One", "a b a b a b a b", "x  y\tz\n \nq  r", "It's the end,\nthey're done. \n", "\nhead line\nhead line\nhead",
    "naïve ÉTÉ 東京 ½ ² 12 3.4 ‘quoted’ 🙂🙂", "tab\there  two   three    four", "a" * 5000, "word " * 3000, "tail space ", "\x1c odd \x1c\x1c", "<|endoftext|> here",
    "same text", "same text",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "en", "s", 0, "clash", 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long, ids string, length double")


def brute_statistics(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_statistics_match_brute_force(docs):
    rows = quality.statistics(docs).collect()
    assert Counter(tuple(r[c] for c in quality.COUNTS) for r in rows) == Counter(map(brute_statistics, TEXTS))


def test_rules_are_learned_from_labels_and_printed():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(900), "b": rng.random(900)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    rules = quality.learn(x, bad)
    hit = np.logical_or.reduce([r.covers(x) for r in rules])
    assert (hit == bad).mean() > 0.97 and "a >=" in rules[0].text()
    assert quality.learn(x, np.zeros(900, bool)) == []


def test_quality_on_labelled_prose(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = [f"w{k}" for k in rng.integers(0, 5000, 120)]
        rows.append((i, " ".join(w + "###" * (i % 4 == 0 and j % 2) for j, w in enumerate(words)), i % 4 and 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality.judged(docs.drop("quality"), docs.select("doc_id", "quality").where("doc_id % 3 > 0"))
    assert {(r.doc_id % 4 != 0) == r.kept for r in out.collect()} == {True}
    assert quality.keep_good(docs.drop("quality"), docs.drop("text")).columns == ["doc_id", "text"]
    none = docs.limit(0)
    assert quality.judged(none.drop("quality"), none.drop("text")).collect() == []


def test_bpe_matches_the_library(spark, docs):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    own = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = Counter()
    for t in TEXTS:
        ids = own.encode_ordinary(t or "")
        expected[len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r)[1:] for r in bpe.round_trip(docs, path, pattern).collect()) == expected
    ids = bpe.encoded(docs.where("doc_id > 3"), path, pattern)
    texts = {i: (t or "").encode() for i, t in enumerate(TEXTS) if i > 3}
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decoded(ids, "doc_id", "ids", bpe.token_table(spark, path)).collect()} == texts
    assert bpe.round_trip(docs.limit(0), path, pattern).collect() == []


def test_bpe_plan_reuses_the_block_exchange(docs):
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_packing_is_exact_and_tight(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    rows = packing.pack_documents(docs, path, public_tokenizers.PATTERN).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(TEXTS):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        own_rows = sorted(by_doc[i if i != 3 else None], key=lambda r: r.piece)
        assert [r.piece for r in own_rows] == list(range(len(own_rows))) and sum(r.length for r in own_rows) == len(ids)
        assert all(r.length == 1024 for r in own_rows[1:])
        for r in own_rows:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for group in by_sequence.values():
        group.sort(key=lambda r: r.offset)
        assert [r.offset for r in group] == [sum(x.length for x in group[:k]) for k in range(len(group))]
        assert sum(r.length for r in group) <= 1024
    assert len(by_sequence) == -(-sum(r.length for r in rows) // 1024)
    assert packing.packed(packing.pieces_of(docs.limit(0), path, public_tokenizers.PATTERN)).collect() == []


def test_added_tokens_in_texts_get_their_ids(spark, tmp_path):
    texts = [*TEXTS, "<|endoftext|>", "a<|endoftext|>b", "x  <|endoftext|>  y\n", " <|endoftext|><|endoftext|>\n\n z", "<|endoftext", "ü<|endoftext|> 🙂"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in queries.op10_best_fit_packing(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        assert sum(n for _, n, _ in got[i]) == len(ids)
        assert all(crc == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n, crc in got[i])


def test_swaps_empty_bins():
    bins = Counter({(6, 2): 1, (5, 2): 1, (4,): 1, (3, 2): 1})
    better = packing.swap_search(bins, 10)
    assert sum(better.values()) < 4
    assert sum((Counter(p) for p, n in better.items() for _ in range(n)), Counter()) == sum((Counter(p) for p in bins), Counter())
    many = {k: 100 for k in range(1, 1024)}
    assert sum(packing.best_fit(many, 1024).values()) <= 1.002 * sum(k * n for k, n in many.items()) / 1024
