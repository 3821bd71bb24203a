"""Deep-shallow sorting and removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from logsluice.llm import suffixes

SHORT = st.lists(st.text("ab", max_size=70).map(str.encode), min_size=1, max_size=40)


@given(SHORT)
def test_order_is_that_of_sorting(text):
    for shallow in (0, 8, 24):
        assert [text[k] for k in suffixes.deep_shallow(text, shallow)] == sorted(text)
    assert [text[k] for k in suffixes.blind_trie(list(range(len(text))), text)] == sorted(text)


@given(st.binary(max_size=30), st.binary(max_size=30), st.binary(max_size=30))
def test_common_prefix(head, a, b):
    want = next((i for i, (x, y) in enumerate(zip(head + a, head + b, strict=False)) if x != y), min(len(head + a), len(head + b)))
    assert suffixes.common_prefix(head + a, head + b) == want


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        yield len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def test_removal_matches_brute_force(spark):
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passages = [prose(n) for n in (30, 60, 90, 250)]
    texts = [None, "", "x" * 300, prose(50), "ab" * 150, "y" * 59, "y" * 60, "y" * 61]
    for i in range(60):
        texts.append("".join(rng.choice([prose(rng.randrange(80)), rng.choice(passages), rng.choice(passages)[5:]]) for _ in range(rng.randrange(1, 7))))
    texts += texts[8:12] + [texts[20] + "tail"] + [p + prose(9) for p in passages for _ in range(15)]
    docs = spark.createDataFrame([(i if i != 30 else None, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, at int").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removed(docs, 60).collect()}
    want = dict(enumerate(brute([(t or "").encode() for t in texts], 60)))
    want[None] = want.pop(30)
    assert got == want
    assert suffixes.removed(docs.limit(0), 60).collect() == []
