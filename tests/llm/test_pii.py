"""Personal data: base spans against a brute-force search, added spans by hand."""

import hashlib
import random
import re

import pytest

from logsluice.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def right_check_digit(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    only = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(EMAIL, text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, "card", m.end()) for m in re.finditer(CARD, text) if 14 <= len(only(m)) <= 19 and right_check_digit(only(m))]
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(PHONE, text) if 10 <= len(only(m)) <= 15]
    return sorted(found)


def rows_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id: r for r in pii.found_personal(docs).collect()}


def check(row, text):
    found = brute(text or "")
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(f[2] == k for f in found) for k in pii.BASE]
    assert {f"{k}:{a}:{b}" for a, _, k, b in found} <= set(row.spans.split(","))


def test_base_spans_equal_a_plain_search(spark):
    rng = random.Random(4)
    letters = "abé1 2.3@-+()4%_\U0001f6009,0\n\t"
    pieces = ["a@b.c", "_d@e.f", "1.2.3.4", "255.0.0.256", "000.00.0.1", "0.0.0.0", "4111 1111 1111 1111", "+1 (743) 555-3824", " ", "é", ".", "@", "7"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(800)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += [None, "", "\n\n", "no data"] + ["same +49 30 123456789"] * 5
    rows = rows_of(spark, texts)
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        check(rows[i], text)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.found_personal(docs).collect()
    assert len(rows) == len(texts)
    for row in rows:
        check(row, texts[row.doc_id])


@pytest.mark.parametrize(
    "text, spans",
    [
        ("pay to IBAN DE89 3704 0044 0532 0130 00 now", "account:12:39"),
        ("ES91 2100 0418 4502 0005 1332 AND so", "account:0:29"),
        ("GB82WEST12345698765432", "account:0:22"),
        ("GB82WEST12345698765431", ""),
        ("ssn 078-05-1120", "social:4:15"),
        ("part 078-05-1120", ""),
        ("ssn of order 078-05-1120", ""),
        ("tel 030 1234 5678", "local_phone:4:17"),
        ("sum 030 1234 5678", ""),
        ("joe [at] mail [dot] org", "spelled_email:0:23"),
        ("call +1 (743) 555-3824 now", "phone:5:22"),
    ],
)
def test_added_spans(spark, text, spans):
    assert rows_of(spark, [text])[0].spans == spans


def test_context_moves_the_score(spark):
    rows = rows_of(spark, ["my card 4111 1111 1111 1111", "the 4111 1111 1111 1111", "order 4111 1111 1111 1111"])
    assert [rows[i].scores for i in range(3)] == [[1.0], [0.7], [0.4]]
    assert all(rows[i].n_card == 1 for i in range(3))


def test_long_texts(spark):
    texts = ["a" * 1_500_000, "1" * 1_000_000, "a@b.c " * 50_000, "1." * 200_000, "+1 " * 100_000, "x@y" * 100_000, "1 " * 300_000, "DE89 " * 90_000]
    rows = rows_of(spark, texts)
    assert rows[2].n_email == 50_000 and rows[2].spans.endswith("email:299994:299999")
    assert rows[3].n_ip == 50_000
    assert all(rows[i].n_email == rows[i].n_card == rows[i].n_phone == 0 for i in (0, 1, 4, 5, 6, 7))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.found_personal(empty).count() == 0
    docs = spark.createDataFrame([(1, "a@b.c", 5, "x"), (1, "a@b.c", 6, "y"), (None, None, None, None)], "doc_id long, text string, start long, personal string")
    rows = pii.with_personal(docs).collect()
    assert sorted((r.doc_id or 0, r.start or 0, len(r.personal)) for r in rows) == [(0, 0, 0), (1, 5, 1), (1, 6, 1)]
    assert pii.found_personal(docs).count() == 3


def test_no_python_and_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = pii.found_personal(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
