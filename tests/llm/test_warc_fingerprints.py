"""WARC round trips and Order MinHash against brute force."""

import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from logsluice.llm import fingerprints, warc


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "same\r\n\r\nWARC/1.0\r\n", "same\r\n\r\nWARC/1.0\r\n", "x" * 300_000, "same\r\n\r\nWARC/1.0\r\n", "<p>é</p>"]
    rows = [(20 - i, f"http://h/{i}\n?q" if i else None, t, "clash") for i, t in enumerate(html)] + [(13, "u", "x" * 9, "r"), (13, "u", "x" * 9, "r"), (None, None, "x" * 9, "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    got = sorted(tuple(map(str, r)) for r in warc.archived(pages).collect())
    first = {}
    for i, _, t, _ in rows:
        key = (t or "").encode()
        first[key] = min(first.get(key, 10**9), i if i is not None else 10**9)
    want, seen = [], set()
    for i, _, t, _ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        p = (t or "").encode()
        response = p not in seen
        seen.add(p)
        want.append(tuple(map(str, (i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else first[p]))))
    assert got == sorted(want)
    assert warc.archived(pages.limit(0)).collect() == []


def test_warc_pushes_header_predicates(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i % 3}", f"body {i // 2}") for i in range(20)], "page_id long, url string, html string")
    warc.write_records(warc.with_revisits(pages), str(tmp_path))
    warc.register(spark)
    rows = spark.read.format("warc").option("payload", "false").load(str(tmp_path))
    some = rows.where((F.col("warc_type") == "revisit") & F.col("target_uri").isin("u0", "u1"))
    assert some.count() == 7 and some.where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([warc.EqualTo(("warc_type",), "revisit")])) == [] and reader.wanted == {"warc_type": {"revisit"}}


def test_long_headers_and_archives_of_other_writers(spark, tmp_path):
    own, other = tmp_path / "own", tmp_path / "other"
    urls = ["http://h/" + "u" * n for n in (*range(16_040, 16_160, 5), 70_000)]
    pages = spark.createDataFrame([(i, u, f"body {i}") for i, u in enumerate(urls)], "page_id long, url string, html string").repartition(2)
    warc.write_records(warc.with_revisits(pages), str(own))
    warc.register(spark)
    got = spark.read.format("warc").option("verify", "true").load(str(own)).select("target_uri", "payload", "payload_bytes").collect()
    assert sorted((r.target_uri, bytes(r.payload).decode(), r.payload_bytes) for r in got) == sorted((u, f"body {i}", len(f"body {i}")) for i, u in enumerate(urls))
    body = b"HTTP/1.1 200 OK\r\nServer:x\r\n\r\n" + bytes(range(256)) * 900
    plain = b"one\r\n\r\ntwo"
    other.mkdir()
    with open(other / "a.warc.gz", "wb") as out:
        for kind, content, block in (("warcinfo", "application/warc-fields", b"a: b\r\n"), ("response", "application/http; msgtype=response", body), ("resource", "text/plain", plain)):
            out.write(gzip.compress(f"WARC/1.0\r\nwarc-type:{kind}\r\nWARC-Target-URI: u\r\nContent-Type:{content}\r\nContent-Length:{len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))
    got = spark.read.format("warc").load(str(other)).collect()
    assert [(r.warc_type, r.target_uri, bytes(r.payload), r.payload_bytes) for r in got] == [("response", "u", body.split(b"\r\n\r\n", 1)[1], 230_400), ("resource", "u", plain, len(plain))]


def test_fingerprints(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 40, 700]))) for _ in range(30)] + [None, "", " ", "é", "a b " * 400, "a b " * 400, "x" * 5000]
    rows = [(i * 3000, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    out = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(out) == len(rows)
    near = []
    for i, t, _ in rows:
        t, following = t or "", rows[(i // 3000 - 1) % len(rows)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= out[i].near_next <= 1 and (edited != t or out[i].near_edited == 1)
        if len(t.split()) > 500 and following != t:
            near.append((out[i].near_edited, out[i].near_next))
    assert all(a > b for a, b in near) and sum(a for a, _ in near) / len(near) > 0.15
    assert out[34 * 3000].fingerprint == out[35 * 3000].fingerprint and out[35 * 3000].near_next == 1
    plan = fingerprints.fingerprints(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))
    assert fingerprints.fingerprints(docs.limit(0)).collect() == []


def test_fingerprint_matches_brute_force_selection(spark):
    """Occurrence numbers, buckets and text order redone in Python from Spark's own hashes."""
    text = "a b a b c a b d e a b " * 7 + "tail of text"
    frame = spark.createDataFrame([(text,)], "text string")
    got = frame.select(fingerprints.signature("text").alias("s")).first().s
    w = text.split()
    hashed = lambda sql: frame.select(F.expr(sql).alias("v")).first().v
    mers = [hashed(f"xxhash64('{x}', '{y}')") for x, y in zip(w, w[1:], strict=False)]
    seen, keys = {}, []
    for at, h in enumerate(mers):
        h >>= 24
        seen[h] = seen.get(h, -1) + 1
        keys.append((hashed(f"xxhash64({h}L, {seen[h]})") >> 24, at))
    by_bucket = {}
    for g, at in sorted(keys):
        by_bucket.setdefault((g >> 34) & 63, []).append((at, g))
    want = set()
    for b, group in by_bucket.items():
        chosen = [g for _, g in sorted(group[:2])]
        want.add((b << 32) | (hashed(f"xxhash64({', '.join(f'{g}L' for g in chosen)})") & 0xFFFFFFFF))
    assert set(got) == want


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d e f"), (None, None)], "doc_id long, text string")
    assert fingerprints.fingerprints(docs).count() == 4
    assert fingerprints.fingerprints(docs.limit(1)).first().near_next == 1
