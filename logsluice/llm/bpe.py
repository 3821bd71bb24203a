"""Byte-level BPE: each distinct pre-token is encoded once for the whole corpus.

Texts become pre-token positions (numbers into the word list of their block). The word lists are
shuffled by word; where a word's rows meet, it is encoded once and its ids are joined to each of
its rows. A second shuffle takes the ids back to their blocks, where documents are put together
by position. Decoding joins ids with the token-byte table.
"""

from __future__ import annotations

import base64
import hashlib
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsluice.llm.blocks import Numbers, assembled, by_bucket, documents_of, in_blocks, numbered, packed_bytes, unpacked_bytes
from logsluice.llm.pretokens import Chunks, compiled


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, bytes): bounded by the vocabulary."""
    return spark.createDataFrame(pa.table({"id": pa.array(read_ranks(path).values(), pa.int32()), "bytes": pa.array(read_ranks(path).keys(), pa.binary())}))


def numbering(pattern: str):
    """A fresh (Numbers, text -> numbers of its matches); frequent chunks are matched once."""

    def make():
        numbers, find = Numbers(), compiled(pattern).findall
        chunks = Chunks(lambda part: numbers.of([w.encode() for w in find(part)]).tobytes())
        return numbers, lambda text: np.frombuffer(chunks.encode(text), np.uint32)

    return make


def encoded_words(blocks: DataFrame, path: str, pattern: str) -> DataFrame:
    """Ids of the words of each block; a word is encoded once, where its rows meet."""
    own: list[tiktoken.Encoding] = []

    def solve(_: int, rows: list) -> tuple[list[bytes], None]:
        if not own:
            own.append(encoding(path, pattern))
        known: dict[bytes, bytes] = {}
        for words, _ in rows:
            for word in words:
                if word not in known:
                    known[word] = np.array(own[0].encode_ordinary(word.decode()), "<u4").tobytes()
        return [packed_bytes([known[w] for w in words]) for words, _ in rows], None

    return by_bucket(blocks, solve)


def decoded(rows: DataFrame, key: str, ids: str, tokens: DataFrame) -> DataFrame:
    """(key, bytes): arrays of ids joined with the token-byte table and put together by position.

    The table is broadcast: its size is the vocabulary's. key must be unique. Null or empty
    arrays give empty bytes; an id that the table lacks fails the row's result to null.
    """
    places = rows.select(key, F.posexplode_outer(ids).alias("at", "id"))
    joined = places.join(F.broadcast(tokens), "id", "left")
    parts = joined.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "bytes")))).alias("parts"),
    )
    whole = F.aggregate("parts", F.lit(b""), lambda out, part: F.concat(out, part["bytes"]))
    return parts.select(key, whole.alias("bytes"))


def encode_documents(docs: DataFrame, path: str, pattern: str, put, schema: str) -> DataFrame:
    """put(documents, ids of each word number) -> columns, for each block of documents."""
    # One exchange by block; both of its readers take all its columns, so Spark reuses it.
    blocks = in_blocks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), numbering(pattern)).repartition("block")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        ids: dict[int, bytes] = {}
        for numbers, _, payload in numbered(left, right):
            ids.update(zip(numbers.tolist(), unpacked_bytes(payload), strict=True))
        return put(documents_of(left), [ids[k] for k in range(len(ids))])

    return assembled(blocks, encoded_words(blocks, path, pattern), task, schema)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each whole text; null is empty. Repeated rows stay rows."""

    def put(documents, ids) -> pa.Table:
        names, out = [], []
        for doc, _, numbers in documents:
            names.append(doc)
            out.append(np.frombuffer(b"".join([ids[k] for k in numbers.tolist()]), "<u4").astype(np.int32))
        return pa.table({"doc_id": pa.array(names, pa.int64()), "ids": pa.array(out, pa.list_(pa.int32()))})

    return encode_documents(docs, path, pattern, put, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of each whole text.

    Ids are decoded by look-up of a block's distinct words in the token-byte table (as large as
    the vocabulary), then joined by position. Empty and null texts give empty digests.
    """
    tokens = docs.sparkSession.sparkContext.broadcast([t for t, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])])

    def put(documents, ids) -> pa.Table:
        known = tokens.value
        lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
        texts = [(",".join(map(str, x))).encode() for x in lists]
        parts = [b"".join([known[i] for i in x]) for x in lists]
        lengths = np.array([len(x) for x in lists], np.int64)
        out: tuple[list, ...] = ([], [], [], [])
        for doc, _, numbers in documents:
            at = numbers.tolist()
            out[0].append(doc)
            out[1].append(int(lengths[numbers].sum()) if at else 0)
            out[2].append(hashlib.sha256(b",".join([texts[k] for k in at])).hexdigest())
            out[3].append(hashlib.sha256(b"".join([parts[k] for k in at])).hexdigest())
        return pa.table({"doc_id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()), "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())})

    return encode_documents(docs, path, pattern, put, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
