"""Whitening against numpy over the whole fit list."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsluice.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors):
    """(n, deviations, whitened up to sign, explained) of the usable vectors, all of one dimension."""
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    covariance = centred.T @ centred / n
    e, u = np.linalg.eigh(covariance)
    order = np.argsort(-e)[:4]
    z = ((n * x - sums) / n).astype(float) @ (u[:, order] / np.sqrt(e[order]))
    return n, [int(((n * r - sums) ** 2).sum()) for r in x], z, e[order] / np.trace(covariance)


def compare(rows, vectors):
    ids = sorted(vectors)
    n, deviations, z, explained = brute([vectors[i] for i in ids])
    found = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(found) == len(ids) * z.shape[1]
    for k in range(z.shape[1]):
        own = np.array([found[i, k + 1].whitened for i in ids])
        sign = np.sign(own @ z[:, k])
        assert np.allclose(own * sign, z[:, k], rtol=1e-7, atol=1e-9)
    for at, i in enumerate(ids):
        assert found[i, 1].n == n and found[i, 1].deviation == deviations[at]
        assert abs(found[i, 1].explained - explained[0]) < 1e-9
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    compare(whitening.whitened(table).collect(), vectors)


@pytest.mark.parametrize("parts", [1, 5])
def test_small_blocks_and_copies(spark, monkeypatch, parts):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(900, 7)) * [5, 4, 3, 2, 1, 0.5, 0.1]
    vectors = {i: (base[i] if i < 600 else base[7]).tolist() for i in range(900)}
    monkeypatch.setattr(whitening, "ENTRIES", 64 * 40)
    table = spark.createDataFrame(list(vectors.items()), SCHEMA).repartition(parts)
    compare(whitening.whitened(table).collect(), vectors)


def test_unusable_vectors_go(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=5).tolist() for i in range(50)}
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([*vectors.items(), *bad], SCHEMA).withColumn("n", F.lit("clash")).withColumn("block", F.lit(1))
    compare(whitening.whitened(table).collect(), vectors)


def test_repeated_and_null_ids_and_short_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, [3.0]), (3, []), (4, [0.0, 0.0])]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 12 and {r.component for r in found} == {1, 2}
    assert {r.n for r in found} == {4}
    assert sum(r.vec_id is None for r in found) == 2 and sum(r.vec_id == 1 for r in found) == 4
    zero = {(r.component, r.whitened) for r in found if r.vec_id in (3, 4)}
    assert len(zero) == 2


def test_no_variance(spark):
    found = whitening.whitened(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], SCHEMA)).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(1, 0, 0.0, 0.0, 0.0)}


def test_large_entries_stay_exact(spark):
    rows = {1: [1e13, -3.0], 2: [-2e13, 5.0], 3: [1.5e13, 7.25]}
    found = {r.vec_id: r for r in whitening.whitened(spark.createDataFrame(list(rows.items()), SCHEMA)).collect()}
    assert all(r.deviation == (1 << 63) - 1 for r in found.values())
    fit = whitening.Fit(3, (1 << 70, 5))
    assert fit.numerators(np.array([[7, 2]]))[0].tolist() == [21 - (1 << 70), 1]
    assert whitening.whole(np.array([1e300, -1e300, -0.001])).tolist() == [2**63 - 1024, -(2**63), -1]


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(table).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).columns[0] == "vec_id"
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0
